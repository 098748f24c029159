"""BM25 as relations: postings, statistics, candidate scores and full-corpus retrieval."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import bm25_idf, bm25_weight
from ..functions.text import tokenize
from ..sources.scratch import discard, materialize

#: Documents of a shard at least and at most, and questions of a block, of retrieval.
SHARD, SHARD_MOST, ASKED = 1024, 65_536, 65_536


def postings(docs: DataFrame) -> DataFrame:
    """``term, article_id, tf`` of ``docs(article_id, text)``."""
    return docs.select("article_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("term", "article_id").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length, 1 at least; documents without a term count with length 0."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg(F.size(tokenize(F.col("text")))), F.lit(1.0)).alias("mean_length"))


def term_stats(docs: DataFrame) -> DataFrame:
    """``term, df, idf``. A document counts once for a term, so terms meet their frequency without their documents."""
    df = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))


def weighted_postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``term, article_id, weight``: what each posting adds to a score, so that a query only sums.

    Texts are tokenized once: what comes of them is written, and length, frequencies and postings are read from that. An id is one document.
    With ``asked(term, ...)`` postings of these terms alone are written and returned; their weights are the same, from all documents.
    """
    listed = docs.select("article_id", F.array_sort(tokenize(F.col("text"))).alias("ts")).withColumn("length", F.size("ts"))
    # in a sorted list a term's count is the distance between the places where it and the next one start
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
    started = listed.withColumn("at", F.when(F.col("length") > 0, places).otherwise(F.array().cast("array<int>")))
    tf = F.transform("at", lambda i, n: F.struct(F.get("ts", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.col("length")) - i).cast("long").alias("tf")))
    if asked is None:
        counted = materialize(started.select("article_id", "length", tf.alias("tf")), "terms")
        flat = counted.select("article_id", "length", F.explode("tf").alias("t")).select("t.term", "article_id", "length", "t.tf")
    else:
        # each document also has a row of the empty term, which no text has: its length, whatever it holds
        own = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
        each = started.select("article_id", "length", F.explode(F.concat(own, tf)).alias("t")).select("t.term", "article_id", "length", "t.tf")
        wanted = materialize(asked.select("term").union(asked.sparkSession.range(1).select(F.lit(""))).distinct(), "wanted")
        held = materialize(each.join(wanted, "term", "left_semi"), "held")
        counted, flat = held.where("term = ''"), held.where("term <> ''")
    df = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df if asked is None else materialize(df, "df")  # of known size, so that postings needn't move to meet it
    stats = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean_length"))
    joined = flat.join(df, "term").crossJoin(F.broadcast(stats))
    idf = bm25_idf(F.col("n_docs"), F.col("df"))
    return joined.select("term", "article_id", bm25_weight(idf, F.col("tf"), F.col("length"), F.col("mean_length")).alias("weight"))


def recent_titles(history: DataFrame, titles: DataFrame, keys: list[str], recent: int = 5) -> DataFrame:
    """``keys, query``: the titles of the newest clicks joined by blanks; a missing title is empty.

    With two or more clicks the query is never empty, even if all titles are missing; with one it may be.
    """
    last = history.where(F.col("age") < recent).join(titles.select("article_id", "title"), "article_id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("age"), F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"])
    return last.groupBy(*keys).agg(F.array_join(ordered, " ").alias("query"))


def query_terms(history: DataFrame, titles: DataFrame, keys: list[str], recent: int = 5) -> DataFrame:
    """``keys, term``: the distinct terms of each query."""
    q = recent_titles(history, titles, keys, recent)
    return q.select(*keys, F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))


def candidate_scores(candidates: DataFrame, terms: DataFrame, weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the candidates alone: postings are met by candidate before they are met by term."""
    asked = candidates.select(*keys, "pos", "article_id").join(terms, keys)
    sums = asked.join(weighted, ["article_id", "term"]).groupBy(*keys, "pos", "article_id").agg(F.sum("weight").alias("score"))
    return candidates.select(*keys, "pos", "article_id").join(sums, [*keys, "pos", "article_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _score_shard(m: int):
    """The best ``m`` documents of one shard for each question of one block, and whether there are more."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        kind = held.schema.field("article_id").type
        values = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
        ids, doc = np.unique(values(held["article_id"]), return_inverse=True)
        term, weight = values(held["term"]), values(held["weight"])
        order = np.argsort(term, kind="stable")
        term, doc, weight = term[order], doc[order], weight[order]
        total, a, b, found_ids, found_scores, more = np.zeros(len(ids)), [], [], [], [], []
        for batch in asked.to_batches(max_chunksize=4096) if len(ids) else []:
            a_, b_, terms, seen = (batch.column(c) for c in ("_a", "_b", "_terms", "seen"))
            for q in range(batch.num_rows):
                ts = terms[q].values.to_numpy()
                low, high = np.searchsorted(term, ts, "left"), np.searchsorted(term, ts, "right")
                total[:] = 0
                for x, y in zip(low, high, strict=True):
                    if x < y:
                        total[doc[x:y]] += weight[x:y]
                left_out = seen[q].values.to_numpy(zero_copy_only=False)
                if len(left_out):
                    at = np.minimum(np.searchsorted(ids, left_out), len(ids) - 1)
                    total[at[ids[at] == left_out]] = 0
                found = np.flatnonzero(total > 0)
                n = len(found)
                if n > m:  # scores are compared as rounded, so what may round to the least one stays until then
                    found = found[total[found] >= np.partition(total[found], -m)[-m] - 2e-6]
                if n:
                    score = np.round(total[found], 6)
                    best = np.lexsort((ids[found], -score))[:m]
                    a.append(a_[q].as_py())
                    b.append(b_[q].as_py())
                    found_ids.append(ids[found[best]])
                    found_scores.append(score[best])
                    more.append(n > m)
        ends = pa.array(np.cumsum([0, *map(len, found_ids)]), pa.int32())
        flat_ids = pa.array(np.concatenate(found_ids) if a else [], kind)
        flat_scores = pa.array(np.concatenate(found_scores) if a else [], pa.float64())
        lists = [pa.ListArray.from_arrays(ends, flat_ids), pa.ListArray.from_arrays(ends, flat_scores)]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *lists, pa.array(more, pa.bool_())], names=["_a", "_b", "ids", "scores", "more"])

    return run


def _first(k: int, shards: int) -> int:
    """How many documents a shard sends on at first: more of the ``k`` best than chance puts into one of ``shards``, all but never passed."""
    return min(k, math.ceil(k / shards) + 6 * math.ceil(math.sqrt(k / shards)) + 8)


def _best(questions: DataFrame, held: DataFrame, shards: int, blocks: int, m: int, k: int) -> DataFrame:
    """``_a, _b, top, settled`` of questions that meet a document: the ``k`` best in order, and whether no shard may hold one that it did not send."""
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = questions.select("*", F.pmod("_a", F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))
    right = held.select("*", F.pmod(F.xxhash64("article_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))
    kind = dict(held.dtypes)["article_id"]
    schema = f"_a long, _b long, ids array<{kind}>, scores array<double>, more boolean"
    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_score_shard(m), schema)
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    cells = cells.select("_a", "_b", pairs.alias("pairs"), "more").withColumn("last", F.when(F.col("more") & F.lit(m < k), F.element_at("pairs", -1)))
    merged = cells.groupBy("_a", "_b").agg(F.array_sort(F.flatten(F.collect_list("pairs"))).alias("all"), F.min("last").alias("last"))
    # what a shard kept back follows the last that it sent
    settled = F.col("last").isNull() | ((F.size("all") >= k) & (F.col("last") > F.get("all", F.lit(k - 1))))
    return merged.select("_a", "_b", F.slice("all", 1, k).alias("top"), settled.alias("settled"))


def retrieve(terms: DataFrame, weighted: DataFrame, history: DataFrame, keys: list[str], k: int = 200, among: DataFrame | None = None) -> DataFrame:
    """``keys, article_id, score, rank``: the ``k`` best of the corpus; articles of the history are left out.

    With ``among(keys, article_id)`` only the rows of these articles are returned, with their ranks among all; no other row is shuffled.

    Impressions with the same terms and the same history ask one question. Documents are dealt to shards and questions to blocks; a cell of the two is
    summed in one place and sends on somewhat more than its share of the ``k`` best of a question. Should a shard hold more of them than that, the
    question is asked again of all shards for ``k`` each. So what is shuffled is neither a row per question and matching document nor one per
    impression and result. Postings of terms that no query asks for fall away first. Terms travel as 64-bit hashes.
    """
    spark = terms.sparkSession
    kind = dict(weighted.dtypes)["article_id"]
    asked = terms.groupBy(*keys).agg(F.array_sort(F.collect_set(F.xxhash64("term"))).alias("_terms"))
    seen = history.select(*keys, F.col("article_id").cast(kind).alias("article_id")).where("article_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("article_id")).alias("seen"))
    asked = asked.join(seen, keys, "left").withColumn("seen", F.coalesce("seen", F.array().cast(f"array<{kind}>")))
    name = lambda salt: F.xxhash64(F.lit(salt), F.size("_terms"), "_terms", "seen")
    asked = materialize(asked.select("*", name(0).alias("_a"), name(1).alias("_b")), "asked")
    questions = materialize(asked.select("_a", "_b", "_terms", "seen").dropDuplicates(["_a", "_b"]), "questions")
    wanted = materialize(questions.select(F.explode("_terms").alias("term")).distinct(), "wanted")
    held = weighted.select(F.xxhash64("term").alias("term"), "article_id", "weight").join(wanted, "term", "left_semi")
    held = materialize(held, "postings")
    docs = held.agg(F.approx_count_distinct("article_id")).first()[0]
    blocks = max(1, -(-questions.count() // ASKED))
    size = min(SHARD_MOST, max(SHARD, docs * blocks // (4 * spark.sparkContext.defaultParallelism)))
    shards = max(1, -(-docs // size))
    best = materialize(_best(questions, held, shards, blocks, _first(k, shards), k), "best")
    again = best.where("not settled").select("_a", "_b")
    if again.isEmpty():
        discard(held, questions)
    else:
        rest = _best(questions.join(again, ["_a", "_b"], "left_semi"), held, shards, blocks, k, k)
        more = materialize(rest, "best")
        discard(held, questions)
        best = best.where("settled").unionByName(more)
    found = asked.select(*keys, "_a", "_b")
    top = F.transform("top", lambda x, n: F.struct(x["i"].alias("i"), (-x["s"]).alias("s"), (n + 1).alias("n")))
    if among is not None:
        found = found.join(among.groupBy(*keys).agg(F.collect_set(F.col("article_id").cast(kind)).alias("_among")), keys)
        top = F.filter(top, lambda x: F.array_contains("_among", x["i"]))
    found = found.join(best, ["_a", "_b"]).select(*keys, F.explode(top).alias("_x"))
    return found.select(*keys, F.col("_x.i").alias("article_id"), F.col("_x.s").alias("score"), F.col("_x.n").alias("rank"))
