"""Query registry: name to callable over the test tables, and name to the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import doubles, unit
from ..functions.text import entity_ids, labelled_items, newest, recency_weights, tokenize
from ..operators import bm25, bootstrap, metrics, profiling, rankers, validation, vectors
from ..operators.store import dedup, manifest
from ..sources.readers import PLACE, file_profile, read_lines, read_tsv, read_vectors, with_place
from ..sources.scratch import materialize, scratch_path
from ..sources.writers import number_field, rank_lines, text_field, write_store, write_submission, written_lines
from ..streaming.popularity import stream_popularity
from .model import IMP, Model
from .sql import SQL  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
    return f


def ranked(scored: DataFrame) -> DataFrame:
    return rankers.rank(scored, IMP).select(*IMP, "pos", "article_id", "score", "rank")


# ---- store


@query
def store_impressions(m: Model) -> DataFrame:
    c = m.candidates.groupBy(*IMP).agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("y").alias("n_clicked"))
    out = m.impressions.join(c, IMP, "left").join(m.n_history, IMP, "left")
    return out.select(*IMP, "t0", "split", "n_candidates", "n_clicked", F.coalesce("n_history", F.lit(0)).alias("n_history"))


@query
def store_split_counts(m: Model) -> DataFrame:
    return manifest(m.impressions)


@query
def store_articles(m: Model) -> DataFrame:
    return m.articles.select("article_id", "category", "subcategory", F.length("title").cast("long").alias("title_chars"), F.length("abstract").cast("long").alias("abstract_chars"), F.array_join("topics", ",").alias("topics"), "published")


def _two_splits(m: Model) -> DataFrame:
    e = m.events.where("article_id is not null")
    train = e.where("w % 2 = 0").withColumn("source_split", F.lit("train")).withColumn("o", F.lit(0))
    return train.unionByName(e.where("w % 2 <> 0").withColumn("source_split", F.lit("dev")).withColumn("o", F.lit(1)))


@query
def dedup_keep_first(m: Model) -> DataFrame:
    return dedup(_two_splits(m), ["article_id"], ["o", "event_id"]).select("article_id", "source_split", "event_id")


@query
def dedup_keep_last(m: Model) -> DataFrame:
    return dedup(_two_splits(m), ["article_id"], ["o", "event_id"], "last").select("article_id", "source_split", "event_id")


@query
def recency_weights_of_history(m: Model) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("age"), "article_id"))), lambda x: x["article_id"])
    lists = m.past.groupBy(*IMP).agg(ordered.alias("h"))
    each = lists.select(*IMP, F.posexplode(F.arrays_zip("h", recency_weights(F.col("h")).alias("w8"))).alias("i", "z"), F.size("h").alias("n"))
    return each.select(*IMP, (F.col("n") - 1 - F.col("i")).alias("age"), F.col("z.h").alias("article_id"), F.col("z.w8").alias("weight"))


@query
def newest_five(m: Model) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("age"), "article_id"))), lambda x: x["article_id"])
    lists = m.past.groupBy(*IMP).agg(ordered.alias("h"))
    return lists.select(*IMP, F.posexplode(newest(F.col("h"), 5)).alias("age", "article_id"))


@query
def parse_labelled_items(m: Model) -> DataFrame:
    tail = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_type") == "click", "-1").otherwise("-0")
    item = F.concat(F.when(F.col("event_id") % 5 == 0, "A-").otherwise("N"), F.col("article_id").cast("string"), tail)
    text = F.when(F.col("event_id") % 11 == 0, F.concat(item, F.lit("  1 -1"))).otherwise(item)
    candidates, clicked = labelled_items(text)
    return m.events.select("event_id", F.array_join(candidates, "|").alias("candidates"), F.array_join(clicked, "|").alias("clicked"), F.size(clicked).alias("n_clicked"))


@query
def parse_entities(m: Model) -> DataFrame:
    good = F.concat(F.lit('[{"WikidataId":"Q'), F.col("article_id").cast("string"), F.lit('"},{"Label":"x"},{"WikidataId":"Q'), F.col("article_id").cast("string"), F.lit('"}]'))
    text = F.when(F.col("event_id") % 3 == 0, F.lit("garbage")).when(F.col("event_id") % 3 == 1, good)
    return m.events.select("event_id", F.array_join(entity_ids(text), ",").alias("entities"))


# ---- popularity and rankers


@query
def popularity_click_counts(m: Model) -> DataFrame:
    return m.clicks


@query
def stream_popularity_counts(m: Model) -> DataFrame:
    return stream_popularity(m.spark, f"{m.sf_dir}/events.parquet", scratch_path(m.spark, "stream"), F.get_json_object("props", "$.k").cast("long"))


@query
def rank_popularity(m: Model) -> DataFrame:
    out = rankers.rank(rankers.popularity(m.validation, m.clicks, IMP), IMP)
    return out.select(*IMP, "pos", "article_id", "rank")


@query
def rank_log_popularity(m: Model) -> DataFrame:
    return ranked(rankers.log_popular(m.validation, m.clicks, IMP))


@query
def affinity_profile(m: Model) -> DataFrame:
    out = rankers.affinity(m.past, m.articles, IMP, ["category", "subcategory", "topics"], 0.85, 20)
    return out.withColumn("weight", F.round("weight", 6))


@query
def rank_affinity_raw(m: Model) -> DataFrame:
    return ranked(rankers.affinity_ranker(m.validation, m.past, m.articles, m.clicks, IMP))


@query
def rank_affinity_norm(m: Model) -> DataFrame:
    return ranked(rankers.affinity_ranker(m.validation, m.past, m.articles, m.clicks, IMP, normalize=True))


@query
def rank_category_history(m: Model) -> DataFrame:
    return ranked(rankers.affinity_ranker(m.validation, m.past, m.articles, m.clicks, IMP, weights={"category": 1.0}, normalize=True))


@query
def rank_topic_fresh(m: Model) -> DataFrame:
    return ranked(rankers.topic_fresh(m.validation, m.past, m.articles, m.clicks, m.times, IMP))


@query
def rank_topic_fresh_assumed(m: Model) -> DataFrame:
    """The variant that takes an unknown publication time as just now."""
    return ranked(rankers.topic_fresh(m.validation, m.past, m.articles, m.clicks, m.times, IMP, missing_freshness=1.0))


@query
def rank_semantic_candidates(m: Model) -> DataFrame:
    return ranked(rankers.semantic(m.validation, m.past, m.vectors, IMP))


@query
def rank_hybrid(m: Model) -> DataFrame:
    return ranked(rankers.hybrid(m.validation, m.past, m.articles, m.vectors, m.clicks, IMP))


@query
def submission_lines(m: Model) -> DataFrame:
    out = rankers.rank(rankers.popularity(m.validation, m.clicks, IMP), IMP)
    return rank_lines(out, "user_id", IMP)


@query
def validate_permutation(m: Model) -> DataFrame:
    sizes = m.validation.groupBy(*IMP).agg(F.count(F.lit(1)).alias("n_candidates"))
    lines = submission_lines(m)
    broken = F.when(F.col("user_id") % 10 == 0, F.regexp_replace("line", r"\[1", "[2")).otherwise(F.col("line"))
    return validation.validate_lines(lines.withColumn("line", broken), sizes, "user_id", IMP)


@query
def validate_order(m: Model) -> DataFrame:
    """Lists written in source order, every tenth user's among them under a wrong id, read back and held against the source."""
    source = m.validation.groupBy(*IMP).agg(F.count(F.lit(1)).alias("n_candidates")).join(m.impressions.select(*IMP, "t0"), IMP)
    line = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("x"), F.col("line"))).otherwise(F.col("line"))
    lines = submission_lines(m).withColumn("line", line).join(source.select(*IMP, "t0"), IMP)
    folder = scratch_path(m.spark, "submission")
    write_submission(lines, ["t0", *IMP], folder)
    return validation.validate_order(written_lines(m.spark, folder), PLACE, source.withColumn("id", F.col("user_id")), ["t0", *IMP])


# ---- files: what is written in a format and read back


@query
def tsv_round_trip(m: Model) -> DataFrame:
    """Behaviors as a headerless file: typed columns, a missing value and the place of each row."""
    kind = text_field(F.when(F.col("event_type") != "view", F.col("event_type")), "NA")
    fields = [number_field(F.col("event_id")), number_field(F.col("user_id")), kind, number_field(F.col("article_id"))]
    folder = scratch_path(m.spark, "tsv")
    write_submission(m.events.select(F.concat_ws("\t", *fields).alias("line"), "event_id"), [F.asc_nulls_last("event_id")], folder)
    back = read_tsv(m.spark, folder, "event_id long, user_id long, event_type string, article_id long", ["NA"], places=True, escaped=True)
    return validation.numbered(back, PLACE).select("idx", "event_id", "user_id", "event_type", "article_id")


@query
def field_guard(m: Model) -> DataFrame:
    """Lines of three fields or four; those of four alone are read."""
    rows = m.events.select(F.concat_ws("\t", "event_id", "user_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("article_id"))).alias("line"), "event_id")
    folder = scratch_path(m.spark, "lines")
    write_submission(rows, ["event_id"], folder)
    parts = read_lines(m.spark, folder, 4)
    return parts.select(F.col("parts")[0].cast("long").alias("event_id"), F.col("parts")[3].cast("long").alias("article_id"))


@query
def vector_text_round_trip(m: Model) -> DataFrame:
    """Vectors as lines of an id and numbers; a text that is no number is null."""
    numbers = F.array_join(F.transform("vector", lambda x, i: F.when((F.col("article_id") % 5 == 0) & (i == 1), "x").otherwise(x.cast("double").cast("string"))), "\t")
    folder = scratch_path(m.spark, "vectors")
    write_submission(m.vectors.select(F.concat_ws("\t", "article_id", numbers).alias("line"), "article_id"), ["article_id"], folder)
    back = read_vectors(m.spark, folder, 64)
    return back.select(F.col("id").cast("long").alias("vec_id"), F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def store_round_trip(m: Model) -> DataFrame:
    """Impressions stored by split; one split read alone."""
    folder = scratch_path(m.spark, "store")
    write_store(m.impressions.where("split is not null"), folder)
    return m.spark.read.parquet(folder).where("split = 'validation'").select(*IMP, "t0", "split")


@query
def json_round_trip(m: Model) -> DataFrame:
    folder = scratch_path(m.spark, "json")
    profiling.value_counts(m.articles, "subcategory").write.json(folder)
    return m.spark.read.schema("key string, n long").json(folder)


@query
def profile_files(m: Model) -> DataFrame:
    """Files, bytes and lines of what was written as text."""
    folder = scratch_path(m.spark, "profiled")
    write_submission(m.events.select(F.concat_ws(" ", "event_id", "event_type").alias("line"), "event_id"), ["event_id"], folder)
    return file_profile(m.spark, folder).where("path like '%.txt'").agg(F.sum("bytes").alias("n_bytes"), F.sum("lines").alias("n_lines"))


@query
def parquet_places(m: Model) -> DataFrame:
    """Rows of a parquet table numbered in the order of its files."""
    rows = with_place(m.table("orders").select("*", "_metadata"))
    return validation.numbered(rows.select("o_orderkey", *PLACE), PLACE).select("idx", F.col("o_orderkey").alias("orderkey"))


@query
def limit_in_order(m: Model) -> DataFrame:
    """The first hundred impressions in time, as a limit on evaluated impressions takes them."""
    return m.impressions.orderBy("t0", *IMP).limit(100).select(*IMP, "t0")


@query
def parse_times(m: Model) -> DataFrame:
    """Times written as text in the logs' format and parsed; a text that is no time is null."""
    text = F.when(F.col("event_id") % 4 == 0, "no time").otherwise(F.date_format("ts", "M/d/yyyy h:mm:ss a"))
    return m.events.select("event_id", F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a")).cast("timestamp_ntz").alias("parsed"))


@query
def semantic_with_bad_vectors(m: Model) -> DataFrame:
    """Vectors with a part that is no number, or infinite: their candidates score 0."""
    bad = F.transform("vector", lambda x, i: F.when((i == 0) & (F.col("article_id") % 7 == 0), F.lit(float("nan"))).when((i == 0) & (F.col("article_id") % 7 == 1), F.lit(float("inf"))).otherwise(x.cast("double")))
    users = m.past.where("article_id % 7 > 1")
    return ranked(rankers.semantic(m.validation, users, m.vectors.withColumn("vector", bad), IMP))


# ---- lexical


@query
def tokenize_documents(m: Model) -> DataFrame:
    return m.texts.select(F.col("article_id").alias("doc_id"), F.explode(tokenize(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def bm25_postings(m: Model) -> DataFrame:
    return bm25.postings(m.texts).withColumnRenamed("article_id", "doc_id")


@query
def bm25_term_stats(m: Model) -> DataFrame:
    return bm25.term_stats(m.texts).withColumn("idf", F.round("idf", 6))


@query
def bm25_corpus_stats(m: Model) -> DataFrame:
    return bm25.corpus_stats(m.texts).withColumn("mean_length", F.round("mean_length", 6))


def _terms(m: Model) -> DataFrame:
    return bm25.query_terms(m.past, m.articles, IMP)


@query
def bm25_query_terms(m: Model) -> DataFrame:
    return _terms(m)


@query
def rank_bm25_candidates(m: Model) -> DataFrame:
    return ranked(bm25.candidate_scores(m.validation, _terms(m), bm25.weighted_postings(m.texts), IMP))


def _bm25_top(m: Model, among: DataFrame | None = None) -> DataFrame:
    terms = materialize(_terms(m), "asked-terms")
    return bm25.retrieve(terms, bm25.weighted_postings(m.texts, terms), m.past, IMP, among=among)


@query
def retrieve_bm25_topk(m: Model) -> DataFrame:
    return _bm25_top(m)


def _recalled(m: Model, retrieved: DataFrame, asked: DataFrame, method: str) -> DataFrame:
    clicked = m.validation.where("y = 1").join(asked, IMP, "left_semi")
    each = metrics.recall(retrieved, clicked, IMP).withColumn("method", F.lit(method))
    out = metrics.slices(each, m.n_history, IMP, ["recall_50", "recall_100", "recall_200"], ["method"])
    return out.groupBy("method", "slice").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == f"recall_{k}", F.col("value"))).alias(f"recall_{k}") for k in (50, 100, 200)]
    )


@query
def recall_bm25(m: Model) -> DataFrame:
    asked = bm25.recent_titles(m.past, m.articles, IMP).where("query <> ''")
    return _recalled(m, _bm25_top(m, m.validation.where("y = 1")), asked, "bm25")


# ---- vectors


@query
def article_vectors(m: Model) -> DataFrame:
    """Each document pools three of all vectors."""
    ids = m.table("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    size = m.vectors.agg((F.max("article_id") + 1).alias("size"))
    members = ids.crossJoin(F.broadcast(size)).select("doc_id", ((F.col("doc_id") * 7 + F.col("j")) % F.col("size")).alias("article_id"))
    return vectors.pooled(members, m.vectors, ["doc_id"]).withColumn("value", F.round("value", 6))


@query
def user_vectors(m: Model) -> DataFrame:
    out = rankers.user_vectors(m.past, m.vectors, IMP).select(*IMP, F.posexplode("user_vector").alias("dim", "value"))
    return out.withColumn("value", F.round("value", 6))


def _semantic_top(m: Model) -> DataFrame:
    units = m.vectors.select("article_id", unit(doubles(F.col("vector"))).alias("vector"))
    return vectors.dense_top_k(rankers.user_vectors(m.past, m.vectors, IMP), units, m.past, IMP)


@query
def retrieve_semantic_topk(m: Model) -> DataFrame:
    return _semantic_top(m)


@query
def recall_semantic(m: Model) -> DataFrame:
    asked = m.past.join(m.vectors.select("article_id"), "article_id", "left_semi").select(*IMP)
    return _recalled(m, _semantic_top(m), asked, "semantic")


# ---- metrics


def _by_affinity(m: Model) -> DataFrame:
    return m.labelled(rankers.affinity_ranker(m.validation, m.past, m.articles, m.clicks, IMP, normalize=True))


@query
def metric_auc_scores(m: Model) -> DataFrame:
    return metrics.auc_on_scores(m.labelled(rankers.log_popular(m.validation, m.clicks, IMP)), IMP)


@query
def metric_auc_ranks(m: Model) -> DataFrame:
    return metrics.auc_on_ranks(m.labelled(rankers.log_popular(m.validation, m.clicks, IMP)), IMP)


@query
def metric_mrr(m: Model) -> DataFrame:
    return metrics.mrr(_by_affinity(m), IMP)


@query
def metric_ndcg(m: Model) -> DataFrame:
    return metrics.ndcg(_by_affinity(m), IMP)


@query
def metric_diversity(m: Model) -> DataFrame:
    return metrics.diversity(_by_affinity(m), m.vectors, IMP)


@query
def metric_novelty(m: Model) -> DataFrame:
    return metrics.novelty(_by_affinity(m), m.clicks, IMP)


def _catalog(m: Model) -> DataFrame:
    return m.table("documents").agg(F.count(F.lit(1)).alias("catalog"))


@query
def metric_coverage(m: Model) -> DataFrame:
    return metrics.coverage(_by_affinity(m), _catalog(m))


@query
def metric_slices(m: Model) -> DataFrame:
    m = m.stored
    methods = {
        "popularity": rankers.popularity(m.validation, m.clicks, IMP),
        "affinity": rankers.affinity_ranker(m.validation, m.past, m.articles, m.clicks, IMP, normalize=True),
        "hybrid": rankers.hybrid(m.validation, m.past, m.articles, m.vectors, m.clicks, IMP),
    }
    by = None
    for name, scored in methods.items():
        part = scored.withColumn("method", F.lit(name)).withColumn("score", scored["score"].cast("double"))
        by = part if by is None else by.unionByName(part)
    keys = ["method", *IMP]
    labelled = rankers.rank(by, keys).join(m.validation.select(*IMP, "pos", "y"), [*IMP, "pos"])
    each = metrics.per_impression(labelled, keys).where("n_clicked > 0")
    return metrics.slices(each, m.n_history, IMP, ["auc", "mrr", "ndcg_5", "ndcg_10"], ["method"])


@query
def bootstrap_ci(m: Model) -> DataFrame:
    """Intervals of all metrics of one method, over all, cold and warm impressions."""
    by = materialize(_by_affinity(m), "ranked")
    each = metrics.per_impression(by, IMP).join(metrics.novelty(by, m.clicks, IMP), IMP).join(metrics.diversity(by, m.vectors, IMP), IMP)
    sliced = metrics.by_slice(each, m.n_history, IMP)
    return bootstrap.bootstrap_ci(sliced, IMP, ["auc", "mrr", "ndcg_5", "ndcg_10", "novelty", "diversity"], ["slice"])


@query
def bootstrap_coverage(m: Model) -> DataFrame:
    return bootstrap.bootstrap_coverage(_by_affinity(m), IMP, _catalog(m))


# ---- profiling


@query
def profile_nulls(m: Model) -> DataFrame:
    return profiling.nulls(m.articles.select("title", "abstract", "category", "published"))


@query
def profile_table_shape(m: Model) -> DataFrame:
    return profiling.shape({t: m.table(t) for t in ("documents", "events", "embeddings")})


@query
def profile_value_counts(m: Model) -> DataFrame:
    return profiling.value_counts(m.articles, "subcategory", 10)


@query
def profile_history_len(m: Model) -> DataFrame:
    lens = m.impressions.select(*IMP).join(m.n_history, IMP, "left").select(F.coalesce("n_history", F.lit(0)).alias("x"))
    return profiling.spread(lens, "x")


@query
def profile_candidates_len(m: Model) -> DataFrame:
    return profiling.spread(m.candidates.groupBy(*IMP).agg(F.count(F.lit(1)).alias("x")), "x")


@query
def profile_click_rate(m: Model) -> DataFrame:
    return profiling.spread(m.candidates.groupBy(*IMP).agg(F.round(F.avg("y"), 6).alias("x")), "x")


@query
def profile_clicks_per_impression(m: Model) -> DataFrame:
    return profiling.value_counts(m.candidates.groupBy(*IMP).agg(F.sum("y").alias("x")), "x")


@query
def profile_impressions_per_user(m: Model) -> DataFrame:
    return m.impressions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def profile_histogram(m: Model) -> DataFrame:
    return profiling.histogram(m.table("documents"), "n_chars")


@query
def profile_bool_share(m: Model) -> DataFrame:
    return profiling.share_true(m.events.withColumn("b", F.col("event_type") == "click"), "b")


@query
def profile_time_range(m: Model) -> DataFrame:
    text = F.date_format("ts", "M/d/yyyy h:mm:ss a")
    return m.events.agg(F.min(text).alias("first_text"), F.max(text).alias("last_text"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- the second log: orders as impressions


@query
def orders_popularity_rank(m: Model) -> DataFrame:
    """Parts of an order ranked by how often they were returned in all orders."""
    lines = m.table("lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("article_id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    clicks = rankers.click_counts(lines)
    scored = lines.join(clicks, "article_id", "left").select("o", F.col("article_id").alias("pos"), "article_id", F.coalesce("clicks", F.lit(0)).cast("double").alias("score"))
    return rankers.rank(scored, ["o"]).select(F.col("o").alias("orderkey"), F.col("article_id").alias("partkey"), F.col("score").cast("long").alias("clicks"), "rank")
