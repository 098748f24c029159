"""Command line: build the store, retrieve, evaluate, and write rank lists.

``python -m quillrank.cli <command> --help`` lists each command's options.
"""

from __future__ import annotations

import argparse
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scores import doubles, unit
from .functions.text import entity_ids, labelled_items, split_items
from .operators import bm25, bootstrap, metrics, rankers, store, validation, vectors
from .session import build_session
from .sources import archives, readers, writers
from .sources.scratch import materialize

KEYS = ["dataset", "source_split", "impression_id"]


def _folder(path: Path, work: Path) -> Path:
    """``path`` itself, or what its archive unpacks to."""
    if path.is_dir():
        return path
    return archives.extract_all(path.with_suffix(".zip"), work / path.stem)


def build(spark: SparkSession, root: str, output: str, validation_days: int = 1, test_days: int = 1) -> dict:
    """Read ``tsv/{train,dev}`` and ``parquet/{articles.parquet,train,validation}`` below ``root`` into one store.

    Articles are deduplicated per dataset and id, the first of the files' order kept; impressions get a chronological split per dataset. The manifest counts articles
    and impressions per dataset.
    """
    base, out, articles, impressions = Path(root), Path(output), [], []
    for n, split in enumerate(("train", "dev")):
        if (base / "tsv" / split).exists() or (base / "tsv" / f"{split}.zip").exists():
            at = _folder(base / "tsv" / split, out / "raw")
            articles.append(store.tsv_articles(spark, str(at / "news.tsv"), split).withColumn("_o", F.lit(n)))
            impressions.append(store.tsv_impressions(spark, str(at / "behaviors.tsv"), split))
    if (base / "parquet").exists():
        placed = readers.with_place(spark.read.parquet(str(base / "parquet/articles.parquet")))
        articles.append(store.parquet_articles(placed, "all").withColumn("_o", F.lit(0)))
        for split in ("train", "validation"):
            at = base / "parquet" / split
            history = readers.with_place(spark.read.parquet(str(at / "history.parquet")))
            impressions.append(store.parquet_impressions(spark.read.parquet(str(at / "behaviors.parquet")), history, split))
    plain = [a.withColumn("entities", F.col("entities").cast("string")) for a in articles]
    order = ["_o", *readers.PLACE]
    store.dedup(reduce(DataFrame.unionByName, plain), ["dataset", "article_id"], order).drop(*order).write.mode("overwrite").parquet(str(out / "articles"))
    every = reduce(DataFrame.unionByName, impressions)
    parts = [store.temporal_split(every.where(F.col("dataset") == d), "timestamp", validation_days, test_days) for d in ("mind", "ebnerd")]
    split = reduce(DataFrame.unionByName, parts).where("split is not null")
    writers.write_store(split, str(out / "impressions"))
    counts: dict[str, dict[str, int]] = {}
    for r in spark.read.parquet(str(out / "articles")).groupBy("dataset").count().collect():
        counts.setdefault(r["dataset"], {})["articles"] = r["count"]
    for r in store.manifest(spark.read.parquet(str(out / "impressions")), ("dataset",)).collect():
        counts.setdefault(r["dataset"], {})[r["split"]] = r["impressions"]
    writers.write_json(counts, out / "manifest.json")
    return counts


def _load(spark: SparkSession, path: str, split: str, limit: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Articles (their text is title and abstract), impressions, candidates and history of one split of the store."""
    articles = spark.read.parquet(f"{path}/articles").withColumn("text", F.concat_ws(" ", "title", "abstract"))
    imp = spark.read.parquet(f"{path}/impressions").where(F.col("split") == split)
    if limit:
        imp = imp.orderBy("timestamp", *KEYS).limit(limit)
    return articles, imp, *store.flatten(imp, KEYS)


def _summary(values: DataFrame, imp: DataFrame, names: list[str], output: str | None) -> list[dict]:
    sizes = imp.select(*KEYS, F.size("history_ids").alias("n_history"))
    rows = metrics.slices(values, sizes, KEYS, names, ["dataset", "method"]).orderBy("dataset", "method", "slice", "metric").collect()
    out = [r.asDict() for r in rows]
    if output:
        writers.write_json({"metrics": out}, output)
    return out


def _clicked(imp: DataFrame) -> DataFrame:
    return imp.select(*KEYS, F.explode(F.array_distinct("clicked_ids")).alias("article_id"))


def _datasets(articles: DataFrame) -> list[str]:
    return sorted(r[0] for r in articles.select("dataset").distinct().collect())  # one row per source that the store was built of


def _weighted(articles: DataFrame) -> DataFrame:
    return materialize(bm25.weighted_postings(articles.select("article_id", "text")), "weighted")


def lexical(spark, path: str, split: str = "validation", recent: int = 5, limit: int = 0, output: str | None = None) -> list[dict]:
    """Recall of lexical retrieval in each dataset's own corpus; impressions without a click or a query are left out."""
    articles, imp, _, history = _load(spark, path, split, limit)
    each = []
    for d in _datasets(articles):
        corpus, past = articles.where(F.col("dataset") == d), history.where(F.col("dataset") == d)
        asked = bm25.recent_titles(past, corpus, KEYS, recent).where("query <> ''")
        top = bm25.retrieve(bm25.query_terms(past, corpus, KEYS, recent), _weighted(corpus), past, KEYS)
        each.append(metrics.recall(top, _clicked(imp).join(asked, KEYS, "left_semi"), KEYS).withColumn("method", F.lit("bm25")))
    return _summary(reduce(DataFrame.unionByName, each), imp, ["recall_50", "recall_100", "recall_200"], output)


def article_vectors(spark, articles: DataFrame, vector_file: str) -> DataFrame:
    """``article_id, vector``: supplied vectors (parquet), or the mean of an article's entity vectors (text)."""
    if vector_file.endswith(".parquet"):
        df = spark.read.parquet(vector_file)
        name = readers.vector_column(df, "article_id")
        return df.select(F.col("article_id").cast("string").alias("article_id"), unit(doubles(F.col(name))).alias("vector"))
    known = readers.read_vectors(spark, vector_file).select(F.col("id").alias("article_id"), "vector")
    ids = F.concat(entity_ids(F.substring_index("entities", "] [", 1)), entity_ids(F.concat(F.lit("["), F.substring_index("entities", "] [", -1))))
    members = articles.select(F.col("article_id").alias("owner"), F.explode(ids).alias("article_id"))
    dims = vectors.pooled(members, known, ["owner"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"])
    return dims.groupBy(F.col("owner").alias("article_id")).agg(ordered.alias("vector"))


def dense(spark, path: str, vector_file: str, split: str = "validation", limit: int = 0, output: str | None = None) -> list[dict]:
    """Recall of vector retrieval; impressions without a click or a known history vector are left out."""
    articles, imp, _, history = _load(spark, path, split, limit)
    vecs = article_vectors(spark, articles, vector_file)
    users = materialize(rankers.user_vectors(history, vecs, KEYS), "users")
    top = vectors.dense_top_k(users, vecs, history, KEYS)
    each = metrics.recall(top, _clicked(imp).join(users, KEYS, "left_semi"), KEYS).withColumn("method", F.lit("semantic"))
    return _summary(each, imp, ["recall_50", "recall_100", "recall_200"], output)


EVALUATED = ["auc", "mrr", "ndcg_5", "ndcg_10", "diversity", "novelty"]


def evaluate(spark, path: str, vector_file: str | None = None, limit: int = 0, output: str | None = None) -> list[dict]:
    """Intervals of AUC, MRR, nDCG, diversity, novelty and coverage of the lexical and vector scores, for each dataset, over all, cold and warm impressions."""
    articles, imp, candidates, history = _load(spark, path, "validation", limit)
    train = store.flatten(spark.read.parquet(f"{path}/impressions").where("split = 'train'"), KEYS)[0]
    vecs = materialize(article_vectors(spark, articles, vector_file), "vectors") if vector_file else None
    sizes = imp.select(*KEYS, F.size("history_ids").alias("n_history"))
    clicked = imp.select(*KEYS, F.size(F.array_distinct("clicked_ids")).alias("n_clicked")).where("n_clicked > 0")
    out: list[dict] = []
    for d in _datasets(articles):
        corpus, past, shown = (x.where(F.col("dataset") == d) for x in (articles, history, candidates))
        clicks = materialize(rankers.click_counts(train.where(F.col("dataset") == d)), "clicks")
        catalog = corpus.agg(F.count(F.lit(1)).alias("catalog"))
        methods = {"bm25": bm25.candidate_scores(shown, bm25.query_terms(past, corpus, KEYS), _weighted(corpus), KEYS)}
        if vecs is not None:
            methods["semantic"] = rankers.semantic(shown, past, vecs, KEYS)
        for name, scored in methods.items():
            ranked = rankers.rank(scored, KEYS).join(shown.select(*KEYS, "pos", "y"), [*KEYS, "pos"]).join(clicked, KEYS, "left_semi")
            ranked = materialize(ranked, "ranked")
            each = metrics.auc_on_scores(ranked, KEYS).join(metrics.mrr(ranked, KEYS), KEYS).join(metrics.ndcg(ranked, KEYS, clicked=clicked), KEYS)
            each = each.join(metrics.novelty(ranked, clicks, KEYS), KEYS)
            each = each.join(metrics.diversity(ranked, vecs, KEYS), KEYS) if vecs is not None else each.withColumn("diversity", F.lit(None).cast("double"))
            rows = bootstrap.bootstrap_ci(metrics.by_slice(each, sizes, KEYS), KEYS, EVALUATED, ["slice"]).orderBy("slice", "metric").collect()
            rows += bootstrap.bootstrap_coverage(ranked, KEYS, catalog).withColumn("slice", F.lit(metrics.ALL)).collect()
            out += [{"dataset": d, "method": name, **r.asDict()} for r in rows]
    if output:
        writers.write_json({"metrics": out}, output)
    return out


# ---- the logs as they are delivered: rank lists to submit, and rankers compared on labelled ones


def _tsv_log(spark, path: str, limit: int = 0) -> DataFrame:
    """``id, now, past, shown, clicked`` and places of a headerless behaviors file."""
    shown, clicked = labelled_items(F.col("impressions"))
    df = readers.read_tsv(spark, path, readers.BEHAVIORS, places=True)
    df = df.select(F.col("impression_id").alias("id"), F.try_to_timestamp("time", F.lit(readers.TIME_FORMAT)).cast("timestamp_ntz").alias("now"), split_items(F.col("history")).alias("past"), shown.alias("shown"), clicked.alias("clicked"), *readers.PLACE)
    return df.orderBy(*readers.PLACE).limit(limit) if limit else df


def _parquet_log(spark, path: str, history: str | None, limit: int = 0) -> DataFrame:
    """The same of a parquet behaviors table and the users' histories."""
    ids = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string"))
    df = readers.with_place(spark.read.parquet(path))
    df = df.orderBy(*readers.PLACE).limit(limit) if limit else df
    past = F.array().cast("array<string>")
    if history:
        known = readers.with_place(spark.read.parquet(history))
        listed = readers.first_existing(known, ["article_id_fixed", "article_id"])
        known = store.dedup(known.select(F.col("user_id").alias("_user"), listed.alias("_past"), *[F.col(c).alias(f"_{c}") for c in readers.PLACE]), ["_user"], [f"_{c}" for c in readers.PLACE], keep="last")
        df, past = df.join(known, F.col("user_id") == F.col("_user"), "left"), ids(F.col("_past"))
    clicked = readers.first_existing(df, ["article_ids_clicked"])
    clicked = ids(clicked) if "article_ids_clicked" in df.columns else F.array().cast("array<string>")
    return df.select(F.col("impression_id").cast("string").alias("id"), F.col("impression_time").cast("timestamp_ntz").alias("now"), past.alias("past"), ids(F.col("article_ids_inview")).alias("shown"), clicked.alias("clicked"), *readers.PLACE)


def _log(spark, kind: str, path: str, history: str | None = None, limit: int = 0) -> DataFrame:
    return _tsv_log(spark, path, limit) if kind == "tsv" else _parquet_log(spark, path, history, limit)


def _metadata(spark, kind: str, files: list[str]) -> DataFrame:
    """``article_id, category, subcategory, topics, published, entities``; of an article in several places the last counts."""
    if kind == "tsv":
        each = [readers.read_tsv(spark, f, readers.NEWS, places=True).withColumn("_o", F.lit(k)) for k, f in enumerate(files)]
        last = store.dedup(reduce(DataFrame.unionByName, each), ["article_id"], ["_o", *readers.PLACE], keep="last")
        return last.select(
            "article_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory"), F.array().cast("array<string>").alias("topics"),
            F.lit(None).cast("timestamp_ntz").alias("published"), F.concat_ws(" ", "title_entities", "abstract_entities").alias("entities"),
        )
    df = readers.with_place(spark.read.parquet(*files))
    published = readers.first_existing(df, ["published_time"]).cast("timestamp_ntz")
    topics = F.coalesce("topics", F.array()) if "topics" in df.columns else F.array().cast("array<string>")
    named = df.select(F.col("article_id").cast("string").alias("article_id"), F.coalesce("category_str", F.lit("")).alias("category"), F.lit("").alias("subcategory"), topics.alias("topics"), published.alias("published"), F.lit("").alias("entities"), *readers.PLACE)
    return store.dedup(named, ["article_id"], readers.PLACE, keep="last").drop(*readers.PLACE)


METHODS = ["popularity", "log_popularity", "affinity", "category_popularity", "history_category", "hybrid", "topic_fresh", "topic_fresh_assumed"]


def _scored(spark, method: str, log: DataFrame, clicks: DataFrame, articles: DataFrame | None, vecs: DataFrame | None, keys: list[str]) -> DataFrame:
    candidates = log.select(*keys, F.posexplode("shown").alias("pos", "article_id"))
    history = log.select(*keys, F.posexplode(F.reverse("past")).alias("age", "article_id"))
    if method == "popularity":
        return rankers.popularity(candidates, clicks, keys)
    if method == "log_popularity":
        return rankers.log_popular(candidates, clicks, keys)
    if method == "affinity":
        return rankers.affinity_ranker(candidates, history, articles, clicks, keys)
    if method == "category_popularity":
        return rankers.affinity_ranker(candidates, history, articles, clicks, keys, normalize=True)
    if method == "history_category":
        return rankers.affinity_ranker(candidates, history, articles, clicks, keys, weights={"category": 1.0}, normalize=True)
    if method == "hybrid":
        return rankers.hybrid(candidates, history, articles, vecs, clicks, keys)
    missing = 1.0 if method == "topic_fresh_assumed" else 0.0
    return rankers.topic_fresh(candidates, history, articles, clicks, log.select(*keys, "now"), keys, missing_freshness=missing)


def _clicks_of(log: DataFrame) -> DataFrame:
    """Clicks of a log. An item without an id, as a bare label leaves it, is no click."""
    return log.select(F.explode("clicked").alias("article_id")).where("article_id <> ''").groupBy("article_id").agg(F.count(F.lit(1)).alias("clicks"))


def submit(
    spark, kind: str, train: str, test: str, output: str, method: str = "popularity", articles: list[str] | None = None, vector_file: str | None = None,
    history: str | None = None, limit: int = 0, name: str | None = None,
) -> bool:
    """Rank lists for a log in the order of its rows: written once as text, checked as written against the log, and packed.

    Returns whether all lines are valid; an archive is made only then.
    """
    log = materialize(_log(spark, kind, test, history, limit), "log")
    keys = ["id", *readers.PLACE]  # ids may repeat, places don't
    known = materialize(_metadata(spark, kind, articles), "articles") if articles else None
    vecs = article_vectors(spark, known, vector_file) if vector_file else None
    clicks = materialize(_clicks_of(_log(spark, kind, train)), "clicks")
    ranked = rankers.rank(_scored(spark, method, log, clicks, known, vecs, keys), keys)
    lines = log.select(*keys).join(writers.rank_lines(ranked, "id", keys), keys, "left").withColumn("line", F.coalesce("line", F.concat("id", F.lit(" []"))))
    writers.write_submission(lines, readers.PLACE, f"{output}/lines")
    source = log.select("id", F.size("shown").alias("n_candidates"), *readers.PLACE)
    good = validation.validate_order(writers.written_lines(spark, f"{output}/lines"), readers.PLACE, source, readers.PLACE).where("not is_valid").isEmpty()
    if good:
        name = name or ("prediction" if kind == "tsv" else "predictions")
        writers.pack_submission(spark, f"{output}/lines", f"{output}/{name}.zip", f"{name}.txt")
    return good


def compare(
    spark, kind: str, train: str, labelled: str, methods: list[str], articles: list[str] | None = None, vector_file: str | None = None, history: str | None = None,
    limit: int = 0, output: str | None = None,
) -> list[dict]:
    """AUC of the ranks, MRR and nDCG of each method, as means over all impressions of a labelled log; one without a click counts 0."""
    log = materialize(_log(spark, kind, labelled, history, limit), "log")
    keys = ["id", *readers.PLACE]
    known = materialize(_metadata(spark, kind, articles), "articles") if articles else None
    vecs = article_vectors(spark, known, vector_file) if vector_file else None
    clicks = materialize(_clicks_of(_log(spark, kind, train)), "clicks")
    labels = log.select(*keys, F.posexplode(F.transform("shown", lambda a: F.array_contains("clicked", a).cast("int"))).alias("pos", "y"))
    out = []
    for method in methods:
        ranked = rankers.rank(_scored(spark, method, log, clicks, known, vecs, keys), keys).join(labels, [*keys, "pos"])
        by_rank = ranked.withColumn("score", -F.col("rank"))
        each = metrics.per_impression(by_rank, keys)
        means = [F.round(F.avg(F.coalesce(m, F.lit(0.0))), 6).alias(m) for m in ("auc", "mrr", "ndcg_5", "ndcg_10")]
        out.append({"method": method, **log.select(*keys).join(each, keys, "left").agg(F.count(F.lit(1)).alias("impressions"), *means).first().asDict()})
    if output:
        writers.write_json({"metrics": out}, output)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    p = argparse.ArgumentParser(prog="quillrank")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("data", help="build the store")
    for flag, default in (("--source-root", "."), ("--output", "data/processed")):
        a.add_argument(flag, default=default)
    for flag in ("--validation-days", "--test-days"):
        a.add_argument(flag, type=int, default=1)
    for name in ("bm25", "semantic", "evaluate"):
        a = sub.add_parser(name)
        a.add_argument("--store", default="data/processed")
        a.add_argument("--limit", type=int, default=0)
        a.add_argument("--output")
        if name != "evaluate":
            a.add_argument("--split", choices=["validation", "test"], default="validation")
        if name == "bm25":
            a.add_argument("--recent-history", type=int, default=5)
        else:
            a.add_argument("--vectors", required=name == "semantic")
    for name in ("submit", "compare"):
        a = sub.add_parser(name)
        a.add_argument("--format", choices=["tsv", "parquet"], default="tsv")
        a.add_argument("--train", required=True)
        a.add_argument("--articles", nargs="*")
        a.add_argument("--history")
        a.add_argument("--vectors")
        a.add_argument("--limit", type=int, default=0)
        if name == "submit":
            a.add_argument("--test", required=True)
            a.add_argument("--output-dir", required=True)
            a.add_argument("--method", choices=METHODS, default="popularity")
        else:
            a.add_argument("--labelled", required=True)
            a.add_argument("--methods", nargs="+", choices=METHODS, default=["log_popularity"])
            a.add_argument("--output")
    o = p.parse_args(argv)
    spark = spark or build_session()
    if o.command == "data":
        return build(spark, o.source_root, o.output, o.validation_days, o.test_days)
    if o.command == "bm25":
        return lexical(spark, o.store, o.split, o.recent_history, o.limit, o.output)
    if o.command == "semantic":
        return dense(spark, o.store, o.vectors, o.split, o.limit, o.output)
    if o.command == "evaluate":
        return evaluate(spark, o.store, o.vectors, o.limit, o.output)
    if o.command == "compare":
        return compare(spark, o.format, o.train, o.labelled, o.methods, o.articles, o.vectors, o.history, o.limit, o.output)
    Path(o.output_dir).mkdir(parents=True, exist_ok=True)
    return submit(spark, o.format, o.train, o.test, o.output_dir, o.method, o.articles, o.vectors, o.history, o.limit)


if __name__ == "__main__":
    print(main())
