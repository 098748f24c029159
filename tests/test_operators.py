import pytest
from pyspark.sql import functions as F

from quillrank.operators import bm25, bootstrap, metrics, profiling, rankers, validation, vectors
from quillrank.operators.store import dedup, flatten, temporal_split
from quillrank.sources.readers import PLACE, read_tsv
from quillrank.sources.writers import write_submission

SCORES = [(1, p, s, y) for p, (s, y) in enumerate(zip([3.0, 1.0, 3.0, 0.0], [0, 1, 1, 0], strict=True))]


def scored(spark):
    return spark.createDataFrame(SCORES, "imp long, pos int, score double, y int").withColumn("article_id", F.col("pos").cast("long"))


def test_rank_keeps_candidate_order_on_ties(spark):
    got = rankers.rank(scored(spark), ["imp"]).orderBy("pos").select("rank").collect()
    assert [r[0] for r in got] == [1, 3, 2, 4]


def test_two_aucs_mrr_and_ndcg(spark):
    ranked = rankers.rank(scored(spark), ["imp"])
    assert metrics.auc_on_scores(ranked, ["imp"]).first()["auc"] == 0.625
    assert metrics.auc_on_ranks(ranked, ["imp"]).first()["auc"] == 0.5
    assert metrics.mrr(ranked, ["imp"]).first()["mrr"] == 0.5
    r = metrics.ndcg(ranked, ["imp"], cuts=(1, 2, 5)).first()
    assert (r["ndcg_1"], r["ndcg_2"], r["ndcg_5"]) == (0.0, 0.386853, 0.693426)


def test_metrics_without_a_click(spark):
    ranked = rankers.rank(scored(spark).withColumn("y", F.lit(0)), ["imp"])
    assert metrics.auc_on_scores(ranked, ["imp"]).first()["auc"] is None
    assert metrics.auc_on_ranks(ranked, ["imp"]).first()["auc"] == 0.0
    assert metrics.mrr(ranked, ["imp"]).first()["mrr"] == 0.0
    assert metrics.ndcg(ranked, ["imp"]).first()["ndcg_5"] == 0.0


def test_ideal_may_count_clicks_that_were_not_shown(spark):
    ranked = rankers.rank(scored(spark), ["imp"])
    more = spark.createDataFrame([(1, 5)], "imp long, n_clicked long")
    assert metrics.ndcg(ranked, ["imp"], clicked=more).first()["ndcg_5"] < 0.693426


def test_novelty(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "imp long, article_id long, rank int")
    clicks = spark.createDataFrame([(1, 5), (3, 5)], "article_id long, clicks long")
    assert metrics.novelty(ranked, clicks, ["imp"]).first()["novelty"] == 2.160964


def test_bm25_scores(spark):
    texts = [(1, "The economy grows fast"), (2, "Football final tonight football"), (3, "Economy and football"), (4, "A weather report")]
    docs = spark.createDataFrame(texts, "article_id long, text string")
    assert bm25.corpus_stats(docs).first()["mean_length"] == 2.75
    terms = spark.createDataFrame([(1, "economy"), (1, "football")], "imp long, term string")
    none = spark.createDataFrame([], "imp long, article_id long, age int")
    got = {r["article_id"]: r["score"] for r in bm25.retrieve(terms, bm25.weighted_postings(docs), none, ["imp"]).collect()}
    assert got == {3: 1.580232, 2: 0.863979, 1: 0.665906}
    seen = spark.createDataFrame([(1, 3, 0)], "imp long, article_id long, age int")
    assert {r["article_id"] for r in bm25.retrieve(terms, bm25.weighted_postings(docs), seen, ["imp"]).collect()} == {1, 2}


def test_temporal_split(spark):
    rows = [(d, f"2024-01-0{d} 00:00:00") for d in range(1, 6)] + [(9, None)]
    df = spark.createDataFrame(rows, "d int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["d"]: r["split"] for r in temporal_split(df, "ts").collect()}
    assert got == {1: "train", 2: "train", 3: "validation", 4: "test", 5: "test", 9: None}


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([("a", "train", 0), ("a", "dev", 1), ("b", "dev", 1)], "article_id string, source_split string, o int")
    first = {(r[0], r[1]) for r in dedup(df, ["article_id"], ["o"]).collect()}
    last = {(r[0], r[1]) for r in dedup(df, ["article_id"], ["o"], "last").collect()}
    assert first == {("a", "train"), ("b", "dev")}
    assert last == {("a", "dev"), ("b", "dev")}


def test_flatten(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b"], ["x", "y"])], "imp long, candidate_ids array<string>, clicked_ids array<string>, history_ids array<string>")
    candidates, history = flatten(df, ["imp"])
    assert {(r["pos"], r["article_id"], r["y"]) for r in candidates.collect()} == {(0, "a", 0), (1, "b", 1)}
    assert {(r["age"], r["article_id"]) for r in history.collect()} == {(0, "y"), (1, "x")}


def test_unknown_history_builds_affinity_for_the_empty_category(spark):
    history = spark.createDataFrame([(1, 0, 77)], "imp long, age int, article_id long")
    articles = spark.createDataFrame([(5, "c", "s")], "article_id long, category string, subcategory string")
    candidates = spark.createDataFrame([(1, 0, 5), (1, 1, 99)], "imp long, pos int, article_id long")
    clicks = spark.createDataFrame([], "article_id long, clicks long")
    got = {r["pos"]: r["score"] for r in rankers.affinity_ranker(candidates, history, articles, clicks, ["imp"]).collect()}
    assert got == {0: 0.0, 1: 3.0}


def test_rank_lists_are_validated(spark):
    lines = spark.createDataFrame([(1, "1 [2,1,3]"), (2, "2 [1,1,3]"), (3, "4 [1]"), (5, "rubbish")], "imp long, line string")
    sizes = spark.createDataFrame([(1, 3), (2, 3), (3, 1), (4, 1), (5, 1)], "imp long, n_candidates long")
    got = {r["imp"]: r["is_valid"] for r in validation.validate_lines(lines, sizes, "imp", ["imp"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_masked_history_comes_last_and_dropped_history_does_not(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "imp long, user_vector array<double>")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "article_id long, vector array<double>")
    history = spark.createDataFrame([(1, 1, 0)], "imp long, article_id long, age int")
    for block in (100, 1):
        masked = vectors.dense_top_k(users, vecs, history, ["imp"], k=3, block=block).orderBy("rank").collect()
        assert [(r["article_id"], r["score"]) for r in masked] == [(3, 0.6), (2, 0.0), (1, None)]
    dropped = vectors.dense_top_k(users, vecs, history, ["imp"], k=3, exclude="drop").orderBy("rank").collect()
    assert [r["article_id"] for r in dropped] == [3, 2]


def test_bootstrap(spark):
    values = spark.createDataFrame([(i, float(i), "a") for i in range(7)] + [(99, None, "a"), (98, float("nan"), "a"), (97, None, "b")], "imp long, v double, g string")
    got = {r["g"]: r for r in bootstrap.bootstrap_ci(values, ["imp"], ["v"], ["g"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"]) == (7, 3.0)  # the sample's own mean
    assert 1.0 < got["a"]["ci95_low"] < 3.0 < got["a"]["ci95_high"] < 5.0
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["ci95_low"]) == (0, None, None)
    many = spark.range(2000).select(F.col("id").alias("imp"), (F.col("id") % 10).cast("double").alias("v"))
    r = bootstrap.bootstrap_ci(many, ["imp"], ["v"], []).first()
    half = 1.96 * 8.25**0.5 / 2000**0.5  # of the normal interval
    assert abs(r["ci95_high"] - 4.5 - half) < 0.03 and abs(4.5 - half - r["ci95_low"]) < 0.03
    assert bootstrap.bootstrap_ci(many.limit(0), ["imp"], ["v"], []).count() == 0


def test_coverage_of_resampled_lists(spark):
    ranked = spark.createDataFrame([(i, 1, i % 4) for i in range(4)], "imp long, rank int, article_id int")
    catalog = spark.createDataFrame([(8,)], "catalog long")
    r = bootstrap.bootstrap_coverage(ranked, ["imp"], catalog).first()
    assert (r["metric"], r["n"], r["observed_full_sample"]) == ("coverage_10", 4, 0.5)
    assert abs(r["mean"] - 0.5 * (1 - 2.718281828**-1)) < 0.02 and r["ci95_low"] < r["mean"] < r["ci95_high"] <= 0.5


def test_numbered_and_order(spark):
    df = spark.range(40).select((F.col("id") * 7 % 40).alias("x"))
    assert {(r["x"] + 1, r["idx"]) for r in validation.numbered(df, ["x"]).collect()} == {(i, i) for i in range(1, 41)}
    source = spark.createDataFrame([("b", 2, 0), ("a", 1, 1), ("c", 1, 2)], "id string, n_candidates int, at int")
    lines = spark.createDataFrame([("b [2,1]", 0), ("c [1]", 1), ("a [1]", 2), ("d [1]", 3)], "line string, at int")
    got = validation.validate_order(lines, ["at"], source, ["at"]).orderBy("idx").collect()
    assert [(r["expected"], r["got"], r["is_valid"]) for r in got] == [("b", "b", True), ("a", "c", False), ("c", "a", False), (None, "d", False)]


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def test_numbered_counts_the_partitions_that_it_numbers(spark, many_partitions):
    wide = spark.range(0, 60_000, 1, 2).select("id", F.sha2(F.col("id").cast("string"), 512).alias("ballast"))
    got = validation.numbered(wide, ["id"]).where("length(ballast) = 128 and idx = id + 1")
    assert got.count() == 60_000


def test_lines_of_a_tsv_are_numbered_whole(spark, many_partitions, tmp_path):
    rows = spark.range(0, 60_000, 1, 2).select(F.concat_ws("\t", "id", F.sha2(F.col("id").cast("string"), 512)).alias("line"), "id")
    write_submission(rows, ["id"], str(tmp_path))
    back = validation.numbered(read_tsv(spark, str(tmp_path), "id long, hash string", places=True), PLACE)
    assert back.where("length(hash) = 128 and idx = id + 1").count() == 60_000


def test_order_is_checked_over_many_partitions(spark, many_partitions):
    source = spark.range(0, 60_000, 1, 2).select(F.sha2(F.col("id").cast("string"), 512).alias("id"), F.lit(2).alias("n_candidates"), F.col("id").alias("at"))
    lines = source.select(F.concat("id", F.lit(" [2,1]"), F.when(F.col("at") % 10 == 0, "x").otherwise("")).alias("line"), "at")
    got = validation.validate_order(lines, ["at"], source, ["at"]).groupBy("is_valid").count().collect()
    assert {(r["is_valid"], r["count"]) for r in got} == {(True, 54_000), (False, 6_000)}


def test_a_candidate_without_a_vector_or_with_a_bad_one_scores_zero(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0])], "article_id long, vector array<double>")
    shown = spark.createDataFrame([(1, p, a) for p, a in enumerate([1, 2, 3, 4, 5])], "imp long, pos int, article_id long")
    past = spark.createDataFrame([(1, 0, 1)], "imp long, age int, article_id long")
    got = {r["article_id"]: r["score"] for r in rankers.semantic(shown, past, vecs, ["imp"]).collect()}
    assert got == {1: 1.0, 2: -1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    users = spark.createDataFrame([(1, [1.0, 0.0])], "imp long, user_vector array<double>")
    top = vectors.dense_top_k(users, vecs, past.limit(0), ["imp"], k=4).orderBy("rank").collect()
    assert [(r["article_id"], r["score"]) for r in top] == [(1, 1.0), (5, 1.0), (2, -1.0), (4, None)]


def test_retrieval_in_many_cells(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("article_id"), F.concat(F.lit("word common "), F.expr("repeat('t', cast(id % 7 + 2 as int))")).alias("text"))
    terms = spark.createDataFrame([(i, t) for i in range(12) for t in ("common", "t" * (i % 7 + 2), "nowhere")], "imp long, term string")
    past = spark.createDataFrame([(1, 1, 0), (1, 8, 1)], "imp long, article_id long, age int")
    whole = sorted(map(tuple, bm25.retrieve(terms, bm25.weighted_postings(docs), past, ["imp"], k=5).collect()))
    monkeypatch.setattr(bm25, "SHARD", 7)
    monkeypatch.setattr(bm25, "SHARD_MOST", 7)
    monkeypatch.setattr(bm25, "ASKED", 4)
    assert sorted(map(tuple, bm25.retrieve(terms, bm25.weighted_postings(docs), past, ["imp"], k=5).collect())) == whole
    assert len(whole) == 60 and not {1, 8} & {r[1] for r in whole if r[0] == 1}


def test_retrieval_asks_a_question_once_and_again_where_a_shard_held_back(spark, monkeypatch):
    docs = spark.range(90).select(F.col("id").alias("article_id"), F.concat(F.lit("word common "), F.expr("repeat('t', cast(id % 7 + 2 as int))")).alias("text"))
    terms = spark.createDataFrame([(i, t) for i in range(40) for t in ("common", "t" * (i % 4 + 2))], "imp long, term string")
    past = spark.createDataFrame([(5, 1, 0), (6, 8, 0)], "imp long, article_id long, age int")
    whole, asked = bm25.weighted_postings(docs), []
    some = bm25.weighted_postings(docs, terms)
    wanted = {r["term"] for r in terms.select("term").distinct().collect()}
    key = lambda df: sorted((r["term"], r["article_id"], round(r["weight"], 9)) for r in df.collect())
    assert key(some) == key(whole.where(F.col("term").isin(*wanted))) and len(key(some)) < len(key(whole))
    once = sorted(map(tuple, bm25.retrieve(terms, whole, past, ["imp"], k=12).collect()))
    best = bm25._best
    monkeypatch.setattr(bm25, "_best", lambda questions, *a: asked.append((questions.count(), a[3])) or best(questions, *a))
    monkeypatch.setattr(bm25, "SHARD", 20)
    monkeypatch.setattr(bm25, "SHARD_MOST", 20)
    monkeypatch.setattr(bm25, "_first", lambda k, shards: 3)
    assert sorted(map(tuple, bm25.retrieve(terms, some, past, ["imp"], k=12).collect())) == once
    assert len(once) == 40 * 12 and asked[0] == (6, 3) and len(asked) == 2 and asked[1][1] == 12


def test_retrieval_returns_the_ranks_of_some_articles_alone(spark):
    docs = spark.range(60).select(F.col("id").alias("article_id"), F.concat(F.lit("word common "), F.expr("repeat('t', cast(id % 7 + 2 as int))")).alias("text"))
    terms = spark.createDataFrame([(i, t) for i in range(12) for t in ("common", "t" * (i % 7 + 2))], "imp long, term string")
    past = spark.createDataFrame([(1, 1, 0)], "imp long, article_id long, age int")
    among = spark.createDataFrame([(i, a) for i in range(11) for a in (i, i + 7, 59, 1000, i)] + [(1, None), (99, 1)], "imp long, article_id long")
    weighted = bm25.weighted_postings(docs)
    want = bm25.retrieve(terms, weighted, past, ["imp"], k=20).join(among.distinct(), ["imp", "article_id"], "left_semi")
    got = bm25.retrieve(terms, weighted, past, ["imp"], k=20, among=among)
    assert got.dtypes == want.select(got.columns).dtypes
    assert 0 < got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "x long, c string")
    assert {(r["column"], r["nulls"]) for r in profiling.nulls(df).collect()} == {("x", 0), ("c", 1)}
    assert [tuple(r) for r in profiling.value_counts(df, "c").collect()] == [("a", 2), (None, 1)]
    assert {r["bin"]: r["n"] for r in profiling.histogram(df, "x", 2).collect()} == {0: 1, 1: 2}
    assert profiling.schema_difference(df, df.withColumn("d", F.lit(1)))["only_second"] == [("d", "int")]


def test_one_pass_metrics_equal_the_single_ones(spark):
    more = [(2, p, s, 0) for p, s in enumerate([1.0, 2.0])] + [(3, p, s, 1) for p, s in enumerate([1.0, 1.0, 0.5])]
    df = spark.createDataFrame([*SCORES, *more], "imp long, pos int, score double, y int")
    ranked = rankers.rank(df, ["imp"])
    both = metrics.per_impression(ranked, ["imp"]).orderBy("imp").collect()
    single = metrics.auc_on_scores(ranked, ["imp"]).join(metrics.mrr(ranked, ["imp"]), "imp").join(metrics.ndcg(ranked, ["imp"]), "imp").orderBy("imp").collect()
    assert [tuple(r[c] for c in ("imp", "auc", "mrr", "ndcg_5", "ndcg_10")) for r in both] == [tuple(r) for r in single]
