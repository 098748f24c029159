import os
import zipfile

from pyspark.sql import functions as F

from quillrank.operators import store
from quillrank.sources import archives, readers, scratch, writers


def test_tsv_store(spark, tmp_path):
    news = 'N1\tnews\tworld\tA "quoted\tNA\thttp://x\t[{"WikidataId":"Q1"}]\t[]\nN2\tsport\tfoot\tB\tb\tu\t\t\n'
    (tmp_path / "news.tsv").write_text(news)
    behaviors = "1\tU1\t11/15/2019 9:05:58 AM\tN1 N2\tN1-1 N2-0\n2\tU2\tbad\t\tN2-1\n"
    (tmp_path / "behaviors.tsv").write_text(behaviors)
    a = {r["article_id"]: r for r in store.tsv_articles(spark, str(tmp_path / "news.tsv"), "train").collect()}
    assert (a["N1"]["title"], a["N1"]["abstract"], a["N2"]["entities"]) == ('A "quoted', "", " ")
    i = {r["impression_id"]: r for r in store.tsv_impressions(spark, str(tmp_path / "behaviors.tsv"), "train").collect()}
    assert (i["1"]["candidate_ids"], i["1"]["clicked_ids"], i["1"]["history_recency_weights"]) == (["N1", "N2"], ["N1"], [0.8, 1.0])
    assert i["1"]["timestamp"].hour == 9
    assert (i["2"]["timestamp"], i["2"]["history_ids"]) == (None, [])
    assert readers.read_lines(spark, str(tmp_path / "behaviors.tsv"), 5).count() == 2


def test_parquet_store_keeps_the_last_history(spark):
    behaviors = spark.sql("SELECT 1 AS impression_id, 7 AS user_id, TIMESTAMP'2024-01-01' AS impression_time, array(1, 2) AS article_ids_inview, array(2) AS article_ids_clicked")
    history = spark.createDataFrame([(7, [1]), (7, [2, 3]), (8, [4])], "user_id int, article_id_fixed array<int>").coalesce(1)
    r = store.parquet_impressions(behaviors, history, "validation").first()
    assert (r["history_ids"], r["candidate_ids"], r["session_id"]) == (["2", "3"], ["1", "2"], None)
    articles = spark.sql("SELECT 5 AS article_id, 't' AS title, 's' AS subtitle, 3 AS category, array('x') AS ner_clusters")
    a = store.parquet_articles(articles, "train").first()
    assert (a["abstract"], a["category"], a["body"], a["entities"]) == ("s", "3", "", ["x"])


def test_vectors_and_discovery(spark, tmp_path):
    (tmp_path / "e.vec").write_text("Q1\t1.0\t2.0\nQ2\tx\t3\nshort\t1\n")
    got = {r["id"]: r["vector"] for r in readers.read_vectors(spark, str(tmp_path / "e.vec"), dim=2).collect()}
    assert got == {"Q1": [1.0, 2.0], "Q2": [None, 3.0]}
    df = spark.sql("SELECT 1 AS article_id, 'x' AS n, array(1.0) AS doc")
    assert readers.vector_column(df, "article_id") == "doc"
    assert df.select(readers.first_existing(df, ["zz", "n"]).alias("v")).first()["v"] == "x"
    assert df.select(readers.first_existing(df, ["zz"], "d").alias("v")).first()["v"] == "d"


def test_archives(tmp_path):
    source = tmp_path / "a.zip"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("in/news.tsv", "x")
        z.writestr("__MACOSX/news.tsv", "y")
        z.writestr("../out.txt", "z")
    target = archives.extract_all(source, tmp_path / "t")
    assert (target / "in/news.tsv").read_text() == "x"
    assert not (tmp_path / "out.txt").exists() and not (target / "__MACOSX").exists()
    assert archives.find_member(source, "/news.tsv") == "in/news.tsv"
    assert archives.extract_member(source, "in/news.tsv", tmp_path / "one/news.tsv").read_text() == "x"


def test_submission(spark, tmp_path):
    ranked = spark.createDataFrame([(2, 0, 2), (2, 1, 1), (1, 0, 1)], "imp long, pos int, rank int")
    lines = writers.rank_lines(ranked, "imp", ["imp"])
    writers.write_submission(lines, ["imp"], str(tmp_path / "out"))
    writers.pack_submission(spark, str(tmp_path / "out"), str(tmp_path / "p.zip"))
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.read("prediction.txt").decode() == "1 [1]\n2 [2,1]\n"
    split = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    writers.write_store(split, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where(F.col("split") == "test").count() == 1
    writers.write_json({"a": 1}, tmp_path / "m.json")
    assert (tmp_path / "m.json").read_text().startswith("{")


def test_places_and_profiles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("z\ny\n")
    (tmp_path / "in/b.txt").write_text("x")
    df = readers.with_place(spark.read.text(str(tmp_path / "in")))
    assert [r["value"] for r in df.orderBy(*readers.PLACE).collect()] == ["z", "y", "x"]
    got = {r["path"][-5:]: (r["bytes"], r["lines"]) for r in readers.file_profile(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": (4, 2), "b.txt": (1, 1)}


def test_the_history_fallback_column(spark):
    behaviors = spark.sql("SELECT 1 AS impression_id, 7 AS user_id, TIMESTAMP'2024-01-01' AS impression_time, array(1, 2) AS article_ids_inview, array(2) AS article_ids_clicked")
    history = spark.createDataFrame([(7, [4])], "user_id int, article_id array<int>")
    assert store.parquet_impressions(behaviors, history, "train").first()["history_ids"] == ["4"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from quillrank.sources import scratch

    class Conf:
        def get(self, name, default=None):
            return "spark://host" if name == "spark.master" else default

    class Session:
        conf = Conf()

    try:
        scratch.shared_dir(Session())
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a cluster without a shared folder was accepted")


def test_discard_deletes_scratch_tables_alone(spark):
    kept, spent = (scratch.materialize(spark.range(3), x) for x in ("kept", "spent"))
    plain = spark.range(2)
    scratch.discard(spent, spent, plain, spent.withColumnRenamed("id", "x"))
    assert kept.count() == 3 and plain.count() == 2
    assert not os.path.exists(spent._scratch.removeprefix("file:")) and os.path.exists(kept._scratch.removeprefix("file:"))
