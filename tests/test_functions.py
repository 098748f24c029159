import math

import pytest
from pyspark.sql import functions as F

from quillrank.functions.scores import bm25_idf, cosine_of, freshness, log_popularity, unit
from quillrank.functions.text import entity_ids, labelled_items, newest, recency_weights, split_items, tokenize


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_labelled_items_split_on_the_last_dash(spark):
    candidates, clicked = labelled_items(F.col("v"))
    df = spark.createDataFrame([("N55689-1 N35729-0 N123 A-B-1 -1 1",), ("",), (None,)], "v string").select(candidates, clicked)
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (["N55689", "N35729", "N123", "A-B", "", "1"], ["N55689", "A-B", "", ""])
    assert rows[1:] == [([], []), ([], [])]


def test_recency_weights(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "h array<string>").select(recency_weights(F.col("h")).alias("w"))
    assert [r["w"] for r in df.collect()] == [[0.64, 0.8, 1.0], []]


@pytest.mark.parametrize(
    ("text", "words"),
    [("don't", ["don"]), ("ÆØÅ 3½", ["æøå", "3½"]), ("foo_bar", ["foo_bar"]), ("áb", []), (None, []), ("The end of IT", ["end"])],
)
def test_tokenize(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("w"))
    assert df.first()["w"] == words


def test_newest_and_split(spark):
    df = spark.createDataFrame([(["x1", "x2", "x3"], "a  b")], "h array<string>, s string")
    r = df.select(newest(F.col("h"), 5).alias("n"), newest(F.col("h"), 2).alias("m"), split_items(F.col("s")).alias("s")).first()
    assert (r["n"], r["m"], r["s"]) == (["x3", "x2", "x1"], ["x3", "x2"], ["a", "b"])


def test_entity_ids(spark):
    rows = [('[{"WikidataId":"Q1"},{"Label":"x"}]',), ("garbage",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(entity_ids(F.col("t")).alias("e"))
    assert [r["e"] for r in df.collect()] == [["Q1"], [], [], []]


def test_freshness(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-03 00:00:00' AS now, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS p, TIMESTAMP_NTZ'2024-02-01 00:00:00' AS later, CAST(NULL AS TIMESTAMP_NTZ) AS none")
    r = df.select(*[freshness(F.col("now"), F.col(c)).alias(c) for c in ("p", "later", "none")], freshness(F.col("now"), F.col("none"), missing=1.0).alias("assumed")).first()
    assert round(0.08 * r["p"], 6) == 0.048522
    assert (r["later"], r["none"], r["assumed"]) == (1.0, 0.0, 1.0)


def test_scores(spark):
    assert one(spark, log_popularity(F.col("c"), F.col("m")), c=3, m=3) == 1.0
    assert one(spark, log_popularity(F.col("c"), F.col("m").cast("long")), c=0, m=None) == 0.0
    assert math.isclose(one(spark, bm25_idf(F.col("n"), F.col("d")), n=4, d=1), math.log(1 + 3.5 / 1.5))
    assert one(spark, unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert math.isclose(one(spark, cosine_of(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(0.0)))), 1 / math.sqrt(2))
