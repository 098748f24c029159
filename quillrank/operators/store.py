"""Feature store: articles, impressions, chronological split, dedup, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import labelled_items, recency_weights, split_items
from ..sources.readers import BEHAVIORS, MISSING, NEWS, PLACE, TIME_FORMAT, first_existing, read_tsv


def dedup(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) by ``order``, which must settle ties."""
    by = [F.desc(c) if keep == "last" else F.asc(c) for c in order]
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def temporal_split(df: DataFrame, ts: str, validation_days: int = 1, test_days: int = 1) -> DataFrame:
    """``df`` with ``split`` counted back from the latest time; a null time is in no split (null).

    The latest time is one row, found by a combining aggregate.
    """
    latest = df.agg(F.max(ts).alias("_latest"))
    back = lambda d: F.col("_latest") - F.expr(f"INTERVAL {d} DAYS")
    split = (
        F.when(F.col(ts) >= back(test_days), "test")
        .when(F.col(ts) >= back(test_days + validation_days), "validation")
        .when(F.col(ts).isNotNull(), "train")
    )
    return df.crossJoin(F.broadcast(latest)).withColumn("split", split).drop("_latest")


def manifest(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.where("split is not null").groupBy(*by, "split").agg(F.count(F.lit(1)).alias("impressions"))


def tsv_articles(spark, path: str, split: str, dataset: str = "mind") -> DataFrame:
    """Articles with their places in the file."""
    df = read_tsv(spark, path, NEWS, MISSING, places=True)
    entities = F.concat(F.coalesce("title_entities", F.lit("")), F.lit(" "), F.coalesce("abstract_entities", F.lit("")))
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("source_split"), "article_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"), F.lit("").alias("body"), "category", entities.alias("entities"),
        F.lit(False).alias("embedding_available"), F.lit(None).cast("string").alias("embedding_path"), *PLACE,
    )


def tsv_impressions(spark, path: str, split: str, dataset: str = "mind") -> DataFrame:
    df = read_tsv(spark, path, BEHAVIORS, MISSING)
    candidates, clicked = labelled_items(F.col("impressions"))
    history = split_items(F.col("history"))
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("source_split"), "impression_id", "user_id",
        F.try_to_timestamp("time", F.lit(TIME_FORMAT)).cast("timestamp_ntz").alias("timestamp"), candidates.alias("candidate_ids"), clicked.alias("clicked_ids"),
        history.alias("history_ids"), F.lit(None).cast("string").alias("session_id"), recency_weights(history).alias("history_recency_weights"),
    )


def parquet_articles(df: DataFrame, split: str, dataset: str = "ebnerd") -> DataFrame:
    text = lambda names, default="": F.coalesce(first_existing(df, names, default).cast("string"), F.lit(default))
    entities = first_existing(df, ["entity_groups", "ner_clusters"])
    return df.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("source_split"), F.col("article_id").cast("string").alias("article_id"), text(["title"]).alias("title"),
        text(["subtitle", "abstract"]).alias("abstract"), text(["body"]).alias("body"), first_existing(df, ["category_str", "category"]).cast("string").alias("category"),
        entities.alias("entities"), F.lit(False).alias("embedding_available"), F.lit(None).cast("string").alias("embedding_path"), *[c for c in PLACE if c in df.columns],
    )


def parquet_impressions(behaviors: DataFrame, history: DataFrame, split: str, dataset: str = "ebnerd") -> DataFrame:
    """Behaviors with the user's history; users without one have an empty list, of repeated users the last counts.

    The last is that of the greatest place, if ``history`` was read ``with_place``; else the last in the order of its partitions.
    """
    ids = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string"))
    past = first_existing(history, ["article_id_fixed", "article_id"])
    order = [c for c in PLACE if c in history.columns]
    placed = history if order else history.withColumn("src_row", F.monotonically_increasing_id())
    order = order or ["src_row"]
    last = dedup(placed.select(F.col("user_id").alias("_user"), past.alias("_past"), *order), ["_user"], order, keep="last").drop(*order)
    joined = behaviors.join(last, F.col("user_id") == F.col("_user"), "left")
    return joined.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("source_split"), F.col("impression_id").cast("string").alias("impression_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("impression_time").cast("timestamp_ntz").alias("timestamp"), ids(first_existing(behaviors, ["article_ids_inview"])).alias("candidate_ids"), ids(first_existing(behaviors, ["article_ids_clicked"])).alias("clicked_ids"),
        ids(F.col("_past")).alias("history_ids"), first_existing(behaviors, ["session_id"]).cast("string").alias("session_id"), recency_weights(ids(F.col("_past"))).alias("history_recency_weights"),
    )


def flatten(impressions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``candidates`` and ``history`` in normal form from canonical impressions."""
    candidates = impressions.select(*keys, "clicked_ids", F.posexplode("candidate_ids").alias("pos", "article_id")).withColumn(
        "y", F.array_contains("clicked_ids", F.col("article_id")).cast("int")
    )
    history = impressions.select(*keys, F.posexplode(F.reverse("history_ids")).alias("age", "article_id"))
    return candidates.drop("clicked_ids"), history
