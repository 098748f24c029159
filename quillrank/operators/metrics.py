"""Ranking metrics per impression, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import doubles

COLD, WARM, ALL = "cold_history_under_5", "warm_history_5_or_more", "all"
COLD_BELOW = 5


def auc_on_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, auc``: the chance that a clicked candidate outscores another, ties a half; null if one class is empty.

    Mid-ranks in one window replace the comparison of all pairs.
    """
    return per_impression(scored.withColumn("rank", F.lit(1)), keys, ()).select(*keys, "auc")


def auc_on_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, auc`` of the rank permutation, which has no ties; 0 if one class is empty."""
    return auc_on_scores(ranked.withColumn("score", -F.col("rank")), keys).withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def mrr(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mrr``: one over the rank of the first click; 0 without one."""
    first = F.min(F.when(F.col("y") == 1, F.col("rank")))
    return ranked.groupBy(*keys).agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("mrr"))


def ideal(n, k: int):
    """The greatest discounted gain of ``n`` clicks in ``k`` places."""
    places = F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))
    return F.when(n > 0, F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))


def ndcg(ranked: DataFrame, keys: list[str], cuts=(5, 10), clicked: DataFrame | None = None) -> DataFrame:
    """``keys, ndcg_<k>`` with binary gains; 0 without a click.

    The ideal counts the clicked candidates, or with ``clicked(keys, n_clicked)`` all clicked ids of the impression, shown or not.
    """
    gain = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("y") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    g = ranked.groupBy(*keys).agg(*[gain(k).alias(f"g{k}") for k in cuts], F.sum("y").alias("n"))
    if clicked is not None:
        g = g.drop("n").join(clicked.withColumnRenamed("n_clicked", "n"), keys, "left")
    return g.select(*keys, *[F.round(F.coalesce(F.col(f"g{k}") / ideal(F.col("n"), k), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in cuts])


def per_impression(ranked: DataFrame, keys: list[str], cuts=(5, 10)) -> DataFrame:
    """``keys, n_clicked, auc, mrr, ndcg_<k>`` as above, from one window and one aggregate over the ranked candidates."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, "score"))
    mid = F.rank().over(W.partitionBy(*keys).orderBy("score")) + (ties - 1) / 2
    gain = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("y") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    g = ranked.withColumn("_mid", mid).groupBy(*keys).agg(
        F.sum(F.col("_mid") * F.col("y")).alias("s"), F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"),
        F.min(F.when(F.col("y") == 1, F.col("rank"))).alias("first"), *[gain(k).alias(f"g{k}") for k in cuts],
    )
    auc = F.when(F.col("p") * F.col("n") > 0, (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")))
    return g.select(
        *keys, F.col("p").alias("n_clicked"), F.round(auc, 6).alias("auc"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        *[F.round(F.coalesce(F.col(f"g{k}") / ideal(F.col("p"), k), F.lit(0.0)), 6).alias(f"ndcg_{k}") for k in cuts],
    )


def recall(retrieved: DataFrame, clicked: DataFrame, keys: list[str], cuts=(50, 100, 200)) -> DataFrame:
    """``keys, recall_<k>`` of ``clicked(keys, article_id)``; every impression of ``clicked`` counts."""
    hits = clicked.select(*keys, "article_id").distinct().join(retrieved.select(*keys, "article_id", "rank"), [*keys, "article_id"], "left")
    share = lambda k: F.sum(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    return hits.groupBy(*keys).agg(*[share(k).alias(f"recall_{k}") for k in cuts])


def diversity(ranked: DataFrame, vectors: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """``keys, diversity``: mean of 1 - cosine over pairs of the first ``k`` with vectors; 0 with fewer than two.

    With unit vectors the pairs' cosines sum to ``(|sum v|^2 - sum |v|^2) / 2``, so no pair is made.
    """
    top = ranked.where(F.col("rank") <= k)
    dims = top.join(vectors.select("article_id", "vector"), "article_id").select(*keys, F.posexplode(doubles(F.col("vector"))).alias("dim", "x"))
    sums = dims.groupBy(*keys, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("m"))
    total = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("c"), F.max("m").alias("m"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    value = F.when(F.col("m") > 1, 1 - F.col("c") / 2 / pairs).otherwise(0.0)
    return top.select(*keys).distinct().join(total, keys, "left").select(*keys, F.round(F.coalesce(value, F.lit(0.0)), 6).alias("diversity"))


def novelty(ranked: DataFrame, clicks: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """``keys, novelty``: mean self-information ``-log2(max(clicks, 1) / max(all clicks, 1))`` of the first ``k``."""
    total = clicks.agg(F.greatest(F.coalesce(F.sum("clicks"), F.lit(0)), F.lit(1)).alias("total"))
    top = ranked.where(F.col("rank") <= k).join(clicks, "article_id", "left").crossJoin(F.broadcast(total))
    info = -F.log2(F.greatest(F.coalesce("clicks", F.lit(0)), F.lit(1)) / F.col("total"))
    return top.groupBy(*keys).agg(F.round(F.avg(info), 6).alias("novelty"))


def coverage(ranked: DataFrame, catalog_size: DataFrame, k: int = 10) -> DataFrame:
    """One row ``covered, catalog, coverage``: distinct articles among the first ``k`` of all impressions over the catalog."""
    seen = ranked.where(F.col("rank") <= k).agg(F.count_distinct("article_id").alias("covered"))
    return seen.crossJoin(F.broadcast(catalog_size)).select("covered", "catalog", F.round(F.col("covered") / F.greatest("catalog", F.lit(1)), 6).alias("coverage"))


def by_slice(values: DataFrame, n_history: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` twice: once in the slice of all and once in that of cold or warm impressions."""
    bucket = F.when(F.coalesce("n_history", F.lit(0)) < COLD_BELOW, COLD).otherwise(WARM)
    return values.join(n_history, keys, "left").select(*values.columns, F.explode(F.array(F.lit(ALL), bucket)).alias("slice"))


def slices(values: DataFrame, n_history: DataFrame, keys: list[str], metrics: list[str], by: list[str]) -> DataFrame:
    """``by, slice, metric, n, value``: means over all, cold and warm impressions; null values are left out of a mean."""
    stack = F.expr(f"stack({len(metrics)}, {', '.join(f'{m!r}, cast({m} as double)' for m in metrics)}) as (metric, v)")
    long = by_slice(values, n_history, keys).select(*by, "slice", stack)
    return long.groupBy(*by, "slice", "metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("value"))
