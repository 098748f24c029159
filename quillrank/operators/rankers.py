"""Popularity, decayed affinity and the rankers made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import doubles, dot, freshness, log_popularity, unit

POPULARITY_WEIGHT, SUBCATEGORY_WEIGHT, SEMANTIC_WEIGHT = 0.15, 2.0, 0.25
TOPIC_FRESH = {"category": 0.52, "topic": 0.28, "popularity": 0.12, "freshness": 0.08}
DIGITS = 6


def click_counts(candidates: DataFrame) -> DataFrame:
    """``article_id, clicks`` of the clicked candidates."""
    return candidates.where("y = 1").groupBy("article_id").agg(F.count(F.lit(1)).alias("clicks"))


def rank(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``scored`` with ``rank`` from 1: higher score first, ties in candidate order.

    Scores are compared to six digits, since the last bits of a distributed sum depend on its order.
    """
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(w))


def with_popularity(candidates: DataFrame, clicks: DataFrame) -> DataFrame:
    """``candidates`` with ``clicks`` (0 if unknown) and ``most``, the greatest count."""
    most = clicks.agg(F.coalesce(F.max("clicks"), F.lit(1)).alias("most"))
    joined = candidates.join(clicks, "article_id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return joined.crossJoin(F.broadcast(most))


def popularity(candidates: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    return with_popularity(candidates, clicks).select(*keys, "pos", "article_id", F.col("clicks").cast("double").alias("score"))


def log_popular(candidates: DataFrame, clicks: DataFrame, keys: list[str], weight: float = POPULARITY_WEIGHT) -> DataFrame:
    score = weight * log_popularity(F.col("clicks"), F.col("most"))
    return with_popularity(candidates, clicks).select(*keys, "pos", "article_id", score.alias("score"))


def affinity(history: DataFrame, articles: DataFrame, keys: list[str], columns: list[str], decay: float, last: int, missing: str = "") -> DataFrame:
    """``keys, kind, key, weight``: decayed weight of each value of ``columns`` over the ``last`` newest items.

    An unknown article counts for the value ``missing`` of a plain column and for no value of an array column.
    """
    arrays = {c for c, t in articles.dtypes if t.startswith("array")}
    seen = history.where(F.col("age") < last).join(articles.select("article_id", *columns), "article_id", "left")

    def entries(c: str) -> Column:
        keyed = F.coalesce(c, F.array()) if c in arrays else F.array(F.coalesce(c, F.lit(missing)))
        return F.transform(keyed, lambda x: F.struct(F.lit(c).alias("kind"), x.alias("key")))

    values = [entries(c) for c in columns]
    each = seen.select(*keys, F.pow(F.lit(decay), F.col("age").cast("double")).alias("_p"), F.explode(F.concat(*values)).alias("v"))
    return each.groupBy(*keys, F.col("v.kind").alias("kind"), F.col("v.key").alias("key")).agg(F.sum("_p").alias("weight"))


def profile_maps(profile: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, and per kind a map from value to weight and the greatest weight: one row per impression.

    A profile has at most as many entries as the history that was kept, so the maps are small.
    """
    w = F.max("weight").over(W.partitionBy(*keys, "kind"))
    kinds = profile.withColumn("top", w).groupBy(*keys, "kind").agg(F.map_from_entries(F.collect_list(F.struct("key", "weight"))).alias("m"), F.max("top").alias("top"))
    return kinds.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("m", "top")))).alias("profile"))


def _weight(kind: str, value: Column) -> Column:
    entry = F.element_at(F.col("profile"), kind)
    return F.coalesce(F.element_at(entry["m"], value), F.lit(0.0))


def _top(kind: str) -> Column:
    return F.coalesce(F.element_at(F.col("profile"), kind)["top"], F.lit(1.0))


def affinity_ranker(
    candidates: DataFrame, history: DataFrame, articles: DataFrame, clicks: DataFrame, keys: list[str], weights: dict[str, float] | None = None,
    normalize: bool = False, decay: float = 0.85, last: int = 20, popularity_weight: float = POPULARITY_WEIGHT,
) -> DataFrame:
    """Affinity of plain columns plus log popularity; raw sums, or each over its greatest in the impression."""
    weights = weights or {"category": 1.0, "subcategory": SUBCATEGORY_WEIGHT}
    maps = profile_maps(affinity(history, articles, keys, list(weights), decay, last), keys)
    joined = with_popularity(candidates, clicks).join(articles.select("article_id", *weights), "article_id", "left").join(maps, keys, "left")
    score = popularity_weight * log_popularity(F.col("clicks"), F.col("most"))
    for c, w in weights.items():
        part = _weight(c, F.coalesce(c, F.lit("")))
        score = score + w * (part / _top(c) if normalize else part)
    return joined.select(*keys, "pos", "article_id", score.alias("score"))


def user_vectors(history: DataFrame, vectors: DataFrame, keys: list[str], decay: float = 1.0, last: int | None = None) -> DataFrame:
    """``keys, user_vector``: the unit vector of the decayed sum over known history vectors; repeats count again."""
    seen = history if last is None else history.where(F.col("age") < last)
    each = seen.join(vectors.select("article_id", "vector"), "article_id").select(
        *keys, F.pow(F.lit(decay), F.col("age").cast("double")).alias("_p"), F.posexplode(doubles(F.col("vector"))).alias("dim", "x")
    )
    dims = each.groupBy(*keys, "dim").agg(F.sum(F.col("_p") * F.col("x")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"])
    return dims.groupBy(*keys).agg(ordered.alias("v")).select(*keys, unit(F.col("v")).alias("user_vector"))


def semantic(candidates: DataFrame, history: DataFrame, vectors: DataFrame, keys: list[str], decay: float = 1.0, last: int | None = None) -> DataFrame:
    """Cosine of the user's and the article's vector; 0 where either is missing or the product isn't a finite number."""
    users = user_vectors(history, vectors, keys, decay, last)
    joined = candidates.join(vectors.select("article_id", "vector"), "article_id", "left").join(users, keys, "left")
    cos = dot(doubles(F.col("vector")), F.col("user_vector"))
    return joined.select(*keys, "pos", "article_id", F.when(~F.isnan(cos) & (F.abs(cos) != float("inf")), cos).otherwise(0.0).alias("score"))


def hybrid(candidates: DataFrame, history: DataFrame, articles: DataFrame, vectors: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised affinity and popularity plus a quarter of the decayed semantic score."""
    base = affinity_ranker(candidates, history, articles, clicks, keys, normalize=True)
    cos = semantic(candidates, history, vectors, keys, decay=0.85, last=20).withColumnRenamed("score", "_cos")
    joined = base.join(cos, [*keys, "pos", "article_id"])
    return joined.select(*keys, "pos", "article_id", (F.col("score") + SEMANTIC_WEIGHT * F.col("_cos")).alias("score"))


def topic_fresh(
    candidates: DataFrame, history: DataFrame, articles: DataFrame, clicks: DataFrame, times: DataFrame, keys: list[str],
    decay: float = 0.88, last: int = 30, missing_category: str = "", missing_freshness: float = 0.0,
) -> DataFrame:
    """Category, topics, popularity and freshness; ``times`` has ``keys, now``, ``articles`` a ``published`` column."""
    maps = profile_maps(affinity(history, articles, keys, ["category", "topics"], decay, last, missing_category), keys)
    joined = (
        with_popularity(candidates, clicks)
        .join(articles.select("article_id", "category", "topics", "published"), "article_id", "left")
        .join(maps, keys, "left")
        .join(times, keys, "left")
    )
    topics = F.coalesce("topics", F.array())
    topic = F.aggregate(topics, F.lit(0.0), lambda s, t: s + _weight("topics", t)) / (_top("topics") * F.greatest(F.lit(1), F.size(topics)))
    score = (
        TOPIC_FRESH["category"] * _weight("category", F.coalesce("category", F.lit(missing_category))) / _top("category")
        + TOPIC_FRESH["topic"] * topic
        + TOPIC_FRESH["popularity"] * log_popularity(F.col("clicks"), F.col("most"))
        + TOPIC_FRESH["freshness"] * freshness(F.col("now"), F.col("published"), missing=missing_freshness)
    )
    return joined.select(*keys, "pos", "article_id", score.alias("score"))
