"""Scalar scoring formulas and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BM25_K1, BM25_B = 1.5, 0.75
FLOOR = 1e-12


def log_popularity(clicks: Column, most: Column) -> Column:
    """``log1p(clicks) / log1p(most)``; nothing clicked anywhere counts as a maximum of 1."""
    top = F.greatest(F.coalesce(most, F.lit(1)), F.lit(1))
    return F.log1p(F.coalesce(clicks, F.lit(0)).cast("double")) / F.log1p(top.cast("double"))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """What one posting adds to a document's score for one query term."""
    saturation = tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length)
    return idf * tf * (BM25_K1 + 1) / saturation


def freshness(now: Column, published: Column, hours: float = 96.0, missing: float = 0.0) -> Column:
    """``exp(-age / hours)``, an age under 0 counting as 0; ``missing`` where the time isn't known."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9
    return F.when(published.isNull(), F.lit(missing)).otherwise(F.exp(-F.greatest(age, F.lit(0.0)) / hours))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x / n)


def cosine_of(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))
