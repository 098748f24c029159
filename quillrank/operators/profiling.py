"""Exploratory profiles as flat tables; charts are left to the reader of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nulls(df: DataFrame) -> DataFrame:
    """``column, nulls, share``: one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("nulls")) for c in df.columns])
    return counts.select("_n", F.explode(pairs).alias("p")).select(
        "p.column", "p.nulls", F.round(F.when(F.col("_n") > 0, F.col("p.nulls") / F.col("_n")).otherwise(0.0), 6).alias("share")
    )


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n_rows, n_columns``; counts come from file footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, column: str, limit: int = 0) -> DataFrame:
    """``key, n``, the most frequent first, ties by key; with ``limit`` the first of them."""
    counts = df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("key"))
    return counts.limit(limit) if limit else counts


def spread(df: DataFrame, column: str) -> DataFrame:
    """One row: count, distinct, least, greatest, mean and exact median."""
    c = F.col(column).cast("double")
    return df.agg(
        F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), F.min(c).alias("lowest"), F.max(c).alias("highest"),
        F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, n`` of equal widths between the extremes; the last bin holds its upper edge; empty bins are left out."""
    c = F.col(column).cast("double")
    ends = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def share_true(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.round(F.avg(F.col(column).cast("int")), 6).alias("share_true"))


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Columns (name and type) that only one of two tables has, and those both have."""
    left, right = set(a.dtypes), set(b.dtypes)
    return {"only_first": sorted(left - right), "only_second": sorted(right - left), "both": sorted(left & right)}
