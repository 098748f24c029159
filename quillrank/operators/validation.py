"""Checks of rank lists against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize

LINE = r"^(\S+) \[([0-9,]*)\]$"


def parse_line(line: Column) -> tuple[Column, Column]:
    """Id and ranks of a rank line; an unreadable line has an empty id."""
    ranks = F.filter(F.split(F.regexp_extract(line, LINE, 2), ","), lambda x: x != "")
    return F.regexp_extract(line, LINE, 1), F.transform(ranks, lambda x: x.cast("int"))


def is_permutation(ranks: Column, n: Column) -> Column:
    """Whether ``ranks`` are 1..n in some order."""
    full = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_sort(ranks) == full, F.lit(False))


def validate_lines(lines: DataFrame, sizes: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """``keys, is_valid`` of ``lines(keys, line)`` against ``sizes(keys, n_candidates)``: id and permutation both fit.

    Impressions without a line, and lines without an impression, are not valid.
    """
    ident, ranks = parse_line(F.col("line"))
    joined = sizes.join(lines, keys, "full")
    ok = (ident == F.col(id_column).cast("string")) & is_permutation(ranks, F.col("n_candidates"))
    return joined.select(*keys, F.coalesce(ok, F.lit(False)).alias("is_valid"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` from 1 in the order of ``order``.

    Positions come from a count per range partition and a row number inside it, so no task sorts all rows. The partitions are written once and read by
    both: ranges rest on a sample and adaptive execution joins small partitions, so a second run of the same deal would cut elsewhere.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("_part").alias("_p"), before.alias("_before")))  # a row per partition
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    joined = ranged.withColumn("_local", local).join(offsets, F.col("_part") == F.col("_p"))
    return joined.withColumn("idx", (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_p", "_before", "_local")


def validate_order(lines: DataFrame, lines_order: list[str], source: DataFrame, source_order: list[str]) -> DataFrame:
    """``idx, expected, got, is_valid``: the n-th of ``lines(line, ...)`` against the n-th of ``source(id, n_candidates, ...)``.

    A line is valid if it has the id of the source's row in that place and ranks that are a permutation of its candidates; missing and extra lines aren't.
    """
    ident, ranks = parse_line(F.col("line"))
    got = numbered(lines, lines_order).select("idx", ident.alias("got"), ranks.alias("_ranks"))
    want = numbered(source, source_order).select("idx", F.col("id").cast("string").alias("expected"), "n_candidates")
    ok = (F.col("got") == F.col("expected")) & is_permutation(F.col("_ranks"), F.col("n_candidates"))
    return want.join(got, "idx", "full").select("idx", "expected", "got", F.coalesce(ok, F.lit(False)).alias("is_valid"))
