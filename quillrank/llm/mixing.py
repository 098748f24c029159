"""Mixing sources to target weights by repetition rates and hash-seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """Per source: ``source, source_size, target``, from ``sizes(source, size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``total`` times all
    words. A target stops at ``cap`` times its source's size and the rest is shared anew by
    weight: the level at which this ends is found in closed form. With sources sorted by
    ``cap * size / weight``, those before it are full and the others get ``weight * level``.
    The windows run over one row per source, after aggregation, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (turn % len(weights) + 1).cast("int")))
    full = F.col("source_size") * cap
    by_ratio = W.orderBy((full / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        weighed.withColumn("_full", full)
        .withColumn("_before", F.coalesce(F.sum("_full").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all").cast("double") * total - F.col("_before")) / F.col("_wleft"))
        .withColumn("_ok", F.col("_level") * F.col("w") <= F.col("_full"))
        .withColumn("_final", F.min(F.when(F.col("_ok"), F.struct(F.col("_full") / F.col("w"), F.col("_level")))).over(everything))
    )
    share = F.col("_final")["_level"] * F.col("w")
    return level.select(
        "source",
        "source_size",
        F.when(F.col("_final").isNull(), F.col("_full").cast("double"))
        .otherwise(F.least(share, F.col("_full").cast("double")))
        .alias("target"),
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies_of(doc_id: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    """How often a document is taken: the whole part of its source's rate, and a draw on the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    base = F.floor(rate)
    return (base + F.when(draw(doc_id, seed) < rate - base, 1).otherwise(0)).cast("long")


def mix_copies(docs: DataFrame, total: float = TOTAL, cap: int = CAP, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)`` with how often the mix takes it.

    Returns ``doc_id, size, source_size, target, copies``. ``rate = target / source_size``; a document
    is taken ``floor(rate)`` times, and once more if its seeded draw falls below the fraction, so
    reruns and rows that repeat an id agree. Null text has size 0; null source is a source of its own;
    a null id draws like any other id. An empty source has target 0 and rate 0.

    Texts are read once: their sizes are kept as a narrow table. The per-source table is
    joined as its measured size allows: broadcast if small, else by a skew-splitting sort-merge.
    """
    narrow = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(narrow, weights, total, cap), "targets").withColumnRenamed("source", "_src")
    joined = narrow.join(targets, F.col("source").eqNullSafe(F.col("_src")), "left")
    copies = copies_of(F.col("doc_id"), F.col("target"), F.col("source_size"), seed)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with ``copy`` from 1.

    The sizes of all that the stage before kept decide the rates.
    """
    mixed = mix_copies(docs.select("doc_id", "source", "text"))
    rates = mixed.select(F.col("source").alias("_src"), F.col("source_size").alias("_size"), F.col("target").alias("_target")).distinct()
    joined = docs.join(materialize(rates, "rates"), F.col("source").eqNullSafe(F.col("_src")), "left")
    n = copies_of(F.col("doc_id"), F.col("_target"), F.col("_size")).cast("int")
    kept = [c for c in docs.columns if c != "copy"]
    return joined.where(n > 0).select(*kept, F.explode(F.sequence(F.lit(1), n)).alias("copy"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
b AS (SELECT *, coalesce(sum(cap) OVER s, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER s, 0) AS wleft, sum(source_size) OVER () AS alls
      FROM w WINDOW s AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(alls AS DOUBLE) * 1.5::DOUBLE - CAST(used AS DOUBLE)) / CAST(wleft AS DOUBLE) AS level FROM b),
o AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT w.source, w.source_size, coalesce(least(o.level * w.w, CAST(w.cap AS DOUBLE)), CAST(w.cap AS DOUBLE)) AS target FROM w LEFT JOIN o ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
  CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
