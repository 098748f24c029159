"""Corpus-wide line dedup that returns keep bitmaps instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, ascii_lower, discard, materialize, table

MIN_CHARS = 10
#: A line is hot if it has this share of all lines, judged by about so many sampled ones.
HOT, SAMPLE = 1 / 512, 1_000_000


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _row_key() -> list[Column]:
    """A row is a document id and its text: rows that repeat an id with other text stay apart."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")]


def hot_keys(hashes: DataFrame, rows: int) -> DataFrame:
    """``_k1, _k2, _parts``: hashes that an even sample says hold over ``HOT`` of all ``rows``, at most ``1 / HOT`` of them, and in how many runs to sort each.

    The sample is of lines, by a hash of where they stand; it balances the work and decides nothing else.
    """
    sampled = F.pmod(F.xxhash64(F.lit(17), "doc_id", "_pos"), F.lit(max(1, rows // SAMPLE))) == 0
    drawn = hashes.where(sampled).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * F.lit(max(1, rows // SAMPLE) / max(1, rows))
    return drawn.where(share > HOT).select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), F.ceil(share / HOT).alias("_parts"))


def dropped_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document that loses lines: ``doc_id, _th, bits``.

    ``bits`` maps ``line position div 64`` to a 64-bit word whose set bits are dropped lines; words
    without a dropped line are left out, so the bitmap is as long as what is dropped.

    The 128-bit hashes of line keys are written once, range-partitioned with document and position as secondary sort, and each partition streams its runs: a line is late if its
    document isn't the first of its run. A hash that holds a large part of all lines is sorted in several runs, dealt by document, over neighbouring
    partitions; the firsts of its runs, a few rows, are merged and its lines held against them. No task holds all of a hot line, and no text is moved.
    """
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select(*_row_key(), F.posexplode(line_array(F.col("text"))).alias("_pos", "_line"))
        .select("doc_id", "_th", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("doc_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(9), "_key").alias("_h2"))
    )
    hashes = materialize(lines, "hashes")
    hot = materialize(hot_keys(hashes, hashes.count()), "hot")
    known = hashes.join(F.broadcast(hot), (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left")
    dealt = known.withColumn("_run", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("_parts"))).otherwise(F.lit(-1)))
    ranged = dealt.select("doc_id", "_th", "_pos", "_h1", "_h2", "_run").repartitionByRange("_h1", "_h2", "_run")
    run = W.partitionBy("_h1", "_h2", "_run").orderBy("doc_id", "_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    streamed = ranged.withColumn("_first", F.first("doc_id").over(run))
    streamed = materialize(streamed.where((F.col("_run") >= 0) | (F.col("doc_id") > F.col("_first"))), "streamed")
    discard(hashes, hot)
    split = streamed.where("_run >= 0")
    firsts = split.groupBy("_h1", "_h2").agg(F.min("_first").alias("_least")).select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), "_least")
    place = ["doc_id", "_th", "_pos"]
    merged = split.join(F.broadcast(firsts), (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")) & (F.col("doc_id") > F.col("_least")))
    late = streamed.where("_run < 0").select(*place).union(merged.select(*place))
    words = late.groupBy("doc_id", "_th", F.expr("_pos div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits")
    )
    return words.groupBy("doc_id", "_th").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("bits")
    )


def kept_lines(text: Column, bits: Column) -> Column:
    """The lines whose bit is not set; all of them where there is no bitmap."""
    lines = line_array(text)
    word = lambda i: F.coalesce(F.element_at(bits, (i / 64).cast("bigint")), F.lit(0).cast("bigint"))
    kept = F.filter(lines, lambda x, i: F.call_function("shiftright", word(i), F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1)) == 0)
    return F.when(bits.isNull(), lines).otherwise(kept)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (at least ``doc_id, text``) with ``_bits``, the bitmap of dropped lines or null.

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A key
    of at least ``min_chars`` code points that several documents hold stays only in the smallest
    ``doc_id``, repeats within that document included. Null or empty text is one empty line. Rows
    with a null ``doc_id`` take no part and keep all lines. Rows that repeat an id belong to
    the same document. An empty table gives an empty result. Other columns pass through untouched.
    """
    bitmaps = materialize(dropped_bitmaps(docs.select("doc_id", "text"), min_chars), "bitmaps").select(
        F.col("doc_id").alias("_bid"), F.col("_th").alias("_bth"), F.col("bits").alias("_bits")
    )
    return docs.join(
        bitmaps,
        (F.col("doc_id") == F.col("_bid")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_bth")),
        "left",
    ).drop("_bid", "_bth")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = docs.select(
        "doc_id",
        F.size(line_array(F.col("text"))).cast("long").alias("n_lines"),
        kept_lines(F.col("text"), F.col("_bits")).alias("_kept"),
    )
    return kept.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("_kept")).alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the dropped lines; no document goes."""
    out = dedup_lines(docs)
    text = F.when(F.col("_bits").isNull(), F.col("text")).otherwise(
        F.array_join(kept_lines(F.col("text"), F.col("_bits")), "\n")
    )
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars", F.when(F.col("_bits").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        )
    return out.select(*docs.columns)


_TRIM = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
OP9_SQL = rf"""
WITH base AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM base),
k AS (SELECT doc_id, rid, pos, line, translate({_TRIM}, '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
