"""Writers of the store, of metrics and of rank lists."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ESCAPES, PLACE, with_place


def write_store(df: DataFrame, path: str, by: str = "split") -> None:
    """A store table as parquet, one folder per split, so that a split is read alone."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(value: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(value, indent=2, default=str))


def rank_lines(ranked: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """``keys, line``: ``<id> [r1,r2,...]`` with the ranks in candidate order, from ``keys, pos, rank``."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "rank")))
    lists = ranked.groupBy(*keys).agg(F.transform(ordered, lambda x: x["rank"]).alias("_ranks"))
    text = F.concat(F.col(id_column).cast("string"), F.lit(" ["), F.array_join(F.transform("_ranks", lambda r: r.cast("string")), ","), F.lit("]"))
    return lists.select(*keys, text.alias("line"))


def text_field(text: Column, missing: str) -> Column:
    """``text`` as a field of a tab-separated line, for ``read_tsv`` with ``escaped``: ``missing`` if null; escaped where it would end a field or line or be taken for nothing."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, char in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(mark)) if char else out
    bare = (out == missing) | out.rlike(r"^[\x00-\x20]*$")  # a line of blanks is no row to the reader
    return F.coalesce(F.when(bare, F.concat(F.lit("\\e"), out)).otherwise(out), F.lit(missing))


def number_field(number: Column) -> Column:
    """``number`` as a field of a tab-separated line; empty if null."""
    return F.coalesce(number.cast("string"), F.lit(""))


def write_submission(lines: DataFrame, order: list[str | Column], folder: str) -> None:
    """Lines in the order of ``order`` as text, in parts that follow each other by name."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(folder)


def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write_submission`` wrote, with each line's place."""
    return with_place(spark.read.text(folder)).withColumnRenamed("value", "line")


def pack_submission(spark: SparkSession, folder: str, archive: str, name: str = "prediction.txt") -> None:
    """The written lines as one file of an archive; the driver passes them on part by part and holds none."""
    ordered = written_lines(spark, folder).orderBy(*PLACE).select("line")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w", force_zip64=True) as out:
        for row in ordered.toLocalIterator():
            out.write(f"{row['line']}\n".encode())
