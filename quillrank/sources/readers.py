"""Readers that end in the canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS = "article_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS = "impression_id string, user_id string, time string, history string, impressions string"
TIME_FORMAT = "M/d/yyyy h:mm:ss a"
#: Texts that stand for a missing value in tabular files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: What stands for a character in the texts of an escaped file; a backslash is doubled, and the last mark is for nothing.
ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\0": "\0", "\\e": ""}


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for mark, char in ESCAPES.items():
            part = F.replace(part, F.lit(mark), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def read_tsv(spark: SparkSession, path: str, schema: str, missing: Sequence[str] = (), places: bool = False, escaped: bool = False) -> DataFrame:
    """A headerless, unquoted tab-separated file. Short lines give nulls; ``missing`` texts become null; ``places`` adds each row's place; ``escaped`` texts are those of ``writers.text_field``."""
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    df = with_place(df) if places else df
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    if missing:
        df = df.select(*[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
    if escaped:
        df = df.select(*[unescape(F.col(c)).alias(c) if c in text - set(PLACE) else F.col(c) for c in df.columns])
    return df


def read_lines(spark: SparkSession, path: str, fields: int, at_least: bool = False) -> DataFrame:
    """Lines split on tabs, as ``parts``; only those of ``fields`` fields (or, ``at_least``, no fewer)."""
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).select(parts.alias("parts"))
    return lines.where(F.size("parts") >= fields if at_least else F.size("parts") == fields)


def read_vectors(spark: SparkSession, path: str, dim: int = 100) -> DataFrame:
    """``id, vector`` of a text file of an id and ``dim`` numbers in each line."""
    parts = F.split("value", "\t", -1)
    return (
        spark.read.text(path)
        .where(F.size(parts) >= dim + 1)
        .select(parts[0].alias("id"), F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("float")).alias("vector"))
    )


def first_existing(df: DataFrame, names: Sequence[str], default=None) -> Column:
    """The first of ``names`` that ``df`` has, else ``default`` as a constant."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def vector_column(df: DataFrame, id_column: str) -> str:
    """The first array-typed column besides the id."""
    for f in df.schema:
        if f.name != id_column and isinstance(f.dataType, T.ArrayType):
            return f.name
    raise ValueError("no column holds arrays")


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, lines`` of each file below ``path``. Sizes come from metadata alone; lines are counted where the files are read, in parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("lines"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return files.join(lines, bare(F.col("path")) == bare(F.col("_path")), "left").select("path", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"))


#: Columns that name a row's place in its source, in order.
PLACE = ["src_file", "src_at", "src_row"]


def with_place(df: DataFrame) -> DataFrame:
    """``df``, read from files, with its rows' places: file, start of the part it was read in, and a number that rises within the part."""
    return df.select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_at"), F.monotonically_increasing_id().alias("src_row"))
