"""URL filters as a sort-merge range join of reversed-host keys with nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEFAULT = "allow"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def reversed_key(host: Column) -> Column:
    """``a.example.com`` becomes ``com.example.a.``: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def swept(points: DataFrame, starts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """``points(bucket, key, ...)`` with ``stack``: the intervals of ``starts(key, depth)`` that each key is in, the outer ones first.

    An interval is the keys with a prefix, and any two are nested or disjoint. Points and starts are sorted together in each bucket; the sweep keeps a stack with a
    place per depth, and a start is put in the place of its depth. What stands in a place is active while the key has it as prefix: a later start of the same depth, or
    a key beyond the interval, takes that away.
    """
    every = starts.select("key", "depth", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).alias("kind"))
    both = points.withColumn("kind", F.lit(1)).unionByName(every, allowMissingColumns=True)
    sweep = W.partitionBy("bucket").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("key")), ignorenulls=True).over(sweep).alias(f"_s{d}") for d in range(depth)]
    held = both.select("*", *places).where("kind = 1")
    stack = F.filter(F.array(*[f"_s{d}" for d in range(depth)]) if depth else F.array().cast("array<string>"), lambda p: p.isNotNull() & F.startswith(F.col("key"), p))
    return held.withColumn("stack", stack).drop("kind", "depth", *[f"_s{d}" for d in range(depth)])


def nested_depth(keys: DataFrame, around) -> DataFrame:
    """``keys(key)`` with ``depth``: how many others its interval is in. ``around`` gives all prefixes that may be one, as an array."""
    outer = keys.select("key", F.explode(around(F.col("key"))).alias("_outer"))
    inner = outer.join(keys.select(F.col("key").alias("_outer")), "_outer").groupBy("key").agg(F.count(F.lit(1)).alias("depth"))
    return keys.join(inner, "key", "left").select("key", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def outer_hosts(key: Column) -> Column:
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    return F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("."))))


def outer_paths(key: Column) -> Column:
    at = F.instr(key, "?")
    return F.when(F.length(key) > at, F.transform(F.sequence(at, F.length(key) - 1), lambda n: F.substring(key, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, buckets: int | None = None) -> DataFrame:
    """Judge ``pages(page_id, url)`` by ``rules(verdict, host, path)``.

    Returns ``page_id, host, path, rule, verdict``, one row per page row (repeats included). A rule
    fits its host and all subdomains when the url's path starts with the rule's; the longest rule
    wins, ties by the greater rule string, of rules repeated with other verdicts the greater verdict. A url without ``://`` or null has empty host and path and gets
    ``default``; so does any url that no rule fits, with a null rule. No rules: all get ``default``. Rules with a null part don't count.

    Two sorted sweeps. In the first, rule hosts and urls are sorted by reversed-host key, and the stack holds the rule hosts a url is in. In the second, each of these
    hosts with the url's path is a key among those of host and path of the rules, and the innermost rule on the stack is the longest that fits for that host. The best of a url's hosts, a few rows,
    is found by a combining aggregate. Urls are dealt to buckets by a hash of the row, so a host with any share of the rows spreads evenly; the rules, the stated
    small side, are repeated in each bucket. What a url carries is bounded by how deep rules are nested, not by how many a host has.
    """
    spark = pages.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rules.where("host is not null and path is not null and verdict is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"), F.max("host").alias("said"))
    known = materialize(
        named.select(
            reversed_key(F.col("host")).alias("low"), F.concat(reversed_key(F.col("host")), F.lit("?"), F.col("path")).alias("key"), F.concat("said", "path").alias("rule"),
            F.length(F.concat("host", "path")).alias("len"), "verdict",
        ),
        "rules",
    )
    hosts = materialize(nested_depth(known.select(F.col("low").alias("key")).distinct(), outer_hosts), "rule-hosts")
    paths = materialize(nested_depth(known.select("key"), outer_paths), "rule-paths")
    deep = [df.agg(F.coalesce(F.max("depth") + 1, F.lit(0))).first()[0] for df in (hosts, paths)]
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = urls.withColumn("bucket", F.pmod(F.xxhash64("page_id", "host", "path", "row"), F.lit(n)).cast("int")).withColumn("key", reversed_key(F.col("host")))
    inside = materialize(swept(urls, hosts, deep[0], n).drop("key"), "inside")
    asked = inside.where(F.size("stack") > 0).select("row", "bucket", F.explode(F.transform("stack", lambda low: F.concat(low, F.lit("?"), F.col("path")))).alias("key"))
    fits = swept(asked, paths, deep[1], n).where(F.size("stack") > 0).select("row", F.element_at("stack", -1).alias("_key"))
    best = fits.join(known, F.col("_key") == F.col("key")).groupBy("row").agg(F.max(F.struct("len", "rule", "verdict")).alias("_best")).withColumnRenamed("row", "_row")
    return inside.join(best, F.col("row") == F.col("_row"), "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(verdict, host, path)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{SPLIT}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{SPLIT}', 2) AS path, row_number() OVER () AS rid FROM pages),
r(verdict, rhost, rpath) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (
  SELECT p.*, r.verdict, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
  FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE k = 1
"""
