"""Bootstrap intervals with weights that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 500
MASK = (1 << 32) - 1
#: 2**32 times the distribution function of a Poisson count of mean 1, at 0 to 9.
POISSON = [1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276, 4294962463, 4294966817]


def seed_of(keys: list[str]) -> Column:
    """32 bits drawn from the keys' text."""
    text = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mixed(seed: Column, r: Column) -> Column:
    """32 bits drawn from a seed and the number of a replicate: two rounds of shift and multiply."""
    x = (seed + (r.cast("long") + 1) * F.lit(2654435769)).bitwiseAND(F.lit(MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def weight_of(drawn: Column) -> Column:
    """How often a row is in a replicate: a Poisson count of mean 1, which is what drawing n of n rows tends to."""
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(drawn < F.lit(POISSON[k]), k).otherwise(out)
    return out


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def interval(means: DataFrame, by: list[str]) -> DataFrame:
    """``by, centre, ci95_low, ci95_high`` of replicate values ``m``."""
    q = lambda p: F.round(F.percentile("m", F.lit(p)), 6)
    return means.groupBy(*by).agg(F.round(F.avg("m"), 6).alias("centre"), q(0.025).alias("ci95_low"), q(0.975).alias("ci95_high"))


def bootstrap_ci(values: DataFrame, keys: list[str], metrics: list[str], by: list[str], replicates: int = REPLICATES) -> DataFrame:
    """``by, metric, n, mean, ci95_low, ci95_high`` of the mean of each of ``metrics``; the mean is the sample's own.

    Null and non-finite values are dropped; without any the interval is null; a group without rows isn't returned. Each row draws how often it is in each replicate from a hash of ``keys``, so
    no row is moved to be drawn: sums per replicate combine on the map side, and a task sends on ``replicates`` rows per group.
    """
    held = values.select(*by, seed_of(keys).alias("_seed"), *[finite(m).alias(m) for m in metrics])
    each = held.select(*by, *metrics, "_seed", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))).alias("r"))
    # replicate -1 is the sample itself
    each = each.withColumn("_w", F.when(F.col("r") < 0, 1).otherwise(weight_of(mixed(F.col("_seed"), F.col("r")))))
    sums = each.groupBy(*by, "r").agg(
        *[F.sum(F.col("_w") * F.col(m)).alias(f"s_{m}") for m in metrics], *[F.sum(F.when(F.col(m).isNotNull(), F.col("_w"))).alias(f"w_{m}") for m in metrics]
    )
    stack = ", ".join(f"{m!r}, s_{m}, w_{m}" for m in metrics)
    long = sums.select(*by, "r", F.expr(f"stack({len(metrics)}, {stack}) as (metric, s, w)")).withColumn("m", F.when(F.col("w") > 0, F.col("s") / F.col("w")))
    own = long.where("r < 0").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("metric").alias("_metric"), F.coalesce("w", F.lit(0)).alias("n"), F.round("m", 6).alias("mean"))
    ci = interval(long.where("r >= 0"), [*by, "metric"])
    same = F.col("metric") == F.col("_metric")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(ci, same).select(*by, "metric", "n", "mean", "ci95_low", "ci95_high")


def bootstrap_coverage(ranked: DataFrame, keys: list[str], catalog: DataFrame, by: list[str] = (), k: int = 10, replicates: int = REPLICATES) -> DataFrame:
    """``by, metric, n, mean, ci95_low, ci95_high, observed_full_sample`` of coverage under resampling of whole lists.

    The mean is that of the replicates, which is lower than what was observed, as any resample leaves lists out. A list draws once the set of replicates it is in, as
    bits; an article's replicates are the union of its lists', which combines on the map side: one row per article, not one per replicate and article.
    """
    by = list(by)
    words = -(-replicates // 64)
    top = ranked.where(F.col("rank") <= k).select(*by, *keys, "article_id")

    def word(i: int) -> Column:
        bits = F.sequence(F.lit(0), F.lit(min(64, replicates - 64 * i) - 1))
        is_in = lambda b: mixed(F.col("_seed"), b + 64 * i) >= F.lit(POISSON[0])
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(is_in(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    lists = top.groupBy(*by, *keys).agg(F.collect_set("article_id").alias("_items")).withColumn("_seed", seed_of(keys))
    held = lists.select(*by, "_items", *[word(i).alias(f"b{i}") for i in range(words)])
    seen = held.select(*by, F.explode("_items").alias("article_id"), *[f"b{i}" for i in range(words)]).groupBy(*by, "article_id").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(words)])
    spread = F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))).alias("r")
    flags = F.element_at(F.array(*[f"b{i}" for i in range(words)]), (F.floor(F.greatest("r", F.lit(0)) / 64) + 1).cast("int"))
    is_in = (F.col("r") < 0) | (F.call_function("shiftright", flags, F.pmod(F.greatest("r", F.lit(0)), F.lit(64))).bitwiseAND(F.lit(1)) == 1)
    per = seen.select("*", spread).groupBy(*by, "r").agg(F.sum(is_in.cast("long")).alias("c")).crossJoin(F.broadcast(catalog))
    per = per.select(*by, "r", (F.col("c") / F.greatest("catalog", F.lit(1))).alias("m"))
    n = lists.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else lists.agg(F.count(F.lit(1)).alias("n"))
    full = per.where("r < 0").select(*by, F.round("m", 6).alias("observed_full_sample"))
    ci = interval(per.where("r >= 0"), by)
    out = ci.join(full, by).join(n, by) if by else ci.crossJoin(F.broadcast(full)).crossJoin(F.broadcast(n))
    return out.select(*by, F.lit(f"coverage_{k}").alias("metric"), "n", F.col("centre").alias("mean"), "ci95_low", "ci95_high", "observed_full_sample")
