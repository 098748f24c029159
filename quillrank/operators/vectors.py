"""Vector pooling and exact dense top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import doubles, unit
from ..sources.scratch import materialize

#: Rows of a block of vectors or users.
BLOCK = 8192


def pooled(members: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dim, value``: the unit vector of the mean over ``members(keys, article_id)`` with a vector; repeats count again."""
    each = members.join(vectors, "article_id").select(*keys, F.posexplode(doubles(F.col("vector"))).alias("dim", "x"))
    dims = each.groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"])
    units = dims.groupBy(*keys).agg(ordered.alias("v"))
    return units.select(*keys, F.posexplode(unit(F.col("v"))).alias("dim", "value"))


def _cell(keys: list[str], k: int, exclude: str):
    """The ``k`` nearest vectors of one block for each user of one block; masked and non-finite scores come last."""

    def run(users: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in [*keys, "article_id", "raw", "masked"]})
        if not len(users) or not len(held):
            return none
        held = held.sort_values("article_id")
        ids, matrix = held.article_id.to_numpy(), np.array(held.vector.tolist(), np.float64)
        out = []
        for at in range(0, len(users), 256):
            part = users.iloc[at : at + 256]
            with np.errstate(invalid="ignore", over="ignore"):
                scores = np.array(part.user_vector.tolist(), np.float64) @ matrix.T
            for i, own in enumerate(part._seen):
                masked = np.isin(ids, list(own)) if own is not None and len(own) else np.zeros(len(ids), bool)
                raw = np.where(np.isposinf(scores[i]), 1.0, scores[i])
                masked |= ~np.isfinite(raw)
                s = np.round(np.where(masked, -np.inf, raw), 6)
                order = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))  # with all that tie with the k-th
                order = order[np.lexsort((ids[order], -s[order]))][:k]
                if exclude == "drop":
                    order = order[~masked[order]]
                got = {c: [part[c].iloc[i]] * len(order) for c in keys}
                out.append(pd.DataFrame(got | {"article_id": ids[order], "raw": np.where(masked[order], 0.0, s[order]), "masked": masked[order].astype(np.int32)}))
        return pd.concat(out)

    return run


def dense_top_k(users: DataFrame, vectors: DataFrame, history: DataFrame, keys: list[str], k: int = 200, exclude: str = "mask", block: int = BLOCK) -> DataFrame:
    """``keys, article_id, score, rank``: the ``k`` nearest vectors of each ``users(keys, user_vector)``, exact.

    ``exclude="mask"`` puts articles of the history after all others, with a null score, so they show up where fewer than ``k``
    others exist; ``"drop"`` leaves them out. A score that isn't a number, or is infinitely low, is treated like a masked one; an infinitely high one is 1. Users and vectors are dealt to blocks of
    about ``block`` rows; a cell of two blocks is one matrix product in one task and sends on ``k`` rows per user, which meet in a window. Nothing passes through the driver.
    """
    seen = history.select(*keys, "article_id").distinct().groupBy(*keys).agg(F.collect_list("article_id").alias("_seen"))
    asked = materialize(users.join(seen, keys, "left"), "asked")
    held = materialize(vectors.select("article_id", "vector"), "vectors")
    cores = users.sparkSession.sparkContext.defaultParallelism
    n, m = held.count(), asked.count()
    n_blocks = max(1, -(-n // block))
    m_blocks = max(1, -(-m // block), min(cores // n_blocks, m // 256))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("*", F.pmod(F.xxhash64(*keys), F.lit(m_blocks)).cast("int").alias("ub"), every(n_blocks, "vb"))
    right = held.select("*", F.pmod(F.xxhash64("article_id"), F.lit(n_blocks)).cast("int").alias("vb"), every(m_blocks, "ub"))
    schema = ", ".join([f"{c} {t}" for c, t in users.select(*keys).dtypes] + [f"article_id {dict(vectors.dtypes)['article_id']}", "raw double", "masked int"])
    found = left.groupBy("ub", "vb").cogroup(right.groupBy("ub", "vb")).applyInPandas(_cell(keys, k, exclude), schema)
    score = F.when(F.col("masked") == 0, F.col("raw"))
    w = W.partitionBy(*keys).orderBy("masked", F.desc("score"), "article_id")
    ranked = found.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*keys, "article_id", "score", "rank")
