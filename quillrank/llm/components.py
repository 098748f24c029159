"""Connected components by contraction in random order; nothing is gathered to one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over the links ``a``-``b``, in one process."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        label = label[label]
        if (label == old).all():
            break
    return label


class LocalUnion:
    """Labels of ``n`` nodes of one process that links join bit by bit, in bounded memory."""

    def __init__(self, n: int, hold: int = 200_000):
        self.label, self.hold, self.links = np.arange(n), hold, []

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs aren't known to be joined; only those need a comparison."""
        return self.label[a] != self.label[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.links.append((a, b))
            if sum(len(x) for x, _ in self.links) >= self.hold:
                self.roots()

    def roots(self) -> np.ndarray:
        """The smallest node that each node is joined to."""
        if self.links:
            a, b = (self.label[np.concatenate(x)] for x in zip(*self.links, strict=True))
            self.label, self.links = local_roots(len(self.label), a, b)[self.label], []
        return self.label


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a long, b long)``; one root, a node of it, per component.

    Each round hooks every node onto the neighbour of least random priority (itself, if it has
    the least) and rewrites the edges by that map, dropping loops and repeats, until none is
    left; the maps are then composed. Priorities are drawn anew each round, so that
    the edges shrink by a constant factor in expectation, whatever the shape of the graph. The minimum per
    node combines before its shuffle; maps hold one row per node, so a join that meets a hub can be split.
    Null ends and loops are ignored; an edge may be repeated; no edges give no rows.
    """
    current = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        k = F.lit(len(maps))
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(k, "v").alias("p"), F.col("v").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64(k, "u").alias("p"), F.col("u").alias("v"))
        hook = materialize(least.select("u", F.least(F.col("m"), own)["v"].alias("to")), "hooks")
        maps.append(hook)
        ends = [hook.select(F.col("u").alias(f"u{x}"), F.col("to").alias(f"to{x}")) for x in "ab"]
        rewritten = materialize(
            current.join(ends[0], F.col("a") == F.col("ua"))
            .join(ends[1], F.col("b") == F.col("ub"))
            .where("toa <> tob")
            .select(F.least("toa", "tob").alias("a"), F.greatest("toa", "tob").alias("b"))
            .distinct(),
            "edges",
        )
        discard(current)
        current = rewritten
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for hook in maps[1:]:
        out = out.join(hook, F.col("root") == F.col("u"), "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(out, "roots")
    discard(current, *maps)
    return out
