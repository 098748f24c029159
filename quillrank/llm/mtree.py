"""Exact top-k by inner product over an M-tree of paged metric nodes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

K, EVERY, SCALE = 5, 50, 256.0
#: Vectors of a page; queries of a block; routing objects at most, and how many vectors each is for.
PAGE, BLOCK, LEAVES, PER_LEAF = 512, 256, 1024, 512
SAMPLE = 2048
#: Quantized components must lie within this.
GREATEST = 1 << 53
SLACK = 1e-6
#: Lengths that have an index at least; of other lengths the vectors, and the numbers in them, that one task scans.
TREES, SCANNED, NUMBERS = 8, 4096, 1 << 20


def quantize(v: Column, scale: float = SCALE) -> Column:
    """``floor(scale * x)`` of each component; an error if one is beyond what a double holds exactly as an integer."""
    said = F.lit("a quantized component is beyond 2**53")
    return F.transform(v, lambda x: F.when(F.abs(F.lit(scale) * x.cast("double")) < float(GREATEST), F.floor(F.lit(scale) * x.cast("double"))).otherwise(F.raise_error(said)).cast("long"))


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~bad


@dataclass
class Tree:
    """The routing part, bounded by LEAVES: tops, the leaf objects under them, and their stored distances.

    Vectors are lifted to one norm, ``x' = (x, sqrt(M - |x|^2))``, where the nearest point to ``(q, 0)`` has the
    greatest inner product with q; the lifted space is metric, so triangle-inequality bounds hold in it.
    """

    bound: float
    leaf: np.ndarray
    top_of: np.ndarray
    tops: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    top_distance: np.ndarray | None = None
    radius: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.bound - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(square, 0))

    def insert(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector by descent to the nearest top and its nearest leaf, and the distance to it."""
        y = self.lift(x)
        top = self.between(y, self.lift(self.leaf[self.tops])).argmin(axis=1)
        d = self.between(y, self.lift(self.leaf))
        under = np.where(self.top_of[None] == top[:, None], d, np.inf)
        at = under.argmin(axis=1)
        return at, np.linalg.norm(y - self.lift(self.leaf)[at], axis=1)

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's leaves from the best on, and what their members are away at least: by the tops' distances and the stored ones alone.

        The query's own leaf, where it would be inserted, is the first.
        """
        z = np.hstack([q, np.zeros((len(q), 1))])
        to_top = self.between(z, self.lift(self.leaf)[self.tops])[:, self.top_of]
        low = np.maximum(np.abs(to_top - self.top_distance[None]) - self.radius[None], 0)
        first = low.copy()
        first[np.arange(len(q)), self.insert(q)[0]] = -1
        return np.argsort(first, axis=1, kind="stable"), low

    def near(self, q: np.ndarray, tau: np.ndarray, low: np.ndarray, turn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``leaf, queries, distances`` of the leaves whose turn it is (``turn``, a flag per query and leaf) and that may hold a nearer vector than ``tau``.

        Where the stored distances already exclude a leaf, its own distance isn't computed.
        """
        z = np.hstack([q, np.zeros((len(q), 1))])
        objects, reach = self.lift(self.leaf), tau * (1 + SLACK) + SLACK
        open_ = turn & (low <= reach[:, None])
        for leaf in np.flatnonzero(open_.any(axis=0)):
            rows = np.flatnonzero(open_[:, leaf])
            d = np.linalg.norm(z[rows] - objects[leaf], axis=1)
            may = d - self.radius[leaf] <= reach[rows]
            if may.any():
                yield int(leaf), rows[may], d[may]


def plant(sample: np.ndarray, ids: np.ndarray, bound: float, leaves: int) -> Tree:
    """Routing objects are the first ``leaves`` of the hash-ordered sample, tops the first of those."""
    leaf = sample[:leaves]
    tops = np.arange(max(1, int(np.sqrt(len(leaf)))))
    tree = Tree(bound, leaf, np.zeros(len(leaf), int), tops, sample, ids)
    lifted = tree.lift(leaf)
    d = tree.between(lifted, lifted[tops])
    tree.top_of = d.argmin(axis=1)
    tree.top_distance = np.linalg.norm(lifted - lifted[tops[tree.top_of]], axis=1)
    tree.radius = np.zeros(len(leaf))
    return tree


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where all sums fit 53 bits, in 64-bit integers where they fit those, else in Python's; an error if a score is beyond 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    wide = q.astype(object) @ x.astype(object).T
    if wide.size and max(abs(int(wide.max())), abs(int(wide.min()))) >= 2**63:
        raise OverflowError("an inner product is beyond 64 bits")
    return wide.astype(np.int64)


def best_of_page(qid: int, score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``(score, vec_id)`` of the k best, ties to the smaller id, the query's own left out. One vector may have k + 1 ids."""
    at = np.arange(len(score)) if len(score) <= k + 1 else np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1])
    rows = [(int(score[c]), int(i)) for c in at for i in ids[c] if i != qid]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


@contextmanager
def small_batches(spark, rows: int):
    """Pages are large rows; a batch holds few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def search_pages(dim: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                qid, far, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.fars), r.ids
                tau, dq = np.frombuffer(r.taus), np.frombuffer(r.dists)
                q = np.frombuffer(r.qvecs, np.int64).reshape(len(qid), dim)
                x = np.frombuffer(r.vecs, np.int64).reshape(len(far), dim)
                may = np.abs(dq[:, None] - far[None]) <= tau[:, None] * (1 + SLACK) + SLACK
                some = np.flatnonzero(may.any(axis=0))
                if not len(some):
                    continue
                score, near = exact_scores(q, x[some]), [ids[c] for c in some]
                for n in range(len(qid)):
                    out += [(int(qid[n]), i, s) for s, i in best_of_page(int(qid[n]), score[n], near, k)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k_of_dim(base: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    spark = base.sparkSession
    # copies of a vector are one object with its k + 1 least ids: more can't be in any answer
    few = W.partitionBy("v").orderBy("vec_id")
    objects = base.withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    objects = materialize(objects, "objects")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = objects.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    drawn = objects.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v", F.col("ids")[0].alias("id")).collect()
    leaves = max(1, min(LEAVES, -(-stats["n"] // PER_LEAF), len(drawn)))
    sample = np.array([r["v"] for r in drawn], np.float64).reshape(len(drawn), dim)
    tree = plant(sample, np.array([r["id"] for r in drawn], np.int64), float(stats["m"]), leaves)
    _, once = np.unique(tree.sample_ids, return_index=True)  # an id counts once for a k-th score
    tree.sample, tree.sample_ids = tree.sample[once], tree.sample_ids[once]

    def insert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, far = tree.insert(matrix(pdf.v))
                yield pd.DataFrame({"leaf": leaf, "far": far, "v": pdf.v, "ids": pdf.ids})

    placed = materialize(objects.mapInPandas(insert, "leaf int, far double, v array<long>, ids array<long>"), "placed")
    nodes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()  # LEAVES rows at most
    for r in nodes:
        tree.radius[r["leaf"]] = r["r"]
    sizes = {r["leaf"]: -(-r["n"] // PAGE) for r in nodes}
    per_leaf = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("leaf"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vecs = np.array(pdf.v.tolist(), np.int64)
        return pd.DataFrame({"leaf": [key[0]], "vecs": [vecs.tobytes()], "fars": [pdf.far.to_numpy().tobytes()], "ids": [pdf.ids.tolist()]})

    paged = placed.withColumn("page", F.pmod(F.xxhash64("v"), per_leaf)).groupBy("leaf", "page")
    pages = materialize(paged.applyInPandas(pack, "leaf int, vecs binary, fars binary, ids array<array<long>>"), "pages")

    def plan(start: int, end: int):
        """Query blocks to the leaves from place ``start`` to ``end`` of each query's order that are within its reach."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), BLOCK):
                    pdf = whole.iloc[at : at + BLOCK]
                    q = matrix(pdf.v)
                    lifted = np.sqrt((q * q).sum(axis=1) + tree.bound)
                    known = exact_scores(q, tree.sample).astype(np.float64)
                    known[pdf.query_id.to_numpy()[:, None] == tree.sample_ids[None]] = -np.inf
                    kth = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
                    kth = np.fmax(kth, pdf.kth.to_numpy(np.float64))
                    tau = np.sqrt(np.maximum(lifted**2 - 2 * kth, 0))
                    order, low = tree.order(q)
                    turn = np.zeros(low.shape, bool)
                    np.put_along_axis(turn, order[:, start:end], True, axis=1)
                    ids = pdf.query_id.to_numpy(np.int64)
                    rows = [(leaf, ids[n].tobytes(), q[n].astype(np.int64).tobytes(), tau[n].tobytes(), d.tobytes()) for leaf, n, d in tree.near(q, tau, low, turn)]
                    if (np.take_along_axis(low, order[:, end:], axis=1) <= (tau * (1 + SLACK) + SLACK)[:, None]).any():
                        rows.append((-1, b"", b"", b"", b""))  # no leaf, but a sign that a later round may visit one
                    yield pd.DataFrame(rows, columns=["at", "qids", "qvecs", "taus", "dists"])

        return run

    visits = "at int, qids binary, qvecs binary, taus binary, dists binary"
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    start = 0
    while start < leaves:  # 1, 2, 4, ... of each query's leaves: as many rounds as doublings
        end = 2 * start + 1
        kth = best.where(F.col("rn") == k).select(F.col("query_id").alias("qk"), F.col("score").alias("kth")) if start else None
        asked = queries.withColumn("kth", F.lit(None).cast("long")) if kth is None else queries.join(kth, F.col("query_id") == F.col("qk"), "left").select("query_id", "v", "kth")
        visit = materialize(asked.mapInPandas(plan(start, end), visits), "visits")
        if start and visit.isEmpty():
            break
        with small_batches(spark, 64):
            met = visit.join(pages, F.col("at") == F.col("leaf")).select("qids", "qvecs", "taus", "dists", "vecs", "fars", "ids")
            wave = materialize(met.mapInPandas(search_pages(dim, k), "query_id long, vec_id long, score long"), "wave")
        found = best.select("query_id", "vec_id", "score").union(wave).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = materialize(found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k), "best")
        start = end
    return best.select("query_id", "vec_id", "score")


def scan_all(k: int, every: int):
    """The ``k`` best ids of each query of a length that has few vectors, by all products."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vecs, out = pdf.vec_id.to_numpy(), np.stack([np.asarray(v, np.int64) for v in pdf.v]), []
        for at in np.flatnonzero(ids % every == 0).tolist():
            score = exact_scores(vecs[at : at + 1], vecs)[0]
            best: dict[int, int] = {}
            for j in np.lexsort((ids, -score)).tolist():
                if ids[j] != ids[at]:
                    best.setdefault(int(ids[j]), int(score[j]))
                if len(best) == k:
                    break
            out += [(int(ids[at]), i, x) for i, x in best.items()]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def m_tree_top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest integer inner products of each query, exact.

    ``vectors(vec_id, embedding)`` is quantized to ``floor(scale * x)``. Queries are rows whose id is divisible by ``every``;
    candidates all rows but those of the query's id; ties go to the smaller id. Null vectors, null or non-finite components
    and null ids take no part; repeated rows count once; an id with several vectors is one query and one candidate, whose best
    score counts; vectors meet only vectors of their own length; a query with fewer
    candidates has fewer rows; an empty table gives none.

    Index: routing objects are a bounded hash-ordered sample, every vector is inserted below its nearest, and leaves
    are written as pages of about ``PAGE`` vectors with the stored distances to their routing object. Search: best first. A query's leaves are ordered by
    the lower bound from radii and stored parent distances and visited in rounds of 1, 2, 4, ... leaves; each round tightens the k-th distance, a leaf beyond it isn't visited, and the
    search ends when the bounds of all later leaves are beyond it. Inside a page the stored distances exclude vectors before any product is computed. Components beyond 2**53 after quantizing, and scores beyond 64 bits, are errors. Queries travel in blocks; no pair of rows is shuffled.
    The ``TREES`` most common lengths, and any with more than ``SCANNED`` vectors or ``NUMBERS`` numbers, have an index; all others are scanned in one pass.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantize(F.col("embedding"), scale).alias("v")).distinct()
    base = materialize(base, "vectors")
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    common = sorted(sizes, key=lambda r: -r["n"])[:TREES]
    trees = sorted(r["dim"] for r in sizes if r in common or r["n"] > SCANNED or r["n"] * r["dim"] > NUMBERS)
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for dim in trees:
        mine = base.where(F.size("v") == dim)
        asked = mine.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
        found = found.union(top_k_of_dim(mine, asked, dim, k))
    if len(trees) < len(sizes):
        rare = spark.createDataFrame([(d,) for d in sorted({r["dim"] for r in sizes} - set(trees))], "dim int")
        some = base.withColumn("size", F.size("v")).join(rare, F.col("size") == F.col("dim")).select("dim", "vec_id", "v")
        found = found.union(some.groupBy("dim").applyInPandas(scan_all(k, every), "query_id long, vec_id long, score long"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_mtree_topk(spark, sf_dir: str) -> DataFrame:
    return m_tree_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
