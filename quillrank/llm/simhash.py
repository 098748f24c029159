"""SimHash fingerprints and near-dedup with pigeonring filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, materialize, table
from .components import LocalUnion, connected_components

BITS, RADIUS, SEGMENTS = 64, 2, 7
#: A bucket of more fingerprints than this is divided by a second ring, and then into blocks of about so many.
BUCKET = 512


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of ``hashes`` (uint64, n x words) have each bit set, low bits first."""
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    total = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(rows), 255 * 64):
        bits = np.unpackbits(rows[at : at + 255 * 64], axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a document's shingle hashes: bits set in over half of them."""
    on = bit_counts(hashes) * 2 > len(hashes)
    return np.packbits(on, bitorder="little").view(np.uint64)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def simhash64(text: str | None, n: int = 3) -> int:
    h = shingle_hashes(text, n)
    return int(majority(h)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id, fp`` of whole texts; ``fp`` is the fingerprint as a signed 64-bit number."""

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.col("text")).alias("fp"))


def ring(segments: int, places: list[int]) -> list[int]:
    """The bit masks of ``segments`` neighbouring parts of ``places``, as even as can be."""
    cut = [i * len(places) // segments for i in range(segments + 1)]
    return [sum(1 << p for p in places[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


def equal_length(radius: int, segments: int) -> int:
    """How many segments at the head of a good chain are equal: those ``l`` whose budget ``l * radius / m`` is under 1."""
    return -(-segments // radius) - 1 if radius else segments


def heads(radius: int, segments: int, places: list[int]) -> list[int]:
    """Per start of the ring the mask of its equal head, which is what buckets are keyed by."""
    parts, n = ring(segments, places), equal_length(radius, segments)
    return [sum(parts[(i + k) % segments] for k in range(n)) for i in range(segments)]


def chain_ok(xor: np.ndarray, start: np.ndarray, radius: int, segments: list[int]) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps each prefix of ``l`` segments within ``l * radius / m``."""
    m = len(segments)
    boxes = np.stack([np.bitwise_count(xor & np.uint64(s)) for s in segments]).astype(np.int64)
    ok, total, column = np.ones(len(xor), bool), np.zeros(len(xor), np.int64), np.arange(len(xor))
    for length in range(1, m + 1):
        total += boxes[(start + length - 1) % m, column]
        ok &= total * m <= length * radius
    return ok


def bucket_links(radius: int, segments: list[int]):
    """Links inside the buckets of a batch, as edges from each linked fingerprint to its bucket's root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf.fps.map(len).to_numpy()
            if not len(sizes):
                continue
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf.fps])
            owner, start = np.repeat(np.arange(len(sizes)), sizes), np.repeat(pdf.start.to_numpy(), sizes)
            fps, at, union = flat.view(np.uint64), np.arange(len(flat)), LocalUnion(len(flat))
            for step in range(1, int(sizes.max())):
                at = at[at + step < len(flat)]
                at = at[owner[at] == owner[at + step]]
                if not len(at):
                    break
                new = at[union.apart(at, at + step)]
                xor = fps[new] ^ fps[new + step]
                keep = chain_ok(xor, start[new], radius, segments)
                keep[keep] = np.bitwise_count(xor[keep]) <= radius  # the full Hamming check
                union.join(new[keep], new[keep] + step)
            root = union.roots()
            linked = np.flatnonzero(root != np.arange(len(flat)))
            yield pd.DataFrame({"a": flat[linked], "b": flat[root[linked]]})

    return run


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def crowded(keyed: DataFrame, bucket: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """``keyed(start, key, fp)`` in two: buckets of 2 to ``bucket`` fingerprints as lists, and the rows of larger ones with their size ``n``."""
    counts = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, f"{tag}-buckets").toDF("s", "k", "n")
    shared = materialize(keyed.join(counts, (F.col("start") == F.col("s")) & (F.col("key") == F.col("k"))).select("start", "key", "n", "fp"), tag)
    small = shared.where(F.col("n") <= bucket).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    return small.select("start", "fps"), shared.where(F.col("n") > bucket)


def near_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints of ``distinct(fp)`` within ``radius`` of each other.

    Pigeonring: over ``m`` segments in a ring, any two fingerprints within the radius have a start from which
    each chain of ``l`` segments differs in at most ``l * radius / m`` bits. As long as that is under 1 the segments are equal, so buckets are (start, value of the equal head): with
    7 segments and radius 2 three of them, 27 bits. Inside buckets the longer chains prune before the full check. Edges span each bucket's links; they don't list all pairs.

    A bucket over ``bucket`` fingerprints, whose head they all share, is divided by a second ring over the other bits in the same way. What is still over that is dealt to
    blocks, and each pair of blocks is compared in a cell of its own. So all is compared that may be within the radius, and no task holds more than two blocks.
    """
    if not 0 < radius < segments:
        raise ValueError("the head of a chain is equal only if there are more segments than the radius")
    whole = list(range(BITS))
    first = heads(radius, segments, whole)
    parts = ring(segments, whole)
    key = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for i, mask in enumerate(first)])
    index = distinct.select("fp", F.explode(key).alias("s")).select("s.start", "s.key", "fp")
    small, large = crowded(index, bucket, "first-ring")
    edges = small.mapInPandas(bucket_links(radius, parts), "a long, b long")
    # the second ring: the first head and a head over the rest
    rest = [[signed(mask | second) for second in heads(radius, segments, [p for p in whole if not mask >> p & 1])] for mask in first]
    masks = F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in rest]), F.col("start") + 1)
    within = large.select("start", "fp", F.posexplode(masks).alias("second", "mask"))
    within = within.select((F.col("second") * segments + F.col("start")).alias("start"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    small, large = crowded(within, bucket, "second-ring")
    one_ring = small.withColumn("start", F.col("start") % segments)
    edges = edges.union(one_ring.mapInPandas(bucket_links(radius, parts), "a long, b long"))
    blocks = F.ceil(F.col("n") / bucket)
    own = large.withColumn("own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = own.groupBy("start", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list("fp").alias("fps"))
    return edges.union(cells.select((F.col("start") % segments).alias("start"), "fps").mapInPandas(bucket_links(radius, parts), "a long, b long"))


def simhash_components(docs: DataFrame, n: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    A null or empty text has fingerprint zero, linked like any other. Copies share a fingerprint and
    count once in all that follows, so a group of copies of any size is one fingerprint.
    Rows that repeat an id are returned as often; a null id has a fingerprint but never names a component (a
    component of null ids alone has a null id). An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, n), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least").withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    named = materialize(named, "named")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- wide fingerprints: grouping by shingle similarity -----------------------------------------

#: Words of a wide fingerprint; the least similarity of near copies; a radius that no two sets of that similarity exceed; rows of a block.
WIDE, NEAR, LOOSE, WINDOW = 8, 0.8, 160, 2048
#: Common shingles that are put last in the order of all, at most (16 bytes each), and rounds of looking for them. Neither bears on what is found.
HOT, ROUNDS = 1_000_000, 6
MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(WIDE)]
TOKEN = re.compile(r"\w+")


def widen(h: np.ndarray) -> np.ndarray:
    """Eight 64-bit hashes of each 64-bit hash (a multiply-xorshift finaliser under eight keys)."""
    out = np.empty((len(h), WIDE), np.uint64)
    for k, key in enumerate(MIX):
        x = h ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def sliced(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` a few at a time, so that what is made of whole texts is held for few of them."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def wide_majority(h: np.ndarray) -> bytes:
    if not len(h):
        return bytes(8 * WIDE)
    total = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 16320):  # bounded memory on very long texts
        total += bit_counts(widen(h[at : at + 16320]))
    return np.packbits(total * 2 > len(h), bitorder="little").tobytes()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Hashes of the set of ``n``-word shingles in rising order, case and punctuation aside; of a shorter text, of all its words."""
    low = (text or "").lower()
    words = TOKEN.findall(low) or low.split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64)
    span = min(n, len(codes))
    mixed = np.zeros(len(codes) - span + 1, np.uint64)
    for k in range(span):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(28)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the sets share ``least`` of their union; exact."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) < least * len(b) - 1e-9:
        return False
    if not len(a):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def run_links(radius: int, window: int | None = None):
    """Links between rows of one sorted run that share a key, as ``a, b``; with a window, also keys left unfinished, as ``open``.

    With a window each row meets the ``window`` rows before it. A key is unfinished if its run is longer, or if it
    is the first or last of its partition, where a run may be cut. Without a window runs must be bounded and whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WIDE), np.uint64))
        ends: set[int] = set()
        for pdf in batches:
            if not len(pdf):
                continue
            fresh = (pdf.key.to_numpy(), pdf.rep.to_numpy(), np.frombuffer(b"".join(pdf.fp), np.uint64).reshape(-1, WIDE))
            key, rep, fp = (np.concatenate(x) for x in zip(held, fresh, strict=True))
            at, union = np.arange(max(1, len(held[0])), len(key)), LocalUnion(len(key))
            for step in range(1, len(key) if window is None else window + 1):
                at = at[at >= step]
                at = at[key[at] == key[at - step]]
                if not len(at):
                    break
                new = at[union.apart(at, at - step)]
                near = new[np.bitwise_count(fp[new] ^ fp[new - step]).sum(axis=1, dtype=np.int64) <= radius]
                union.join(near, near - step)
            root = union.roots()
            linked = np.flatnonzero(root != np.arange(len(key)))
            yield pd.DataFrame({"a": pd.array(rep[linked], "Int64"), "b": pd.array(rep[root[linked]], "Int64"), "open": pd.array([None] * len(linked), "Int64")})
            if window is not None:
                if not ends:
                    ends.add(int(key[0]))
                ends |= set(key[at].tolist()) if len(at) else set()  # rows that share their key with the row ``window`` before
                last = slice(max(0, len(key) - window), None)
            else:
                last = slice(int(np.searchsorted(key, key[-1])), None)
            held = (key[last], rep[last], fp[last])
        if window is not None and len(held[0]):
            ends.add(int(held[0][-1]))
            none = pd.array([None] * len(ends), "Int64")
            yield pd.DataFrame({"a": none, "b": none, "open": pd.array(sorted(ends), "Int64")})

    return run


LINKS = "a long, b long, open long"


def set_links(least: float, window: int | None = None):
    """Links ``a, b`` between rows of one sorted run that share a key and whose sets are similar; with a window, each row meets as many before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, root = None, [], {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for pdf in batches:
            out = []
            for key, rep, raw in zip(pdf.key, pdf.rep, pdf.set, strict=True):
                if key != last:
                    last, held, root = key, [], {}
                mine = np.frombuffer(raw, np.uint64)
                root.setdefault(rep, rep)
                for other, its in reversed(held):
                    if find(rep) != find(other) and similar(mine, its, least):
                        root[find(rep)] = find(other)
                        out.append((rep, other))
                held.append((rep, mine))
                if window is not None and len(held) > window:
                    del held[0]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64").assign(open=pd.array([None] * len(out), "Int64"))

    return run


def absorbed_by(links: DataFrame) -> DataFrame:
    """``node`` of the representatives that a smaller one of their component stands for."""
    roots = connected_components(links.select("a", "b"))
    least = materialize(roots.groupBy("root").agg(F.min("node").alias("first")), "least").withColumnRenamed("root", "r")
    return roots.join(least, F.col("root") == F.col("r")).where("node <> first").select("node")


def cell_links(rows: DataFrame, radius: int, block: int, links=None) -> DataFrame:
    """Links between all rows of ``rows(key, rep, fp)`` that share a key, whatever its size; ``links`` may judge other columns than ``fp``.

    A key of more than ``block`` rows is dealt into blocks; each pair of blocks is a cell of about two blocks at most,
    and a cell is the most that a task holds at once.
    """
    what = [c for c in rows.columns if c not in ("key", "rep")]
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), F.ceil(F.col("n") / block).alias("blocks"))
    sized = rows.join(materialize(sizes, "sizes"), F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))  # cells that collide are only compared in vain
    cells = paired.select(cell.alias("key"), "rep", *what).repartition("key").sortWithinPartitions("key", "rep")
    return cells.mapInPandas(links or run_links(radius), LINKS)


def counted(keyed: DataFrame) -> DataFrame:
    """``k, n``: the keys that several rows of ``keyed(key, rep)`` have, and how many."""
    return materialize(keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")


def shared(keyed: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``key, rep`` of the rows whose key another row has too. What was written for ``keyed`` and ``counts`` is deleted."""
    if counts is None:
        keyed = materialize(keyed, "keyed")
        counts = counted(keyed)
    out = materialize(keyed.join(counts.select("k"), F.col("key") == F.col("k")).select("key", "rep"), "shared")
    discard(keyed, counts)
    return out


def prefix_length(size: int, least: float) -> int:
    """How many shingles, the first in an order of all, two sets that share ``least`` of their union have one in common of."""
    return size - ceil(round(least * size, 6)) + 1 if size else 0


def rare_prefix(h: np.ndarray, hot: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The prefix of a set in the order that puts the shingles ``hot`` (sorted) after all others, the rarest of them first."""
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    known = hot[at] == h
    last = h[known][np.lexsort((h[known], often[at[known]]))]
    return np.concatenate([h[~known], last])[: prefix_length(len(h), least)]


def rare_first(keyed: DataFrame, sets_of, least: float, window: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``keyed(key, rep)``, the prefixes of all sets in the order of their hashes, in an order that puts common shingles last; and its ``counted``.

    A prefix filter is complete in any order that is the same for all sets. So shingles that over ``window`` prefixes hold are moved to the end, and
    only the sets whose prefix holds one of them are read again (``sets_of``: ``rep, set`` of a table of ``rep``). Of what comes up in their place a like share may be common, hence up to
    ROUNDS. A passage that a third of all texts quote is a key of few then, and not one whose rows all meet. At most ``most`` shingles, the commonest,
    are moved: that bounds what is sent to tasks, and has no bearing on what is found.
    """
    spark = keyed.sparkSession
    hot, often = np.empty(0, np.uint64), np.empty(0, np.int64)
    for _ in range(ROUNDS):
        counts = counted(keyed)
        top = counts.where(F.col("n") > window).orderBy(F.desc("n"), "k").limit(most).toArrow()
        key, n = top["k"].to_numpy().view(np.uint64), top["n"].to_numpy()
        fresh = np.flatnonzero(~np.isin(key, hot))[: most - len(hot)]
        if not len(fresh):
            return keyed, counts
        hot, often = np.concatenate([hot, key[fresh]]), np.concatenate([often, n[fresh]])
        order = np.argsort(hot)
        hot, often = hot[order], often[order]
        held = spark.sparkContext.broadcast((hot, often))

        def moved(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in sliced(batches):
                some = [rare_prefix(np.frombuffer(x, np.uint64), *held.value, least) for x in pdf.set]
                yield pd.DataFrame({"key": np.concatenate([*some, np.empty(0, np.uint64)]).view(np.int64), "rep": np.repeat(pdf.rep.to_numpy(), [len(x) for x in some])})

        # sets without a hot shingle in their prefix have the same prefix in the new order
        common = spark.createDataFrame(pa.table({"k": hot.view(np.int64)}))
        met = keyed.join(common, F.col("key") == F.col("k"), "left_semi").select(F.col("rep").alias("m")).distinct()
        met = materialize(met, "met")
        again = sets_of(met.select(F.col("m").alias("rep"))).mapInPandas(moved, "key long, rep long")
        changed = materialize(keyed.join(met, F.col("rep") == F.col("m"), "left_anti").union(again), "keyed")
        discard(keyed, counts, met)
        keyed = changed
    return keyed, counted(keyed)


def ring_groups(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``key, rep`` of the rows of ``reps(rep, fp)`` a word of whose wide fingerprint links to a word of another's; ``key`` names the component.

    Each of the eight words is a SimHash fingerprint of 64 bits of its own; all go through the pigeonring of ``near_links`` at once. A row has as many keys as words with company.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, 4096):
            yield pd.DataFrame({"word": np.frombuffer(b"".join(pdf.fp), np.int64), "rep": np.repeat(pdf.rep.to_numpy(), WIDE)})

    words = materialize(reps.select("rep", "fp").mapInPandas(split, "word long, rep long"), "words")
    prints = materialize(words.select(F.col("word").alias("fp")).distinct(), "prints")
    roots = connected_components(near_links(prints, radius))
    met = shared(words.join(roots, F.col("word") == F.col("node"), "left").select(F.coalesce("root", "word").alias("key"), "rep").distinct())
    discard(words, prints)
    return met


def near_duplicates(docs: DataFrame, n: int = 5, least: float = NEAR, window: int = WINDOW) -> DataFrame:
    """``doc_id`` of documents to drop so that no two of similarity ``least`` stay; of each group the smallest id stays.

    Similarity is the share of common five-word shingles (case and punctuation aside) of two texts, and is judged on the
    whole sets. Candidates are complete: in any order of all shingles, here that of their hashes, two sets that share
    ``least`` of their union have a common shingle among the first ``size - ceil(least * size) + 1`` of each (prefix filter; ``rare_first`` moves common shingles out of it).
    First comes the search that the query runs: 64-bit SimHash fingerprints, here eight of each set, through the pigeonring of ``near_links`` to components.
    The texts of a component are compared in a sorted run, each with the rows before it, and all but one of what is linked goes.
    Sets of similarity 0.8 differ in some ten of 64 bits, which no ring with selective heads holds; what follows finds the pairs beyond its radius.
    Texts with the same first shingle are compared in such a run too, so that a large group of copies is small in what follows. Then those with a common shingle in their prefixes are
    compared by 512-bit fingerprints at a radius so wide that it only spares work: a bit of two sets of similarity 0.8 differs
    with a chance of at most 0.19, so a pair beyond 160 bits is seven deviations out, whatever the texts are. What is linked
    that way forms loose groups, and in these all pairs of sets are compared exactly, in cells of two blocks.
    (A link between two documents that both go may be missed; it would join two groups whose remaining documents are no near copies.)
    Null ids are never dropped; rows that repeat an id share its fate. An empty table drops nothing.
    """
    block = max(1, window // 8)

    def digest(h: np.ndarray) -> bytes:
        return xxhash.xxh128_digest(h.tobytes())

    def prefix(h: np.ndarray) -> bytes:
        return h[: prefix_length(len(h), least)].tobytes()

    def wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            sets = [shingle_set(t, n) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "digest": [digest(h) for h in sets], "fp": [wide_majority(h) for h in sets], "prefix": [prefix(h) for h in sets]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = pdf[pdf.prefix.map(len) > 0]
            yield pd.DataFrame({"key": np.array([np.frombuffer(x[:8], np.int64)[0] for x in some.prefix], np.int64), "rep": some.rep})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            yield pd.DataFrame({"key": np.frombuffer(b"".join(pdf.prefix), np.int64), "rep": np.repeat(pdf.rep.to_numpy(), pdf.prefix.map(len).to_numpy() // 8)})

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            sets = [shingle_set(t, n) for t in pdf.text]
            same = np.array([digest(h) == d for h, d in zip(sets, pdf.digest, strict=True)], bool)  # an id may have several texts
            yield pd.DataFrame({"key": pdf.key, "rep": pdf.rep, "set": [h.tobytes() for h in sets]})[same]

    named = docs.where("doc_id is not null").select("doc_id", "text")
    fps = materialize(named.mapInPandas(wide, "doc_id long, digest binary, fp binary, prefix binary"), "wide")
    reps = fps.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("prefix").alias("prefix"))
    # an id with several texts is one representative per text
    reps = materialize(reps, "reps")
    discard(fps)
    texts = materialize(reps.select(F.col("rep").alias("r"), "digest"), "digests")

    def with_sets(of: DataFrame) -> DataFrame:
        known = of.join(texts, F.col("rep") == F.col("r")).select("key", "rep", "digest")
        return named.join(known, F.col("doc_id") == F.col("rep")).select("key", "rep", "digest", "text").mapInPandas(filled, "key long, rep long, set binary")

    def thinned(of: DataFrame, met: DataFrame) -> DataFrame:
        """``of`` without what is linked to a smaller row in the sorted runs of ``met(key, rep)``. What was written for both is deleted."""
        run = with_sets(met).repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
        links = materialize(run.mapInPandas(set_links(least, block), LINKS), "links")
        left = materialize(of.join(absorbed_by(links), F.col("rep") == F.col("node"), "left_anti"), "left")
        discard(met, links, of)
        return left

    left = thinned(reps, ring_groups(reps))
    left = thinned(left, shared(left.select("rep", "prefix").mapInPandas(first, "key long, rep long")))
    keyed = materialize(left.select("rep", "prefix").mapInPandas(each, "key long, rep long"), "keyed")
    held = shared(*rare_first(keyed, lambda of: with_sets(of.select(F.lit(0).cast("long").alias("key"), "rep")), least, window, HOT))
    rows = held.join(left.select(F.col("rep").alias("r"), "fp"), F.col("rep") == F.col("r")).select("key", "rep", "fp")
    loose = materialize(cell_links(rows, LOOSE, window), "loose")
    discard(held)
    grouped = materialize(connected_components(loose.select("a", "b")).select(F.col("root").alias("key"), F.col("node").alias("rep")), "grouped")
    sets = materialize(with_sets(grouped), "sets")
    exact = materialize(cell_links(sets, 0, block, set_links(least)), "exact")
    keep = left.join(absorbed_by(exact), F.col("rep") == F.col("node"), "left_anti")
    keep = materialize(keep.select("rep").distinct(), "keep")
    discard(left, loose, grouped, sets, exact, texts)
    return named.select("doc_id").join(keep, F.col("doc_id") == F.col("rep"), "left_anti")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays."""
    gone = materialize(near_duplicates(docs), "gone").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
