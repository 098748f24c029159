"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact similarity."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .simhash import majority

SHINGLE, SIMILARITY = 5, 0.8
#: Hamming radius and blocks: two fingerprints within 19 bits share a block up to 1 bit.
RADIUS, BLOCKS = 19, 10
#: Benchmark items, and characters of them, that one pass over the documents holds; more take more passes.
ITEMS, CHARS = 20_000, 50_000_000
#: Words by which a window may be off because of words put in or left out before the anchor.
SHIFT = 2
TOKEN = re.compile(r"\w+")
K = np.uint64(0x9FB21C651E98DF25)


class Codes(dict):
    """Hash of each word, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word, 5)
        if len(self) < 200_000:
            self[word] = code
        return code


def tokens(text: str | None) -> list[str]:
    """Words of the text, case and punctuation aside."""
    return TOKEN.findall((text or "").lower())


def shingles(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ codes[k : k + len(out)]) * K
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Items:
    """The items of one pass: shingle postings, fingerprints and their multi-index."""

    ids: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    posts: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))
    fps: list[int] = field(default_factory=list)
    prints: np.ndarray | None = None
    index: dict[tuple[int, int], list[int]] = field(default_factory=lambda: defaultdict(list))
    known: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, item_id: int, text: str | None, codes: Codes) -> None:
        code = np.array([codes[w] for w in tokens(text)], np.uint64)
        if not len(code):
            return
        h = shingles(code, min(SHINGLE, len(code)))
        k = len(self.ids)
        self.ids.append(item_id)
        self.words.append(len(code))
        self.counts.append(Counter(h.tolist()))
        for at, x in enumerate(h.tolist()):
            self.posts[min(SHINGLE, len(code))][x].append((k, at))
        self.fps.append(int(majority(h)[0]))

    def close(self) -> Items:
        self.prints = np.array(self.fps, np.uint64)
        for k, fp in enumerate(self.fps):
            for b, (at, width) in enumerate(BLOCK):
                self.index[b, fp >> at & (1 << width) - 1].append(k)
        self.posts = {n: dict(p) for n, p in self.posts.items()}
        self.index = dict(self.index)
        self.known = {n: np.sort(np.fromiter(p, np.uint64)) for n, p in self.posts.items()}
        return self

    def within(self, fp: int) -> np.ndarray:
        """All items whose fingerprint is within RADIUS: some block differs in RADIUS // BLOCKS = 1 bit at most."""
        found: set[int] = set()
        for b, (at, width) in enumerate(BLOCK):
            value = fp >> at & (1 << width) - 1
            for near in (value, *(value ^ 1 << i for i in range(width))):
                found.update(self.index.get((b, near), ()))
        got = np.fromiter(found, np.int64)
        return got[np.bitwise_count(self.prints[got] ^ np.uint64(fp)) <= RADIUS]


BLOCK = [(b * 64 // BLOCKS, (b + 1) * 64 // BLOCKS - b * 64 // BLOCKS) for b in range(BLOCKS)]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared shingles over all shingles, each weighed by how often it occurs."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def scan(text: str | None, items: Items, codes: Codes) -> dict[int, tuple[float, int, int, int]]:
    """Item index to ``(similarity, start, end, bits)`` of its best window in the text."""
    words = tokens(text)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    best: dict[int, tuple[float, int, int, int]] = {}
    for n, known in items.known.items():
        h = shingles(code, n)
        if not len(h):
            continue
        slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hits = np.flatnonzero(known[slot] == h)
        # a window without a shingle of an item has similarity 0 with it: only those around a shared one are hashed
        starts = {(max(0, int(p) - at + d), items.words[k]) for p in hits for k, at in items.posts[n][int(h[p])] for d in range(-SHIFT, SHIFT + 1)}
        for start, length in starts:
            start = max(0, min(start, len(code) - length))
            mine = h[start : start + length - n + 1]
            fp = int(majority(mine)[0])
            near = items.within(fp)
            if not len(near):
                continue
            own = Counter(mine.tolist())
            for k in near.tolist():
                if items.words[k] == length:
                    s = weighted_similarity(own, items.counts[k])
                    if s >= SIMILARITY and (k not in best or (s, -start) > (best[k][0], -best[k][1])):
                        best[k] = (s, start, min(len(code), start + length), int(np.bitwise_count(np.uint64(fp) ^ items.prints[k])))
    return best


#: The index of the pass that this Python process last worked on, so that its tasks build it once.
_held: dict[str, tuple[Items, Codes]] = {}


def index_of(name: str, rows: list[tuple[int, str]]) -> tuple[Items, Codes]:
    if name not in _held:
        codes, items = Codes(), Items()
        for item_id, text in rows:
            items.add(item_id, text, codes)
        _held.clear()
        _held[name] = items.close(), codes
    return _held[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, end_word, bits``: documents that hold a benchmark item.

    A row per document row and item with a window of the item's size whose weighted five-word shingles (all
    words, if the item has fewer) reach similarity 0.8; the best window, the first of equals. Words are compared
    without case and punctuation. An item of one to four words is found wherever its words stand in a row. Items without a word and null ids are left out; repeated item rows count once; null
    or empty texts match nothing; rows that repeat a document are reported as often; empty tables give no rows.

    The benchmark goes to every task in passes of about ``per_pass`` items or ``CHARS`` characters at most, so what is sent is bounded and no item
    is left out; documents are read once per pass and never shuffled.
    """
    spark = docs.sparkSession
    bench = benchmark.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    bench = materialize(bench, "benchmark")
    size = bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size["n"] // per_pass), -(-size["chars"] // CHARS))
    out = None
    for p in range(passes):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])

        def run(batches: Iterator[pd.DataFrame], held=held, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            items, codes = index_of(name, held.value)
            for pdf in batches:
                got = [(d, items.ids[k], *v) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for k, v in sorted(scan(t, items, codes).items())]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "similarity", "start_word", "end_word", "bits"])

        part = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(
            run, "doc_id long, item_id long, similarity double, start_word long, end_word long, bits int"
        )
        out = part if out is None else out.union(part)
    return out


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; null ids stay."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
