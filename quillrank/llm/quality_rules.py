"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, table

#: Labelled rows that the rules are fitted on, at most: those of least hash of the id.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY, STEPS = 0.0005, 1500


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with statistics of ``text`` as columns, and their names.

    Each is a finite double for any text, null and empty included. The words and what is neither letter nor white space are
    taken out once; most counts run over that short rest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = docs.withColumns(
        {
            "_p_words": F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1),
            "_p_rest": F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""),
            "_p_lines": F.split(text, "\n", -1),
        }
    )
    chars, rest = F.length(text), F.col("_p_rest")
    words = F.when(F.get("_p_words", F.lit(0)) == "", 0.0).otherwise(F.size("_p_words").cast("double"))
    in_words = F.length(F.array_join("_p_words", ""))
    count = lambda drawn: F.regexp_count(rest, F.lit(drawn)).cast("double")
    per_char = lambda c: c / F.greatest(chars, F.lit(1))
    per_word = lambda c: c / F.greatest(words, F.lit(1.0))
    stats = {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(words),
        "word_length": per_word(in_words),
        "symbols": per_word(count(r"[#*$%&@~^_=+<>{}\[\]\\/]")),
        "bars": per_word(count(r"\|")),
        "bangs": per_word(count("[!?]")),
        "stops": per_word(count("[.,;:]")),
        "digits": per_char(count("[0-9]")),
        "letters": per_char(in_words - F.length(rest)),
        "capitals": per_char(F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double")),
        "distinct_words": per_word(F.size(F.array_distinct("_p_words")).cast("double")),
        "distinct_lines": F.size(F.array_distinct("_p_lines")) / F.size("_p_lines").cast("double"),
        "line_words": words / F.size("_p_lines"),
    }
    out = inner.withColumns({f"_s_{n}": c.cast("double") for n, c in stats.items()}).drop("_p_words", "_p_rest", "_p_lines")
    return out, [f"_s_{n}" for n in stats]


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, is_greater, threshold)`` and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def fires(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(x[:, f] > t) == up for f, up, t in self.terms])


def grow(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int):
    """One boosted regression tree; returns its leaves' fit and the conjunction of each node's path."""
    fit, paths = np.zeros(len(x)), []

    def node(rows: np.ndarray, path: tuple, left: int) -> None:
        g, h = grad[rows], hess[rows]
        best = None
        if left and len(rows) >= 20:
            for f, cuts in enumerate(bins):
                at = np.searchsorted(cuts, x[rows, f], side="left")
                gs, hs = (np.bincount(at, v, len(cuts) + 1).cumsum()[:-1] for v in (g, h))
                if not len(cuts):
                    continue
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1)
                k = int(gain.argmax())
                if (best is None or gain[k] > best[0]) and 0 < (at <= k).sum() < len(rows):
                    best = (gain[k], f, cuts[k])
        if best is None or best[0] <= g.sum() ** 2 / (h.sum() + 1) + 1e-6:
            fit[rows] = g.sum() / (h.sum() + 1)
            return
        _, f, cut = best
        up = x[rows, f] > cut
        for side, mine in ((False, rows[~up]), (True, rows[up])):
            paths.append((*path, (f, side, float(cut))))
            node(mine, paths[-1], left - 1)

    node(np.arange(len(x)), (), depth)
    return fit, paths


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights under an L1 penalty and the free intercept, by accelerated proximal gradient steps."""
    n, p = z.shape
    ones = np.hstack([z, np.ones((n, 1))])
    step = 4 * n / max(np.linalg.norm(ones, 2) ** 2, 1e-9)
    w = v = np.zeros(p + 1)
    for k in range(steps):
        slope = ones.T @ (1 / (1 + np.exp(-np.clip(ones @ v, -30, 30))) - y) / n
        new = v - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[Rule], float]:
    """Rules with nonzero weight and the intercept; with no row or one class, no rule and the class's rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return [], base
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    score, paths = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        fit, found = grow(x, bins, y - p, p * (1 - p), DEPTH)
        score += RATE * fit
        paths |= dict.fromkeys(found)
    rules = [Rule(p) for p in paths]
    fired = np.column_stack([r.fires(x) for r in rules]).astype(float)
    _, first = np.unique(fired, axis=1, return_index=True)  # rules that fire alike are one rule
    first = np.sort(first)
    w, b = lasso_logistic(fired[:, first], y)
    return [Rule(rules[i].terms, float(v)) for i, v in zip(first, w, strict=True) if abs(v) > 1e-6], b


def compile_score(rules: list[Rule], intercept: float, names: list[str]) -> Column:
    """The ensemble as one column over the statistics' columns."""
    total = F.lit(intercept)
    for r in rules:
        terms = [F.col(names[f]) > F.lit(t) if up else F.col(names[f]) <= F.lit(t) for f, up, t in r.terms]
        total = total + F.when(reduce(lambda a, b: a & b, terms), F.lit(r.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Rule], float]:
    """Fit on at most ``sample`` labelled rows that aren't held out.

    Labels repeated for an id count once, the least; null labels and ids are left out. The sample is the only thing that
    comes to the driver: its statistics, one row per label.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    drawn, names = with_statistics(docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text"))
    once = drawn.groupBy("_id").agg(F.min(F.struct("_y", *names)).alias("r")).select("_id", "r.*")
    rows = once.toPandas().sort_values("_id")
    return fit_rules(rows.drop(columns=["_id", "_y"]).to_numpy(float), (rows["_y"] == 1).to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (at least ``doc_id, text``) with ``_score``, the estimated chance of label 1.

    Scores depend on the text alone. Null text scores as empty text. Repeated rows score alike; an
    empty table gives an empty result; without usable labels all scores are 0.5.
    """
    rules, intercept = learn(docs.select("doc_id", "text"), labels, sample)
    wide, names = with_statistics(docs)
    return wide.withColumn("_score", compile_score(rules, intercept, names)).drop(*names)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under 0.5 go.

    A generator of no or one element does the filtering: a predicate on the score would be pushed below the
    statistics, each of which would then be computed anew in every term of every rule.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    keep = F.when(F.col("_score") >= 0.5, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return scored.withColumn("_keep", F.explode(keep)).select(*docs.columns)
