"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mix."""

from __future__ import annotations

from quillrank.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from quillrank.llm.common import materialize

STAGES = [
    ("quality_classifier", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mix_sources", mixing.stage),
]

#: SQL can't express the learned and fingerprint stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
