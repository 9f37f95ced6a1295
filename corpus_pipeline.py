"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import chosen_path, language_id, packing, secrets, suffix_dedup
from lodestar.llm.common import dropped, held, prepare, stored

STAGES = [
    ("language id", language_id.language_stage),
    ("near dedup", chosen_path.near_stage),
    ("suffix dedup", suffix_dedup.dedup_stage),
    ("secret scan", secrets.redact_stage),
    ("packing", packing.pack_stage),
]

#: SQL can't express language prediction or tokenizing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again as the next one's input.

    What a stage stored for itself, and its input, are deleted once its rows are written.
    """
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), len(held(spark))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        dropped(spark, before, -1)
    return STAGES[-1][1](spark, docs, sf_dir)
