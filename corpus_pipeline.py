"""The corpus pipeline: documents -> quality rules -> line dedup -> near-dedup -> decontamination -> mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.decontaminate import stage_decontaminate
from corpusforge.llm.line_dedup import stage_line_dedup
from corpusforge.llm.mixing import stage_mix
from corpusforge.llm.quality_rules import stage_quality
from corpusforge.llm.near_text import stage_near_dedup
from corpusforge.session import materialize

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality stage's sketches are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
