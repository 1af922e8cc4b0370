"""The corpus pipeline: stages applied to documents, each to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontam, exact_dedup, mixing, near_dedup, quality_crf
from newsloom.llm._shared import written

STAGES = [
    ("quality", quality_crf.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.pipeline_stage),
    ("decontamination", decontam.stage),
    ("source_mix", mixing.stage),
]

#: The first stage is a trained model, which SQL can't express; tests hold each stage's operator against brute force, and run() against what each stage must drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
