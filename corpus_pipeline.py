"""The corpus pipeline: stages that each take and return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stages.run(spark, sf_dir, docs)
