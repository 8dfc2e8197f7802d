"""The corpus pipeline: each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import stages

#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = stages.STAGES
#: Trees, SimHash windows and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
