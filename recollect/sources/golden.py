"""Golden sets: JSON documents with memories ("atoms") and with graded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text

ATOMS = "atoms array<struct<id: string, type: string, text: string, importance: double, confidence: double, scope: string, valid_to: string, provenance: struct<repo: string, project: string>>>"
QUERIES = "queries array<struct<id: string, text: string, mode: string, filters: struct<type: array<string>, as_of: string>, graded_relevant: array<struct<atom_id: string, grade: int>>>>"


def corpus(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """The memories, as if made at now_ms, with deterministic vectors."""
    atoms = spark.read.option("multiLine", True).schema(ATOMS).json(path).select(F.explode("atoms").alias("a"))
    gone = F.unix_millis(F.to_timestamp("a.valid_to"))
    return atoms.select("a.id", "a.type", "a.text", "a.importance", "a.confidence", "a.scope", "a.provenance.repo", "a.provenance.project", F.lit(now_ms).alias("created_at"), gone.alias("valid_to"), text.fake_vector(F.col("a.text")).alias("embedding"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """query, body, mode, types, as_of, graded and point, the deterministic vector of the body."""
    rows = spark.read.option("multiLine", True).schema(QUERIES).json(path).select(F.explode("queries").alias("q"))
    return rows.select(F.col("q.id").alias("query"), F.col("q.text").alias("body"), "q.mode", F.col("q.filters.type").alias("types"), "q.filters.as_of", F.col("q.graded_relevant").alias("graded"), text.fake_vector(F.col("q.text")).alias("point"))
