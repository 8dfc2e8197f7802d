"""Transcripts posted as single JSON objects, the older form of intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTED = "session_id string, source string, content string, repo string, project string, branch string, agent string"


def rows(posted: DataFrame) -> DataFrame:
    """The fields of posted objects (line), every one a transcript; those without session, source or content are passed over."""
    read = posted.select(F.from_json("line", POSTED).alias("p")).select("p.*")
    return read.where(" and ".join(f"coalesce({c}, '') <> ''" for c in ("session_id", "source", "content")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """rows() of the objects in files, one in a line."""
    return rows(spark.read.text(path).withColumnRenamed("value", "line"))
