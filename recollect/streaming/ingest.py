"""Structured Streaming intake: transcripts from a folder, stored once each however often they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.functions import text

ENVELOPE = "session_id string, project_id string, event string, wire_version string, turns array<struct<role:string,text:string>>"
VERSION = r"^v(?:0|[1-9][0-9]*)\.[0-9]+$"


def valid(envelopes: DataFrame) -> DataFrame:
    """Envelopes with a session, a version of the right form and at least one turn."""
    return envelopes.where(F.col("session_id").isNotNull() & F.col("wire_version").rlike(VERSION) & (F.size("turns") > 0))


def memories(envelopes: DataFrame) -> DataFrame:
    """A memory per distinct turn, normalised, by its hash."""
    turns = valid(envelopes).select("session_id", F.explode("turns").alias("t")).select("session_id", F.col("t.role").alias("role"), text.normalized(F.col("t.text")).alias("text"))
    return turns.where("text <> ''").withColumn("hash", F.sha2("text", 256)).dropDuplicates(["hash"])


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read all new files of the source and append what the target does not have yet; replays add nothing."""

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = memories(batch)
        try:
            new = new.join(session.read.parquet(target).select("hash"), "hash", "left_anti")
        except Exception as missing:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(ENVELOPE).json(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
