"""Sending the log of memories: envelopes of events, what the receiver acknowledged of each, and a cursor that does not pass what is missing.

A round takes the events that may be sent and are not acknowledged, cuts them by seq into envelopes, and posts these from the tasks.
The receiver answers with the last seq that it took; of an envelope the events up to there are acknowledged, the others go into the next
round, cut anew. An envelope that fails keeps no other one back. The receipts of a round, with the acknowledged numbers, are one
write into the store, which is all the state there is: a round that ends before it is as if it had not been, but that the receiver
may see its events again, as it also may when a task is lost after it posted; device and seq tell it so.

The cursor is the last acknowledged event before the first one that waits, 0 without one. Events that may be sent are those whose memory has team or org scope now,
and erasures that say such a scope. Events without a seq are passed over; seq names one event."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators.memory import payload
from recollect.session import cut, numbered

#: Events in an envelope, and the longest wait.
SIZE, CAP_MS = 200, 900_000
SHARED = ("team", "org")
RECEIPT = "round int, batch long, first_seq long, last_seq long, cursor long, events int, acked array<long>, error string"
EVENT = ["seq", "event_type", "atom_id", "payload_json", "content_hash", "created_at"]
#: Takes an envelope as JSON and gives the last seq that was taken; raises where sending fails.
Post = Callable[[str], int | None]


@dataclass(frozen=True)
class Sender:
    """Who sends, and the name of the protocol that the receiver expects."""

    protocol: str
    device: str
    workspace: str


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """The envelopes sent so far; none where nothing was sent."""
    schema = T._parse_datatype_string(RECEIPT)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/receipts")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/receipts") if there else spark.createDataFrame([], schema)


def waiting(events: DataFrame, memories: DataFrame, sent: DataFrame) -> DataFrame:
    """The events that may be sent and are not acknowledged, by their own column or by the receipts."""
    rows = events.where("synced_at is null and seq is not null").join(memories.select(F.col("id").alias("atom_id"), "scope"), "atom_id", "left")
    rows = rows.where(F.col("scope").isin(*SHARED) | ((F.col("event_type") == "erase_request") & payload("scope").isin(*SHARED)))
    return rows.join(sent.select(F.explode("acked").alias("seq")), "seq", "left_anti").select(*EVENT)


def marked(events: DataFrame, sent: DataFrame, at_ms: int) -> DataFrame:
    """The log with synced_at of what the receipts acknowledge."""
    done = sent.select(F.explode("acked").alias("seq"), F.lit(at_ms).alias("at"))
    return events.join(done, "seq", "left").withColumn("synced_at", F.coalesce("synced_at", "at")).drop("at")


def posted(envelopes: DataFrame, post: Post, round_: int, cursor: int) -> DataFrame:
    """The receipts of envelopes (batch, seqs, body), each posted once by its task."""

    def send(body: str, seqs: list[int]) -> tuple[list[int], str | None]:
        try:
            upto = post(body)
        except Exception as failure:  # noqa: BLE001  whatever a receiver's client raises is this envelope's failure
            return [], str(failure) or type(failure).__name__
        if upto is None or upto < 0:
            return [], "response missing acked_seq"
        return [n for n in seqs if n <= upto], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                acked, error = send(row["body"], row["seqs"])
                rows.append({"round": round_, "batch": row["batch"], "first_seq": row["seqs"][0], "last_seq": row["seqs"][-1], "cursor": cursor, "events": len(row["seqs"]), "acked": acked, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("round", pa.int32()), ("batch", pa.int64()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("cursor", pa.int64()), ("events", pa.int32()), ("acked", pa.list_(pa.int64())), ("error", pa.string())])
    return envelopes.mapInArrow(run, RECEIPT)


def ship_once(events: DataFrame, memories: DataFrame, folder: str, post: Post, sender: Sender, size: int = SIZE) -> dict[str, int]:
    """One round. How many envelopes there were and how many of them failed, and the numbers of events shipped and acked."""
    spark = events.sparkSession
    sent = receipts(spark, folder)
    left = cut(waiting(events, memories, sent))
    first, round_ = left.agg(F.min("seq")).first()[0], sent.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0] + 1
    if first is None:
        return {"envelopes": 0, "failed": 0, "shipped": 0, "acked": 0}
    done = events.where("synced_at is not null").select("seq").union(sent.select(F.explode("acked")))
    cursor = done.where(F.col("seq") < first).agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long")).first()[0]
    rows = numbered(left, ["seq"], "number", 0).withColumn("batch", F.floor(F.col("number") / size))
    # A payload that is no JSON goes as null.
    event = F.struct("seq", "event_type", "atom_id", F.try_parse_json("payload_json").alias("payload_json"), "content_hash", "created_at")
    item = F.struct("seq", F.to_json(event, {"ignoreNullFields": "false"}).alias("said"))
    grouped = rows.groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    head = json.dumps({"protocol": sender.protocol, "device_id": sender.device, "workspace_id": sender.workspace, "cursor": cursor})[:-1]
    body = F.concat(F.lit(f'{head}, "events": ['), F.array_join("items.said", ", "), F.lit("]}"))
    posted(grouped.select("batch", F.col("items.seq").alias("seqs"), body.alias("body")), post, round_, cursor).write.mode("append").parquet(f"{folder}/receipts")
    now = receipts(spark, folder).where(F.col("round") == round_)
    out = now.agg(F.count("*"), F.count("error"), F.sum("events"), F.sum(F.size("acked"))).first()
    return dict(zip(("envelopes", "failed", "shipped", "acked"), out))


def ship(events: DataFrame, memories: DataFrame, folder: str, post: Post, sender: Sender, rounds: int, interval_ms: int = 30_000, wait: Callable[[float], None] = time.sleep) -> list[dict[str, int]]:
    """Rounds until nothing waits, `rounds` at most; after one with failures the next waits longer by each such round in a row, and not at all after the others."""
    told, failures = [], 0
    for _ in range(rounds):
        told.append(ship_once(events, memories, folder, post, sender))
        if not told[-1]["envelopes"]:
            break
        failures = failures + 1 if told[-1]["failed"] else 0
        if failures:
            wait(min(interval_ms * 2**failures, CAP_MS) / 1000)
    return told
