"""States of queue jobs from the log of their events.

An event maps every state to the next one, and maps compose: the events of a job may lie in many tasks, each of which composes
its own run to one map, and the maps of the runs are composed in order. An event that does not apply to the job's state is ignored and
counted. A state is its name and the attempts so far, which stop at MOST, so a map has few entries.

enqueue makes a job that is not there pending; claim takes a pending one; complete ends a running one; an error of a running one
pauses it (budget), poisons it (deterministic, or the attempts are used up) or leaves it failed, each but budget as one more attempt;
requeue makes a failed one and resume a paused one pending again. Events are in order by seq, which names one; other kinds, also null, are ignored. Events without a job are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions import scoring

STATES = ("absent", "pending", "running", "completed", "failed", "poison", "paused")
#: Attempts after which a job is poison.
MOST = 3
KINDS = ("enqueue", "claim", "complete", "transient", "deterministic", "budget", "requeue", "resume")
RUNS = "maps array<int>, ignored array<long>, errors array<long>, n long"


def _code(state: str, attempts: int) -> int:
    return STATES.index(state) * (MOST + 1) + attempts


def _next(kind: str, state: str, attempts: int) -> tuple[str, int]:
    """What an event makes of a state; the state itself where it does not apply."""
    moves = {("enqueue", "absent"): "pending", ("claim", "pending"): "running", ("complete", "running"): "completed", ("budget", "running"): "paused", ("requeue", "failed"): "pending", ("resume", "paused"): "pending"}
    if state == "running" and kind in ("transient", "deterministic"):
        more = min(attempts + 1, MOST)
        return ("poison" if kind == "deterministic" or more >= MOST else "failed"), more
    return moves.get((kind, state), state), attempts


SIZE = len(STATES) * (MOST + 1)
#: By kind, and one row for other kinds: the next state of each.
TABLE = np.array([[_code(*_next(kind, s, a)) for s in STATES for a in range(MOST + 1)] for kind in (*KINDS, "")], np.int32)
#: Whether the kind is an error where it applies.
FAULT = np.array([kind in ("transient", "deterministic", "budget") for kind in (*KINDS, "")])


def kind_of(action: Column, message: Column) -> Column:
    """The kind of an action; errors by their message, a spent budget before the others."""
    return F.when(action != "error", action).otherwise(F.when(F.lower(message).contains("budget"), "budget").otherwise(scoring.classify_error(message)))


def composed(kinds: np.ndarray, starts: np.ndarray, seqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of events: where it leads from every state, how many events it ignores, and the seq of its last error; the n-th events of all runs at a time."""
    edges = np.append(starts, len(kinds))
    lengths = np.diff(edges)
    maps = np.tile(np.arange(SIZE, dtype=np.int32), (len(starts), 1))
    ignored, errors = np.zeros((len(starts), SIZE), np.int64), np.full((len(starts), SIZE), -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), "right")
    for i, n in enumerate(live):
        runs = order[:n]
        at = starts[runs] + i
        before = maps[runs]
        after = TABLE[kinds[at][:, None], before]
        maps[runs] = after
        same = after == before
        ignored[runs] += same
        errors[runs] = np.where(~same & FAULT[kinds[at]][:, None], seqs[at][:, None], errors[runs])
    return maps, ignored, errors


def folded(events: DataFrame) -> DataFrame:
    """job, state, attempts, events, ignored and error_seq (the last error that applied; null without one) from events (job, seq, kind)."""
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    rows = events.where("job is not null").select("job", F.col("seq").cast("long").alias("seq"), number.alias("kind"))
    order = ["job", "seq"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(batches):
            if batch.num_rows:
                jobs = batch.column("job").to_numpy(zero_copy_only=False)
                starts = np.append(0, np.flatnonzero(jobs[1:] != jobs[:-1]) + 1)
                kinds = batch.column("kind").to_numpy()
                maps, ignored, errors = composed(kinds, starts, batch.column("seq").to_numpy())
                lists = [pa.array(x.tolist(), pa.list_(kind)) for x, kind in ((maps, pa.int32()), (ignored, pa.int64()), (errors, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("job").take(pa.array(starts)), pa.array(np.full(len(starts), place + n)), *lists, pa.array(np.diff(np.append(starts, len(jobs))))], names=["job", "place", "maps", "ignored", "errors", "n"])

    schema = T.StructType([rows.schema["job"], T.StructField("place", T.LongType()), *T._parse_datatype_string(RUNS).fields])
    # One row for each run of a job in a batch.
    runs = rows.mapInArrow(run, schema).groupBy("job").agg(F.sort_array(F.collect_list(F.struct("place", "maps", "ignored", "errors"))).alias("runs"), F.sum("n").alias("events"))
    first = F.struct(F.lit(_code("absent", 0)).alias("code"), F.lit(0).cast("long").alias("ignored"), F.lit(-1).cast("long").alias("error"))

    def step(held: Column, x: Column) -> Column:
        error = F.get(x["errors"], held["code"])
        return F.struct(F.get(x["maps"], held["code"]).alias("code"), (held["ignored"] + F.get(x["ignored"], held["code"])).alias("ignored"), F.when(error >= 0, error).otherwise(held["error"]).alias("error"))

    out = runs.withColumn("last", F.aggregate("runs", first, step))
    state = F.get(F.array(*[F.lit(s) for s in STATES]), F.floor(F.col("last.code") / (MOST + 1)).cast("int"))
    return out.select("job", state.alias("state"), (F.col("last.code") % (MOST + 1)).alias("attempts"), "events", F.col("last.ignored").alias("ignored"), F.when(F.col("last.error") >= 0, F.col("last.error")).alias("error_seq"))
