"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows of equal text are one atomic group; a null text counts as the empty one. Groups are ordered by a hash
of the text. The smallest capacity with which greedy filling needs no more than the wanted shards is found
by binary search, and the cuts are made under that capacity where the shards come out most even.

The rows stay on the executors. The driver sees at most `points` prefix sums at a time: the last one in
each of so many ranges of bytes. They bound the capacity from both sides, and only the ranges that can
hold a cut are looked into more closely, until both bounds meet.

An empty table has no rows. Repeated rows are one group like any equal texts. Fewer groups than shards
leave shards empty. Extra columns are dropped by shards() and kept nowhere else.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.session import cut

#: Prefix sums that the driver holds at once.
POINTS = 20_000
#: Bytes that a row takes beside its text.
ROW_BYTES = 8


class Prefixes:
    """Some of the prefix sums at group ends, in order; `hidden[i]` says that others lie before the i-th and after the one before."""

    def __init__(self, ends: list[int], hidden: list[bool]):
        self.ends, self.hidden = ends, hidden

    def surely(self, x: int) -> int:
        """A group end at or below x."""
        i = bisect_right(self.ends, x)
        return self.ends[i - 1] if i else 0

    def perhaps(self, x: int) -> int:
        """No group end at or below x is higher."""
        i = bisect_right(self.ends, x)
        return x if i < len(self.ends) and self.hidden[i] else self.surely(x)

    def refined(self, other: Prefixes) -> Prefixes:
        have = dict(zip(self.ends, self.hidden, strict=True)) | dict(zip(other.ends, other.hidden, strict=True))
        ends = sorted(have)
        return Prefixes(ends, [have[e] for e in ends])


def greedy(floor: Callable[[int], int], capacity: int, shards: int, total: int) -> list[int]:
    """Where greedy filling cuts; the last cut is the total if the shards suffice."""
    cuts = [0]
    for _ in range(shards):
        cuts.append(min(total, floor(cuts[-1] + capacity)))
    return cuts[1:]


def smallest_capacity(floor: Callable[[int], int], shards: int, total: int, least: int) -> int:
    low, high = least, max(least, total)
    while low < high:
        middle = (low + high) // 2
        if greedy(floor, middle, shards, total)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts at group ends, no part above the capacity, each as near as can be to an even share of what is left."""
    total = ends[-1]
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(0 if earliest[-1] <= capacity else ends[bisect_left(ends, earliest[-1] - capacity)])
    earliest = earliest[::-1]
    cuts, known = [0], [0, *ends]
    for s in range(shards - 1):
        low, high = max(cuts[-1], earliest[s]), cuts[-1] + capacity
        aim = cuts[-1] + (total - cuts[-1]) / (shards - s)
        around = bisect_left(known, aim)
        near = [known[i] for i in (around - 1, around, bisect_left(known, low), bisect_right(known, high) - 1) if 0 <= i < len(known) and low <= known[i] <= high]
        cuts.append(min(near, key=lambda x: (abs(x - aim), x)))
    return cuts[1:]


def _points(groups: DataFrame, windows: list[tuple[int, int]], width: int) -> Prefixes:
    """The last group end in each range of `width` bytes of the windows."""
    inside = reduce(lambda x, y: x | y, [F.col("end").between(a, b) for a, b in windows])
    rows = groups.where(inside).groupBy(F.floor(F.col("end") / width).alias("range")).agg(F.max("end").alias("end"), F.count("*").alias("n")).orderBy("end").collect()
    return Prefixes([r["end"] for r in rows], [r["n"] > 1 for r in rows])


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_cuts(groups: DataFrame, shards: int, points: int = POINTS) -> tuple[int, list[int]]:
    """The smallest capacity and the cuts, from a table of group ends (end: bytes up to it, bytes: its own)."""
    top = groups.agg(F.max("end").alias("total"), F.max("bytes").alias("most")).first()
    if top is None or top["total"] is None:
        return 0, []
    total = top["total"]
    least = max(top["most"], -(-total // shards))
    width = -(-total // points)
    known = _points(groups, [(1, total)], width)
    while True:
        high = smallest_capacity(known.surely, shards, total, least)
        low = smallest_capacity(known.perhaps, shards, total, least)
        if low == high:
            return high, even_cuts(known.ends, high, shards)
        spans = [(a, b) for a, b in zip(greedy(known.surely, low, shards, total), greedy(known.perhaps, high, shards, total), strict=True)]
        windows = _merged([(known.surely(a) + 1, known.ends[min(bisect_left(known.ends, b), len(known.ends) - 1)]) for a, b in spans])
        width = max(1, min(width // 2, -(-sum(b - a + 1 for a, b in windows) // points)))
        known = known.refined(_points(groups, windows, width))


def ordered(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows in the order of their groups, with the number of rows before (row) and the bytes up to and with each (upto)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.md5(whole).alias("group"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, "group", "doc_id").sortWithinPartitions("group", "doc_id"))
    totals = {r["part"]: (r["n"], r["bytes"]) for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    before, n, size = {}, 0, 0
    for part in sorted(totals):
        before[part] = (n, size)
        n, size = n + totals[part][0], size + totals[part][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            upto = size + np.cumsum(batch.column("size").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n + np.arange(batch.num_rows)), pa.array(upto)], names=[*batch.schema.names, "row", "upto"])
            n, size = n + batch.num_rows, int(upto[-1]) if batch.num_rows else size

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("row", T.LongType(), False), T.StructField("upto", T.LongType(), False)]))


def shards(docs: DataFrame, count: int, text: str = "text", points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; no shard has more bytes than the smallest feasible capacity."""
    rows = ordered(docs, text)
    groups = cut(rows.groupBy("group").agg(F.max("upto").alias("end"), (F.max("row") + 1).alias("rows"), F.sum("size").alias("bytes")).drop("group"))
    _, cuts = find_cuts(groups, count, points)
    starts = {r["end"]: r["rows"] for r in groups.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    shard: Column = reduce(lambda x, c: x + (F.col("upto") > c).cast("int"), cuts, F.lit(0))
    first = F.get(F.array(*[F.lit(starts.get(c, 0)).cast("long") for c in [0, *cuts]]), F.col("shard"))
    return rows.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("row") - first).alias("slot"))


def digests(docs: DataFrame, count: int = 24) -> DataFrame:
    return shards(docs.select("doc_id", "text"), count).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
