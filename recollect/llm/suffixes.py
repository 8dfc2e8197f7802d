"""Removal of repeated byte strings by column-wise construction over aligned contexts.

The construction inserts one symbol of every string each round, and updates the order of the collection and
the common prefixes of neighbours. Over whole documents it needs as many rounds as the longest has bytes, each a rewrite of global files,
so here the collection is cut into contexts of bounded length first, which leaves 2 * length - SEED rounds whatever the documents are:

1. Of the SEED-byte strings in every string of `length` bytes the one with the lowest hash is its anchor.
   Equal strings have the same anchor at the same place. The context of an anchor is all bytes of the strings that it is the anchor of.
2. Contexts with the same anchor are aligned by it. Column by column they are put into the order of
   their reversed prefixes, with the start of each one's common part with its neighbour (a positional Burrows-Wheeler transform). A string of
   `length` bytes is repeated when it agrees with a neighbour over all its columns.
3. Equal contexts go in as one; where all contexts of an anchor are equal, all their strings are repeated and no bytes are
   looked at. An anchor with more different contexts than a task holds (HOT) is spread over all tasks by its strings, which
   are counted by 128-bit hashes.

Bytes covered by any repeated string go; overlaps count. Strings never cross texts. Null or empty texts have no bytes. Rows of equal doc_id and text are
two texts like any others. Long texts are taken in blocks. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.batches import groups
from recollect.llm import arrow
from recollect.session import written

SEED = 24
#: Different contexts of one anchor that one task takes; their bytes and orders need 250 MB.
HOT = 262_144
#: Contexts that a task orders at a time.
TOGETHER = 32_768
#: Odd multipliers of the two halves of a string's hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CODES = (arrow.BYTE_CODE, arrow.mix(arrow.BYTE_CODE ^ arrow.U(0xA0761D6478BD642F)))
NONE = 256


def slid(values: np.ndarray, width: int, step: np.ufunc) -> np.ndarray:
    """step (minimum or maximum) over each run of `width` values."""
    n = len(values)
    if n < width:
        return values[:0]
    size = -(-n // width) * width
    padded = np.empty(size, values.dtype)
    padded[:n], padded[n:] = values, values[-1]
    blocks = padded.reshape(-1, width)
    head = step.accumulate(blocks, axis=1).ravel()
    tail = step.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return step(tail[: n - width + 1], head[width - 1 : n])


def anchor_places(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of `length` bytes within the texts, and the first and the last start of the strings of each."""
    n = len(data) - SEED + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, arrow.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = eight[:n] * arrow.U(0x9E3779B97F4A7C15)
    hashes ^= hashes >> arrow.U(29)
    hashes += eight[8 : n + 8] * arrow.U(0xC2B2AE3D27D4EB4F)
    hashes *= arrow.U(0xD6E8FEB86659FD93)
    hashes ^= hashes >> arrow.U(32)
    hashes += eight[16 : n + 16] * arrow.U(0x165667B19E3779F9)
    hashes = arrow.mix(hashes) | arrow.U(1)
    wide = length - SEED + 1
    lowest = slid(hashes, wide, np.minimum)
    good = np.zeros(len(lowest), bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        good[a : max(a, b - length + 1)] = True
    lowest[~good] = 0
    edge = np.zeros(wide - 1, arrow.U)
    reach = slid(np.concatenate((edge, lowest, edge)), wide, np.maximum)
    places = np.flatnonzero(reach == hashes)
    own = hashes[places]
    # The strings of an anchor start in one run of equal lowest hashes: the last run whose first anchor does not lie behind it.
    first = np.flatnonzero(np.concatenate(([True], lowest[1:] != lowest[:-1])))
    last = np.append(first[1:], len(lowest)) - 1
    first, last = first[lowest[first] > 0], last[lowest[first] > 0]
    kinds, kind = np.unique(own, return_inverse=True)
    order = np.lexsort((places, kind))
    sought = np.searchsorted(kinds, lowest[first]) * (n + 1) + first
    leftmost = places[order][np.searchsorted((kind * (n + 1) + places)[order], sought)]
    run = np.searchsorted(leftmost, places, "right") - 1
    return places, own, np.maximum(first[run], places - wide + 1), np.minimum(last[run], places)


class Powers:
    """Powers of an odd number and of its inverse, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, arrow.U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = np.full(n, self.base, arrow.U), np.full(n, self.inverse, arrow.U)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        return self.up[:n], self.down[:n]


def prefix_sums(data: np.ndarray, powers: Powers, code: np.ndarray) -> np.ndarray:
    up, _ = powers.of(len(data) + 1)
    return np.concatenate((np.zeros(1, arrow.U), np.cumsum(code[data] * up[:-1], dtype=arrow.U)))


def keyed(docs: DataFrame) -> DataFrame:
    """The texts with 128 bits, key and twin, that tell the rows apart."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(7), "text", "doc_id").alias("twin"), "doc_id", "text")


def _blocks(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First byte, bytes and offsets of blocks that share no start of a string; texts of a usual size are one block."""
    if len(data) <= 2 * arrow.SLICE_BYTES:
        yield 0, data, at
        return
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        for start in range(a, max(a, b - length + 1), arrow.SLICE_BYTES):
            end = min(b, start + arrow.SLICE_BYTES + length - 1)
            yield start, data[start:end], np.array([0, end - start])


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """key, twin, place, anchor, the bytes before and after (from the anchor on) of its context, and context, a hash of them; one row for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0])
        for batch in batches:
            for part in arrow.slices(batch):
                whole, ends = arrow.text_bytes(part.column("text"))
                for zero, data, at in _blocks(whole, ends, length):
                    places, hashes, first, last = anchor_places(data, at, length)
                    text = np.searchsorted(ends, zero + places, "right") - 1
                    right = last + length
                    sums, (_, down) = prefix_sums(data, powers, CODES[0]), powers.of(len(data) + 1)
                    context = arrow.mix((sums[right] - sums[first]) * down[first] + arrow.mix((places - first).astype(arrow.U) * arrow.U(1024) + (right - places).astype(arrow.U)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(text)), part.column("twin").take(pa.array(text)), pa.array((zero + places - ends[text]).astype(np.int32)), pa.array((places - first).astype(np.int16)), pa.array((right - places).astype(np.int16)), arrow.longs(hashes), arrow.longs(context)],
                        names=["key", "twin", "place", "before", "after", "anchor", "context"],
                    )

    return texts.select("key", "twin", "text").mapInArrow(run, "key long, twin long, place int, before short, after short, anchor long, context long")


def repeated_windows(symbols: np.ndarray, at: np.ndarray, missing: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For contexts (their bytes one after the other with offsets, the columns missing before each, sorted by group) and each start of a string: whether another context of the group has the same string there."""
    count, width = len(missing), 2 * length - SEED
    found = np.zeros((count, width - length + 1), bool)
    order, group = np.arange(count), np.unique(group, return_inverse=True)[1].astype(np.uint32)
    small = np.uint16 if count < 1 << 16 else np.uint32
    group = group.astype(small)
    zero, end = at[:-1] - missing, missing + np.diff(at)
    far = np.int32(width + 1)
    # since[k]: the column from which on the k-th context agrees with the one before it in the order.
    since = np.zeros(count + 1, np.int32)
    since[0] = since[-1] = far
    since[1:-1][group[1:] != group[:-1]] = far
    for t in range(width):
        column = np.full(count, NONE, np.uint16)
        has = (missing <= t) & (t < end)
        column[has] = symbols[zero[has] + t]
        column = column[order]
        # By symbol, then by group, both stable: the order within a group is by the symbols up to this one, the last first.
        moved = np.argsort(column, kind="stable")
        if group[0] != group[-1]:
            moved = moved[np.argsort(group[order[moved]], kind="stable")]
        column, own = column[moved], group[order[moved]]
        old, new = moved[:-1], moved[1:]
        together = own[1:] == own[:-1]
        same = together & (column[1:] == column[:-1])
        fresh = np.full(count + 1, far, np.int32)
        inner = fresh[1:-1]
        inner[~same & together] = t + 1
        next_to = same & (new == old + 1)
        inner[next_to] = since[new[next_to]]
        apart = np.flatnonzero(same & ~next_to)
        if len(apart):
            ends = np.empty(2 * len(apart), np.int64)
            ends[::2], ends[1::2] = old[apart] + 1, new[apart] + 1
            inner[apart] = np.maximum.reduceat(since, ends)[::2]
        order, since = order[moved], fresh
        start = t + 1 - length
        if start >= 0:
            agree = since <= start
            found[order, start] = agree[:-1] | agree[1:]
    return found


def _ranges(found: np.ndarray, before: int, length: int) -> list[list[int]]:
    """For each context the covered bytes as starts and ends in turn, counted from its anchor."""
    padded = np.zeros((len(found), found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    row, edge = np.nonzero(np.diff(padded, axis=1))
    value = edge - before
    value[1::2] += length - 1
    bounds = np.searchsorted(row, np.arange(len(found) + 1))
    return [value[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def contexts(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """anchor, context, n, hot and the bytes of each chosen context (key, twin, anchor, context, n, hot, place, before, after), with the bytes missing before it."""
    wanted = chosen.groupBy("key", "twin").agg(F.collect_list(F.struct("anchor", "context", "n", "hot", "place", "before", "after")).alias("wanted"))
    most = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch):
                data, at = arrow.text_bytes(part.column("text"))
                lists = part.column("wanted")
                text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                rows = lists.flatten()
                place, before, after = (rows.field(c).to_numpy().astype(np.int64) for c in ("place", "before", "after"))
                place = place + at[text]
                bodies = [data[a:b].tobytes() for a, b in zip((place - before).tolist(), (place + after).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in ("anchor", "context", "n", "hot")], pa.array((most - before).astype(np.int32)), pa.array(bodies, pa.binary())], names=["anchor", "context", "n", "hot", "missing", "body"])

    return texts.select("key", "twin", "text").join(wanted, ["key", "twin"]).select("text", "wanted").mapInArrow(run, "anchor long, context long, n long, hot boolean, missing int, body binary")


def ordered(bodies: DataFrame, length: int) -> DataFrame:
    """anchor, context and covered of the contexts that have repeated strings."""
    before, width = length - SEED, 2 * length - SEED

    def flush(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        missing, bodies = table.column("missing").to_numpy().astype(np.int64), table.column("body")
        sizes = pc.binary_length(bodies).to_numpy().astype(np.int64)
        symbols = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[slice(*np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]])] for c in bodies.chunks])
        found = repeated_windows(symbols, np.concatenate(([0], np.cumsum(sizes))), missing, table.column("anchor").to_numpy(), length)
        found |= (table.column("n").to_numpy() > 1)[:, None]
        start = np.arange(width - length + 1)[None, :]
        found &= (start >= missing[:, None]) & (start + length <= (missing + sizes)[:, None])
        ranges = _ranges(found, before, length)
        has = pa.array([bool(r) for r in ranges])
        out = pa.Table.from_arrays([table.column("anchor"), table.column("context"), pa.chunked_array([pa.array(ranges, pa.list_(pa.int32()))])], names=["anchor", "context", "covered"])
        return out.filter(has).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for group in groups(batches, ["anchor"]):
            if held and rows + group.num_rows > TOGETHER:
                yield from flush(held).to_batches()
                held, rows = [], 0
            held.append(group)
            rows += group.num_rows
        if held:
            yield from flush(held).to_batches()

    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, context long, covered array<int>")


def counted(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many contexts: all strings' hashes are counted, over all tasks."""
    before = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [(Powers(base), code) for base, code in zip(BASES, CODES, strict=True)]
        for batch in batches:
            for anchor, context, n, missing, body in zip(*[batch.column(c).to_pylist() for c in ("anchor", "context", "n", "missing", "body")], strict=True):
                data = np.frombuffer(body, np.uint8)
                starts = np.arange(len(data) - length + 1)
                size, strings = len(starts), []
                for powers, code in halves:
                    sums, (_, down) = prefix_sums(data, powers, code), powers.of(len(data) + 1)
                    strings.append(arrow.longs(arrow.mix((sums[starts + length] - sums[starts]) * down[starts])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, anchor)), pa.array(np.full(size, context)), pa.array(np.full(size, n)), pa.array((starts + missing).astype(np.int32)), *strings], names=["anchor", "context", "n", "start", "string", "twin"])

    strings = bodies.mapInArrow(run, "anchor long, context long, n long, start int, string long, twin long")
    often = written(strings.groupBy("anchor", "start", "string", "twin").agg(F.sum("n").alias("all")).where(F.col("all") > 1).drop("all"))
    found = strings.join(often, ["anchor", "start", "string", "twin"])
    pairs = F.flatten(F.transform(F.col("starts"), lambda s: F.array(s - before, s - before + length)))
    return found.groupBy("anchor", "context").agg(F.array_sort(F.collect_set("start")).alias("starts")).select("anchor", "context", pairs.alias("covered"))


def clean(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (starts and ends in turn) and kept, the bytes that stay."""
    texts = keyed(docs)
    rows = anchors(texts, length)
    # What a join looks up is a table of its own, so that Spark can split the keys of many rows.
    often = written(rows.groupBy("anchor").agg(F.count("*").alias("of_anchor")).where("of_anchor > 1").select("anchor"))
    rows = written(rows.join(often, "anchor"))
    distinct = rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "twin", "place", "before", "after")).alias("first"))
    distinct = written(distinct.select("anchor", "context", "n", "first.*"))
    several = written(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor", (F.col("contexts") > HOT).alias("hot")))
    bodies = contexts(texts, distinct.join(several, "anchor"), length)
    covered = ordered(bodies.where("not hot"), length)
    if not several.where("hot").isEmpty():
        covered = covered.union(counted(written(bodies.where("hot").drop("hot")), length))
    alone = distinct.join(several, "anchor", "left_anti").select("anchor", "context", F.array((-F.col("before")).cast("int"), F.col("after").cast("int")).alias("covered"))
    covered = written(covered.union(alone))
    spans = written(rows.join(covered, ["anchor", "context"]).groupBy("key", "twin").agg(F.collect_list(F.struct("place", "covered")).alias("spans")))
    joined = texts.join(spans, ["key", "twin"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch):
                data, at = arrow.text_bytes(part.column("text"))
                sizes, removed, kept = np.diff(at), [], []
                lists = part.column("spans")
                for i in range(part.num_rows):
                    own = data[at[i] : at[i + 1]].data
                    edges = _merged(lists[i].values) if lists[i].is_valid else np.zeros(0, np.int64)
                    rest = [0, *edges.tolist(), len(own)]
                    removed.append(edges)
                    kept.append(b"".join([own[a:b] for a, b in zip(rest[::2], rest[1::2], strict=True)]))
                gone = np.array([int((e[1::2] - e[::2]).sum()) for e in removed], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(gone), pa.array(np.array([len(e) // 2 for e in removed], np.int64)), pa.array([e.tolist() for e in removed], pa.list_(pa.int32())), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"],
                )

    return joined.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, removed array<int>, kept binary").fields]))


def _merged(spans: pa.StructArray) -> np.ndarray:
    """Starts and ends in turn of the union of the spans."""
    lists = spans.field("covered")
    counts = np.diff(lists.offsets.to_numpy())
    edges = lists.flatten().to_numpy() + np.repeat(spans.field("place").to_numpy(), counts)
    start, end = edges[::2], edges[1::2]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return np.stack((start[first], end[last]), axis=1).ravel().astype(np.int64)


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    return clean(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
