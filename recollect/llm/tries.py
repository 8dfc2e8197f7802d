"""Prefix trie of conversations: a Cartesian tree over the common prefixes of sorted conversations.

1. Each conversation becomes the string of its turns' 128-bit codes. Equal strings are one sequence; sequences are sorted
   over ranges, the partitions of which are the blocks from here on.
2. A[s] is the number of turns that sequence s shares with the one before it (-1 at both ends). A node where sequences part
   is an interval of sequences between the nearest smaller values on both sides of an A. Each task finds the intervals
   within its block by one pass with a stack; equal values of an interval are one node.
3. An interval that crosses a border between blocks is a beginning of the first sequence behind the border. The minima of
   the blocks name the block of its nearest smaller value on each side, and that block's own chain of minima the place.
   Sums and minima of the interval are those of the two parts and of the whole blocks between them.
4. Depths between a node and its parent are nodes with the same conversations; they are expanded from the words' running sums.

What the driver sees is bounded by the number of partitions: sizes, minima and sums of blocks.

Rows without conv_id are left out. Turns are sorted by turn, null first; turns with equal numbers by their code, and repeated rows
are turns of their own. A null role or text is empty. Long texts count by their code and number of words only; a conversation of
n turns is one row of 24 n bytes. An empty table gives no nodes. Other columns are passed over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import cut, written

#: Bytes of a turn's code; turns of one piece of a conversation; bits of the ids that share a piece of the list of a sequence's conversations; rows of a batch.
CODE, PIECE, IDS, ROWS = 16, 4096, 12, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max

PARTS = (
    "kind int, block long, depth long, above long, place long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "shared_words long, own_words long, skipped long, turns long, ends_sha256 string, words array<long>, ref_border long, ref_depth long"
)
#: Kinds of rows of PARTS: nodes of a block; nodes that cross a border; the chain of minima from the end of a block and from its start; the words of a block's first sequence; a whole block.
NODE, CROSSING, SUFFIX, PREFIX, BORDER, BLOCK = range(6)
TYPES = {"ends_sha256": pa.string(), "words": pa.list_(pa.int64()), "kind": pa.int32()}
NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _batch(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = []
    for name in NAMES:
        of = TYPES.get(name, pa.int64())
        arrays.append(pa.array(np.full(n, kind, np.int32)) if name == "kind" else pa.nulls(n, of) if name not in columns else pa.array(columns[name], of) if not isinstance(columns[name], pa.Array) else columns[name])
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, codes, words): the conversations in runs of turns, at being the number of a run's first one. A conversation may go on over many tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "code"]
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "code", "words"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, run = 0, None, None, 0
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                first = ids[0] if first is None else first
                own = batch.num_rows - int(np.searchsorted(ids, ids[-1]))
                run = run + own if own == batch.num_rows and last == ids[-1] else own
                last, n = ids[-1], n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "first": [first], "last": [last], "run": [run]})

    before, last, run = {}, None, 0
    for r in sorted(rows.mapInArrow(ends, "part long, n long, first long, last long, run long").collect()):
        before[r["part"]] = run if r["first"] == last else 0
        run, last = r["run"] + (before[r["part"]] if r["run"] == r["n"] else 0), r["last"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, codes, words = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(ids)) + 1)
            cuts = np.unique(np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, np.append(starts[1:], len(ids)), strict=True)]))
            at = at if last is None or last == ids[0] else 0
            places, here = np.empty(len(cuts), np.int64), np.searchsorted(starts, cuts, "right") - 1
            places[:] = cuts - starts[here] + 1
            places[here == 0] += at
            at, last = (at if len(starts) == 1 else 0) + len(ids) - starts[-1], ids[-1]
            edges = np.append(cuts, len(ids))
            flat = b"".join(codes.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[cuts]), pa.array(places), pa.array([flat[CODE * s : CODE * e] for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(words))], names=["conv_id", "at", "codes", "words"]
            )

    return rows.mapInArrow(joined, "conv_id long, at long, codes binary, words array<long>")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, codes, words): one row for each conversation."""
    found = pieces(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "codes", "words"))).alias("p"))
    whole = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["codes"])), ""))
    return found.select("conv_id", F.when(F.size("p") == 1, F.col("p")[0]["codes"]).otherwise(whole).alias("codes"), F.flatten("p.words").alias("words"))


def forked(whole: DataFrame, every: int, most: int) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % every in place of its own; h = crc32(c) % most."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = whole.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.substring("codes", 1, CODE * (most - 1)).alias("head_codes"), F.slice("words", 1, most - 1).alias("head_words"))
    rows = whole.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", shared.cast("int")).join(heads, "head", "left")
    none = F.array().cast("array<long>")
    codes = F.concat(F.substring(F.coalesce("head_codes", F.unhex(F.lit(""))), F.lit(1), CODE * F.col("h")), F.substring(F.col("codes"), CODE * F.col("h") + 1, F.octet_length("codes")))
    words = F.concat(F.slice(F.coalesce("head_words", none), F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1))))
    return rows.select("conv_id", codes.alias("codes"), words.alias("words"))


def _distinct(whole: DataFrame) -> DataFrame:
    """(conv_id, n, ends_sha256, codes, words): each sequence once, with its smallest conversation, their number, and the hash of their ids.

    The ids of a sequence are joined in pieces; one task hashes the pieces of a sequence one by one, as SHA-256 has no other way."""
    key = F.unhex(F.md5("codes"))
    lists = whole.groupBy(key.alias("key"), F.shiftright("conv_id", IDS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = lists.select("key", "piece", F.col("ids")[0].alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["conv_id", "n", "ends_sha256"])

        for b in batches:
            for key, conv, n, ids in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "n", "ids")), strict=True):
                if key != last:
                    if state is not None:
                        out.append((state[0], state[1], state[2].hexdigest()))
                    last, state = key, [conv, 0, hashlib.sha256()]
                else:
                    state[2].update(b",")
                state[1] += n
                state[2].update(ids.encode())
            if len(out) >= ROWS:
                yield batch()
                out = []
        if state is not None:
            out.append((state[0], state[1], state[2].hexdigest()))
            yield batch()

    found = lists.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(hashed, "conv_id long, n long, ends_sha256 string")
    return found.join(whole, "conv_id")


def _common(a: bytes, b: bytes) -> int:
    """Codes that both begin with."""
    low, high = 0, min(len(a), len(b)) // CODE
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[CODE * low : CODE * middle] == b[CODE * low : CODE * middle] else (low, middle - 1)
    return low


def _borders(rows: DataFrame) -> list[tuple[int, int]]:
    """(partition, turns that its first sequence shares with the one before it) for the partitions with rows, in order."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                codes = batch.column(0)
                first = codes[0].as_py() if first is None else first
                last = codes[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last]})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, before = batch.column("first").to_pylist(), batch.column("before").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([-1 if b is None else _common(a, b) for a, b in zip(first, before, strict=True)], pa.int64())], names=["part", "shared"])

    edges = rows.select("codes").mapInArrow(ends, "part long, first binary, last binary")
    # Two sequences of each partition, whatever the table holds.
    beside = edges.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))
    return sorted((r["part"], r["shared"]) for r in beside.mapInArrow(shared, "part long, shared long").collect())


class _Block:
    """The sequences of one partition, in order, and what stands between them."""

    def __init__(self, batches: Iterator[pa.RecordBatch], before: int, after: int):
        codes_before, a, lengths, flat, low, n, self.ends = b"", [], [], [], [], [], []
        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                a.append(_common(codes_before, codes))
                lengths.append(len(codes) // CODE)
                codes_before = codes
            flat.append(batch.column("words").flatten().to_numpy(zero_copy_only=False))
            low.append(batch.column("conv_id").to_numpy())
            n.append(batch.column("n").to_numpy())
            self.ends += batch.column("ends_sha256").to_pylist()
        self.size = len(a)
        if not self.size:
            return
        a[0] = before
        self.a = np.array([*a, after], np.int64)
        self.len, self.low, self.n = np.array(lengths, np.int64), np.concatenate(low), np.concatenate(n)
        self.at = np.concatenate(([0], np.cumsum(self.len)))
        self.sums = np.concatenate(([0], np.cumsum(np.concatenate(flat).astype(np.int64))))
        every = np.arange(self.size)
        total = self.words(every, self.len)
        self.skipped = self.words(every, np.maximum(self.a[:-1], 0))
        self.leaf = self.a[1:] < self.len
        run = lambda x: np.concatenate(([0], np.cumsum(x)))
        #: Running sums: conversations, leaves, words of all conversations, words of the sequences' new nodes.
        self.run = [run(self.n), run(self.leaf), run(self.n * total), run(total - self.skipped)]

    def words(self, s: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first turns of sequences."""
        return self.sums[self.at[s] + depth] - self.sums[self.at[s]]

    def over(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [r[end] - r[start] for r in self.run]

    def intervals(self) -> None:
        """Nearest smaller values on both sides of each A, and the smallest conversation between them; -1 where there is none in the block."""
        n, a, low = self.size, self.a.tolist(), self.low.tolist()
        same, left, right, least = list(range(n + 1)), [-1] * (n + 1), [-1] * (n + 1), [FAR] * (n + 1)
        stack: list[int] = []
        latest = [0] * (n + 1)
        for j in range(n + 1):
            value, carry = a[j], low[j - 1] if j else FAR
            while stack and a[stack[-1]] > value:
                i = stack.pop()
                right[i] = j
                if carry < least[i]:
                    least[i] = carry
                carry = least[i]
            if stack and a[stack[-1]] == value:
                top = stack[-1]
                same[j] = top
                latest[top] = j
                if carry < least[top]:
                    least[top] = carry
            elif j < n:
                left[j] = latest[stack[-1]] if stack else -1
                latest[j] = j
                least[j] = carry
                stack.append(j)
        self.same, self.left, self.right, self.least = (np.array(x, np.int64) for x in (same, left, right, least))
        #: What the interval of A is named by at the block's end.
        self.open = np.array(stack, np.int64)


def _block_rows(block: _Block, number: int) -> Iterator[pa.RecordBatch]:
    n, a = block.size, block.a
    block.intervals()
    own = np.flatnonzero((block.same[:n] == np.arange(n)) & (a[:n] >= 0))
    inside = own[(block.left[own] >= 0) & (block.right[own] >= 0)]
    crossing = own[(block.left[own] < 0) | (block.right[own] < 0)]
    leaves = np.flatnonzero(block.leaf)
    start = np.concatenate((block.left[inside], leaves))
    end = np.concatenate((block.right[inside], leaves + 1))
    depth = np.concatenate((a[inside], block.len[leaves]))
    least = np.concatenate((block.least[inside], block.low[leaves]))
    above = np.maximum(a[start], a[end])
    # The parent is the interval of the larger neighbour; at the block's end that of the next block's first value, unless an equal one is here.
    parent = block.same[np.where(a[start] >= a[end], start, end)]
    beyond = parent == n
    kids = np.bincount(parent[above >= 0], minlength=n + 1)
    there = np.zeros(n + 1, bool)
    there[inside] = True
    known = there[parent]
    border = np.where(beyond | (block.left[parent] >= 0), number + 1, number)
    kids_of = np.concatenate((kids[inside], np.zeros(len(leaves), np.int64)))
    convs, tips, shared, new = block.over(start, end)
    base = shared - new - block.skipped[start]
    whole = block.len[start] == depth
    counts = depth - above
    order = np.argsort(start, kind="stable")
    at, total = 0, np.cumsum(counts[order])
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ROWS, "right")))
        i = order[at:to]
        c, top = counts[i], np.concatenate(([0], np.cumsum(counts[i])[:-1]))
        e = np.repeat(i, c)
        first = np.arange(len(e)) == np.repeat(top, c)
        d = above[e] + 1 + np.arange(len(e)) - np.repeat(top, c)
        last = d == depth[e]
        parents = np.where(first, block.least[parent[e]], least[e])
        unknown = (first & ~known[e]) | (d == 0)
        refs = first & ~known[e] & (above[e] >= 0)
        yield _batch(
            NODE,
            conv_id=least[e], depth=d, parent_conv_id=pa.array(parents, mask=unknown), n_convs=convs[e], n_children=np.where(last, kids_of[e], 1), n_leaves=tips[e],
            saved_tokens=base[e] - (convs[e] - 1) * block.words(start[e], np.maximum(d - 1, 0)),
            ends_sha256=[block.ends[s] if w else NOTHING for s, w in zip(start[e].tolist(), (last & whole[e]).tolist(), strict=True)],
            ref_border=pa.array(border[e], mask=~refs), ref_depth=pa.array(above[e], mask=~refs),
        )
        at = to
    # Children count at the left border where there is one.
    left = crossing[block.left[crossing] < 0]
    right = block.open[a[block.open] >= 0]
    once = np.where(block.left[right] < 0, 0, kids[right])
    yield _batch(
        CROSSING,
        ref_border=np.concatenate((np.full(len(left), number), np.full(len(right), number + 1), [number + 1] if a[n] >= 0 else [])).astype(np.int64),
        ref_depth=np.concatenate((a[left], a[right], [a[n]] if a[n] >= 0 else [])).astype(np.int64),
        n_children=np.concatenate((kids[left], once, [kids[n]] if a[n] >= 0 else [])).astype(np.int64),
    )
    for kind, values in ((PREFIX, a[:n]), (SUFFIX, a[:n][::-1])):
        least_so_far = np.minimum.accumulate(values)
        above_it = np.concatenate(([FAR], least_so_far[:-1]))
        records = np.flatnonzero(values < above_it)
        place = records if kind == PREFIX else n - 1 - records
        lows = np.minimum.accumulate(block.low if kind == PREFIX else block.low[::-1])
        lows = np.concatenate(([FAR], lows))[records] if kind == PREFIX else lows[records]
        sums = block.over(np.zeros_like(place), place) if kind == PREFIX else block.over(place, np.full_like(place, n))
        yield _batch(
            kind,
            block=np.full(len(place), number), depth=a[place], above=above_it[records], place=place, conv_id=lows, n_convs=sums[0], n_leaves=sums[1], shared_words=sums[2], own_words=sums[3],
            skipped=block.skipped[place], turns=block.len[place], ends_sha256=[block.ends[i] for i in place.tolist()],
        )
    if a[0] >= 0:
        yield _batch(BORDER, block=[number], words=[block.words(np.zeros(int(a[0]) + 1, np.int64), np.arange(int(a[0]) + 1)).tolist()])
    sums = [int(r[-1]) for r in block.run]
    yield _batch(BLOCK, block=[number], depth=[int(a[:n].min())], conv_id=[int(block.low.min())], n_convs=[sums[0]], n_leaves=[sums[1]], shared_words=[sums[2]], own_words=[sums[3]])


def _between(crossing: DataFrame, blocks: list) -> DataFrame:
    """Adds the blocks of the nearest smaller values on both sides, and the sums of the blocks between them."""
    least = [r["depth"] for r in blocks]
    lows = np.array([r["conv_id"] for r in blocks], np.int64)
    sums = [np.concatenate(([0], np.cumsum([r[c] for r in blocks], dtype=np.int64))) for c in ("n_convs", "n_leaves", "shared_words", "own_words")]
    count = len(blocks)
    smaller = {}
    for step, every in ((-1, range(count)), (1, range(count - 1, -1, -1))):
        to = [-1 if step < 0 else count] * count
        for b in every:
            k = b + step
            while 0 <= k < count and least[k] >= least[b]:
                k = to[k]
            to[b] = k
        smaller[step] = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for border, depth in zip(batch.column("ref_border").to_pylist(), batch.column("ref_depth").to_pylist(), strict=True):
                i, j = border - 1, border
                while least[i] >= depth:
                    i = smaller[-1][i]
                while j < count and least[j] >= depth:
                    j = smaller[1][j]
                out.append([i, j, *(int(s[j] - s[i + 1]) for s in sums), int(lows[i + 1 : j].min(initial=FAR))])
            more = [pa.array([x[k] for x in out], pa.int64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "l", "r", "m_convs", "m_leaves", "m_shared", "m_own", "m_low"])

    return crossing.mapInArrow(run, "ref_border long, ref_depth long, kids long, l long, r long, m_convs long, m_leaves long, m_shared long, m_own long, m_low long")


def _crossing(parts: DataFrame, blocks: list) -> tuple[DataFrame, DataFrame]:
    """The nodes that cross a border, every depth of them, and which conversation stands for each (border, depth)."""
    rows = parts.where(F.col("kind") == CROSSING).groupBy("ref_border", "ref_depth").agg(F.sum("n_children").alias("kids"))
    chain = lambda kind, side: parts.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "depth", "above", "place", "conv_id", "n_convs", "n_leaves", "shared_words", "own_words", "skipped", "turns", "ends_sha256")])
    met = lambda side: (F.col(side) == F.col(f"{side}_block")) & (F.col(f"{side}_depth") < F.col("ref_depth")) & (F.col("ref_depth") <= F.col(f"{side}_above"))
    found = _between(rows, blocks).join(chain(SUFFIX, "l"), met("l")).join(chain(PREFIX, "r"), met("r"), "left")
    total = lambda name, middle: F.col(f"l_{name}") + F.col(middle) + F.coalesce(f"r_{name}", F.lit(0))
    right = F.coalesce("r_depth", F.lit(-1))
    found = written(
        found.select(
            "ref_border", "ref_depth", "kids", "l", "l_place", F.greatest("l_depth", right).alias("above"), F.least("l_conv_id", "m_low", F.coalesce("r_conv_id", F.lit(int(FAR)))).alias("conv_id"),
            total("n_convs", "m_convs").alias("n_convs"), total("n_leaves", "m_leaves").alias("n_leaves"), (total("shared_words", "m_shared") - total("own_words", "m_own") - F.col("l_skipped")).alias("base"),
            F.when(F.col("l_turns") == F.col("ref_depth"), F.col("l_ends_sha256")).alias("ends"),
            F.when(F.col("l_depth") >= right, F.col("l") + 1).otherwise(F.col("r")).alias("up_border"),
        )
    )
    names = found.select("ref_border", "ref_depth", F.col("conv_id").alias("ref_conv_id"), F.col("l").alias("ref_l"), F.col("l_place").alias("ref_place"))
    same = ["above", "conv_id", "n_convs", "n_leaves", "base", "ends", "up_border"]
    nodes = found.groupBy("l", "l_place", "ref_depth").agg(F.sum("kids").alias("kids"), F.min("ref_border").alias("border"), *[F.first(c).alias(c) for c in same])
    nodes = written(nodes.join(names.select(F.col("ref_border").alias("up_border"), F.col("ref_depth").alias("above"), F.col("ref_conv_id").alias("up_conv_id"), F.col("ref_l").alias("up_l"), F.col("ref_place").alias("up_place")), ["up_border", "above"], "left"))
    more = nodes.where("up_l is not null").groupBy(F.col("up_l").alias("l"), F.col("up_place").alias("l_place"), F.col("above").alias("ref_depth")).agg(F.count("*").alias("more"))
    words = parts.where(F.col("kind") == BORDER).select(F.col("block").alias("border"), "words")
    nodes = nodes.join(more, ["l", "l_place", "ref_depth"], "left").join(words, "border")
    each = nodes.withColumn("depth", F.explode(F.sequence(F.col("above") + 1, F.col("ref_depth"))))
    last = F.col("depth") == F.col("ref_depth")
    before = F.when(F.col("depth") > 0, F.get("words", (F.col("depth") - 1).cast("int"))).otherwise(0)
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("above") + 1, F.col("up_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("kids") + F.coalesce("more", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("base") - (F.col("n_convs") - 1) * before).alias("saved_tokens"), F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    ), names


def trie(whole: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node, from (conv_id, codes, words)."""
    spark = whole.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(_distinct(written(whole)).repartitionByRange(parts, "codes").sortWithinPartitions("codes").select("codes", "words", "conv_id", "n", "ends_sha256"))
    borders = _borders(rows)
    blocks = {part: (i, shared, borders[i + 1][1] if i + 1 < len(borders) else -1) for i, (part, shared) in enumerate(borders)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, after = blocks.get(TaskContext.get().partitionId(), (0, -1, -1))
        block = _Block(batches, before, after)
        if block.size:
            yield from _block_rows(block, number)

    found = written(rows.mapInArrow(run, PARTS))
    totals = sorted(found.where(F.col("kind") == BLOCK).select("block", "depth", "conv_id", "n_convs", "n_leaves", "shared_words", "own_words").collect())
    crossing, names = _crossing(found, totals)
    nodes = found.where(F.col("kind") == NODE).select(*RESULT, "ref_border", "ref_depth")
    nodes = nodes.join(names.select("ref_border", "ref_depth", "ref_conv_id"), ["ref_border", "ref_depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "ref_conv_id"))
    return nodes.select(*RESULT).union(crossing.select(*RESULT))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations that begin with the first turns of another one."""
    return trie(forked(sequences(conversations), every, most))
