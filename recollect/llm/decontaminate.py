"""Benchmark decontamination by SimHash windows and a multi-index over Hamming blocks.

Every window of a document that is as long as an item is compared with the items of that length (a shorter document is
one window). A window's fingerprint is the 128-bit SimHash of its five-word shingles, each weighing as often as it
occurs. The fingerprint is cut into 8 blocks of 16 bits; two fingerprints within RADIUS agree in some block up to
RADIUS // 8 bits, so that a join on blocks with so many bits flipped misses none of them: it finds the pairs of window and item. The weighted
Jaccard similarity of the shingles, sum of minima by sum of maxima, verifies what is left.

Windows that cannot reach the similarity with any item are not fingerprinted: at similarity s, s / (1 + s) of all shingles of
both sides are shared. A map of bits, of one size whatever the number of items, tells which shingles no item of a length has; it drops no
match, and the documents are read once. What the fingerprints lose of all pairs at the similarity is measured in the tests.

Words are runs of ASCII digits, letters and all beyond ASCII, A-Z in lower case. Null or empty texts and
items match nothing, and neither do rows without doc_id. Repeated rows match alike and are reported once, different texts of one doc_id each by itself under it; of equal similarity the first window is reported.
Extra columns are dropped by matches() and kept by clean(). An empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import arrow
from recollect.session import written

K = 5
SIMILARITY = 0.8
BLOCKS, BITS = 8, 16
#: At similarity 0.8 fingerprints differ in 19 bits on average; 31 are three standard deviations more.
RADIUS = 31
#: Bits of the map of shingles, as a power of two: 8 MB.
MAP_BITS = 26
SECOND = 0xA0761D6478BD642F


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """The two halves of the SimHash of some shingles, as signed 64-bit numbers."""
    halves = []
    for own in (grams, arrow.mix(grams ^ arrow.U(SECOND))):
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        halves.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own), bitorder="little").view("<i8")[0]))
    return halves[0], halves[1]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    keys, counts = np.unique(a, return_counts=True)
    other, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(keys, other, assume_unique=True, return_indices=True)
    shared = int(np.minimum(counts[i], more[j]).sum())
    return shared / max(1, len(a) + len(b) - shared)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, long (words), grams, high and low (fingerprint) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = arrow.word_hashes(*arrow.text_bytes(batch.column("text")), arrow.plain_words())
            grams, gram_at = arrow.shingle_hashes(words, at, K)
            has = np.flatnonzero(np.diff(at) > 0)
            own = [grams[gram_at[i] : gram_at[i + 1]] for i in has]
            prints = [fingerprint(g) for g in own]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(has)), pa.array(np.diff(at)[has].astype(np.int32)), arrow.long_lists(own), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], names=["item_id", "long", "grams", "high", "low"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, long int, grams array<long>, high long, low long")


def _salted(grams: np.ndarray, long: int) -> np.ndarray:
    """Another hash of the shingles, for each length of an item its own."""
    return arrow.mix(grams + arrow.U(long) * arrow.U(0x9E3779B97F4A7C15))


class Shingles:
    """Which shingles items have, at all and by the items' length in words: a map of bits, two for each entry, which never denies one that is there."""

    def __init__(self, rows: pa.Table, lengths: list[int]):
        self.words, self.lengths = np.zeros(1 << (MAP_BITS - 6), arrow.U), lengths
        self.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(arrow.U)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> arrow.U(6)).astype(np.int64)] >> (at & arrow.U(63))) & arrow.U(1) > 0

    def has(self, grams: np.ndarray) -> np.ndarray:
        return self._bit(grams >> arrow.U(64 - MAP_BITS)) & self._bit((grams >> arrow.U(64 - 2 * MAP_BITS)) & arrow.U((1 << MAP_BITS) - 1))

    def places(self, grams: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.has(grams))

    def of_length(self, places: np.ndarray, grams: np.ndarray, long: int) -> np.ndarray:
        return places[self.has(_salted(grams[places], long))]


def shingles(own: DataFrame) -> Shingles:
    """The map of all items. It comes to the driver as at most 2^(MAP_BITS - 6) words of 64 bits; the lengths are no more than the longest item has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            grams = lists.flatten().to_numpy().view(arrow.U)
            long = np.repeat(batch.column("long").to_numpy().astype(arrow.U), np.diff(lists.offsets.to_numpy()))
            entries = np.concatenate((grams, arrow.mix(grams + long * arrow.U(0x9E3779B97F4A7C15))))
            at = np.concatenate((entries >> arrow.U(64 - MAP_BITS), (entries >> arrow.U(64 - 2 * MAP_BITS)) & arrow.U((1 << MAP_BITS) - 1)))
            yield pa.RecordBatch.from_arrays([arrow.longs(at >> arrow.U(6)), arrow.longs(arrow.U(1) << (at & arrow.U(63)))], names=["word", "bits"])

    words = own.select("long", "grams").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return Shingles(words.toArrow(), sorted(r["long"] for r in own.select("long").distinct().collect()))


def _windows(grams: np.ndarray, n_words: int, hits: np.ndarray, long: int, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """First word, length in words and shingles of the windows that can reach the similarity with an item of that length."""
    size = min(len(grams), long - K + 1)
    need = least / (1 + least) * (size + long - K + 1) - 1e-9
    if len(hits) < need:
        return
    total = np.concatenate(([0], np.cumsum(np.bincount(hits, minlength=len(grams)))))
    for start in np.flatnonzero(total[size:] - total[: len(grams) - size + 1] >= need):
        yield int(start), min(long, n_words), grams[start : start + size]


def _runs(words: np.ndarray, at: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of fewer words than a shingle has, as texts of just these words have them."""
    n = len(words) - long + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, arrow.U)
    inside = np.zeros(n + 1, np.int64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= long:
            inside[a] += 1
            inside[b - long + 1] -= 1
    places = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    keys = arrow.mix(np.arange(1, K + 1, dtype=arrow.U) * arrow.U(0xD1342543DE82EF95)) | arrow.U(1)
    total = np.full(len(places), long, arrow.U)
    for j in range(long):
        total += words[places + j] * keys[j]
    return places, arrow.mix(total)


def windows(docs: DataFrame, known: Shingles, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, start, long, grams, high and low of the windows that can match."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def found_in(words: np.ndarray, at: np.ndarray, known: Shingles) -> Iterator[tuple[int, int, int, np.ndarray]]:
        grams, gram_at = arrow.shingle_hashes(words, at, K)
        hits = known.places(grams)
        for long in known.lengths:
            if long < K:
                # An item of fewer words than a shingle is one run of words, and so is each window of its length.
                places, runs = _runs(words, at, long)
                mine = known.of_length(known.places(runs), runs, long)
                for place, run in zip(places[mine].tolist(), runs[mine], strict=True):
                    i = int(np.searchsorted(at, place, "right") - 1)
                    yield i, place - int(at[i]), long, np.array([run])
                continue
            own = known.of_length(hits, grams, long)
            for i in np.unique(np.searchsorted(gram_at, own, "right") - 1):
                if at[i + 1] - at[i] >= K:
                    mine = own[np.searchsorted(own, gram_at[i]) : np.searchsorted(own, gram_at[i + 1])] - gram_at[i]
                    for window in _windows(grams[gram_at[i] : gram_at[i + 1]], int(at[i + 1] - at[i]), mine, long, least):
                        yield int(i), *window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = arrow.plain_words(), sent.value
        for batch in batches:
            for part in arrow.slices(batch):
                found = list(found_in(*arrow.word_hashes(*arrow.text_bytes(part.column("text")), tables), known))
                if found:
                    prints = [fingerprint(f[3]) for f in found]
                    text = pa.array([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(text), part.column("text_hash").take(text), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), arrow.long_lists([f[3] for f in found]), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())],
                        names=["doc_id", "text_hash", "start", "long", "grams", "high", "low"],
                    )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, start int, long int, grams array<long>, high long, low long")


def _value():
    """The value of the block of a fingerprint."""
    half = BLOCKS // 2
    return F.expr(f"cast(shiftrightunsigned(case when block < {half} then high else low end, {BITS} * (block % {half})) & {(1 << BITS) - 1} as int)")


def index(own: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Block number and value, each value within the radius's share of bits of an item's own, with the item."""
    share = radius // BLOCKS
    masks = [sum(1 << b for b in c) for n in range(share + 1) for c in combinations(range(BITS), n)]
    rows = own.select("item_id", F.col("long").alias("item_long"), "high", "low", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("value", _value())
    flipped = rows.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    return flipped.select("block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "item_id", "item_long", F.col("high").alias("item_high"), F.col("low").alias("item_low"))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start and n_words of the best window, its similarity and Hamming distance."""
    own = written(items(benchmark))
    seen = written(windows(docs, shingles(own), least))
    place = ["doc_id", "text_hash", "start", "long"]
    parts = seen.select(*place, "high", "low", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("value", _value())
    distance = (F.bit_count(F.col("high").bitwiseXOR(F.col("item_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("item_low")))).alias("distance")
    # Merged: the index has thousands of rows an item, which isn't sent to all tasks.
    near = parts.join(index(own, radius).hint("merge"), ["block", "value"]).select(*place, "item_id", distance).where(F.col("distance") <= radius).distinct()
    both = near.join(seen.select(*place, "grams").dropDuplicates(place), place).join(own.select("item_id", F.col("grams").alias("item_grams")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("grams"), batch.column("item_grams"), strict=True)
            values = [similarity(np.array(a.values), np.array(b.values)) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "item_id", "start", "long", "distance")], pa.array(values, pa.float64())], names=["doc_id", "item_id", "start", "long", "distance", "similarity"])

    exact = both.mapInArrow(run, "doc_id long, item_id long, start int, long int, distance int, similarity double").where(F.col("similarity") >= least)
    best = F.struct(F.col("similarity").alias("similarity"), (-F.col("start")).alias("start"), "long", "distance")
    return exact.groupBy("doc_id", "item_id").agg(F.max(best).alias("best")).select("doc_id", "item_id", (-F.col("best.start")).alias("start"), F.col("best.long").alias("n_words"), F.col("best.similarity").alias("similarity"), F.col("best.distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark. All columns stay."""
    leaks = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["doc_id"], "left_anti")
