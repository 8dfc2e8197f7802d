"""Substring dedup by sliding sentence spans.

A span starts at every sentence and takes at least two sentences, and so many that it has LEAST_WORDS words; a text too short
for that is one span as a whole. With both_ways the shortest such span that ends at every sentence counts too: together they
cover every repeated run of two sentences and LEAST_WORDS words to its end, forward spans alone leave its last sentences. Spans are compared by two 64-bit hashes of their words, A-Z in lower case, without punctuation.
Of equal spans the first stays, the one of the smallest (doc_id, place); sentences that any
other one covers are removed.

A sentence ends with . ! or ? before white space or the end, or with a line; what has no words belongs
to the sentence before. Null or empty texts have no sentences, and their text stays as it is. Rows of one
doc_id count as one document at equal places; rows without doc_id are neither compared nor cut. Extra columns stay with clean(), a
table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import arrow
from recollect.session import written

LEAST_SENTENCES = 2
LEAST_WORDS = 20
#: Odd multipliers of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence: first byte, hashes (one row for each of BASES), number of words; and each text's offsets among the sentences."""
    inside, code = arrow.plain_words()
    words, word_at, starts = arrow.placed_words(data, at, (inside, code))
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    after = np.ones(len(data), bool)
    after[:-1] = np.isin(data[1:], np.array(arrow.SPACES, np.uint8))
    after[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero((stop & after) | (data == 10))
    part = np.searchsorted(ends, starts)
    new = np.ones(len(starts), bool)
    new[1:] = part[1:] != part[:-1]
    new[word_at[:-1][word_at[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(starts)))
    sentence_at = np.searchsorted(first, word_at)
    if not len(first):
        return first, np.zeros((len(BASES), 0), arrow.U), counts, sentence_at
    place = np.arange(len(starts)) - np.repeat(first, counts)
    hashes = np.stack([arrow.mix(np.add.reduceat(words * _powers(base, int(counts.max()))[place], first) + counts.astype(arrow.U)) for base in BASES])
    begin = np.where(part[first] > 0, ends[np.maximum(part[first] - 1, 0)] + 1, 0)
    own = sentence_at[:-1][np.diff(sentence_at) > 0]
    begin[own] = at[:-1][np.diff(sentence_at) > 0]
    return begin, hashes, counts, sentence_at


def _powers(base: int, n: int) -> np.ndarray:
    power = np.full(n, base, arrow.U)
    power[0] = 1
    return np.multiply.accumulate(power)


def runs(hashes: np.ndarray, counts: np.ndarray, at: np.ndarray, both_ways: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end and hashes of each span, each span once."""
    total = np.concatenate(([0], np.cumsum(counts)))
    start = np.arange(len(counts))
    text = np.searchsorted(at, start, "right") - 1
    end = np.maximum(np.searchsorted(total, total[:-1] + LEAST_WORDS), start + LEAST_SENTENCES)
    whole = (start == at[text]) & (end > at[text + 1])
    end = np.where(whole, at[text + 1], end)
    good = end <= at[text + 1]
    start, end, forward = start[good], end[good], end
    if both_ways:
        stop = np.arange(1, len(counts) + 1)
        begin = np.minimum(np.searchsorted(total, total[1:] - LEAST_WORDS, "right") - 1, stop - LEAST_SENTENCES)
        more = begin >= at[text]
        more[more] = forward[begin[more]] != stop[more]
        start, end = np.concatenate((start, begin[more])), np.concatenate((end, stop[more]))
    keys = []
    for base, own in zip(BASES, hashes, strict=True):
        power, back = _powers(base, len(own) + 1), _powers(pow(base, -1, 1 << 64), len(own) + 1)
        sums = np.concatenate((np.zeros(1, arrow.U), np.cumsum(own * power[:-1], dtype=arrow.U)))
        keys.append(arrow.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(arrow.U)))
    return start, end, np.stack(keys)


def spans(docs: DataFrame, both_ways: bool = False) -> DataFrame:
    """doc_id, start, end (sentences), hash and twin (its other hash) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch):
                data, at = arrow.text_bytes(part.column("text"))
                _, hashes, counts, sentence_at = sentences(data, at)
                start, end, keys = runs(hashes, counts, sentence_at, both_ways)
                text = np.searchsorted(sentence_at, start, "right") - 1
                zero = sentence_at[text]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array((start - zero).astype(np.int32)), pa.array((end - zero).astype(np.int32)), arrow.longs(keys[0]), arrow.longs(keys[1])], names=["doc_id", "start", "end", "hash", "twin"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("start int, end int, hash long, twin long").fields]))


def repeated(docs: DataFrame, both_ways: bool = False) -> DataFrame:
    """doc_id and covered, the spans (start, end) of each document that are not the first of their kind."""
    found = spans(docs.where("doc_id is not null"), both_ways)
    # A table of its own, so that Spark can split the rows of a span that very many documents have.
    often = written(found.groupBy("hash", "twin").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = found.join(often, ["hash", "twin"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("covered"))


def clean(docs: DataFrame, both_ways: bool = False) -> DataFrame:
    """All columns, text without its repeated sentences, and n_sentences, n_removed and removed, the runs (start, end) of sentences that went."""
    docs = docs.select([docs[c] for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")])
    own = "_covered"
    while own in docs.columns:
        own += "_"
    joined = docs.join(repeated(docs, both_ways).withColumnRenamed("covered", own), "doc_id", "left").select(*docs.columns, own)
    fields = [*docs.schema.fields, *T._parse_datatype_string("n_sentences long, n_removed long, removed array<struct<start:int,end:int>>").fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch):
                data, at = arrow.text_bytes(part.column("text"))
                begin, _, _, sentence_at = sentences(data, at)
                texts, counts, gone, removed = [], np.diff(sentence_at), [], []
                for i, covered in enumerate(part.column(own).to_pylist()):
                    away = np.zeros(counts[i] + 1, bool)
                    for span in covered or ():
                        away[span["start"] : span["end"]] = True
                    steps = np.flatnonzero(np.diff(np.concatenate(([False], away))))
                    pairs = steps.reshape(-1, 2)
                    edge = np.append(begin[sentence_at[i] : sentence_at[i + 1]], at[i + 1])
                    texts.append(_without(data, int(at[i]), int(at[i + 1]), [(int(edge[a]), int(edge[b])) for a, b in pairs]) if len(pairs) else part.column("text")[i].as_py())
                    gone.append(int(away.sum()))
                    removed.append([{"start": int(a), "end": int(b)} for a, b in pairs])
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in part.schema.names if c != own]
                names = [c for c in part.schema.names if c != own]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(removed, kind)], names=[*names, "n_sentences", "n_removed", "removed"])

    return joined.mapInArrow(run, T.StructType(fields))


def _without(data: np.ndarray, start: int, end: int, cuts: list[tuple[int, int]]) -> str:
    kept, at = [], start
    for a, b in cuts:
        kept.append(data[at:a].tobytes())
        at = b
    return b"".join([*kept, data[at:end].tobytes()]).decode()
