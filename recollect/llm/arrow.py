"""Numpy helpers for Arrow batches: words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: ASCII white space.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def spaced_words() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables (is in a word, code) of words between ASCII white space, A-Z in lower case."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return inside, _lowered()


def plain_words() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of words of ASCII digits and letters and whatever lies beyond ASCII, A-Z in lower case."""
    inside = np.zeros(256, bool)
    inside[ord("0") : ord("9") + 1] = inside[ord("a") : ord("z") + 1] = inside[ord("A") : ord("Z") + 1] = inside[128:] = True
    return inside, _lowered()


def _lowered() -> np.ndarray:
    code = BYTE_CODE.copy()
    code[ord("A") : ord("Z") + 1] = BYTE_CODE[ord("a") : ord("z") + 1]
    return code


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and their offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes."""
    _, at = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def word_hashes(data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the offsets of each text's words."""
    return placed_words(data, at, tables)[:2]


def placed_words(data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, the offsets of each text's words, and each word's first byte."""
    inside, code = tables
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[1:-1][at[1:-1] < len(data)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(at), np.int64), starts
    where = np.flatnonzero(word)
    begin = np.searchsorted(where, starts)
    lengths = np.diff(np.append(begin, len(where)))
    power = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    values = code[data[where]] * power[where - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(values, begin) + lengths.astype(U)), np.searchsorted(starts, at), starts


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k words within a text, and each text's offsets. A text of fewer words has all of them as one run; without words, none."""
    counts = np.diff(at)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(out_at[-1]), U)
    keys = mix(np.arange(1, k + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    n = len(words) - k + 1
    if n > 0:
        run = words[:n] * keys[0]
        for j in range(1, k):
            run += words[j : j + n] * keys[j]
        long = np.flatnonzero(counts >= k)
        take = np.repeat(at[long] - np.concatenate(([0], np.cumsum(sizes[long])[:-1])), sizes[long]) + np.arange(int(sizes[long].sum()))
        put = np.repeat(out_at[long] - np.concatenate(([0], np.cumsum(sizes[long])[:-1])), sizes[long]) + np.arange(int(sizes[long].sum()))
        out[put] = run[take]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[at[i] : at[i + 1]]
        out[out_at[i]] = (own * keys[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(out), out_at


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(at), longs(flat.astype(U, copy=False)))
