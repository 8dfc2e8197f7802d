"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one vocabulary token can be the last of its encoding. The encoder
stores that token for each prefix, so that bytes are appended exactly without encoding anew, and an edit
leaves the prefixes before it as they are and takes over the ones after it as soon as they agree again.

A null text counts as empty (no tokens, no bytes). Repeated rows are encoded each for itself, other
columns stay as they are, and a column of the name of a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.arrow import slices

#: Pairs of tokens whose standing side by side a worker keeps.
KEPT_PAIRS = 400_000
#: Places, by a hash of the pair, at which the encoder of many pieces keeps the same; a power of 2.
PAIR_PLACES = 1 << 20
#: Longer pieces are worked out one by one.
LONG_PIECE = 64
#: Pieces whose prefixes are worked out at once.
BLOCK_PIECES = 1 << 14
#: Text bytes that are encoded at once; a longer text is taken by itself.
SLICE_BYTES = 1 << 20


SPACE_RUN = re.compile(r"\s ")
WORD_END = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Tokens by rank, and which two tokens may stand side by side in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = {rank: token for token, rank in ranks.items()}
        self.right: dict[int, tuple[tuple[int, float], ...]] = {}
        self.left: dict[int, tuple[tuple[int, float], ...]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for rank, token in sorted(self.token.items()):
            own = ((rank, float("inf")),)
            self.right[rank] = self.left[rank] = own
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._meet(a, b):
                    self.merged[a, b] = rank
                    self.right[rank] = own + tuple((t, min(up, rank)) for t, up in self.right[b])
                    self.left[rank] = own + tuple((t, min(up, rank)) for t, up in self.left[a])
                    break

    def _meet(self, a: int, b: int) -> bool:
        """Merges go by rank, the leftmost first among equals. Two tokens stay apart unless a merge over their
        border comes while both its parts still stand: before the left part's own merge, and not after the right's."""
        merged = self.merged
        for x, up_x in self.right[a]:
            for y, up_y in self.left[b]:
                rank = merged.get((x, y))
                if rank is not None and rank < up_x and rank <= up_y:
                    return False
        return True

    def adjacent(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > KEPT_PAIRS:
                self.known.clear()
            found = self.known[a, b] = self._meet(a, b)
        return found


class Prefixes:
    """A piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        whole, before, last, vocabulary = self.data + data, len(self.data), self.last, self.vocabulary
        ranks, known, adjacent, longest = vocabulary.ranks.get, vocabulary.known.get, vocabulary.adjacent, vocabulary.longest
        for end in range(before + 1, len(whole) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = ranks(whole[start:end])
                if token is not None:
                    before = last[start]
                    fits = known((before, token)) if start else True
                    if fits or fits is None and adjacent(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token for byte {whole[end - 1]}")
        self.data = whole

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put data in the place of bytes start to end; the number of prefixes that were worked out anew."""
        old, whole = self.last, self.data[:start] + data + self.data[end:]
        self.last, shift, same, done = old[: start + 1], len(data) - (end - start), 0, 0
        for at in range(start + 1, len(whole) + 1):
            self.data = whole[: at - 1]
            self.append(whole[at - 1 : at])
            done += 1
            same = same + 1 if at > start + len(data) and self.last[at] == old[at - shift] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                break
        self.data = whole
        return done

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.token[found[-1]])
        return found[::-1]


class Table:
    """Whole numbers by whole-number keys, looked up for many keys at once; -1 for a key that is not there."""

    def __init__(self, held: dict[int, int]):
        self.bits = max(4, (4 * len(held)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int32, len(held))
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = self.keys[at] != keys
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) % len(self.keys)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return spread(keys, self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.keys)
            held = self.keys[at[rest]]
            found[rest] = np.where(held == keys[rest], self.values[at[rest]], -1)
            rest = rest[(held != keys[rest]) & (held >= 0)]
        return found


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """A hash of so many bits."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class Columns:
    """The last token of each prefix of many pieces: all prefixes of one byte first, then all of two, and so on."""

    def __init__(self, vocabulary: Vocabulary):
        n = max(vocabulary.token) + 1
        self.n, self.size = n, np.zeros(n, np.int64)
        self.head, self.tail = np.full(n, -1), np.full(n, -1)
        for rank, token in vocabulary.token.items():
            self.size[rank] = len(token)
        for (a, b), rank in vocabulary.merged.items():
            self.head[rank], self.tail[rank] = a, b
        self.merged = Table({a * n + b: rank for (a, b), rank in vocabulary.merged.items()})
        nodes: dict[int, int] = {}
        ends = {}
        for token, rank in vocabulary.ranks.items():
            node = 0
            for byte in token:
                node = nodes.setdefault(node * 256 + byte, len(nodes) + 1)
            ends[node] = rank
        self.nodes, self.ends = Table(nodes), np.full(len(nodes) + 1, -1)
        self.ends[list(ends)] = list(ends.values())
        self.pairs, self.fit = np.full(PAIR_PLACES, -1), np.zeros(PAIR_PLACES, bool)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary._meet of many pairs: goes back through the merges at both sides of the border, the latest first."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        up_a = up_b = np.full(len(a), self.n)
        while len(live):
            rank = self.merged.get(a * self.n + b)
            bad = (rank >= 0) & (rank < up_a) & (rank <= up_b)
            out[live[bad]] = False
            last_a, last_b = np.where(self.tail[a] >= 0, a, -1), np.where(self.head[b] >= 0, b, -1)
            go = np.flatnonzero(~bad & ((last_a >= 0) | (last_b >= 0)))
            live, a, b, up_a, up_b = live[go], a[go], b[go], up_a[go], up_b[go]
            right = last_b[go] >= last_a[go]
            up_a, up_b = np.where(right, up_a, a), np.where(right, b, up_b)
            a, b = np.where(right, a, self.tail[a]), np.where(right, self.head[b], b)
        return out

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.n + b
        at = spread(pair, PAIR_PLACES.bit_length() - 1)
        out = self.fit[at]
        new = np.flatnonzero(self.pairs[at] != pair)
        if len(new):
            out[new] = self.meet(a[new], b[new])
            self.pairs[at[new]] = pair[new]
            held = self.pairs[at[new]] == pair[new]  # of several pairs of one place the last one stays
            self.fit[at[new][held]] = out[new[held]]
        return out

    def last(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of pieces of these sizes, one after the other in data: the last token of each prefix, the empty one's (-1) first."""
        ends = np.cumsum(sizes)
        stop, shift = np.repeat(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
        column = np.arange(len(data)) - (stop - np.repeat(sizes, sizes))
        at, node, depth, found = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
        while len(at):
            node = self.nodes.get(node * 256 + data[at + depth]).astype(np.int64)
            depth += 1
            token = self.ends[node]
            hit = np.flatnonzero((node >= 0) & (token >= 0))
            found.append((at[hit], np.full(len(hit), depth), token[hit]))
            go = np.flatnonzero((node >= 0) & (at + depth < stop[at]))
            at, node = at[go], node[go]
        start, size, token = (np.concatenate(x) for x in zip(*found, strict=True))
        width = column[start] + size
        order = np.argsort(width.astype(np.uint16), kind="stable")
        start, size, token = start[order], size[order], token[order]
        cuts = np.searchsorted(width[order], np.arange(1, int(sizes.max()) + 2))
        start += shift[start]
        last = np.full(len(data) + len(sizes), -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            before, own = last[start[a:b]], token[a:b]
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.adjacent(before[inner], own[inner])
            last[(start[a:b] + size[a:b])[fits]] = own[fits]
        return last

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces that are not empty, one piece after the other, and how many each has."""
        blocks = [self._block(pieces[at : at + BLOCK_PIECES]) for at in range(0, len(pieces), BLOCK_PIECES)]
        tokens, counts = zip(*blocks, strict=True) if blocks else ([np.zeros(0, np.int64)],) * 2
        return np.concatenate(tokens), np.concatenate(counts)

    def _block(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = self.last(np.frombuffer(b"".join(pieces), np.uint8), sizes)
        base = np.cumsum(sizes + 1) - sizes - 1
        at, live, steps = base + sizes, np.arange(len(pieces)), []
        while len(live):
            token = last[at]
            if token.min() < 0:
                raise ValueError("no token for a byte")
            steps.append((live, token))
            at = at - self.size[token]
            go = np.flatnonzero(at > base[live])
            at, live = at[go], live[go]
        counts = np.zeros(len(pieces), np.int64)
        for live, _ in steps:
            counts[live] += 1
        tokens, free = np.empty(int(counts.sum()), np.int64), np.cumsum(counts)
        for live, token in steps:
            free[live] -= 1
            tokens[free[live]] = token
        return tokens, counts


def numbered(things: list) -> tuple[list, np.ndarray]:
    """The distinct things, and for each thing its number among them."""
    number = dict(zip(dict.fromkeys(things), count()))
    return list(number), np.fromiter(map(number.__getitem__, things), np.int64, len(things))


def gather(values: np.ndarray, counts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of values, those with the numbers take, one after the other, and how many values each has."""
    begin, sizes = np.cumsum(counts) - counts, counts[take]
    at = np.repeat(begin[take] - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return values[at], sizes


def totals(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of runs of sizes."""
    return np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))])


class Encoder:
    """Encodes texts; each match of the pattern for itself, and each distinct one of the given texts once."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.columns, self.pieces = vocabulary, Columns(vocabulary), regex.compile(pattern)

    def parts(self, text: str) -> list:
        """No match of a pattern of this kind goes from a character on to a space after it, so a text falls apart before
        such spaces, mostly into words. A part is given without the space that it begins with; the first, which has none, in a tuple."""
        if SPACE_RUN.search(text):
            first, *rest = WORD_END.split(text)
            return [(first,), *[p[1:] for p in rest]]
        first, *rest = text.split(" ")
        return [(first,), *rest]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, one after the other, and how many each has."""
        split = list(map(self.parts, texts))
        parts, of_texts = numbered(list(chain.from_iterable(split)))
        found = [self.pieces.findall(f" {p}" if isinstance(p, str) else p[0]) for p in parts]
        pieces, of_parts = numbered(list(chain.from_iterable(found)))
        data = [p.encode() for p in pieces]
        short = np.fromiter((len(x) <= LONG_PIECE for x in data), bool, len(data))
        tokens, counts = self.columns.encode([x for x in data if len(x) <= LONG_PIECE])
        long = [Prefixes(self.vocabulary, x).tokens() for x in data if len(x) > LONG_PIECE]
        place = np.empty(len(data), np.int64)
        place[short], place[~short] = np.arange(len(counts)), len(counts) + np.arange(len(long))
        tokens = np.concatenate((tokens, np.array(list(chain.from_iterable(long)), np.int64)))
        counts = np.concatenate((counts, np.array(list(map(len, long)), np.int64)))
        tokens, sizes = gather(tokens, counts, place[of_parts])
        counts = totals(sizes, np.fromiter(map(len, found), np.int64, len(found)))
        tokens, sizes = gather(tokens, counts, of_texts)
        return tokens.astype(np.int32), totals(sizes, np.fromiter(map(len, split), np.int64, len(split)))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def _ranks(file: bytes) -> Iterator[tuple[bytes, int]]:
    for line in file.splitlines():
        if line:
            token, rank = line.split()
            yield base64.b64decode(token), int(rank)


@lru_cache(maxsize=1)
def _encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(dict(_ranks(file))), pattern)


@lru_cache(maxsize=1)
def _tokens(file: bytes) -> dict[int, bytes]:
    """The bytes of each id, which is all that decoding needs."""
    return {rank: token for token, rank in _ranks(file)}


def _encoded(batches: Iterator[pa.RecordBatch], file: bytes, pattern: str, text: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(file, pattern)
    for whole in batches:
        for batch in slices(whole, text, SLICE_BYTES):
            tokens, counts = encoder.encode_all([x or "" for x in batch.column(text).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(counts)], names=[*batch.schema.names, "ids", "n_tokens"])


def _decoded(batches: Iterator[pa.RecordBatch], file: bytes, ids: str) -> Iterator[pa.RecordBatch]:
    own = _tokens(file).__getitem__
    for batch in batches:
        column = batch.column(ids)
        at, values = column.offsets.to_numpy(), column.values.to_numpy()
        found = [b"".join(map(own, values[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])


ENCODED = (T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False))
DECODED = (T.StructField("decoded", T.BinaryType(), True),)


def _without(docs: DataFrame, added: Sequence[T.StructField]) -> DataFrame:
    return docs.select([docs[c] for c in docs.columns if c not in [field.name for field in added]])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids, the token ids of each text, and n_tokens."""
    file = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = _without(docs, ENCODED)
    return docs.mapInArrow(lambda batches: _encoded(batches, file.value, pattern, text), T.StructType([*docs.schema.fields, *ENCODED]))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the bytes that the token ids stand for."""
    file = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))
    tokens = _without(tokens, DECODED)
    return tokens.mapInArrow(lambda batches: _decoded(batches, file.value, ids), T.StructType([*tokens.schema.fields, *DECODED]))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids, n_tokens and decoded in the place of the text: decode after encode, by one worker."""
    file = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = _without(docs, ENCODED + DECODED)
    names = [c for c in docs.columns if c != text] + ["ids", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded((batch.select(names) for batch in _encoded(batches, file.value, pattern, text)), file.value, "ids")

    return docs.mapInArrow(run, T.StructType([*docs.drop(text).schema.fields, *ENCODED, *DECODED]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens, and SHA-256 of its ids and of what they decode to."""
    return encode_decode(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
