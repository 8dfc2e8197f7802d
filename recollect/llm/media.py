"""Media columns: texts stored as progressive JPEG and read back as coefficients and RGB tensors.

A text's UTF-8 bytes, with spaces up to a positive multiple of 192, are the payload. The unit of the format that keeps 8 bits
without loss is the quantised DCT coefficient: a byte becomes a coefficient of the eight-bit size class (DC: of
two values for each of 7 bits), and the coefficients of 64 bytes are a block in zigzag order. The image has 4:2:0
sampling, four blocks of luma to one of each chroma; blocks beyond the payload stand for spaces.

Its scans are progressive: DC and then two spectral bands without their lowest bit, then that bit by successive approximation.
The reader takes progressive files of 8-bit samples and three components sampled so, with scans of one component: it accumulates the scans into
coefficient arrays, for all restart intervals of a batch in step, transforms them back exactly in whole numbers, upsamples chroma, and yields the
full-resolution RGB tensor, row by row.

A null or empty text is 192 spaces. Equal texts give equal bytes. Rows repeat as they come; extra columns are dropped. An
empty table gives no rows. A text is one image, which one task holds as a whole, with some thirty times the text's size in arrays.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm import arrow

UNIT = 192
BLOCK = 64
#: (component, first and last coefficient, high and low bit) of each scan, in the order of the file.
SCRIPT = [(c, 0, 0, 0, 1) for c in range(3)] + [(c, *band, 0, 1) for band in ((1, 5), (6, 63)) for c in range(3)] + [(c, 0, 0, 1, 0) for c in range(3)] + [(c, 1, 63, 1, 0) for c in range(3)]
#: Code lengths and symbols: DC has class 7 alone, AC a coefficient of class 7 and the end of a block.
DC_CODES, AC_CODES = ((1,), (0x07,)), ((1, 1), (0x07, 0x00))


def zigzag() -> np.ndarray:
    """The place, row by row, of each coefficient of a block."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
SCALE = 12


def inverse_transform() -> np.ndarray:
    """From coefficients in zigzag order to samples, in whole numbers of 2^-(2 * SCALE); float64 sums of them are exact in any order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.rint(np.where(u == 0, math.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * math.pi / 16) * (1 << SCALE))
    return np.kron(one, one)[ZIGZAG]


TRANSFORM = inverse_transform()


def shape(payload: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units that hold the payload."""
    units = -(-payload // (6 * BLOCK))
    columns = math.isqrt(units - 1) + 1
    return -(-units // columns), columns


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(kind: int, lengths_symbols) -> bytes:
    counts, symbols = lengths_symbols
    return bytes([kind, *counts, *[0] * (16 - len(counts)), *symbols])


def _head(payload: int) -> bytes:
    rows, columns = shape(payload)
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"payload %d" % payload) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, _codes(0x00, DC_CODES) + _codes(0x10, AC_CODES)) + _segment(0xDD, b"\0\1")


SCAN_HEADS = [_segment(0xDA, bytes([1, c + 1, 0x00, first, last, 16 * high + low])) for c, first, last, high, low in SCRIPT]


def _scan(blocks: np.ndarray, place: np.ndarray, first: int, last: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of a scan of all blocks, a restart marker before each but an image's first, and where each block's bytes begin."""
    if not high:
        coded = blocks[:, first : last + 1] >> 1  # the one-bit code 0, then the seven high bits
    else:
        low = blocks[:, first : last + 1] & 1
        if not first:
            coded = (low << 7) | 0x7F
        else:
            low = np.where(blocks[:, first : last + 1] < 128, 1 - low, low)
            bits = np.ones((len(blocks), 72), np.uint8)
            bits[:, 1], bits[:, 2 : 2 + low.shape[1]] = 0, low
            coded = np.packbits(bits, axis=1)
    out = np.empty((len(blocks), coded.shape[1] + 2), np.uint8)
    out[:, 0], out[:, 1], out[:, 2:] = 0xFF, 0xD0 + (place - 1) % 8, coded
    kept, full = np.ones(out.shape, bool), np.zeros(out.shape, bool)
    kept[place == 0, :2], full[:, 2:] = False, coded == 0xFF
    begin = np.concatenate(([0], np.cumsum(kept.sum(axis=1) + full.sum(axis=1))))
    # A zero goes behind each coded byte that looks like a marker.
    return np.insert(out[kept], np.flatnonzero(full[kept]) + 1, 0), begin


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload."""
    units = np.array([math.prod(shape(len(p))) for p in payloads], np.int64)
    filled = [p + b" " * (6 * BLOCK * u - len(p)) for p, u in zip(payloads, units.tolist(), strict=True)]
    parts = [[f[: 4 * BLOCK * u] for f, u in zip(filled, units, strict=True)], [f[4 * BLOCK * u : 5 * BLOCK * u] for f, u in zip(filled, units, strict=True)], [f[5 * BLOCK * u :] for f, u in zip(filled, units, strict=True)]]
    planes = [np.frombuffer(b"".join(p), np.uint8).reshape(-1, BLOCK) for p in parts]
    starts = [np.concatenate(([0], np.cumsum(units * (4 if c == 0 else 1)))) for c in range(3)]
    places = [np.arange(len(planes[c])) - np.repeat(starts[c][:-1], np.diff(starts[c])) for c in range(3)]
    pieces = [[_head(len(p))] for p in payloads]
    for head, (c, first, last, high, _) in zip(SCAN_HEADS, SCRIPT, strict=True):
        flat, begin = _scan(planes[c], places[c], first, last, high)
        data, edges = flat.tobytes(), begin[starts[c]].tolist()
        for i, own in enumerate(pieces):
            own += [head, data[edges[i] : edges[i + 1]]]
    return [b"".join([*own, b"\xff\xd9"]) for own in pieces]


class Image:
    """What the segments of a file say, and its scans: (component, first, last, high, low, DC and AC table, restart interval, start, end)."""

    def __init__(self, data: bytes):
        self.payload, self.scans, self.quantum = None, [], {}
        tables: dict[int, bytes] = {}
        interval, at = 0, 2
        while True:
            marker, size = data[at + 1], 0
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif marker == 0xDB:
                self.quantum[body[0] & 15] = body[1:65]
            elif marker == 0xC2:
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                self.components = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(count)]
                if [c[1] for c in self.components] != [0x22, 0x11, 0x11]:
                    raise ValueError("only 4:2:0 images are read")
            elif marker == 0xC4:
                while body:
                    size = 17 + sum(body[1:17])
                    tables[body[0]], body = body[1:size], body[size:]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                if body[0] != 1:
                    raise ValueError("only scans of one component are read")
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                component = [c[0] for c in self.components].index(body[1])
                self.scans.append((component, body[3], body[4], body[5] >> 4, body[5] & 15, tables.get(body[2] >> 4), tables.get(16 + (body[2] & 15)), interval, at, end))
                at = end
            elif not 0xE0 <= marker <= 0xEF:
                raise ValueError(f"marker {marker:x} is not read")

    def blocks(self, component: int) -> int:
        side = 16 if component else 8
        return -(-self.height // side) * -(-self.width // side)


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol by the next 16 bits."""
    lengths, symbols, code, at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            low = code << (16 - size)
            lengths[low : low + (1 << (16 - size))], symbols[low : low + (1 << (16 - size))] = size, table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


class Bits:
    """Positions in a buffer of bits, one for each stream; all are read in step."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words, self.at = np.ndarray(len(data) + 8, ">u8", padded, strides=(1,)).astype(np.uint64), start * 8

    def ahead(self, who: np.ndarray) -> np.ndarray:
        at = self.at[who]
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def symbol(self, who: np.ndarray, lookup) -> np.ndarray:
        code = (self.ahead(who) >> np.uint64(48)).astype(np.int64)
        self.at[who] += lookup[0][code]
        return lookup[1][code]

    def take(self, who: np.ndarray, count: np.ndarray) -> np.ndarray:
        value = ((self.ahead(who) >> np.uint64(1)) >> (63 - count).astype(np.uint64)).astype(np.int64)
        self.at[who] += count
        return value

    def one(self, who: np.ndarray) -> np.ndarray:
        value = (self.ahead(who) >> np.uint64(63)).astype(np.int64)
        self.at[who] += 1
        return value


def _extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _dc(bits: Bits, lookup, who: np.ndarray, block: np.ndarray, out: np.ndarray, before: np.ndarray, high: int, low: int) -> None:
    if high:
        out[block, 0] |= (bits.one(who) << low).astype(out.dtype)
        return
    size = bits.symbol(who, lookup)
    before[who] += _extended(bits.take(who, size), size)
    out[block, 0] = before[who] << low


def _ac_first(bits: Bits, lookup, who: np.ndarray, block: np.ndarray, out: np.ndarray, ended: np.ndarray, first: int, last: int, low: int) -> None:
    open_ = ended[who] == 0
    ended[who[~open_]] -= 1
    who, block = who[open_], block[open_]
    at = np.full(len(who), first)
    while len(who):
        symbol = bits.symbol(who, lookup)
        run, size = symbol >> 4, symbol & 15
        value = bits.take(who, np.where(size > 0, size, np.where(run < 15, run, 0)))
        end = (size == 0) & (run < 15)
        at = at + np.where(size > 0, run, 16)
        put = size > 0
        if put.all():
            out[block, at] = _extended(value, size) << low
        else:
            out[block[put], at[put]] = _extended(value[put], size[put]) << low
            ended[who[end]] = (1 << run[end]) + value[end] - 1
        at = at + put
        more = ~end & (at <= last)
        if not more.all():
            who, block, at = who[more], block[more], at[more]


def _ac_refined(bits: Bits, lookup, who: np.ndarray, block: np.ndarray, out: np.ndarray, ended: np.ndarray, first: int, last: int, low: int) -> None:
    waiting, run, new = np.zeros(len(who), bool), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    for k in range(first, last + 1):
        ask = np.flatnonzero(~waiting & (ended[who] == 0))
        if len(ask):
            symbol = bits.symbol(who[ask], lookup)
            r, size = symbol >> 4, symbol & 15
            stop = (size == 0) & (r < 15)
            ended[who[ask[stop]]] = (1 << r[stop]) + bits.take(who[ask[stop]], r[stop])
            go = ask[~stop]
            waiting[go], run[go], new[go] = True, r[~stop], 0
            fresh = ask[size > 0]
            new[fresh] = np.where(bits.one(who[fresh]) == 1, 1 << low, -(1 << low))
        value = out[block, k].astype(np.int64)
        known = np.flatnonzero(value)
        if len(known):
            bit = bits.one(who[known])
            had = value[known]
            out[block[known], k] = had + np.where((bit == 1) & ((np.abs(had) >> low) & 1 == 0), np.sign(had) << low, 0)
        zero = np.flatnonzero((value == 0) & waiting)
        if len(zero):
            here = zero[run[zero] == 0]
            out[block[here], k] = new[here]
            waiting[here] = False
            run[zero] -= 1
    done = ended[who] > 0
    ended[who[done]] -= 1


def coefficients(files: list[bytes], images: list[Image]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component the coefficients of all images' blocks in zigzag order, and each image's offsets."""
    planes = []
    for c in range(3):
        at = np.concatenate(([0], np.cumsum([i.blocks(c) for i in images]))).astype(np.int64)
        planes.append((np.zeros((int(at[-1]), BLOCK), np.int16), at))
    for k in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if k < len(image.scans):
                kinds.setdefault(image.scans[k][:8], []).append(i)
        for kind, own in kinds.items():
            _scans(kind, [(files[i][images[i].scans[k][8] : images[i].scans[k][9]], int(planes[kind[0]][1][i]), images[i].blocks(kind[0])) for i in own], planes[kind[0]][0])
    return planes


def _scans(kind: tuple, scans: list[tuple[bytes, int, int]], out: np.ndarray) -> None:
    """Decode like scans (bytes, first block, blocks) of several images, all restart intervals in step."""
    _, first, last, high, low, dc, ac, interval, = kind
    data = np.frombuffer(b"".join(s[0] for s in scans), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(s[0]) for s in scans])))[:-1]
    after = np.append(data[1:], np.uint8(1))
    full = data == 0xFF
    restart = full & (after >= 0xD0) & (after <= 0xD7)
    drop = restart.copy()
    drop[1:] |= restart[:-1] | (full[:-1] & (after[:-1] == 0))
    kept = np.concatenate(([0], np.cumsum(~drop)))
    marks = np.flatnonzero(restart)
    start = np.sort(np.concatenate((kept[begin], kept[marks])), kind="stable")
    counts = [s[2] for s in scans]
    blocks, sizes = [], []
    for _, at, count in scans:
        step = interval or count
        heads = np.arange(0, count, step)
        blocks.append(at + heads)
        sizes.append(np.minimum(step, count - heads))
    block, size = np.concatenate(blocks), np.concatenate(sizes)
    if len(start) != len(block):
        raise ValueError(f"{len(start)} restart intervals, {len(block)} expected for {sum(counts)} blocks")
    bits, ended, before = Bits(data[~drop], start), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    lookup = _lookup(dc if first == 0 else ac) if not (first == 0 and high) else None
    for step in range(int(size.max(initial=0))):
        who = np.flatnonzero(size > step)
        if first == 0:
            _dc(bits, lookup, who, block[who] + step, out, before, high, low)
        elif high:
            _ac_refined(bits, lookup, who, block[who] + step, out, ended, first, last, low)
        else:
            _ac_first(bits, lookup, who, block[who] + step, out, ended, first, last, low)


def payload_bytes(own: list[np.ndarray], size: int) -> bytes:
    """The bytes that an image's coefficients stand for."""
    blocks = np.concatenate(own)
    values = np.where(blocks < 0, blocks + 255, blocks)
    values[:, 0] = np.where(blocks[:, 0] < 0, blocks[:, 0] + 254, blocks[:, 0])
    return values.astype(np.uint8).tobytes()[:size]


def samples(blocks: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 samples from coefficients."""
    exact = (blocks * quantum).astype(np.float64) @ TRANSFORM
    half = 1 << (2 * SCALE - 1)
    return np.clip((exact.astype(np.int64) + half >> 2 * SCALE) + 128, 0, 255).astype(np.int32).reshape(-1, 8, 8)


def plane(blocks: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return blocks.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def rgb(luma: np.ndarray, blue: np.ndarray, red: np.ndarray) -> np.ndarray:
    """The tensor of full resolution; chroma is upsampled, in whole numbers of 2^-16."""
    blue, red = blue - 128, red - 128
    shifts = [(91881 * red + 32768) >> 16, (-22554 * blue - 46802 * red + 32768) >> 16, (116130 * blue + 32768) >> 16]
    out = np.empty((*luma.shape, 3), np.uint8)
    for i, shift in enumerate(shifts):
        np.clip(luma + shift.repeat(2, axis=0).repeat(2, axis=1), 0, 255, out=out[:, :, i], casting="unsafe")
    return out


def read(files: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Payload and RGB tensor of each file."""
    images = [Image(f) for f in files]
    planes = coefficients(files, images)
    pixels = []
    for c, (blocks, at) in enumerate(planes):
        quantum = np.concatenate([np.broadcast_to(np.frombuffer(i.quantum[i.components[c][2]], np.uint8).astype(np.int32), (int(n), BLOCK)) for i, n in zip(images, np.diff(at), strict=True)]) if len(blocks) else np.ones((0, BLOCK), np.int32)
        pixels.append(samples(blocks, quantum))
    for i, image in enumerate(images):
        own = [blocks[at[i] : at[i + 1]] for blocks, at in planes]
        rows, columns = -(-image.height // 16), -(-image.width // 16)
        parts = [plane(pixels[c][planes[c][1][i] : planes[c][1][i + 1]], rows * (1 if c else 2), columns * (1 if c else 2)) for c in range(3)]
        yield payload_bytes(own, image.payload), rgb(*parts)[: image.height, : image.width]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch):
                data, at = arrow.text_bytes(part.column("text"))
                data, sizes = data.tobytes(), np.diff(at)
                padded = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
                payloads = [data[a:b] + b" " * int(p - (b - a)) for a, b, p in zip(at[:-1].tolist(), at[1:].tolist(), padded, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(write(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def decode(media: DataFrame) -> DataFrame:
    """Adds payload, height, width, sums (of the tensor's channels) and rgb, the tensor's bytes, row by row; columns of these names are replaced."""
    added = [("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("sums", pa.list_(pa.int64())), ("rgb", pa.binary())]
    media = media.select([media[c] for c in media.columns if c not in dict(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for payload, tensor in read(part.column("media").to_pylist()):
                    rows.append((payload, *tensor.shape[:2], tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist(), tensor.tobytes()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, kind) for v, (_, kind) in zip(columns, added, strict=True)]], names=[*part.schema.names, *[n for n, _ in added]])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, *T._parse_datatype_string("payload binary, height int, width int, sums array<long>, rgb binary").fields]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about as many bytes of files as a slice of texts."""
    sizes = np.cumsum(pc.binary_length(batch.column("media")).to_numpy())
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + arrow.SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def digests(docs: DataFrame) -> DataFrame:
    """Per document the digests of the payload as it was read back and of the stored file, and as its feature the tensor's size, the sums of its channels and its CRC-32."""
    found = decode(encode(docs))
    payload = F.col("payload")
    tail = F.crc32(F.substring(payload, -16, 16))
    feature = F.concat_ws(":", F.concat_ws("x", "height", "width"), F.array_join(F.col("sums").cast("array<string>"), ":"), F.lower(F.lpad(F.hex(F.crc32("rgb")), 8, "0")))
    return found.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
