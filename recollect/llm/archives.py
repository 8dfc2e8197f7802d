"""Legacy archives to WARC: ARC files are parsed by the header line of their version and its declared length, and become WARC records.

1. `write_arc` writes pages as ARC files, one to a partition, of version 1 and 2 in turn: a file description, then a header line
   and an HTTP response for each page.
2. `convert` reads ARC files one by one, record by record. It makes record ids (UUIDs by the record's place, URI and date), ISO
   timestamps, types (warcinfo, response, revisit, resource) and SHA-1 digests of block and payload. Of responses with equal
   payloads the one with the smallest page id stays, then the first by file and place; the others become revisits of it without payload.
3. `read_warc` reads WARC files back, by their headers and declared lengths, and checks the digests.

All files are written and read by Spark, so they may lie in any store that Spark reaches. A file is one row of a task and unpacked as a stream;
its size is bounded by spark.sql.files.maxPartitionBytes of the pages. Long payloads are one record. Equality of payloads is that of
their SHA-256 over keys only: payloads are shuffled only if there are more revisits than Spark broadcasts by its own limit of size.

A null html is an empty payload; white space and control characters of a URL become %20, a null or empty one about:blank. Rows
without page_id sort last and come back without one. Rows that repeat a page are records of their own: one of them is the response.
An empty table gives no rows. Other columns of pages are passed over. A record that is shorter than declared keeps what there is and says so (WARC-Truncated)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import ensure_checkpoint_dir, written

#: The fields of a header line by the version of the file.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "X-Page-Id"
#: Our own field for the size of the payload, which a revisit does not carry.
SIZE = "X-Payload-Length"
#: Bytes and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 4096
#: Files are packed fast rather than small.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class Record(NamedTuple):
    """A record of an ARC file; kind is filedesc for the file's description."""

    at: int
    version: int
    fields: dict[str, str]
    block: bytes
    truncated: bool


def opened(content: bytes | memoryview) -> io.BufferedIOBase:
    """The bytes of a file as a stream, unpacked if they are packed, whole or record by record."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if bytes(content[:2]) == b"\x1f\x8b" else raw


def arc_records(content: bytes | memoryview) -> Iterator[Record]:
    """The records of an ARC file, its description first."""
    stream, at, version = opened(content), 0, None
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip(b"\r\n"):
            continue
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with its description")
            block = stream.read(int(line.rsplit(b" ", 1)[1]))
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            names = FIELDS[version].split()
            values = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
        else:
            # A URL of an old file may hold spaces; the other fields do not.
            values = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
            if len(values) != len(names) or not values[-1].isdigit():
                raise ValueError(f"no header line of version {version} at {start}")
            block = stream.read(int(values[-1]))
        at += len(block)
        fields = {n: v.decode("utf-8", "surrogateescape") for n, v in zip(names, values, strict=True)}
        yield Record(start, version, fields, block, len(block) < int(values[-1]))


def iso_date(digits: str) -> str:
    """2024-01-02T03:04:05Z of the 14 digits of an ARC date, or of the fewer ones of older files."""
    d = "".join(c for c in digits if c in "0123456789")[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str, record: Record) -> str:
    f = record.fields
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([name, str(record.at), f['URL'], f['Archive-date']]).encode('utf-8', 'surrogateescape').hex())}"


def kind_of(record: Record) -> str:
    if record.at == 0 and record.fields["URL"].startswith("filedesc://"):
        return "warcinfo"
    return "response" if record.block.startswith(b"HTTP/") or record.fields["URL"].startswith("dns:") else "resource"


def split(kind: str, block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, with the empty line, and its payload."""
    if kind != "response" or not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def page_of(head: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id: *(-?\d+) *\r?$", head)
    return int(found[1]) if found else None


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of each file."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("name")[i].as_py(), memoryview(batch.column("content")[i].as_buffer())


def write_arc(pages: DataFrame, folder: str, captured: str = "20240101000000", origin: str = "recollect") -> None:
    """Pages (page_id, url, html) as packed ARC files."""
    url = F.when(F.coalesce(F.length("url"), F.lit(0)) > 0, F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")).otherwise("about:blank")
    payload = F.coalesce("html", F.lit(""))
    own = F.coalesce(F.concat(F.lit(f"{PAGE}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), own, F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    name = F.concat(F.lit("part-"), F.spark_partition_id().cast("string"), F.lit(".arc"))
    second = F.spark_partition_id() % 2 == 1

    def line(uri: Column, ip: str, mime: str, length: Column) -> Column:
        more = F.when(second, F.concat(F.lit(" 200 - - 0 "), name)).otherwise("")
        return F.concat(uri, F.lit(f" {ip} {captured} {mime}"), more, F.lit(" "), length.cast("string"), F.lit("\n"))

    about = F.when(second, f"2 0 {origin}\n{FIELDS[2]}\n").otherwise(f"1 0 {origin}\n{FIELDS[1]}\n")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    described = F.when(first, F.concat(line(F.concat(F.lit("filedesc://"), name), "0.0.0.0", "text/plain", F.octet_length(about)), about, F.lit("\n"))).otherwise("")
    rows = pages.select(url.alias("url"), payload.alias("payload"), "page_id").withColumn("head", head)
    rows.select(F.concat(described, line(F.col("url"), "0.0.0.0", "text/html", F.octet_length("head") + F.octet_length("payload")), "head", "payload").alias("value")).write.options(**PACKED).option("lineSep", "\n").text(folder)


INDEX = "name string, at long, id string, page_id long, uri string, date string, key binary, size long"


def index(arcs: DataFrame) -> DataFrame:
    """The responses of ARC files by place, with the SHA-256 of their payload."""
    schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("key", pa.binary()), ("size", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, content in _contents(batches):
            for r in arc_records(content):
                if kind_of(r) == "response" and not r.truncated:
                    head, payload = split("response", r.block)
                    uri = r.fields["URL"].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    yield name, r.at, record_id(name, r), page_of(head), uri, iso_date(r.fields["Archive-date"]), hashlib.sha256(payload).digest(), len(payload)

    return arcs.mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: 300), INDEX)


def revisits(found: DataFrame, least: int = 0) -> DataFrame:
    """(name, at, to, to_uri, to_date) of the responses whose payload, of least bytes or more, another one keeps."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "name", "at", "id", "uri", "date")
    firsts = written(found.where(F.col("size") >= least).groupBy("key").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f"))
    rows = found.where(F.col("size") >= least).join(firsts, "key").where("name <> f.name or at <> f.at")
    return rows.select("name", "at", F.col("f.id").alias("to"), F.col("f.uri").alias("to_uri"), F.col("f.date").alias("to_date"))


RECORDS = "name string, at long, kind string, common string, mime string, head binary, payload binary, block_digest string, head_digest string"


def records(arcs: DataFrame) -> DataFrame:
    """All records of ARC files: what a WARC header says whatever the type, and the block in two parts."""
    schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("common", pa.binary()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("block_digest", pa.string()), ("head_digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, content in _contents(batches):
            info = ""
            for r in arc_records(content):
                kind, own = kind_of(r), record_id(name, r)
                block, common = r.block, [f"WARC-Record-ID: <{own}>", f"WARC-Date: {iso_date(r.fields['Archive-date'])}"]
                if kind == "warcinfo":
                    info, mime = own, "application/warc-fields"
                    block = f"software: recollect\r\nformat: WARC File Format 1.1\r\nsource: ARC File Format {r.version}\r\n".encode()
                    common.append(f"WARC-Filename: {name}")
                else:
                    http = block.startswith(b"HTTP/")
                    mime = "application/http; msgtype=response" if http else "text/dns" if kind == "response" else r.fields["Content-type"]
                    common += [f"WARC-Target-URI: {r.fields['URL']}", f"WARC-IP-Address: {r.fields['IP-address']}", f"WARC-Warcinfo-ID: <{info}>"]
                head, payload = split(kind, block)
                if kind != "warcinfo":
                    common += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"{SIZE}: {len(payload)}"]
                if r.truncated:
                    common.append("WARC-Truncated: length")
                lines = "".join(f"{x}\r\n" for x in common).encode("utf-8", "surrogateescape")
                yield name, r.at, kind, lines, mime, head, payload, digest(block), digest(head)

    typed = schema.set(3, pa.field("common", pa.binary()))
    rows_as = RECORDS.replace("common string", "common binary")
    return arcs.mapInArrow(lambda batches: _batches(rows(batches), typed, lambda r: 400 + len(r[5]) + len(r[6])), rows_as)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = 0) -> None:
    """ARC files become WARC files; repeated payloads of least bytes or more become revisits."""
    arcs = files(spark, arc_folder)
    again = written(revisits(written(index(arcs)), least))
    rows = records(arcs).join(again, ["name", "at"], "left")
    repeated = F.col("to").isNotNull()
    length = F.octet_length("head") + F.when(repeated, 0).otherwise(F.octet_length("payload"))
    text = lambda *parts: F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts])
    refers = text(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <", F.col("to"), ">\r\nWARC-Refers-To-Target-URI: ", F.col("to_uri"), "\r\nWARC-Refers-To-Date: ", F.col("to_date"), "\r\n")
    nothing = F.lit("").cast("binary")
    whole = text(
        "WARC/1.1\r\nWARC-Type: ", F.when(repeated, "revisit").otherwise(F.col("kind")), "\r\n", F.col("common"), F.when(repeated, refers).otherwise(nothing),
        "WARC-Block-Digest: sha1:", F.when(repeated, F.col("head_digest")).otherwise(F.col("block_digest")), "\r\nContent-Type: ", F.col("mime"), "\r\nContent-Length: ", length.cast("string"), "\r\n\r\n",
        F.col("head"), F.when(repeated, nothing).otherwise(F.col("payload")),
    )
    rows.select(whole.cast("string").alias("value")).write.options(**PACKED).option("lineSep", "\r\n\r\n").text(warc_folder)


def warc_records(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file; fields by their name in lower case."""
    stream = opened(content)
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        fields = {"version": line.strip().decode()}
        while (line := stream.readline()).strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            raise ValueError(f"the block of {fields.get('warc-record-id')} is not what its header says")
        yield fields, block


WARC = "id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of WARC files but warcinfo: their header's ids, types and dates, and size and digest of the whole payload."""
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in WARC.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, content in _contents(batches):
            for fields, block in warc_records(content):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, payload = split("response" if kind in ("response", "revisit") else kind, block)
                size, found = len(payload), digest(payload)
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "revisit":
                    size, found = int(fields[SIZE.lower()]), stated
                elif stated and stated != found:
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")
                refers = fields.get("warc-refers-to")
                uri = fields.get("warc-target-uri", "").encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                yield fields["warc-record-id"].strip("<>"), kind, uri, fields["warc-date"], page_of(head), size, found, refers and refers.strip("<>")

    return files(spark, folder).mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: 300), WARC)


def digests(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from the WARC files that its ARC record became."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", least)
    found = written(read_warc(spark, f"{folder}/warc"))
    kept = found.where("record_type <> 'revisit'").select(F.col("id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    repeated = found.where("record_type = 'revisit'").join(kept, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(repeated.select(*columns))
