"""A kept inverted index with positions: segments of postings in a folder, asked without the texts.

A segment is written once: for each slice of the corpus rows (term, ords, places) with the numbers of the memories that have the term and its
places in each, in folders by segment and by bucket, a hash of the term, sorted by term, and dealt by term and slice, so that a frequent term lies in many files. The
empty term has the ids and sizes of a slice's memories in the order of their numbers. What counts is what the newest manifest
names: a job that ends early leaves files that nobody reads. Removed memories are named in a table of their own until
their segments are merged. One writer at a time; readers keep the version that they began with.

A memory counts twice, once as it is and once normalised, so sizes and frequencies double. A null text has no terms and no size.
Ids must be new in `add`; `replace` removes older rows of its ids first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recollect.batches import groups
from recollect.functions import text
from recollect.session import shuffles_deleted, small_batches, written

#: Folders of a segment's postings; as many terms of a question go into the scan's filter, more are joined; terms of a slice; tasks that a bucket's rows are dealt to at least; places of a batch that a task gives back.
BUCKETS, LITERALS, SLICE, DEALT, PIECE = 32, 500, 1 << 21, 8, 1 << 17
ALL = ""
ROW = "term string, slice long, ords array<int>, places array<array<int>>, ids array<string>, sizes array<long>"
NAMES = [f.split()[0] for f in ROW.split(", ")]
MANIFEST = "segment long, n long, total long, sized long"
#: Stands in every manifest, so that one without segments has a row.
NONE = (0, 0, 0, 0)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The same on the driver."""
    spark = SparkSession.active()
    return spark.range(1).select(bucket(F.lit(term))).first()[0]


@dataclass(frozen=True)
class Version:
    """What a manifest names: the segments that count, and their sums."""

    spark: SparkSession
    folder: str
    number: int
    segments: tuple[tuple[int, int, int, int], ...]

    @property
    def live(self) -> list[int]:
        return [s[0] for s in self.segments]

    def _rows(self) -> DataFrame:
        schema = f"{ROW}, segment long, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/postings").parquet(*[f"{self.folder}/postings/segment={s}" for s in self.live])

    def gone(self) -> DataFrame:
        """(id, segment, size) of removed memories in segments that count."""
        rows = self.spark.read.schema("id string, segment long, size long, version long").parquet(f"{self.folder}/gone")
        return rows.where((F.col("version") <= self.number) & F.col("segment").isin(self.live)).select("id", "segment", "size")

    def sizes(self) -> DataFrame:
        """(id, segment, size) of the memories in the index."""
        return self.members().select("id", "segment", "size").join(self.gone().select("id", "segment"), ["id", "segment"], "left_anti")

    def _slices(self) -> DataFrame:
        """(segment, slice, ids, sizes) of all slices."""
        return self._rows().where((F.col("bucket") == bucket_of(ALL)) & (F.col("term") == ALL)).select("segment", "slice", "ids", "sizes")

    def _each(self, rows: DataFrame, *more: str) -> DataFrame:
        """A row for each memory, without those that were removed."""
        named = rows.select(*more, "segment", "slice", "ords", "places").join(self._slices(), ["segment", "slice"])
        each = named.select(*more, "segment", F.inline(F.transform(F.arrays_zip("ords", "places"), lambda x: F.struct(F.get("ids", x["ords"]).alias("id"), F.get("sizes", x["ords"]).alias("size"), x["places"].alias("places")))))
        return each.join(self.gone().select("id", "segment"), ["id", "segment"], "left_anti")

    def _of(self, terms: DataFrame) -> DataFrame:
        """The rows of the terms (term): a few are filtered in the scan, by their buckets and themselves."""
        wanted = terms.select("term", bucket(F.col("term")).alias("bucket")).distinct()
        few = wanted.limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            return self._rows().where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin([r["term"] for r in few]))
        return self._rows().join(wanted, ["bucket", "term"], "left_semi")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, id, size, places) of all terms or of a table (term) of them."""
        rows = self._rows() if terms is None else self._of(terms)
        return self._each(rows.where(F.col("term") != ALL), "term").select("term", "id", "size", "places")

    def places(self, asked: DataFrame) -> DataFrame:
        """asked (term, ...) with segment, slice, ords and places of each slice that has its term, and dead, the numbers of removed memories there."""
        rows = self._of(asked).select("term", "segment", "slice", "ords", "places").join(asked, "term")
        if self.gone().isEmpty():
            return rows.withColumn("dead", F.lit(None).cast("array<int>"))
        dead = self._dead()
        return rows.join(dead, ["segment", "slice"], "left")

    def members(self) -> DataFrame:
        """(segment, slice, ord, id, size): the memories by their numbers, removed ones too."""
        each = self._slices().select("segment", "slice", F.posexplode(F.arrays_zip("ids", "sizes")).alias("ord", "d"))
        return each.select("segment", "slice", "ord", F.col("d.ids").alias("id"), F.col("d.sizes").alias("size")).where("id is not null")

    def blocks(self) -> DataFrame:
        """The rows of the index; where something was removed, without it: its id is null in its slice, and its places go."""
        rows = self._rows().select(*NAMES, "segment")
        # Slices of several segments go into one, so their numbers must differ.
        number = F.xxhash64("segment", "slice").alias("slice")
        if self.gone().isEmpty():
            return rows.select(*[number if n == "slice" else n for n in NAMES])
        # A mark for each memory of a slice only, so that the rows themselves need not travel for them where slices are few.
        each = self._slices().select("segment", "slice", F.posexplode("ids").alias("ord", "id")).join(self.gone().select("id", "segment", F.lit(True).alias("gone")), ["id", "segment"], "left")
        marks = each.groupBy("segment", "slice").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("gone").isNull().alias("live"))))["live"].alias("live"))
        both = rows.join(written(marks), ["segment", "slice"])
        stay = F.filter(F.arrays_zip("ords", "places"), lambda x: F.get("live", x["ords"]))
        both = both.withColumn("stay", stay).where(F.col("stay").isNull() | (F.size("stay") > 0))
        kept = lambda name: F.transform(name, lambda x, at: F.when(F.get("live", at), x))
        return both.select("term", number, F.col("stay.ords").alias("ords"), F.col("stay.places").alias("places"), kept("ids").alias("ids"), kept("sizes").alias("sizes"))

    def _dead(self) -> DataFrame:
        """(segment, slice, dead): the numbers of the removed memories of slices that have any."""
        return self.members().join(self.gone().select("id", "segment"), ["id", "segment"], "left_semi").groupBy("segment", "slice").agg(F.sort_array(F.collect_list("ord")).alias("dead"))

    def corpus(self) -> DataFrame:
        """One row: n, the number of memories, and mean, their mean size."""
        n, total, sized = (sum(s[i] for s in self.segments) for i in (1, 2, 3))
        gone = self.gone().agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("size").alias("sized"))
        return gone.select((n - F.col("n")).alias("n"), ((total - F.col("total")) / F.nullif(sized - F.col("sized"), F.lit(0))).alias("mean"))


def create(spark: SparkSession, folder: str) -> None:
    """An empty index."""
    spark.range(1).select(F.lit("").alias("id"), F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("size")).where("false").write.parquet(f"{folder}/gone/version=0")
    _publish(spark, folder, 0, ())


def _publish(spark: SparkSession, folder: str, number: int, segments: tuple) -> None:
    # createDataFrame() would start Python workers, which stay beside those of the slices.
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    rows = [F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(names, row, strict=True)]) for row in (NONE, *segments)]
    spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))).write.parquet(f"{folder}/manifest/version={number}")


def version(spark: SparkSession, folder: str) -> Version:
    """The newest version of an index."""
    rows = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{folder}/manifest")
    number = rows.agg(F.max("version")).first()[0]
    segments = rows.where(F.col("version") == number).where("segment > 0").orderBy("segment").collect()
    return Version(spark, folder, number, tuple(tuple(r)[:4] for r in segments))


def _next(v: Version) -> int:
    return max([v.number, *v.live]) + 1


def _write(blocks: DataFrame, folder: str, segment: int) -> tuple[int, int, int, int]:
    """Rows dealt by bucket and slice: each task writes few folders, and a frequent term has many tasks."""
    spark = blocks.sparkSession
    path = f"{folder}/postings/segment={segment}"
    rows = blocks.select(*NAMES, bucket(F.col("term")).alias("bucket"))
    with shuffles_deleted(spark), small_batches(spark):
        rows.repartition("bucket", F.pmod(F.xxhash64("slice"), F.lit(DEALT))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    every = spark.read.schema(f"{ROW}, bucket int").parquet(path).where((F.col("bucket") == bucket_of(ALL)) & (F.col("term") == ALL))
    sizes = every.select(F.inline(F.arrays_zip("ids", "sizes"))).where("ids is not null")
    return (segment, *sizes.agg(F.count("*"), F.coalesce(F.sum("sizes"), F.lit(0)), F.count("sizes")).first())


def sliced(memories: DataFrame) -> DataFrame:
    """The rows of memories (id, text): the places of each term in slices of about SLICE terms, put together before anything travels."""
    rows = memories.select(F.col("id").cast("string").alias("id"), text.terms(F.col("text")).alias("own"))

    return rows.mapInArrow(lambda batches: _sliced(batches, TaskContext.get().partitionId() << 32), ROW)


def _sliced(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """The slices of a task's texts, from that number on. What waits for its slice are codes of terms, not the terms, and nothing of a batch that came."""
    held, n = [], 0
    for batch in batches:
        at, own = 0, batch.column("own")
        # A memory counts as one term more, so that texts without terms end a slice too.
        ends = np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy() + 1)
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE - n, "right")))
            part = own.slice(at, to - at)
            held.append((batch.column("id").take(pa.array(np.arange(at, to))), pc.list_value_length(part), part.flatten().dictionary_encode()))
            n += int(ends[to - 1]) - before
            at = to
            if n >= SLICE:
                yield from _slice(held, number)
                n, number = 0, number + 1
                pa.default_memory_pool().release_unused()
    if held:
        yield from _slice(held, number)
        pa.default_memory_pool().release_unused()


def _rows(terms: pa.Array, number: int, **lists: pa.Array) -> pa.RecordBatch:
    """Rows of a slice; lists that are not given are null."""
    n = len(terms)
    kinds = {"ords": pa.int32(), "places": pa.list_(pa.int32()), "ids": pa.string(), "sizes": pa.int64()}
    return pa.RecordBatch.from_arrays([terms, pa.array(np.full(n, number)), *[lists[k] if k in lists else pa.nulls(n, pa.list_(t)) for k, t in kinds.items()]], names=NAMES)


def _slice(held: list[tuple[pa.Array, pa.Array, pa.DictionaryArray]], number: int) -> Iterator[pa.RecordBatch]:
    """The rows of one slice, about PIECE places in a batch; empties held. Of the whole slice there is one sorted number for each place, all else is made for a batch."""
    ids, lengths = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    terms = pa.chunked_array([h[2] for h in held]).unify_dictionaries()
    held.clear()
    keys, at = np.empty(len(terms), np.int64), 0
    for chunk in terms.chunks:
        keys[at : at + len(chunk)] = chunk.indices
        at += len(chunk)
    names = terms.chunk(0).dictionary
    del terms, chunk
    edges = np.append(0, np.cumsum(np.bincount(keys, minlength=len(names))))
    # By term and then by place in the slice.
    keys <<= 32
    keys |= np.arange(len(keys), dtype=np.int32)
    keys.sort()
    counts = pc.fill_null(lengths, 0).to_numpy()
    ends = np.cumsum(counts)
    begins = ends - counts
    first = 0
    while first < len(names):
        low = edges[first]
        to = max(first + 1, int(np.searchsorted(edges, low + PIECE, "right")) - 1)
        at = keys[low : edges[to]] & 0xFFFFFFFF
        doc = np.searchsorted(ends, at, "right").astype(np.int32)
        at -= begins[doc]
        own = edges[first:to] - low
        new = np.ones(len(at), bool)
        new[1:] = doc[1:] != doc[:-1]
        new[own] = True
        docs = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(docs, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
        each = pa.array(np.append(np.searchsorted(docs, own), len(docs)).astype(np.int32))
        yield _rows(names.slice(first, to - first), number, ords=pa.ListArray.from_arrays(each, pa.array(doc[docs])), places=pa.ListArray.from_arrays(each, places))
        first = to
    whole = pa.array([0, len(ids)], pa.int32())
    yield _rows(pa.array([ALL]), number, ids=pa.ListArray.from_arrays(whole, ids), sizes=pa.ListArray.from_arrays(whole, pc.multiply(lengths.cast(pa.int64()), 2)))


def add(memories: DataFrame, folder: str) -> Version:
    """Memories (id, text) as a new segment."""
    spark = memories.sparkSession
    v = version(spark, folder)
    segment = _write(sliced(memories), folder, _next(v))
    _publish(spark, folder, segment[0], (*v.segments, segment))
    return version(spark, folder)


def forget(ids: DataFrame, folder: str) -> Version:
    """Remove the memories (id) from the index; ids that it does not have change nothing."""
    spark = ids.sparkSession
    v = version(spark, folder)
    if not v.segments:
        return v
    number = _next(v)
    v.sizes().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").write.parquet(f"{folder}/gone/version={number}")
    _publish(spark, folder, number, v.segments)
    return version(spark, folder)


def replace(memories: DataFrame, folder: str) -> Version:
    """Memories (id, text) in place of older rows with their ids."""
    forget(memories.select("id"), folder)
    return add(memories, folder)


def merge(spark: SparkSession, folder: str, segments: list[int] | None = None) -> Version:
    """One segment in place of several (all of them, if none are named), without what was removed."""
    v = version(spark, folder)
    chosen = set(segments if segments is not None else v.live)
    old = Version(spark, folder, v.number, tuple(s for s in v.segments if s[0] in chosen))
    if not old.segments:
        return v
    merged = _write(old.blocks(), folder, _next(v))
    _publish(spark, folder, merged[0], (*[s for s in v.segments if s[0] not in chosen], merged))
    return version(spark, folder)


MATCHED = "query {0}, phrase int, segment long, slice long, ord int, times long"
#: Where a place may lie before the beginning of a text, less the term's place in its phrase.
BEFORE = 1 << 20


def _starts(table: pa.Table) -> np.ndarray:
    """Sorted numbers of (memory, place at which the phrase would begin) of one term of a phrase."""
    ords, places = (table.column(c).combine_chunks() for c in ("ords", "places"))
    ords, places = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ords, places))
    lists = places.flatten()
    doc = np.repeat(ords.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
    return (doc.astype(np.int64) << 32) + lists.flatten().to_numpy() + BEFORE - table.column("offset")[0].as_py()


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What is in both of two sorted arrays without copies, by looking up the shorter one."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return few
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return few[many[at] == few]


def _matched(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of each query and slice: how many memories have each phrase (ord -1), and the memories that have all, with the times of each."""
    for table in groups(batches, ["query", "segment", "slice"]):
        dead = table.column("dead")[0].as_py() or []
        phrase, offset = table.column("phrase").to_numpy(), table.column("offset").to_numpy()
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in np.unique(phrase).tolist():
            own = [table.take(np.flatnonzero((phrase == p) & (offset == o))) for o in np.unique(offset[phrase == p])]
            if len(own) < own[0].column("words")[0].as_py():
                continue
            starts = _starts(own[0])
            for more in own[1:]:
                starts = _both(starts, _starts(more))
            doc, times = np.unique(starts >> 32, return_counts=True)
            alive = ~np.isin(doc, dead)
            if alive.any():
                found[p] = (doc[alive], times[alive])
        rows = [(p, np.array([-1]), np.array([len(doc)])) for p, (doc, _) in found.items()]
        if found and len(found) == table.column("wanted")[0].as_py():
            both = reduce(np.intersect1d, [doc for doc, _ in found.values()])
            rows += [(p, both, times[np.searchsorted(doc, both)]) for p, (doc, times) in found.items()]
        if rows:
            n = sum(len(x[1]) for x in rows)
            same = [pa.array([table.column(c)[0].as_py()] * n, t) for c, t in (("query", kind), ("segment", pa.int64()), ("slice", pa.int64()))]
            ord_, times = (np.concatenate([x[i] for x in rows]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([same[0], pa.array(np.repeat([x[0] for x in rows], [len(x[1]) for x in rows]).astype(np.int32)), same[1], same[2], pa.array(ord_.astype(np.int32)), pa.array(times.astype(np.int64))], names=["query", "phrase", "segment", "slice", "ord", "times"])


def scores(index: Version, queries: DataFrame) -> DataFrame:
    """(query, id, bm25) of the memories with every white-space part of a query (query, body) as a phrase; lower is better.

    A part of several terms is a phrase: the places of its terms, each less its own place in the part, are intersected, slice by slice, so
    that only numbers of phrases and the memories with all parts of a query travel on. query is a number or a string that names one row. Queries without terms give no rows."""
    if not index.segments:
        return queries.select("query", F.lit("").alias("id"), F.lit(0.0).alias("bm25")).where("false")
    parts = queries.select("query", F.posexplode(F.split(F.trim("body"), r"\s+")).alias("phrase", "part")).withColumn("own", text.terms(F.col("part"))).where(F.size("own") > 0)
    wanted = parts.groupBy("query").agg(F.count("*").alias("wanted"))
    asked = parts.select("query", "phrase", F.size("own").alias("words"), F.posexplode("own").alias("offset", "term")).join(wanted, "query")
    order = ["query", "segment", "slice"]
    rows = index.places(asked).select(*order, "phrase", "words", "offset", "wanted", "ords", "places", "dead").repartition(*order).sortWithinPartitions(*order)
    kind = queries.schema["query"].dataType
    arrow = to_arrow_type(kind)
    # Written, as the phrases' weights need all of it before the first score.
    with small_batches(queries.sparkSession):
        found = written(rows.mapInArrow(lambda batches: _matched(batches, arrow), MATCHED.format(kind.simpleString())))
    weights = found.where("ord < 0").groupBy("query", "phrase").agg(F.sum("times").alias("df")).crossJoin(F.broadcast(index.corpus()))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query", "phrase", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    f = 2 * F.col("times")
    part = F.col("idf") * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    hits = found.where("ord >= 0").join(index.members(), ["segment", "slice", "ord"]).join(weights, ["query", "phrase"])
    return hits.groupBy("query", "id").agg((-F.sum(part)).alias("bm25"))


def ask(index: Version, query: str) -> DataFrame:
    """(id, bm25) for one query."""
    return scores(index, index.spark.range(1).select(F.lit(0).alias("query"), F.lit(query).alias("body"))).select("id", "bm25")


def built(memories: DataFrame, folder: str, parts: list[Column]) -> Version:
    """A new index with a segment for the memories of each condition."""
    create(memories.sparkSession, folder)
    return reduce(lambda _, p: add(memories.where(p), folder), parts, version(memories.sparkSession, folder))
