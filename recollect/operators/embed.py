"""Embedding of new memories and their way into memories, events and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions import scoring
from recollect.session import written

#: Texts, and bytes of them, that a model is given at once.
AT_ONCE, BYTES = 256, 1 << 20

Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def deterministic_vector(text: Column, size: int = 1024) -> Column:
    """A vector for tests from the text's SHA-256: each component from two of its bytes, which repeat, within -1 and 1."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    of = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    vector = lambda b: F.transform(places, lambda i: ((F.get(b, i % 32) * 256 + F.get(b, (i + 1) % 32)) / 32767.5 - 1).cast("float"))
    return F.get(F.transform(F.array(of), vector), F.lit(0))  # so that the hash is worked out once


def _small(batches: Iterator[pa.RecordBatch], text: str, rows_at_once: int, bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows and bytes of text, so that texts and vectors of few rows are Python objects at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bytes_at_once, "right"))
            to = min(max(to, at + 1), at + rows_at_once)
            yield batch.slice(at, to - at)
            at = to


def embedded(rows: DataFrame, embed: Embed, size: int, text: str = "text") -> DataFrame:
    """Adds embedding and error: `embed` takes up to AT_ONCE texts at once, of BYTES in all but for a single one. Where it raises, the batch's texts go one by one, so that an error is that of its row; a vector of another size is one too. A null text is empty."""

    rows_at_once, bytes_at_once = AT_ONCE, BYTES

    def one(given: str) -> tuple[list[float] | None, str | None]:
        try:
            return _sized(embed([given])[0])
        except Exception as error:  # noqa: BLE001  whatever the model's client raises belongs to the row
            return None, f"{type(error).__name__}: {error}"

    def _sized(vector: Sequence[float] | None) -> tuple[list[float] | None, str | None]:
        n = 0 if vector is None else len(vector)
        return (np.asarray(vector, np.float32).tolist(), None) if n == size else (None, f"schema: {n} dimensions in place of {size}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, text, rows_at_once, bytes_at_once):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            try:
                vectors = list(embed(texts))
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                found = [_sized(v) for v in vectors]
            except Exception:  # noqa: BLE001
                found = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], names=[*batch.schema.names, "embedding", "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))


@dataclass(frozen=True)
class Indexed:
    """What embed_and_index() adds: results (ord, id, created), memories, events (atom_id, event_type, content_hash), vectors (id, embedding), failures (ord, error, kind)."""

    results: DataFrame
    memories: DataFrame
    events: DataFrame
    vectors: DataFrame
    failures: DataFrame


def embed_and_index(new: DataFrame, memories: DataFrame, erased: DataFrame, embed: Embed, size: int, model: str = "model") -> Indexed:
    """New memories (ord, text, hash, ...) get vectors and go in, each hash once: the first of its ord makes the row and its create event, the others name it, as does
    a hash that memories (id, hash) has. Erased hashes (hash) stay away without a result. A failed text leaves no row; its error is classified. An id is the start of its hash."""
    wanted = new.join(erased.select("hash").distinct(), "hash", "left_anti")
    tried = written(embedded(wanted, embed, size))
    good = tried.where("error is null")
    known = memories.groupBy("hash").agg(F.min("id").alias("known"))
    first = good.groupBy("hash").agg(F.min("ord").alias("first"))
    last = good.groupBy("hash").agg(F.max_by("embedding", "ord").alias("embedding"))
    own = F.coalesce("known", F.substring("hash", 1, 32))
    rows = good.drop("embedding", "error").join(first, "hash").join(known, "hash", "left")
    created = F.col("known").isNull() & (F.col("ord") == F.col("first"))
    results = rows.select("ord", own.alias("id"), created.alias("created"))
    made = rows.where(created).select(own.alias("id"), *[c for c in new.columns if c != "ord"], F.lit(model).alias("embedding_model"), F.lit(size).alias("embedding_dim"))
    events = made.select(F.col("id").alias("atom_id"), F.lit("create").alias("event_type"), F.col("hash").alias("content_hash"))
    vectors = last.join(known, "hash", "left").select(own.alias("id"), "embedding")
    failures = tried.where("error is not null").select("ord", "error", scoring.classify_error(F.col("error")).alias("kind"))
    return Indexed(results, made, events, vectors, failures)


def upsert_outcomes(vectors: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """new (id, ord, embedding) with outcome: stored, replaced later (a later good one has its id), wrong size or unknown id. Null vectors have a wrong size."""
    known = vectors.select("id", F.lit(True).alias("known")).distinct()
    good = F.coalesce(F.size("embedding") == size, F.lit(False))
    last = new.where(good).groupBy("id").agg(F.max("ord").alias("last"))
    outcome = F.when(F.col("known").isNull(), "unknown id").when(~good, "wrong size").when(F.col("ord") < F.col("last"), "replaced later").otherwise("stored")
    return new.join(known, "id", "left").join(last, "id", "left").select("id", "ord", "embedding", outcome.alias("outcome"))


def upserted(vectors: DataFrame, new: DataFrame, size: int) -> DataFrame:
    """The vectors after an upsert, and how each came about: the last good one of an id wins."""
    stored = upsert_outcomes(vectors, new, size).where("outcome = 'stored'").groupBy("id").agg(F.max("embedding").alias("new"))
    return vectors.join(stored, "id", "left").select("id", F.coalesce("new", "embedding").alias("embedding"), F.when(F.col("new").isNotNull(), "replaced").otherwise("kept").alias("how"))
