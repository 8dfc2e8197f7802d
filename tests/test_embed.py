"""Embedding and indexing: failures row by row, duplicates, erased hashes, and the last vector of an id."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import embed


def made():
    def model(texts):
        if any("down" in x for x in texts):
            raise TimeoutError("ETIMEDOUT")
        return [[float(len(x)), 1.0] if "short" not in x else [1.0] for x in texts]

    return model


model = made()


def test_deterministic_vector(spark):
    for words in ("", "a text é😀"):
        b = hashlib.sha256(words.encode()).digest()
        want = [np.float32((b[i % 32] * 256 + b[(i + 1) % 32]) / 32767.5 - 1) for i in range(70)]
        assert spark.createDataFrame([(words,)], "t string").select(embed.deterministic_vector(F.col("t"), 70).alias("v")).first()["v"] == pytest.approx(want, abs=1e-7)


def test_failures_are_those_of_their_rows(spark):
    rows = [(i, x) for i, x in enumerate(["one", "down", "short", None, "word " * 100_000])]
    got = {r["ord"]: r for r in embed.embedded(spark.createDataFrame(rows, "ord long, text string").coalesce(1), model, 2).collect()}
    assert got[0]["embedding"] == [3.0, 1.0] and got[3]["embedding"] == [0.0, 1.0] and got[4]["embedding"] == [500_000.0, 1.0]
    assert got[1]["error"] == "TimeoutError: ETIMEDOUT" and "1 dimensions" in got[2]["error"] and got[1]["embedding"] is got[2]["embedding"] is None


def test_embed_and_index(spark):
    new = spark.createDataFrame([(1, "a", "h1"), (2, "again a", "h1"), (3, "b", "old"), (4, "c", "gone"), (5, "down", "h5"), (6, "short", "h6"), (7, "d", "h7")], "ord long, text string, hash string")
    memories = spark.createDataFrame([("m1", "old"), ("m2", "other")], "id string, hash string")
    erased = spark.createDataFrame([("gone",), ("gone",)], "hash string")
    done = embed.embed_and_index(new, memories, erased, model, 2)
    assert sorted(map(tuple, done.results.collect())) == [(1, "h1", True), (2, "h1", False), (3, "m1", False), (7, "h7", True)]
    assert sorted((r["id"], r["text"], r["embedding_dim"]) for r in done.memories.collect()) == [("h1", "a", 2), ("h7", "d", 2)]
    assert sorted(map(tuple, done.events.collect())) == [("h1", "create", "h1"), ("h7", "create", "h7")]
    assert {r["id"]: r["embedding"] for r in done.vectors.collect()} == {"h1": [7.0, 1.0], "m1": [1.0, 1.0], "h7": [1.0, 1.0]}
    assert sorted((r["ord"], r["kind"]) for r in done.failures.collect()) == [(5, "transient"), (6, "deterministic")]
    assert embed.embed_and_index(new.where("false"), memories, erased, model, 2).results.collect() == []


def test_the_last_vector_of_an_id_wins(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id long, embedding array<float>")
    new = spark.createDataFrame([(1, 1, [9.0, 0.0]), (1, 2, [3.0, 0.0]), (1, 3, [1.0]), (5, 4, [1.0, 1.0]), (2, 5, None)], "id long, ord long, embedding array<float>")
    assert {r["id"]: (r["embedding"], r["how"]) for r in embed.upserted(vectors, new, 2).collect()} == {1: ([3.0, 0.0], "replaced"), 2: ([1.0, 1.0], "kept")}
    assert {r["ord"]: r["outcome"] for r in embed.upsert_outcomes(vectors, new, 2).collect()} == {1: "replaced later", 2: "stored", 3: "wrong size", 4: "unknown id", 5: "wrong size"}
