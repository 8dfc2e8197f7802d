"""Slices of an index are made in little memory: small batches in and out, and nothing of a batch waits for its slice."""

from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.operators import index
from recollect.session import small_batches

TEXTS = [["a", "b", "a"], None, [], ["c"], ["b"] * 9, [], ["é", "a"], None, [], [], [], []]


def batches(texts, most):
    for i in range(0, len(texts), most):
        part = texts[i : i + most]
        yield pa.RecordBatch.from_arrays([pa.array([str(i + n) for n in range(len(part))]), pa.array(part, pa.list_(pa.string()))], names=["id", "own"])


@pytest.mark.parametrize("most", [1, 5, 100])
def test_slices(monkeypatch, most):
    monkeypatch.setattr(index, "SLICE", 8)
    monkeypatch.setattr(index, "PIECE", 3)
    slices, found = {}, defaultdict(list)
    for batch in index._sliced(batches(TEXTS, most), 7):
        rows = batch.to_pylist()
        assert len(rows) == 1 or sum(len(p) for r in rows for p in r["places"]) <= 3
        for r in rows:
            if r["term"] == index.ALL:
                slices[r["slice"]] = list(zip(r["ids"], r["sizes"], strict=True))
                assert r["ords"] is None and r["places"] is None
            else:
                found[r["slice"]].append(r)
    assert sorted(slices) == list(range(7, 7 + len(slices)))
    every = [m for n in sorted(slices) for m in slices[n]]
    assert every == [(str(i), None if x is None else 2 * len(x)) for i, x in enumerate(TEXTS)]
    # Texts without terms end a slice too.
    assert all(len(s) == 1 or len(s) + sum(z or 0 for _, z in s) / 2 <= 8 for s in slices.values())
    got = {(r["term"], slices[n][o][0], tuple(p)) for n, rows in found.items() for r in rows for o, p in zip(r["ords"], r["places"], strict=True)}
    assert got == {(w, str(i), tuple(k for k, v in enumerate(x) if v == w)) for i, x in enumerate(TEXTS) for w in x or []}
    assert all(len({r["term"] for r in rows}) == len(rows) and all(r["ords"] == sorted(r["ords"]) for r in rows) for rows in found.values())


def test_nothing_of_a_batch_waits():
    words = [f"{n}-" + "x" * 1000 for n in range(10)]
    sizes, before = [], pa.total_allocated_bytes()

    def seen():
        for batch in batches([words] * 3000, 100):
            sizes.append(pa.total_allocated_bytes() - before)
            yield batch
            del batch

    rows = sum(b.num_rows for b in index._sliced(seen(), 0))
    assert rows == 11 and len(sizes) == 30 and max(sizes) < 5_000_000  # 30 MB in all, 1 MB a batch


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    measured = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long")
    with small_batches(spark, "64k"):
        sizes = [r["n"] for r in measured.select("*").collect()]
    assert len(sizes) > 5 and max(sizes) < 140_000 and spark.conf.get(name) == before
