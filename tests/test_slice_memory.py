"""What a task holds for a slice of an index, and that an index starts no Python workers but those of its slices."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from recollect.operators import index


@pytest.mark.parametrize("each", [7, 500])
def test_a_slice_takes_few_bytes_a_term(monkeypatch, each):
    monkeypatch.setattr(index, "PIECE", 1 << 12)
    n, random = 1 << 18, np.random.default_rng(3)
    words = random.integers(0, 5000, n)
    own = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, n, each), n), pa.int32()), pa.array(words.astype(str)))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)).astype(str)), own], names=["id", "own"])]
    tracemalloc.start()
    places = sum(len(b.column("places").flatten().flatten()) for b in index._sliced(iter(batches), 0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places == n and most < 19 * n


def test_both():
    random = np.random.default_rng(5)
    for a, b in ((0, 9), (9, 0), (1, 50), (50, 1), (40, 60)):
        a, b = (np.unique(random.integers(0, 80, k)) for k in (a, b))
        assert index._both(a, b).tolist() == np.intersect1d(a, b).tolist()


def test_no_workers_for_manifests(spark, tmp_path, monkeypatch):
    memories = spark.createDataFrame([("1", "to be or"), ("2", "or to be"), ("3", None)], "id string, text string")

    def refused(*_, **__):
        raise AssertionError("starts Python workers")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    folder = str(tmp_path / "index")
    index.create(spark, folder)
    assert index.version(spark, folder).segments == () and index.ask(index.version(spark, folder), "be").isEmpty()
    v = index.add(memories, folder)
    v = index.forget(memories.where("id = '2'").select("id"), v.folder)
    assert [s[1:] for s in v.segments] == [(3, 12, 2)] and [r["id"] for r in index.ask(v, "to-be").collect()] == ["1"]
