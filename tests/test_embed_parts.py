"""A model is given few texts at once, however large Spark's batches are."""

from recollect.operators import embed


def test_parts(spark, monkeypatch):
    monkeypatch.setattr(embed, "BYTES", 100, raising=False)
    rows = [(i, None if i % 50 == 7 else "x" * (i % 60)) for i in range(1000)] + [(1000, "y" * 500)] + [(2000 + i, "") for i in range(600)]

    def model(texts):
        return [[float(len(texts)), float(sum(map(len, texts)))] for _ in texts]

    got = embed.embedded(spark.createDataFrame(rows, "ord long, text string").coalesce(1), model, 2).collect()
    assert [r["ord"] for r in got] == [i for i, _ in rows] and all(r["error"] is None for r in got)
    assert max(r["embedding"][0] for r in got) <= 256
    assert all(r["embedding"][1] <= 100 or r["embedding"][0] == 1 for r in got)
