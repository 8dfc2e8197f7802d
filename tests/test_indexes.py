"""Kept indexes against plain versions: segments that are added, removed and merged, and balls of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import index, neighbours, search

ROWS = [("1", "use sqlite-vec with sqlite here"), ("2", "vec then sqlite"), ("3", "SQLite vec, sqlite vec"), ("4", None), ("5", ""), ("6", "la la la"), ("7", "état-of-the-art " * 3), ("8", "word " * 5000 + "sqlite-vec")]
ASKED = [("a", "sqlite-vec"), ("b", "sqlite vec"), ("c", "  sqlite sqlite "), ("d", "-- ?"), ("e", "nowhere"), ("f", ""), ("g", "la-la"), ("h", "etat-of-the-art"), ("i", "word")]


def texts(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def asked(spark):
    return spark.createDataFrame(ASKED, "query string, body string")


def got(v, spark):
    return {(r["query"], r["id"], round(r["bm25"], 9)) for r in index.scores(v, asked(spark)).collect()}


def plain(spark, rows):
    return {(r["query"], r["id"], round(r["bm25"], 9)) for r in search.keyword_scores_of_all(texts(spark, rows), asked(spark)).collect()}


def test_segments(spark, tmp_path):
    folder = str(tmp_path / "index")
    index.create(spark, folder)
    assert got(index.version(spark, folder), spark) == set()
    first = index.add(texts(spark, ROWS[:3]), folder)
    assert got(first, spark) == plain(spark, ROWS[:3])
    v = index.add(texts(spark, ROWS[3:]), folder)
    assert len(v.live) == 2 and got(v, spark) == plain(spark, ROWS) and {q for q, _, _ in plain(spark, ROWS)} >= {"a", "b", "c", "g", "h", "i"}
    assert got(first, spark) == plain(spark, ROWS[:3])  # a reader keeps its version
    v = index.forget(texts(spark, [("3", ""), ("99", "")]), folder)
    rest = [r for r in ROWS if r[0] != "3"]
    assert got(v, spark) == plain(spark, rest)
    v = index.replace(texts(spark, [("3", "sqlite"), ("1", "la-la")]), folder)
    rest = [r for r in rest if r[0] != "1"] + [("3", "sqlite"), ("1", "la-la")]
    assert len(v.live) == 3 and got(v, spark) == plain(spark, rest)
    v = index.merge(spark, folder, v.live[1:])
    assert len(v.live) == 2 and got(v, spark) == plain(spark, rest)
    v = index.merge(spark, folder)
    assert len(v.live) == 1 and got(v, spark) == plain(spark, rest) and v.gone().count() == 0
    v = index.forget(texts(spark, rest), folder)
    assert got(v, spark) == set() and v.corpus().first()["n"] == 0


def test_a_job_that_ends_early_leaves_the_index_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "index")
    v = index.built(texts(spark, ROWS), folder, [F.lit(True)])
    (tmp_path / "index/postings/segment=2/bucket=0").mkdir(parents=True)
    (tmp_path / "index/postings/segment=2/bucket=0/part-0.parquet").write_bytes(b"half a file")
    assert index.version(spark, folder) == v and got(index.version(spark, folder), spark) == plain(spark, ROWS)


def test_plan_reads_no_texts_and_filters_in_the_scan(spark, tmp_path, capsys):
    v = index.built(texts(spark, ROWS), str(tmp_path / "index"), [F.col("id") < "4", F.col("id") >= "4"])
    v.postings(spark.createDataFrame([("sqlite",)], "term string")).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(term, [sqlite])" in plan or "EqualTo(term,sqlite)" in plan
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "LITERALS", 1)
    v = index.built(texts(spark, ROWS), str(tmp_path / "index"), [F.lit(True)])
    assert got(v, spark) == plain(spark, ROWS)


def test_an_index_without_places_refuses_phrases(spark):
    frame = texts(spark, ROWS)
    for body in ("sqlite-vec", "la la"):
        with pytest.raises(ValueError):
            search.indexed_scores(search.postings(frame), search.corpus(frame), body)


def plain_nearest(vectors, points, k):
    out = {}
    for q, p in points:
        d = sorted((round(float(np.sqrt(np.square(np.array(v, np.float32).astype(float) - np.array(p)).sum())), 9), i) for i, v in vectors if v is not None and len(v) == len(p))
        out |= {(q, place + 1): (i, x) for place, (x, i) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize(("spread", "most"), [(0.2, 0.2), (30.0, 1.0)])
def test_nearest(spark, spread, most, monkeypatch):
    """Equal vectors, fewer vectors than asked for, null vectors and other sizes; groups leave most pairs out."""
    monkeypatch.setattr(neighbours, "SHELL", 16)
    monkeypatch.setattr(neighbours, "PIVOTS", 64)
    q = np.random.default_rng(5)
    middles = q.normal(size=(40, 6)) * 10
    vectors = [(i, [float(np.float32(x)) for x in middles[i % 40] + q.normal(size=6) * spread]) for i in range(1200)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(50)] + [(5000, None), (5001, [1.0]), (5002, [])]
    points = [(i, v) for i, v in vectors[:1200:20]] + [(9000, [0.0] * 6), (9001, [1e6] * 6)]
    v = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(5)
    p = spark.createDataFrame(points, "query long, point array<double>")
    balls = neighbours.built(v)
    for k in (1, 10, 80):
        found = {(r["query"], r["place"]): (r["id"], round(r["distance"], 9)) for r in neighbours.nearest(balls, p, k).collect()}
        assert found == plain_nearest(vectors, points, k)
    assert neighbours.compared_share(balls, p.where("query < 9000"), 5) <= most


def test_nearest_of_few_and_of_none(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0])], "query long, point array<double>")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    assert [tuple(r)[1:] for r in neighbours.nearest(neighbours.built(few), p, 10).orderBy("place").collect()] == [(1, 1.0, 0.5, 1), (2, 5.0, 1 / 6, 2)]
    assert neighbours.nearest(neighbours.built(few.where("false")), p, 3).count() == 0
