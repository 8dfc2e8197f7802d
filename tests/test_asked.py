"""Questions of an index get their postings in small batches, and the session's settings stay as they were."""

from recollect.operators import index


def test_small_batches_of_postings(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, during, keep = spark.conf.get(name), [], index.written
    monkeypatch.setattr(index, "written", lambda df: (during.append(spark.conf.get(name)), keep(df))[1])
    v = index.built(spark.createDataFrame([("1", "to be or"), ("2", "or to be")], "id string, text string"), str(tmp_path / "index"), [])
    v = index.add(spark.createDataFrame([("1", "to be or"), ("2", "or to be")], "id string, text string"), v.folder)
    asked = spark.createDataFrame([("a", "to-be or")], "query string, body string")
    assert {r["id"] for r in index.scores(v, asked).collect()} == {"1", "2"}
    assert during and set(during) == {"4m"} and spark.conf.get(name) == before
