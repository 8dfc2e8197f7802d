"""Postings are counted text by text: no shuffle, and the same counts whatever is counted at once."""

from collections import Counter

import pytest

from recollect.operators import search

ROWS = [("1", "la la lu"), ("2", None), ("3", ""), ("4", "Lu é lu " * 50), ("5", "x")]


@pytest.mark.parametrize("most", [3, 1 << 19])
def test_postings(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(search, "TERMS", most)
    frame = spark.createDataFrame(ROWS, "id string, text string").coalesce(1)
    found = search.postings_and_sizes(frame)
    terms = {i: (b or "").lower().replace("é", "e").split() for i, b in ROWS}
    got = {(r["term"], r["id"], r["tf"], r["size"]) for r in found.where("term is not null").collect()}
    assert got == {(w, i, 2 * n, 2 * len(ws)) for i, ws in terms.items() for w, n in Counter(ws).items()}
    assert {tuple(r) for r in search.postings(frame).collect()} == got
    assert search.index_corpus(found).first() == search.corpus(frame).first()
    search.postings(frame).explain()
    assert "Exchange" not in capsys.readouterr().out
