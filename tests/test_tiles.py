"""Pairs of near vectors by tiles: a vector travels a bounded number of times, and no pair is lost; a run's merges need no weaker pairs."""

import random

import numpy as np
import pytest

from recollect.operators import memory, merges
from recollect.session import cut


@pytest.mark.parametrize("tile", [1, 128])
def test_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(memory, "BLOCK", 4)
    monkeypatch.setattr(memory, "TILE", tile)
    monkeypatch.setattr(memory, "ROWS_OUT", 50)
    q = np.random.default_rng(3)
    rows = [(i % 2, i, [float(x) for x in q.normal(size=5)]) for i in range(200)] + [(7, 900, [1.0] * 5), (7, 901, [2.0] * 5), (7, 902, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "repo int, id long, embedding array<double>")
    got = {(r["a"], r["b"]): r["similarity"] for r in memory.near_pairs(vectors, 0.9, 0.1).collect()}
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    wanted = {(i, j): cosine(x, y) for k, i, x in rows for m, j, y in rows if k == m and i < j and len(x) == len(y) and cosine(x, y) >= 0.1}
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-12 for p in wanted)


def test_blocks_travel_to_few_tiles(spark, monkeypatch):
    """Each of a group's many blocks goes to as many pairs of tiles as there are tiles, not as blocks."""
    monkeypatch.setattr(memory, "BLOCK", 2)
    q = np.random.default_rng(4)
    vectors = spark.createDataFrame([(1, i, [float(x) for x in q.normal(size=3)]) for i in range(400)], "repo int, id long, embedding array<double>")
    blocks = cut(memory._blocks(vectors))
    n, sent = blocks.count(), memory._tiles(blocks, 4.0)
    assert n >= 200 and sent.select("block").distinct().count() == n
    assert sent.groupBy("block").count().agg({"count": "max"}).first()[0] <= memory.TILES + 1


def test_merges_compare_from_their_own_threshold(spark, monkeypatch):
    asked, found = [], memory.near_pairs
    monkeypatch.setattr(memory, "near_pairs", lambda v, merge, propose, *more: asked.append(propose) or found(v, merge, propose, *more))
    vectors = spark.createDataFrame([("r", "a", [1.0, 0.01]), ("r", "b", [1.0, 0.02]), ("r", "c", [1.0, 0.4])], "repo string, id string, embedding array<double>")
    memories = spark.createDataFrame([(x, 0.5, i, None) for i, x in enumerate("abc")], "id string, importance double, created_at long, valid_to long")
    useful = spark.createDataFrame([("b", 0.9)], "id string, useful double")
    assert [tuple(r)[:2] for r in merges.merged(vectors, memories, useful).select("winner", "loser").collect()] == [("b", "a")]
    assert asked == [0.95 - 1e-9]


def test_components_stay_together(spark):
    """200 short chains of falling similarity beside a long one, over several partitions: no memory is in two merges."""
    q = random.Random(1)
    ids, pairs, at = q.sample(range(100_000), 5000), [], 0
    for n in [400, *[20] * 200]:
        chain, at = ids[at : at + n], at + n
        pairs += [(min(x, y), max(x, y), 0.9 - i / 1000 + at / 1e8) for i, (x, y) in enumerate(zip(chain, chain[1:]))]
    used, wanted = set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {a, b} & used:
            used |= {a, b}
            wanted.add((a, b))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = [(r["a"], r["b"]) for r in merges.greedy(spark.createDataFrame(pairs, "a long, b long, similarity double"), 100).collect()]
    finally:
        spark.conf.unset(name)
    assert len(got) == len(set(got)) and set(got) == wanted
