"""Greedy merges against a plain loop, over random pairs, chains and large components, and what a run makes of memories."""

import random

import pytest

from recollect.operators import merges


def plain(pairs):
    used, wanted = set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {a, b} & used:
            used |= {a, b}
            wanted.add((a, b))
    return wanted


def taken(spark, pairs, most):
    frame = spark.createDataFrame(pairs, "a long, b long, similarity double")
    return [(r["a"], r["b"]) for r in merges.greedy(frame, most).collect()]


@pytest.mark.parametrize("most", [5, 1 << 18])
def test_random_pairs(spark, most):
    q = random.Random(3)
    pairs = [(a, b, x) for (a, b), x in {tuple(sorted(q.sample(range(40), 2))): q.choice([0.5, 0.6, 0.7, q.random()]) for _ in range(150)}.items()]
    got = taken(spark, pairs, most)
    assert len(got) == len(set(got)) and set(got) == plain(pairs)


@pytest.mark.parametrize("most", [4000, 1 << 18])
def test_falling_chains_end_in_few_rounds(spark, monkeypatch, most):
    """A chain of 10,000 pairs, ids in mixed order, and 200 short ones: far fewer rounds than pairs."""
    q = random.Random(5)
    ids = q.sample(range(100_000), 14_001)
    pairs = [(min(x, y), max(x, y), 1 - i / 20_000) for i, (x, y) in enumerate(zip(ids, ids[1:])) if i < 10_000 or i % 20]
    rounds, found = [], merges._locally_best
    monkeypatch.setattr(merges, "_locally_best", lambda rows: rounds.append(1) or found(rows))
    assert set(taken(spark, pairs, most)) == plain(pairs)
    assert len(rounds) <= 20


def test_odd_pairs(spark):
    rows = [(1, 1, 0.9), (2, 1, 0.5), (1, 2, 0.7), (1, 2, 0.7), (3, 4, None), (4, 3, float("nan")), (None, 5, 0.9), (5, 6, 0.1)]
    assert sorted(taken(spark, rows, 10)) == [(1, 2), (5, 6)]
    assert taken(spark, [], 10) == []


def test_run(spark):
    """Three copies of one direction, a borderline pair, one that is pending, one whose memory ended and one in another group."""
    tilt = lambda y, z=0.0: [1.0, y, z]
    other = lambda y: [0.0, y, 1.0]
    vectors = spark.createDataFrame([("r", "a", tilt(0.01)), ("r", "b", tilt(0.02)), ("r", "c", tilt(0.4)), ("r", "d", other(0.0)), ("r", "e", other(0.45)), ("r", "f", tilt(0.01)), ("q", "g", tilt(0.01)), ("r", "h", tilt(0.01))], "repo string, id string, embedding array<double>")
    memories = spark.createDataFrame([(x, 0.5, i, 7 if x == "f" else None) for i, x in enumerate("abcdefg")], "id string, importance double, created_at long, valid_to long")
    useful = spark.createDataFrame([("b", 0.9)], "id string, useful double")
    nothing = spark.createDataFrame([], "winner string, loser string")
    run = merges.decisions(vectors, memories, useful, nothing)
    got = {tuple(r)[:3] for r in run.collect()}
    # c is borderline with a and b; a is gone after its merge.
    assert got == {("merge", "b", "a"), ("propose", "b", "c"), ("propose", "d", "e")}
    again = merges.decisions(vectors, memories, useful, spark.createDataFrame([("e", "d")], "winner string, loser string"))
    assert {tuple(r)[:3] for r in again.collect()} == got - {("propose", "d", "e")}
    merged = run.where("action = 'merge'").select("winner", "loser")
    state = {r["id"]: tuple(r)[1:] for r in merges.after(memories, merged, 99).collect()}
    assert state["a"] == (99, "b", None) and state["b"] == (None, None, ["a"]) and state["f"] == (7, None, None) and len(state) == 7
    log = sorted((r["atom_id"], r["event_type"], r["payload_json"]) for r in merges.events(merged, 99).collect())
    assert log == [("a", "supersede", '{"superseded_by":"b"}'), ("a", "usefulness", '{"family":"memory_corrected","action":"superseded"}')]
