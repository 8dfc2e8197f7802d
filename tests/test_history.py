"""Validity at many times against a plain comparison."""

import random

from recollect.operators import history


def test_valid_at(spark):
    """Ends at the moment itself, empty and reversed intervals, open ends, far times, nulls and repeated rows."""
    q = random.Random(2)
    times = [0, 1, 2, 3, 7, 8, 1023, 1024, 1_704_067_200_000, 1_704_067_200_001, history.LAST - 1]
    pick = lambda: q.choice([q.choice(times), q.randrange(5000), q.randrange(1 << 43)])
    memories = [(str(i), q.choice(["a", "b", None]), q.choice([None, pick(), pick()]), q.choice([None, pick(), pick()])) for i in range(150)]
    memories += memories[:3]
    requests = [(i, q.choice(["a", "b", None]), q.choice([None, -5, *times, pick()])) for i in range(120)]
    got = history.valid_at(spark.createDataFrame(memories, "id string, repo string, valid_from long, valid_to long"), spark.createDataFrame(requests, "request long, repo string, at long"), ["repo"])
    want = [(r, i) for r, key, at in requests for i, repo, start, end in memories if key is not None and key == repo and at is not None and at >= 0 and (start or 0) <= at and (end is None or at < end)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_every_moment_is_in_one_range(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a - 1, 41)], "a long, b long").select("a", "b", history.ranges(F.col("a"), F.col("b")).alias("r")).collect()
    for a, b, r in rows:
        assert sorted(x for level, n in r for x in range(n << level, (n + 1) << level)) == list(range(a, b)) and len(r) <= 12
