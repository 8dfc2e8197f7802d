"""The budget gate against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import budget


def plain(rows, cap):
    spent, out = {}, {}
    for g, at, i, amount in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        a = max(amount or 0, 0)
        out[i] = spent.get(g or "", 0) + a <= cap
        if out[i]:
            spent[g or ""] = spent.get(g or "", 0) + a
    return out


@pytest.mark.parametrize(("cap", "seed"), [(100, 0), (5_000, 1), (200_000, 2), (10**12, 3), (0, 4)])
def test_gate(spark, cap, seed):
    """One day holds most calls, so that it goes on over all ranges; days without a name, nulls, large and small calls."""
    q = random.Random(seed)
    rows = [(q.choice(["hot"] * 6 + ["a", "b", None]), q.randrange(50), i, q.choice([1, 3, 50, q.randrange(1, 400), q.randrange(1000, 9000), None, -5])) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        df = spark.createDataFrame(rows, "grp string, at long, id long, amount long").withColumn("part", F.lit("x"))
        assert {r["id"]: r["fits"] for r in budget.gated(df, cap).collect()} == plain(rows, cap)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_smaller_call_passes_after_a_rejected_one(spark):
    df = spark.createDataFrame([("d", 1, 1, 60), ("d", 2, 2, 50), ("d", 3, 3, 40), ("d", 4, 4, 1)], "grp string, at long, id long, amount long")
    assert [r["fits"] for r in budget.gated(df, 100).orderBy("id").collect()] == [True, False, True, False]
    assert budget.gated(df.where("false"), 100).collect() == []
