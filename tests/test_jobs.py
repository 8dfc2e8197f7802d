"""Job states against a plain replay."""

import random

import pytest

from recollect.operators import jobs


def plain(rows):
    out = {}
    for job, seq, kind in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        state, attempts, events, ignored, error = out.get(job, ("absent", 0, 0, 0, None))
        new, more = state, attempts
        if kind == "enqueue" and state == "absent" or kind == "requeue" and state == "failed" or kind == "resume" and state == "paused":
            new = "pending"
        elif kind == "claim" and state == "pending":
            new = "running"
        elif kind == "complete" and state == "running":
            new = "completed"
        elif kind == "budget" and state == "running":
            new = "paused"
        elif kind in ("transient", "deterministic") and state == "running":
            more = attempts + 1
            new = "poison" if kind == "deterministic" or more >= 3 else "failed"
        out[job] = (new, more, events + 1, ignored + (new == state), seq if new != state and kind in ("transient", "deterministic", "budget") else error)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    """One job has most events, so that many tasks hold a run of it."""
    q = random.Random(seed)
    kinds = ["enqueue", "claim", "claim", "complete", "transient", "transient", "deterministic", "budget", "requeue", "requeue", "resume", "resume", None, "other"]
    if seed == 2:
        kinds = ["enqueue", "claim", "budget", "resume"]  # a job that never ends
    rows = [(q.choice([7] * 9 + [1, 2, 3, None, *range(100, 140)]), i, q.choice(kinds)) for i in range(4000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r["job"]: tuple(r)[1:] for r in jobs.folded(spark.createDataFrame(rows, "job long, seq long, kind string").repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows) and (seed != 2 or got[7][0] != "absent")
    assert jobs.folded(spark.createDataFrame([], "job long, seq long, kind string")).collect() == []
