"""Intake with state: outcomes over several batches, a batch that runs again, rejected lines, and what is stored."""

import json

import pytest
from pyspark.sql import functions as F

from recollect.streaming import intake

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
WIRE = {"event": "session_end", "session_id": "s", "project_id": "p", "captured_at": "2024-01-02T03:04:05.678Z", "client_scrub_applied": False, "client_scrub_hits": 0, "client_version": "1", "client_scrub_version": "1", "wire_version": "v1.0", "turns": [{"role": "user", "text": f"key {KEY}"}]}
TYPED = {**{k: v for k, v in WIRE.items() if k != "turns"}, "kind": "events", "events": [{"type": "fact", "text": "a fact", "importance": 0.5, "evidence": f"seen {KEY}"}], "tool": "runner"}
OLDER = {"session_id": "s", "source": "cli", "content": f"user: {KEY}", "project": "q"}


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def outcomes(spark, folder, batch):
    return sorted((str(r["key"]), r["outcome"]) for r in intake.table(spark, folder, "outcomes").where(F.col("batch") == batch).collect())


@pytest.fixture
def folder(spark, tmp_path):
    intake.create(spark, str(tmp_path / "store"))
    return str(tmp_path / "store")


def named(key, **changes):
    return {**WIRE, "idempotency_key": key, **changes}


def test_claims_over_batches(spark, folder):
    intake.take(lines(spark, named("a"), named("a"), named("b"), WIRE, WIRE, named("c", client_version="2"), named("c", client_version="3")), folder, 1)
    first = outcomes(spark, folder, 1)
    assert first[:3] == [("None", "new"), ("None", "new"), ("a", "new")] and first[3:] == [("a", "replay"), ("b", "new"), ("c", "conflict"), ("c", "new")]
    ids = {r["key"]: r["transcript_id"] for r in intake.table(spark, folder, "outcomes").where("outcome = 'new'").collect()}
    intake.erase(spark.createDataFrame([(ids["b"],)], "id string"), folder, 1)
    intake.take(lines(spark, named("a"), named("a", client_version="9"), named("b"), named("b"), named("b", client_version="9"), named("d")), folder, 2)
    assert outcomes(spark, folder, 2) == [("a", "conflict"), ("a", "replay"), ("b", "conflict"), ("b", "reinsert"), ("b", "replay"), ("d", "new")]
    intake.take(lines(spark, named("b"), named("d"), named("d", client_version="0")), folder, 3)
    assert outcomes(spark, folder, 3) == [("b", "replay"), ("d", "conflict"), ("d", "replay")]
    again = {r["key"]: r["transcript_id"] for r in intake.table(spark, folder, "outcomes").where("batch = 3 and outcome = 'replay'").collect()}
    assert again["b"] != ids["b"] and again["b"] == intake.table(spark, folder, "outcomes").where("outcome = 'reinsert'").first()["transcript_id"]


def test_a_batch_that_runs_again_stores_the_same_rows_once(spark, folder):
    rows = lines(spark, named("a"), WIRE, WIRE, {**TYPED, "idempotency_key": "t"}, OLDER, "{", named("z", event="other"))
    count = lambda: {n: sorted(map(str, intake.table(spark, folder, n).collect())) for n in intake.TABLES}
    intake.take(rows, folder, 1)
    before = count()
    intake.take(rows.repartition(3), folder, 1)
    assert count() == before and len(before["transcripts"]) == 5 and len(before["rejected"]) == 2


BAD = [
    ("{", ["no JSON object"]), ("", ["no JSON object"]), ("[1]", None), ({}, ["session_id", "source", "content"]), ({**OLDER, "content": ""}, ["content"]),
    ({**WIRE, "wire_version": "v01.0"}, ["wire_version"]), ({**WIRE, "wire_version": "v1.٣"}, ["wire_version"]), ({**WIRE, "event": "x"}, ["event"]), ({**WIRE, "captured_at": "2024-01-02"}, ["captured_at"]), ({**WIRE, "captured_at": "2024-13-02T00:00:00Z"}, ["captured_at"]),
    ({**WIRE, "client_scrub_hits": -1}, ["client_scrub_hits"]), ({**WIRE, "kind": "other"}, ["kind"]), ({**WIRE, "turns": []}, ["turns"]), ({**WIRE, "turns": [{"role": "system", "text": "x"}]}, ["turns"]), ({**WIRE, "turns": None}, ["turns"]),
    ({**TYPED, "events": []}, ["events"]), ({**TYPED, "events": TYPED["events"] * 501}, ["events"]), ({**TYPED, "events": [{"type": "fact", "text": "x", "importance": 1.5}]}, ["events"]), ({**TYPED, "events": [{"type": "fact", "text": ""}]}, ["events"]), ({**TYPED, "events": [{"type": "other", "text": "x"}]}, ["events"]),
    ({**WIRE, "client_scrub_hits_by_label": {"a": -1}}, ["client_scrub_hits_by_label"]),
]
GOOD = [WIRE, {**WIRE, "client_scrub_hits_by_label": {"a": 2}, "captured_at": "2024-01-02T03:04:05+01:00"}, TYPED, {**TYPED, "events": TYPED["events"] * 500}, {**WIRE, "turns": [{"role": "assistant", "text": ""}]}, OLDER, {**WIRE, **OLDER, "event": "x"}]


def test_reasons(spark):
    for row, reasons in BAD:
        got = intake.parsed(lines(spark, row)).first()["reasons"]
        assert got == reasons if reasons else got, row
    assert [r["reasons"] for r in intake.parsed(lines(spark, *GOOD)).collect()] == [[]] * len(GOOD)


def test_what_is_stored(spark, folder):
    intake.take(lines(spark, WIRE, TYPED, OLDER), folder, 1)
    rows = {r["source"]: r for r in intake.table(spark, folder, "transcripts").collect()}
    assert set(rows) == {"transcript", "runner-events", "cli"} and not any(KEY in r["content"] for r in rows.values())
    assert all("[REDACTED:aws_access_key:" in r["content"] for r in rows.values()) and rows["cli"]["wire_version"] == "v0.0" and rows["transcript"]["captured_at"] == 1704164645678
    assert sorted(r["kind"] for r in intake.table(spark, folder, "jobs").collect()) == ["distill", "distill", "distill-events"]
    assert [tuple(r)[:3] for r in intake.table(spark, folder, "redactions").collect()] == [("s", "aws_access_key", 3)]
    intake.take(lines(spark, {**WIRE, "client_version": "x"}), folder, 2, enabled=False)
    assert KEY in intake.table(spark, folder, "transcripts").where("batch = 2").first()["content"]


def test_stream(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[named("a"), named("b")], [named("a"), named("b", client_version="2")], [named("c")]]):
        (tmp_path / f"in/{n}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        intake.start(spark, str(tmp_path / "in"), folder, str(tmp_path / "check")).awaitTermination(120)
    assert [outcomes(spark, folder, n) for n in (1, 2, 3)] == [[("a", "new"), ("b", "new")], [("a", "replay"), ("b", "conflict")], [("c", "new")]]


def test_plan_reads_only_its_prefixes(spark, folder, capsys):
    intake.take(lines(spark, named("a"), named("b")), folder, 1)
    intake.table(spark, folder, "claims").where(F.col("prefix").isin([3, 5]) & (F.col("batch") < 9)).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1].split("\n")[0]
