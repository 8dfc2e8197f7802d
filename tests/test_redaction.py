"""Redaction against values worked out by hand: guards, offsets, order and white space."""

import hashlib

import pytest
from pyspark.sql import functions as F

from recollect.operators import redact

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
UUID = "550e8400-e29b-41d4-a716-446655440000"
HEX64 = "0123456789abcdef" * 4
HEX40 = HEX64[:40]
RANDOM = "Zk9Qx7LpRt5Yw2Vb8Nm3"
h8 = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]

CASES = [
    (f"id {UUID} logged", []),
    (f"id Zk9Qx7Lp-{UUID}-Rt5Yw2 logged", [("high_entropy", f"Zk9Qx7Lp-{UUID}-Rt5Yw2", 3)]),
    (f"({UUID})", [("high_entropy", f"({UUID})", 0)] if redact._entropy(f"({UUID})") >= 4 else []),
    (f"latest commit {HEX64} is green", []),
    (f"hash: {HEX40}", []),
    (f"Digest={HEX64}", [("high_entropy", f"Digest={HEX64}", 0)]),
    (f"please share {HEX64} now", [("high_entropy", HEX64, 13)]),
    (f"sha256 {HEX64}", [("high_entropy", HEX64, 7)]),
    (f"sha-256 {HEX64}", []),
    (f"commits {HEX64}", [("high_entropy", HEX64, 8)]),
    (f"commit {'x' * 40} {HEX64}", [("high_entropy", HEX64, 48)]),
    (f"{HEX64[:39]} commit", [] if redact._entropy(HEX64[:39]) < 4 else [("high_entropy", HEX64[:39], 0)]),
    (f"[REDACTED:x:{RANDOM}]", []),
    (f"see[REDACTED:custom:0123abcd]{RANDOM}", []),
    (f"path/{RANDOM}", []),
    (f"back\\{RANDOM}", []),
    (RANDOM, [("high_entropy", RANDOM, 0)]),
    (RANDOM[:19], []),
    (f"a\u00a0{RANDOM}\u3000b", [("high_entropy", RANDOM, 2)]),
    (f"😀 {RANDOM}", [("high_entropy", RANDOM, 3)]),
    (f"password\u00a0=\u2003hunter2 rest", [("generic_credential", "hunter2", 11)]),
    (f"k {KEY} and password = hunter2secret!", [("aws_access_key", KEY, 2), ("generic_credential", "hunter2secret!", 38)]),
    (f"é{KEY}", [("aws_access_key", KEY, 1)]),
    ("token=ghp_" + "a1B2" * 9, [("github_token", "ghp_" + "a1B2" * 9, 6)]),
    ("postgres://u:pw@h/x", [("connection_string", "u:pw", 11)]),
    ("a://u\u00a0:p@h", []),
    ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY----- " + KEY, [("pem_private_key", "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", 0), ("aws_access_key", KEY, 36)]),
    ("", []),
    ("plain words only", []),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_findings(text, wanted):
    out, found = redact.redactions(text)
    assert found == [(kind, h8(value), at) for kind, value, at in wanted]
    for kind, value, _ in wanted:
        assert value not in out and f"[REDACTED:{kind}:{h8(value)}]" in out
    assert wanted or out == text


def test_columns_are_those_of_each_text(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)] + [(1000, None), (1001, ("word " * 50_000) + KEY)]
    frame = spark.createDataFrame(rows, "id long, text string").withColumn("types", F.lit(1))
    got = {r["id"]: r["r"] for r in redact.redacted_rows(frame).collect()}
    for i, text in rows:
        out, found = redact.redactions(text) if text is not None else (None, [])
        assert (got[i]["text"], [tuple(e) for e in got[i]["events"]], got[i]["types"]) == (out, found, [k for k, _, _ in found])
    off = redact.redacted_rows(frame, enabled=False).collect()
    assert all(r["r"]["text"] == r["text"] and r["r"]["events"] == [] for r in off)


def test_custom_patterns(spark):
    frame = spark.createDataFrame([("ticket AB-77 here",), ("none",)], "text string")
    got = [r["r"]["text"] for r in redact.redacted_rows(frame, custom=(r"AB-\d+", "[", "x*")).collect()]
    assert got == [f"ticket [REDACTED:custom:{h8('AB-77')}] here", "none"]


def test_turns(spark):
    turns = [[("user", f"my key {KEY}"), ("ai", "ok"), ("user", None), None, ("user", f"{RANDOM} {KEY}")], [("user", "nothing")], [], None]
    frame = spark.createDataFrame(list(enumerate(turns)), "id long, turns array<struct<role:string,text:string>>")
    got = {r["id"]: r for r in redact.redacted_lists(frame, "turns", "text").collect()}
    first = got[0]
    assert [x and x["text"] for x in first["turns"]] == [f"my key [REDACTED:aws_access_key:{h8(KEY)}]", "ok", None, None, f"[REDACTED:high_entropy:{h8(RANDOM)}] [REDACTED:aws_access_key:{h8(KEY)}]"]
    assert [tuple(x) for x in first["findings"]] == [(0, "aws_access_key", h8(KEY), 7), (4, "aws_access_key", h8(KEY), 21), (4, "high_entropy", h8(RANDOM), 0)]
    assert [x["text"] for x in got[1]["turns"]] == ["nothing"] and got[2]["turns"] == [] and got[3]["turns"] is None and got[3]["findings"] == []
    assert redact.redacted_lists(frame, "turns", "text", enabled=False).where("id = 0").first()["turns"][0]["text"] == f"my key {KEY}"
