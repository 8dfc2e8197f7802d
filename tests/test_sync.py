"""Sending the log: partial and failing answers, a lost round, what goes into an envelope, and waits."""

import json

import pytest
from pyspark.sql import functions as F

from recollect.streaming import sync

WHO = sync.Sender("p", "dev", "ws")


@pytest.fixture
def log(spark):
    events = [(n, "create", f"m{n % 6}", '{"n":1,"deep":{"x":[true,null]}}' if n != 8 else "no json", "h", n * 10, 5 if n == 2 else None) for n in range(1, 13)]
    events += [(13, "erase_request", "gone", '{"scope":"team"}', None, 130, None), (14, "erase_request", "gone", '{"scope":"personal"}', None, 140, None), (None, "create", "m1", None, None, 1, None)]
    memories = [(f"m{i}", s) for i, s in enumerate(["personal", "team", "org", "team", "org", None])]
    return spark.createDataFrame(events, "seq long, event_type string, atom_id string, payload_json string, content_hash string, created_at long, synced_at long"), spark.createDataFrame(memories, "id string, scope string")


def rows(spark, folder):
    return [(r["round"], r["first_seq"], r["last_seq"], r["cursor"], r["acked"], r["error"]) for r in sync.receipts(spark, folder).orderBy("round", "batch").collect()]


def test_rounds(spark, log, tmp_path):
    folder, seen = str(tmp_path / "s"), str(tmp_path / "seen")
    (tmp_path / "seen").mkdir()

    def receiver(k):
        def post(body):
            said = json.loads(body)
            seqs = [e["seq"] for e in said["events"]]
            with open(f"{seen}/{k}-{seqs[0]}", "w") as f:
                f.write(body)
            if k == 1 and seqs[0] == 4:
                raise OSError("HTTP 500")
            return {1: seqs[0], 2: seqs[-1], 3: None}[k] if seqs[0] != 13 or k > 1 else -1

        return post

    # Sent by scope: 1 3 4 7 8 9 10 13; 2 is sent already.
    told = sync.ship_once(*log, folder, receiver(1), WHO, 2)
    assert told == {"envelopes": 4, "failed": 1, "shipped": 8, "acked": 3}
    assert rows(spark, folder) == [(1, 1, 3, 0, [1], None), (1, 4, 7, 0, [], "HTTP 500"), (1, 8, 9, 0, [8], None), (1, 10, 13, 0, [10], None)]
    # The cursor stays before 3, though 8 and 10 are acknowledged; what is acknowledged is not sent again.
    told = sync.ship_once(*log, folder, receiver(2), WHO, 2)
    assert told == {"envelopes": 3, "failed": 0, "shipped": 5, "acked": 5}
    assert [r[1:5] for r in rows(spark, folder)[4:]] == [(3, 4, 2, [3, 4]), (7, 9, 2, [7, 9]), (13, 13, 2, [13])]
    assert sync.ship_once(*log, folder, receiver(3), WHO, 2) == {"envelopes": 0, "failed": 0, "shipped": 0, "acked": 0}
    after = sync.marked(log[0], sync.receipts(spark, folder), 99)
    assert sorted(r["seq"] for r in after.where("synced_at = 99").collect()) == [1, 3, 4, 7, 8, 9, 10, 13] and after.count() == log[0].count()
    body = json.loads((tmp_path / "seen" / "1-8").read_text())
    assert {k: body[k] for k in ("protocol", "device_id", "workspace_id", "cursor")} == {"protocol": "p", "device_id": "dev", "workspace_id": "ws", "cursor": 0}
    assert body["events"][0] == {"seq": 8, "event_type": "create", "atom_id": "m2", "payload_json": None, "content_hash": "h", "created_at": 80}
    assert body["events"][1]["payload_json"] == {"n": 1, "deep": {"x": [True, None]}}


def test_a_lost_round_is_sent_again(spark, log, tmp_path, monkeypatch):
    """A round that ends before its receipts are written leaves the store as it was."""
    folder = str(tmp_path / "s")
    with monkeypatch.context() as broken:
        broken.setattr(sync, "posted", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            sync.ship_once(*log, folder, lambda body: 99, WHO)
    assert rows(spark, folder) == []
    assert sync.ship_once(*log, folder, lambda body: 99, WHO)["acked"] == 8


def test_waits_grow_and_end(spark, log, tmp_path):
    def post(body):
        raise TimeoutError

    waits = []
    told = sync.ship(*log, str(tmp_path / "a"), post, WHO, 3, 300_000, waits.append)
    assert waits == [600.0, 900.0, 900.0] and [x["failed"] for x in told] == [1, 1, 1]
    assert sync.receipts(spark, str(tmp_path / "a")).first()["error"] == "TimeoutError"
    waits.clear()
    told = sync.ship(*log, str(tmp_path / "a"), lambda body: json.loads(body)["events"][3]["seq"], WHO, 9, wait=waits.append)
    assert waits == [] and [x["acked"] for x in told] == [4, 4, 0]


def test_a_missing_answer_and_no_events(spark, log, tmp_path):
    events, memories = log
    assert sync.ship_once(events, memories, str(tmp_path / "a"), lambda body: None, WHO) == {"envelopes": 1, "failed": 1, "shipped": 8, "acked": 0}
    assert rows(spark, str(tmp_path / "a"))[0][5] == "response missing acked_seq"
    assert sync.ship_once(events.where(F.lit(False)), memories, str(tmp_path / "b"), lambda body: None, WHO)["envelopes"] == 0
