"""Session files in both forms, with lines that are passed over."""

import json

from recollect.sources import sessions


def message(role, text, kind="input_text"):
    return {"type": "message", "role": role, "content": [{"type": kind, "text": text}]}


def wrapped(item):
    return {"type": "response_item", "payload": item}


def test_sessions(spark, tmp_path):
    newer = [{"type": "session_meta", "payload": {"id": "abc", "cwd": "/home/u/proj"}}, wrapped(message("user", "<user_instructions>x</user_instructions>")), wrapped(message("user", "ask")), wrapped({"type": "function_call", "name": "shell", "arguments": "{}"}), wrapped(message("assistant", "answer"))]
    older = [message("user", "which port"), message("assistant", "one")]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.jsonl").write_text("\n".join(map(json.dumps, newer)) + "\nno json {\n[1]\nnull\n\n")
    (tmp_path / "old.jsonl").write_text("\n".join(map(json.dumps, older)))
    (tmp_path / "lone.jsonl").write_text(json.dumps(older[0]))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "notes.txt").write_text(json.dumps(older[1]))
    found = sessions.turns(sessions.lines(spark, str(tmp_path)))
    got = {r["session_id"]: (r["cwd"], [tuple(x) for x in r["turns"]]) for r in found.collect()}
    assert got == {"abc": ("/home/u/proj", [("user", "ask"), ("assistant", "answer")]), "old": (None, [("user", "which port"), ("assistant", "one")])}
    assert [r["session_id"] for r in sessions.unread(found, found.where("session_id = 'abc'").select("file", "size")).collect()] == ["old"]
    sent = {r["session_id"]: r for r in sessions.envelope(found, "cli").collect()}
    assert sent["cli-abc"]["project_id"] == "proj" and sent["cli-old"]["project_id"] == "unknown" and sent["cli-abc"]["idempotency_key"] != sent["cli-old"]["idempotency_key"]
