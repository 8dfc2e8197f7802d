"""Small cases of the memory operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import chunks, evaluation, memory, proposals, redact, scrub, search
from recollect.sources import golden, transcripts
from recollect.streaming import ingest


def one(spark, column, *values):
    schema = ", ".join(f"v{i} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("chars", "budget"), [(500, 1500), (4000, 1500), (12000, 750), (100000, 300)])
def test_budget_shrinks(spark, chars, budget):
    assert one(spark, scoring.shrink_budget(1500, F.col("v0")), chars) == budget


def test_minmax(spark):
    frame = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "s double").select(scoring.minmax(F.col("s")).alias("x"))
    assert sorted(r["x"] for r in frame.collect()) == [0.0, 0.5, 1.0]
    assert [r["x"] for r in spark.createDataFrame([(3.0,), (3.0,)], "s double").select(scoring.minmax(F.col("s")).alias("x")).collect()] == [1.0, 1.0]


@pytest.mark.parametrize(("given", "wanted"), [("a\r\nb  \n", "a\nb"), ("x\nx\nx\ny", "x\ny"), ("x\nx\ny", "x\nx\ny"), ("a\n\n\n\nb", "a\n\nb")])
def test_cleaned(spark, given, wanted):
    assert one(spark, text.cleaned(F.col("v0")), given) == wanted


def test_normalized(spark):
    assert one(spark, text.normalized(F.col("v0")), "  use SQLITE  and sqlite-vec on LINUX ") == "use SQLite and sqlite-vec on Linux"


@pytest.mark.parametrize(("given", "wanted"), [('[{"role":"user","text":"a"},{"role":"ai","text":"b"}]', "user: a\nai: b"), ("plain", "plain"), ("[]", "[]"), ('{"a":1}', '{"a":1}')])
def test_flattened(spark, given, wanted):
    assert one(spark, text.flattened_turns(F.col("v0")), given) == wanted


def test_entropy(spark):
    assert one(spark, text.entropy(F.col("v0")), "abcd") == pytest.approx(2.0)


def test_chunks():
    assert chunks.chunk_text("") == [""]
    assert chunks.chunk_text("no roles") == ["no roles"]
    assert len(chunks.chunk_text("\n".join(f"user: {'word ' * 200}" for _ in range(20)))) > 3


def test_redaction():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    out, kinds = redact.redact_text(f"k {key} and password = hunter2secret!")
    assert kinds == ["aws_access_key", "generic_credential"] and key not in out and "hunter2" not in out
    assert redact.redact_text("commit " + "0a1b2c3d4e" * 4)[1] == []
    assert redact.redact_text("plain text", custom=("[",)) == ("plain text", [])


def test_recall_and_ndcg(spark):
    graded = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 0)], "query string, item string, grade int")
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, place int")
    row = memory.ranking_quality(ranked, graded, 10).first()
    assert (row["recall"], row["ndcg"]) == (1.0, pytest.approx(1.0))
    assert memory.ranking_quality(ranked.where("item = 'b'"), graded, 10).first()["recall"] == 0.5


def test_pack_keeps_the_first_and_stops_at_the_budget(spark):
    rows = [(str(i), "fact", "x" * 215, "r", 0.5, 1000, None) for i in range(50)]
    frame = spark.createDataFrame(rows, "id string, type string, text string, repo string, importance double, created_at long, valid_to long")
    assert 0 < memory.select_pack(frame, 2000, 200).agg(F.sum("tokens").alias("n")).first()["n"] <= 200
    assert memory.select_pack(frame, 2000, 5).count() == 1
    assert memory.render_pack(memory.select_pack(frame, 2000, 200)).first()["pack"].startswith("# Repo memory pack\n\n## Facts\n- x")


def test_phrases_are_adjacent(spark):
    frame = spark.createDataFrame([("1", "use sqlite vec here"), ("2", "vec then sqlite"), ("3", "nothing")], "id string, text string")
    assert [r["id"] for r in search.keyword_scores(frame, "sqlite-vec").collect()] == ["1"]
    assert search.keyword_scores(frame, "sqlite absent").count() == 0


def test_filters_come_after_the_limit(spark):
    rows = [(str(i), f"t {i}", "fact", "r", 0.5, 1000, 5 if i == 0 else None) for i in range(3)]
    memories = spark.createDataFrame(rows, "id string, text string, type string, repo string, importance double, created_at long, valid_to long")
    vectors = spark.createDataFrame([("0", 0.9), ("1", 0.8), ("2", 0.1)], "id string, score double")
    none = spark.createDataFrame([], "id string, bm25 double")
    out = search.hybrid(memories, none, vectors, spark.createDataFrame([], "id string, useful double"), 1000, 10, candidates=2).collect()
    assert [r["id"] for r in out] == ["1"]


def test_stream_replay_adds_nothing(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    line = json.dumps({"session_id": "s", "project_id": "p", "event": "session_end", "wire_version": "v1.0", "turns": [{"role": "user", "text": "keep this"}]})
    for n in range(2):
        (source / f"{n}.json").write_text(line + "\n" + line.replace("v1.0", "v01.0").replace("keep", "drop") + "\n")
        ingest.start(spark, str(source), str(target), str(tmp_path / f"check{n}")).awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(target)).collect()] == ["keep this"]


def test_upserts_keep_what_is_known(spark):
    rows = [("s", 1, 10, "p", None), ("s", 2, 20, None, "x"), ("s", 3, 30, None, "y"), ("t", 1, 5, None, None)]
    frame = spark.createDataFrame(rows, "session_id string, ord int, started_at long, project string, agent string")
    assert sorted(tuple(r) for r in proposals.upsert_sessions(frame, ["project", "agent"]).collect()) == [("s", 10, "p", "y"), ("t", 5, None, None)]


def test_view_counts_lines_not_memories(spark):
    rows = [("1", "fact", "a\nb", 1, None), ("2", "fact", None, 2, None), ("3", "fact", "c", 3, 9), ("4", "fact", "d", 4, None)]
    frame = spark.createDataFrame(rows, "id string, type string, text string, created_at long, valid_to long")
    assert [(r["line"], r["content"]) for r in proposals.view(frame, 2, 3).orderBy("line").collect()] == [(2, "b"), (3, "- [2] ")]
    assert proposals.replace_targets(frame, "d").first()["status"] == "good"


@pytest.mark.parametrize(("propose", "size"), [(0.2, 7), (0.95, 7), (0.2, 512)])
def test_near_pairs_are_all_found(spark, monkeypatch, propose, size):
    q = random.Random(3)
    centers = [[q.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 3 % 2, [q.gauss(x, 0.2) for x in centers[i % 5]]) for i in range(120)] + [(200, 0, None), (201, 0, [0.0] * 6), (202, 0, [1.0, 2.0]), (203, 2, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "id long, repo int, embedding array<float>")
    held = {r["id"]: r for r in frame.where("id < 200").collect()}
    wanted = set()
    for a in held:
        for b in held:
            x, y = held[a]["embedding"], held[b]["embedding"]
            if a < b and held[a]["repo"] == held[b]["repo"] and sum(map(float.__mul__, x, y)) / (sum(map(float.__mul__, x, x)) * sum(map(float.__mul__, y, y))) ** 0.5 >= propose:
                wanted.add((held[a]["repo"], a, b))
    monkeypatch.setattr(memory, "BLOCK", size)
    assert len(wanted) > 100 and {(r["repo"], r["a"], r["b"]) for r in memory.near_pairs(frame, 0.99, propose).collect()} == wanted
    if propose == 0.95:
        assert {r["repo"] for r in memory.near_pairs(frame, 0.99, propose, 50).collect()} == {1}
        assert [tuple(r) for r in memory.oversize_groups(frame, 50).collect()] == [(0, 83)]


def test_every_appended_memory_is_numbered(spark):
    memories = spark.range(1000).selectExpr("cast(id as string) id", "id * 7919 % 997 created_at")
    events = spark.createDataFrame([(4,), (41,)], "seq long")
    wanted = sorted([(r["created_at"], r["id"]) for r in memories.collect()])
    assert sorted(tuple(r) for r in memory.appended(memories, events).collect()) == [(42 + n, i) for n, (_, i) in enumerate(wanted)]
    assert memory.appended(memories, events.where("false")).agg(F.min("seq")).first()[0] == 1


def test_parsed_query(spark):
    got = one(spark, text.parsed_query(F.col("v0"), 10 * 86_400_000), " type:fact repo:myrepo since:7d since:3w who:me project: what did  we type:todo ")
    assert (got["q"], got["type"], got["repo"], got["project"], got["since_ms"]) == ("who:me project: what did we", ["fact", "todo"], "myrepo", None, 3 * 86_400_000)
    assert one(spark, text.parsed_query(F.col("v0"), 0), "")["q"] == ""


def test_normalised(spark):
    given = r"see C:\Users\me\src\a.ts and /home/me/notes, not /opt/home/me, at 2024-01-15  10:30:00.5 UTC with Copilot"
    assert one(spark, text.normalised(F.col("v0"), "/home/me"), given) == "see C:/Users/me/src/a.ts and ~/notes, not /opt/home/me, at 2024-01-15T10:30:00Z with github-copilot"


def test_fake_vector(spark):
    import math

    words, h = "port é😀", 0
    for unit in memoryview(words.encode("utf-16-le")).cast("H"):
        h = ((h * 31 + unit + 2**31) & 0xFFFFFFFF) - 2**31
    got = one(spark, text.fake_vector(F.col("v0"), 3), words)
    assert got == pytest.approx([math.sin(h * 0.001 + i * 0.01) for i in range(3)], abs=1e-5)


def test_indexed_scores_are_those_of_the_texts(spark):
    frame = spark.createDataFrame([(str(i), f"one {'two ' * (i % 3)} three é {i}") for i in range(30)] + [("x", None), ("y", "")], "id string, text string")
    plain = {r["id"]: round(r["bm25"], 9) for r in search.keyword_scores(frame, "two three").collect()}
    got = {r["id"]: round(r["bm25"], 9) for r in search.indexed_scores(search.postings(frame), search.corpus(frame.where("text is not null")), "two three").collect()}
    assert plain and set(got) == set(plain)


def test_redacted_rows(spark):
    rows = [("a", "plain"), ("b", None), ("c", "password = hunter2secret!"), ("d", "AKIA" + "A1B2C3D4E5F6G7H8"), ("e", "a://u:p@h x")]
    got = {r["id"]: r["r"] for r in redact.redacted_rows(spark.createDataFrame(rows, "id string, text string")).collect()}
    for name, body in rows:
        assert (got[name]["text"], got[name]["types"]) == (redact.redact_text(body) if body is not None else (None, []))


def test_keyword_scores_of_all_queries_are_those_of_each(spark):
    rows = [("1", "use sqlite-vec with sqlite here"), ("2", "vec then sqlite"), ("3", "SQLite vec, sqlite vec"), ("4", None), ("5", "")]
    frame = spark.createDataFrame(rows, "id string, text string")
    asked = [("a", "sqlite-vec"), ("b", "sqlite vec"), ("c", "  sqlite sqlite "), ("d", "-- ?"), ("e", "nowhere"), ("f", "")]
    queries = spark.createDataFrame(asked, "query string, body string")
    found = {(r["query"], r["id"], round(r["bm25"], 9)) for r in search.keyword_scores_of_all(frame, queries).collect()}
    assert found == {(q, r["id"], round(r["bm25"], 9)) for q, body in asked for r in search.keyword_scores(frame, body).collect()}
    assert {i for q, i, _ in found if q == "a"} == {"1", "3"}


def test_golden_files(spark, tmp_path):
    atom = lambda i, words, **more: {"id": i, "type": "fact", "text": words, "importance": 0.5, "confidence": 0.9, "scope": "team", "valid_to": None, "provenance": {"repo": "r", "project": "p"}, **more}
    (tmp_path / "corpus.json").write_text(json.dumps({"atoms": [atom("a", "the build needs java"), atom("b", "tests run at night", type="command"), atom("c", "old java rule", valid_to="2024-01-01T00:00:00.000Z")]}, indent=1))
    ask = lambda i, words, grades, **filters: {"id": i, "text": words, "mode": "hybrid", "filters": filters, "graded_relevant": [{"atom_id": a, "grade": g} for a, g in grades]}
    asked = [ask("1", "java build", [("a", 3)]), ask("2", "java", [("a", 3), ("c", 1)]), ask("3", "java", [("c", 3)], as_of="2023-01-01T00:00:00.000Z"), ask("4", "tests night", [("b", 3)], type=["command"]), ask("5", "java", [])]
    (tmp_path / "queries.json").write_text(json.dumps({"queries": asked}))
    quality = evaluation.evaluated(golden.corpus(spark, str(tmp_path / "corpus.json"), 10**12), golden.queries(spark, str(tmp_path / "queries.json")), 10**12)
    rows = {r["query"]: r for r in quality.collect()}
    assert [rows[q]["recall"] for q in "12345"] == [1.0, 0.5, None, 1.0, 1.0] and rows["3"]["skipped"]
    assert (rows["1"]["ndcg"], rows["4"]["ndcg"]) == (1.0, 1.0) and 0.5 < rows["2"]["ndcg"] < 1
    assert evaluation.means(quality).first()[:3] == (4, 1, pytest.approx(0.875))
    assert evaluation.means(quality.where("false")).first()[:] == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize(("given", "wanted"), [("Bearer abc.d-e_f+/=, x", "Bearer [REDACTED], x"), ("BEARER\t\tq bearer r", "BEARER [REDACTED] bearer [REDACTED]"), ("a bearer", "a bearer"), ("", "")])
def test_masked(spark, given, wanted):
    assert one(spark, scrub.masked(F.col("v0")), given) == wanted


def test_scrubbed_records(spark):
    schema = "msg string, Api_Key long, deep struct<x: array<struct<authorization: string, note: string>>, n: int>, tags map<string, string>, none struct<a: string>"
    row = ("bearer t", 7, ([("s", "Bearer u"), None], 3), {"myToken": "v", "name": "Bearer w"}, None)
    frame = spark.createDataFrame([(row,), (None,)], f"r struct<{schema}>")
    out = frame.select(scrub.scrubbed(F.col("r"), frame.schema["r"].dataType).alias("r")).collect()
    got = out[0]["r"].asDict(recursive=True)
    assert got == {"msg": "bearer [REDACTED]", "Api_Key": "[REDACTED]", "deep": {"x": [{"authorization": "[REDACTED]", "note": "Bearer [REDACTED]"}, None], "n": 3}, "tags": {"myToken": "[REDACTED]", "name": "Bearer [REDACTED]"}, "none": None}
    assert out[1]["r"] is None
    assert one(spark, scrub.shortened(F.col("v0")), "x" * 203) == "x" * 200 + "... [3 more chars]"
    assert one(spark, scrub.shortened(F.col("v0")), "x" * 200) == "x" * 200


def test_posted_transcripts(spark, tmp_path):
    lines = [{"session_id": "s", "source": "cli", "content": "hello", "repo": "r"}, {"session_id": "s", "source": "cli", "content": "hello", "repo": None}, {"session_id": "", "source": "cli", "content": "x"}, {"source": "cli", "content": "x"}, {"session_id": "t", "source": "cli", "content": ""}]
    (tmp_path / "posted.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    assert sorted((r["session_id"], r["repo"] or "") for r in transcripts.read(spark, str(tmp_path)).collect()) == [("s", ""), ("s", "r")]


def test_reembedded(spark):
    memories = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, text string")
    rows = memory.reembedded(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), memories, lambda body: text.fake_vector(body, 4)).collect()
    assert {r["id"]: r["outcome"] for r in rows} == {"1": "embedded", "2": "embedded", "3": "missing"}
    assert {r["id"]: r["embedding"] is not None for r in rows}["1"]
