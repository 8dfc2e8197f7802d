"""More registered queries: lifecycle events, consolidation, intake, sync and metrics."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import embed, evaluation, history, jobs, memory, proposals, scrub
from recollect.plans.catalog import query, r6
from recollect.session import shared_folder
from recollect.sources import tables as t
from recollect.sources import transcripts
from recollect.streaming import intake

NOW = t.NOW_MS
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query(r""", raw AS (SELECT id, ' type:' || type || ' repo:' || repo || ' since:' || (id::BIGINT % 9) || CASE WHEN id::BIGINT % 3 = 0 THEN 'w' WHEN id::BIGINT % 3 = 1 THEN 'd' ELSE 'h' END || ' what:ever ' || scope || CASE WHEN id::BIGINT % 2 = 0 THEN ' type:note project:' || project ELSE ' project:' END AS q FROM mem)
SELECT id, 'what:ever ' || scope || CASE WHEN id::BIGINT % 2 = 0 THEN '' ELSE ' project:' END AS q, CASE WHEN id::BIGINT % 2 = 0 THEN type || ',note' ELSE type END AS types, repo, CASE WHEN id::BIGINT % 2 = 0 THEN project END AS project, CASE WHEN id::BIGINT % 3 = 1 THEN """ + f"{NOW} - (id::BIGINT % 9) * 86400000 WHEN id::BIGINT % 3 = 2 THEN {NOW} - (id::BIGINT % 9) * 3600000 END AS since_ms FROM mem")
def parsed_queries(s, d):
    n = F.col("id").cast("long")
    raw = F.concat(F.lit(" type:"), "type", F.lit(" repo:"), "repo", F.lit(" since:"), (n % 9).cast("string"), F.when(n % 3 == 0, "w").when(n % 3 == 1, "d").otherwise("h"), F.lit(" what:ever "), "scope", F.when(n % 2 == 0, F.concat(F.lit(" type:note project:"), "project")).otherwise(" project:"))
    return t.memories(s, d).select("id", text.parsed_query(raw, NOW).alias("p")).select("id", "p.q", F.array_join("p.type", ",").alias("types"), "p.repo", "p.project", "p.since_ms")


@query("SELECT coalesce(round(sum(usd), 2), 0.0) AS usd_total, count(*) AS calls FROM spend WHERE day = '1995-03-15'")
def budget_today(s, d):
    return t.spend(s, d).where("day = '1995-03-15'").agg(F.coalesce(F.round(F.sum("usd"), 2), F.lit(0.0)).alias("usd_total"), F.count("*").alias("calls"))


LOG = f"rl AS (SELECT event_id AS ingest, event_type AS type, {K}::BIGINT AS n, (epoch_us(ts) // 1000) AS created_at FROM events)"


@query(f", {LOG} SELECT type, sum(n)::BIGINT AS n FROM rl WHERE created_at >= (SELECT max(created_at) FROM rl) - 7 * 86400000 GROUP BY type")
def redaction_breakdown(s, d):
    log = t.redaction_log(s, d)
    last = log.agg(F.max("created_at").alias("last"))
    return log.crossJoin(F.broadcast(last)).where(F.col("created_at") >= F.col("last") - 7 * t.DAY_MS).groupBy("type").agg(F.sum("n").alias("n"))


@query(f", {LOG} SELECT ingest % 50 AS ingest, type, sum(n)::BIGINT AS n FROM rl GROUP BY 1, 2")
def redactions_by_ingest(s, d):
    return t.redaction_log(s, d).groupBy((F.col("ingest") % 50).alias("ingest"), "type").agg(F.sum("n").alias("n"))


WINNERS = """, u AS (SELECT atom_id AS id, (sum((family = 'recall_used')::INT) + 1) / (sum((family IN ('recall_used', 'memory_corrected'))::INT) + 2)::DOUBLE AS useful FROM ev WHERE event_type = 'usefulness' GROUP BY atom_id),
m AS (SELECT mem.id, coalesce(useful, 0.5) AS useful, importance, created_at FROM mem LEFT JOIN u ON u.id = mem.id),
w AS (SELECT prop.id AS pair, CASE WHEN (-x.useful, -x.importance, x.created_at, x.id) < (-y.useful, -y.importance, y.created_at, y.id) THEN x.id ELSE y.id END AS winner, CASE WHEN (-x.useful, -x.importance, x.created_at, x.id) < (-y.useful, -y.importance, y.created_at, y.id) THEN y.id ELSE x.id END AS loser FROM prop JOIN m x ON x.id = prop.winner JOIN m y ON y.id = prop.loser)"""


def _winners(s, d):
    pairs = t.proposals(s, d).select(F.col("id").alias("pair"), F.col("winner").alias("a"), F.col("loser").alias("b"))
    return proposals.winners(pairs, t.memories(s, d), memory.usefulness_scores(t.memory_events(s, d)))


@query(f"{WINNERS} SELECT pair, winner, loser FROM w")
def merge_winners(s, d):
    return _winners(s, d).select("pair", "winner", "loser")


@query(f"{WINNERS} SELECT winner, string_agg(loser, ',' ORDER BY pair) AS derived_from FROM (SELECT winner, loser, min(pair) AS pair FROM w GROUP BY winner, loser) GROUP BY winner")
def merge_lineage(s, d):
    return proposals.lineage(_winners(s, d), "pair").select("winner", F.array_join("derived_from", ",").alias("derived_from"))


@query(f"{WINNERS}, f AS (SELECT loser, min(pair) AS pair FROM w GROUP BY loser) SELECT mem.id AS id, coalesce(valid_to, CASE WHEN f.loser IS NOT NULL THEN {NOW} END) AS valid_to, CASE WHEN valid_to IS NULL THEN w.winner END AS superseded_by FROM mem LEFT JOIN f ON f.loser = mem.id LEFT JOIN w ON w.pair = f.pair AND w.loser = f.loser")
def merged_memories(s, d):
    return proposals.superseded(t.memories(s, d), _winners(s, d), "pair", NOW).select("id", "valid_to", "superseded_by")


@query("SELECT label AS repo, vec_id % 3 AS type, count(*) AS size FROM embeddings GROUP BY 1, 2 HAVING count(*) > 15")
def skipped_groups(s, d):
    v = t.vectors(s, d).select(F.struct("repo", (F.col("id") % 3).alias("type")).alias("repo"), "id")
    return memory.oversize_groups(v, 15).select("repo.repo", "repo.type", F.col("n").alias("size"))


@query("SELECT x.label AS repo, x.vec_id % 3 AS type, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id % 3 = y.vec_id % 3 AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3")
def consolidation_by_type(s, d):
    # One number for each group of repo and type.
    v = t.vectors(s, d).select((F.col("repo") * 3 + F.col("id") % 3).alias("repo"), "id", "embedding")
    pairs = memory.near_pairs(v, 0.95, 0.3)
    return pairs.select(F.floor(F.col("repo") / 3).alias("repo"), (F.col("repo") % 3).alias("type"), "a", "b", r6("similarity"))


@query("SELECT id, created_at FROM mem WHERE repo IN ('web', 'src1') OR project = 'en' ORDER BY created_at, id LIMIT 50")
def rebuild_candidates(s, d):
    return t.memories(s, d).where("repo in ('web', 'src1') or project = 'en'").orderBy("created_at", "id").limit(50).select("id", "created_at")


@query("SELECT id, winner, loser FROM prop ORDER BY id LIMIT 40")
def proposals_by_age(s, d):
    return t.proposals(s, d).orderBy("id").limit(40)


SESSIONS = f"se AS (SELECT session_id, {t.START_MS} + min(turn) * 1000 + CAST(session_id AS BIGINT) % 7 AS started_at FROM turn WHERE CAST(session_id AS BIGINT) % 4 > 0 GROUP BY session_id)"


def _sessions(s, d):
    n = F.col("session_id").cast("long")
    return t.turns(s, d).where(n % 4 > 0).groupBy("session_id").agg((F.lit(t.START_MS) + F.min("turn") * 1000 + F.max(n) % 7).alias("started_at"))


@query(f", {SESSIONS} SELECT turn.session_id AS session_id, turn, role, started_at FROM turn LEFT JOIN se USING (session_id)")
def transcript_sessions(s, d):
    return t.turns(s, d).join(_sessions(s, d), "session_id", "left").select("session_id", "turn", "role", "started_at")


@query(f", {SESSIONS} SELECT id, CAST(id::BIGINT % 40 AS VARCHAR) AS session_id, started_at FROM mem LEFT JOIN se ON se.session_id = CAST(id::BIGINT % 40 AS VARCHAR)")
def provenance(s, d):
    m = t.memories(s, d).select("id", (F.col("id").cast("long") % 40).cast("string").alias("session_id"))
    return m.join(_sessions(s, d), "session_id", "left").select("id", "session_id", "started_at")


@query(f", {SESSIONS} SELECT session_id, started_at FROM se ORDER BY started_at DESC, session_id DESC LIMIT 1")
def latest_session(s, d):
    return _sessions(s, d).agg(F.max(F.struct("started_at", "session_id")).alias("last")).select("last.session_id", "last.started_at")


@query("SELECT session_id || ':' || turn AS recall, atom_id, substr(sha256(text), 1, 16) AS query_hash, CASE WHEN ord = 1 THEN 0.5 END AS score, 'search' AS surface FROM (SELECT *, unnest([session_id, CAST(turn AS VARCHAR)]) AS atom_id, unnest([1, 2]) AS ord FROM turn WHERE role = 'user')")
def served_events(s, d):
    recalls = t.turns(s, d).where("role = 'user'").select(F.concat_ws(":", "session_id", "turn").alias("recall"), F.col("text").alias("query"), F.array("session_id", F.col("turn").cast("string")).alias("atom_ids"), F.array(F.lit(0.5)).alias("scores"), F.lit("search").alias("surface"), F.lit(None).cast("string").alias("mode"))
    rows = memory.served(recalls)
    return rows.select("recall", "atom_id", memory.payload("query_hash").alias("query_hash"), memory.payload("score").cast("double").alias("score"), memory.payload("surface").alias("surface"))


@query("SELECT atom_id, CASE WHEN family = 'recall_used' THEN '{\"family\":\"recall_used\",\"surface\":\"' || surface || '\",\"signal\":\"explicit\"}' ELSE '{\"family\":\"memory_corrected\",\"action\":\"invalidated\"}' END AS payload_json FROM ev WHERE family IN ('recall_used', 'memory_corrected')")
def usage_events(s, d):
    rows = t.memory_events(s, d).select("atom_id", memory.payload("family").alias("family"), memory.payload("surface").alias("surface")).where("family in ('recall_used', 'memory_corrected')")
    return memory.used_or_corrected(rows.withColumn("signal", F.lit("explicit")).withColumn("action", F.lit("invalidated"))).select("atom_id", "payload_json")


@query(", p AS (SELECT DISTINCT session_id FROM turn), f AS (SELECT CAST(id::BIGINT % 300 AS VARCHAR) AS session_id, min(id::BIGINT) AS first FROM mem GROUP BY 1) SELECT p.session_id AS transcript_id, coalesce(CAST(first AS VARCHAR), 'pending:' || p.session_id) AS memory_id FROM p LEFT JOIN f USING (session_id)")
def summary_backfill(s, d):
    made = t.memories(s, d).select((F.col("id").cast("long") % 300).cast("string").alias("transcript_id"), F.col("id").cast("long").alias("ord"), "id")
    placeholders = t.turns(s, d).select(F.col("session_id").alias("transcript_id")).distinct().withColumn("memory_id", F.concat(F.lit("pending:"), "transcript_id"))
    return memory.repointed(placeholders, made)


TIMES = "'at ' || strftime(o_orderdate, '%Y-%m-%d') || '  0' || (o_orderkey % 9) || ':05:07' || CASE o_orderkey % 4 WHEN 0 THEN '.250' WHEN 1 THEN ' UTC' WHEN 2 THEN 'Z' ELSE '' END || ' done'"


@query(f" SELECT o_orderkey AS id, 'at ' || strftime(o_orderdate, '%Y-%m-%d') || 'T0' || (o_orderkey % 9) || ':05:07Z done' AS body FROM orders")
def normalised_times(s, d):
    n = F.col("o_orderkey")
    tail = F.when(n % 4 == 0, ".250").when(n % 4 == 1, " UTC").when(n % 4 == 2, "Z").otherwise("")
    body = F.concat(F.lit("at "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  0"), (n % 9).cast("string"), F.lit(":05:07"), tail, F.lit(" done"))
    return t.read(s, d, "orders").select(n.alias("id"), text.normalised_times(body).alias("body"))


@query("SELECT event_id AS answer, CASE WHEN event_id % 5 = 0 THEN 'deterministic' ELSE 'parsed' END AS outcome, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'fact:' || event_type || ' happened' ELSE 'fact:' || event_type || ' happened|note:value of ' || user_id END AS atoms FROM events")
def extracted_atoms(s, d):
    n, e = F.col("event_id"), F.col("event_type")
    one = F.concat(F.lit('{"type":"fact","text":"'), e, F.lit(' happened","importance":0.5,"confidence":0.9}'))
    other = F.when(n % 3 == 0, F.lit('{"type":"note","text":"abc"}')).otherwise(F.concat(F.lit('{"type":"note","text":"value of '), F.col("user_id").cast("string"), F.lit('"}')))
    answer = F.when(n % 5 == 0, F.lit("I cannot")).when(n % 2 == 0, F.concat(F.lit('```json\n{"atoms":['), one, F.lit(","), other, F.lit("]}\n```"))).otherwise(F.concat(F.lit('Here: {"atoms":['), one, F.lit(","), other, F.lit("]} done")))
    rows = proposals.extracted(t.read(s, d, "events").select(n.alias("answer"), answer.alias("body")))
    return rows.select("answer", "outcome", F.array_join(F.transform("atoms", lambda a: F.concat_ws(":", a["type"], a["text"])), "|").alias("atoms"))


@query("SELECT hash, text, type, importance, confidence FROM (SELECT sha256(body) AS hash, body AS text, role AS type, CASE WHEN turn % 2 = 0 THEN turn / 100.0 ELSE 0.7 END::DOUBLE AS importance, 0.9::DOUBLE AS confidence, row_number() OVER (PARTITION BY lower(body) ORDER BY CASE WHEN turn % 2 = 0 THEN turn / 100.0 ELSE 0.7 END DESC, CAST(session_id AS BIGINT) * 10000 + turn) AS n FROM (SELECT *, 'turn ' || (turn % 7) || CASE WHEN turn % 3 = 0 THEN ' OF ' ELSE ' of ' END || session_id AS body FROM turn)) WHERE n = 1")
def event_atoms(s, d):
    turn = F.col("turn")
    body = F.concat(F.lit("turn "), (turn % 7).cast("string"), F.when(turn % 3 == 0, " OF ").otherwise(" of "), "session_id")
    event = F.struct(F.col("role").alias("type"), F.concat(F.lit(" "), body, F.lit("  ")).alias("text"), F.when(turn % 2 == 0, turn / 100.0).alias("importance"), F.lit(None).cast("double").alias("confidence"))
    envelopes = t.turns(s, d).select((F.col("session_id").cast("long") * 10_000 + turn).alias("ord"), F.array(event).alias("events"))
    return memory.event_atoms(envelopes).select("hash", "text", "type", "importance", "confidence")


def _sent_vectors(v):
    """Two vectors for one id in both orders of size, ids that nobody knows, and vectors that are too short or null."""
    shifted = F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", 1, 1))
    large = F.transform("embedding", lambda x: (x + 9).cast("float"))
    sent = [("id % 3 = 0", "id", 3, shifted), ("id % 6 = 0", "id", 1, large), ("id % 6 = 3", "id", 5, large), ("id % 5 = 1", "id + 1000000000", 2, F.col("embedding")), ("id % 7 = 1", "id", 7, F.slice("embedding", 1, 3)), ("id % 11 = 2", "id", 8, F.lit(None).cast("array<float>"))]
    rows = [v.where(where).select(F.expr(own).alias("id"), F.lit(ord_).alias("ord"), e.alias("embedding")) for where, own, ord_, e in sent]
    return reduce(DataFrame.union, rows)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 6 = 3 THEN embedding[1] + 9 WHEN vec_id % 6 = 0 THEN embedding[2] ELSE embedding[1] END AS head, CASE WHEN vec_id % 3 = 0 THEN 'replaced' ELSE 'kept' END AS how FROM embeddings")
def vector_upserts(s, d):
    v = t.vectors(s, d).select("id", "embedding")
    return embed.upserted(v, _sent_vectors(v), 64).select("id", F.get("embedding", F.lit(0)).alias("head"), "how")


SENT = " UNION ALL ".join(
    f"SELECT {own} AS id, {n} AS ord, {outcome} AS outcome FROM embeddings WHERE {where}"
    for where, own, n, outcome in (
        ("vec_id % 3 = 0", "vec_id", 3, "CASE WHEN vec_id % 6 = 3 THEN 'replaced later' ELSE 'stored' END"), ("vec_id % 6 = 0", "vec_id", 1, "'replaced later'"), ("vec_id % 6 = 3", "vec_id", 5, "'stored'"),
        ("vec_id % 5 = 1", "vec_id + 1000000000", 2, "'unknown id'"), ("vec_id % 7 = 1", "vec_id", 7, "'wrong size'"), ("vec_id % 11 = 2", "vec_id", 8, "'wrong size'"),
    )
)


@query(f", sent AS ({SENT}) SELECT * FROM sent")
def vector_upsert_outcomes(s, d):
    v = t.vectors(s, d).select("id", "embedding")
    return embed.upsert_outcomes(v, _sent_vectors(v), 64).select("id", "ord", "outcome")


def _model(texts):
    """Stands for a model: some texts have no answer, some a short one."""
    if any(len(x) % 13 == 5 for x in texts):
        raise ConnectionError("HTTP 503 from the model")
    digests = [hashlib.sha256(x.encode()).digest() for x in texts]
    return [[(b[i % 32] * 256 + b[(i + 1) % 32]) / 32767.5 - 1 for i in range(10 if len(x) % 17 == 3 else 64)] for x, b in zip(texts, digests, strict=True)]


@query("""SELECT n.id::BIGINT AS ord, coalesce(CASE WHEN NOT failed THEN coalesce(known, substr(n.hash, 1, 32)) END, '') AS id,
  CASE WHEN failed AND length(coalesce(text, '')) % 13 = 5 THEN 'transient' WHEN failed THEN 'deterministic' WHEN known IS NULL AND first = n.id::BIGINT THEN 'created' ELSE 'known' END AS outcome,
  CASE WHEN NOT failed THEN round((('0x' || substr(h, 1, 2))::INT * 256 + ('0x' || substr(h, 3, 2))::INT) / 32767.5 - 1, 4)::DOUBLE END AS head
FROM (SELECT *, sha256(coalesce(text, '')) AS h, length(coalesce(text, '')) % 13 = 5 OR length(coalesce(text, '')) % 17 = 3 AS failed, min(id::BIGINT) OVER (PARTITION BY hash) AS first FROM mem WHERE id::BIGINT % 4 > 0 AND coalesce(hash NOT IN (SELECT hash FROM mem WHERE id::BIGINT % 9 = 5 AND hash IS NOT NULL), true)) n
LEFT JOIN (SELECT hash, min(id) AS known FROM mem WHERE id::BIGINT % 4 = 0 GROUP BY hash) k ON k.hash = n.hash""")
def embedded_memories(s, d):
    """Memories through an embedding model into the index: what was made, known before, erased (no row) or failed."""
    m, n = t.memories(s, d), F.col("id").cast("long")
    done = embed.embed_and_index(m.where(n % 4 > 0).select(n.alias("ord"), "text", "type", "hash"), m.where(n % 4 == 0).select("id", "hash"), m.where(n % 9 == 5).select("hash"), _model, 64)
    good = done.results.join(done.vectors, "id").select("ord", "id", F.when(F.col("created"), "created").otherwise("known").alias("outcome"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("head"))
    return good.union(done.failures.select("ord", F.lit("").alias("id"), "kind", F.lit(None).cast("double")))


@query("SELECT batch, count(*) AS n, min(seq) AS first_seq, max(seq) AS acked_seq FROM (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 200 AS batch FROM ev WHERE synced_at IS NULL) GROUP BY batch")
def sync_batches(s, d):
    return memory.sync_batches(t.memory_events(s, d).where("synced_at is null"))


@query(f", req AS (SELECT seq, atom_id, CASE WHEN seq % 2 = 0 THEN 'invalidate' ELSE 'supersede' END AS kind, CAST(seq % 400 AS VARCHAR) AS new_id FROM ev WHERE event_type IN ('create', 'erase_request')), ok AS (SELECT req.*, mem.id IS NOT NULL AS known, mem.valid_to IS NULL AS valid, kind = 'invalidate' OR (n.id IS NOT NULL AND n.valid_to IS NULL) AS good FROM req LEFT JOIN mem ON mem.id = atom_id LEFT JOIN mem n ON n.id = new_id), first AS (SELECT atom_id, min(seq) AS seq FROM ok WHERE known AND valid AND good GROUP BY atom_id) SELECT ok.seq AS seq, CASE WHEN NOT known THEN 'not found' WHEN NOT valid OR first.seq < ok.seq THEN 'conflict' WHEN NOT good THEN 'invalid target' ELSE 'done' END AS outcome FROM ok LEFT JOIN first USING (atom_id)")
def lifecycle_outcomes(s, d):
    log = t.memory_events(s, d).where("event_type in ('create', 'erase_request')").select("seq", "atom_id", F.when(F.col("seq") % 2 == 0, "invalidate").otherwise("supersede").alias("kind"), (F.col("seq") % 400).cast("string").alias("new_id"))
    return memory.lifecycle_outcomes(t.memories(s, d), log)


@query("SELECT item_id AS id, round(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648) * 0.001, 3) AS phase, 1024 AS size FROM benchmark")
def fake_vectors(s, d):
    return t.read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.round(text.fake_seed(F.col("text")) * 0.001, 3).alias("phase"), F.size(text.fake_vector(F.col("text"))).alias("size"))


SEED = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)"
# Two words of an item ask for it (grade 3) and the next one (grade 1); every third query allows only the item's type, every eighth asks for a past time.
GOLD = rf""", it AS (SELECT item_id AS id, (['decision','fact','lesson','command','todo','note','event'])[item_id % 7 + 1] AS type, (item_id % 11)::DOUBLE / 10 AS importance, item_id % 17 = 3 AS gone, w, list_transform(range(64), lambda i: sin(seed * 0.001 + i * 0.01)::FLOAT::DOUBLE) AS e
  FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w, {SEED} AS seed FROM benchmark)),
asked AS (SELECT id AS query, type, w, e FROM it WHERE id % 8 <> 6),
ph AS (SELECT query, p, w[2 * p + 1] AS term FROM asked, (SELECT unnest([1, 2]) AS p)),
fr AS (SELECT query, p, id, 2 * len(list_filter(w, lambda x: x = term)) AS f, 2 * len(w) AS size FROM ph, it),
c AS (SELECT count(*) AS n, avg(2 * len(w)) AS mean FROM it),
idf AS (SELECT query, p, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(mean) AS mean FROM fr, c WHERE f > 0 GROUP BY query, p),
bm AS (SELECT fr.query AS query, id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS k FROM fr JOIN idf ON idf.query = fr.query AND idf.p = fr.p WHERE f > 0 GROUP BY fr.query, id HAVING count(*) = 2),
k AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query ORDER BY k DESC, id) <= 50),
ds AS (SELECT query, id, list_distance(asked.e, it.e) AS d FROM asked, it),
v AS (SELECT query, id, 1 / (1 + d) AS v FROM ds QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 50),
b AS (SELECT coalesce(k.query, v.query) AS query, coalesce(k.id, v.id) AS id, k, v FROM k FULL JOIN v ON k.query = v.query AND k.id = v.id),
n AS (SELECT *, CASE WHEN k IS NULL THEN 0 WHEN min(k) OVER o = max(k) OVER o THEN 1 ELSE (k - min(k) OVER o) / (max(k) OVER o - min(k) OVER o) END AS nk, CASE WHEN v IS NULL THEN 0 WHEN min(v) OVER o = max(v) OVER o THEN 1 ELSE (v - min(v) OVER o) / (max(v) OVER o - min(v) OVER o) END AS nv FROM b WINDOW o AS (PARTITION BY query)),
pl AS (SELECT n.query AS query, n.id AS id, row_number() OVER (PARTITION BY n.query ORDER BY 0.4 * nk + 0.4 * nv + 0.1 * importance DESC, n.id) AS place FROM n JOIN it ON it.id = n.id JOIN asked ON asked.query = n.query WHERE NOT gone AND (n.query % 3 > 0 OR asked.type = it.type)),
gr AS (SELECT query, query AS item, 3 AS grade, 1 AS best FROM asked UNION ALL SELECT query, query + 1, 1, 2 FROM asked),
q AS (SELECT gr.query AS query, avg((place IS NOT NULL)::INT) AS recall, sum(CASE WHEN place IS NULL THEN 0 ELSE (pow(2, grade) - 1) / log2(place + 1) END) / sum((pow(2, grade) - 1) / log2(best + 1)) AS ndcg FROM gr LEFT JOIN pl ON pl.query = gr.query AND pl.id = item AND place <= 10 GROUP BY gr.query),
r AS (SELECT item_id AS query, item_id % 8 = 6 AS skipped, recall, ndcg FROM benchmark LEFT JOIN q ON q.query = item_id)"""


def _golden(s, d):
    items, n = t.read(s, d, "benchmark"), F.col("item_id")
    own = text.terms(F.col("text"))
    kind, vector = F.get(F.array(*[F.lit(k) for k in t.TYPES]), (n % 7).cast("int")), text.fake_vector(F.col("text"), 64)
    corpus = items.select(n.alias("id"), kind.alias("type"), "text", ((n % 11).cast("double") / 10).alias("importance"), F.lit(NOW).alias("created_at"), F.when(n % 17 == 3, F.lit(NOW)).alias("valid_to"), vector.alias("embedding"))
    grade = lambda item, g: F.struct(item.alias("atom_id"), F.lit(g).alias("grade"))
    queries = items.select(
        n.alias("query"), F.concat_ws(" ", F.get(own, F.lit(2)), F.get(own, F.lit(4))).alias("body"), vector.alias("point"),
        F.when(n % 3 == 0, F.array(kind)).alias("types"), F.when(n % 8 == 6, "2024-01-01").alias("as_of"), F.array(grade(n, 3), grade(n + 1, 1)).alias("graded"),
    )
    return evaluation.evaluated(corpus, queries, NOW)


@query(f"{GOLD} SELECT query, skipped, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM r")
def golden_quality(s, d):
    return _golden(s, d).select("query", "skipped", r6("recall"), r6("ndcg"))


@query(f"{GOLD} SELECT count(*) FILTER (NOT skipped) AS evaluated, count(*) FILTER (skipped) AS skipped, coalesce(round(avg(recall), 6), 0.0) AS recall, coalesce(round(avg(ndcg), 6), 0.0) AS ndcg FROM r")
def golden_means(s, d):
    return evaluation.means(_golden(s, d)).select("evaluated", "skipped", r6("recall"), r6("ndcg"))


@query("SELECT event_id AS id, 'sent bearer [REDACTED], user ' || user_id AS message, '[REDACTED]' AS api_key, '[REDACTED]' AS inner_token, event_type AS inner_name, 'Bearer [REDACTED]' AS tag, CASE WHEN event_id % 2 = 0 THEN 'name=' || event_type ELSE 'authorization=[REDACTED]' END AS extra, CASE WHEN length(repeat(event_type, 40)) > 200 THEN substr(repeat(event_type, 40), 1, 200) || '... [' || (length(repeat(event_type, 40)) - 200) || ' more chars]' ELSE repeat(event_type, 40) END AS transcript FROM events")
def scrubbed_logs(s, d):
    n, e = F.col("event_id"), F.col("event_type")
    secret = F.concat(F.lit("a1.b2-"), n.cast("string"), F.lit("=="))
    extra = F.when(n % 2 == 0, F.create_map(F.lit("name"), e)).otherwise(F.create_map(F.lit("authorization"), secret))
    record = F.struct(
        F.concat(F.lit("sent bearer  "), secret, F.lit(", user "), F.col("user_id").cast("string")).alias("message"), secret.alias("api_key"),
        F.struct(F.array(secret).alias("Token"), e.alias("name")).alias("inner"), F.array(F.concat(F.lit("Bearer "), secret)).alias("tags"), extra.alias("extra"),
    )
    rows = t.read(s, d, "events").select(n.alias("id"), record.alias("record"), scrub.shortened(F.repeat(e, 40)).alias("transcript"))
    rows = rows.withColumn("record", scrub.scrubbed(F.col("record"), rows.schema["record"].dataType))
    one = F.map_entries("record.extra")[0]
    return rows.select("id", "record.message", "record.api_key", F.col("record.inner.Token").alias("inner_token"), F.col("record.inner.name").alias("inner_name"), F.col("record.tags")[0].alias("tag"), F.concat_ws("=", one["key"], one["value"]).alias("extra"), "transcript")


@query(f", a AS (SELECT event_id AS request, CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'purchase') SELECT request, a.id AS id, CASE WHEN mem.id IS NULL THEN 'missing' ELSE 'embedded' END AS outcome, round(sin({SEED} * 0.001)::FLOAT::DOUBLE, 5) AS head FROM a LEFT JOIN mem ON mem.id = a.id")
def reembedded(s, d):
    requests = t.read(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("request"), F.col("user_id").cast("string").alias("id"))
    rows = memory.reembedded(requests, t.memories(s, d), lambda body: text.fake_vector(body, 64))
    return rows.select("request", "id", "outcome", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("head"))


@query("SELECT session_id, coalesce(max(repo), 'unknown') AS repo, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM (SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 3 > 0 THEN 'r' || session_id END AS repo FROM turn) GROUP BY session_id")
def legacy_transcripts(s, d):
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    n = F.col("session_id").cast("long")
    posted = t.turns(s, d).groupBy("session_id").agg(F.to_json(said).alias("content"))
    posted = posted.select(F.to_json(F.struct("session_id", F.lit("cli").alias("source"), "content", F.when(n % 3 > 0, F.concat(F.lit("r"), "session_id")).alias("repo"))).alias("line"))
    return transcripts.rows(posted).select("session_id", F.coalesce("repo", F.lit("unknown")).alias("repo"), text.flattened_turns(F.col("content")).alias("body"))


#: Kinds of job events by their message, and what becomes of a job.
JOB_FOLD = """, jk AS (SELECT job, seq, row_number() OVER (PARTITION BY job ORDER BY seq) AS place, CASE WHEN action <> 'error' THEN action WHEN message LIKE '%budget%' THEN 'budget' WHEN message LIKE 'invalid JSON%' THEN 'deterministic' ELSE 'transient' END AS kind FROM jev),
f AS (SELECT job, 0::BIGINT AS place, 'absent' AS state, 0 AS attempts, 0::BIGINT AS ignored, NULL::BIGINT AS error_seq FROM (SELECT DISTINCT job FROM jk)
  UNION ALL SELECT job, place, CASE WHEN NOT ok THEN state WHEN kind IN ('enqueue', 'requeue', 'resume') THEN 'pending' WHEN kind = 'claim' THEN 'running' WHEN kind = 'complete' THEN 'completed' WHEN kind = 'budget' THEN 'paused' WHEN kind = 'deterministic' OR attempts >= 2 THEN 'poison' ELSE 'failed' END,
    CASE WHEN ok AND kind IN ('transient', 'deterministic') THEN attempts + 1 ELSE attempts END, ignored + CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN ok AND kind IN ('transient', 'deterministic', 'budget') THEN seq ELSE error_seq END
  FROM (SELECT f.job, jk.place, jk.seq, kind, state, attempts, ignored, error_seq, coalesce((state = 'absent' AND kind = 'enqueue') OR (state = 'pending' AND kind = 'claim') OR (state = 'running' AND kind IN ('complete', 'budget', 'transient', 'deterministic')) OR (state = 'failed' AND kind = 'requeue') OR (state = 'paused' AND kind = 'resume'), false) AS ok
    FROM f JOIN jk ON jk.job = f.job AND jk.place = f.place + 1)),
last AS (SELECT f.* FROM f JOIN (SELECT job, max(place) AS place FROM f GROUP BY job) m ON m.job = f.job AND m.place = f.place)"""


@query(f"{JOB_FOLD} SELECT last.job AS job, state, attempts::INT AS attempts, place AS events, ignored, error_seq, message AS last_error FROM last LEFT JOIN jev ON jev.job = last.job AND jev.seq = error_seq", recursive=True)
def job_states(s, d):
    log = t.job_events(s, d)
    states = jobs.folded(log.select("job", "seq", jobs.kind_of(F.col("action"), F.col("message")).alias("kind")))
    return states.join(log.select("job", F.col("seq").alias("error_seq"), F.col("message").alias("last_error")), ["job", "error_seq"], "left").select("job", "state", F.col("attempts").cast("int").alias("attempts"), "events", "ignored", "error_seq", "last_error")


def _lines(s, d):
    """Conversations and events as lines of the wire: (number, key, value of the first version)."""
    turn = F.struct(F.col("role"), F.col("text"))
    sent = t.turns(s, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("said")))), lambda x: x["said"]).alias("turns")).withColumn("n", F.col("session_id").cast("long"))
    event = F.struct(F.lit("lesson").alias("type"), "event_type", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    typed = t.read(s, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", event.alias("e"))).alias("events")).select(F.col("user_id").alias("n"), F.transform(F.array_sort("events"), lambda x: F.struct(x["e"]["type"].alias("type"), x["e"]["text"].alias("text"), (x["e"]["k"] / 90).alias("importance"))).alias("events"))
    common = [F.lit("session_end").alias("event"), F.lit("p").alias("project_id"), F.lit("2024-01-02T03:04:05Z").alias("captured_at"), F.lit(False).alias("client_scrub_applied"), F.lit(0).alias("client_scrub_hits"), F.lit("1").alias("client_scrub_version"), F.lit("v1.0").alias("wire_version")]
    line = lambda key, version, *more: F.to_json(F.struct(key.alias("idempotency_key"), version.alias("client_version"), *common, *more)).alias("value")
    return sent, typed, line


@query("""SELECT batch, key, outcome FROM (
  SELECT 1 AS batch, CASE WHEN n % 5 < 4 THEN 'c' || n END AS key, CASE WHEN bad THEN 'rejected turns' ELSE 'new' END AS outcome FROM cv
  UNION ALL SELECT 2, 'c' || n, CASE WHEN bad THEN 'rejected turns' WHEN n % 5 = 4 THEN 'new' WHEN n % 3 = 1 THEN 'conflict' WHEN n % 6 = 0 THEN 'reinsert' ELSE 'replay' END FROM cv WHERE n % 3 < 2
  UNION ALL SELECT 2, 'c' || n, CASE WHEN bad THEN 'rejected turns' ELSE 'replay' END FROM cv WHERE n % 3 = 0
  UNION ALL SELECT 3, 'u' || user_id, CASE WHEN count(*) > 500 OR max(k) > 90 THEN 'rejected events' ELSE 'new' END FROM ev0 GROUP BY user_id
  UNION ALL SELECT 3, NULL, 'rejected no JSON object' FROM cv WHERE n % 7 = 0
  UNION ALL SELECT 3, 'o' || n, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'rejected content' END FROM cv WHERE n % 7 = 1)""".replace("SELECT batch, key", ", cv AS (SELECT session_id::BIGINT AS n, bool_or(role NOT IN ('user', 'assistant') OR role IS NULL OR text IS NULL) AS bad FROM turn GROUP BY session_id) SELECT batch, key", 1))
def intake_outcomes(s, d):
    """Three batches into one store: first lines, then the same or other bodies for their keys after some erasures, then typed events, older forms and broken lines."""
    folder = shared_folder(s, "store")
    intake.create(s, folder)
    sent, typed, line = _lines(s, d)
    n, session = F.col("n"), F.col("n").cast("string").alias("session_id")
    key = F.concat(F.lit("c"), n.cast("string"))
    one = F.lit("1")
    intake.take(sent.select(line(F.when(n % 5 < 4, key), one, session, "turns")), folder, 1)
    gone = intake.table(s, folder, "outcomes").where((F.col("outcome") == "new") & (F.substring("key", 2, 20).cast("long") % 6 == 0))
    intake.erase(gone.select(F.col("transcript_id").alias("id")), folder, 1)
    again = sent.where(n % 3 == 0).select(line(key, one, session, "turns"))
    intake.take(again.union(again).union(sent.where(n % 3 == 1).select(line(key, F.lit("2"), session, "turns"))), folder, 2)
    events = typed.select(line(F.concat(F.lit("u"), n.cast("string")), one, session, F.lit("events").alias("kind"), "events"))
    older = sent.where(n % 7 == 1).select(F.to_json(F.struct(F.concat(F.lit("o"), n.cast("string")).alias("idempotency_key"), session, F.lit("cli").alias("source"), F.when(n % 2 == 0, "said").alias("content"))).alias("value"))
    intake.take(events.union(older).union(sent.where(n % 7 == 0).select(F.lit("{broken").alias("value"))), folder, 3)
    done = intake.table(s, folder, "outcomes").select("batch", "key", "outcome")
    bad = intake.table(s, folder, "rejected").select("batch", F.get_json_object("line", "$.idempotency_key").alias("key"), F.concat(F.lit("rejected "), F.array_join("reasons", " ")).alias("outcome"))
    return done.union(bad).select(F.col("batch").cast("int").alias("batch"), "key", "outcome")


@query(f", rq AS (SELECT conv_id AS request, 'src' || (conv_id // 20) % 20 AS repo, (['decision','fact','lesson','command','todo','note','event'])[conv_id % 7 + 1] AS type, {t.START_MS} + conv_id * 977000 AS moment FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 20 = 0)) SELECT request, id FROM rq JOIN mem ON mem.repo = rq.repo AND mem.type = rq.type AND valid_from <= moment AND (valid_to IS NULL OR moment < valid_to)")
def valid_at_requests(s, d):
    """The memories of a repository and type that were valid at the moment of every conversation whose id is divisible by 20."""
    n = F.col("request")
    requests = t.read(s, d, "conversations").select(F.col("conv_id").alias("request")).where("request % 20 = 0").distinct()
    requests = requests.select("request", F.concat(F.lit("src"), F.expr("string((request div 20) % 20)")).alias("repo"), F.get(F.array(*[F.lit(k) for k in t.TYPES]), (n % 7).cast("int")).alias("type"), (t.START_MS + n * 977_000).alias("at"))
    return history.valid_at(t.memories(s, d), requests, ["repo", "type"])
