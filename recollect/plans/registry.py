"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import scoring, text
from recollect.operators import budget, chunks, memory, proposals, redact, search
from recollect.plans import more  # noqa: F401  registers its queries too
from recollect.plans.catalog import ORACLES, QUERIES, Query, query, r6
from recollect.session import written
from recollect.sources import tables as t

NOW = t.NOW_MS
WORDS = "stupid idiot"
POINT = [((i * 37) % 19 - 9) / 9 for i in range(64)]


@query("SELECT id, type, repo, importance, scope FROM mem WHERE id = '42'")
def point_lookup(s, d):
    return t.memories(s, d).where("id = '42'").select("id", "type", "repo", "importance", "scope")


@query("SELECT type, count(*) AS n FROM mem GROUP BY type")
def memory_counts_by_type(s, d):
    return t.memories(s, d).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT state, count(*) AS n FROM job GROUP BY state")
def job_counts_by_state(s, d):
    return t.jobs(s, d).groupBy("state").agg(F.count("*").alias("n"))


@query(f"SELECT strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H') AS hour, count(*) AS n FROM mem WHERE created_at > {NOW} - 86400000 AND created_at <= {NOW} GROUP BY 1")
def hourly_throughput(s, d):
    return t.memories(s, d).where(f"created_at > {NOW} - 86400000 and created_at <= {NOW}").groupBy(F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT day, round(sum(usd), 2) AS usd_total, count(*) AS calls FROM spend GROUP BY day")
def budget_by_day(s, d):
    return t.spend(s, d).groupBy("day").agg(F.round(F.sum("usd"), 2).alias("usd_total"), F.count("*").alias("calls"))


@query("SELECT coalesce(round(sum(usd), 2), 0.0) AS usd_total, count(*) AS calls FROM spend WHERE day LIKE '1995-03%'")
def budget_month_to_date(s, d):
    return t.spend(s, d).where(F.col("day").startswith("1995-03")).agg(F.coalesce(F.round(F.sum("usd"), 2), F.lit(0.0)).alias("usd_total"), F.count("*").alias("calls"))


USED = "count(DISTINCT CASE WHEN family = 'recall_used' THEN atom_id END)"
SERVED = "count(DISTINCT CASE WHEN family = 'recall_served' THEN atom_id END)"


@query("SELECT atom_id AS id, sum(CASE WHEN family = 'recall_used' THEN 1 ELSE 0 END)::BIGINT AS used, sum(CASE WHEN family = 'memory_corrected' THEN 1 ELSE 0 END)::BIGINT AS corrected, round((sum(CASE WHEN family = 'recall_used' THEN 1 ELSE 0 END) + 1) / (sum(CASE WHEN family IN ('recall_used', 'memory_corrected') THEN 1 ELSE 0 END) + 2)::DOUBLE, 6) AS useful FROM ev WHERE event_type = 'usefulness' GROUP BY atom_id")
def usefulness_scores(s, d):
    return memory.usefulness_scores(t.memory_events(s, d)).select("id", "used", "corrected", r6("useful"))


@query(f"SELECT {SERVED} AS served, {USED} AS used, round(CASE WHEN {SERVED} > 0 THEN {USED} / {SERVED}::DOUBLE END, 6) AS rate FROM ev WHERE event_type = 'usefulness' AND surface = 'search' AND created_at >= {t.START_MS} + 20 * 86400000")
def usefulness_rate(s, d):
    return memory.usefulness_rate(t.memory_events(s, d), t.START_MS + 20 * t.DAY_MS, "search").select("served", "used", r6("rate"))


@query(f"SELECT type, {SERVED} AS served, {USED} AS used, round(CASE WHEN {SERVED} > 0 THEN {USED} / {SERVED}::DOUBLE END, 6) AS rate FROM ev JOIN mem ON ev.atom_id = mem.id WHERE event_type = 'usefulness' GROUP BY type HAVING {SERVED} > 0 OR {USED} > 0")
def usefulness_by_type(s, d):
    return memory.usefulness_by_type(t.memory_events(s, d), t.memories(s, d)).select("type", "served", "used", r6("rate"))


@query("SELECT repo, type, count(*) AS n FROM mem GROUP BY repo, type")
def session_digest(s, d):
    return t.memories(s, d).groupBy("repo", "type").agg(F.count("*").alias("n"))


@query("SELECT coalesce(max(seq), 0) AS last_acked FROM ev WHERE synced_at IS NOT NULL")
def last_acked_seq(s, d):
    return t.memory_events(s, d).where("synced_at is not null").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_acked"))


@query("SELECT seq, atom_id, event_type, mem.scope AS scope FROM ev LEFT JOIN mem ON ev.atom_id = mem.id WHERE synced_at IS NULL AND (mem.scope IN ('team', 'org') OR (event_type = 'erase_request' AND ev.scope IN ('team', 'org'))) ORDER BY seq LIMIT 200")
def unsynced_batch(s, d):
    return memory.unsynced(t.memory_events(s, d), t.memories(s, d))


@query("SELECT seq, CASE WHEN synced_at IS NULL AND seq <= 500 THEN 1 ELSE 0 END AS acked FROM ev")
def sync_ack(s, d):
    return t.memory_events(s, d).select("seq", (F.col("synced_at").isNull() & (F.col("seq") <= 500)).cast("int").alias("acked"))


@query("SELECT id, type, created_at FROM mem ORDER BY created_at DESC, id LIMIT 25")
def recent_memories(s, d):
    return t.memories(s, d).orderBy(F.desc("created_at"), "id").limit(25).select("id", "type", "created_at")


@query("SELECT id, state, attempts FROM job WHERE state IN ('failed', 'poison') ORDER BY created_at DESC, id LIMIT 20")
def recent_failures(s, d):
    return t.jobs(s, d).where("state in ('failed', 'poison')").orderBy(F.desc("created_at"), "id").limit(20).select("id", "state", "attempts")


@query("SELECT id, state FROM job WHERE state = 'pending' ORDER BY created_at, id LIMIT 1")
def next_claim(s, d):
    return t.jobs(s, d).where("state = 'pending'").orderBy("created_at", "id").limit(1).select("id", "state")


@query("SELECT atom_id, seq, event_type FROM ev WHERE atom_id = '7'")
def event_history(s, d):
    return t.memory_events(s, d).where("atom_id = '7'").select("atom_id", "seq", "event_type")


@query("SELECT DISTINCT type FROM mem WHERE valid_to IS NULL")
def valid_types(s, d):
    return t.memories(s, d).where("valid_to is null").select("type").distinct()


@query("SELECT 'create' AS event_type, id AS atom_id, created_at, '{\"backfill\":true}' AS payload_json FROM mem")
def backfill_events(s, d):
    return t.memories(s, d).select(F.lit("create").alias("event_type"), F.col("id").alias("atom_id"), "created_at", F.lit('{"backfill":true}').alias("payload_json"))


@query(f"SELECT id, type FROM mem WHERE valid_from <= {NOW} - 7200000 AND (valid_to IS NULL OR valid_to > {NOW} - 7200000)")
def as_of_validity(s, d):
    return t.memories(s, d).where(f"valid_from <= {NOW} - 7200000 and (valid_to is null or valid_to > {NOW} - 7200000)").select("id", "type")


@query("SELECT id, strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created, scope, '' AS evidence FROM mem")
def wire_projection(s, d):
    return t.memories(s, d).select("id", F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"), "scope", F.lit("").alias("evidence"))


@query("SELECT type, count(*) AS n, sum(CASE WHEN length(text) BETWEEN 5 AND 500 THEN 1 ELSE 0 END)::BIGINT AS good FROM mem GROUP BY type")
def atom_validity(s, d):
    return t.memories(s, d).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("text").between(5, 500).cast("long")).alias("good"))


DISTANCE = f"sqrt(list_sum(list_transform(list_zip(embedding, {POINT}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


@query(f"SELECT vec_id AS id, round({DISTANCE}, 6) AS distance, round(1 / (1 + {DISTANCE}), 6) AS score FROM embeddings ORDER BY {DISTANCE}, vec_id LIMIT 20")
def knn(s, d):
    return search.nearest(t.vectors(s, d), POINT, 20).select("id", r6("distance"), r6("score"))


TERMS = rf"list_filter(regexp_split_to_array(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
BM25 = f"""own AS (SELECT id, {TERMS} AS w FROM mem), tf AS (SELECT id, 2 * len(w) AS size, 2 * len(list_filter(w, lambda x: x = 'stupid')) AS f0, 2 * len(list_filter(w, lambda x: x = 'idiot')) AS f1 FROM own),
c AS (SELECT count(*) AS n, avg(size) AS mean, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM tf), idf AS (SELECT *, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) AS i0, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) AS i1 FROM c),
bm AS (SELECT id, -(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / mean)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean))) AS bm25 FROM tf, idf WHERE f0 > 0 AND f1 > 0)"""


@query(f", {BM25} SELECT id, round(bm25, 6) AS bm25 FROM bm")
def bm25(s, d):
    return search.keyword_scores(t.memories(s, d), WORDS).select("id", r6("bm25"))


def _hybrid(s, d, mode="hybrid", **filters):
    return hybrid_of(s, d, search.keyword_scores(t.memories(s, d), WORDS), mode, **filters)


def hybrid_of(s, d, keyword, mode="hybrid", **filters):
    vector = search.nearest(t.vectors(s, d), POINT, 50).select(F.col("id").cast("string").alias("id"), "score")
    useful = memory.usefulness_scores(t.memory_events(s, d)).select("id", "useful")
    return search.hybrid(t.memories(s, d), keyword, vector, useful, NOW, 10, mode=mode, **filters)


HYBRID = f""", {BM25}, k AS (SELECT id, -bm25 AS k FROM bm ORDER BY bm25, id LIMIT 50), v AS (SELECT CAST(vec_id AS VARCHAR) AS id, 1 / (1 + {DISTANCE}) AS v FROM embeddings ORDER BY {DISTANCE}, vec_id LIMIT 50),
b AS (SELECT coalesce(k.id, v.id) AS id, k, v FROM k FULL JOIN v ON k.id = v.id),
n AS (SELECT *, CASE WHEN k IS NULL THEN 0 WHEN min(k) OVER () = max(k) OVER () THEN 1 ELSE (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) END AS nk, CASE WHEN v IS NULL THEN 0 WHEN min(v) OVER () = max(v) OVER () THEN 1 ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) END AS nv FROM b),
u AS (SELECT atom_id AS id, (sum((family = 'recall_used')::INT) + 1) / (sum((family IN ('recall_used', 'memory_corrected'))::INT) + 2)::DOUBLE AS useful FROM ev WHERE event_type = 'usefulness' GROUP BY atom_id),
f AS (SELECT n.id, mem.type, 0.4 * nk + 0.4 * nv + 0.1 * importance + 0.1 * exp(-(({NOW} - created_at) / 86400000.0) / 30) + 0.1 * coalesce(useful, 0.5) AS score, CASE WHEN k IS NOT NULL AND v IS NOT NULL THEN 'both' WHEN k IS NOT NULL THEN 'fts' ELSE 'vec' END AS source, 0.4 * nk AS keyword_part, 0.4 * nv AS vector_part FROM n JOIN mem ON n.id = mem.id LEFT JOIN u ON u.id = n.id WHERE valid_to IS NULL)
SELECT id, type, round(score, 6) AS score, source, round(keyword_part, 6) AS keyword_part, round(vector_part, 6) AS vector_part FROM f ORDER BY f.score DESC, id LIMIT 10"""


@query(HYBRID)
def hybrid_search(s, d):
    return _hybrid(s, d).select("id", "type", r6("score"), "source", r6("keyword_part"), r6("vector_part"))


@query(HYBRID.replace("ORDER BY bm25, id LIMIT 50", "ORDER BY bm25, id LIMIT 0"))
def semantic_search(s, d):
    return _hybrid(s, d, "semantic").select("id", "type", r6("score"), "source", r6("keyword_part"), r6("vector_part"))


@query(HYBRID.replace("vec_id LIMIT 50", "vec_id LIMIT 0"))
def keyword_search(s, d):
    return _hybrid(s, d, "keyword").select("id", "type", r6("score"), "source", r6("keyword_part"), r6("vector_part"))


@query(HYBRID.replace("WHERE valid_to IS NULL", f"WHERE valid_to IS NULL AND mem.project IN ('en', 'de') AND mem.type IN ('fact', 'lesson', 'note') AND created_at >= {t.START_MS} + 3600000"))
def filtered_search(s, d):
    return _hybrid(s, d, types=("fact", "lesson", "note"), projects=("en", "de"), since_ms=t.START_MS + 3_600_000).select("id", "type", r6("score"), "source", r6("keyword_part"), r6("vector_part"))


EXPLAINED = HYBRID.replace("0.4 * nv AS vector_part FROM n", f"0.4 * nv AS vector_part, 0.1 * importance AS importance_part, 0.1 * exp(-(({NOW} - created_at) / 86400000.0) / 30) AS freshness_part, 0.1 * coalesce(useful, 0.5) AS usefulness_part FROM n")


@query(EXPLAINED.replace("round(vector_part, 6) AS vector_part FROM f", "round(vector_part, 6) AS vector_part, round(importance_part, 6) AS importance_part, round(freshness_part, 6) AS freshness_part, round(usefulness_part, 6) AS usefulness_part FROM f"))
def score_explanations(s, d):
    return _hybrid(s, d).select("id", "type", r6("score"), "source", *[r6(f"{n}_part") for n in ("keyword", "vector", "importance", "freshness", "usefulness")])


@query(f", own AS (SELECT id, {TERMS} AS w FROM mem), p AS (SELECT id, unnest(w) AS term FROM own) SELECT term, count(DISTINCT id) AS documents, 2 * count(*) AS occurrences FROM p GROUP BY term")
def inverted_index(s, d):
    return search.postings(t.memories(s, d)).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(f", {BM25} SELECT id, round(bm25, 6) AS bm25 FROM bm")
def indexed_bm25(s, d):
    index = written(search.postings_and_sizes(t.memories(s, d)))
    return search.indexed_scores(index, search.index_corpus(index), WORDS).select("id", r6("bm25"))


PACK = f""", c AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id) AS age FROM mem WHERE valid_to IS NULL),
sc AS (SELECT *, CASE type WHEN 'decision' THEN 1.0 WHEN 'lesson' THEN 0.9 WHEN 'fact' THEN 0.7 WHEN 'command' THEN 0.6 ELSE 0.4 END::DOUBLE * exp(-(({NOW} - created_at) / 86400000.0) / 30) * importance AS score, ceil(length(text) / 4.0)::BIGINT AS tokens FROM c WHERE age <= 500),
p AS (SELECT *, row_number() OVER o AS rank, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS total FROM sc WINDOW o AS (PARTITION BY repo ORDER BY score DESC, id)),
pack AS (SELECT * FROM p WHERE total <= 1500 OR rank = 1)"""


@query(f"{PACK} SELECT repo, id, type, round(score, 6) AS score, tokens, rank::INT AS rank, total::BIGINT AS total FROM pack")
def memory_pack(s, d):
    return memory.select_pack(t.memories(s, d), NOW).select("repo", "id", "type", r6("score"), "tokens", "rank", "total")


@query()
def rendered_pack(s, d):
    return memory.render_pack(memory.select_pack(t.memories(s, d), NOW))


PROMPTS = r"prompts AS (SELECT session_id || ':' || turn AS prompt_id, 'src' || (CAST(session_id AS BIGINT) % 25) AS repo, text AS prompt FROM turn WHERE role = 'user')"
ASKS = r"regexp_matches(prompt, '(?i)\b(remember|recall|last time|previously|we decided|as before|earlier session|what did (i|we))\b')"


@query(rf"""{PACK}, {PROMPTS}, best AS (SELECT repo, max(score) AS best FROM pack GROUP BY repo),
r AS (SELECT prompt_id, prompts.repo, prompt, CASE WHEN NOT {ASKS} AND regexp_matches(prompt, '(?i)^\s*(hi|hey|hello|thanks?|thank you|ok(ay)?|yes|no|cool|nice|lol|good (morning|evening|night)|how are you)\s*[!.?]*\s*$') THEN 'smalltalk' WHEN NOT {ASKS} AND length(trim(prompt)) < 12 THEN 'prompt-too-short' WHEN best IS NULL THEN 'empty-pack' WHEN best < 0.15 THEN 'below-min-score' ELSE 'injected' END AS reason FROM prompts LEFT JOIN best ON prompts.repo = best.repo)
SELECT prompt_id, repo, reason, reason = 'injected' AS inject, CASE WHEN length(prompt) <= 4000 THEN 1500 ELSE greatest(300, round(1500 * greatest(0.0, 1 - (length(prompt) - 4000) / 16000.0))) END::BIGINT AS budget_tokens FROM r""")
def injection_decisions(s, d):
    prompts = t.turns(s, d).where("role = 'user'").select(F.concat_ws(":", "session_id", "turn").alias("prompt_id"), F.concat(F.lit("src"), (F.col("session_id").cast("long") % 25).cast("string")).alias("repo"), F.col("text").alias("prompt"))
    return memory.decide_injection(prompts, memory.select_pack(t.memories(s, d), NOW))


@query("SELECT min(id::BIGINT) AS id, hash FROM mem WHERE hash NOT IN (SELECT hash FROM mem WHERE scope = 'org' AND type = 'todo') AND hash NOT IN (SELECT hash FROM mem WHERE type = 'fact') AND type NOT IN ('fact', 'todo') GROUP BY hash")
def insert_new_memories(s, d):
    m = t.memories(s, d)
    candidates = m.where("type not in ('fact', 'todo')").select("hash", F.col("id").cast("long").alias("ord"))
    return memory.insert_new(m.where("type = 'fact'"), candidates, m.where("scope = 'org' and type = 'todo'")).select(F.col("ord").alias("id"), "hash")


LOG = "lg AS (SELECT seq, atom_id, created_at, CASE seq % 4 WHEN 0 THEN 'invalidate' WHEN 1 THEN 'supersede' WHEN 2 THEN 'promote_scope' ELSE CASE WHEN seq % 7 = 0 THEN 'erase_request' ELSE 'usefulness' END END AS kind FROM ev WHERE event_type IN ('create', 'erase_request'))"


@query(f""", {LOG}, x AS (SELECT atom_id, min(CASE WHEN kind IN ('invalidate', 'supersede') THEN seq END) AS ended, max(CASE WHEN kind = 'promote_scope' THEN 2 + seq % 2 END) AS promoted, max(CASE WHEN kind = 'erase_request' THEN 1 ELSE 0 END) AS erased FROM lg GROUP BY atom_id)
SELECT id, type, coalesce(valid_to, lg.created_at) AS valid_to, CASE WHEN lg.kind = 'supersede' THEN '0' END AS superseded_by, (['personal', 'team', 'org'])[greatest(list_position(['personal', 'team', 'org'], scope), coalesce(promoted, 0))] AS scope
FROM mem LEFT JOIN x ON mem.id = x.atom_id LEFT JOIN lg ON lg.seq = x.ended WHERE coalesce(erased, 0) = 0""")
def fold_state(s, d):
    n = F.col("seq") % 4
    kind = F.when(n == 0, "invalidate").when(n == 1, "supersede").when(n == 2, "promote_scope").when(F.col("seq") % 7 == 0, "erase_request").otherwise("usefulness")
    payload = F.when(n == 1, F.lit('{"superseded_by":"0"}')).when(n == 2, F.concat(F.lit('{"to":"'), F.when(F.col("seq") % 2 == 0, "team").otherwise("org"), F.lit('"}')))
    log = t.memory_events(s, d).where("event_type in ('create', 'erase_request')").select("seq", "atom_id", "created_at", kind.alias("event_type"), payload.alias("payload_json"))
    return memory.fold_state(t.memories(s, d), log)


@query("SELECT mem.id, CASE WHEN c.id IS NULL THEN 'new' WHEN c.hash = mem.hash THEN 'replay' ELSE 'conflict' END AS status FROM mem LEFT JOIN (SELECT id, CASE WHEN id::BIGINT % 6 = 0 THEN 'other' ELSE hash END AS hash FROM mem WHERE id::BIGINT % 2 = 0) c ON mem.id = c.id")
def idempotency_status(s, d):
    m = t.memories(s, d)
    n = F.col("id").cast("long")
    claims = m.where(n % 2 == 0).select(F.col("id").alias("key"), F.when(n % 6 == 0, "other").otherwise(F.col("hash")).alias("body_hash"))
    return memory.claim_status(m.select(F.col("id").alias("key"), F.col("hash").alias("body_hash")), claims).select(F.col("key").alias("id"), "status")


MESSAGES = ["HTTP 503 from host", "Zod issue", "Unexpected token < in JSON", "ECONNRESET", "1500 tokens left", "something else", "status 404"]


@query(f"""SELECT id, m, CASE WHEN regexp_matches(lower(m), 'econnrefused|etimedout|econnreset|enetunreach|ehostunreach|epipe|rate limit|rate-limit|ratelimit|429|500|502|503|504') THEN 'transient' WHEN regexp_matches(lower(m), 'zod|json parse|json\\.parse|unexpected token|unexpected end of json|invalid json|parse error|parse fail|schema|validation fail|validation error|400|401|403|404|422') THEN 'deterministic' ELSE 'transient' END AS kind FROM (SELECT id, ({MESSAGES})[id % 7 + 1] AS m FROM job)""")
def error_kinds(s, d):
    m = F.get(F.array(*[F.lit(x) for x in MESSAGES]), (F.col("id") % 7).cast("int"))
    return t.jobs(s, d).select("id", m.alias("m"), scoring.classify_error(m).alias("kind"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'paused' WHEN id % 3 = 1 OR attempts + 1 >= 3 THEN 'poison' ELSE 'pending' END AS state, CASE WHEN id % 3 = 0 THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN id % 3 = 2 AND attempts + 1 < 3 THEN least(1000 * pow(2, attempts), 60000)::BIGINT ELSE 0 END AS delay_ms FROM job WHERE state IN ('failed', 'poison')")
def retry_router(s, d):
    kind = F.when(F.col("id") % 3 == 0, "budget").when(F.col("id") % 3 == 1, "deterministic").otherwise("transient")
    return t.jobs(s, d).where("state in ('failed', 'poison')").select("id", scoring.next_state(kind, F.col("attempts")).alias("n")).select("id", "n.*")


@query("SELECT id FROM job WHERE NOT (state = 'completed' AND created_at < epoch_ms(TIMESTAMP '1997-01-01'))")
def cleanup_jobs(s, d):
    return t.jobs(s, d).where(~((F.col("state") == "completed") & (F.col("created_at") < F.unix_millis(F.lit("1997-01-01").cast("timestamp"))))).select("id")


@query("SELECT id, attempts, least(30000 * pow(2, attempts), 900000)::BIGINT AS delay_ms FROM job")
def sync_backoff(s, d):
    return t.jobs(s, d).select("id", "attempts", scoring.backoff_ms(F.col("attempts")).alias("delay_ms"))


@query("SELECT id, mem.scope AS scope, count(seq) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM mem LEFT JOIN ev ON ev.atom_id = mem.id GROUP BY id, mem.scope")
def why_receipts(s, d):
    e = t.memory_events(s, d).select(F.col("atom_id").alias("id"), "seq")
    return t.memories(s, d).join(e, "id", "left").groupBy("id", "scope").agg(F.count("seq").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT row_number() OVER (ORDER BY created_at, id) + (SELECT max(seq) FROM ev) AS seq, id AS atom_id FROM mem WHERE type = 'decision'")
def next_sequence(s, d):
    return memory.appended(t.memories(s, d).where("type = 'decision'"), t.memory_events(s, d))


@query("SELECT atom_id AS id, count(*) AS n FROM ev WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.id = ev.atom_id) GROUP BY atom_id")
def dangling_references(s, d):
    return t.memory_events(s, d).join(t.memories(s, d).select(F.col("id").alias("atom_id")), "atom_id", "left_anti").groupBy(F.col("atom_id").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS source_hash FROM turn GROUP BY session_id")
def flattened_transcripts(s, d):
    rows = t.turns(s, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    body = text.flattened_turns(F.to_json(F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))))
    return rows.select("session_id", body.alias("body")).withColumn("source_hash", F.sha2("body", 256))


@query()
def cleaned_texts(s, d):
    return t.memories(s, d).select("id", F.sha2(text.cleaned(F.col("text")), 256).alias("cleaned"))


@query()
def transcript_chunks(s, d):
    body = flattened_transcripts(s, d)
    return chunks.chunk(body, "session_id", "body")


@query(r"""SELECT type, text, importance, place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY importance DESC, ord) AS n, min(ord) OVER (PARTITION BY k) AS place FROM (SELECT id::BIGINT AS ord, type, text, importance, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS k FROM mem)) WHERE n = 1""")
def reduced_atoms(s, d):
    atoms = t.memories(s, d).select(F.col("id").cast("long").alias("ord"), "type", "text", "importance")
    return memory.reduce_atoms(atoms).select("type", "text", "importance", "place")


@query()
def normalized_memories(s, d):
    return t.memories(s, d).select("id", F.sha2(text.normalized(F.col("text")), 256).alias("final_hash"))


@query("SELECT id, ceil(length(text) / 4.0)::BIGINT AS tokens, round(ceil(length(text) / 4.0) * 2e-6 + 0.001, 9) AS usd, round(ceil(length(text) / 4.0) / 1e6 * 2.5 + 500 / 1e6 * 10, 9) AS model_usd FROM mem")
def token_costs(s, d):
    n = scoring.token_estimate(F.col("text"))
    return t.memories(s, d).select("id", n.alias("tokens"), F.round(scoring.estimate_usd(F.length("text")), 9).alias("usd"), F.round(scoring.token_cost(F.lit("gpt-4o"), n, F.lit(500)), 9).alias("model_usd"))


GATE = """, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY moment, id) AS place FROM calls),
g AS (SELECT grp, id, place, amount <= {cap} AS fits, CASE WHEN amount <= {cap} THEN amount ELSE 0 END AS spent FROM k WHERE place = 1
  UNION ALL SELECT k.grp, k.id, k.place, g.spent + k.amount <= {cap}, g.spent + CASE WHEN g.spent + k.amount <= {cap} THEN k.amount ELSE 0 END FROM g JOIN k ON k.grp = g.grp AND k.place = g.place + 1)"""


@query(f", calls AS (SELECT id, repo AS grp, created_at AS moment, coalesce(ceil(length(text) / 4.0)::BIGINT * 2 + 1000, 0) AS amount FROM mem){GATE.format(cap=50_000)} SELECT id, fits FROM g", recursive=True)
def budget_gate(s, d):
    """Micro-dollars of every memory's extraction, under a cap for each repository."""
    calls = t.memories(s, d).select("id", F.col("repo").alias("grp"), F.col("created_at").alias("at"), (scoring.token_estimate(F.col("text")) * 2 + 1000).alias("amount"))
    return budget.gated(calls, 50_000).select("id", "fits")


@query(f", calls AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS grp, o_custkey AS moment, round(o_totalprice * 100)::BIGINT AS amount FROM orders){GATE.format(cap=50_000_000)}, s AS (SELECT grp AS day, count(*) AS calls, count(*) FILTER (fits) AS accepted, max(spent)::BIGINT AS spent FROM g GROUP BY grp) SELECT * FROM s", recursive=True)
def budget_of_days(s, d):
    """What the days' caps let through, and what was spent."""
    calls = t.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("grp"), F.col("o_custkey").alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    rows = budget.gated(calls, 50_000_000).groupBy(F.col("grp").alias("day"))
    return rows.agg(F.count("*").alias("calls"), F.count_if("fits").alias("accepted"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("amount"))), F.lit(0)).alias("spent"))


@query()
def redacted_documents(s, d):
    return redact.redacted_rows(t.memories(s, d).select("id", "text")).select("id", F.sha2("r.text", 256).alias("redacted"), F.size("r.types").alias("n"))


@query()
def redaction_findings(s, d):
    """Every finding of every memory, with its offset."""
    rows = redact.redacted_rows(t.memories(s, d).select("id", "text")).select("id", F.explode("r.events").alias("e"))
    return rows.select("id", "e.type", "e.hash8", "e.offset")


@query()
def redacted_turns(s, d):
    """Transcripts as they are stored: their turns redacted, with the number of findings."""
    turns = t.turns(s, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = redact.redacted_lists(turns, "turns", "text")
    return rows.select("session_id", F.size("turns").alias("turns"), F.sha2(F.array_join("turns.text", "\n"), 256).alias("stored"), F.size("findings").alias("findings"))


@query()
def redaction_counts(s, d):
    return redact.counts(redact.redacted_rows(t.memories(s, d).select("text")).select("r.types"))


@query("SELECT CASE WHEN label_a = 0 THEN 0 ELSE label_a END AS repo, a, b, round(sim, 6) AS similarity, CASE WHEN sim >= 0.3 THEN 'merge' ELSE 'propose' END AS action FROM (SELECT x.label AS label_a, x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE sim >= 0.2")
def consolidation_pairs(s, d):
    return memory.near_pairs(t.vectors(s, d), 0.3, 0.2).select("repo", "a", "b", r6("similarity"), "action")


@query("SELECT label AS repo, count(*) AS size, count(*) > 45 AS oversize FROM embeddings GROUP BY label")
def consolidation_groups(s, d):
    return t.vectors(s, d).groupBy("repo").agg(F.count("*").alias("size")).withColumn("oversize", F.col("size") > 45)


GRADED = "g AS (SELECT source AS query, doc_id AS item, quality + 2 * (1 - toxic) AS grade FROM documents JOIN labels USING (doc_id)), rk AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)"


@query(f""", {GRADED}, h AS (SELECT g.query, g.item, grade, CASE WHEN place <= 10 THEN place END AS place, row_number() OVER (PARTITION BY g.query ORDER BY grade DESC, g.item) AS best FROM g LEFT JOIN rk ON g.query = rk.query AND g.item = rk.item),
a AS (SELECT query, sum((grade > 0)::INT) AS relevant, sum((grade > 0 AND place IS NOT NULL)::INT) AS found, sum(CASE WHEN place IS NOT NULL THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (pow(2, grade) - 1) / log2(best + 1) ELSE 0 END) AS idcg FROM h GROUP BY query)
SELECT query, round(CASE WHEN relevant = 0 THEN 1 ELSE found / relevant::DOUBLE END, 6) AS recall, round(CASE WHEN idcg = 0 THEN 1 ELSE dcg / idcg END, 6) AS ndcg FROM a""")
def retrieval_quality(s, d):
    docs, labels = t.read(s, d, "documents"), t.read(s, d, "labels")
    graded = docs.join(labels, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), (F.col("quality") + 2 * (1 - F.col("toxic"))).alias("grade"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("item"), place.alias("place"))
    return memory.ranking_quality(ranked, graded, 10).select("query", r6("recall"), r6("ndcg"))


@query("SELECT repo, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id) AS n FROM mem) WHERE n <= 3")
def retention(s, d):
    return t.memories(s, d).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("created_at"), "id"))).where("n <= 3").select("repo", "id")


PAIR = "least({0}.winner, {0}.loser) = least(prop.winner, prop.loser) AND greatest({0}.winner, {0}.loser) = greatest(prop.winner, prop.loser)"


@query(f"SELECT id, winner, loser FROM prop WHERE NOT EXISTS (SELECT 1 FROM prop q WHERE q.id % 3 = 0 AND {PAIR.format('q')})")
def new_proposals(s, d):
    pairs = t.proposals(s, d)
    pending = pairs.where("id % 3 = 0").select(F.col("loser").alias("winner"), F.col("winner").alias("loser"))
    return proposals.unproposed(pairs, pending).select("id", "winner", "loser")


@query("SELECT prop.id AS id, winner, loser, w.text AS winner_text, l.text AS loser_text FROM prop LEFT JOIN mem w ON w.id = winner LEFT JOIN mem l ON l.id = loser")
def proposal_texts(s, d):
    return proposals.with_texts(t.proposals(s, d), t.memories(s, d)).select("id", "winner", "loser", "winner_text", "loser_text")


@query("SELECT seq, proposal, CASE WHEN prop.id IS NULL THEN 'missing' WHEN seq = min(seq) OVER (PARTITION BY proposal) THEN action ELSE 'conflict' END AS outcome FROM verdict LEFT JOIN prop ON prop.id = proposal")
def proposal_decisions(s, d):
    return proposals.decided(t.proposals(s, d), t.decisions(s, d))


@query(f"SELECT session_id, {t.START_MS} + min(turn) * 1000 AS started_at, (max({{'o': turn, 'v': role}}) FILTER (WHERE turn % 3 = 0)).v AS project, (max({{'o': turn, 'v': 'agent' || turn}}) FILTER (WHERE role = 'assistant')).v AS agent FROM turn GROUP BY session_id")
def session_upserts(s, d):
    agent, project = F.when(F.col("role") == "assistant", F.concat(F.lit("agent"), F.col("turn"))), F.when(F.col("turn") % 3 == 0, F.col("role"))
    ingests = t.turns(s, d).select("session_id", F.col("turn").alias("ord"), (F.lit(t.START_MS) + F.col("turn") * 1000).alias("started_at"), project.alias("project"), agent.alias("agent"))
    return proposals.upsert_sessions(ingests, ["project", "agent"])


@query("""SELECT type, line, content FROM (SELECT type, content, row_number() OVER (PARTITION BY type ORDER BY n, k) AS line FROM (SELECT type, n, unnest(ls) AS content, generate_subscripts(ls, 1) AS k
FROM (SELECT type, row_number() OVER (PARTITION BY type ORDER BY created_at, id) AS n, string_split('- [' || id || '] ' || coalesce(text, ''), chr(10)) AS ls FROM mem WHERE valid_to IS NULL))) WHERE line BETWEEN 2 AND 40""")
def memory_view(s, d):
    return proposals.view(t.memories(s, d), 2, 40)


@query("""SELECT type, sum((times > 0)::INT)::BIGINT AS memories, max(times) AS most, CASE WHEN sum((times > 0)::INT) = 0 THEN 'not found' WHEN sum((times > 0)::INT) > 1 THEN 'several memories' WHEN max(times) > 1 THEN 'several times' ELSE 'good' END AS status
FROM (SELECT type, coalesce(((length(text) - length(replace(text, 'stupid', ''))) // 6)::BIGINT, 0) AS times FROM mem WHERE valid_to IS NULL) GROUP BY type""")
def replace_targets(s, d):
    return proposals.replace_targets(t.memories(s, d), "stupid")


@query("SELECT session_id, turn, sha256(json_object('meta', json_object('agent', NULL, 'session', session_id), 'role', role, 'text', text, 'turn', turn)::VARCHAR) AS body_hash FROM turn")
def body_hashes(s, d):
    body = F.struct("turn", "text", "role", F.struct(F.col("session_id").alias("session"), F.lit(None).cast("string").alias("agent")).alias("meta"))
    rows = t.turns(s, d).select("session_id", "turn", body.alias("body"))
    return rows.select("session_id", "turn", F.sha2(text.stable_json(F.col("body"), rows.schema["body"].dataType), 256).alias("body_hash"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)


# These go on from the texts and functions above.
from recollect.plans import changes, indexes  # noqa: E402, F401  register their queries too
