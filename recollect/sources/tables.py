"""Domain relations over the driver's tables: memories, their events, vectors, transcripts, jobs and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1_704_067_200_000
NOW_MS = START_MS + 30 * 3_600_000
DAY_MS = 86_400_000
#: Memory types in their order, and scopes by rank.
TYPES = ("decision", "fact", "lesson", "command", "todo", "note", "event")
SCOPES = ("personal", "team", "org")


def _pick(values, number):
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per document, with type, scope, importance and validity by its id."""
    d = read(spark, sf_dir, "documents")
    n, created = F.col("doc_id"), F.lit(START_MS) + F.col("doc_id") * 60_000
    return d.select(
        n.cast("string").alias("id"), _pick(TYPES, n % 7).alias("type"), "text", F.col("source").alias("repo"), F.col("lang").alias("project"),
        ((n % 11).cast("double") / 10).alias("importance"), created.alias("created_at"), created.alias("valid_from"), F.when(n % 17 == 0, created + DAY_MS).alias("valid_to"),
        _pick(SCOPES, n % 3).alias("scope"), F.sha2("text", 256).alias("hash"),
    )


def memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; the payload is JSON with family, surface and scope."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    family = F.when(F.col("event_type").isin("view", "click"), "recall_served").when(F.col("event_type") == "purchase", "recall_used").when(F.col("event_type") == "error", "memory_corrected")
    payload = F.to_json(F.struct(family.alias("family"), _pick(("search", "pack", "tool"), k % 3).alias("surface"), _pick(SCOPES, k % 3).alias("scope")))
    kind = F.when(family.isNotNull(), "usefulness").when(k % 5 == 0, "erase_request").otherwise("create")
    return e.select(F.col("event_id").alias("seq"), kind.alias("event_type"), F.col("user_id").cast("string").alias("atom_id"), payload.alias("payload_json"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.when(F.col("event_id") % 4 == 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("synced_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repo"), "embedding")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("poison")
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of one job for each user: signups enqueue, the others act by their number; errors carry a message."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when((F.col("event_type") == "signup") | (k % 11 == 0), "enqueue").otherwise(_pick(("claim", "error", "requeue", "claim", "error", "requeue", "resume", "complete", None), k % 9))
    message = F.when(action == "error", _pick(("HTTP 503", "ETIMEDOUT while reading", "request failed", "Rate limit", "daily budget spent", "invalid JSON from model", "odd"), k % 7))
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), action.alias("action"), message.alias("message"))


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("usd"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories proposed for a merge, one per vector."""
    n = F.col("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(n.alias("id"), n.cast("string").alias("winner"), ((n * 7 + 3) % 400).cast("string").alias("loser"))
    return rows.where("winner <> loser")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_id") % 2 == 0, "accept").otherwise("reject")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("proposal"), action.alias("action"))


def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of a type an ingest had."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ingest"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("n"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))


#: The same relations for DuckDB, as the start of a WITH clause.
SQL = f"""
mem AS (SELECT CAST(doc_id AS VARCHAR) AS id, (['decision','fact','lesson','command','todo','note','event'])[doc_id % 7 + 1] AS type, text,
  source AS repo, lang AS project, CAST(doc_id % 11 AS DOUBLE) / 10 AS importance, {START_MS} + doc_id * 60000 AS created_at, {START_MS} + doc_id * 60000 AS valid_from,
  CASE WHEN doc_id % 17 = 0 THEN {START_MS} + doc_id * 60000 + {DAY_MS} END AS valid_to, (['personal','team','org'])[doc_id % 3 + 1] AS scope, sha256(text) AS hash FROM documents),
ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type IN ('view','click') THEN 'recall_served' WHEN event_type = 'purchase' THEN 'recall_used' WHEN event_type = 'error' THEN 'memory_corrected' END AS family FROM events),
ev AS (SELECT event_id AS seq, CASE WHEN family IS NOT NULL THEN 'usefulness' WHEN k % 5 = 0 THEN 'erase_request' ELSE 'create' END AS event_type, CAST(user_id AS VARCHAR) AS atom_id, family,
  (['search','pack','tool'])[k % 3 + 1] AS surface, (['personal','team','org'])[k % 3 + 1] AS scope, (epoch_us(ts) // 1000) AS created_at, CASE WHEN event_id % 4 = 0 THEN (epoch_us(ts) // 1000) END AS synced_at FROM ev0),
job AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'poison' END AS state, CAST(o_orderkey % 4 AS INTEGER) AS attempts, (epoch_us(o_orderdate) // 1000) AS created_at FROM orders),
jev AS (SELECT user_id AS job, event_id AS seq, action, CASE WHEN action = 'error' THEN (['HTTP 503','ETIMEDOUT while reading','request failed','Rate limit','daily budget spent','invalid JSON from model','odd'])[k % 7 + 1] END AS message
  FROM (SELECT *, CASE WHEN event_type = 'signup' OR k % 11 = 0 THEN 'enqueue' ELSE (['claim','error','requeue','claim','error','requeue','resume','complete',NULL])[k % 9 + 1] END AS action FROM ev0)),
spend AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS usd FROM orders),
prop AS (SELECT vec_id AS id, CAST(vec_id AS VARCHAR) AS winner, CAST((vec_id * 7 + 3) % 400 AS VARCHAR) AS loser FROM embeddings WHERE vec_id <> (vec_id * 7 + 3) % 400),
verdict AS (SELECT event_id AS seq, user_id AS proposal, CASE WHEN event_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS action FROM events),
turn AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text FROM conversations)
"""
