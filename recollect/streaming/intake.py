"""Intake with state: one reader for transcripts, typed events and the older form, a store split by hash prefixes, and rejected lines with their reasons.

A line is a JSON object, with an idempotency_key or without. Of what a key has claimed before, a batch reads only the prefixes of its own keys:

- new: the key is free; of several lines of a batch the first one by (captured_at, body_hash) claims it. Lines without a key are always new.
- replay: the key's claim has the same body; its transcript is named again, nothing is stored.
- conflict: the claim has another body.
- reinsert: the same body, but the claimed transcript was erased; the first such line stores it again.

Every table is split by (prefix, batch), and a batch decides by earlier batches only and overwrites its own folders: a batch that is run again after
a failure stores the same rows once. Texts are redacted before they are stored; body_hash is that of the body as it came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from recollect.functions import text
from recollect.operators import redact
from recollect.session import written

PREFIXES = 64
#: The fields of a line; names and limits of what they may be.
BODY = (
    "event string, session_id string, project_id string, agent_type string, cwd string, captured_at string, kind string, turns array<struct<role:string,text:string,ts:string>>, "
    "events array<struct<type:string,text:string,importance:double,confidence:double,evidence:string,occurred_at:double>>, tool string, client_scrub_applied boolean, client_scrub_hits long, "
    "client_version string, client_scrub_version string, client_scrub_hits_by_label map<string,long>, wire_version string, source string, content string, repo string, project string, branch string, agent string"
)
EVENTS = ("pre_compact", "session_end", "subagent_stop")
ROLES = ("user", "assistant")
TYPES = ("decision", "fact", "lesson", "command", "todo", "note", "event")
VERSION = r"^v(?:0|[1-9][0-9]*)\.[0-9]+$"
MOMENT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
MOST_EVENTS = 500

TABLES = {
    "claims": "key string, body_hash string, transcript_id string",
    "transcripts": "id string, session_id string, source string, content string, event string, captured_at long, wire_version string",
    "sessions": "session_id string, project string, agent string, started_at long",
    "jobs": "id string, kind string, transcript_id string, session_id string",
    "redactions": "session_id string, type string, n long",
    "outcomes": "key string, body_hash string, outcome string, transcript_id string",
    "rejected": "line string, reasons array<string>",
    "erased": "id string",
}


def prefix(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PREFIXES)).cast("int")


def create(spark: SparkSession, folder: str) -> None:
    """An empty store."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], f"{schema}, prefix int, batch long").write.partitionBy("prefix", "batch").parquet(f"{folder}/{name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, prefix int, batch long").parquet(f"{folder}/{name}")


def _put(rows: DataFrame, folder: str, name: str, by: Column, batch: int) -> None:
    placed = rows.withColumns({"prefix": prefix(by), "batch": F.lit(batch).cast("long")})
    placed.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(f"{folder}/{name}")


def erase(ids: DataFrame, folder: str, batch: int) -> None:
    """The transcripts (id) are gone from the batch after this one on."""
    _put(ids.select(F.col("id").cast("string").alias("id")).distinct(), folder, "erased", F.col("id"), batch)


def parsed(lines: DataFrame) -> DataFrame:
    """line, key, body, whether it is of the present form, and the reasons for which it is rejected (none: it is taken)."""
    record = F.from_json("value", f"idempotency_key string, {BODY}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    names = [f.split()[0] for f in BODY.split(", ")]
    rows = lines.select(F.col("value").alias("line"), record.alias("r"))
    rows = rows.select("line", F.col("r.idempotency_key").alias("key"), F.struct(*[F.col(f"r.{n}").alias(n) for n in names]).alias("body"), (F.col("r._corrupt").isNotNull() | F.col("r").isNull()).alias("broken"))
    return rows.withColumns({"canonical": _canonical(), "older": _older()}).withColumns(
        {"present": F.col("body.wire_version").isNotNull() & (F.size("canonical") == 0), "reasons": F.when(F.col("broken"), F.array(F.lit("no JSON object"))).when((F.size("canonical") == 0) | (F.size("older") == 0), F.array().cast("array<string>")).when(F.col("body.wire_version").isNotNull(), F.col("canonical")).otherwise(F.col("older"))}
    )


def _reasons(**checks: Column) -> Column:
    named = [F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def _canonical() -> Column:
    b = lambda name: F.col(f"body.{name}")
    share = lambda x: x.isNull() | x.between(0, 1)
    good_event = lambda e: F.coalesce(e["type"].isin(*TYPES) & (F.length(e["text"]) > 0) & share(e["importance"]) & share(e["confidence"]), F.lit(False))
    good_turn = lambda x: F.coalesce(x["role"].isin(*ROLES) & x["text"].isNotNull(), F.lit(False))
    typed = F.coalesce(b("kind"), F.lit("transcript")) == "events"
    return _reasons(
        event=b("event").isin(*EVENTS), session_id=b("session_id").isNotNull(), project_id=b("project_id").isNotNull(), captured_at=b("captured_at").rlike(MOMENT) & F.try_to_timestamp(b("captured_at")).isNotNull(),
        kind=b("kind").isNull() | b("kind").isin("transcript", "events"), client_scrub_applied=b("client_scrub_applied").isNotNull(), client_scrub_hits=b("client_scrub_hits") >= 0,
        client_version=b("client_version").isNotNull(), client_scrub_version=b("client_scrub_version").isNotNull(), wire_version=b("wire_version").rlike(VERSION),
        client_scrub_hits_by_label=b("client_scrub_hits_by_label").isNull() | F.forall(F.map_values(b("client_scrub_hits_by_label")), lambda x: F.coalesce(x >= 0, F.lit(False))),
        turns=F.when(typed, b("turns").isNull() | (F.size(b("turns")) > 0)).otherwise(F.size(b("turns")) > 0) & (b("turns").isNull() | F.forall(b("turns"), good_turn)),
        events=F.when(typed, F.size(b("events")).between(1, MOST_EVENTS)).otherwise(b("events").isNull() | F.size(b("events")).between(1, MOST_EVENTS)) & (b("events").isNull() | F.forall(b("events"), good_event)),
    )


def _older() -> Column:
    return _reasons(**{name: F.length(f"body.{name}") > 0 for name in ("session_id", "source", "content")})


def _decided(good: DataFrame, folder: str, batch: int) -> DataFrame:
    """good with outcome and transcript_id, by the claims of earlier batches under the batch's own prefixes."""
    spark = good.sparkSession
    named = lambda copy: F.substring(F.sha2(F.concat_ws("|", F.lit(str(batch)), F.coalesce("key", F.lit("")), "body_hash", copy.cast("string")), 256), 1, 32)
    free = good.where("key is null").select("*", F.lit("new").alias("outcome"), named(F.col("copy")).alias("transcript_id"))
    keyed = good.where("key is not null").withColumn("prefix", prefix(F.col("key")))
    touched = [r["prefix"] for r in keyed.select("prefix").distinct().collect()]
    earlier = table(spark, folder, "claims").where(F.col("prefix").isin(touched) & (F.col("batch") < batch)).join(keyed.select("key").distinct(), "key", "left_semi")
    claims = written(earlier.groupBy("key").agg(F.max_by(F.struct("body_hash", "transcript_id"), "batch").alias("c")).select("key", F.col("c.body_hash").alias("claimed"), F.col("c.transcript_id").alias("known")))
    held = [r["prefix"] for r in claims.select(prefix(F.col("known")).alias("prefix")).distinct().collect()]
    last = lambda name, column: table(spark, folder, name).where(F.col("prefix").isin(held) & (F.col("batch") < batch)).groupBy("id").agg(F.max("batch").alias(column))
    live = last("transcripts", "stored").join(last("erased", "erased"), "id", "left").where("erased is null or erased < stored").select(F.col("id").alias("known"), F.lit(True).alias("live"))
    claims = written(claims.join(live, "known", "left"))
    first = written(keyed.groupBy("key").agg(F.min(F.struct("captured", "body_hash"))["body_hash"].alias("first_hash")))
    rows = keyed.join(claims, "key", "left").join(first, "key").withColumn("claim", F.coalesce("claimed", "first_hash"))
    outcome = F.when(F.col("body_hash") != F.col("claim"), "conflict").when(F.col("live") | (F.col("copy") > 1), "replay").when(F.col("known").isNull(), "new").otherwise("reinsert")
    whose = F.when(outcome != "conflict", F.when(F.coalesce("live", F.lit(False)), F.col("known")).otherwise(named(F.lit(1))))
    return free.unionByName(rows.select(*good.columns, outcome.alias("outcome"), whose.alias("transcript_id")))


def take(lines: DataFrame, folder: str, batch: int, enabled: bool = True) -> None:
    """One batch of lines (value) into the store."""
    spark = lines.sparkSession
    rows = written(parsed(lines))
    _put(rows.where(F.size("reasons") > 0).select("line", "reasons"), folder, "rejected", F.col("line"), batch)
    kind = rows.schema["body"].dataType
    good = rows.where(F.size("reasons") == 0).withColumns({"body_hash": F.sha2(text.stable_json(F.col("body"), kind), 256), "captured": F.unix_millis(F.try_to_timestamp("body.captured_at"))})
    # Equal lines are told apart by their number only, so that a batch that is run again names the same transcripts.
    good = good.withColumn("copy", F.row_number().over(Window.partitionBy("key", "body_hash").orderBy("captured")))
    done = written(_decided(good.select("key", "body", "present", "body_hash", "captured", "copy"), folder, batch))
    new = done.where("outcome in ('new', 'reinsert')").select("transcript_id", "body.*", "present", "captured", (F.col("present") & (F.coalesce("body.kind", F.lit("transcript")) == "events")).alias("typed"))
    new = redact.redacted_lists(new, "turns", "text", enabled=enabled).withColumnRenamed("findings", "in_turns")
    new = redact.redacted_lists(new, "events", "text", enabled=enabled).withColumnRenamed("findings", "in_texts")
    new = redact.redacted_lists(new, "events", "evidence", enabled=enabled).withColumnRenamed("findings", "in_evidence")
    new = written(redact.redacted_rows(new, "content", enabled=enabled))
    stored = F.when(~F.col("present"), F.col("r.text")).when(F.col("typed"), F.to_json("events")).otherwise(F.to_json("turns"))
    source = F.when(~F.col("present"), F.col("source")).when(~F.col("typed"), F.coalesce("tool", F.lit("transcript"))).otherwise(F.coalesce(F.concat("tool", F.lit("-events")), F.lit("events")))
    version = F.coalesce(F.when(F.col("present"), F.col("wire_version")), F.lit("v0.0"))
    _put(new.select(F.col("transcript_id").alias("id"), "session_id", source.alias("source"), stored.alias("content"), F.when(F.col("present"), F.col("event")).alias("event"), F.col("captured").alias("captured_at"), version.alias("wire_version")), folder, "transcripts", F.col("id"), batch)
    project, agent = F.when(F.col("present"), F.col("project_id")).otherwise(F.col("project")), F.when(F.col("present"), F.col("agent_type")).otherwise(F.col("agent"))
    order = F.struct("captured", "transcript_id")
    sessions = new.select("session_id", project.alias("project"), agent.alias("agent"), "captured", order.alias("o")).groupBy("session_id")
    latest = lambda name: F.max(F.when(F.col(name).isNotNull(), F.struct("o", name)))[name].alias(name)
    _put(sessions.agg(latest("project"), latest("agent"), F.min("captured").alias("started_at")), folder, "sessions", F.col("session_id"), batch)
    job = F.substring(F.sha2(F.concat(F.lit("job:"), "transcript_id"), 256), 1, 32)
    _put(new.select(job.alias("id"), F.when(F.col("typed"), "distill-events").otherwise("distill").alias("kind"), "transcript_id", "session_id"), folder, "jobs", F.col("id"), batch)
    types = F.concat(*[F.when(F.col(w), F.transform(c, lambda x: x["type"])).otherwise(F.array().cast("array<string>")) for c, w in (("in_turns", "told_turns"), ("in_texts", "typed"), ("in_evidence", "typed"))], F.when(~F.col("present"), F.col("r.types")).otherwise(F.array().cast("array<string>")))
    found = new.withColumn("told_turns", F.col("present") & ~F.col("typed")).select("session_id", F.explode(types).alias("type")).groupBy("session_id", "type").agg(F.count("*").alias("n"))
    _put(found, folder, "redactions", F.col("session_id"), batch)
    _put(done.select("key", "body_hash", "outcome", "transcript_id"), folder, "outcomes", F.col("body_hash"), batch)
    # What later batches go by comes last.
    _put(done.where("key is not null and outcome in ('new', 'reinsert')").select("key", "body_hash", "transcript_id"), folder, "claims", F.col("key"), batch)


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, enabled: bool = True) -> StreamingQuery:
    """Read all new files of lines into the store, batch by batch. Batches are numbered from 1 by the checkpoint."""
    stream = spark.readStream.text(source)
    return stream.writeStream.foreachBatch(lambda rows, number: take(rows, folder, number + 1, enabled)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
