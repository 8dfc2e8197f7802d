"""Merge proposals, session upserts and the file view of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unproposed(pairs: DataFrame, pending: DataFrame) -> DataFrame:
    """The pairs (winner, loser) that no pending pair names, whichever way round."""
    both = [F.least("winner", "loser").alias("one"), F.greatest("winner", "loser").alias("other")]
    return pairs.select("*", *both).join(pending.select(*both), ["one", "other"], "left_anti").drop("one", "other")


def with_texts(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposals with winner_text and loser_text, null where a memory is gone."""
    text = lambda side: memories.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"))
    return proposals.join(text("winner"), "winner", "left").join(text("loser"), "loser", "left")


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of each decision (seq, proposal, action): only the first one on a known proposal counts."""
    first = decisions.groupBy("proposal").agg(F.min("seq").alias("first"))
    known = proposals.select(F.col("id").alias("proposal")).join(first, "proposal")
    outcome = F.when(F.col("first").isNull(), "missing").when(F.col("seq") == F.col("first"), F.col("action")).otherwise("conflict")
    return decisions.join(known, "proposal", "left").select("seq", "proposal", outcome.alias("outcome"))


def winners(pairs: DataFrame, memories: DataFrame, useful: DataFrame) -> DataFrame:
    """winner and loser of each pair (a, b, ...) beside its other columns: the more useful, then the more important, then the older, then by id. Pairs with a memory that is gone go."""
    rank = memories.join(useful.select("id", "useful"), "id", "left").select("id", F.struct((-F.coalesce("useful", F.lit(0.5))).alias("useful"), (-F.col("importance")).alias("importance"), "created_at", "id").alias("rank"))
    both = pairs.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(rank.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    first = F.col("rank_a") < F.col("rank_b")
    return both.select(*rest, F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"))


def lineage(merges: DataFrame, order: str) -> DataFrame:
    """winner and derived_from, its losers in the order of their first merge, each once."""
    first = merges.groupBy("winner", "loser").agg(F.min(order).alias("at"))
    return first.groupBy("winner").agg(F.sort_array(F.collect_list(F.struct("at", "loser")))["loser"].alias("derived_from"))


def superseded(memories: DataFrame, merges: DataFrame, order: str, now_ms: int) -> DataFrame:
    """The memories after the merges: the first one that a valid memory loses ends it."""
    first = merges.groupBy(F.col("loser").alias("id")).agg(F.min(F.struct(order, "winner"))["winner"].alias("by"))
    rows = memories.join(first, "id", "left")
    valid = F.col("valid_to").isNull()
    return rows.withColumns({"superseded_by": F.when(valid, F.col("by")), "valid_to": F.coalesce("valid_to", F.when(F.col("by").isNotNull(), F.lit(now_ms)))}).drop("by")


ATOM = "struct<type:string,text:string,importance:double,confidence:double>"
KINDS = ("decision", "fact", "lesson", "command", "todo", "note", "event")


def good_atom(atom: Column) -> Column:
    """Whether an atom has a known type, 5 to 500 characters, and importance and confidence, where given, from 0 to 1."""
    within = lambda c: c.isNull() | c.between(0, 1)
    return atom["type"].isin(*KINDS) & F.length(atom["text"]).between(5, 500) & within(atom["importance"]) & within(atom["confidence"])


def extracted(answers: DataFrame) -> DataFrame:
    """outcome and atoms of answers (answer, body): the outermost JSON object in each, fenced or not; bad atoms go one by one, an answer without an array of atoms is a deterministic error."""
    json = F.regexp_extract("body", r"(?s)(\{.*\})", 1)
    atoms = F.from_json(json, f"struct<atoms:array<{ATOM}>>")["atoms"]
    rows = answers.withColumn("found", atoms)
    kept = F.filter("found", lambda a: F.coalesce(good_atom(a), F.lit(False)))
    return rows.select("answer", F.when(F.col("found").isNull(), "deterministic").otherwise("parsed").alias("outcome"), kept.alias("atoms"))


def upsert_sessions(rows: DataFrame, latest: list[str]) -> DataFrame:
    """One row per session of ingests (session_id, ord, started_at, ...): the last value that is not null of each
    column in latest, and started_at as the first ingest has it."""
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c) for c in latest]
    return rows.groupBy("session_id").agg(F.min(F.struct("ord", "started_at"))["started_at"].alias("started_at"), *last)


def view(memories: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of each type's file, one "- [id] text" per valid memory, the oldest first; a text may take several lines."""
    age = F.row_number().over(Window.partitionBy("type").orderBy("created_at", "id"))
    # A memory has one line at least, so that no later memory can reach the last line wanted.
    rows = memories.where("valid_to is null").withColumn("n", age).where(F.col("n") <= last)
    body = F.concat(F.lit("- ["), "id", F.lit("] "), F.coalesce("text", F.lit("")))
    lines = rows.select("type", "n", F.posexplode(F.split(body, "\n")).alias("k", "content"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("n", "k")).alias("line")
    return lines.select("type", place, "content").where(F.col("line").between(first, last))


def replace_targets(memories: DataFrame, old: str) -> DataFrame:
    """Whether a replacement of `old` is good in each type's file: one valid memory must have it, once."""
    times = ((F.length("text") - F.length(F.replace(F.col("text"), F.lit(old), F.lit("")))) / len(old)).cast("long")
    rows = memories.where("valid_to is null").select("type", F.coalesce(times, F.lit(0)).alias("times"))
    out = rows.groupBy("type").agg(F.sum((F.col("times") > 0).cast("long")).alias("memories"), F.max("times").alias("most"))
    status = F.when(F.col("memories") == 0, "not found").when(F.col("memories") > 1, "several memories").when(F.col("most") > 1, "several times").otherwise("good")
    return out.withColumn("status", status)
