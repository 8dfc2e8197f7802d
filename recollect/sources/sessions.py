"""Session files of coding assistants: JSON lines, in a newer form with wrapped items and an older one without.

Lines that are no JSON objects, tool calls and injected context blocks are passed over. A session counts if it has two
turns or more, one of the assistant among them. Files that have not changed in size since they were last read
are passed over. A folder without such files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = "array<struct<type: string, text: string>>"
LINE = f"type string, role string, content {CONTENT}, payload struct<id: string, cwd: string, type: string, role: string, content: {CONTENT}>"
#: Blocks that the tools put before a prompt.
INJECTED = r"^\s*<(?:user_instructions|environment_context)>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, size, at (place in the file) and line of every line of the .jsonl files below the path."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at.alias("at"), F.col("value").alias("line"))


def turns(rows: DataFrame) -> DataFrame:
    """file, size, session_id, cwd and turns, the array of (role, text), of the sessions that count."""
    said = F.from_json("line", LINE)
    wrapped = F.col("said.type") == "response_item"
    of = lambda name: F.when(wrapped, F.col(f"said.payload.{name}")).otherwise(F.col(f"said.{name}"))
    text = F.array_join(F.transform(of("content"), lambda x: x["text"]), "\n")
    rows = rows.withColumn("said", said).select("file", "size", "at", "said", of("type").alias("kind"), of("role").alias("role"), text.alias("text"))
    turn = (F.col("kind") == "message") & F.col("role").isin("user", "assistant") & (F.trim("text") != "") & ~F.col("text").rlike(INJECTED)
    meta = lambda name: F.min(F.when(F.col("said.type") == "session_meta", F.struct("at", F.col(f"said.payload.{name}").alias("value"))))["value"]
    found = rows.groupBy("file", "size").agg(meta("id").alias("id"), meta("cwd").alias("cwd"), F.array_sort(F.collect_list(F.when(turn, F.struct("at", "role", "text")))).alias("own"))
    name = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    found = found.select("file", "size", F.coalesce("id", name).alias("session_id"), "cwd", F.transform("own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return found.where((F.size("turns") >= 2) & F.exists("turns", lambda x: x["role"] == "assistant"))


def unread(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """The sessions of files that state (file, size) does not know in their present size."""
    return sessions.join(state.select("file", "size"), ["file", "size"], "left_anti")


def envelope(sessions: DataFrame, tool: str) -> DataFrame:
    """Capture rows of sessions, with a key that is equal for equal content."""
    body: Column = F.sha2(F.to_json(F.struct("session_id", "turns")), 256)
    project = F.coalesce(F.regexp_extract("cwd", r"([^/\\]+)[/\\]*$", 1), F.lit("unknown"))
    return sessions.select(F.concat(F.lit(f"{tool}-"), "session_id").alias("session_id"), F.lit(tool).alias("tool"), project.alias("project_id"), "turns", body.alias("idempotency_key"))
