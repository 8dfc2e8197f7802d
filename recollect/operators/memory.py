"""Packs, lifecycle, metrics, distillation, consolidation and evaluation of memories."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.batches import groups
from recollect.functions import scoring, text
from recollect.session import cut, numbered

#: Vectors in a block of near_pairs(); tiles that a repo's blocks make, blocks of a tile at most; pairs in a batch of its results.
BLOCK, TILES, TILE, ROWS_OUT = 512, 8, 128, 1 << 17

#: Headings of a pack.
HEADINGS = {"decision": "Decisions", "lesson": "Lessons", "fact": "Facts", "command": "Commands", "todo": "Todos", "note": "Notes", "event": "Events"}


def select_pack(memories: DataFrame, now_ms: int, budget: int = 1500, newest: int = 500) -> DataFrame:
    """Per repo the best of the newest valid memories, in order, as long as the token budget lasts; the first always."""
    recent = Window.partitionBy("repo").orderBy(F.desc("created_at"), "id")
    rows = memories.where("valid_to is null").withColumn("age", F.row_number().over(recent)).where(F.col("age") <= newest)
    rows = rows.withColumns({"score": scoring.pack_score(F.col("type"), F.col("importance"), F.col("created_at"), now_ms), "tokens": scoring.token_estimate(F.col("text"))})
    order = Window.partitionBy("repo").orderBy(F.desc("score"), "id")
    rows = rows.withColumns({"rank": F.row_number().over(order), "total": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("total") <= budget) | (F.col("rank") == 1)).select("repo", "id", "type", "text", "score", "tokens", "rank", "total")


def render_pack(pack: DataFrame) -> DataFrame:
    """One Markdown text per repo, types in the order in which they first come."""
    lines = pack.groupBy("repo", "type").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), text.collapsed(F.col("text"))).alias("line")))).alias("lines"))
    names = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    part = F.concat(F.lit("## "), F.coalesce(F.try_element_at(names, F.col("type")), F.col("type")), F.lit("\n"), F.array_join("lines.line", "\n"))
    parts = lines.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("first", part.alias("part")))).alias("parts"))
    return parts.select("repo", F.concat(F.lit("# Repo memory pack\n\n"), F.array_join("parts.part", "\n\n")).alias("pack"))


def decide_injection(prompts: DataFrame, pack: DataFrame, base: int = 1500, least: float = 0.15) -> DataFrame:
    """inject, reason and budget for prompts (prompt_id, repo, prompt), by the best score that the repo's pack has."""
    best = pack.groupBy("repo").agg(F.max("score").alias("best"))
    rows = prompts.join(best, "repo", "left")
    prompt = F.col("prompt")
    asks = prompt.rlike(text.ASKS)
    reason = (
        F.when(~asks & prompt.rlike(text.SMALLTALK), "smalltalk")
        .when(~asks & (F.length(text.trimmed(prompt)) < 12), "prompt-too-short")
        .when(F.col("best").isNull(), "empty-pack")
        .when(F.col("best") < least, "below-min-score")
        .otherwise("injected")
    )
    return rows.select("prompt_id", "repo", reason.alias("reason"), (reason == "injected").alias("inject"), scoring.shrink_budget(base, F.length("prompt")).alias("budget_tokens"))


def payload(name: str) -> Column:
    return F.get_json_object("payload_json", f"$.{name}")


def usefulness_scores(events: DataFrame) -> DataFrame:
    """(used + 1) / (used + corrected + 2) per atom that has either."""
    family = payload("family")
    used, corrected = F.sum((family == "recall_used").cast("long")), F.sum((family == "memory_corrected").cast("long"))
    rows = events.where("event_type = 'usefulness'").groupBy(F.col("atom_id").alias("id")).agg(F.coalesce(used, F.lit(0)).alias("used"), F.coalesce(corrected, F.lit(0)).alias("corrected"))
    return rows.withColumn("useful", (F.col("used") + 1) / (F.col("used") + F.col("corrected") + 2))


def _distinct(family: str) -> Column:
    return F.count_distinct(F.when(payload("family") == family, F.col("atom_id")))


def usefulness_rate(events: DataFrame, since_ms: int | None = None, surface: str | None = None) -> DataFrame:
    rows = events.where("event_type = 'usefulness'")
    rows = rows.where(F.col("created_at") >= since_ms) if since_ms is not None else rows
    rows = rows.where(payload("surface") == surface) if surface is not None else rows
    out = rows.agg(_distinct("recall_served").alias("served"), _distinct("recall_used").alias("used"))
    return out.withColumn("rate", F.when(F.col("served") > 0, F.col("used") / F.col("served")))


def usefulness_by_type(events: DataFrame, memories: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'usefulness'").join(memories.select(F.col("id").alias("atom_id"), "type"), "atom_id")
    out = rows.groupBy("type").agg(_distinct("recall_served").alias("served"), _distinct("recall_used").alias("used")).where("served > 0 or used > 0")
    return out.withColumn("rate", F.when(F.col("served") > 0, F.col("used") / F.col("served")))


def unsynced(events: DataFrame, memories: DataFrame, size: int = 200) -> DataFrame:
    """The next events to send: not sent yet, and of an atom of team or org scope now, or a tombstone of such a scope."""
    rows = events.where("synced_at is null").join(memories.select(F.col("id").alias("atom_id"), "scope"), "atom_id", "left")
    shared = F.col("scope").isin("team", "org") | ((F.col("event_type") == "erase_request") & payload("scope").isin("team", "org"))
    return rows.where(shared).orderBy("seq").limit(size).select("seq", "atom_id", "event_type", "scope")


def insert_new(memories: DataFrame, candidates: DataFrame, erased: DataFrame) -> DataFrame:
    """The candidates that are new by hash, the first of each; erased hashes stay away."""
    first = Window.partitionBy("hash").orderBy("ord")
    rows = candidates.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.join(erased.select("hash"), "hash", "left_anti").join(memories.select("hash"), "hash", "left_anti")


def appended(memories: DataFrame, events: DataFrame) -> DataFrame:
    """seq and atom_id of every memory as it is appended to the log: the numbers after its last one, by (created_at, id)."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long")).first()[0]
    return numbered(memories.select("created_at", "id"), ["created_at", "id"], "seq", last + 1).select("seq", F.col("id").alias("atom_id"))


def fold_state(memories: DataFrame, events: DataFrame) -> DataFrame:
    """State after an accepted log (seq, event_type, atom_id, payload_json, created_at): the first ending event sets valid_to, the highest promotion the scope, erased atoms go."""
    rank = lambda c: F.array_position(F.array(F.lit("personal"), F.lit("team"), F.lit("org")), c)
    when = lambda kinds, value: F.when(F.col("event_type").isin(kinds), value)
    log = events.groupBy(F.col("atom_id").alias("id")).agg(
        F.min(when(["invalidate", "supersede"], F.struct("seq", "created_at", payload("superseded_by").alias("by")))).alias("ended"),
        F.max(when(["promote_scope"], rank(payload("to")))).alias("promoted"),
        F.max((F.col("event_type") == "erase_request").cast("int")).alias("erased"),
    )
    rows = memories.join(log, "id", "left").where("coalesce(erased, 0) = 0")
    scope = F.get(F.array(F.lit("personal"), F.lit("team"), F.lit("org")), (F.greatest(rank(F.col("scope")), F.coalesce("promoted", F.lit(0))) - 1).cast("int"))
    return rows.select("id", "type", F.coalesce("valid_to", F.col("ended.created_at")).alias("valid_to"), F.col("ended.by").alias("superseded_by"), scope.alias("scope"))


def served(recalls: DataFrame) -> DataFrame:
    """One recall_served event for each atom of recalls (recall, query, atom_ids, scores, surface, mode); of the query only a hash is kept, scores go by index."""
    rows = recalls.select("recall", F.posexplode("atom_ids").alias("at", "atom_id"), F.substring(F.sha2("query", 256), 1, 16).alias("query_hash"), "scores", "surface", "mode")
    body = F.struct(F.lit("recall_served").alias("family"), "query_hash", F.get("scores", F.col("at")).alias("score"), "surface", "mode")
    return rows.select("recall", "atom_id", F.lit("usefulness").alias("event_type"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload_json"))


def used_or_corrected(rows: DataFrame) -> DataFrame:
    """The events of atoms that were used (family recall_used: surface, signal) or corrected (memory_corrected: action)."""
    used = F.to_json(F.struct("family", "surface", "signal"))
    return rows.select("atom_id", F.lit("usefulness").alias("event_type"), F.when(F.col("family") == "recall_used", used).otherwise(F.to_json(F.struct("family", "action"))).alias("payload_json"))


def repointed(placeholders: DataFrame, made: DataFrame) -> DataFrame:
    """transcript_id and memory_id: the first memory (transcript_id, ord, id) that a transcript led to, or its placeholder."""
    first = made.groupBy("transcript_id").agg(F.min(F.struct("ord", "id"))["id"].alias("first"))
    return placeholders.join(first, "transcript_id", "left").select("transcript_id", F.coalesce("first", "memory_id").alias("memory_id"))


def event_atoms(envelopes: DataFrame) -> DataFrame:
    """The memories of typed events (ord, events): defaults for importance and confidence, one of equal texts, normalised, with their hash."""
    rows = envelopes.select("ord", F.posexplode("events").alias("at", "e")).select(F.struct("ord", "at").alias("ord"), "e.type", "e.text", F.coalesce("e.importance", F.lit(0.7)).alias("importance"), F.coalesce("e.confidence", F.lit(0.9)).alias("confidence"))
    found = rows.withColumn("key", text.reduce_key(F.col("text"))).groupBy("key").agg(F.min(F.struct((-F.col("importance")).alias("less"), "ord", "type", "text", "importance", "confidence")).alias("best"))
    out = found.select("best.type", text.normalized(F.col("best.text")).alias("text"), "best.importance", "best.confidence")
    return out.withColumn("hash", F.sha2("text", 256))


def reembedded(requests: DataFrame, memories: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Each request with its outcome and the memory's new vector; a memory that is not there any more is no failure. However many requests name a memory, it is embedded once, and its text stays where it is."""
    asked = requests.select("id").distinct()
    made = memories.join(asked, "id", "left_semi").select("id", F.lit(True).alias("known"), embed(F.col("text")).alias("embedding"))
    rows = requests.join(made, "id", "left")
    outcome = F.when(F.col("known"), "embedded").otherwise("missing")
    return rows.select(*requests.columns, outcome.alias("outcome"), "embedding")


def sync_batches(events: DataFrame, size: int = 200) -> DataFrame:
    """batch, n, first_seq and acked_seq, where the cursor goes once the batch is acknowledged."""
    rows = numbered(events.select("seq"), ["seq"], "number", 0)
    return rows.groupBy(F.floor(F.col("number") / size).alias("batch")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("acked_seq"))


def lifecycle_outcomes(memories: DataFrame, log: DataFrame) -> DataFrame:
    """What becomes of each request (seq, atom_id, kind, new_id) to invalidate or supersede: the first good one on a valid memory is done, later ones conflict; a superseding memory must be there and valid."""
    state = memories.select(F.col("id").alias("atom_id"), F.col("valid_to").isNull().alias("valid"))
    target = memories.select(F.col("id").alias("new_id"), F.col("valid_to").isNull().alias("target_valid"))
    rows = log.join(state, "atom_id", "left").join(target, "new_id", "left")
    good = (F.col("kind") == "invalidate") | F.coalesce("target_valid", F.lit(False))
    rows = rows.select("seq", "atom_id", "valid", good.alias("good"))
    first = rows.where("valid and good").groupBy("atom_id").agg(F.min("seq").alias("first"))
    outcome = F.when(F.col("valid").isNull(), "not found").when(~F.col("valid") | (F.col("first") < F.col("seq")), "conflict").when(~F.col("good"), "invalid target").otherwise("done")
    return rows.join(first, "atom_id", "left").select("seq", outcome.alias("outcome"))


def claim_status(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """new, replay or conflict for requests (key, body_hash) by what is known of their keys."""
    known = claims.select("key", F.col("body_hash").alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("body_hash"), "replay").otherwise("conflict")
    return requests.join(known, "key", "left").select("key", status.alias("status"))


def reduce_atoms(atoms: DataFrame) -> DataFrame:
    """One atom (ord, type, text, importance) per text up to case and white space: the most important, the first of equals."""
    keyed = atoms.withColumn("key", text.reduce_key(F.col("text")))
    found = keyed.groupBy("key").agg(F.min(F.struct((-F.col("importance")).alias("less"), "ord", "type", "text", "importance")).alias("best"), F.min("ord").alias("place"))
    return found.select("key", "best.type", "best.text", "best.importance", "place")


def near_pairs(vectors: DataFrame, merge: float, propose: float, most: int | None = None) -> DataFrame:
    """Pairs of a repo's vectors by cosine: merge or propose. Vectors without a norm have none, nor do those of different lengths.

    Exact: vectors lie in blocks by their angle to one vector of the repo, and as angles obey the triangle inequality, two
    blocks further apart than the angle of `propose` hold no pair. Runs of blocks make tiles, and each pair of near tiles is a task
    of its own, so that a vector travels once for each tile of its repo, of which there are about TILES, and not for each block.
    With `most`, repos with more vectors are passed over; oversize_groups() names them."""
    if most is not None:
        vectors = vectors.join(oversize_groups(vectors, most), "repo", "left_anti")
    blocks = cut(_blocks(vectors))
    reach = math.acos(max(-1.0, min(1.0, propose))) + 1e-6
    places = _tiles(blocks, reach)
    held = blocks.select("repo", "length", "block", "low", "high", "ids", "norms", "values").join(F.broadcast(places), "block")
    order = ["tile_a", "tile_b"]
    tasks = held.repartition(*order).sortWithinPartitions(*order, "side", "block")
    limit = ROWS_OUT

    def block(row: pa.Table) -> tuple:
        low, high, norms, values, n = (row.column(c)[0].as_py() for c in ("low", "high", "norms", "values", "length"))
        norms, values = np.frombuffer(norms), np.frombuffer(values).reshape(-1, n)
        return low, high, norms, values, values / norms[:, None], row.column("ids")[0].values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, order):
            kind, same = tile.column("repo")[0], tile.column("tile_a")[0] == tile.column("tile_b")[0]
            side = tile.column("side").to_numpy()
            right = [block(tile.slice(i, 1)) for i in (range(len(side)) if same else np.flatnonzero(side == 1).tolist())]
            found, n = [], 0
            for at, i in enumerate(np.flatnonzero(side == 0).tolist()):
                low, high, p, x, one, names = right[at] if same else block(tile.slice(i, 1))
                for at_other in range(at if same else 0, len(right)):
                    low_other, high_other, q, y, other, names_other = right[at_other]
                    if low - high_other > reach or low_other - high > reach:
                        continue
                    a, b = np.nonzero(one @ other.T >= propose - 1e-9)
                    if same and at == at_other:
                        a, b = a[a < b], b[a < b]
                    if not len(a):
                        continue
                    # The sum in the order of the elements, as one by one.
                    dot = np.zeros(len(a))
                    for k in range(x.shape[1]):
                        dot += x[a, k] * y[b, k]
                    similarity = dot / (p[a] * q[b])
                    good = similarity >= propose
                    found.append((names.take(pa.array(a[good])), names_other.take(pa.array(b[good])), similarity[good]))
                    n += int(good.sum())
                    if n >= limit:
                        yield _pairs(found, kind, n)
                        found, n = [], 0
            if n:
                yield _pairs(found, kind, n)

    repo, item = vectors.schema["repo"].dataType, vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("repo", repo), T.StructField("x", item), T.StructField("y", item), T.StructField("similarity", T.DoubleType())])
    pairs = tasks.mapInArrow(run, schema).where("x != y")
    return pairs.select("repo", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", F.when(F.col("similarity") >= merge, "merge").otherwise("propose").alias("action"))


def oversize_groups(vectors: DataFrame, most: int) -> DataFrame:
    """repo and n of the repos that near_pairs() passes over with that limit."""
    return vectors.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > most)


def _tiles(blocks: DataFrame, reach: float) -> DataFrame:
    """block, tile_a, tile_b and side (0 of a, 1 of b): the pairs of near tiles that each block is needed for; of a tile with itself it is one side only.

    Tiles are runs of a repo's blocks in the order of their angles, so many that there are TILES of them, but none of more than TILE blocks. A tile is named by its first block."""
    group = Window.partitionBy("repo", "length")
    rows = cut(blocks.select("repo", "length", "block", "low", "high")).withColumn("wide", F.least(F.lit(TILE), F.ceil(F.count("*").over(group) / TILES)))
    rows = rows.withColumn("run", F.floor((F.row_number().over(group.orderBy("block")) - 1) / F.col("wide")))
    rows = cut(rows.withColumn("tile", F.min("block").over(Window.partitionBy("repo", "length", "run"))).select("repo", "length", "block", "low", "high", "tile"))
    tiles = rows.groupBy("repo", "length", "tile").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    left, right = (tiles.select("repo", "length", *[F.col(c).alias(f"{c}_{side}") for c in ("tile", "low", "high")]) for side in "ab")
    near = (F.col("tile_a") <= F.col("tile_b")) & (F.col("low_a") - F.col("high_b") <= reach) & (F.col("low_b") - F.col("high_a") <= reach)
    both = left.join(right, ["repo", "length"]).where(near).select("tile_a", "tile_b")
    sides = both.select("tile_a", "tile_b", F.lit(0).alias("side"), F.col("tile_a").alias("tile")).union(both.where("tile_a <> tile_b").select("tile_a", "tile_b", F.lit(1), "tile_b"))
    return rows.select("block", "tile").join(sides, "tile").drop("tile")


def _pairs(found: list[tuple], repo: pa.Scalar, n: int) -> pa.RecordBatch:
    x, y = (pa.concat_arrays([f[i] for f in found]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array([repo.as_py()] * n, repo.type), x, y, pa.array(np.concatenate([f[2] for f in found]))], names=["repo", "x", "y", "similarity"])


def _blocks(vectors: DataFrame) -> DataFrame:
    """repo, length, block, low and high (the least and largest angle to the repo's first vector), ids, norms and values of at most BLOCK vectors each."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    rows = vectors.where("repo is not null").select("repo", "id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("length"))
    rows = rows.withColumn("norm", F.sqrt(dot("embedding", "embedding"))).where("norm > 0")
    first = rows.groupBy("repo", "length").agg(F.min_by(F.struct("embedding", "norm"), "id").alias("first"))
    cosine = dot(F.col("embedding"), F.col("first.embedding")) / F.col("norm") / F.col("first.norm")
    rows = rows.join(first, ["repo", "length"]).select("repo", "length", "id", "embedding", "norm", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "repo", "length", "angle", "id").sortWithinPartitions("repo", "length", "angle", "id")
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for group in groups(batches, ["repo", "length"]):
            for start in range(0, group.num_rows, most):
                part = group.slice(start, most).combine_chunks()
                ids, values, angles = (part.column(c).combine_chunks() for c in ("id", "embedding", "angle"))
                ids, values = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, values))
                kind = pa.list_(ids.type)
                yield pa.RecordBatch.from_arrays(
                    [part.column("repo").combine_chunks().slice(0, 1), part.column("length").combine_chunks().slice(0, 1), pa.array([number]), pa.array([angles[0].as_py()]), pa.array([angles[len(angles) - 1].as_py()]), pa.array([ids.to_pylist()], kind), pa.array([part.column("norm").to_numpy().tobytes()], pa.binary()), pa.array([values.flatten().to_numpy().tobytes()], pa.binary())],
                    names=["repo", "length", "block", "low", "high", "ids", "norms", "values"],
                )
                number += 1

    item, repo = vectors.schema["id"].dataType, vectors.schema["repo"].dataType
    schema = T.StructType([T.StructField("repo", repo), *T._parse_datatype_string("length int, block long, low double, high double").fields, T.StructField("ids", T.ArrayType(item)), *T._parse_datatype_string("norms binary, values binary").fields])
    return rows.mapInArrow(run, schema)


def ranking_quality(ranked: DataFrame, graded: DataFrame, k: int) -> DataFrame:
    """recall and ndcg at k per query. ranked: query, item, place from 1; graded: query, item, grade."""
    hits = graded.join(ranked.where(F.col("place") <= k), ["query", "item"], "left")
    ideal = Window.partitionBy("query").orderBy(F.desc("grade"), "item")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    rows = hits.withColumns({"best": F.row_number().over(ideal), "gain": gain})
    out = rows.groupBy("query").agg(
        F.sum((F.col("grade") > 0).cast("long")).alias("relevant"),
        F.sum(((F.col("grade") > 0) & F.col("place").isNotNull()).cast("long")).alias("found"),
        F.sum(F.when(F.col("place").isNotNull(), F.col("gain") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, F.col("gain") / F.log2(F.col("best") + 1)).otherwise(0.0)).alias("idcg"),
    )
    recall = F.when(F.col("relevant") == 0, 1.0).otherwise(F.col("found") / F.col("relevant"))
    return out.select("query", recall.alias("recall"), F.when(F.col("idcg") == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))
