"""Consolidation of near memories: which pairs merge, who wins, and what that makes of the memories and their log.

Pairs are taken from the most similar down, and a memory is in one merge at most. That order is kept without going through it pair by pair:

1. A pair that is the best of both its sides is taken whatever the others are. Rounds of this go on as long as each leaves half of the
   pairs or less, so there are at most log2 of their number.
2. What a round hardly shrinks are chains of falling similarity. Pairs in different components do not touch, so each component of at most
   TASK pairs is gone through in order by one task, all components at a time.
3. Of larger components the best pairs, about TASK of them, are gone through by a task and all pairs that they touch go; then it starts again.
   Components stay what they were, as pairs only go, and are not looked for again.

Pairs of a memory with itself and those without a similarity are left out; of repeated ones the most similar counts. Ties go by (a, b), a being the smaller id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators import memory, proposals
from recollect.session import cut

#: Pairs that one task goes through in order.
TASK = 1 << 18
ORDER = ["less", "a", "b"]


def _components(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable, of the ends of edges (a, b): each id is hung on the smallest neighbour, and neighbours pass on what they hang on."""
    links = cut(edges.select("a", "b").distinct())
    before = None
    while True:
        near = links.union(links.select("b", "a"))
        low = near.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        upper = near.join(low, "a").where("b > a").select(F.col("b").alias("id"), F.col("low").alias("to")).distinct()
        low = upper.groupBy("id").agg(F.min("to").alias("low"))
        ends = upper.join(low, "id").select(F.col("low").alias("a"), F.explode(F.array("id", "to")).alias("b"))
        links = cut(ends.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("id"), F.col("a").alias("component")).union(links.select("a", "a").distinct())
        before = now


def _in_order(rows: DataFrame, group: str | None) -> DataFrame:
    """The pairs that are taken, each group (all pairs without one) gone through by one task."""
    schema = T.StructType([rows.schema[c] for c in ORDER])
    dealt = rows.repartition(group).sortWithinPartitions(group, *ORDER) if group else rows.withColumn("all", F.lit(0)).coalesce(1).sortWithinPartitions(*ORDER)
    key = group or "all"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, last = set(), None
        for batch in batches:
            keep = []
            for i, (g, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "a", "b")))):
                if g != last:
                    used, last = set(), g
                if x not in used and y not in used:
                    used |= {x, y}
                    keep.append(i)
            yield batch.select(ORDER).take(pa.array(keep, pa.int64()))

    return cut(dealt.select(key, *ORDER).mapInArrow(run, schema))


def _locally_best(rows: DataFrame) -> DataFrame:
    """The pairs that are the best of both their sides."""
    best = rows.select(F.explode(F.array("a", "b")).alias("side"), F.struct(*ORDER).alias("edge")).groupBy("side").agg(F.min("edge").alias("edge"))
    return cut(best.groupBy("edge").agg(F.count("*").alias("n")).where("n = 2").select("edge.*"))


def _untouched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    used = chosen.select(F.explode(F.array("a", "b")).alias("side"))
    return cut(rows.join(used, F.col("a") == F.col("side"), "left_anti").join(used, F.col("b") == F.col("side"), "left_anti"))


def greedy(pairs: DataFrame, most: int = TASK) -> DataFrame:
    """a, b and similarity of the pairs that merge; `most` is what one task goes through."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rows = pairs.where("a <> b and similarity is not null and not isnan(similarity)").groupBy(*ends).agg((-F.max("similarity")).alias("less"))
    left, done = cut(rows), []
    n, labelled = left.count(), False
    while n:
        chosen = _locally_best(left)
        done.append(chosen)
        left = _untouched(left, chosen)
        n, before = left.count(), n
        if n * 2 <= before:
            continue
        if n <= most:
            done.append(_in_order(left, None))
            break
        if not labelled:
            left, labelled = cut(left.join(_components(left).withColumnRenamed("id", "a"), "a")), True
        # One row for each component, not for each memory.
        large = cut(left.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most)).select("component")
        # Cut, as Spark drops the dealing below where the join has dealt by the same column, and then may turn that join into one that does not deal.
        done.append(_in_order(cut(left.join(large, "component", "left_anti")), "component"))
        left = left.join(large, "component", "left_semi")
        ranges = cut(left.repartitionByRange(n // most + 1, *ORDER).withColumn("part", F.spark_partition_id()))
        first = ranges.agg(F.min("part")).first()[0]
        if first is None:
            break
        chosen = _in_order(ranges.where(F.col("part") == first), None)
        done.append(chosen)
        left = _untouched(ranges.where(F.col("part") != first).drop("part"), chosen)
        n = left.count()
    taken = reduce(DataFrame.union, [d.select("a", "b", (-F.col("less")).alias("similarity")) for d in done]) if done else left.select("a", "b", F.col("less").alias("similarity"))
    return taken


def _near(vectors: DataFrame, valid: DataFrame, merge: float, least: float) -> DataFrame:
    """a, b and similarity, to nine places, of the pairs from `least` up of vectors whose memories are valid."""
    pairs = memory.near_pairs(vectors.join(valid.select("id"), "id", "left_semi"), merge - 1e-9, least - 1e-9).withColumn("similarity", F.round("similarity", 9))
    return cut(pairs.where(F.col("similarity") >= least).select("a", "b", "similarity"))


def merged(vectors: DataFrame, memories: DataFrame, useful: DataFrame, merge: float = 0.95) -> DataFrame:
    """winner, loser and similarity of what decisions() merges, without the pairs below `merge`, which only proposals need."""
    valid = memories.where("valid_to is null")
    return cut(proposals.winners(greedy(_near(vectors, valid, merge, merge)), valid, useful))


def decisions(vectors: DataFrame, memories: DataFrame, useful: DataFrame, pending: DataFrame, merge: float = 0.95, propose: float = 0.85) -> DataFrame:
    """action, winner, loser and similarity (to nine places, by which pairs are ordered) of a run over the vectors (repo, id, embedding) of valid memories; repo names the group in which they are compared.

    Pairs from `merge` up merge; those from `propose` up are proposed where both memories outlast the merges and no pending pair (winner, loser) names them. Vectors of memories that are not there or not valid are passed over."""
    valid = memories.where("valid_to is null")
    pairs = _near(vectors, valid, merge, propose)
    near = F.col("similarity") >= merge
    taken = cut(proposals.winners(greedy(pairs.where(near)), valid, useful))
    lost = taken.select(F.col("loser").alias("gone"))
    weaker = pairs.where(~near).join(lost, F.col("a") == F.col("gone"), "left_anti").join(lost, F.col("b") == F.col("gone"), "left_anti")
    proposed = proposals.unproposed(proposals.winners(weaker, valid, useful), pending)
    rows = lambda kind, found: found.select(F.lit(kind).alias("action"), "winner", "loser", "similarity")
    return rows("merge", taken).union(rows("propose", proposed))


def after(memories: DataFrame, merged: DataFrame, now_ms: int) -> DataFrame:
    """id, valid_to, superseded_by and derived_from (null without a merge) of all memories after the merges (winner, loser), a memory losing once at most."""
    rows = proposals.superseded(memories, merged.withColumn("at", F.lit(0)), "at", now_ms)
    made = proposals.lineage(merged.withColumn("at", F.lit(0)), "at").withColumnRenamed("winner", "id")
    return rows.join(made, "id", "left").select("id", "valid_to", "superseded_by", "derived_from")


def events(merged: DataFrame, now_ms: int) -> DataFrame:
    """The two entries of the log that each merge (winner, loser) makes of its loser: that it is superseded, and that it was corrected."""
    ended = F.struct(F.lit("supersede").alias("event_type"), F.to_json(F.struct(F.col("winner").alias("superseded_by"))).alias("payload_json"))
    signal = F.struct(F.lit("usefulness").alias("event_type"), F.lit('{"family":"memory_corrected","action":"superseded"}').alias("payload_json"))
    return merged.select(F.col("loser").alias("atom_id"), F.explode(F.array(ended, signal)).alias("e"), F.lit(now_ms).alias("created_at")).select("atom_id", "e.*", "created_at")
