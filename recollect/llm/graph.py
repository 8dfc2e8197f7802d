"""Connected components of a table of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges (a, b): the smallest id reachable, itself included.

    Rounds of large and small stars: every id hangs its neighbours on the smallest of them, first the larger ones,
    then the smaller ones, until nothing changes. Nulls and loops are passed over; an empty table has no components."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        hung = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select(F.col("y").alias("a"), F.col("m").alias("b")))
        edges = cut(hung.where("a <> b").distinct())
        # A round that changes nothing has every id on the smallest one of its component.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
