"""Retrieval quality over a golden set of memories and graded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import scoring
from recollect.operators import memory, neighbours, search


def rankings(corpus: DataFrame, queries: DataFrame, now_ms: int, k: int = 10, weights: scoring.Weights = scoring.Weights()) -> DataFrame:
    """(query, item, place): hybrid search for all queries at once; places count from 1, up to k.

    corpus: id, text, type, importance, created_at, valid_to, embedding. queries: query, body, point and types
    (null or empty: any), which are filtered after the fusion, as are memories that are no longer valid."""
    width = max(4 * k, 50)
    best = F.row_number().over(Window.partitionBy("query").orderBy("bm25", "id"))
    left = search.keyword_scores_of_all(corpus, queries).withColumn("n", best).where(F.col("n") <= width).select("query", "id", (-F.col("bm25")).alias("k"))
    right = neighbours.nearest(neighbours.built(corpus), queries, width).select("query", "id", F.col("score").alias("v"))
    useful = corpus.select("id", F.lit(0.5).alias("useful")).where("false")
    rows = search.fused(left, right, corpus.drop("embedding"), useful, now_ms, weights, ["query"]).join(queries.select("query", "types"), "query")
    allowed = F.coalesce(F.size("types") <= 0, F.lit(True)) | F.array_contains("types", F.col("type"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    kept = rows.where(F.col("valid_to").isNull() & F.col("text").isNotNull() & F.coalesce(allowed, F.lit(True)))
    return kept.withColumn("place", place).where(F.col("place") <= k).select("query", F.col("id").alias("item"), "place")


def evaluated(corpus: DataFrame, queries: DataFrame, now_ms: int, k: int = 10, weights: scoring.Weights = scoring.Weights()) -> DataFrame:
    """query, skipped, recall and ndcg at k of every query; those with an as_of are skipped and have neither.

    queries: as for rankings(), with as_of and graded, an array of (atom_id, grade)."""
    asked = queries.where("as_of is null")
    graded = asked.select("query", F.explode("graded").alias("g")).select("query", F.col("g.atom_id").alias("item"), F.col("g.grade").alias("grade"))
    quality = memory.ranking_quality(rankings(corpus, asked, now_ms, k, weights), graded, k)
    skipped = F.col("as_of").isNotNull()
    rows = queries.select("query", skipped.alias("skipped")).join(quality, "query", "left")
    whole = lambda name: F.when(~F.col("skipped"), F.coalesce(name, F.lit(1.0))).alias(name)
    return rows.select("query", "skipped", whole("recall"), whole("ndcg"))


def means(quality: DataFrame) -> DataFrame:
    """evaluated, skipped and the means of recall and ndcg, 0 without evaluated queries."""
    mean = lambda name: F.coalesce(F.avg(name), F.lit(0.0)).alias(name)
    return quality.agg(F.count_if(~F.col("skipped")).alias("evaluated"), F.count_if("skipped").alias("skipped"), mean("recall"), mean("ndcg"))
