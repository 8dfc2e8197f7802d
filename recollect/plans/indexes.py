"""Registered queries over kept indexes: postings with places, and balls of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import index, neighbours
from recollect.plans.catalog import query, r6
from recollect.plans.registry import BM25, HYBRID, TERMS, WORDS, hybrid_of
from recollect.session import shared_folder
from recollect.sources import tables as t


def _segments(s, d, parts=2):
    m = t.memories(s, d)
    n = F.col("id").cast("long")
    return index.built(m, shared_folder(s, "index"), [n % parts == i for i in range(parts)])


@query(f", {BM25} SELECT id, round(bm25, 6) AS bm25 FROM bm")
def kept_bm25(s, d):
    return index.ask(_segments(s, d), WORDS).select("id", r6("bm25"))


@query(f", {BM25.replace('FROM mem)', 'FROM mem WHERE id::BIGINT % 9 > 0)', 1)} SELECT id, round(bm25, 6) AS bm25 FROM bm")
def kept_bm25_after_changes(s, d):
    """Three segments; some memories sent again, some removed, and two segments merged."""
    m, n = t.memories(s, d), F.col("id").cast("long")
    v = _segments(s, d, 3)
    index.replace(m.where(n % 5 == 0), v.folder)
    index.forget(m.where(n % 9 == 0).select("id"), v.folder)
    return index.ask(index.merge(s, v.folder, v.live[:2]), WORDS).select("id", r6("bm25"))


PHRASES = rf"""own AS (SELECT id, {TERMS} AS w FROM mem), sized AS (SELECT id, 2 * len(w) AS size FROM own), c AS (SELECT count(*) AS n, avg(size) AS mean FROM sized),
places AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM own),
it AS (SELECT item_id AS query, {TERMS} AS w FROM benchmark),
hit AS (SELECT query, 0 AS p, a.id, count(*) AS times FROM it JOIN places a ON a.term = it.w[4] JOIN places b ON b.id = a.id AND b.i = a.i + 1 AND b.term = it.w[5] GROUP BY query, a.id
  UNION ALL SELECT query, 1, a.id, count(*) FROM it JOIN places a ON a.term = it.w[2] GROUP BY query, a.id),
wt AS (SELECT query, p, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(mean) AS mean FROM hit, c GROUP BY query, p),
sc AS (SELECT hit.query, hit.id, -sum(idf * 2 * times * 2.2 / (2 * times + 1.2 * (0.25 + 0.75 * size / mean))) AS bm25 FROM hit JOIN wt ON wt.query = hit.query AND wt.p = hit.p JOIN sized ON sized.id = hit.id GROUP BY hit.query, hit.id HAVING count(*) = 2)"""


@query(f", {PHRASES} SELECT query, id, round(bm25, 6) AS bm25 FROM sc")
def kept_phrases(s, d):
    """A phrase of two words and a word of every benchmark item, asked at once of an index of two segments."""
    own = text.terms(F.col("text"))
    queries = t.read(s, d, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.get(own, F.lit(3)), F.lit("-"), F.get(own, F.lit(4)), F.lit(" "), F.get(own, F.lit(1))).alias("body"))
    return index.scores(_segments(s, d), queries).select("query", "id", r6("bm25"))


@query(HYBRID)
def kept_search(s, d):
    """Hybrid search whose keyword leg reads the index only."""
    return hybrid_of(s, d, index.ask(_segments(s, d), WORDS)).select("id", "type", r6("score"), "source", r6("keyword_part"), r6("vector_part"))


@query(
    """ SELECT query, id, round(distance, 6) AS distance, place::INT AS place FROM (SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM
  (SELECT q.vec_id AS query, x.vec_id AS id, list_distance(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings x WHERE q.vec_id % 20 = 0)) WHERE place <= 10"""
)
def nearest_to_each(s, d):
    """The ten nearest vectors of every vector whose id is divisible by 20, against all."""
    v = t.vectors(s, d)
    points = v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("point"))
    return neighbours.nearest(neighbours.built(v), points, 10).select("query", "id", r6("distance"), F.col("place").cast("int").alias("place"))
