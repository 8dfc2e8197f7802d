"""Hybrid retrieval: keyword scores, nearest vectors, fusion, filters and score explanations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.functions import scoring, text
from recollect.session import written

#: Terms that postings() counts at once.
TERMS = 1 << 19


def keyword_scores(memories: DataFrame, query: str) -> DataFrame:
    """(id, bm25) of memories with every white-space part of the query as a phrase; lower is better.

    A text counts twice, once as it is and once normalised, so frequencies and lengths double."""
    spark = memories.sparkSession
    phrases = spark.createDataFrame([(i, p) for i, p in enumerate(query.split())], "phrase int, body string").select("phrase", text.terms(F.col("body")).alias("own"))
    wanted = [(r["phrase"], r["own"]) for r in phrases.collect() if r["own"]]
    if not wanted:
        return memories.select("id", F.lit(0.0).alias("bm25")).where("false")
    folded = memories.select("id", text.folded(F.col("text")).alias("body"))
    # Counted in the text, without an array of its terms, and written, as both the corpus and the scores need it.
    found = written(folded.select("id", (2 * F.regexp_count("body", F.lit(f"{text.TERM}+"))).alias("size"), *[(2 * F.regexp_count("body", F.lit(_phrase(words)))).alias(f"f{i}") for i, words in wanted]))
    names = [f"f{i}" for i, _ in wanted]
    corpus = found.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"d{c}") for c in names])
    both = found.where(" and ".join(f"{c} > 0" for c in names)).crossJoin(F.broadcast(corpus))
    score = F.lit(0.0)
    for c in names:
        idf = F.log((F.col("n") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5))
        score = score - F.when(idf > 0, idf).otherwise(1e-6) * F.col(c) * 2.2 / (F.col(c) + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    return both.select("id", score.alias("bm25"))


def _phrase(words: list[str]) -> str:
    """A pattern that matches wherever the words start to stand one after the other."""
    first, rest = words[0], "".join(f"{text.BETWEEN}+{w}(?!{text.TERM})" for w in words[1:])
    return f"(?<!{text.TERM}){first}(?!{text.TERM})" + (f"(?={rest})" if rest else "")


def _counted(memories: DataFrame, sizes: bool) -> DataFrame:
    """term, id, tf and size, counted text by text within a task, as an id names one text; with sizes also a row with a null term for each text."""
    own = memories.select("id", text.terms(F.col("text")).alias("own"))
    kind = T.StructType([T.StructField("term", T.StringType()), own.schema["id"], T.StructField("tf", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("own"))
            ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TERMS, "right")))
                part, n = batch.slice(at, to - at), lengths.slice(at, to - at)
                at = to
                terms = part.column("own").flatten().dictionary_encode()
                doc = np.repeat(np.arange(len(n), dtype=np.int64), pc.fill_null(n, 0).to_numpy())
                pair, times = np.unique(doc * max(1, len(terms.dictionary)) + terms.indices.to_numpy(), return_counts=True)
                docs, codes = np.divmod(pair, max(1, len(terms.dictionary)))
                size = pc.multiply(n.cast(pa.int64()), 2)
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(codes)), ids.take(pa.array(docs)), pa.array(2 * times), size.take(pa.array(docs))], names=["term", "id", "tf", "size"])
                if sizes:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), ids, pa.nulls(len(n), pa.int64()), size], names=["term", "id", "tf", "size"])

    return own.mapInArrow(run, kind)


def postings(memories: DataFrame) -> DataFrame:
    """term, id, tf and size: the inverted index. Written once, it answers queries without the texts. An id names one text."""
    return _counted(memories, False)


def postings_and_sizes(memories: DataFrame) -> DataFrame:
    """The same with a row with a null term for each text, so that one pass over the texts gives index_corpus() too."""
    return _counted(memories, True)


def index_corpus(index: DataFrame) -> DataFrame:
    """corpus() by what postings_and_sizes() gave."""
    return index.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def corpus(memories: DataFrame) -> DataFrame:
    """n and mean: the number of texts and their mean length in terms."""
    return memories.agg(F.count("*").alias("n"), F.avg(2 * F.regexp_count(text.folded(F.col("text")), F.lit(f"{text.TERM}+"))).alias("mean"))


def indexed_scores(index: DataFrame, corpus: DataFrame, query: str) -> DataFrame:
    """The same as keyword_scores() by an index without places, for queries of different single words; `index.scores` answers all queries."""
    spark = index.sparkSession
    parts = spark.createDataFrame([(p,) for p in query.split()], "body string").select(text.terms(F.col("body")).alias("own")).where(F.size("own") > 0).collect()
    if any(len(r["own"]) > 1 for r in parts) or len({r["own"][0] for r in parts}) < len(parts):
        raise ValueError("phrases and repeated words need an index with places")
    words = spark.createDataFrame([(query,)], "body string").select(F.array_distinct(text.terms(F.col("body"))).alias("own")).first()["own"]
    hits = index.where(F.col("term").isin(words))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus)).select("term", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    rows = hits.join(F.broadcast(weighed), "term")
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    return rows.groupBy("id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("terms")).where(F.col("terms") == len(words)).select("id", "bm25")


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(id, distance, score) of the k nearest vectors by Euclidean distance; score is 1 / (1 + distance)."""
    point = F.array(*[F.lit(float(x)) for x in query])
    square = F.aggregate(F.zip_with("embedding", point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", F.sqrt(square).alias("distance")).orderBy("distance", "id").limit(k).withColumn("score", 1 / (1 + F.col("distance")))


def hybrid(memories: DataFrame, keyword: DataFrame, vector: DataFrame, useful: DataFrame, now_ms: int, limit: int, candidates: int | None = None, weights: scoring.Weights = scoring.Weights(), types: Sequence[str] = (), repo: str | None = None, projects: Sequence[str] = (), since_ms: int | None = None, mode: str = "hybrid") -> DataFrame:
    """Fused scores of the candidates of both legs, filtered after fusion, with each signal's share.

    keyword: id, bm25; vector: id, score; useful: id, useful. Candidates are at most twice `candidates` rows."""
    width = candidates or max(4 * limit, 50)
    left = keyword.orderBy("bm25", "id").limit(width).select("id", (-F.col("bm25")).alias("k"))
    right = vector.orderBy(F.desc("score"), "id").limit(width).select("id", F.col("score").alias("v"))
    left, right = left.where("false") if mode == "semantic" else left, right.where("false") if mode == "keyword" else right
    rows = fused(left, right, memories, useful, now_ms, weights)
    kept = rows.where(F.col("valid_to").isNull() & F.col("text").isNotNull())
    kept = kept.where(F.col("type").isin(list(types))) if types else kept
    kept = kept.where(F.col("repo") == repo) if repo is not None else kept
    kept = kept.where(F.col("project").isin(list(projects))) if projects else kept
    kept = kept.where(F.col("created_at") >= since_ms) if since_ms is not None else kept
    return kept.orderBy(F.desc("score"), "id").limit(limit)


def fused(left: DataFrame, right: DataFrame, memories: DataFrame, useful: DataFrame, now_ms: int, weights: scoring.Weights = scoring.Weights(), by: Sequence[str] = ()) -> DataFrame:
    """Candidates of both legs (k and v, higher is better) with their memories, fused score, source and the signals' shares; scores are scaled within the columns of by."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    both = left.join(right, [*by, "id"], "full_outer")
    both = both.withColumns({"nk": scoring.minmax(F.col("k"), whole), "nv": scoring.minmax(F.col("v"), whole)})
    rows = both.join(memories, "id", "left").join(useful, "id", "left")
    fresh = scoring.freshness(F.coalesce("created_at", F.lit(now_ms)), now_ms)
    parts = {"keyword": F.col("nk"), "vector": F.col("nv"), "importance": F.coalesce("importance", F.lit(0.5)), "freshness": fresh, "usefulness": F.coalesce("useful", F.lit(0.5))}
    source = F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), "both").when(F.col("k").isNotNull(), "fts").otherwise("vec")
    return rows.withColumns({"score": scoring.fuse(*parts.values(), weights), "source": source, **{f"{n}_part": c * getattr(weights, n) for n, c in parts.items()}})


def keyword_scores_of_all(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, bm25): keyword_scores() of every row of queries (query, body) in one join by terms, phrases by the terms' places.

    Queries without terms give no rows."""
    parts = queries.select("query", F.posexplode(F.split(F.trim("body"), r"\s+")).alias("phrase", "part")).withColumn("own", text.terms(F.col("part"))).where(F.size("own") > 0)
    phrases = parts.select("query", "phrase", F.size("own").alias("words"))
    asked = parts.select("query", "phrase", F.posexplode("own").alias("place", "term"))
    own = memories.select("id", text.terms(F.col("text")).alias("own"))
    terms = own.select("id", (2 * F.size("own")).alias("size"), F.posexplode("own").alias("at", "term"))
    hits = terms.join(asked, "term").groupBy("query", "phrase", "id", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.first("size").alias("size"))
    found = hits.join(phrases, ["query", "phrase"]).where("n = words").groupBy("query", "phrase", "id").agg((2 * F.count("*")).alias("f"), F.first("size").alias("size"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = found.groupBy("query", "phrase").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus(memories))).select("query", "phrase", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    part = F.col("idf") * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    scores = found.join(weighed, ["query", "phrase"]).groupBy("query", "id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("n"))
    wanted = phrases.groupBy("query").agg(F.count("*").alias("wanted"))
    return scores.join(wanted, "query").where("n = wanted").select("query", "id", "bm25")

