"""Centroid clustering of vectors, filtered by ball trees.

Each task builds metric trees over the vectors of its own partition; a tree is a row that keeps its vectors and,
for each ball, its radius, count and integer sum. In a round a centroid that the triangle inequality shows to be
farther from every vector of a ball than another one is left out for that ball; a ball with one centroid left is
added to it whole, by its count and sum, and what is left of the others is compared exactly in the leaves. So the
result is that of comparing every vector with every centroid; only counts and sums of clusters travel.

Components become floor(scale * x). Vectors that are null, have another number of components or a null, NaN or infinite one
are left out. A null vec_id counts as an empty one in the seeds' hash and stays null in the result. Repeated rows
count as often as they stand; ties between centroids go to the smaller number, between seeds to the smaller vector.
With fewer vectors than centroids each vector seeds one; an empty table gives no rows. Other columns are passed over.
Components beyond LARGEST in size raise an error, as their squared distances may not fit 64 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.session import written

#: Vectors of a tree, which is one row, and of a leaf.
TREE, LEAF = 8192, 32
#: Largest size of an integer component: four of its squares times 64 components stay below 2^63.
LARGEST = 1 << 26
#: Up to this size sums of products are exact in doubles.
EXACT = 1 << 22
#: What distances in doubles may be off by, as a share and at least.
SLACK = (1e-9, 1e-5)

TREES = "ids array<long>, vectors binary, starts array<int>, ends array<int>, lefts array<int>, radii array<double>, sums binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    plain = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where((F.size("embedding") == size) & plain)


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    found = np.floor(flat * scale)
    if found.size and np.abs(found).max() > LARGEST:
        raise ArithmeticError(f"components beyond {LARGEST} / {scale}: squared distances may not fit 64 bits")
    return found.astype(np.int64)


def build(v: np.ndarray) -> tuple[np.ndarray, list, list, list, list, np.ndarray]:
    """The order of the vectors, and the balls by generation: start, end, place of the left half's ball (the right one's is next; 0: a leaf), radius, sum."""
    order, starts, ends, lefts, radii, sums = np.arange(len(v)), [0], [len(v)], [], [], []
    for i in range(2 * len(v)):
        if i == len(starts):
            break
        s, e = starts[i], ends[i]
        own = v[order[s:e]]
        total = own.sum(0)
        away = np.square(own - total / (e - s)).sum(1)
        radius = float(np.sqrt(away.max()))
        left = 0
        if e - s > LEAF and radius > 0:
            a = own[away.argmax()]
            b = own[np.square((own - a).astype(np.float64)).sum(1).argmax()]
            halves = np.argpartition((own * (b - a).astype(np.float64)).sum(1), (e - s) // 2)
            order[s:e] = order[s:e][halves]
            left, middle = len(starts), s + (e - s) // 2
            starts += [s, middle]
            ends += [middle, e]
        lefts.append(left)
        radii.append(radius)
        sums.append(total)
    return order, starts, ends, lefts, radii, np.array(sums)


def grown(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """One row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def rows(every: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, held, n
            if n < TREE and not (every and n):
                return
            names, v, at = pa.concat_arrays(ids), np.concatenate(held), 0
            while n - at >= TREE or (every and at < n):
                own = v[at : at + TREE]
                order, starts, ends, lefts, radii, sums = build(own)
                row = [names.slice(at, TREE).take(pa.array(order)).to_pylist(), own[order].astype(np.int32).tobytes(), starts, ends, lefts, radii, sums.astype(np.int64).tobytes()]
                kinds = [pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["ids", "vectors", "starts", "ends", "lefts", "radii", "sums"])
                at += TREE
            ids, held, n = [names.slice(at)], [v[at:]], max(n - at, 0)

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).cast(pa.int64()))
                held.append(integers(batch.column(1), size, scale))
                n += batch.num_rows
                yield from rows(False)
        yield from rows(True)

    return vectors.mapInArrow(run, TREES)


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            of = {name: batch.column(name)[i] for name in batch.schema.names}
            arrays = [of[name].values.to_numpy(zero_copy_only=False) for name in ("starts", "ends", "lefts", "radii")]
            yield of["ids"].values, np.frombuffer(of["vectors"].as_py(), np.int32).reshape(-1, size).astype(np.int64), *arrays, np.frombuffer(of["sums"].as_py(), np.int64).reshape(-1, size)


def assign(v: np.ndarray, starts: np.ndarray, ends: np.ndarray, lefts: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The nearest centroid of each vector, and (ball, centroid) of the balls that went to one whole."""
    near = np.empty(len(v), np.int32)
    whole = []
    away = np.sqrt(np.square((sums / (ends - starts)[:, None])[:, None, :] - centroids[None]).sum(2))
    small = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    exact = (v.astype(np.float64), centroids.astype(np.float64)) if small else (v, centroids)
    squares = (exact[1] * exact[1]).sum(1)
    left = [(0, np.arange(len(centroids)))]
    while left:
        ball, among = left.pop()
        d = away[ball, among]
        bound = (d.min() + 2 * radii[ball]) * (1 + SLACK[0]) + SLACK[1]
        among = among[d <= bound]
        s, e = starts[ball], ends[ball]
        if len(among) == 1:
            near[s:e] = among[0]
            whole.append((ball, int(among[0])))
        elif lefts[ball]:
            left += [(lefts[ball], among), (lefts[ball] + 1, among)]
        else:
            # The vector's own square is the same for all centroids.
            near[s:e] = among[(squares[among] - 2 * (exact[0][s:e] @ exact[1][among].T)).argmin(1)]
    return near, whole


def cluster(vectors: DataFrame, k: int, rounds: int, size: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part.

    The seeds are the k vectors with the smallest SHA-256 of salt and vec_id; each round moves every centroid that has vectors
    to the floor of their mean. Centroids, at most k, and their sums are all that the driver sees."""
    spark, rows = vectors.sparkSession, kept(vectors, size)
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    wide = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    seeds = rows.select(hashed.alias("h"), wide.alias("v")).orderBy("h", "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([[int(x) for x in r["v"]] for r in seeds], np.int64)
    trees = written(grown(rows, size, scale))
    for _ in range(rounds):
        for r in _sums(trees, centroids).collect():
            centroids[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    found = written(_nearest(trees, centroids))
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    last = spark.createDataFrame([(c, inertia[c], whole, digests[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return found.join(F.broadcast(last), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) over all trees: whole balls by their stored sums, the rest by their vectors."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, any_tree = np.zeros(k, np.int64), np.zeros((k, size), np.int64), False
        for _, v, starts, ends, lefts, radii, sums in _trees(batches, size):
            any_tree = True
            near, whole = assign(v, starts, ends, lefts, radii, sums, centroids)
            rest = np.ones(len(v), bool)
            for ball, c in whole:
                n[c] += ends[ball] - starts[ball]
                total[c] += sums[ball]
                rest[starts[ball] : ends[ball]] = False
            at = np.flatnonzero(rest)
            if len(at):
                at = at[np.argsort(near[at], kind="stable")]
                firsts = np.flatnonzero(np.diff(near[at], prepend=-1))
                n[near[at[firsts]]] += np.diff(np.append(firsts, len(at)))
                total[near[at[firsts]]] += np.add.reduceat(v[at], firsts)
        if any_tree:
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]).alias("sums"))


def _nearest(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, starts, ends, lefts, radii, sums in _trees(batches, size):
            near, _ = assign(v, starts, ends, lefts, radii, sums, centroids)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(near), pa.array(np.square(v - centroids[near]).sum(1))], names=["vec_id", "cluster", "distance"])

    fields = [T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType(), False), T.StructField("distance", T.LongType(), False)]
    return trees.mapInArrow(run, T.StructType(fields))
