"""Exact nearest neighbours of many points without comparing all: vectors in balls and shells, left out by the triangle inequality.

Every vector belongs to its nearest pivot; pivots are a bounded sample, the vectors with the smallest hashes of their ids. A ball's
vectors are sorted by their distance to the pivot and kept in rows of up to SHELL, the shells, with the least and greatest of these
distances. For a point p at distance d of the pivot no vector of a shell is nearer than d - greatest or least - d.

1. The balls nearest to p that hold k vectors bound its k-th distance by their radii; their shells are compared first.
2. The k-th distance found is the bound for all other balls, then for their shells; what is left is compared exactly.

Balls that follow each other lie in one column, as do the shells of a part of a large one; a point travels once to each column that it
needs, with the numbers of its balls, and meets all their shells there. Products of blocks choose, exact distances decide. Vectors of
another size than the pivots', or null ones, are left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.batches import groups
from recollect.session import written

#: Pivots, vectors of a shell, and vectors of a column.
PIVOTS, SHELL, COLUMN = 256, 1024, 1 << 17
#: What distances in doubles may be off by, as a share.
SLACK = 1e-9


@dataclass(frozen=True)
class Balls:
    """Shells (part, ball, least, greatest, n, ids, vectors); of each ball its pivot, radius, size and columns."""

    shells: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    columns: dict[int, list[int]]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to each of b."""
    return np.stack([np.sqrt(np.square(b - x).sum(1)) for x in a]) if len(a) else np.zeros((0, len(b)))


def built(vectors: DataFrame) -> Balls:
    """The balls of vectors (id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("embedding").collect()
    size = max((len(r["embedding"]) for r in sample), default=0)
    whole = [r["embedding"] for r in sample if len(r["embedding"]) == size]
    pivots = np.array(whole, np.float64).reshape(len(whole), size)
    kind = rows.schema["id"].dataType

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_matrix(batch.column("embedding"), size), pivots)
            ball = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(away[np.arange(len(ball)), ball])], names=["id", "embedding", "ball", "away"])

    placed = rows.where(F.size("embedding") == size).mapInArrow(near, T.StructType([T.StructField("id", kind), rows.schema["embedding"], T.StructField("ball", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    order = ["ball", "away", "id"]

    def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["ball"]):
            for at in range(0, table.num_rows, SHELL):
                part = table.slice(at, SHELL).combine_chunks()
                away, ball = part.column("away").to_numpy(), part.column("ball")[0].as_py()
                vectors_of = _matrix(part.column("embedding").combine_chunks(), size).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_pydict({"ball": pa.array([ball], pa.int32()), "least": [away.min()], "greatest": [away.max()], "n": [part.num_rows], "ids": [part.column("id").to_pylist()], "vectors": [vectors_of]})

    fields = [("ball", T.IntegerType()), ("least", T.DoubleType()), ("greatest", T.DoubleType()), ("n", T.LongType()), ("ids", T.ArrayType(kind)), ("vectors", T.BinaryType())]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // COLUMN + 1)
    made = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(shells, T.StructType([T.StructField(n, k) for n, k in fields]))
    made = written(made.withColumn("part", F.spark_partition_id()))
    radii, sizes, columns = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), {}
    # A row for each ball and each part at most.
    for r in sorted(made.groupBy("ball", "part").agg(F.max("greatest").alias("radius"), F.sum("n").alias("n")).collect()):
        radii[r["ball"]] = max(radii[r["ball"]], r["radius"])
        sizes[r["ball"]] += r["n"]
        columns.setdefault(r["ball"], []).append(r["part"])
    return Balls(made, pivots, radii, sizes, columns)


def _asked(balls: Balls, points: DataFrame, k: int) -> DataFrame:
    """(query, point, first, bound, part, balls, away): for each column the balls that may hold one of the k nearest; first are those that hold k by themselves."""
    pivots, radii, sizes = balls.pivots, balls.radii, balls.sizes
    columns = [balls.columns.get(b, []) for b in range(len(pivots))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_matrix(batch.column("point"), pivots.shape[1]), pivots)
            reach = (away + radii) * (1 + SLACK)
            order = np.argsort(away, 1, kind="stable")
            held = np.cumsum(sizes[order], 1)
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, np.concatenate((np.ones((len(away), 1), bool), held[:, :-1] < k), 1), 1)
            bound = np.where(first & (sizes > 0), reach, 0).max(1)
            bound[held[:, -1] < k] = np.inf
            needed = (sizes > 0) & (first | (away - radii <= bound[:, None]))
            out: list[tuple] = []
            for i in range(len(away)):
                to: dict[tuple[bool, int], list[int]] = {}
                for b in np.flatnonzero(needed[i]).tolist():
                    for part in columns[b]:
                        to.setdefault((bool(first[i, b]), part), []).append(b)
                out += [(i, f, part, own, away[i, own].tolist()) for (f, part), own in to.items()]
            row = pa.array([x[0] for x in out], pa.int64())
            more = [pa.array([x[1] for x in out], pa.bool_()), pa.array(bound).take(row), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.int32())), pa.array([x[4] for x in out], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("query").take(row), batch.column("point").take(row), *more], names=["query", "point", "first", "bound", "part", "balls", "away"])

    rows = points.select("query", F.col("point").cast("array<double>").alias("point")).where(F.size("point") == pivots.shape[1])
    more = [("first", T.BooleanType()), ("bound", T.DoubleType()), ("part", T.IntegerType()), ("balls", T.ArrayType(T.IntegerType())), ("away", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, kind) for n, kind in more]]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a partition, cut where another part or side begins."""
    for batch in batches:
        if batch.num_rows:
            new = (np.diff(batch.column("part").to_numpy()) != 0) | (np.diff(batch.column("side").to_numpy()) != 0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(s, e - s) for s, e in zip(edges[:-1], edges[1:], strict=True))


def _within(a: np.ndarray, b: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest of b to each of a, and of more that are as near but for rounding, within the bounds."""
    squares = np.square(b).sum(1)
    d = np.square(a).sum(1)[:, None] + squares - 2 * (a @ b.T)
    slack = (np.square(a).sum(1) + squares.max()) * SLACK
    most = np.minimum(np.square(bound), np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.inf)
    row, place = np.nonzero(d <= (most * (1 + SLACK) + slack)[:, None])
    away = np.sqrt(np.square(a[row] - b[place]).sum(1))
    near = away <= bound[row] * (1 + SLACK)
    return row[near], place[near], away[near]


def _compared(balls: Balls, asked: DataFrame, k: int, counting: bool = False) -> DataFrame:
    """(query, id, distance) of the k nearest within the bound, of each shell; or the number of pairs compared."""
    size, radii, kind, asker = balls.pivots.shape[1], balls.radii, balls.shells.schema["ids"].dataType.elementType, asked.schema["query"].dataType
    left, right = ["ball", "least", "greatest", "ids", "vectors"], ["query", "point", "bound", "balls", "away"]
    types = {f.name: f.dataType for f in [*balls.shells.schema.fields, *asked.schema.fields]}
    none = lambda names: [F.lit(None).cast(types[n]).alias(n) for n in names]
    shells = balls.shells.select("part", F.lit(0).alias("side"), *left, *none(right))
    rows = shells.union(asked.select("part", F.lit(1).alias("side"), *none(left), *right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, pairs = None, {}, 0
        for batch in _runs(batches):
            if part != batch.column("part")[0].as_py():
                part, held = batch.column("part")[0].as_py(), {}
            if batch.column("side")[0].as_py() == 0:
                for i in range(batch.num_rows):
                    ball, least, greatest = (batch.column(c)[i].as_py() for c in left[:3])
                    held.setdefault(ball, []).append((least, greatest, batch.column("ids")[i].values, np.frombuffer(batch.column("vectors")[i].as_py(), np.float32).reshape(-1, size)))
                continue
            points, bound = _matrix(batch.column("point"), size), batch.column("bound").to_numpy()
            counts = np.diff(batch.column("balls").offsets.to_numpy())
            of, ball, away = np.repeat(np.arange(batch.num_rows), counts), batch.column("balls").flatten().to_numpy(), batch.column("away").flatten().to_numpy()
            for b in np.unique(ball):
                here = np.flatnonzero((ball == b) & (away - radii[ball] <= bound[of] * (1 + SLACK)))
                for least, greatest, ids, vectors in held.get(int(b), []):
                    gap = np.maximum(away[here] - greatest, least - away[here]) * (1 - SLACK)
                    own = of[here[gap <= bound[of[here]] * (1 + SLACK)]]
                    pairs += len(own) * len(vectors)
                    if len(own) and not counting:
                        row, place, d = _within(points[own], vectors.astype(np.float64), bound[own], k)
                        yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(own[row])), ids.take(pa.array(place)), pa.array(d)], names=["query", "id", "distance"])
        if counting:
            yield pa.RecordBatch.from_pydict({"pairs": [pairs]})

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("pairs", T.LongType())] if counting else [T.StructField("query", asker), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])
    return rows.repartition(parts, "part").sortWithinPartitions("part", "side").mapInArrow(run, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def _phases(balls: Balls, points: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nearest of the first balls; what is asked of them, and of the others with the bound that they gave."""
    asked = written(_asked(balls, points, k))
    first = asked.where("first")
    found = written(_best(_compared(balls, first, k), k))
    kth = found.where(F.col("place") == k).select("query", F.col("distance").alias("kth"))
    rest = asked.where("not first").join(kth, "query", "left").withColumn("bound", F.least("bound", F.coalesce("kth", "bound")))
    return found, first, rest.drop("kth")


def nearest(balls: Balls, points: DataFrame, k: int) -> DataFrame:
    """(query, id, distance, score, place) of the k nearest vectors to each of points (query, point); query names one point."""
    if not len(balls.pivots):
        return points.select("query", F.lit(None).alias("id"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(0).alias("place")).where("false")
    found, _, rest = _phases(balls, points, k)
    rows = found.select("query", "id", "distance").union(_compared(balls, rest, k))
    return _best(rows, k).select("query", "id", "distance", (1 / (1 + F.col("distance"))).alias("score"), "place")


def compared_share(balls: Balls, points: DataFrame, k: int) -> float:
    """The share of all pairs of point and vector that nearest() compares."""
    _, first, rest = _phases(balls, points, k)
    done = _compared(balls, first, k, True).union(_compared(balls, rest, k, True)).agg(F.sum("pairs")).first()[0]
    return (done or 0) / max(points.count() * int(balls.sizes.sum()), 1)
