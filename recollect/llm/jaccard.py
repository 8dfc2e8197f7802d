"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams. Two link when 100 * intersection >= percent * union.
All n-grams have one global order, by hash, and it is cut into fragments. Partial overlaps are counted in
each fragment by itself and summed per pair, for the pairs that can link at all:

1. Equal sets are one representative. Of a set of n the first m in the global order are sampled, m so
   large that two linked sets share at least `need` sampled n-grams. Sets with fewer sampled n-grams that another sample has
   too are out. The same is done with the whole sets that are left, where `need` is percent of n.
2. Of what it shares with any other a set keeps its rarest n-grams but for need - 1; linked sets have one of those in common.
   In STARS rounds each set is paired with the one set that comes first in most of its kept n-grams' lists; the partial overlaps of these
   pairs are summed, and what links becomes one class. That takes one pair for each set however large a group of near copies is.
3. Sets that share a kept n-gram with a set of another class have all such partners left to compare. They lie in blocks by class and size, and
   each pair of blocks is a task of its own, unless both lie in one class or no sizes in them can link. In each task the
   fragments' overlap matrices are counted, then summed; the links are reduced to a
   spanning forest, and the components of all links are the answer. No link between different sets is lost.

N-grams are compared by 64-bit hashes, sets by 128 bits. A document without words is empty and links with nothing, as does a null text. A shorter text
than n words is one n-gram. Rows of one doc_id are one document: what links with any of its texts links with it, but for texts without words. Rows without doc_id stay by themselves.
Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.batches import groups
from recollect.llm import arrow
from recollect.llm.graph import components
from recollect.session import cut, numbered, written

#: Fragments of the global order of n-grams.
FRAGMENTS = 4
#: Sets in a block of a cluster.
BLOCK = 256
#: Rounds of pairs with one partner for each set.
STARS = 2
#: Sampled n-grams of 100 beyond the prefix that any link needs.
SPARE = 5


def sampled(n: np.ndarray | int, percent: int):
    """How many of n n-grams are sampled: the prefix that a link cannot miss and SPARE percent."""
    return np.minimum(n, n * (100 - percent) // 100 + np.maximum(1, n * SPARE // 100))


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """id, n (set size), one and two (a digest of the set), sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = arrow.spaced_words()
        for batch in batches:
            for part in arrow.slices(batch):
                own = [np.unique(g) for g in _grams(part, tables, k)]
                digests = np.array([(g.sum(dtype=arrow.U), arrow.mix(g).sum(dtype=arrow.U)) for g in own], arrow.U).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.array([len(g) for g in own], np.int64)), arrow.longs(digests[:, 0]), arrow.longs(digests[:, 1]), arrow.long_lists([g[: sampled(len(g), percent)] for g in own])],
                    names=["id", "n", "one", "two", "sample"],
                )

    return docs.select("id", "text").mapInArrow(run, "id long, n long, one long, two long, sample array<long>")


def _grams(part: pa.RecordBatch, tables, k: int) -> list[np.ndarray]:
    data, at = arrow.text_bytes(part.column("text"))
    grams, at = arrow.shingle_hashes(*arrow.word_hashes(data, at, tables), k)
    return [grams[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def known(samples: DataFrame) -> DataFrame:
    """rep, n, gram and df (how many sets have it) of the n-grams that another set has too. samples: rep, n, sample."""
    rows = samples.select("rep", "n", F.explode("sample").alias("gram"))
    # A table of its own, so that Spark can split the rows of a very common n-gram.
    often = written(rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    return rows.join(often, "gram")


def survivors(samples: DataFrame, percent: int) -> DataFrame:
    """rep of every set whose sample leaves it a chance. samples: rep, n, sample."""
    need = F.expr(f"greatest(1, ((n * {percent} + 99) div 100) * {SPARE} div 100)")
    return known(samples).groupBy("rep", "n").agg(F.count("*").alias("own")).where(F.col("own") >= need).select("rep")


def whole_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """rep, n and sample, here all n-grams, of the sets named in reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = arrow.spaced_words()
        for batch in batches:
            for part in arrow.slices(batch):
                own = [np.unique(g) for g in _grams(part, tables, k)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(np.array([len(g) for g in own], np.int64)), arrow.long_lists(own)], names=["rep", "n", "sample"])

    # Merged at every size: what is left grows with the input and isn't sent to all tasks.
    texts = docs.select(F.col("id").alias("rep"), "text").join(reps.hint("merge"), "rep")
    return texts.mapInArrow(run, "rep long, n long, sample array<long>")


def kept_grams(whole: DataFrame, percent: int) -> DataFrame:
    """rep, n and gram: what each set keeps of its n-grams, so that linked sets have one in common."""
    own = known(whole).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("own"))
    own = own.withColumn("need", F.expr(f"(n * {percent} + 99) div 100")).where(F.size("own") >= F.col("need"))
    return own.select("rep", "n", F.explode(F.expr("slice(own, 1, cast(size(own) - need + 1 as int))")).alias("key")).select("rep", "n", F.col("key.gram").alias("gram"))


def pieces(whole: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, n, fragment and grams: the sets of reps, each cut into the fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = arrow.U(64 - (FRAGMENTS - 1).bit_length())
        for batch in batches:
            lists = batch.column("sample")
            at, grams = lists.offsets.to_numpy(), lists.values.to_numpy().view(arrow.U)
            own = [grams[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            edges = [np.searchsorted(g >> width, np.arange(FRAGMENTS + 1)) for g in own]
            take = pa.array(np.repeat(np.arange(len(own)), FRAGMENTS))
            parts = arrow.long_lists([g[e[f] : e[f + 1]] for g, e in zip(own, edges, strict=True) for f in range(FRAGMENTS)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("rep", "n")], pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(own))), parts], names=["rep", "n", "fragment", "grams"])

    return whole.join(reps, "rep", "left_semi").select("rep", "n", "sample").mapInArrow(run, "rep long, n long, fragment int, grams array<long>")


def classed(keys: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The kept n-grams with the class of their set, as the edges have it so far."""
    if edges is None:
        return keys.withColumn("class", F.col("rep"))
    found = components(edges).withColumnRenamed("id", "rep")
    return keys.join(found, "rep", "left").withColumn("class", F.coalesce("component", "rep")).drop("component")


def star(keys: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of each set and the first set of another class in most of its lists. keys: rep, n, gram, class."""
    first = written(keys.groupBy("gram").agg(F.min(F.struct("rep", "n", "class")).alias("first"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("gram", "first"))
    near = keys.join(first, "gram").where((F.col("class") != F.col("first.class")) & (100 * F.least("n", "first.n") >= percent * F.greatest("n", "first.n")))
    votes = near.groupBy("rep", F.col("first.rep").alias("pivot")).agg(F.count("*").alias("votes"))
    pairs = written(votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("pivot"))).alias("best")).select(F.col("rep").alias("a"), (-F.col("best.pivot")).alias("b")))
    left = pairs.join(parts.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a")), "a")
    both = left.join(parts.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b")), ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def clusters(keys: DataFrame) -> DataFrame:
    """rep, n, class and cluster of every set that shares a kept n-gram with a set of another class."""
    first = written(keys.groupBy("gram").agg(F.min("rep").alias("first"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("gram", "first"))
    open_ = keys.join(first, "gram")
    found = components(open_.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    return open_.select("rep", "n", "class").distinct().join(found, "rep")


def tasks(parts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """cluster, i, j (two blocks), fragment, rep, n, side and the n-grams of each set in each fragment, once for each task it is in."""
    placed = numbered(members.select("cluster", "class", "n", "rep"), ["cluster", "class", "n", "rep"], "number", 0)
    placed = written(placed.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long")).drop("number"))
    blocks = written(placed.groupBy("cluster", "block").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")))
    other = blocks.select("cluster", *[F.col(c).alias(f"{c}_j") for c in ("block", "low", "high", "least", "most")])
    pairs = blocks.join(other, "cluster").where("block <= block_j and not (low = high and low = low_j and low = high_j)")
    pairs = pairs.where((100 * F.col("most") >= percent * F.col("least_j")) & (100 * F.col("most_j") >= percent * F.col("least")))
    sides = pairs.select("cluster", F.col("block").alias("i"), F.col("block_j").alias("j"))
    both = sides.select("*", F.col("i").alias("block"), F.lit(False).alias("side")).union(sides.where("i < j").select("*", F.col("j").alias("block"), F.lit(True).alias("side")))
    return parts.join(placed.select("cluster", "block", "rep"), "rep").join(both, ["cluster", "block"]).select("cluster", "i", "j", "fragment", "rep", "n", "side", "grams")


TASK = ["cluster", "i", "j"]


def overlaps(dealt: DataFrame) -> DataFrame:
    """The overlap matrix of each task in each fragment, over its sets by rep: int32, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*TASK, "fragment"]):
            lists = group.column("grams").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            lengths = np.diff(lists.offsets.to_numpy())
            matrix = _shared(lists.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths), len(lengths))
            first = group.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*[first.column(c).combine_chunks() for c in TASK], pa.array([group.column(c).to_pylist() for c in ["rep"]], pa.list_(pa.int64())), pa.array([group.column("n").to_pylist()], pa.list_(pa.int64())), pa.array([group.column("side").to_pylist()], pa.list_(pa.bool_())), pa.array([matrix.tobytes()], pa.binary())],
                names=[*TASK, "reps", "n", "sides", "partial"],
            )

    keyed = dealt.repartition(*TASK, "fragment").sortWithinPartitions(*TASK, "fragment", "rep", "n", "side")
    return keyed.mapInArrow(run, "cluster long, i long, j long, reps array<long>, n array<long>, sides array<boolean>, partial binary")


def _shared(grams: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many n-grams each two of `count` sets share."""
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1)[column] > 1 if len(grams) else new
    owner, column = owner[often], column[often]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    total = np.zeros((count, count), np.int32)
    for start in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        here = (column >= start) & (column < start + 4096)
        dense = np.zeros((count, int(column[here].max()) - start + 1), np.float32)
        dense[owner[here], column[here] - start] = 1
        total += (dense @ dense.T).astype(np.int32)
    return total


def links(partial: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) of a spanning forest of each task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, TASK):
            reps = group.column("reps")[0].as_py()
            n, sides = np.array(group.column("n")[0].as_py()), np.array(group.column("sides")[0].as_py())
            total = np.zeros((len(reps), len(reps)), np.int64)
            for x in group.column("partial"):
                total += np.frombuffer(x.as_py(), np.int32).reshape(total.shape)
            linked = 100 * total >= percent * (n[:, None] + n[None, :] - total)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= sides[:, None] != sides[None, :]
            edges = _forest(linked)
            if edges:
                a, b = zip(*[(reps[x], reps[y]) for x, y in edges], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return partial.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(run, "a long, b long")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    seen, edges = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            x = stack.pop()
            near = np.flatnonzero(linked[x] & ~seen)
            seen[near] = True
            edges += [(x, int(y)) for y in near]
            stack += near.tolist()
    return edges


def _linked(docs: DataFrame, own: DataFrame, k: int, percent: int, same: DataFrame | None = None) -> DataFrame:
    """one, two and component: the smallest id that links lead to from each set. docs: id, text, where equal ids have equal texts; own: id, n, one, two; same: ids (a, b) that count as linked."""
    named = own.where("n > 0")
    samples = sets(docs, k, percent).where("n > 0").groupBy("one", "two").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sample").alias("sample"))
    whole = written(whole_sets(docs, written(survivors(written(samples.select("rep", "n", "sample")), percent)), k))
    keys = written(kept_grams(whole, percent))
    parts = written(pieces(whole, keys.select("rep").distinct()))
    reps = written(named.groupBy("one", "two").agg(F.min("id").alias("rep")))
    edges = None
    if same is not None:
        rep = named.join(reps, ["one", "two"]).select("id", "rep")
        edges = written(same.join(rep.toDF("a", "x"), "a").join(rep.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    for _ in range(STARS):
        more = written(star(written(classed(keys, edges)), parts, percent))
        edges = more if edges is None else edges.union(more)
    members = written(clusters(written(classed(keys, edges))))
    if not members.isEmpty():
        more = links(overlaps(tasks(parts, members, percent)), percent)
        edges = more if edges is None else edges.union(more)
    found = components(edges)
    return reps.join(found, F.col("rep") == F.col("id"), "left").select("one", "two", F.coalesce("component", "rep").alias("component"))


def join(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to, for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    own = cut(sets(docs, k, percent).drop("sample"))
    named = own.where("id is not null")
    if named.groupBy("id").agg(F.min(F.struct("one", "two")).alias("low"), F.max(F.struct("one", "two")).alias("high")).where("low != high").isEmpty():
        found, own = _linked(docs.where("id is not null"), named, k, percent), own.withColumn("doc_id", F.col("id"))
    else:
        # Some doc_id has several texts: they are numbered in the order of doc_id, and count as linked.
        digest = F.coalesce(F.md5("text"), F.lit(""))
        keyed = docs.select(F.col("id").alias("doc_id"), digest.alias("digest"), "text")
        numbers = written(numbered(keyed.where("doc_id is not null").select("doc_id", "digest").distinct(), ["doc_id", "digest"], "id", 0))
        texts = written(keyed.join(numbers, ["doc_id", "digest"], "left"))
        own = written(sets(texts, k, percent).drop("sample").where("id is not null").distinct())
        same = numbers.join(numbers.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
        found = _linked(texts.where("id is not null").select("id", "text"), own, k, percent, same)
        found = found.join(numbers.select(F.col("id").alias("component"), "doc_id"), "component").select("one", "two", F.col("doc_id").alias("component"))
        alone = sets(texts.where("id is null"), k, percent).drop("sample").withColumn("doc_id", F.lit(None).cast("long"))
        own = texts.where("id is not null").select("id", "doc_id").join(own, "id").select(alone.columns).union(alone)
    lone = (F.col("n") == 0) | F.col("doc_id").isNull()
    rows = own.select("doc_id", F.col("n").alias("n_shingles"), F.when(lone, None).otherwise(F.col("one")).alias("one"), F.when(lone, None).otherwise(F.col("two")).alias("two"))
    return rows.join(found, ["one", "two"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id names their component, equal rows of one doc_id once, and all rows without doc_id. All columns stay.

    Different texts of one doc_id are documents of their own, in the order of (doc_id, digest of the text)."""
    named = docs.where("doc_id is not null")
    digest = F.coalesce(F.md5("text"), F.lit(""))
    short = F.xxhash64("text")
    key, number = "_digest", "_number"
    while {key, number} & set(docs.columns):
        key, number = f"{key}_", f"{number}_"
    # Numbering takes the texts through one more shuffle, so it is done only where a doc_id has several.
    if named.groupBy("doc_id").agg(F.min(short).alias("low"), F.max(short).alias("high")).where("low != high").isEmpty():
        kept = join(named, k, percent).where("doc_id = component_id").select("doc_id").distinct()
        own = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    else:
        texts = numbered(named.select("doc_id", digest.alias(key)).distinct(), ["doc_id", key], number)
        keyed = named.withColumn(key, digest).join(texts, ["doc_id", key])
        kept = join(keyed.select(F.col(number).alias("doc_id"), "text"), k, percent).where("doc_id = component_id").select(F.col("doc_id").alias(number)).distinct()
        own = keyed.join(kept, number, "left_semi").dropDuplicates([number])
    return own.select(*docs.columns).union(docs.where("doc_id is null"))
