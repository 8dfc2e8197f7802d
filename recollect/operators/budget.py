"""Budget gate: of calls in order, which ones still fit under a cap when only what was spent counts.

A call that does not fit is not spent, so a smaller one after it may pass: the sum of what was accepted is carried on, not that of all.
Calls are sorted over ranges by (group, at, id). A task decides the groups that lie within its range at once. Of a group that goes on
over several ranges each range tells its sum and its smallest call: what fits whole, or not at all, needs no second look; else
the range is gone through from what was spent before it, one range of each group a round. A round is a job over the ranges
concerned only; a group takes as many rounds as it has ranges that take some of their calls, which near the cap are few.

Amounts are whole numbers (nano-dollars, say), so that sums do not depend on their order. A null amount counts as 0 and fits; so does
an amount below it. Rows without a group are one group. Equal rows are decided one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.session import cut

#: Calls that are summed at a time.
RUN = 4096
FIELDS = "part long, grp string, first boolean, last boolean, n long, total long, least long"


def accepted(amounts: np.ndarray, spent: int, cap: int) -> tuple[np.ndarray, int]:
    """Which of the calls fit, and what is spent after them: the longest run that fits, the next call that still does, and so on."""
    out = np.zeros(len(amounts), bool)
    at = 0
    while at < len(amounts):
        part = amounts[at : at + RUN]
        sums = spent + np.cumsum(part)
        fit = int(np.searchsorted(sums, cap, "right"))
        out[at : at + fit] = True
        spent = int(sums[fit - 1]) if fit else spent
        at += fit
        if fit < len(part):
            rest = part[fit:] <= cap - spent
            at += int(rest.argmax()) if rest.any() else len(rest)
    return out, spent


def _groups(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray, list[pa.RecordBatch]]:
    """The groups of a partition, where each begins, all amounts, and the batches."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return [], np.zeros(1, np.int64), np.zeros(0, np.int64), []
    names = pa.chunked_array([b.column("grp") for b in held]).to_numpy()
    starts = np.append(0, np.flatnonzero(names[1:] != names[:-1]) + 1)
    amounts = np.concatenate([b.column("amount").to_numpy() for b in held])
    return names[starts].tolist(), np.append(starts, len(names)), amounts, held


def gated(calls: DataFrame, cap: int) -> DataFrame:
    """calls (grp, at, id, amount) with fits: whether the call was still under the group's cap."""
    spark = calls.sparkSession
    rows = calls.withColumns({"grp": F.coalesce(F.col("grp").cast("string"), F.lit("")), "amount": F.greatest(F.coalesce(F.col("amount").cast("long"), F.lit(0)), F.lit(0))})
    parts, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["grp", "at", "id"]
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, edges, amounts, _ = _groups(batches)
        out = []
        for i in sorted({0, len(names) - 1}) if names else []:
            own = amounts[edges[i] : edges[i + 1]]
            out.append((TaskContext.get().partitionId(), names[i], i == 0, i == len(names) - 1, len(own), int(own.sum()), int(own.min())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    # Two rows of each range at most.
    found = sorted(rows.select("grp", "amount").mapInArrow(borders, FIELDS).collect())
    over: dict[str, list] = {}
    for r in found:
        over.setdefault(r["grp"], []).append(r)
    chains = {g: rs for g, rs in over.items() if len(rs) > 1}
    before: dict[tuple[int, str], int] = {}
    state = {g: (0, 0) for g in chains}
    while True:
        ask = {}
        for g, rs in chains.items():
            i, spent = state[g]
            while i < len(rs):
                before[rs[i]["part"], g] = spent
                if spent + rs[i]["total"] <= cap:
                    spent += rs[i]["total"]
                elif rs[i]["least"] <= cap - spent:
                    ask[rs[i]["part"], g] = spent
                    break
                i += 1
            state[g] = (i, spent)
        if not ask:
            break
        for (part, g), spent in _spent(rows, ask, cap).items():
            state[g] = (next(i for i, r in enumerate(chains[g]) if r["part"] == part) + 1, spent)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, edges, amounts, held = _groups(batches)
        part = TaskContext.get().partitionId()
        fits = [accepted(amounts[s:e], before.get((part, g), 0), cap)[0] for g, s, e in zip(names, edges[:-1], edges[1:], strict=True)]
        at, fits = 0, np.concatenate(fits) if fits else np.zeros(0, bool)
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fits[at : at + b.num_rows])], names=[*b.schema.names, "fits"])
            at += b.num_rows

    return rows.mapInArrow(decide, T.StructType([*rows.schema.fields, T.StructField("fits", T.BooleanType(), False)]))


def _spent(rows: DataFrame, ask: dict[tuple[int, str], int], cap: int) -> dict[tuple[int, str], int]:
    """What is spent after the group in the range, for each (range, group) asked with what was spent before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine = {g: s for (p, g), s in ask.items() if p == part}
        if mine:
            names, edges, amounts, _ = _groups(batches)
            for i, g in enumerate(names):
                if g in mine:
                    yield pa.RecordBatch.from_pydict({"part": [part], "grp": [g], "spent": [accepted(amounts[edges[i] : edges[i + 1]], mine[g], cap)[1]]})

    return {(r["part"], r["grp"]): r["spent"] for r in rows.select("grp", "amount").mapInArrow(run, "part long, grp string, spent long").collect()}
