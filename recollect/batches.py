"""Arrow batches of a partition, run by run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a sorted partition, each as one table. A run may go on over several batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        start = 0
        for cut in np.flatnonzero(new):
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], int(cut)
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
