"""Whole groups of sorted rows for Arrow functions: many small groups in one table, so that array work spans them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of small groups that go together; a larger group is a table of its own.
TOGETHER = 8 << 20


def _differs(t: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from the row before; nulls are equal to nulls."""
    out = np.zeros(t.num_rows, bool)
    for k in keys:
        now, before = t[k].slice(1), t[k].slice(0, t.num_rows - 1)
        change = pc.fill_null(pc.not_equal(now, before), pc.xor(pc.is_null(now), pc.is_null(before)))
        out[1:] |= np.asarray(change.to_numpy(zero_copy_only=False) if isinstance(change, pa.Array) else change.to_numpy()).astype(bool)
    return out


def group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    """0 for the rows of the first group, 1 for those of the next."""
    return np.cumsum(_differs(t, keys))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= size:
            # Up to the last group that begins in this batch, or at its first row.
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            starts = _differs(batch, keys)
            starts[0] = _differs(seam, keys)[1]
            at = np.flatnonzero(starts)
            if len(at):
                yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
                held, n, batch = [], 0, batch.slice(int(at[-1]))
        held.append(batch)
        n += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(df: DataFrame, keys: list[str], within: list[str] = []) -> DataFrame:  # noqa: B006
    """`df` dealt by `keys`, each group's rows in a row and by `within`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *within)
