"""The strongest distinct values of groups, kept in each task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that wait before they are merged into a task's state, and rows of a state before it is passed on.
WAITING_ROWS = 40_000
STATE_ROWS = 200_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, nulls one of their own."""
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _merge(table: pa.Table, keys: list[str], value: str, strength: str, k: int) -> pa.Table:
    """The ``k`` strongest distinct values of each group of ``table``."""
    if not table.num_rows:
        return table
    order = [*((key, "ascending") for key in keys), (strength, "descending"), (value, "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=order))
    moved = np.zeros(table.num_rows, bool)
    moved[0] = True
    for key in keys:
        codes = _codes(table.column(key))
        moved[1:] |= codes[1:] != codes[:-1]
    codes = _codes(table.column(value))
    new = moved.copy()
    new[1:] |= codes[1:] != codes[:-1]
    seen = np.cumsum(new)
    group = np.cumsum(moved) - 1
    place = seen - seen[np.flatnonzero(moved)][group]
    return table.filter(pa.array(new & (place < k)))


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], value: str, strength: str, k: int) -> Iterator[pa.RecordBatch]:
    """The state of a task: merged whenever enough rows wait, passed on whenever it has grown too large."""
    state, waiting = None, []

    def merged() -> pa.Table:
        return _merge(pa.concat_tables([*([state] if state is not None else []), *map(lambda b: pa.Table.from_batches([b]), waiting)]), keys, value, strength, k)

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= WAITING_ROWS:
            state, waiting = merged(), []
            if state.num_rows > STATE_ROWS:
                yield from state.to_batches(max_chunksize=10_000)
                state = None
    if waiting:
        state = merged()
    if state is not None:
        yield from state.to_batches(max_chunksize=10_000)


def strongest_distinct(rows: DataFrame, keys: list[str], value: str, strength: str, k: int) -> DataFrame:
    """``rows`` with ``Place`` 1 to ``k``: of each group the distinct values of largest strength, ties by value.

    A value's strength has to be the same in all its rows of a group; any of them stays.  Every task first
    keeps only the ``k`` best of each group it has seen, so at most groups x tasks x ``k`` rows are shuffled, however
    many rows or copies there are.  A task whose groups outgrow its state passes it on and starts anew, so its memory is
    bounded, too.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    few = rows.mapInArrow(lambda batches: _partial(batches, keys, value, strength, k), schema)
    others = [name for name in rows.columns if name not in [*keys, value]]
    once = few.groupBy(*keys, value).agg(*(F.any_value(name).alias(name) for name in others))
    best = Window.partitionBy(*keys).orderBy(F.desc(strength), value)
    return once.withColumn("Place", F.row_number().over(best)).where(F.col("Place") <= k)
