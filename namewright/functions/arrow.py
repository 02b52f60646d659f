"""Arrow helpers for operators that stream sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers that are equal where the values are; null is -1 beside non-negative codes.

    Only equality is kept, and only within this column.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column; the first row always does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a group of equal keys; the input is sorted by key.

    Holds one group and one batch: callers bound the size of a group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        column, last = table.column(key), table.column(key)[-1]
        same = pc.is_null(column) if not last.is_valid else pc.fill_null(pc.equal(column, last), False)
        start = table.num_rows - pc.sum(same).as_py()
        if start:
            yield pa.concat_tables([*held, table.slice(0, start)])
            held = [table.slice(start)]
        elif held and held[-1].column(key)[-1] != last:
            yield pa.concat_tables(held)
            held = [table]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)
