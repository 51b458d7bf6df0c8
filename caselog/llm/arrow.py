"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]

SLICE_BYTES = 4_000_000


def sliced(batches: Batches, column: int, most: int = SLICE_BYTES) -> Batches:
    """The same rows in smaller batches: a slice ends once its texts pass ``most`` bytes, so memory follows the
    slice and the longest text, not Spark's rows per batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = (np.cumsum(sizes) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), type=kind))


def list_rows(column: pa.ListArray) -> list[np.ndarray]:
    """One array per row of a list column without nulls inside; a null row is empty."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


class Cache:
    """Values kept by key for one task; emptied when full, so it stays bounded whatever the vocabulary."""

    def __init__(self, compute: Callable, most: int = 120_000):
        self.compute, self.most, self.kept = compute, most, {}

    def values(self, keys: list) -> list:
        """The value of each key, none of them None; new keys are computed together."""
        found = list(map(self.kept.get, keys))
        if None in found:
            new = list(dict.fromkeys(k for k, v in zip(keys, found) if v is None))
            if len(self.kept) + len(new) > self.most:
                self.kept = {k: v for k, v in zip(keys, found) if v is not None}
            self.kept.update(zip(new, self.compute(new)))
            found = list(map(self.kept.__getitem__, keys))
        return found

    def rows(self, rows: list[list]) -> list[list]:
        """The values of several rows of keys; what is new in any of them is computed in one go."""
        flat = self.values([k for row in rows for k in row])
        cuts = np.cumsum([0, *map(len, rows)]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]
