"""Epoch columns of Arrow batches as NumPy blocks, without per-value Python objects."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_OUT = pa.list_(pa.list_(pa.float64()))


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, block)`` per epoch shape of a batch, blocks being ``(n, channels, times)``."""
    if column.null_count:
        raise ValueError("epochs must not be missing; filter them first")
    outer = column.offsets.to_numpy()
    inner = column.values
    edges = inner.offsets.to_numpy()
    flat = inner.values.to_numpy(zero_copy_only=False)
    channels = np.diff(outer)
    first = edges[np.minimum(outer[:-1], len(edges) - 2)] if len(edges) > 1 else np.zeros(len(outer) - 1, dtype=int)
    spans = edges[outer[1:]] - edges[outer[:-1]]
    times = np.where(channels > 0, spans // np.maximum(channels, 1), 0)
    if not (times * channels == spans).all():
        raise ValueError("epochs must be rectangular")
    for c, t in sorted({(int(c), int(t)) for c, t in zip(channels, times)}):
        rows = np.flatnonzero((channels == c) & (times == t))
        pick = first[rows][:, None] + np.arange(c * t)[None, :]
        yield rows, flat[pick].reshape(len(rows), c, t).astype(np.float64)


def column_of(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Blocks back to one epoch column in row order."""
    shape = {}
    for k, (rows, block) in enumerate(parts):
        for at, row in enumerate(rows):
            shape[int(row)] = (k, at)
    channels = np.array([parts[shape[i][0]][1].shape[1] for i in range(n)], dtype=np.int32)
    times = np.array([parts[shape[i][0]][1].shape[2] for i in range(n)], dtype=np.int32)
    if len(parts) == 1:
        values = parts[0][1].ravel()
    else:
        values = np.concatenate([parts[shape[i][0]][1][shape[i][1]].ravel() for i in range(n)]) if n else np.zeros(0)
    outer = np.concatenate([[0], np.cumsum(channels)]).astype(np.int32)
    inner = np.concatenate([[0], np.cumsum(np.repeat(times, channels))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(values)))


def map_epochs(df: DataFrame, column: str, out: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``fn`` to the blocks of an epoch column; other columns pass through untouched."""
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    fields = [T.StructField(f.name, kind) if f.name == out else f for f in df.schema.fields]
    if out not in df.columns:
        fields.append(T.StructField(out, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(rows, fn(block)) for rows, block in blocks(batch.column(column))]
            made = column_of(parts, batch.num_rows) if batch.num_rows else pa.array([], type=_OUT)
            names = list(batch.schema.names)
            arrays = list(batch.columns)
            if out in names:
                arrays[names.index(out)] = made
            else:
                names.append(out)
                arrays.append(made)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, T.StructType(fields))


def fold_epochs(
    df: DataFrame, column: str, schema: str, start: Callable[[], object], step: Callable[[object, np.ndarray], object],
    finish: Callable[[object], dict[str, list]],
) -> DataFrame:
    """One partial aggregate per partition over the blocks of an epoch column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                state = step(state, block)
        made = finish(state)
        if made and len(next(iter(made.values()))):
            yield pa.RecordBatch.from_pydict(made)

    return df.select(column).mapInArrow(run, schema)
