"""Embedding columns as whole-number matrices inside tasks, and small partial results merged in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges.
FAN = 16


def usable(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an array<double> column are vectors of that width (any, but all the same, if None) without null or
    non-finite entries, and these as a matrix."""
    n = len(column)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    sound = (sizes >= 0) & (wrong[ends] == wrong[ends - np.maximum(sizes, 0)])
    if width is None:
        width = int(sizes[sound][0]) if sound.any() else 0
    keep = sound & (sizes == width)
    at = (ends - width)[keep][:, None] + np.arange(width)
    return np.flatnonzero(keep) if n else np.zeros(0, np.int64), flat[at].reshape(-1, width) if n else np.zeros((0, width))


def whole(x: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x) as longs; entries beyond the bound count as the bound."""
    return np.clip(np.floor(scale * x), -bound, bound).astype(np.int64)


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """parts has rows of one partial result each (part long, state binary), numbered from 0 on without many gaps. They are merged FAN at a time
    on the executors, level by level, in the order of their numbers; one state comes to the driver."""
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [bytes(s) for s in pdf.sort_values("part").state]
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN], "state": [merge(states)]})

    while last:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInPandas(one, "part long, state binary")
        last //= FAN
    return bytes(parts.first().state)


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
