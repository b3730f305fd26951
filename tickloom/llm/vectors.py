"""Vectors of Arrow list columns as NumPy matrices, and sums of what tasks found, merged as a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at once.
CHUNK_ROWS = 4096


class Lists:
    """A list column; length is -1 for a row that is null or holds a null or a number that isn't finite."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_list(pa.float64()))
        missing = column.is_null().to_numpy(zero_copy_only=False)
        self.values = column.values.to_numpy(zero_copy_only=False)
        self.offsets = column.offsets.to_numpy()
        bad = np.r_[0, np.cumsum(~np.isfinite(self.values))]
        self.length = np.diff(self.offsets)
        self.length[missing | (bad[self.offsets[1:]] > bad[self.offsets[:-1]])] = -1

    def matrices(self, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their values) of the vectors of length d, a chunk at a time."""
        rows = np.flatnonzero(self.length == d)
        for i in range(0, len(rows), CHUNK_ROWS):
            part = rows[i : i + CHUNK_ROWS]
            yield part, self.values[self.offsets[part][:, None] + np.arange(d)]


def floored(values: np.ndarray, scale: float, limit: int) -> np.ndarray:
    """floor(scale * value) as integers; beyond limit they are limit."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -limit, limit).astype(np.int64)


def tree(partials: DataFrame, add: Callable[[Any, Any], Any], decode: Callable[[Any], Any]) -> Any:  # noqa: ANN401
    """All rows of partials decoded and added up by treeAggregate, as deep as leaves few of them for the driver; None if there are none."""
    rdd = partials.rdd
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), 8)))

    def both(a: Any, b: Any) -> Any:  # noqa: ANN401
        return b if a is None else a if b is None else add(a, b)

    return rdd.treeAggregate(None, lambda acc, row: both(acc, decode(row)), both, depth)


def length_of(vectors: DataFrame, column: str) -> int | None:
    """The most frequent length of the vectors without nulls and numbers that aren't finite; of several the greatest. None: there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n = np.unique(Lists(batch.column(0)).length, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))], ["d", "n"])

    sizes = vectors.select(column).mapInArrow(count, "d bigint, n bigint").where("d >= 0").groupBy("d").agg(F.sum("n").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else None
