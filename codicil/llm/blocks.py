"""Comparing all members of a bucket with each other in blocks of bounded size.

A bucket of many members is dealt into parts; a block holds two parts of one bucket (or one, with itself),
so that every pair meets in exactly one block. A member is sent to as many blocks as its bucket has parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def halves(members: DataFrame, key: tuple[str, ...], *carry: str) -> DataFrame:
    """members (bucket columns, _node, _parts: those of the bucket) -> rows sorted by key, which is the bucket, _lo and _hi, with _half and carry."""
    return (
        members.withColumn("_half", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)))
        .withColumns({"_lo": F.least("_half", "_other"), "_hi": F.greatest("_half", "_other")})
        .select(*key, "_half", *carry)
        .repartition(*key)
        .sortWithinPartitions(*key)
    )


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of rows that are equal in by, of batches sorted by them; a run may pass from batch to batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Forest:
    """Which of n rows are joined, by label propagation over whole arrays of pairs."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.low[x], self.low[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.low, np.maximum(a, b), np.minimum(a, b))
            while (self.low != (up := self.low[self.low])).any():
                self.low = up

    def roots(self) -> np.ndarray:
        return self.low
