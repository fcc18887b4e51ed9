"""Streaming over the groups of sorted Arrow batches, one bounded group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions and sorted by them there.

    The number is given, so small inputs of costly tasks aren't gathered into a few partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a new key begins, apart from row 0."""
    differs = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        values = table.column(key).to_numpy()
        differs |= values[1:] != values[:-1]
    return np.flatnonzero(differs) + 1


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which the rows of a key are adjacent. Keys are integers without nulls."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        bounds = [0, *_changes(table, keys).tolist()]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield table.slice(lo, hi - lo)
        held = table.slice(bounds[-1])
    if held is not None:
        yield held


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links a-b lead to: labels sink along links and are followed until they rest."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
