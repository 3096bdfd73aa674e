"""Sessions in order, a batch at a time: Spark sorts and spills, a task holds the fold's state."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, pa.RecordBatch]]:
    for batch in batches:
        start = 0
        for name, run in itertools.groupby(batch.column("session_id").to_pylist()):
            n = sum(1 for _ in run)
            yield name, batch.slice(start, n)
            start += n


def by_session(rows: DataFrame, run: Callable[[Any, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``run`` for each session: its id and its rows by ``seq``, in batches of which only one is held."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in itertools.groupby(_slices(batches), key=lambda x: x[0]):
            yield from run(name, (batch for _, batch in group))

    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(over, schema)
