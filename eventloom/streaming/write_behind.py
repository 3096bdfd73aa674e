"""Write-behind: a stream of rows into a stored log, each row once and in order.

Spark's batches are the coalescing: a trigger's rows are one append.  A ledger in
the log's commits says which batch of which stream is in, so a batch that comes
again after a crash is left out; a batch that failed is tried again before any
later one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..folders import Conflict, commit_of, revision
from ..sources.appends import append

Write = Callable[..., int]


def write_batch(rows: DataFrame, batch: int, folder: str, stream: str, *, attempts: int = 3, wait: float = 0.5, write: Write = append) -> None:
    """Append one batch, unless it is in; what fails is tried again, and raised after the last attempt.

    Where another writer was faster, the batch goes after its rows.
    """
    spark, tries = rows.sparkSession, 0
    rows.persist()
    try:
        while True:
            base = revision(spark, folder)
            if commit_of(spark, folder, base).get("ledger", {}).get(stream, -1) >= batch or rows.isEmpty():
                return
            try:
                write(rows, folder, base, skip_known=True, ledger={stream: batch})
                return
            except Conflict:
                continue
            except Exception:
                tries += 1
                if tries >= attempts:
                    raise
                time.sleep(wait * 2 ** (tries - 1))
    finally:
        rows.unpersist()


def write_behind(rows: DataFrame, folder: str, stream: str, checkpoint: str, *, interval: str = "200 milliseconds", attempts: int = 3, wait: float = 0.5, write: Write = append) -> StreamingQuery:
    """Start writing a stream of rows behind its source.

    A stream that stopped at a failure goes on, when started again with its
    ``checkpoint``, at the batch that failed.
    """

    def run(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, folder, stream, attempts=attempts, wait=wait, write=write)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def flush(query: StreamingQuery) -> None:
    """Wait until all rows that were there are stored; raises what stopped the stream."""
    query.processAllAvailable()
