"""The surface fold: the visible view of a log whose ranges can be replaced.

Rows are appended to a list or replace a range of it, by the numbers of the
range's first and last row.  Positions move, so no window can say it; each
session is folded in order inside one task, long ones in blocks by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import shared_folder
from ..ordered import by_session
from ..schema import SURFACE_TYPES
from . import surface_blocks as blocks

#: Sessions of more rows are folded in blocks of so many.
BLOCK_ROWS = 20_000
#: Rows of a batch of the result.
_OUT_ROWS = 10_000


class SurfaceError(ValueError):
    """A log that can't be folded."""


class Surface:
    """The fold's state: the current rows, each with its neighbours, and who replaced whom."""

    def __init__(self) -> None:
        # -1 stands before the first row and after the last.
        self._after: dict[int, int] = {-1: -1}
        self._before: dict[int, int] = {-1: -1}
        self.replaced_by: dict[int, int] = {}
        self.next_seq = 0

    @property
    def current(self) -> list[int]:
        """The current rows in order."""
        return self._range(self._after[-1], -1)[:-1]

    def _range(self, start: int, end: int) -> list[int]:
        """The rows from ``start`` to ``end``, or to the last and -1 where ``end`` doesn't follow."""
        out = [start]
        while out[-1] not in (end, -1):
            out.append(self._after[out[-1]])
        return out

    def _put(self, seq: int, before: int, after: int) -> None:
        self._before[seq], self._after[seq] = before, after
        self._after[before] = self._before[after] = seq

    def apply(self, seq: int, kind: str, op: str | None, start: int | None, end: int | None, sources: list[int] | None) -> None:
        if seq != self.next_seq:
            raise SurfaceError(f"row {seq} where {self.next_seq} was due")
        self.next_seq += 1
        if kind not in SURFACE_TYPES:
            if op is not None:
                raise SurfaceError(f"row {seq} of type {kind} can't be on the surface")
            return
        if op is None:
            raise SurfaceError(f"row {seq} doesn't say where it goes")
        sources = [] if sources is None else list(sources)
        if len(set(sources)) < len(sources) or any(s >= seq or s < 0 for s in sources):
            raise SurfaceError(f"row {seq} cites rows that don't come before it, or one twice")
        if op == "append":
            self._put(seq, self._before[-1], -1)
        elif op == "replace":
            if any(x is None or x < 0 or x not in self._after for x in (start, end)):
                raise SurfaceError(f"row {seq} replaces rows that aren't current")
            gone = self._range(start, end)
            if gone[-1] != end:
                raise SurfaceError(f"row {seq} replaces a range that ends before it starts")
            if missing := set(gone) - set(sources):
                raise SurfaceError(f"row {seq} doesn't cite {sorted(missing)}, which it replaces")
            self._put(seq, self._before[start], self._after[end])
            for x in gone:
                del self._before[x], self._after[x]
            self.replaced_by.update(dict.fromkeys(gone, seq))
        else:
            raise SurfaceError(f"row {seq} has the unknown operation {op}")


FOLDED = "session_id string, seq bigint, surface string, position bigint, replaced_by bigint, error string"


def fold(log: DataFrame, strict: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``session_id, seq, surface, position, replaced_by, error`` of every row.

    ``surface`` is current, shadowed or log-only; ``position`` is the place among
    the current rows.  A session that can't be folded raises an error, or, when
    not ``strict``, has it in ``error`` and null states.  A session of up to
    ``block_rows`` rows is one task's work, which holds three numbers or fewer a
    row.  A longer one is folded in blocks of so many rows by as many tasks, with
    the same result; only one that can't be folded goes row by row, to say why.
    """
    rows = log.select(F.col("session_id").cast("string").alias("session_id"), "seq", "type", "surface_op.op", "surface_op.start", "surface_op.end", "source_event_seqs")
    long = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("session_id")
    if long.isEmpty():
        return _row_by_row(rows, strict)
    shared_folder(rows.sparkSession)
    in_blocks = rows.join(long, "session_id", "left_semi")
    folded = blocks.fold_blocks(in_blocks, block_rows).checkpoint()
    faulty = folded.where("fault").select("session_id").union(blocks.uncited(folded, in_blocks)).distinct()
    one_by_one = rows.join(long, "session_id", "left_anti")
    if not faulty.isEmpty():
        one_by_one = one_by_one.unionByName(rows.join(faulty, "session_id", "left_semi"))
        folded = folded.join(faulty, "session_id", "left_anti")
    found = blocks.positioned(folded).select("session_id", "seq", "surface", "position", "replaced_by", F.lit(None).cast("string").alias("error"))
    return _row_by_row(one_by_one, strict).unionByName(found)


def _row_by_row(rows: DataFrame, strict: bool) -> DataFrame:
    def out(name: str, seqs: list[int], state: list[str | None], place: list[int | None], by: list[int | None], error: str | None) -> pa.RecordBatch:
        columns = [pa.array([name] * len(seqs), pa.string()), pa.array(seqs, pa.int64()), pa.array(state, pa.string()), pa.array(place, pa.int64()), pa.array(by, pa.int64()), pa.array([error] * len(seqs), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["session_id", "seq", "surface", "position", "replaced_by", "error"])

    def failed(name: str, seqs: list[int], error: str) -> pa.RecordBatch:
        none = [None] * len(seqs)
        return out(name, seqs, none, none, none, error)

    def run(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, error, done = Surface(), None, 0
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            if error is None:
                try:
                    for k, row in enumerate(batch.select(["seq", "type", "op", "start", "end", "source_event_seqs"]).to_pylist()):  # noqa: B007
                        state.apply(*row.values())
                        done += 1
                    continue
                except SurfaceError as e:
                    if strict:
                        raise
                    error, seqs = str(e), seqs[k:]
                    for a in range(0, done, _OUT_ROWS):
                        yield failed(name, list(range(a, min(a + _OUT_ROWS, done))), error)
            yield failed(name, seqs, error)
        if error is not None:
            return
        place = {s: k for k, s in enumerate(state.current)}
        # The rows of a session without error are numbered from 0 on.
        for a in range(0, done, _OUT_ROWS):
            rows = range(a, min(a + _OUT_ROWS, done))
            surface = ["current" if s in place else "shadowed" if s in state.replaced_by else "log-only" for s in rows]
            yield out(name, list(rows), surface, [place.get(s) for s in rows], [state.replaced_by.get(s) for s in rows], None)

    return by_session(rows, run, FOLDED)


def classified(log: DataFrame, folded: DataFrame) -> DataFrame:
    """The log with each row's surface."""
    return log.join(folded.select("session_id", "seq", "surface"), ["session_id", "seq"], "left").withColumn("surface", F.coalesce("surface", F.lit("log-only")))
