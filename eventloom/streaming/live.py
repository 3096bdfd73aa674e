"""Projections over a stream, on Spark's state API: cells, a watermark, and when to write checkpoints.

Each session has a map of cells, one a projection, of which only those that
changed are written, and the last row that all of them have seen.  A stream
begins from stored checkpoints where ``initial`` names them, so a projection can
be added to a running log: it is folded over what is stored, and goes on live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .projections import _EVENT, Projection, event_rows

LIVE = "session_id string, kind string, key string, ver int, seq bigint, value string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """When a session's checkpoint is written: after a row of these types, or after so many rows or milliseconds since the last."""

    rows: int = 50
    milliseconds: int = 5000
    types: tuple[str, ...] = ("turn/end",)


class _Live(StatefulProcessor):
    def __init__(self, projections: list[Projection], policy: Policy | None) -> None:
        self.projections, self.policy = projections, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "key string", "ver int, seq bigint, value string")
        self.seen = handle.getValueState("seen", "seq bigint")
        self.early = handle.getMapState("early", "seq bigint", "type string, time bigint, data string, seed_length bigint")
        self.unwritten = handle.getValueState("unwritten", "rows bigint, due bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ends = set(initialState["seq"].astype(int))
        if len(ends) > 1:
            raise ValueError(f"session {key[0]}: checkpoints of different rows, {sorted(ends)}")
        self.seen.update((ends.pop(),))
        for c in initialState.to_dict("records"):
            self.cells.updateValue((c["key"],), (int(c["ver"]), int(c["seq"]), c["val"]))

    def _states(self, session: str, seen: int) -> dict[str, Any]:
        states = {}
        for p in self.projections:
            held = self.cells.getValue((p.key,)) if self.cells.containsKey((p.key,)) else None
            if held is not None and held[0] == p.version:
                states[p.key] = json.loads(held[2])
            elif seen < 0:
                states[p.key] = p.init()
            else:
                raise ValueError(f"session {session}: {p.key} joins after row {seen}; fold the stored log and start from its checkpoints")
        return states

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, out = key[0], []
        seen = before = self.seen.get()[0] if self.seen.exists() else -1
        states, changed = self._states(session, seen), {}
        unwritten, due = self.unwritten.get() if self.unwritten.exists() else (0, 0)
        write, early = False, 0

        def take(event: dict) -> None:
            nonlocal seen, unwritten, write
            seen = event["seq"]
            for p in self.projections:
                new = states[p.key] if p.own and seen < event["seed_length"] else p.apply(states[p.key], event)
                if new is not states[p.key]:
                    states[p.key] = new
                    changed[p.key] = seen
                    out.append((session, "change", p.key, p.version, seen, json.dumps(p.view(new))))
            unwritten += 1
            if self.policy and (event["type"] in self.policy.types or unwritten >= self.policy.rows):
                write = True
                flush()

        def flush() -> None:
            nonlocal unwritten, due, write
            out.extend((session, "checkpoint", p.key, p.version, seen, json.dumps(states[p.key])) for p in self.projections)
            if due:
                self.handle.deleteTimer(due)
            unwritten, due, write = 0, 0, False

        for part in rows:
            for event in part.sort_values("seq", kind="stable")[_EVENT].to_dict("records"):
                if event["seq"] <= seen:
                    continue
                if event["seq"] > seen + 1:  # its predecessors may be in the next part
                    if not self.early.containsKey((event["seq"],)):
                        early += 1
                    self.early.updateValue((event["seq"],), (event["type"], event["time"], event["data"], event["seed_length"]))
                    continue
                take(event)
                while early and self.early.containsKey((seen + 1,)):
                    kind, time, data, seed = self.early.getValue((seen + 1,))
                    self.early.removeKey((seen + 1,))
                    early -= 1
                    take({"session_id": session, "seq": seen + 1, "type": kind, "time": time, "data": data, "seed_length": seed})
            if len(out) > 1000:
                yield self._frame(out)
                out.clear()
        if early:
            first = min(k[0] for k in self.early.keys())
            raise ValueError(f"session {session}: row {first} after {seen}")
        versions = {p.key: p.version for p in self.projections}
        if before < 0:
            changed = dict.fromkeys(versions, seen) | changed
        for name, seq in changed.items():
            self.cells.updateValue((name,), (versions[name], seq, json.dumps(states[name])))
        if seen > before:
            self.seen.update((seen,))
        if self.policy:
            if unwritten and not due:
                due = timerValues.getCurrentProcessingTimeInMs() + self.policy.milliseconds
                self.handle.registerTimer(due)
            self.unwritten.update((unwritten, due))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        unwritten, due = self.unwritten.get() if self.unwritten.exists() else (0, 0)
        if not unwritten or due != expiredTimerInfo.getExpiryTimeInMs():
            return
        seen = self.seen.get()[0]
        self.unwritten.update((0, 0))
        yield self._frame([(key[0], "checkpoint", p.key, p.version, seen, self.cells.getValue((p.key,))[2]) for p in self.projections])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "kind", "key", "ver", "seq", "value"])

    def close(self) -> None:
        pass


def live(log: DataFrame, projections: list[Projection], initial: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """``session_id, kind, key, ver, seq, value``: changes of a stream of rows and, with a ``policy``, checkpoints.

    A change is the view of a projection after a row that gave a new state (a step
    says that nothing changed by returning the state it got); a checkpoint is the
    state of every projection after the last row.  Rows of a session may come in
    any number of batches and in any order within one; a row that comes again
    changes nothing, and a batch that leaves a hole is an error.

    ``initial`` are checkpoints of ``projections.fold`` (``session_id, key, ver,
    seq, val``) that a new query begins from; those of other projections are kept
    and not driven.  The session must use the RocksDB state store, which is set
    here where no other is.
    """
    spark = log.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(provider, None) or ""):
        spark.conf.set(provider, _ROCKS)
    rows = event_rows(log)
    held = None if initial is None else initial.select("session_id", "key", "ver", "seq", "val").groupBy("session_id")
    return rows.groupBy("session_id").transformWithStateInPandas(_Live(projections, policy), LIVE, "Append", "ProcessingTime" if policy else "None", held)


def stored_checkpoints(written: DataFrame) -> DataFrame:
    """The newest checkpoint of each session and projection, as ``projections.fold`` takes and gives them."""
    rows = written.where("kind = 'checkpoint'")
    return rows.groupBy("session_id", "key").agg(F.max_by(F.struct("ver", "seq", "value"), "seq").alias("c")).select("session_id", "key", "c.ver", "c.seq", F.col("c.value").alias("val"))
