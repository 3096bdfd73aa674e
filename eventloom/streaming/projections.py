"""Projections: folds with a versioned state, over stored logs or as they grow.

A projection is ``init()``, ``apply(state, event)`` and ``view(state)`` over plain
JSON values.  The same functions run in a batch and in a stream, where the state
of each session and projection remembers the last row it has seen: a row that
comes again changes nothing, a row that comes too early is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import by_session


@dataclass(frozen=True)
class Projection:
    key: str
    version: int
    init: Callable[[], Any]
    apply: Callable[[Any, dict], Any]
    view: Callable[[Any], Any] = lambda state: state
    #: A fork's first ``seed_length`` rows are its parent's: such a projection passes over them.
    own: bool = False


class Registry:
    """Projections by key; one key can't have two versions, and counts who uses it."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[Projection, int]] = {}

    def register(self, projection: Projection) -> Callable[[], None]:
        held = self._held.get(projection.key)
        if held and held[0].version != projection.version:
            raise ValueError(f"{projection.key} is registered with version {held[0].version}")
        self._held[projection.key] = (held[0] if held else projection, held[1] + 1 if held else 1)
        done = False

        def release() -> None:
            nonlocal done
            if not done:
                done = True
                unit, users = self._held[projection.key]
                self._held.pop(projection.key)
                if users > 1:
                    self._held[projection.key] = (unit, users - 1)

        return release

    def all(self) -> list[Projection]:
        return [p for p, _ in self._held.values()]


CHECKPOINT = "session_id string, key string, ver int, seq bigint, val string"
CHANGE = "session_id string, key string, seq bigint, value string"
_EVENT = ["session_id", "seq", "type", "time", "data", "seed_length"]


def event_rows(log: DataFrame) -> DataFrame:
    """What folds read of a log; without ``seed_length`` no session is a fork."""
    seed = F.coalesce(F.col("seed_length").cast("bigint"), F.lit(0)) if "seed_length" in log.columns else F.lit(0).cast("bigint")
    return log.select(F.col("session_id").cast("string").alias("session_id"), *_EVENT[1:5], seed.alias("seed_length"))


def _step(projections: list[Projection], states: dict[str, tuple[int, Any]], event: dict) -> None:
    """Apply one event where it is due."""
    for p in projections:
        seen, state = states[p.key]
        if event["seq"] <= seen:
            continue
        if event["seq"] != seen + 1:
            raise ValueError(f"session {event['session_id']}: row {event['seq']} after {seen}")
        states[p.key] = (event["seq"], state if p.own and event["seq"] < event["seed_length"] else p.apply(state, event))


_HELD = "array<struct<key: string, seq: bigint, val: string>>"


def _usable(checkpoints: DataFrame, versions: dict[str, int]) -> DataFrame:
    """The checkpoints of current versions."""
    test = F.lit(False)
    for key, version in versions.items():
        test = test | ((F.col("key") == key) & (F.col("ver") == version))
    return checkpoints.where(test)


def _unread(rows: DataFrame, checkpoints: DataFrame, ends: DataFrame, versions: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """What must be folded yet, with the states to go on from, and the checkpoints that hold already."""
    known = _usable(checkpoints, versions).join(ends, "session_id").where("seq <= end")
    held = known.groupBy("session_id", "end").agg(F.collect_list(F.struct("key", "seq", "val")).alias("held"), F.min("seq").alias("floor"), F.count(F.lit(1)).alias("n"))
    whole = held.where(F.col("n") == len(versions))
    least = whole.where("floor < end").agg(F.min("floor")).first()[0]
    # A number, so that the scan itself leaves out what is older.
    later = rows.where(F.col("seq") > (least if least is not None else F.lit(2**62))).join(whole.where("floor < end").select("session_id", "held", "floor"), "session_id").where("seq > floor").drop("floor")
    done = whole.where("floor = end").select("session_id", F.explode("held").alias("c")).select("session_id", "c.key", "c.seq", "c.val")
    fresh = ends.join(whole, "session_id", "left_anti").select("session_id").join(held.select("session_id", "held"), "session_id", "left")
    if fresh.isEmpty():
        return later, done
    return later.unionByName(rows.join(fresh, "session_id")), done


def fold(log: DataFrame, projections: list[Projection], checkpoints: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Checkpoints (``session_id, key, ver, seq, val``) after all rows of the log.

    With earlier ``checkpoints`` only the rows after the least usable one are
    folded for each session, and rows before the least of all are not read; a
    checkpoint of another version, or one beyond the log's end, isn't usable and
    its projection is folded from the start.  ``ends`` (``session_id, end``)
    says where the logs end; without it two columns of the log are read for it.
    """
    rows = event_rows(log)
    versions = {p.key: p.version for p in projections}
    done = None
    if checkpoints is not None:
        ends = rows.groupBy("session_id").agg(F.max("seq").alias("end")) if ends is None else ends.select(F.col("session_id").cast("string").alias("session_id"), "end")
        rows, done = _unread(rows, checkpoints, ends, versions)
    else:
        rows = rows.withColumn("held", F.lit(None).cast(_HELD))

    def run(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = None
        for batch in batches:
            if states is None:
                states = {p.key: (-1, p.init()) for p in projections}
                for c in batch.column("held")[0].as_py() or []:
                    states[c["key"]] = (int(c["seq"]), json.loads(c["val"]))
            for event in batch.select(_EVENT).to_pylist():
                _step(projections, states, event)
        rows = [(name, p.key, p.version, states[p.key][0], json.dumps(states[p.key][1])) for p in projections]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["session_id", "key", "ver", "seq", "val"])

    folded = by_session(rows, run, CHECKPOINT)
    if done is None:
        return folded
    number = F.coalesce(*(F.when(F.col("key") == key, version) for key, version in versions.items())).cast("int")
    return folded.unionByName(done.select("session_id", "key", number.alias("ver"), "seq", "val"))


def drive(log: DataFrame, projections: list[Projection], initial: DataFrame | None = None) -> DataFrame:
    """A stream of changes (``session_id, key, seq, value``) from a stream of rows: see ``live.live``."""
    from .live import live

    return live(log, projections, initial).where("kind = 'change'").select("session_id", "key", "seq", "value")


def latest_values(changes: DataFrame) -> DataFrame:
    """The newest value of each session and projection; older frames that come late are dropped."""
    return changes.groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def restore_floor(versions: dict[str, int], checkpoints: dict[str, tuple[int, int]]) -> int | None:
    """From which row a session must be read again: None without projections, 0 if any has no usable state."""
    if not versions:
        return None
    usable = [seq for key, version in versions.items() for ver, seq in [checkpoints.get(key, (-1, -1))] if ver == version and seq >= 0]
    return min(usable) if len(usable) == len(versions) else 0


def stale_view(checkpoints: DataFrame, versions: dict[str, int]) -> DataFrame:
    """What stored states show without the log: those of current versions, and the row they all include."""
    good = _usable(checkpoints, versions)
    return good.groupBy("session_id").agg(F.min("seq").alias("as_of"), F.map_from_entries(F.collect_list(F.struct("key", "val"))).alias("values"))


def same_lifecycle(checkpoints: DataFrame, sessions: DataFrame) -> DataFrame:
    """Checkpoints of the sessions they were written for: created at the same time, in the same folder."""
    now = sessions.select(F.col("id").cast("string").alias("session_id"), F.col("created_at").alias("_at"), F.col("cwd").alias("_cwd"))
    return checkpoints.join(now, "session_id").where((F.col("created_at") == F.col("_at")) & F.col("cwd").eqNullSafe(F.col("_cwd"))).drop("_at", "_cwd")


def snapshot(changes: DataFrame, as_of: int) -> DataFrame:
    """All values of each session as they were after one row."""
    return latest_values(changes.where(F.col("seq") <= as_of)).withColumn("as_of", F.lit(as_of).cast("bigint"))
