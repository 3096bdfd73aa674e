"""Ordered state that windows and aggregates can express."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context(log: DataFrame, session_id, seq: int, before: int, after: int, limit: int = 50) -> DataFrame:
    """A row and its neighbours; ``seq`` is dense, so a range of it is a range of rows."""
    if not (0 <= before <= limit and 0 <= after <= limit):
        raise ValueError(f"at most {limit} rows on each side")
    return log.where((F.col("session_id") == session_id) & F.col("seq").between(seq - before, seq + after))


def latest(log: DataFrame, value: Column, where: Column, name: str = "value") -> DataFrame:
    """The last value written in each session; sessions without one are left out."""
    return log.where(where).groupBy("session_id").agg(F.max_by(value, "seq").alias(name), F.max("seq").alias("seq"))


def first_value(log: DataFrame, value: Column, where: Column, name: str = "value") -> DataFrame:
    """The first value written in each session."""
    return log.where(where).groupBy("session_id").agg(F.min_by(value, "seq").alias(name), F.min("seq").alias("seq"))


def latest_with_reset(log: DataFrame, value: Column, writes: Column, resets: Column, name: str = "value") -> DataFrame:
    """The last value of each session, null where a reset came after it."""
    last = F.max_by(F.struct(writes.alias("written"), value.alias("value")), "seq")
    rows = log.where(writes | resets).groupBy("session_id").agg(last.alias("last"))
    return rows.select("session_id", F.when(F.col("last.written"), F.col("last.value")).alias(name))


def pending(log: DataFrame, wanted: Column, active: Column, value: Column) -> DataFrame:
    """What was asked for and what is in force; pending where they differ and the request is newer."""
    rows = log.where(wanted | active).groupBy("session_id").agg(
        F.max_by(F.when(wanted, value), F.when(wanted, F.col("seq"))).alias("wanted"),
        F.max(F.when(wanted, F.col("seq"))).alias("wanted_seq"),
        F.max_by(F.when(active, value), F.when(active, F.col("seq"))).alias("active"),
        F.max(F.when(active, F.col("seq"))).alias("active_seq"),
    )
    newer = F.col("wanted_seq").isNotNull() & (F.coalesce(F.col("active_seq"), F.lit(-1)) < F.col("wanted_seq"))
    return rows.select("session_id", "wanted", "active", (newer & ~F.col("wanted").eqNullSafe(F.col("active"))).alias("pending"))


def running_balance(log: DataFrame, delta: Column, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The running sum of ``delta``, whether it is zero there, and whether it has been negative."""
    so_far = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("balance", F.sum(delta).over(so_far))
    return rows.withColumn("balanced", F.col("balance") == 0).withColumn("broken", F.min("balance").over(so_far) < 0)


def retention_cut(log: DataFrame, tokens: Column, budget: int, balanced: Column | None = None) -> DataFrame:
    """Where to cut each session so that the tail holds at least ``budget``.

    Going back from the end, ``cut`` is the first row whose tail reaches the
    budget, or the last balanced row before it; null where nothing would be left
    to drop.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("tail", F.sum(tokens).over(back))
    reached = rows.groupBy("session_id").agg(F.max(F.when(F.col("tail") >= budget, F.col("seq"))).alias("reached"))
    good = F.lit(True) if balanced is None else balanced
    joined = rows.join(reached, "session_id").groupBy("session_id").agg(F.max(F.when((F.col("seq") <= F.col("reached")) & good, F.col("seq"))).alias("cut"))
    return joined.withColumn("cut", F.when(F.col("cut") > 0, F.col("cut")))


def without_idle(spans: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Spans (``start, end``) moved together by the idle time before them (``idle``)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.withColumn("_gap", F.greatest(F.lit(0), F.coalesce(F.col("start") - reached, F.lit(0))))
    idle = gaps.withColumn("idle", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    return idle.withColumn("start_without_idle", F.col("start") - F.col("idle")).withColumn("end_without_idle", F.col("end") - F.col("idle"))


def timeline(log: DataFrame, turn: Column) -> DataFrame:
    """A running index for each row and the index at which its turn begins."""
    rows = log.withColumn("turn", turn).withColumn("index", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1)
    return rows.withColumn("turn_start", F.min("index").over(Window.partitionBy("session_id", "turn")))


def attach_to_next(log: DataFrame, visible: Column) -> DataFrame:
    """A group for each visible row and the invisible ones before it; the last group may have none."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("group", F.coalesce(F.sum(visible.cast("bigint")).over(before), F.lit(0)))


def islands(log: DataFrame, same: Sequence[Column], keys: Sequence[str] = ("session_id",), name: str = "island") -> DataFrame:
    """Numbers runs of consecutive rows that agree in all of ``same``."""
    order = Window.partitionBy(*keys).orderBy("seq")
    broken = F.lit(False)
    for column in same:
        broken = broken | ~column.eqNullSafe(F.lag(column).over(order))
    rows = log.withColumn("_new", F.when(F.lag("seq").over(order).isNull() | broken, 1).otherwise(0))
    return rows.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeated_calls(calls: DataFrame, call: Sequence[Column], thresholds: Sequence[int]) -> DataFrame:
    """Rows at which a run of the same call reaches one of the thresholds."""
    rows = islands(calls, call)
    n = F.row_number().over(Window.partitionBy("session_id", "island").orderBy("seq"))
    return rows.withColumn("repeats", n).where(F.col("repeats").isin(*thresholds)).drop("island")


def located(log: DataFrame, turn: Column, step: Column) -> DataFrame:
    """Each row's turn and step: its own, or those in force; a new turn ends the step."""
    so_far = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("at_turn", F.last(turn, ignorenulls=True).over(so_far))
    in_turn = Window.partitionBy("session_id", "at_turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("at_step", F.when(F.col("at_turn").isNotNull(), F.last(step, ignorenulls=True).over(in_turn)))


def timed_spans(cells: DataFrame, mode: str) -> DataFrame:
    """Spans of cells (``start, duration``): ``time`` marks starts, ``actual`` spans, ``duration`` spans without idle time."""
    if mode not in ("time", "actual", "duration"):
        raise ValueError(f"unknown mode {mode}")
    end = F.col("start") + F.greatest(F.coalesce("duration", F.lit(0)), F.lit(0))
    spans = cells.where("start is not null").withColumn("end", end if mode != "time" else F.col("start"))
    if mode != "duration":
        return spans
    moved = without_idle(spans)
    return moved.withColumns({"start": F.col("start_without_idle"), "end": F.col("end_without_idle")}).drop("idle", "start_without_idle", "end_without_idle")
