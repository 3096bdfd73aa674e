"""Schedules: what is due now, and when to look again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_occurrence, next_occurrence


def targets(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules (``id, kind, target, interval, position``) with ``due`` and the ``next`` target.

    One-shot schedules (``after``, ``at``) are due once their target is reached;
    fixed-rate ones (``every``) are due for the latest target they missed only.
    """
    every = F.col("kind") == "every"
    due = F.when(F.col("target") <= now, F.when(every, last_occurrence(F.col("target"), F.col("interval"), now)).otherwise(F.col("target")))
    following = F.when(every, F.when(F.col("target") <= now, next_occurrence(F.col("target"), F.col("interval"), now)).otherwise(F.col("target"))).otherwise(F.when(F.col("target") > now, F.col("target")))
    return schedules.withColumn("due", due).withColumn("next", following)


def dispatch(schedules: DataFrame, now: Column) -> DataFrame:
    """What to run: the first overdue one-shot alone, else every due fixed-rate schedule."""
    rows = targets(schedules, now).where("due is not null")
    shot = rows.where("kind <> 'every'").orderBy("target", "position").limit(1)
    first = shot.agg(F.count(F.lit(1)).alias("shots"))
    rates = rows.where("kind = 'every'").join(F.broadcast(first.where("shots = 0").select(F.lit("every").alias("kind"))), "kind", "left_semi")
    return shot.unionByName(rates).orderBy("due", "position")


def next_wake(schedules: DataFrame, now: Column) -> DataFrame:
    return targets(schedules, now).agg(F.min("next").alias("wake"))


def due_order(schedules: DataFrame) -> DataFrame:
    return schedules.orderBy("target", "position")
