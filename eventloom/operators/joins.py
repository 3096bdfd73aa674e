"""Joins and set operations of the log model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(live: DataFrame, persisted: DataFrame, key: str = "id", immutable: Sequence[str] = ()) -> DataFrame:
    """All sessions, live headers before persisted ones, with flags ``live`` and ``persisted``.

    Columns in ``immutable`` must agree where a session is in both.
    """
    columns = [c for c in live.columns if c != key]
    a = live.select(key, F.struct(*columns).alias("_live"))
    b = persisted.select(key, F.struct(*columns).alias("_kept"))
    both = a.join(b, key, "full_outer")
    in_both = F.col("_live").isNotNull() & F.col("_kept").isNotNull()
    same = F.lit(True)
    for c in immutable:
        same = same & F.col(f"_live.{c}").eqNullSafe(F.col(f"_kept.{c}"))
    row = F.when(in_both & ~same, F.raise_error("a session's headers differ")).otherwise(F.coalesce("_live", "_kept")) if immutable else F.coalesce("_live", "_kept")
    return both.select(key, row.alias("_row"), F.col("_live").isNotNull().alias("live"), F.col("_kept").isNotNull().alias("persisted")).select(key, *(F.col(f"_row.{c}").alias(c) for c in columns), "live", "persisted")


def lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The wanted rows (``id, position``), each once at its first place, with a status."""
    wanted = ids.groupBy(key).agg(F.min("position").alias("position"))
    found = rows.withColumn("_found", F.lit(True))
    return wanted.join(found, key, "left").withColumn("status", F.when(F.col("_found"), "fulfilled").otherwise("rejected")).drop("_found")


def paired_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each result with the last earlier call of its id in the same turn.

    ``calls, results``: ``session_id, turn, call_id, seq, time``.  A call matches
    one result, its first; what has no partner is left out; a negative duration
    counts as none.
    """
    keys = ["session_id", "turn", "call_id"]
    both = calls.select(*keys, "seq", "time", F.lit(True).alias("is_call")).unionByName(results.select(*keys, "seq", "time", F.lit(False).alias("is_call")))
    order = Window.partitionBy(*keys).orderBy("seq")
    # A result pairs with the row before it if that is a call.
    rows = both.withColumn("call_seq", F.lag("seq").over(order)).withColumn("call_time", F.lag("time").over(order)).withColumn("after_call", F.lag("is_call").over(order))
    return rows.where(~F.col("is_call") & F.col("after_call")).select(*keys, "call_seq", F.col("seq").alias("result_seq"), F.greatest(F.col("time") - F.col("call_time"), F.lit(0)).alias("duration"))


def in_force(log: DataFrame, value: Column, name: str) -> DataFrame:
    """The last value at or before each row: an as-of join of a log with itself."""
    so_far = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(name, F.last(value, ignorenulls=True).over(so_far))


def group_members(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the group and place of their id; strays are in the group "ungrouped", last."""
    joined = rows.join(ids, key, "left")
    return joined.withColumn("group", F.coalesce("group", F.lit("ungrouped")))


def with_titles(rows: DataFrame, titles: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.join(titles.select(key, "title"), key, "left").withColumn("title", F.coalesce("title", F.lit("untitled")))


def merge_results(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, those of the first before those of the second, each key once."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)), allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("source", "rank")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def by_path_or_name(names: DataFrame, paths: DataFrame) -> DataFrame:
    """The path that a name means: itself, or the only path that ends in it."""
    exact = paths.select(F.col("path").alias("name"), F.col("path").alias("_exact")).distinct()
    base = paths.select("path").distinct().groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only"))
    joined = names.join(exact, "name", "left").join(base, "name", "left")
    return joined.withColumn("path", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only")))).drop("_exact", "_n", "_only")


def stable_distinct(df: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """The keys, each once, at its first position."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def no_duplicates(items: Column, what: str) -> Column:
    """The array, or an error if an element repeats."""
    return F.when(F.size(items) == F.size(F.array_distinct(items)), items).otherwise(F.raise_error(f"{what} repeats"))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with ``n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_rows(rows: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows, or an error if keys repeat: equal keys meet, whole groups don't."""
    repeated = duplicates(rows, keys).select(*keys, F.raise_error(F.lit(f"{what} repeats")).cast("boolean").alias("_fault"))
    return rows.join(repeated, list(keys), "left").where("_fault is null").drop("_fault")


def last_write(changes: DataFrame, keys: Sequence[str] = ("table", "key")) -> DataFrame:
    """A key-value table from its changes (``table, key, version, value``); a null value deletes."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("value", "version"), "version").alias("last"))
    return last.where("last.value is not null").select(*keys, "last.value", "last.version")


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("table", "key")) -> DataFrame:
    """What a write changed in a key-value table: ``keys, change`` (put or deleted), ``value, version``.

    A put is a key that is new or has another version; an unchanged key gives no row.
    """
    old = before.select(*keys, F.col("version").alias("_version"))
    both = after.withColumn("_there", F.lit(True)).join(old.withColumn("_was", F.lit(True)), list(keys), "full_outer")
    change = F.when(F.col("_there").isNull(), "deleted").when(F.col("_was").isNull() | ~F.col("version").eqNullSafe(F.col("_version")), "put")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "value", "version")
