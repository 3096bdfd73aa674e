"""A stored log that grows by whole batches.

Each append writes its rows to a folder of its own and then puts one commit that
names it.  Readers list folders by the last commit: a batch that failed shows no
row, and two writers from one revision can't both win.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import Conflict, commit_of, delete, put, revision

__all__ = ["AppendError", "Conflict", "append", "compact", "read", "revision", "sessions"]


class AppendError(ValueError):
    """Rows that don't follow the stored ones."""


def _parts(spark: SparkSession, folder: str, number: int | None, name: str) -> DataFrame | None:
    """One table of all batches, each row with its batch's number."""
    batches = commit_of(spark, folder, number).get("batches", [])
    tables = [spark.read.parquet(f"{folder}/{b['id']}/{name}").withColumn("_batch", F.lit(b["number"])) for b in batches if name != "cuts" or b["cut"]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def _uncut(rows: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Rows but those that a later batch has cut off."""
    if cuts is None:
        return rows
    later = cuts.select(F.col("session_id").alias("_session"), F.col("_batch").alias("_later"), F.col("from").alias("_from"))
    return rows.join(later, (F.col("session_id") == F.col("_session")) & (F.col("_later") > F.col("_batch")) & (F.col("seq") >= F.col("_from")), "left_anti")


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """All rows as of a revision, the last one by default; a filter on ``session_id`` and ``seq`` reaches the scan."""
    rows = _parts(spark, folder, number, "rows")
    if rows is None:
        raise FileNotFoundError(f"nothing is stored in {folder}")
    return _uncut(rows, _parts(spark, folder, number, "cuts")).drop("_batch")


def sessions(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """``session_id, created_at, end, revision, store`` of every session: a snapshot without reading the log.

    ``end`` is the last row's ``seq``.  ``revision`` counts the batches that
    changed the session, so it goes up with each append and repair and stays
    otherwise; ``store`` is the folder's own id, as revisions of two folders can't
    be compared.
    """
    store = commit_of(spark, folder, number).get("store")
    rows = _parts(spark, folder, number, "sessions")
    if rows is None:
        return spark.createDataFrame([], "session_id string, created_at bigint, end bigint, revision bigint, store string")
    known = rows.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max_by("last", "_batch").alias("end"), F.sum("changes").cast("bigint").alias("revision"))
    return known.withColumn("store", F.lit(store))


def append(log: DataFrame, folder: str, base: int | None = None, *, cuts: DataFrame | None = None, skip_known: bool = False, ledger: dict | None = None) -> int:
    """Add a batch of rows and return the new revision.

    ``log`` has ``session_id, seq, time`` and what else it likes.  Each session's
    rows must be numbered without holes from where its stored ones end; otherwise
    ``AppendError``, and nothing is there.  ``base`` is the revision that the caller
    has seen: ``Conflict`` where it isn't the last any more.  ``cuts`` (``session_id,
    from``) takes off what a crash has torn, in the same commit.  With
    ``skip_known`` rows that are stored already are left out instead.  ``ledger`` is
    merged into the commit, for whoever must know which batches are in.

    Rows go by ranges of session and ``seq``, so a session with most of the rows is
    in many files, and files have narrow ranges.  Checks and the summary are
    aggregates of the batch; nothing but one fault comes to the driver.
    """
    spark = log.sparkSession
    base = revision(spark, folder) if base is None else base
    held = commit_of(spark, folder, base)
    name = uuid.uuid4().hex
    number = max([b["number"] for b in held.get("batches", [])], default=0) + 1
    path = f"{folder}/{name}"
    ends = sessions(spark, folder, base).select("session_id", "end") if held else spark.createDataFrame([], "session_id string, end bigint")
    if cuts is not None:
        cuts = cuts.select(F.col("session_id").cast("string").alias("session_id"), F.col("from").cast("bigint").alias("from"))
        ends = ends.join(cuts, "session_id", "left").select("session_id", F.least("end", F.col("from") - 1).alias("end"))
    rows = log.withColumn("session_id", F.col("session_id").cast("string"))
    if skip_known:
        rows = rows.join(ends, "session_id", "left").where(F.col("seq") > F.coalesce("end", F.lit(-1))).drop("end")
    try:
        rows.repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").write.parquet(f"{path}/rows")
        written = spark.read.parquet(f"{path}/rows")
        new = written.groupBy("session_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("rows"), F.min("time").cast("bigint").alias("created_at"))
        if cuts is not None:
            cuts.write.parquet(f"{path}/cuts")
            gone = ends.join(cuts, "session_id", "left_semi").join(new, "session_id", "left_anti").select("session_id", F.lit(None).cast("bigint").alias("first"), F.col("end").alias("last"), F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("created_at"))
            new = new.unionByName(gone)
        new.withColumn("changes", F.lit(1)).write.parquet(f"{path}/sessions")
        added = spark.read.parquet(f"{path}/sessions")
        due = F.coalesce("end", F.lit(-1)) + 1
        wrong = added.where("rows > 0").join(ends, "session_id", "left").where((F.col("first") != due) | (F.col("last") - F.col("first") + 1 != F.col("rows"))).select("session_id", "first", due.alias("due")).first()
        if wrong is None:  # as many rows as numbers, but are they different ones?
            wrong = written.groupBy("session_id", "seq").count().where("count > 1").select("session_id", F.col("seq").alias("first"), (F.col("seq") + 1).alias("due")).first()
        if wrong is not None:
            raise AppendError(f"session {wrong['session_id']}: row {wrong['first']} where {wrong['due']} was due, or rows are missing")
        content = {"store": held.get("store") or uuid.uuid4().hex, "batches": [*held.get("batches", []), {"id": name, "number": number, "cut": cuts is not None}], "ledger": held.get("ledger", {}) | (ledger or {})}
        return put(spark, folder, base, content)
    except BaseException:
        delete(spark, path)
        raise


def compact(spark: SparkSession, folder: str) -> int:
    """Make one batch of all, so that a read lists one folder; rows, revisions and the ledger stay.

    Folders that no commit needs any more are the caller's to delete, when nobody
    reads old revisions.
    """
    base = revision(spark, folder)
    held = commit_of(spark, folder, base)
    name = uuid.uuid4().hex
    path = f"{folder}/{name}"
    try:
        read(spark, folder, base).repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").write.parquet(f"{path}/rows")
        sessions(spark, folder, base).select("session_id", F.lit(0).cast("bigint").alias("first"), F.col("end").alias("last"), (F.col("end") + 1).alias("rows"), "created_at", F.col("revision").cast("int").alias("changes")).write.parquet(f"{path}/sessions")
        number = max(b["number"] for b in held["batches"])
        return put(spark, folder, base, held | {"batches": [{"id": name, "number": number, "cut": False}]})
    except BaseException:
        delete(spark, path)
        raise
