"""Session lists: who may see what, candidates, exports, forks, incremental documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traces import _kept, descendants


def authorized(sessions: DataFrame, caller) -> DataFrame:
    """Sessions of the caller's folder; a caller without one sees itself only."""
    own = sessions.where(F.col("id") == caller).select(F.col("cwd").alias("_cwd")).limit(1)
    same = sessions.join(F.broadcast(own.where("_cwd is not null")), F.col("cwd") == F.col("_cwd"), "left_semi")
    return same.unionByName(sessions.where((F.col("id") == caller) & F.col("cwd").isNull()))


def visible(sessions: DataFrame, archived: DataFrame, current=None) -> DataFrame:
    """Sessions that aren't a subagent's, archived, or blank unless current."""
    rows = sessions.where(F.coalesce(F.col("origin") != "subagent", F.lit(True)))
    blank = F.col("events") == 0
    shown = rows.where(~blank | (F.col("id") == F.lit(current))) if current is not None else rows.where(~blank)
    return shown.join(archived.select("id"), "id", "left_anti")


def reference_candidates(sessions: DataFrame, caller, cwd: str | None, query: str, limit: int) -> DataFrame:
    """Other sessions whose id, folder or title holds the query: the same folder first, then none, then others."""
    text = F.lower(F.concat_ws("\n", "id", "cwd", "title"))
    place = F.when(F.col("cwd").eqNullSafe(F.lit(cwd)) & F.col("cwd").isNotNull(), 0).when(F.col("cwd").isNull(), 1).otherwise(2)
    return sessions.where((F.col("id") != caller) & F.contains(text, F.lit(query.lower()))).orderBy(place, F.desc("created_at"), "id").limit(limit)


def job_order(jobs: DataFrame) -> DataFrame:
    """Live jobs by start, then settled ones, the last to finish first."""
    live = F.col("finished").isNull()
    return jobs.orderBy(F.desc(live), F.when(live, F.col("started")), F.desc("finished"), "started")


def before_open_step(log: DataFrame, session_id) -> DataFrame:
    """A session's rows before its open step; all rows where no step is open."""
    own = log.where(F.col("session_id") == session_id)
    last = own.where(F.col("type").isin("step/start", "step/end")).groupBy("session_id").agg(F.max_by("type", "seq").alias("_last"), F.max("seq").alias("_seq"))
    return own.join(F.broadcast(last), "session_id", "left").where(F.coalesce(F.col("_last") != "step/start", F.lit(True)) | (F.col("seq") < F.col("_seq"))).drop("_last", "_seq")


def provider_in_force(log: DataFrame, header: Column) -> DataFrame:
    """The newest header of each session whose step is open at the end of its log."""
    rows = log.groupBy("session_id").agg(
        F.max_by(header, F.when(header.isNotNull(), F.col("seq"))).alias("header"),
        F.max_by("type", F.when(F.col("type").isin("step/start", "step/end"), F.col("seq"))).alias("last"),
    )
    return rows.where("last = 'step/start'").select("session_id", "header")


def export(sessions: DataFrame, log: DataFrame, media: DataFrame, root, with_descendants: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of a session, and of those under it, and the media they name, each once."""
    ids = sessions.where(F.col("id") == root).select(F.col("id").alias("session_id"))
    if with_descendants:
        ids = ids.unionByName(descendants(sessions, root).select(F.col("id").alias("session_id")))
    rows = log.join(ids, "session_id", "left_semi")
    return rows, media.join(rows.select(F.explode("media").alias("media_id")).distinct(), "media_id", "left_semi").dropDuplicates(["media_id"])


def telemetry(log: DataFrame, sent: DataFrame, redact: Sequence = ()) -> DataFrame:
    """Rows not sent yet (``session_id, cursor``), of chunks the first of a turn and step, through all redactions."""
    first = Window.partitionBy("session_id", "turn", "step").orderBy("seq")
    chunks = log.where("type = 'assistant/chunk'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = log.where("type <> 'assistant/chunk'").unionByName(chunks)
    rows = rows.join(sent, "session_id", "left").where(F.col("seq") > F.coalesce("cursor", F.lit(-1))).drop("cursor")
    data = F.col("data")
    for rule in redact:
        data = rule(data)
    return rows.withColumn("data", data)


def fork(log: DataFrame, session_id, child, at: int) -> DataFrame:
    """A log that begins with another's first rows; the cut must follow the end of a turn."""
    rows = log.where((F.col("session_id") == session_id) & (F.col("seq") < at))
    last = rows.groupBy("session_id").agg(F.max_by("type", "seq").alias("_last"))
    whole = F.when(F.col("_last") == "turn/end", F.lit(child)).otherwise(F.raise_error("a fork must follow the end of a turn"))
    return rows.join(F.broadcast(last), "session_id").withColumn("session_id", whole).drop("_last")


def fork_segments(sessions: DataFrame) -> DataFrame:
    """``session_id, source, low, high``: whose rows make up each session's log, ``low`` to before ``high`` (null: all).

    ``sessions``: ``id, parent, seed_length``.  A fork has its parent's first
    ``seed_length`` rows, which may be the grandparent's.  Links are doubled, so a
    line of d forks takes log d rounds; a parent that isn't there has no rows, and a
    cycle is an error.
    """
    # Null seeds are of sessions that are no forks.
    forks = sessions.select("id", F.when(F.coalesce("seed_length", F.lit(0)) > 0, F.col("parent")).alias("parent"), F.coalesce("seed_length", F.lit(0)).cast("bigint").alias("seed"))
    own = forks.select("id", F.col("seed").alias("low"))
    links = _kept(forks.where("parent is not null").select("id", F.col("parent").alias("jump"), F.col("seed").alias("cap")))
    found = _kept(own.select(F.col("id").alias("session_id"), F.col("id").alias("source"), F.lit(None).cast("bigint").alias("high")))
    rows, reach = links.count(), 1
    while links.count():
        if reach > rows:
            raise ValueError("the sessions form a cycle")
        further = found.join(links.withColumnRenamed("id", "source"), "source").select("session_id", F.col("jump").alias("source"), F.least("high", "cap").alias("high"))
        up = links.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("cap").alias("_cap"))
        found, links, reach = _kept(found.unionByName(further)), _kept(links.join(up, "jump").select("id", F.col("far").alias("jump"), F.least("cap", "_cap").alias("cap"))), 2 * reach
    return found.join(own.withColumnRenamed("id", "source"), "source").where("high is null or low < high").select("session_id", "source", "low", "high")


def forked_log(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """The log of every session, forks' shared rows included, with ``seed_length``; nothing is copied or stored.

    ``log`` has each session's own rows only, a fork's numbered from its
    ``seed_length`` on.  Folds leave out rows before it where a projection is of own
    rows.
    """
    seeds = sessions.select(F.col("id").alias("session_id"), F.coalesce("seed_length", F.lit(0)).cast("bigint").alias("seed_length"))
    parts = fork_segments(sessions)
    rows = log.withColumnRenamed("session_id", "source").join(parts, "source").where((F.col("seq") >= F.col("low")) & (F.col("high").isNull() | (F.col("seq") < F.col("high"))))
    return rows.join(seeds, "session_id").select("session_id", *(c for c in log.columns if c != "session_id"), "seed_length")


def reconcile(documents: DataFrame, indexed: DataFrame, sessions: DataFrame, revisions: DataFrame) -> DataFrame:
    """An index's documents after new or changed sessions replaced theirs.

    ``sessions``: ``session_id, revision`` now; ``revisions``: those indexed.
    Documents of sessions that are gone go, those of unchanged ones stay.
    """
    same = sessions.join(revisions, ["session_id", "revision"], "left_semi").select("session_id")
    changed = sessions.join(revisions, ["session_id", "revision"], "left_anti").select("session_id")
    return indexed.join(same, "session_id", "left_semi").unionByName(documents.join(changed, "session_id", "left_semi"))


def history_page(log: DataFrame, before: int, messages: int) -> DataFrame:
    """Of one session's log: rows of the last ``messages`` messages before a row, with all that belongs to them."""
    older = log.where(F.col("seq") < before)
    starts = older.where(F.col("type").isin("user/message", "assistant/message")).orderBy(F.desc("seq")).limit(messages)
    first = starts.groupBy("session_id").agg(F.min("seq").alias("_from"))
    return older.join(F.broadcast(first), "session_id").where(F.col("seq") >= F.col("_from")).drop("_from")


def byte_capped(groups: DataFrame, order: str, size: Column, most: int) -> DataFrame:
    """Groups in order up to ``most`` bytes, the first always; ``groups`` is one page, in one task."""
    rows = groups.withColumn("_total", F.sum(size).over(Window.orderBy(order)))
    return rows.where((F.col("_total") <= most) | (F.col("_total") == size)).drop("_total")


def spliced(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Keys of a new baseline: known ones in their order, new ones before the next known one.

    Both have ``key, position``.  A new key takes the place of the next known
    key after it in the baseline; those without one come last.  The lists are
    those of one page, in one task.
    """
    known = baseline.join(current.withColumnRenamed("position", "held"), "key", "left")
    ahead = Window.orderBy("position").rowsBetween(0, Window.unboundedFollowing)
    placed = known.withColumn("anchor", F.first("held", ignorenulls=True).over(ahead))
    return placed.orderBy(F.col("anchor").asc_nulls_last(), F.col("held").isNotNull(), "position").select("key")


def retained(messages: DataFrame, most: int) -> DataFrame:
    """Messages (``session_id, seq, checkpoint, text``) of each session within ``most`` bytes.

    The oldest go first, but for checkpoints and the newest message, until the
    rest fits; if it still doesn't, the longest are cut in the middle, the
    longest of all first.  Both steps are running sums.
    """
    from ..functions.pandas_text import column, ends

    whole = Window.partitionBy("session_id")
    before = Window.unboundedPreceding, -1
    rows = messages.withColumn("_bytes", F.octet_length("text").cast("bigint")).withColumn("_stays", F.coalesce("checkpoint", F.lit(False)) | (F.col("seq") == F.max("seq").over(whole)))
    older = F.coalesce(F.sum(F.when(~F.col("_stays"), F.col("_bytes"))).over(whole.orderBy("seq").rowsBetween(*before)), F.lit(0))
    rows = rows.withColumn("_over", F.sum("_bytes").over(whole) - most).withColumn("_older", older).where(F.col("_stays") | (F.col("_older") >= F.col("_over")))
    longer = F.coalesce(F.sum("_bytes").over(whole.orderBy(F.desc("_bytes"), "seq").rowsBetween(*before)), F.lit(0))
    left = F.col("_bytes") - F.greatest(F.sum("_bytes").over(whole) - most - longer, F.lit(0))
    kept = rows.withColumn("_left", F.greatest(left, F.lit(0)))
    short = F.when(F.col("_left") < F.col("_bytes"), F.concat_ws("\n", F.col("_left").cast("string"), "text"))
    return kept.withColumn("text", F.coalesce(column(ends, "string")(short), "text")).select(*messages.columns)
