"""Queries over what the library itself stores: an index that is kept up, logs that grow by batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..folders import new_folder
from ..operators import index, surface
from ..schema import search_documents, session_events, store_log, stored_session, table
from ..sources import appends, jsonl
from . import query
from .search import _DOCS, _LOG, _TOKENS, _TWO


@query(f"SELECT session_id, seq, CAST({_TWO} AS INTEGER) AS spans, length(text) AS length FROM (SELECT *, {_TOKENS} AS t FROM {_DOCS}) WHERE {_TWO} > 0")
def indexed_phrase_search(spark, sf_dir):
    """The phrase search, from the postings of its two words."""
    docs, folder = search_documents(spark, sf_dir), new_folder(spark, "index")
    index.reconcile(docs, folder, docs.select("session_id").distinct().withColumn("revision", F.lit(1)))
    return index.matches(spark, folder, "of THE").select("session_id", "seq", "spans", "length")


@query(
    f"""WITH d AS (SELECT doc_id AS session_id, 0 AS seq, CASE WHEN doc_id % 100 = 0 THEN text || ' of the' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 1)
        SELECT session_id, CAST({_TWO} AS INTEGER) AS spans, length(text) AS length FROM (SELECT *, {_TOKENS} AS t FROM d) WHERE {_TWO} > 0"""
)
def reconciled_index(spark, sf_dir):
    """A session a document; then of each hundred one changes and one goes, and only the changed are indexed again."""
    docs, folder = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.lit(0).alias("seq"), F.col("doc_id").alias("time"), "text"), new_folder(spark, "index")
    index.reconcile(docs, folder, docs.select("session_id", F.lit(1).alias("revision")))
    changed = F.col("session_id") % 100 == 0
    now = docs.where("session_id % 100 <> 1").withColumn("text", F.when(changed, F.concat("text", F.lit(" of the"))).otherwise(F.col("text")))
    index.reconcile(now, folder, now.select("session_id", F.when(changed, 2).otherwise(1).alias("revision")))
    return index.matches(spark, folder, "of the").select("session_id", "spans", "length")


def _in_batches(spark, sf_dir):
    """The test log, appended in three batches of each session's rows."""
    log, folder = session_events(spark, sf_dir).drop("value"), new_folder(spark, "log")
    for low, high in ((0, 4), (5, 19), (20, 2**31)):
        appends.append(log.where(F.col("seq").between(low, high)), folder)
    return folder


@query(f"SELECT session_id, min(time) AS created_at, max(seq) AS \"end\", CAST(1 + (max(seq) >= 5)::INT + (max(seq) >= 20)::INT AS BIGINT) AS revision FROM {_LOG} GROUP BY session_id")
def appended_sessions(spark, sf_dir):
    """Snapshots of sessions with revisions that count the batches that changed them."""
    return appends.sessions(spark, _in_batches(spark, sf_dir)).drop("store")


@query(
    f"""WITH e AS (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_LOG})
        SELECT session_id, seq, type, time FROM e WHERE seq < 30 UNION ALL SELECT DISTINCT session_id, 30, 'turn/end', 0 FROM e WHERE last >= 30"""
)
def repaired_log(spark, sf_dir):
    """What follows row 30 was torn: one commit takes it off and closes the turn."""
    folder = _in_batches(spark, sf_dir)
    torn = appends.sessions(spark, folder).where(F.col("end") >= 30).select("session_id", F.lit(30).cast("bigint").alias("from"))
    closers = torn.select("session_id", F.col("from").alias("seq"), F.lit("turn/end").alias("type"), F.lit(0).cast("bigint").alias("time"), F.lit(None).cast("string").alias("data"))
    appends.append(closers, folder, cuts=torn)
    return appends.read(spark, folder).select("session_id", "seq", "type", "time")


@query(f"SELECT session_id, seq, type, time FROM {_LOG}")
def written_log(spark, sf_dir):
    """The test log as files of JSON lines, of many sessions each, and read again by line."""
    log, folder = session_events(spark, sf_dir), new_folder(spark, "lines")
    # A session's first row has its least time; for that nothing need be numbered.
    heads = log.groupBy(F.col("session_id").alias("id")).agg(F.min("time").alias("created_at"))
    jsonl.write(heads, log.select("session_id", "seq", "type", "time", F.to_json(F.struct(F.col("data").alias("text"))).alias("data")), folder)
    lines = jsonl.log_lines(spark, folder)
    names = jsonl.headers(lines).select("path", F.col("id").alias("session_id"))
    return jsonl.events(lines).join(names, "path").select("session_id", "seq", "type", "time")


@query(f"SELECT seq, type, time FROM {_LOG} WHERE session_id = '7' AND seq >= 3")
def stored_session_tail(spark, sf_dir):
    """One session's later rows, from its bucket of a stored log."""
    folder = new_folder(spark, "stored")
    store_log(session_events(spark, sf_dir).drop("value"), folder, 5000)
    return stored_session(spark, folder, "7").where("seq >= 3").select("seq", "type", "time")


@query(
    """WITH e AS (SELECT event_id AS seq, event_id // 50 * 50 + 49 AS heir, max(event_id) OVER () AS top FROM events), f AS (SELECT seq, CASE WHEN seq % 50 < 49 AND heir <= top THEN heir END AS replaced_by FROM e)
        SELECT seq, CASE WHEN replaced_by IS NULL THEN 'current' ELSE 'shadowed' END AS surface, CASE WHEN replaced_by IS NULL THEN row_number() OVER (PARTITION BY replaced_by IS NULL ORDER BY seq) - 1 END AS position, replaced_by FROM f"""
)
def long_surface(spark, sf_dir):
    """All events as one session, of which every fiftieth row replaces those since the last such: folded in blocks."""
    seq = F.col("event_id")
    replaces = seq % 50 == 49
    op = F.when(replaces, F.struct(F.lit("replace").alias("op"), (seq - 49).alias("start"), (seq - 1).alias("end"))).otherwise(F.struct(F.lit("append").alias("op"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end")))
    sources = F.when(replaces, F.sequence(seq - 49, seq - 1)).otherwise(F.array().cast("array<bigint>"))
    log = table(spark, sf_dir, "events").select(F.lit("all").alias("session_id"), seq.alias("seq"), F.lit("user/message").alias("type"), op.alias("surface_op"), sources.alias("source_event_seqs"))
    return surface.fold(log, block_rows=500).drop("session_id", "error")
