"""Joins, overlays and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import traces as t
from ..schema import conversation_sessions, session_events, table
from . import query
from .search import _LOG

_S = "s AS (SELECT conv_id AS id, min(turn) AS created_at, count(*) AS events, CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent FROM conversations GROUP BY conv_id)"
_P = f"{_S}, p AS (SELECT s.id AS node, a.id AS ancestor, 1 AS depth FROM s JOIN s a ON s.parent = a.id UNION ALL SELECT p.node, a.id, p.depth + 1 FROM p JOIN s ON p.ancestor = s.id JOIN s a ON s.parent = a.id)"


@query("SELECT doc_id AS id, coalesce(a.quality, b.quality) AS quality, a.doc_id IS NOT NULL AS live, b.doc_id IS NOT NULL AS persisted FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) b USING (doc_id)")
def overlay_full_outer(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return j.overlay(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0"), immutable=["quality"])


@query("SELECT id, position, CASE WHEN doc_id IS NULL THEN 'rejected' ELSE 'fulfilled' END AS status FROM (SELECT doc_id * 2 AS id, doc_id AS position FROM documents) LEFT JOIN labels ON id = doc_id")
def batch_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("position"))
    return j.lookup(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), ids).select("id", "position", "status")


@query(f"WITH RECURSIVE {_P} SELECT ancestor, CAST(depth AS INTEGER) AS depth FROM p WHERE node = 45")
def ancestors(spark, sf_dir):
    return t.ancestors(conversation_sessions(spark, sf_dir), 45)


@query(f"WITH RECURSIVE {_P} SELECT s.id, s.parent, CAST(depth AS INTEGER) AS depth FROM p JOIN s ON s.id = p.node WHERE ancestor = 3")
def descendants(spark, sf_dir):
    return t.descendants(conversation_sessions(spark, sf_dir), 3).select("id", "parent", "depth")


@query(f"WITH RECURSIVE {_P} SELECT s.id, (SELECT count(*) FROM p WHERE ancestor = s.id) AS descendants, (SELECT count(*) FROM p JOIN s d ON d.id = p.node WHERE ancestor = s.id AND d.events > 4) AS running FROM s")
def descendant_rollup(spark, sf_dir):
    return t.rollup(conversation_sessions(spark, sf_dir), F.col("events") > 4)


@query(f"WITH {_S} SELECT id FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s)")
def lineage_roots(spark, sf_dir):
    return t.roots(conversation_sessions(spark, sf_dir)).select("id")


@query(f"WITH RECURSIVE {_P} SELECT s.id AS node, CAST(coalesce((SELECT max(depth) FROM p WHERE node = s.id), 0) AS INTEGER) AS layer FROM s")
def dependency_layers(spark, sf_dir):
    rows = conversation_sessions(spark, sf_dir)
    there = rows.select(F.col("id").alias("parent"))
    edges = rows.join(there, "parent", "left_semi").select(F.col("id").alias("node"), F.col("parent").alias("needs"))
    return t.layers(edges, rows.select(F.col("id").alias("node")))


@query(
    f"""WITH l AS (SELECT *, value > 25 AS is_call FROM {_LOG} WHERE type IN ('view', 'click')),
        b AS (SELECT *, lag(seq) OVER w AS call_seq, lag(time) OVER w AS call_time, lag(is_call) OVER w AS after_call FROM l WINDOW w AS (PARTITION BY session_id, type ORDER BY seq))
        SELECT session_id, type AS call_id, call_seq, seq AS result_seq, greatest(time - call_time, 0) AS duration FROM b WHERE NOT is_call AND after_call"""
)
def tool_pairing(spark, sf_dir):
    """Rows of one type stand for one call's id; high values are calls, others results."""
    log = session_events(spark, sf_dir).where(F.col("type").isin("view", "click")).select("session_id", F.lit(0).alias("turn"), F.col("type").alias("call_id"), "seq", "time", "value")
    return j.paired_calls(log.where("value > 25"), log.where("value <= 25")).select("session_id", "call_id", "call_seq", "result_seq", "duration")


@query("SELECT d.doc_id AS session_id, coalesce(b.text, 'untitled') AS title FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def title_attach(spark, sf_dir):
    titles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id"), F.col("text").alias("title"))
    return j.with_titles(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id")), titles)


@query("SELECT doc_id AS id, CAST(CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS INTEGER) AS source, coalesce(CAST(quality AS BIGINT), n_chars) AS rank FROM documents FULL JOIN labels USING (doc_id)")
def merge_first_wins(spark, sf_dir):
    """Labels before documents, each id once."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("rank"))
    return j.merge_results(labels, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank"))).select("id", "source", "rank")


@query("SELECT source, lang, min(doc_id) AS position FROM documents GROUP BY source, lang")
def stable_distinct(spark, sf_dir):
    return j.stable_distinct(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "position"), ["source", "lang"])


@query(
    """WITH p AS (SELECT DISTINCT lang || '/' || source || '/f' || (doc_id % 50) AS path FROM documents), b AS (SELECT string_split(path, '/')[-1] AS name, count(*) AS n, min(path) AS single FROM p GROUP BY 1)
        SELECT name, CASE WHEN n = 1 THEN single END AS path FROM b"""
)
def unique_basename(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    paths = docs.select(F.concat_ws("/", "lang", "source", F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))).alias("path"))
    names = paths.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    return j.by_path_or_name(names, paths).select("name", "path")


@query(f"WITH e AS (SELECT session_id, seq AS citing, unnest([seq - 1, seq - 2]) AS seq FROM {_LOG} WHERE seq % 3 = 2) SELECT session_id, seq, array_to_string(list_sort(list(DISTINCT citing)), ',') AS derived FROM e GROUP BY session_id, seq")
def derived_events(spark, sf_dir):
    cited = F.when(F.col("seq") % 3 == 2, F.array(F.col("seq") - 1, F.col("seq") - 2))
    found = t.derived(session_events(spark, sf_dir).withColumn("source_event_seqs", cited))
    return found.select("session_id", "seq", F.array_join(F.col("derived").cast("array<string>"), ",").alias("derived"))
