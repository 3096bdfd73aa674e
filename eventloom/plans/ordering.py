"""Orders, limits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as o
from ..operators import sessions as n
from ..schema import conversation_log, table
from . import query
from .search import _CONV


@query("SELECT doc_id, source, omitted FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n, greatest(count(*) OVER (PARTITION BY lang, source) - 3, 0) AS omitted FROM documents) WHERE n <= 3")
def head_retention(spark, sf_dir):
    return o.head(table(spark, sf_dir, "documents"), ["lang", "source"], [F.col("doc_id")], 3).select("doc_id", "source", "omitted")


@query(
    """WITH m AS (SELECT doc_id AS position, list_distinct(string_split(lower(text), ' ')) AS keywords FROM documents)
        SELECT position, CAST(score AS INTEGER) AS score FROM (SELECT position, len(list_intersect(keywords, ['the', 'and', 'de'])) AS score FROM m) WHERE score > 0 ORDER BY score DESC, position LIMIT 25"""
)
def keyword_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("position"), F.array_distinct(F.split(F.lower("text"), " ")).alias("keywords"))
    return o.keyword_top_k(rows, ["The", "and", "de", "the"], 25).select("position", "score")


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
        SELECT doc_id, source FROM (SELECT * FROM r ORDER BY round, first LIMIT 50)"""
)
def stratified_sample(spark, sf_dir):
    """Fifty documents dealt out over sources: the sample is the operator."""
    return o.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source"), [F.col("doc_id")], 50).select("doc_id", "source")


@query("SELECT doc_id, text FROM documents WHERE (n_chars < 2000 OR (n_chars = 2000 AND doc_id > 100)) ORDER BY n_chars DESC, doc_id LIMIT 21")
def keyset_page(spark, sf_dir):
    """The rows of a page and the one that says there are more."""
    docs = table(spark, sf_dir, "documents")
    keys = [("n_chars", True), ("doc_id", False)]
    return docs.where(o.after(keys, [2000, 100])).orderBy(F.desc("n_chars"), "doc_id").limit(o.page_size(None) + 1).select("doc_id", "text")


@query("SELECT l.doc_id, d.doc_id AS position FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 3000) d USING (doc_id)")
def stored_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 3000").select("doc_id", F.col("doc_id").alias("position"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("changed"))
    return o.stored_order(rows, docs, "doc_id", "changed").select("doc_id", "position")


@query(rf"""WITH l AS (SELECT session_id, seq, string_split(text, chr(10)) AS l FROM {_CONV}) SELECT session_id, seq, array_to_string(list_filter(l[1:3], lambda x, i: list_sum(list_transform(l[1:i], lambda y: strlen(y) + 1)) <= 400), chr(10)) AS lines FROM l""")
def line_window(spark, sf_dir):
    return conversation_log(spark, sf_dir).select("session_id", "seq", F.array_join(o.line_window(F.col("text"), 0, 3, 400), "\n").alias("lines"))


@query(
    """WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id), m AS (SELECT *, l[conv_id % len(l) + 1] AS item, l[1] AS anchor FROM l), r AS (SELECT *, list_filter(l, lambda t: t <> item) AS rest FROM m)
        SELECT conv_id, array_to_string(CASE WHEN item = anchor THEN list_append(rest, item) ELSE list_prepend(item, rest) END, ',') AS items FROM r"""
)
def move_before(spark, sf_dir):
    """One turn of each conversation before its first; the first goes last."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("items"))
    item, first = F.element_at("items", (F.col("conv_id") % F.size("items") + 1).cast("int")), F.element_at("items", 1)
    moved = F.when(item == first, o.move_before(F.col("items"), item, None)).otherwise(o.move_before(F.col("items"), item, F.when(item != first, first).otherwise(F.element_at("items", -1))))
    return rows.select("conv_id", F.array_join(moved.cast("array<string>"), ",").alias("items"))


@query("SELECT conv_id AS id, max(turn) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, id LIMIT 20")
def recent_sessions(spark, sf_dir):
    """The twenty sessions with the latest change."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at"))
    return o.by_recency(rows).limit(20)


@query("SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS created_at FROM events ORDER BY created_at DESC, id LIMIT 20")
def newest_sessions(spark, sf_dir):
    """The twenty rows that were made last."""
    made = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return o.by_creation(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), made.alias("created_at"))).limit(20)


@query("SELECT event_id AS id, CASE WHEN value > 2 THEN event_id * 3 % 1009 END AS finished FROM events ORDER BY finished IS NULL DESC, CASE WHEN finished IS NULL THEN event_id END, finished DESC, event_id LIMIT 200")
def job_list(spark, sf_dir):
    """The first two hundred jobs: live ones by start, then those that ended last."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("started"), F.when(F.col("value") > 2, F.col("event_id") * 3 % 1009).alias("finished"))
    return n.job_order(jobs).select("id", "finished").limit(200)


@query("WITH c AS (SELECT conv_id, list(turn) AS l, max(turn) AS top FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_filter(range(0, top + 1), lambda t: NOT list_contains(l, t)), ',') AS missing FROM c")
def missing_turns(spark, sf_dir):
    """Turns that a conversation should have and hasn't."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("l"), F.max("turn").alias("top"))
    return rows.select("conv_id", F.array_join(F.array_except(F.sequence(F.lit(0).cast("bigint"), "top"), "l").cast("array<string>"), ",").alias("missing"))
