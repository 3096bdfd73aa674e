"""Filters and full-text search over documents and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import search as s
from ..schema import conversation_log, search_documents, session_events
from . import query

_DOCS = "(SELECT source AS session_id, doc_id AS seq, doc_id AS time, lang AS type, text FROM documents) d"
_LOG = "(SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS type, epoch_us(ts) // 1000 AS time, value, props AS data FROM events) e"
_CONV = "(SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN role = 'assistant' THEN 'assistant/message' ELSE 'user/message' END AS type, turn AS time, role, text FROM conversations) c"
_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
#: Spans of a phrase of two different words can't overlap.
_TWO = "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))"


@query(f"SELECT session_id, seq, type, time FROM {_LOG} WHERE type IN ('click', 'error') AND seq BETWEEN 2 AND 40 AND time >= 1704067200000.5")
def filter_conjunctive(spark, sf_dir):
    where = f.EventFilter(types=["click", "error"], seq=(2, 40), time=(1704067200000.5, None))
    return session_events(spark, sf_dir).where(where.column()).select("session_id", "seq", "type", "time")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 0 OR quality IS NULL")
def filter_nullable_list(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    joined = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return joined.where(f.one_of(F.col("quality"), [0, None])).select("doc_id", "quality")


@query(f"SELECT session_id, seq, type FROM {_LOG} WHERE false")
def filter_empty_list(spark, sf_dir):
    return session_events(spark, sf_dir).where(f.one_of(F.col("type"), [])).select("session_id", "seq", "type")


@query("WITH k AS (SELECT doc_id, doc_id % 3 <> 0 AS live, doc_id % 2 = 0 AS persisted FROM labels) SELECT doc_id FROM k WHERE live")
def filter_availability(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("doc_id") % 3 != 0).alias("live"), (F.col("doc_id") % 2 == 0).alias("persisted"))
    both = rows.where(f.available(F.col("live"), F.col("persisted"), ["live", "persisted"]))
    return both.where(f.available(F.col("live"), F.col("persisted"), ["live"])).select("doc_id")


@query(rf"SELECT session_id, seq FROM {_DOCS} WHERE regexp_matches(text, '(?i)of[\s\x{{00A0}}]+the')")
def text_literal_match(spark, sf_dir):
    return search_documents(spark, sf_dir).where(f.literal_text(F.col("text"), "  OF  the ")).select("session_id", "seq")


@query(f"SELECT session_id, seq FROM {_CONV} WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def filter_terms(spark, sf_dir):
    return conversation_log(spark, sf_dir).where(f.has_terms(F.col("text"), "The and")).select("session_id", "seq")


@query(f"SELECT type, count(*) AS n FROM {_LOG} WHERE type IN ('click', 'view') GROUP BY type")
def hook_matcher(spark, sf_dir):
    return session_events(spark, sf_dir).where(f.matches_hook(F.col("type"), "click|view")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT session_id, seq FROM {_LOG} WHERE time <= 1704200000000 AND time + 1000 * value >= 1704100000000")
def range_overlap(spark, sf_dir):
    log = session_events(spark, sf_dir)
    return log.where(f.overlaps(F.col("time"), F.col("time") + 1000 * F.col("value"), 1704100000000, 1704200000000)).select("session_id", "seq")


@query(f"SELECT session_id, seq, CAST({_TWO} AS INTEGER) AS spans, length(text) AS length FROM (SELECT *, {_TOKENS} AS t FROM {_DOCS}) WHERE {_TWO} > 0")
def phrase_search(spark, sf_dir):
    return s.matches(search_documents(spark, sf_dir), "of THE").select("session_id", "seq", "spans", F.col("length").cast("bigint").alias("length"))


@query(
    f"""SELECT session_id, seq, CAST(n AS INTEGER) AS spans FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, length(text), time DESC, seq) AS r
        FROM (SELECT *, {_TWO} AS n FROM (SELECT *, {_TOKENS} AS t FROM {_DOCS}) WHERE {_TWO} > 0)) WHERE r = 1"""
)
def best_match_per_session(spark, sf_dir):
    return s.best_sessions(search_documents(spark, sf_dir), "of the").select("session_id", "seq", "spans")


@query(
    f"""SELECT session_id, seq, CAST(n AS INTEGER) AS spans FROM (SELECT *, {_TWO} AS n FROM (SELECT *, {_TOKENS} AS t FROM {_DOCS} WHERE type IN ('en') AND seq >= 10) WHERE {_TWO} > 0)
        ORDER BY n DESC, length(text), time DESC, session_id, seq LIMIT 20"""
)
def search_events(spark, sf_dir):
    """The twenty strongest rows: a report of the top is what a page is."""
    found = s.matches(search_documents(spark, sf_dir), "of the", f.EventFilter(types=["en"], seq=(10, None)))
    return found.orderBy(F.desc("spans"), "length", F.desc("time"), "session_id", "seq").limit(20).select("session_id", "seq", "spans")
