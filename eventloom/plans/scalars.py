"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..schema import conversation_log, session_events, table
from . import query
from .search import _CONV, _LOG

_UTF16 = "(len(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')))"


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:6], ' ') AS title FROM documents")
def title_clean(spark, sf_dir):
    dressed = F.concat(F.lit("\x1b]0;stolen\x07\x1b[31m  "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", x.first_words(x.clean_title(dressed), 6).alias("title"))


@query(f"SELECT session_id, seq, CAST(ceil({_UTF16} / 4) + 4 AS BIGINT) AS tokens FROM {_CONV}")
def token_estimate(spark, sf_dir):
    return conversation_log(spark, sf_dir).select("session_id", "seq", x.text_tokens(F.col("text")).alias("tokens"))


@query("SELECT item_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM benchmark")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", x.csv_field(F.col("text")).alias("field"))


@query("SELECT doc_id, left(text, 100) || CASE WHEN length(text) > 150 THEN chr(10) || '[... ' || (length(text) - 150) || ' characters pruned]' || chr(10) || right(text, 50) ELSE substr(text, 101) END AS text FROM documents")
def prune_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.prune_middle(F.col("text"), 100, 50).alias("text"))


@query(
    f"""SELECT session_id, seq, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 2592000 THEN (s // 86400) || 'd' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS ago
        FROM (SELECT session_id, seq, (1711929600000 - time) // 1000 AS s FROM {_LOG})"""
)
def relative_time(spark, sf_dir):
    return session_events(spark, sf_dir).select("session_id", "seq", x.relative_time(F.col("time"), F.lit(1711929600000)).alias("ago"))


@query(
    f"""SELECT session_id, seq, CASE WHEN ms < 60000 THEN (t // 10) || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || (t % 10) END || 's' ELSE (s // 60) || 'm' || (s % 60) || 's' END AS shown
        FROM (SELECT *, (ms + 50) // 100 AS t, (ms + 500) // 1000 AS s FROM (SELECT session_id, seq, CAST(floor(value * 3000) AS BIGINT) AS ms FROM {_LOG}))"""
)
def duration_format(spark, sf_dir):
    return session_events(spark, sf_dir).select("session_id", "seq", x.duration(F.floor(F.col("value") * 3000)).alias("shown"))


_TENTHS = "((({n}) // 10) || CASE WHEN ({n}) % 10 = 0 THEN '' ELSE '.' || (({n}) % 10) END)"


@query(
    f"""SELECT session_id, seq, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 100000 THEN {_TENTHS.format(n="(n * 10 + 500) // 1000")} || 'K' WHEN n < 1000000 THEN ((n + 500) // 1000) || 'K'
        WHEN n < 100000000 THEN {_TENTHS.format(n="(n * 10 + 500000) // 1000000")} || 'M' ELSE ((n + 500000) // 1000000) || 'M' END AS shown
        FROM (SELECT session_id, seq, CAST(floor(value * value * value * 400) AS BIGINT) AS n FROM {_LOG})"""
)
def token_format(spark, sf_dir):
    n = F.floor(F.col("value") * F.col("value") * F.col("value") * 400)
    return session_events(spark, sf_dir).select("session_id", "seq", x.token_count(n).alias("shown"))


@query(f"SELECT session_id, seq, CAST(CASE WHEN time >= 1704100000000 THEN 1704100000000 + (time - 1704100000000) // 300000 * 300000 END AS BIGINT) AS latest, CAST(CASE WHEN time < 1704100000000 THEN 1704100000000 ELSE 1704100000000 + ((time - 1704100000000) // 300000 + 1) * 300000 END AS BIGINT) AS following FROM {_LOG}")
def recurrence(spark, sf_dir):
    anchor, step = F.lit(1704100000000).cast("bigint"), F.lit(300000).cast("bigint")
    log = session_events(spark, sf_dir)
    return log.select("session_id", "seq", x.last_occurrence(anchor, step, F.col("time")).alias("latest"), x.next_occurrence(anchor, step, F.col("time")).alias("following"))


@query("SELECT doc_id, left(sha256(source), 16) AS key, replace(replace(replace(text, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS safe FROM documents")
def keys_and_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.workspace_key(F.col("source")).alias("key"), x.tag_safe(F.col("text")).alias("safe"))


@query(f"SELECT session_id, seq, least(500 * pow(2, seq % 8), 10000) AS wait, round(least(500 * pow(2, seq % 8), 10000) * (0.9 + 0.2 * (seq % 5) / 4), 6) AS jittered FROM {_LOG}")
def retry_backoff(spark, sf_dir):
    wait = x.backoff(F.col("seq") % 8)
    return session_events(spark, sf_dir).select("session_id", "seq", wait.alias("wait"), F.round(x.jittered(wait, F.col("seq") % 5 / 4), 6).alias("jittered"))


@query("SELECT lang, count(*) AS seen, least(count(*), 100) AS kept, greatest(count(*) - 100, 0) AS omitted, count(*) > 100 AS truncated FROM documents GROUP BY lang")
def retained_accounting(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", x.retained(F.col("n"), 100).alias("r")).select("lang", "r.*")
