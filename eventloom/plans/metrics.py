"""Usage, latency, grouping and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..schema import conversation_log, session_events, table
from . import query
from .search import _CONV, _LOG

# Rows of the test log as samples: a turn for every eight rows, steps by type.
_SAMPLES = f"(SELECT session_id, seq, seq // 8 AS turn, ascii(type) AS step, CAST(floor(value) AS BIGINT) AS input, CAST(floor(value * 2) AS BIGINT) AS output, CASE WHEN type = 'view' THEN seq END AS cache_read, CAST(NULL AS BIGINT) AS cache_write, CAST(1000 AS BIGINT) AS window_size FROM {_LOG})"


def _samples(spark, sf_dir):
    return session_events(spark, sf_dir).select(
        "session_id", "seq", F.floor(F.col("seq") / 8).alias("turn"), F.ascii("type").alias("step"), F.floor("value").alias("input"), F.floor(F.col("value") * 2).alias("output"),
        F.when(F.col("type") == "view", F.col("seq")).alias("cache_read"), F.lit(None).cast("bigint").alias("cache_write"), F.lit(1000).cast("bigint").alias("window"),
    )


@query(
    f"""SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read, CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write FROM (
        SELECT *, lead(turn) OVER w IS NOT DISTINCT FROM turn AND lead(step) OVER w IS NOT DISTINCT FROM step AS again FROM {_SAMPLES} WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE NOT again GROUP BY session_id"""
)
def usage_totals(spark, sf_dir):
    return m.usage_totals(_samples(spark, sf_dir))


@query(f"SELECT session_id, arg_max(coalesce(input, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0), seq) AS pressure, arg_max(window_size, seq) AS \"window\" FROM {_SAMPLES} GROUP BY session_id")
def context_pressure(spark, sf_dir):
    return m.context_pressure(_samples(spark, sf_dir))


_T = f"(SELECT *, seq // 8 AS turn FROM {_LOG})"


@query(f"SELECT session_id, turn, ascii(type) AS step, arg_min(time, seq) AS first_token FROM {_T} WHERE data <> '' GROUP BY ALL")
def first_tokens(spark, sf_dir):
    return m.first_tokens(session_events(spark, sf_dir).select("session_id", "seq", "time", F.floor(F.col("seq") / 8).alias("turn"), F.ascii("type").alias("step"), F.col("data").alias("text")))


_STEPS = f"""(SELECT session_id, seq // 8 AS turn, seq % 8 AS step, time AS start, time + CAST(floor(value * 10) AS BIGINT) AS first_token, time + CAST(floor(value * 30) AS BIGINT) AS "end", CAST(floor(value) AS BIGINT) AS output FROM {_LOG})"""


def _steps(spark, sf_dir):
    return session_events(spark, sf_dir).select(
        "session_id", "seq", F.floor(F.col("seq") / 8).alias("turn"), (F.col("seq") % 8).alias("step"), F.col("time").alias("start"),
        (F.col("time") + F.floor(F.col("value") * 10)).alias("first_token"), (F.col("time") + F.floor(F.col("value") * 30)).alias("end"), F.floor("value").alias("output"),
    )


@query(
    f"""SELECT session_id, turn, arg_min(first_token - start, step) AS ttft,
        round(sum(CASE WHEN output > 0 AND "end" > first_token THEN output END) / (sum(CASE WHEN output > 0 AND "end" > first_token THEN "end" - first_token END) / 1000), 6) AS tokens_per_second
        FROM {_STEPS} GROUP BY session_id, turn"""
)
def turn_metrics(spark, sf_dir):
    return m.turn_metrics(_steps(spark, sf_dir)).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


@query(
    f"""SELECT session_id, max(turn) + 1 AS turns, count(*) AS steps, CAST(sum("end" - start) AS BIGINT) AS llm_ms, CAST(sum(first_token - start) AS BIGINT) AS ttft_ms, count(*) AS ttft_steps,
        CAST(sum("end" - first_token) AS BIGINT) AS decode_ms, CAST(sum(output) AS BIGINT) AS decode_tokens, CAST(sum("end" - first_token) AS BIGINT) AS tool_ms FROM {_STEPS} GROUP BY session_id"""
)
def session_stats(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    tools = steps.select("session_id", (F.col("end") - F.col("first_token")).alias("duration"))
    return m.session_stats(steps, tools, steps.select("session_id", "seq", "turn"))


@query(
    f"""WITH u AS (SELECT session_id, sum(input) AS input, sum(coalesce(cache_read, 0)) AS cache_read FROM {_SAMPLES} GROUP BY session_id)
        SELECT session_id, CAST(input + cache_read AS BIGINT) AS billed_input, CAST(floor(100 * (cache_read / (input + cache_read)) + 0.5) AS BIGINT) AS cache_hit, CAST(least(floor(100 * ((input + cache_read) / 5000) + 0.5), 100) AS BIGINT) AS occupancy FROM u"""
)
def derived_ratios(spark, sf_dir):
    usage = _samples(spark, sf_dir).groupBy("session_id").agg(F.sum("input").alias("input"), F.sum(F.coalesce("cache_read", F.lit(0))).alias("cache_read"), F.lit(0).cast("bigint").alias("cache_write"))
    return m.ratios(usage, F.lit(5000)).select("session_id", "billed_input", "cache_hit", "occupancy")


@query(f"SELECT session_id, count(DISTINCT turn) AS turns, count(*) AS steps, CAST(sum(output) AS BIGINT) AS output FROM {_STEPS} GROUP BY session_id")
def window_stats(spark, sf_dir):
    return m.window_stats(_steps(spark, sf_dir))


@query(f"SELECT session_id, turn, min(start) AS start, max(\"end\") AS \"end\" FROM {_STEPS} GROUP BY session_id, turn")
def timeline_extent(spark, sf_dir):
    return m.extent(_steps(spark, sf_dir), "session_id", "turn")


@query(f"SELECT session_id, seq, delta FROM (SELECT session_id, seq, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY session_id ORDER BY seq), 0) AS delta FROM {_CONV})")
def token_deltas(spark, sf_dir):
    from pyspark.sql import Window

    rows = conversation_log(spark, sf_dir).withColumn("tokens", F.length("text").cast("bigint"))
    rows = rows.withColumn("replaced_tokens", F.lag("tokens").over(Window.partitionBy("session_id").orderBy("seq")))
    return m.token_deltas(rows).select("session_id", "seq", "delta")


@query("SELECT source AS path, min(doc_id) OVER (PARTITION BY source) AS first, count(*) OVER (PARTITION BY source) AS n, doc_id AS line, lang AS text FROM documents")
def group_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("position"), F.col("doc_id").alias("line"), F.col("lang").alias("text"))
    return m.grouped_matches(rows)


_HOOKS = f"(SELECT session_id AS event, seq AS position, CASE type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'ask' ELSE 'allow' END AS decision, data AS reason, CASE WHEN value > 60 THEN data END AS stop FROM {_LOG})"


@query(
    f"""WITH r AS (SELECT *, CASE decision WHEN 'deny' THEN 3 WHEN 'ask' THEN 2 ELSE 1 END AS rank FROM {_HOOKS}), t AS (SELECT *, max(rank) OVER (PARTITION BY event) AS top FROM r)
        SELECT event, max(CASE top WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' ELSE 'allow' END) AS decision, string_agg(reason, chr(10) ORDER BY position) FILTER (WHERE rank = top) AS reason, count(reason) FILTER (WHERE position % 3 = 0) AS contexts, arg_min(stop, position) FILTER (WHERE stop IS NOT NULL) AS stop FROM t GROUP BY event"""
)
def hook_merge(spark, sf_dir):
    return m.merge_hooks(_hooks(spark, sf_dir))


def _hooks(spark, sf_dir):
    log = session_events(spark, sf_dir)
    decision = F.when(F.col("type") == "error", "deny").when(F.col("type") == "signup", "ask").otherwise("allow")
    return log.select(F.col("session_id").alias("event"), F.col("seq").alias("position"), decision.alias("decision"), F.col("data").alias("reason"), F.when(F.col("value") > 60, F.col("data")).alias("stop"), F.when(F.col("seq") % 3 == 0, F.col("data")).alias("context"))


@query(
    f"""WITH r AS (SELECT *, CASE decision WHEN 'deny' THEN 3 WHEN 'ask' THEN 2 ELSE 1 END AS rank FROM {_HOOKS}), t AS (SELECT *, max(rank) OVER (PARTITION BY event) AS top FROM r)
        SELECT event, position, 'reason' AS kind, reason AS text FROM t WHERE rank = top AND reason IS NOT NULL UNION ALL SELECT event, position, 'context', reason FROM t WHERE position % 3 = 0 AND reason IS NOT NULL"""
)
def hook_texts(spark, sf_dir):
    """The reasons that won and all contexts, a row each."""
    return m.hook_texts(_hooks(spark, sf_dir))


@query("SELECT source AS \"case\", doc_id AS test FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def failed_tests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("case"), F.col("doc_id").alias("test"))
    marks = docs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "test"), "test").select("case", "test", F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("verdict"))
    return m.failures(docs, marks)


@query("SELECT source AS \"case\", count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed, bool_and(coalesce(quality = 1, false)) AS resolved FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def pass_fail_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("case"), F.col("doc_id").alias("test"))
    marks = docs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "test"), "test").select("case", "test", F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("verdict"))
    return m.pass_fail(docs, marks)


@query(f"SELECT session_id AS run, type AS phase, min(seq) AS first, count(*) AS agents, count(*) FILTER (WHERE value <= 10) AS running FROM {_LOG} GROUP BY session_id, type")
def workflow_phases(spark, sf_dir):
    log = session_events(spark, sf_dir)
    starts = log.select(F.col("session_id").alias("run"), "seq", F.col("type").alias("phase"), F.lit(False).alias("run_over"))
    ends = log.where("value > 10").select(F.col("session_id").alias("run"), "seq", F.lit("done").alias("outcome"))
    return m.phase_view(starts, ends)


@query(f"SELECT session_id, seq // 8 AS turn, type AS path, min(seq) AS seq FROM {_LOG} WHERE value > 5 AND seq <= 30 GROUP BY ALL")
def produced_files(spark, sf_dir):
    edits = session_events(spark, sf_dir).select("session_id", F.floor(F.col("seq") / 8).alias("turn"), "seq", (F.col("value") > 5).alias("ok"), F.array("type", "type").alias("paths"))
    return m.produced_files(edits, 30)
