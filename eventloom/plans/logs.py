"""Windows, ordered state and codecs over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pandas_text as p
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import sessions as n
from ..operators import surface, traces
from ..operators import windows as w
from ..schema import conversation_log, session_events, table
from ..sources import jsonl, tables
from ..streaming import projections, schedules
from . import query
from .search import _CONV, _LOG


@query(f"SELECT session_id, seq, type FROM {_LOG} WHERE session_id = '7' AND seq BETWEEN 8 AND 15")
def event_window(spark, sf_dir):
    return w.context(session_events(spark, sf_dir), "7", 10, 2, 5).select("session_id", "seq", "type")


@query(f"SELECT session_id, arg_max(value, seq) AS value, max(seq) AS seq FROM {_LOG} WHERE type = 'purchase' GROUP BY session_id")
def latest_value(spark, sf_dir):
    return w.latest(session_events(spark, sf_dir), F.col("value"), F.col("type") == "purchase")


@query(f"SELECT session_id, arg_min(data, seq) AS value, min(seq) AS seq FROM {_LOG} WHERE type = 'view' GROUP BY session_id")
def first_value(spark, sf_dir):
    return w.first_value(session_events(spark, sf_dir), F.col("data"), F.col("type") == "view")


@query(f"SELECT session_id, CASE WHEN arg_max(type, seq) = 'click' THEN arg_max(value, seq) END AS value FROM {_LOG} WHERE type IN ('click', 'signup') GROUP BY session_id")
def latest_with_reset(spark, sf_dir):
    return w.latest_with_reset(session_events(spark, sf_dir), F.col("value"), F.col("type") == "click", F.col("type") == "signup")


@query(
    f"""SELECT session_id, wanted, active, coalesce(wanted_seq IS NOT NULL AND coalesce(active_seq, -1) < wanted_seq AND wanted IS DISTINCT FROM active, false) AS pending FROM (
        SELECT session_id, arg_max(data, seq) FILTER (type = 'click') AS wanted, max(seq) FILTER (type = 'click') AS wanted_seq,
               arg_max(data, seq) FILTER (type = 'view') AS active, max(seq) FILTER (type = 'view') AS active_seq
        FROM {_LOG} WHERE type IN ('click', 'view') GROUP BY session_id)""".replace("FILTER (type", "FILTER (WHERE type")
)
def pending_selection(spark, sf_dir):
    return w.pending(session_events(spark, sf_dir), F.col("type") == "click", F.col("type") == "view", F.col("data"))


_DELTA = "CASE type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END"


@query(f"SELECT session_id, seq, balance, balance = 0 AS balanced, min(balance) OVER (PARTITION BY session_id ORDER BY seq) < 0 AS broken FROM (SELECT *, CAST(sum({_DELTA}) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS balance FROM {_LOG})")
def running_balance(spark, sf_dir):
    delta = F.when(F.col("type") == "view", 1).when(F.col("type") == "click", -1).otherwise(0)
    return w.running_balance(session_events(spark, sf_dir), delta).select("session_id", "seq", "balance", "balanced", "broken")


@query(
    f"""WITH t AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY seq DESC) AS tail FROM {_CONV}),
        r AS (SELECT session_id, max(seq) FILTER (WHERE tail >= 500) AS reached FROM t GROUP BY session_id)
        SELECT session_id, CASE WHEN cut > 0 THEN cut END AS cut FROM (
            SELECT session_id, max(seq) FILTER (WHERE seq <= reached AND type = 'user/message') AS cut FROM t JOIN r USING (session_id) GROUP BY session_id)"""
)
def retention_cut(spark, sf_dir):
    return w.retention_cut(conversation_log(spark, sf_dir), F.length("text"), 500, F.col("type") == "user/message")


_SPANS = f"(SELECT session_id, seq, time AS start, time + CAST(floor(value * 100000) AS BIGINT) AS \"end\" FROM {_LOG})"


@query(
    f"""WITH g AS (SELECT *, greatest(0, coalesce(start - max("end") OVER (PARTITION BY session_id ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap FROM {_SPANS}),
        i AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY session_id ORDER BY start, "end", seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idle FROM g)
        SELECT session_id, seq, idle, start - idle AS start_without_idle, "end" - idle AS end_without_idle FROM i"""
)
def idle_compression(spark, sf_dir):
    log = session_events(spark, sf_dir)
    spans = log.select("session_id", "seq", F.col("time").alias("start"), (F.col("time") + F.floor(F.col("value") * 100000)).alias("end"))
    return w.without_idle(spans).select("session_id", "seq", "idle", "start_without_idle", "end_without_idle")


@query(f"SELECT session_id, seq, index, min(index) OVER (PARTITION BY session_id, turn) AS turn_start FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS index, seq // 2 AS turn FROM {_CONV})")
def sequence_timeline(spark, sf_dir):
    return w.timeline(conversation_log(spark, sf_dir), F.floor(F.col("seq") / 2)).select("session_id", "seq", "index", "turn_start")


@query(f"SELECT session_id, seq, CAST(coalesce(sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"group\" FROM {_LOG}")
def attach_pending(spark, sf_dir):
    return w.attach_to_next(session_events(spark, sf_dir), F.col("type") == "view").select("session_id", "seq", "group")


_ISLANDS = f"(SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq) AS island FROM (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY session_id ORDER BY seq) IS NOT DISTINCT FROM type THEN 0 ELSE 1 END AS new FROM {_LOG}))"


@query(f"SELECT session_id, seq, type, CAST(repeats AS INTEGER) AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY seq) AS repeats FROM {_ISLANDS}) WHERE repeats IN (2, 3)")
def repeated_calls(spark, sf_dir):
    return w.repeated_calls(session_events(spark, sf_dir), [F.col("type")], [2, 3]).select("session_id", "seq", "type", "repeats")


@query(
    f"""SELECT session_id, seq, at_turn, last_value(CASE WHEN type = 'click' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id, at_turn ORDER BY seq) AS at_step FROM (
        SELECT *, last_value(CASE WHEN type = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS at_turn FROM {_LOG}) WHERE at_turn IS NOT NULL
        UNION ALL SELECT session_id, seq, NULL, NULL FROM (SELECT *, last_value(CASE WHEN type = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS at_turn FROM {_LOG}) WHERE at_turn IS NULL"""
)
def event_location(spark, sf_dir):
    log = session_events(spark, sf_dir)
    return w.located(log, F.when(F.col("type") == "signup", F.col("seq")), F.when(F.col("type") == "click", F.col("seq"))).select("session_id", "seq", "at_turn", "at_step")


@query(f"SELECT session_id, seq, last_value(CASE WHEN type = 'signup' THEN data END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS header FROM {_LOG}")
def header_in_force(spark, sf_dir):
    return j.in_force(session_events(spark, sf_dir), F.when(F.col("type") == "signup", F.col("data")), "header").select("session_id", "seq", "header")


_RUNS = f"""(SELECT session_id, type, min(seq) AS seq0, min(time) AS time0, list(time ORDER BY seq) AS times, list(data ORDER BY seq) AS texts FROM {_ISLANDS} GROUP BY session_id, type, island)"""


@query(f"SELECT session_id, type, seq0, time0, array_to_string(list_transform(range(2, len(times) + 1), lambda i: times[i] - times[i - 1]), ',') AS dt, array_to_string(texts, '|') AS texts FROM {_RUNS} WHERE len(texts) >= 3")
def pack_runs(spark, sf_dir):
    packed = jsonl.pack(session_events(spark, sf_dir), keys=("type",), text="data").where("packed")
    return packed.select("session_id", "type", "seq0", "time0", F.array_join(F.col("dt").cast("array<string>"), ",").alias("dt"), F.array_join("texts", "|").alias("texts"))


@query(f"SELECT session_id, type, seq, time, data AS text FROM {_LOG}")
def unpack_runs(spark, sf_dir):
    """Packing and unpacking gives the log back."""
    return jsonl.unpack_arrays(jsonl.pack(session_events(spark, sf_dir), keys=("type",), text="data")).select("session_id", "type", "seq", "time", "text")


@query(f"SELECT session_id, seq, type FROM {_LOG} WHERE seq < 20")
def torn_tail_cut(spark, sf_dir):
    """Logs with a hole after their twentieth row keep what comes before it."""
    rows = session_events(spark, sf_dir).select(F.col("session_id").alias("path"), F.col("seq").alias("number"), (F.col("seq") != 20).alias("good"), "seq", "type")
    return jsonl.cut_tail(rows).select(F.col("path").alias("session_id"), "seq", "type")


def _seen(state, event):
    """How many rows, and the last of each type."""
    return {"rows": state["rows"] + 1, "last": {**state["last"], event["type"]: event["seq"]}}


@query(f"SELECT session_id, count(*) AS rows, max(seq) FILTER (WHERE type = 'view') AS view, max(seq) FILTER (WHERE type = 'click') AS click, max(seq) AS seq FROM {_LOG} GROUP BY session_id")
def projection_fold(spark, sf_dir):
    """Whole logs, folded on from checkpoints after their tenth row; those of even sessions are of an older version."""
    seen = projections.Projection("seen", 2, lambda: {"rows": 0, "last": {}}, _seen)
    log = session_events(spark, sf_dir)
    version = F.when(F.col("session_id").cast("bigint") % 2 == 0, 1).otherwise(2)
    # Stored, as checkpoints are.
    held = traces._kept(projections.fold(log.where("seq < 10"), [seen]).withColumn("ver", version))
    state = F.from_json("val", "rows bigint, last map<string, bigint>")
    return projections.fold(log, [seen], held).select("session_id", state["rows"].alias("rows"), state["last"]["view"].alias("view"), state["last"]["click"].alias("click"), "seq")


@query(f"SELECT session_id || '/' || type AS id, count(*) AS n, min(time) AS due FROM {_LOG} GROUP BY session_id, type HAVING min(time) <= 1704200000000")
def schedule_due(spark, sf_dir):
    rows = session_events(spark, sf_dir).groupBy(F.concat_ws("/", "session_id", "type").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("target"))
    plans = rows.withColumns({"kind": F.lit("at"), "interval": F.lit(None).cast("bigint"), "position": F.lit(0)})
    return schedules.targets(plans, F.lit(1704200000000).cast("bigint")).where("due is not null").select("id", "n", "due")


@query("SELECT 'labels' AS \"table\", CAST(doc_id // 2 AS VARCHAR) AS key, arg_max(CAST(quality AS VARCHAR), doc_id) AS value, max(doc_id) AS version FROM labels GROUP BY doc_id // 2")
def key_value_table(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select(F.lit("labels").alias("table"), F.floor(F.col("doc_id") / 2).cast("string").alias("key"), F.col("doc_id").alias("version"), F.col("quality").cast("string").alias("value"))
    return j.last_write(changes)


@query("SELECT doc_id AS id, CAST(r AS INTEGER) AS row, CASE r WHEN 0 THEN 'id,lang' ELSE CAST(doc_id AS VARCHAR) || ',' || lang || '|x' END AS line FROM documents, unnest([0, 1]) AS t(r)")
def markdown_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("intro\n| id | lang |\n|---|:-:|\n| "), F.col("doc_id").cast("string"), F.lit(" | "), "lang", F.lit("\\|x |\nend"))
    cells = tables.markdown_tables(docs.select(F.col("doc_id").alias("id"), text.alias("text")))
    return cells.select("id", "row", tables.csv_lines(F.col("cells")).alias("line"))


@query(r"SELECT doc_id AS path, CAST(i AS INTEGER) AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(l, 'than')")
def grep_lines(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    return tables.grep(files, "than")


def _replacing(spark, sf_dir):
    """Conversations of which every third row replaces the two rows before it."""
    log = conversation_log(spark, sf_dir)
    third = F.col("seq") % 3 == 2
    op = F.struct(F.when(third, "replace").otherwise("append").alias("op"), F.when(third, F.col("seq") - 2).alias("start"), F.when(third, F.col("seq") - 1).alias("end"))
    return log.withColumn("source_event_seqs", F.when(third, F.array(F.col("seq") - 2, F.col("seq") - 1))).withColumn("surface_op", op).withColumn("session_id", F.col("session_id").cast("string"))


_THIRD = "seq - seq % 3 + 2"


@query(
    f"""WITH e AS (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_CONV}),
        f AS (SELECT *, CASE WHEN seq % 3 < 2 AND {_THIRD} <= last THEN {_THIRD} END AS replaced_by FROM e)
        SELECT CAST(session_id AS VARCHAR) AS session_id, seq, CASE WHEN replaced_by IS NULL THEN 'current' ELSE 'shadowed' END AS surface,
               CASE WHEN replaced_by IS NULL THEN row_number() OVER (PARTITION BY session_id, replaced_by IS NULL ORDER BY seq) - 1 END AS position, replaced_by FROM f"""
)
def surface_fold(spark, sf_dir):
    return surface.fold(_replacing(spark, sf_dir)).drop("error")


@query(f"SELECT CAST(session_id AS VARCHAR) AS session_id, seq, CAST({_THIRD} AS VARCHAR) AS chain FROM (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_CONV}) WHERE seq % 3 < 2 AND {_THIRD} <= last")
def replacement_chain(spark, sf_dir):
    chains = traces.replacement_chains(surface.fold(_replacing(spark, sf_dir)))
    return chains.select("session_id", "seq", F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"))


@query(f"SELECT CAST(a.session_id AS VARCHAR) AS session_id, a.seq, string_agg(CAST(b.seq AS VARCHAR), ',' ORDER BY b.seq) AS chain FROM {_CONV.removesuffix(' c')} a JOIN {_CONV.removesuffix(' c')} b ON a.session_id = b.session_id AND b.seq > a.seq GROUP BY ALL")
def long_chains(spark, sf_dir):
    """Conversations of which every row replaces the one before."""
    log = conversation_log(spark, sf_dir)
    later = F.col("seq") > 0
    op = F.struct(F.when(later, "replace").otherwise("append").alias("op"), F.when(later, F.col("seq") - 1).alias("start"), F.when(later, F.col("seq") - 1).alias("end"))
    log = log.withColumn("source_event_seqs", F.when(later, F.array(F.col("seq") - 1))).withColumn("surface_op", op).withColumn("session_id", F.col("session_id").cast("string"))
    chains = traces.replacement_chains(surface.fold(log))
    return chains.select("session_id", "seq", F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"))


@query(f"SELECT session_id, seq, replace(data, ' ', '') AS data FROM {_LOG}")
def canonical_json(spark, sf_dir):
    return session_events(spark, sf_dir).select("session_id", "seq", p.column(p.canonical, "string")(F.col("data")).alias("data"))


@query(f"SELECT 'child' AS session_id, seq, type FROM {_LOG} WHERE session_id = '7' AND seq < 5")
def fork_log(spark, sf_dir):
    log = session_events(spark, sf_dir).withColumn("kind", F.col("type")).withColumn("type", F.when(F.col("seq") == 4, "turn/end").otherwise(F.col("type")))
    return n.fork(log, "7", "child", 5).select("session_id", "seq", F.col("kind").alias("type"))


@query(f"SELECT session_id, seq, type FROM {_LOG} WHERE session_id = '7' AND seq < 30 AND seq >= (SELECT min(seq) FROM (SELECT seq FROM {_LOG} WHERE session_id = '7' AND seq < 30 AND type = 'click' ORDER BY seq DESC LIMIT 3))")
def history_page(spark, sf_dir):
    log = session_events(spark, sf_dir).where("session_id = '7'").withColumn("kind", F.col("type")).withColumn("type", F.when(F.col("type") == "click", "user/message").otherwise(F.col("type")))
    return n.history_page(log, 30, 3).select("session_id", "seq", F.col("kind").alias("type"))


@query("SELECT doc_id AS id FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 5)")
def workspace_access(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cwd"))
    return n.authorized(rows, 5).select("id")


@query("SELECT doc_id AS session_id, n_chars AS seq, lang FROM documents WHERE doc_id % 4 <> 0")
def index_reconcile(spark, sf_dir):
    """Sessions whose number ends a group of four are gone, every third has changed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("n_chars").alias("seq"), "lang")
    now = docs.where("session_id % 4 <> 0").select("session_id", (F.col("session_id") % 3).alias("revision"))
    before = docs.select("session_id", F.lit(1).alias("revision"))
    old = docs.withColumn("lang", F.when(F.col("session_id") % 3 == 1, F.col("lang")).otherwise("stale"))
    return n.reconcile(docs, old, now, before)


_TURNS = f"(SELECT session_id, seq, time, CASE type WHEN 'signup' THEN 'subagent/descriptor' WHEN 'view' THEN 'turn/start' WHEN 'click' THEN 'turn/end' ELSE 'other' END AS kind FROM {_LOG})"


def _turns(spark, sf_dir):
    kind = F.when(F.col("type") == "signup", "subagent/descriptor").when(F.col("type") == "view", "turn/start").when(F.col("type") == "click", "turn/end").otherwise("other")
    return session_events(spark, sf_dir).withColumn("type", kind).withColumn("data", F.lit("{}"))


@query(
    f"""WITH k AS (SELECT *, max(seq) FILTER (WHERE kind = 'turn/start') OVER w AS s, arg_max(time, seq) FILTER (WHERE kind = 'turn/start') OVER w AS s_time, max(seq) FILTER (WHERE kind = 'turn/end') OVER w AS e, max(seq) FILTER (WHERE kind = 'subagent/descriptor') OVER (PARTITION BY session_id) AS d
            FROM {_TURNS} WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        o AS (SELECT *, CASE WHEN kind = 'turn/start' THEN time WHEN kind <> 'turn/end' AND s > coalesce(e, -1) THEN s_time END AS since FROM k WHERE d IS NOT NULL)
        SELECT session_id, CAST(coalesce(sum(greatest(time - s_time, 0)) FILTER (WHERE kind = 'turn/end' AND s > coalesce(e, -1) AND seq > d), 0) AS BIGINT) AS settled_ms,
            arg_max([since], seq)[1] AS since, arg_max([CASE WHEN since IS NOT NULL THEN time END], seq)[1] AS through FROM o GROUP BY session_id"""
)
def subagent_timing(spark, sf_dir):
    return m.subagent_timing(_turns(spark, sf_dir))
