"""What events say, how sessions hang together, and the state that their logs leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import events as e
from ..functions import text as x
from ..operators import joins as j
from ..operators import metrics as m
from ..operators import sessions as n
from ..operators import surface, trees
from ..operators import windows as w
from ..schema import conversation_log, conversation_sessions, session_events, table
from ..streaming import folds, projections, schedules
from . import query
from .logs import _THIRD, _replacing
from .metrics import _SAMPLES, _STEPS, _samples, _steps
from .search import _CONV, _LOG


def _spoken(spark, sf_dir):
    """Conversations as logs with JSON data; every assistant's text is followed by hidden reasoning."""
    text = F.struct(F.lit("text").alias("type"), "text")
    said = F.when(F.col("type") == "assistant/message", F.to_json(F.struct(F.struct(F.array(text, F.struct(F.lit("reasoning").alias("type"), F.lit("hidden").alias("text"))).alias("content")).alias("message")))).otherwise(F.to_json(F.struct(F.array(text).alias("content"))))
    return conversation_log(spark, sf_dir).withColumn("data", said)


_SAID = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_UTF16 = r"(length({0}) + length(regexp_replace({0}, '[\x{{0}}-\x{{FFFF}}]', '', 'g')))"


@query(f"SELECT session_id, seq, {_SAID} AS text FROM {_CONV} WHERE {_SAID} <> ''")
def event_text(spark, sf_dir):
    """What search reads of each event."""
    return e.documents(_spoken(spark, sf_dir)).select("session_id", "seq", "text")


@query(f"SELECT session_id, seq, text FROM {_CONV}")
def surface_messages(spark, sf_dir):
    log = _spoken(spark, sf_dir).where(e.on_surface(F.col("type")))
    message = e.message_of(F.col("type"), F.col("data"))
    return log.select("session_id", "seq", F.get_json_object(message, "$.content[0].text").alias("text"))


@query(f"SELECT session_id, seq, CAST(ceil({_UTF16.format('text')} / 4) + 8 AS BIGINT) AS tokens, CAST(length(text) AS INTEGER) AS chars FROM {_CONV} WHERE type = 'user/message'")
def message_prices(spark, sf_dir):
    blocks = F.get_json_object("data", "$.content")
    return _spoken(spark, sf_dir).where("type = 'user/message'").select("session_id", "seq", x.message_tokens(e.block_tokens(blocks)).alias("tokens"), e.text_length(blocks).alias("chars"))


@query(f"SELECT DISTINCT session_id, unnest(['m' || (seq % 3), 'n' || type]) AS media_id FROM {_LOG}")
def image_references(spark, sf_dir):
    """Images in blocks and in results inside them, whatever the order of their keys."""
    data = F.concat(F.lit('{"content":[{"ref":"m'), (F.col("seq") % 3).cast("string"), F.lit('","size":{"w":1},"type":"image"},{"type":"tool-result","content":[{"type":"image","size":{"w":1},"ref":"n'), "type", F.lit('"},{"type":"text","ref":"none"}]}]}'))
    return e.image_refs(session_events(spark, sf_dir).withColumn("data", data))


@query(f"SELECT session_id, seq, seq % 2 = 0 AS whole, seq % 3 > 0 AS known, type = 'view' AS same FROM {_LOG}")
def checked_json(spark, sf_dir):
    """Torn JSON, unknown keys, and headers that differ only in what is empty."""
    data = F.when(F.col("seq") % 2 == 0, F.col("data")).otherwise(F.left("data", F.length("data") - 1))
    keyed = F.when(F.col("seq") % 3 == 0, F.lit('{"k":1,"z":2}')).when(F.col("seq") % 3 == 1, F.lit('{"k":1}')).otherwise(F.lit('{"o":null,"k":1}'))
    header = F.when(F.col("type") == "view", F.lit('{"system":"","tools":[]}')).otherwise(F.lit('{"system":"s"}'))
    return session_events(spark, sf_dir).select("session_id", "seq", e.lossless(data).alias("whole"), e.exact_keys(keyed, ["k"], ["o"]).isNotNull().alias("known"), e.same_header(header, F.lit("{}")).alias("same"))


_HEADED = f"(SELECT *, max(seq) FILTER (WHERE type = 'signup') OVER (PARTITION BY session_id ORDER BY seq) AS header FROM {_LOG})"


@query(
    f"""WITH r AS (SELECT *, CASE WHEN type NOT IN ('click', 'signup') THEN CAST(floor(value) AS BIGINT) - 20 END AS delta, CASE WHEN type = 'click' THEN CAST(floor(value * 9) AS BIGINT) END AS used,
            CASE WHEN seq % 4 = 3 THEN -1 ELSE header END AS counted, CASE WHEN type = 'signup' THEN CAST(floor(value) AS BIGINT) END AS size FROM {_HEADED}),
        g AS (SELECT *, coalesce(sum(delta) OVER w, 0) AS grown, coalesce(last_value(size IGNORE NULLS) OVER w, 0) AS held FROM r WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
        a AS (SELECT *, max(seq) FILTER (WHERE used IS NOT NULL) OVER (PARTITION BY session_id ORDER BY seq) AS anchor FROM g),
        b AS (SELECT a.*, c.used AS c_used, c.counted AS c_counted, c.grown + c.held AS c_estimate, c.grown AS c_grown FROM a LEFT JOIN g c ON a.session_id = c.session_id AND a.anchor = c.seq),
        d AS (SELECT *, coalesce(anchor IS NOT NULL AND c_counted IS NOT DISTINCT FROM header, false) AS measured FROM b WHERE delta IS NOT NULL)
        SELECT session_id, seq, CAST(CASE WHEN measured THEN greatest(c_used, c_estimate) END AS BIGINT) AS baseline,
            CAST(greatest(CASE WHEN measured THEN greatest(c_used, c_estimate) + grown - c_grown ELSE grown + held END, 0) AS BIGINT) AS tokens, measured FROM d"""
)
def anchored_measurement(spark, sf_dir):
    """Clicks are counts, signups headers, other rows changes; every fourth row was counted under a foreign header."""
    log = j.in_force(session_events(spark, sf_dir), F.when(F.col("type") == "signup", F.col("seq")), "header")
    samples = log.where("type = 'click'").select("session_id", "seq", F.floor(F.col("value") * 9).alias("used"), F.when(F.col("seq") % 4 == 3, F.lit(-1).cast("bigint")).otherwise(F.col("header")).alias("header"))
    changes = log.where("type not in ('click', 'signup')").select("session_id", "seq", (F.floor("value") - 20).alias("delta"))
    headers = log.where("type = 'signup'").select("session_id", "seq", "header", F.floor("value").alias("tokens"))
    return m.anchored(samples, changes, headers)


@query(
    f"""SELECT session_id, CAST(coalesce(sum(floor(value)) FILTER (WHERE type <> 'signup'), 0) AS BIGINT) AS messages, CAST(coalesce(arg_max(floor(value), seq) FILTER (WHERE type = 'signup'), 0) AS BIGINT) AS system,
        coalesce(max(seq) FILTER (WHERE type = 'signup'), 0) AS tools FROM {_LOG} GROUP BY session_id"""
)
def context_breakdown(spark, sf_dir):
    log = session_events(spark, sf_dir)
    headers = log.where("type = 'signup'").select("session_id", "seq", F.floor("value").alias("system"), F.col("seq").alias("tools"))
    return m.breakdown(headers, log.where("type <> 'signup'").select("session_id", F.floor("value").alias("delta")))


@query(f"SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(sum(length(text)) AS BIGINT) AS tokens FROM (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_CONV}) WHERE seq % 3 = 2 OR {_THIRD} > last GROUP BY session_id")
def surface_token_fold(spark, sf_dir):
    log = _replacing(spark, sf_dir)
    return m.surface_tokens(surface.fold(log), log.select("session_id", "seq", F.length("text").cast("bigint").alias("tokens")))


@query(
    f"""WITH s AS (SELECT *, coalesce(input, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0) AS used FROM {_SAMPLES} WHERE step = ascii('view')), l AS (SELECT session_id, max(seq) AS anchor, arg_max(used, seq) AS pressure, arg_max(window_size, seq) AS w FROM s GROUP BY session_id)
        SELECT l.session_id, CAST(pressure AS BIGINT) AS pressure, w AS "window", CAST(greatest(0, pressure + coalesce((SELECT sum(floor(e.value) - 30) FROM {_LOG} WHERE e.session_id = l.session_id AND e.seq >= anchor), 0)) AS BIGINT) AS projected FROM l"""
)
def pressure_projection(spark, sf_dir):
    changes = session_events(spark, sf_dir).select("session_id", "seq", (F.floor("value") - 30).alias("delta"))
    return m.projected_pressure(_samples(spark, sf_dir).where(F.col("step") == F.ascii(F.lit("view"))), changes)


@query(
    f"""WITH k AS (SELECT *, seq // 8 AS turn, seq % 4 AS step FROM {_LOG})
        SELECT session_id, turn, step, max_start AS start, first_token, "end", output FROM (
            SELECT session_id, turn, step, arg_max(time, seq) FILTER (WHERE type = 'signup') AS max_start, arg_min(time, seq) FILTER (WHERE type = 'view') AS first_token, arg_min(time, seq) FILTER (WHERE type = 'click') AS "end", CAST(arg_min(floor(value), seq) FILTER (WHERE type = 'click') AS BIGINT) AS output
            FROM k GROUP BY ALL) WHERE "end" IS NOT NULL"""
)
def step_timing(spark, sf_dir):
    log = session_events(spark, sf_dir).select("session_id", "seq", "time", "type", F.floor(F.col("seq") / 8).alias("turn"), (F.col("seq") % 4).alias("step"), F.col("data").alias("text"), F.floor("value").alias("output"))
    return m.step_timing(log.where("type = 'signup'"), log.where("type = 'view'"), log.where("type = 'click'"))


@query("SELECT source AS cwd, count(*) AS n, bool_or(doc_id = 5) AS has_current FROM documents GROUP BY source")
def workspace_groups(spark, sf_dir):
    return m.by_workspace(table(spark, sf_dir, "documents").select(F.col("source").alias("cwd"), F.col("doc_id").alias("id")), 5)


@query("SELECT source, coalesce(max(doc_id) FILTER (WHERE doc_id % 3 > 0), 0) AS greatest FROM documents GROUP BY source")
def greatest_ids(spark, sf_dir):
    ids = F.concat(F.when(F.col("doc_id") % 3 > 0, F.lit("memory-")).otherwise(F.lit("note-")), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(m.greatest_number(ids).alias("greatest"))


def _plans(spark, sf_dir):
    """A schedule for each row: views and clicks run once, the others at fixed rates."""
    kind = F.when(F.col("type") == "view", "after").when(F.col("type") == "click", "at").otherwise("every")
    return session_events(spark, sf_dir).select("session_id", "seq", F.concat_ws("/", "session_id", F.col("seq").cast("string")).alias("id"), kind.alias("kind"), F.col("time").alias("target"), ((F.col("seq") + 1) * 60_000).alias("interval"), F.col("seq").alias("position"))


_NOW = 1704200000000
_DUE = f"(SELECT *, type NOT IN ('view', 'click') AS every, (seq + 1) * 60000 AS step FROM {_LOG})"


@query(
    f"""SELECT session_id, seq, CAST(CASE WHEN time <= {_NOW} THEN CASE WHEN every THEN time + ({_NOW} - time) // step * step ELSE time END END AS BIGINT) AS due,
        CAST(CASE WHEN time > {_NOW} THEN time WHEN every THEN time + (({_NOW} - time) // step + 1) * step END AS BIGINT) AS next FROM {_DUE}"""
)
def schedule_targets(spark, sf_dir):
    """One-shots and fixed rates: what is due, and when each is next."""
    return schedules.targets(_plans(spark, sf_dir), F.lit(_NOW).cast("bigint")).select("session_id", "seq", "due", "next")


@query(f"SELECT min(CASE WHEN time > {_NOW} THEN time WHEN every THEN CAST(time + (({_NOW} - time) // step + 1) * step AS BIGINT) END) AS wake FROM {_DUE}")
def next_wake(spark, sf_dir):
    return schedules.next_wake(_plans(spark, sf_dir), F.lit(_NOW).cast("bigint"))


_WORK = f"(SELECT session_id, seq, CASE type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'step' WHEN 'click' THEN 'end' WHEN 'error' THEN 'cancel' ELSE 'take' END AS kind, max(seq) FILTER (WHERE type = 'view') OVER w AS turn, max(seq) FILTER (WHERE type = 'click') OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM {_LOG} WINDOW w AS (PARTITION BY session_id ORDER BY seq))"


@query(
    f"""WITH t AS (SELECT session_id, turn, bool_or(kind = 'step') AS works, bool_or(kind = 'take' AND turn > coalesce(ended, -1)) AS takes, max(seq) FILTER (WHERE kind = 'end') AS e FROM {_WORK} WHERE turn IS NOT NULL GROUP BY ALL),
        c AS (SELECT session_id, max(e) AS "end" FROM t WHERE works OR (takes AND e % 2 = 0) GROUP BY session_id), d AS (SELECT session_id, max(seq) FILTER (WHERE kind = 'cancel') AS dropped FROM {_WORK} GROUP BY session_id)
        SELECT session_id, "end", coalesce(dropped > coalesce("end", -1), false) AS dropped_unrun FROM d LEFT JOIN c USING (session_id)"""
)
def consumed_work(spark, sf_dir):
    """Views start turns, purchases steps, clicks end turns; errors cancel messages, signups take them."""
    log = j.in_force(session_events(spark, sf_dir), F.when(F.col("type") == "view", F.col("seq")), "turn")
    turn = F.col("turn").cast("string")
    kind = F.when(F.col("type") == "view", "turn/start").when(F.col("type") == "purchase", "step/start").when(F.col("type") == "click", "turn/end").otherwise("agent/inbox/spliced")
    reason = F.when(F.col("seq") % 2 == 0, "aborted").otherwise("completed")
    own = F.when(turn.isNotNull(), F.concat(F.lit('{"turn":'), turn, F.lit(',"reason":{"kind":"'), reason, F.lit('"}}'))).otherwise(F.lit("{}"))
    data = F.when(F.col("type") == "error", F.lit('{"removedCount":1,"outcome":"canceled","inserted":[]}')).when(F.col("type") == "signup", F.lit('{"removedCount":1,"inserted":[]}')).otherwise(own)
    return m.consumed_work(log.withColumn("data", data).withColumn("type", kind))


@query("SELECT doc_id AS id FROM documents WHERE source <> 'src0' AND (n_chars > 500 OR doc_id = 7) AND doc_id % 5 > 0")
def visible_sessions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "subagent").otherwise("user").alias("origin"), F.when(F.col("n_chars") > 500, 3).otherwise(0).alias("events"))
    return n.visible(rows, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")), 7).select("id")


@query("SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'ungrouped' ELSE 'group' || quality END AS \"group\" FROM documents LEFT JOIN labels USING (doc_id)")
def grouped_sessions(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("group"), F.col("quality").cast("string")).alias("group"))
    return j.group_members(ids, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))).select("id", "group")


@query(f"SELECT session_id, arg_max(data, seq) FILTER (WHERE type = 'signup') AS header FROM {_LOG} GROUP BY session_id HAVING arg_max(type, seq) FILTER (WHERE type IN ('view', 'click')) = 'view'")
def provider_in_force(spark, sf_dir):
    """Views start steps and clicks end them; signups are headers."""
    kind = F.when(F.col("type") == "view", "step/start").when(F.col("type") == "click", "step/end").otherwise(F.col("type"))
    header = F.when(F.col("type") == "signup", F.col("data"))
    log = session_events(spark, sf_dir).withColumn("header", header).withColumn("type", kind)
    return n.provider_in_force(log, F.col("header"))


@query(f"SELECT session_id, seq, CASE WHEN held IS NULL THEN NULL WHEN type = 'click' THEN 's' || held END AS schema FROM (SELECT *, max(seq) FILTER (WHERE type = 'signup') OVER (PARTITION BY session_id ORDER BY seq) AS held FROM {_LOG}) WHERE type IN ('view', 'click')")
def call_knobs(spark, sf_dir):
    """Views and clicks are calls; the header in force knows the schema of clicks only."""
    tools = F.when(F.col("type") == "signup", F.array(F.struct(F.lit("click").alias("name"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("schema"))))
    call = F.when(F.col("type").isin("view", "click"), F.col("type"))
    return trees.knobs(session_events(spark, sf_dir), tools, call).select("session_id", "seq", "schema")


_TREE = "WITH RECURSIVE s AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent FROM conversations), t AS (SELECT id, id AS root, 0 AS depth FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, t.root, t.depth + 1 FROM s JOIN t ON s.parent = t.id)"


@query(f"{_TREE} SELECT id, root, CAST(depth AS INTEGER) AS depth FROM t")
def lineage_tree(spark, sf_dir):
    return trees.flatten(conversation_sessions(spark, sf_dir), F.col("id")).select("id", "root", "depth")


@query(f"{_TREE} SELECT id FROM t WHERE root = 0 AND depth > 0 AND id % 2 = 1")
def subagents(spark, sf_dir):
    flat = trees.flatten(conversation_sessions(spark, sf_dir).withColumn("origin", F.when(F.col("id") % 2 == 1, "subagent").otherwise("user")), F.col("id"))
    return trees.of_origin(flat, 0, "subagent").select("id")


@query(f"{_TREE} SELECT id AS call_id, CASE WHEN id % 3 = 0 THEN 'ok' ELSE 'running' END AS state, CAST(depth AS INTEGER) AS depth FROM t")
def call_tree(spark, sf_dir):
    rows = conversation_sessions(spark, sf_dir).select(F.col("id").alias("call_id"), "parent", F.col("id").alias("seq"))
    ends = rows.where("call_id % 3 = 0").select("call_id", "seq", F.lit("ok").alias("outcome"))
    late = ends.select("call_id", (F.col("seq") + 1).alias("seq"), F.lit("late").alias("outcome"))
    return trees.call_tree(rows, ends.unionByName(late)).select("call_id", "state", "depth")


@query(f"{_TREE} SELECT id, root, (SELECT count(*) FROM t d WHERE d.root = t.root AND d.depth > t.depth) AS deeper FROM t")
def post_order(spark, sf_dir):
    """Children before parents: in each tree, by how many nodes are deeper."""
    return trees.post_order(trees.flatten(conversation_sessions(spark, sf_dir), F.col("id"))).select("id", "root", "deeper")


@query("WITH g AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source), t AS (SELECT *, sum(size) OVER (ORDER BY source) AS total FROM g) SELECT source, size FROM t WHERE total <= (SELECT sum(size) / 2 FROM g) OR total = size")
def byte_capped(spark, sf_dir):
    """Sources in order up to half of all characters."""
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    half = groups.agg(F.sum("size")).first()[0] / 2
    return n.byte_capped(groups, "source", F.col("size"), half).select("source", "size")


@query("SELECT doc_id AS id FROM documents WHERE doc_id <> 3 AND contains(lower(CAST(doc_id AS VARCHAR) || chr(10) || source || chr(10) || lang), 'e') ORDER BY CASE WHEN source = 'src1' THEN 0 ELSE 2 END, n_chars DESC, doc_id LIMIT 40")
def reference_candidates(spark, sf_dir):
    """The forty best candidates: the list is the operator."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cwd"), F.col("lang").alias("title"), F.col("n_chars").alias("created_at"))
    return n.reference_candidates(rows, 3, "src1", "E", 40).select("id")


@query(f"WITH k AS (SELECT * FROM {_LOG} WHERE session_id = '7'), l AS (SELECT max(seq) AS seq, arg_max(type, seq) AS type FROM k WHERE type IN ('view', 'click')) SELECT k.seq FROM k LEFT JOIN l ON true WHERE l.type IS DISTINCT FROM 'view' OR k.seq < l.seq")
def before_open_step(spark, sf_dir):
    kind = F.when(F.col("type") == "view", "step/start").when(F.col("type") == "click", "step/end").otherwise(F.col("type"))
    return n.before_open_step(session_events(spark, sf_dir).withColumn("type", kind), "7").select("seq")


@query(f"SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq // 8, type = 'view' ORDER BY seq) AS i FROM {_LOG}) WHERE (type <> 'view' OR i = 1) AND seq > CAST(session_id AS BIGINT) % 10")
def telemetry(spark, sf_dir):
    """Views are chunks: the first of each turn is sent, and nothing that was sent before."""
    kind = F.when(F.col("type") == "view", "assistant/chunk").otherwise(F.col("type"))
    log = session_events(spark, sf_dir).withColumn("type", kind).withColumn("turn", F.floor(F.col("seq") / 8)).withColumn("step", F.lit(0))
    sent = log.select("session_id").distinct().withColumn("cursor", F.col("session_id").cast("bigint") % 10)
    return n.telemetry(log, sent).select("session_id", "seq")


@query("SELECT doc_id AS key, CASE WHEN toxic IS NULL THEN 'put' WHEN quality = 0 AND toxic = 1 THEN 'deleted' ELSE 'put' END AS change FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR doc_id % 2 = 0 OR (quality = 0 AND toxic = 1)")
def change_feed(spark, sf_dir):
    """Labels before; after them bad toxic ones are gone, even ones have changed, the other documents are new."""
    labels = table(spark, sf_dir, "labels")
    before = labels.select(F.lit("t").alias("table"), F.col("doc_id").alias("key"), F.lit(1).alias("version"), F.lit("old").alias("value"))
    kept = labels.where("not (quality = 0 and toxic = 1)").select(F.lit("t").alias("table"), F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("version"), F.lit("new").alias("value"))
    new = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_anti").select(F.lit("t").alias("table"), F.col("doc_id").alias("key"), F.lit(1).alias("version"), F.lit("new").alias("value"))
    return j.change_feed(before, kept.unionByName(new)).select("key", "change")


_CHANGES = f"(SELECT session_id, type AS key, seq, data AS value FROM {_LOG})"


@query(f"SELECT session_id, key, arg_max(value, seq) AS value, max(seq) AS seq FROM {_CHANGES} GROUP BY session_id, key")
def latest_values(spark, sf_dir):
    return projections.latest_values(session_events(spark, sf_dir).select("session_id", F.col("type").alias("key"), "seq", F.col("data").alias("value")))


@query(f"SELECT session_id, key, arg_max(value, seq) AS value, max(seq) AS seq, CAST(9 AS BIGINT) AS as_of FROM {_CHANGES} WHERE seq <= 9 GROUP BY session_id, key")
def snapshot(spark, sf_dir):
    return projections.snapshot(session_events(spark, sf_dir).select("session_id", F.col("type").alias("key"), "seq", F.col("data").alias("value")), 9)


@query(f"SELECT session_id, min(seq) AS as_of, max(value) FILTER (WHERE key = 'click') AS click, max(value) FILTER (WHERE key = 'view') AS view FROM (SELECT session_id, key, max(seq) AS seq, arg_max(value, seq) AS value FROM {_CHANGES} GROUP BY ALL) WHERE (key = 'click' AND seq % 3 = 1) OR (key = 'view' AND seq % 3 = 2) GROUP BY session_id")
def stale_view(spark, sf_dir):
    """Stored states of the current versions, without the log."""
    rows = session_events(spark, sf_dir).groupBy("session_id", F.col("type").alias("key")).agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("val"))
    shown = projections.stale_view(rows.withColumn("ver", (F.col("seq") % 3).cast("int")), {"click": 1, "view": 2})
    return shown.select("session_id", "as_of", F.col("values")["click"].alias("click"), F.col("values")["view"].alias("view"))


@query("SELECT CAST(doc_id AS VARCHAR) AS session_id FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 3 > 0 OR source = 'src1')")
def same_lifecycle(spark, sf_dir):
    """Checkpoints of sessions that were made anew, or are in another folder now, don't count."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), F.col("source").alias("cwd"))
    held = docs.select(F.col("id").cast("string").alias("session_id"), (F.col("created_at") + F.col("id") % 2).alias("created_at"), F.when(F.col("id") % 3 == 0, F.lit("src1")).otherwise(F.col("cwd")).alias("cwd"))
    return projections.same_lifecycle(held, docs).select("session_id")


@query(f"SELECT session_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) AS pending FROM (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_LOG}) WHERE seq % 3 <> 1 OR seq = last GROUP BY session_id")
def inbox_fold(spark, sf_dir):
    """Each row puts a message first; every third takes the one before away."""
    data = F.concat(F.lit('{"target":"next-turn","start":0,"removedCount":'), F.when(F.col("seq") % 3 == 2, "1").otherwise("0"), F.lit(',"inserted":[{"id":"'), F.col("seq").cast("string"), F.lit('"}]}'))
    states = projections.fold(session_events(spark, sf_dir).withColumn("type", F.lit("agent/inbox/spliced")).withColumn("data", data), [folds.INBOX])
    ids = F.from_json("val", "`next-turn` array<struct<id: string>>")["next-turn"]["id"]
    return states.select("session_id", F.array_join(ids, ",").alias("pending"))


_FORKS = f"""(WITH n AS (SELECT session_id, count(*) AS n FROM {_LOG} GROUP BY session_id) SELECT c.session_id, c.n, CASE WHEN CAST(c.session_id AS BIGINT) % 4 > 0 THEN least(coalesce(p.n, 0), 5) ELSE 0 END AS seed FROM n c LEFT JOIN n p ON CAST(p.session_id AS BIGINT) = CAST(c.session_id AS BIGINT) - 1) f"""


@query(
    f"""WITH q AS (SELECT session_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq DESC) AS pending FROM (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last FROM {_LOG}) WHERE seq % 3 <> 1 OR seq = last GROUP BY session_id)
        SELECT session_id, pending, CAST(n + seed - 1 AS BIGINT) AS seq FROM q JOIN {_FORKS} USING (session_id)"""
)
def forked_inboxes(spark, sf_dir):
    """Three of four sessions fork the one before after five rows, which count as theirs; its pending messages don't."""
    own = session_events(spark, sf_dir)
    counts = own.groupBy(F.col("session_id").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    forks = counts.join(counts.select((F.col("id") + 1).alias("id"), F.least("n", F.lit(5)).alias("up_to")), "id", "left")
    seed = F.when(F.col("id") % 4 > 0, F.coalesce("up_to", F.lit(0))).otherwise(0)
    forks = forks.select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("parent"), seed.cast("bigint").alias("seed_length"))
    data = F.concat(F.lit('{"target":"next-turn","start":0,"removedCount":'), F.when(F.col("seq") % 3 == 2, "1").otherwise("0"), F.lit(',"inserted":[{"id":"'), F.col("seq").cast("string"), F.lit('"}]}'))
    rows = own.join(forks.select(F.col("id").alias("session_id"), "seed_length"), "session_id").select("session_id", (F.col("seq") + F.col("seed_length")).alias("seq"), F.lit("agent/inbox/spliced").alias("type"), "time", data.alias("data"))
    states = projections.fold(n.forked_log(rows, forks), [folds.INBOX])
    ids = F.from_json("val", "`next-turn` array<struct<id: string>>")["next-turn"]["id"]
    return states.select("session_id", F.array_join(ids, ",").alias("pending"), "seq")


@query(f"SELECT session_id, count(DISTINCT type) AS blocks, string_agg(data, '' ORDER BY ascii(type), ascii(right(type, 1)), seq) AS text FROM {_LOG} GROUP BY session_id")
def block_assembly(spark, sf_dir):
    """Deltas of a block for each type, in the order of their blocks."""
    index = F.ascii("type") * 1000 + F.ascii(F.right("type", F.lit(1)))
    data = F.to_json(F.struct(F.lit("text-delta").alias("kind"), index.alias("index"), F.col("data").alias("text")))
    states = projections.fold(session_events(spark, sf_dir).withColumn("data", data).withColumn("type", F.lit("assistant/chunk")), [folds.BLOCKS])
    blocks = F.map_entries(F.from_json("val", "blocks map<string, struct<texts: array<string>>>")["blocks"])
    ordered = F.array_sort(F.transform(blocks, lambda b: F.struct(b["key"].cast("int").alias("k"), F.array_join(b["value"]["texts"], "").alias("t"))))
    return states.select("session_id", F.size(blocks).cast("bigint").alias("blocks"), F.array_join(ordered["t"], "").alias("text"))


@query(f"SELECT session_id, string_agg(CAST(seq AS VARCHAR) || ':' || coalesce(CAST(request AS VARCHAR), ''), ',' ORDER BY seq) AS failed FROM (SELECT *, max(seq) FILTER (WHERE type = 'view') OVER (PARTITION BY session_id, seq // 8 ORDER BY seq) AS request FROM {_LOG}) WHERE type = 'error' GROUP BY session_id")
def request_failures(spark, sf_dir):
    """An error belongs to the last request of its turn."""
    turn = F.floor(F.col("seq") / 8).cast("string")
    kind = F.when(F.col("type") == "view", "assistant/message").when(F.col("type") == "error", "turn/end").otherwise("other")
    log = session_events(spark, sf_dir).withColumn("data", F.concat(F.lit('{"reason":{"kind":"error"},"turn":'), turn, F.lit("}"))).withColumn("type", kind)
    failed = F.from_json("val", "failed array<array<bigint>>")["failed"]
    shown = F.array_join(F.transform(failed, lambda f: F.concat(f[0].cast("string"), F.lit(":"), F.coalesce(f[1].cast("string"), F.lit("")))), ",")
    return projections.fold(log, [folds.FAILURES]).select("session_id", shown.alias("failed")).where("failed <> ''")


@query(f"SELECT session_id, seq, start, CASE WHEN seq % 2 = 0 THEN start + CAST(floor(value) AS BIGINT) ELSE start END AS \"end\" FROM (SELECT *, time AS start FROM {_LOG})")
def timed_cells(spark, sf_dir):
    """Cells with a length or without one, as spans."""
    cells = session_events(spark, sf_dir).select("session_id", "seq", F.col("time").alias("start"), F.when(F.col("seq") % 2 == 0, F.floor("value")).alias("duration"))
    return w.timed_spans(cells, "actual").select("session_id", "seq", "start", "end")


@query(f"SELECT type, count(*) AS n FROM {_LOG} WHERE regexp_matches(type, '^(s.*p|.*ror)$') GROUP BY type")
def hook_pattern(spark, sf_dir):
    from ..operators.filters import matches_hook

    return session_events(spark, sf_dir).where(matches_hook(F.col("type"), "^(s.*p|.*ror)$")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT session_id, seq, length(text) AS bytes FROM (SELECT *, max(seq) OVER (PARTITION BY session_id) AS last, sum(strlen(text)) OVER (PARTITION BY session_id) AS total, coalesce(sum(CASE WHEN seq % 4 > 0 THEN strlen(text) ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM {_CONV}) WHERE seq % 4 = 0 OR seq = last OR older >= total - 100000")
def retained_messages(spark, sf_dir):
    """Conversations within a hundred thousand bytes; every fourth message is a checkpoint."""
    rows = conversation_log(spark, sf_dir).select("session_id", "seq", (F.col("seq") % 4 == 0).alias("checkpoint"), "text")
    return n.retained(rows, 100_000).select("session_id", "seq", F.length("text").cast("bigint").alias("bytes"))


@query(f"SELECT session_id, CAST(sum(output) AS BIGINT) AS output FROM {_STEPS} GROUP BY session_id")
def without_duplicates(spark, sf_dir):
    """Steps, of which none may stand twice: it would be an error."""
    return j.unique_rows(_steps(spark, sf_dir), ["session_id", "turn", "step"], "a step").groupBy("session_id").agg(F.sum("output").alias("output"))


@query(f"SELECT session_id, type, count(*) AS n FROM {_LOG} GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    """Types that a session has more than once."""
    return j.duplicates(session_events(spark, sf_dir), ["session_id", "type"])


@query(f"SELECT session_id, 'g' || (max(seq) - max(seq) % 4) AS goal, CASE WHEN max(seq) % 4 = 0 THEN 'active' ELSE 'complete' END AS phase, CAST(CASE WHEN max(seq) % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS revision, max(seq) // 4 + 1 AS goals FROM {_LOG} GROUP BY session_id")
def goal_fold(spark, sf_dir):
    """A goal is made at every fourth row and completed at the next."""
    seq = F.col("seq")
    made = seq - seq % 4
    goal = F.struct(F.concat(F.lit("g"), made.cast("string")).alias("id"), (seq % 4 + 1).alias("revision"), F.when(seq % 4 == 0, "active").otherwise("complete").alias("phase"), F.lit(3).alias("maxGoalRounds"))
    data = F.to_json(F.struct(F.when(seq % 4 == 0, "create").otherwise("complete").alias("operation"), goal.alias("goal"), F.lit(0).alias("roundsStarted"), made.alias("createdAt"), seq.alias("updatedAt")))
    kind = F.when(seq % 4 < 2, "goal/change").otherwise("turn/start")
    states = projections.fold(session_events(spark, sf_dir).withColumn("data", data).withColumn("type", kind), [folds.GOALS])
    state = F.from_json("val", "goal struct<id: string, phase: string, revision: bigint>, ids array<string>")
    return states.select("session_id", state["goal"]["id"].alias("goal"), state["goal"]["phase"].alias("phase"), state["goal"]["revision"].alias("revision"), F.size(state["ids"]).cast("bigint").alias("goals"))
