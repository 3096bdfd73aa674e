"""Operators without a registered query, on small tables."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import events as e
from eventloom.functions import text as x
from eventloom.operators import joins, metrics, ordering, sessions, trees, windows
from eventloom.streaming import projections


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_export_takes_descendants_and_each_medium_once(spark):
    s = spark.createDataFrame([("a", 0, None), ("b", 1, "a"), ("c", 2, None)], "id string, created_at int, parent string")
    log = spark.createDataFrame([("a", 0, ["m1"]), ("b", 0, ["m1", "m2"]), ("c", 0, ["m3"])], "session_id string, seq int, media array<string>")
    media = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("m3",)], "media_id string")
    out, used = sessions.export(s, log, media, "a")
    assert sorted(rows(out, "session_id")) == [("a",), ("b",)] and sorted(rows(used, "media_id")) == [("m1",), ("m2",)]
    assert rows(sessions.export(s, log, media, "a", with_descendants=False)[0], "session_id") == [("a",)]


def test_telemetry_sends_first_chunks_after_the_cursor(spark):
    log = spark.createDataFrame([("a", k, "assistant/chunk" if k in (1, 2) else "x", 1, 1, "secret") for k in range(4)], "session_id string, seq int, type string, turn int, step int, data string")
    sent = spark.createDataFrame([("a", 0)], "session_id string, cursor int")
    got = sessions.telemetry(log, sent, [lambda d: F.replace(d, F.lit("secret"), F.lit("*"))])
    assert sorted(rows(got, "seq", "data")) == [(1, "*"), (3, "*")]


def test_state_stores(spark):
    changes = spark.createDataFrame([("s", "k", 1, "a"), ("s", "k", 3, "c"), ("s", "k", 2, "b")], "session_id string, key string, seq bigint, value string")
    assert rows(projections.latest_values(changes), "value", "seq") == [("c", 3)] and rows(projections.snapshot(changes, 2), "value") == [("b",)]
    held = spark.createDataFrame([("s", "k", 1, 5, "v", 7, "/x"), ("t", "k", 2, 6, "w", 7, None)], "session_id string, key string, ver int, seq bigint, val string, created_at bigint, cwd string")
    assert rows(projections.stale_view(held, {"k": 1}), "session_id", "as_of") == [("s", 5)]
    now = spark.createDataFrame([("s", 7, "/y"), ("t", 7, None)], "id string, created_at bigint, cwd string")
    assert rows(projections.same_lifecycle(held, now), "session_id") == [("t",)]


def test_time_modes(spark):
    cells = spark.createDataFrame([("s", 0, 10), ("s", 100, 5), ("s", 102, None), ("s", None, 3)], "session_id string, start bigint, duration bigint")
    got = lambda m: sorted(rows(windows.timed_spans(cells, m), "start", "end"))
    assert got("time") == [(0, 0), (100, 100), (102, 102)] and got("actual") == [(0, 10), (100, 105), (102, 102)] and got("duration") == [(0, 10), (10, 15), (12, 12)]
    with pytest.raises(ValueError):
        windows.timed_spans(cells, "other")


def test_headers_and_schemas_in_force(spark):
    log = spark.createDataFrame([("s", 0, "step/start", "h0", None), ("s", 1, "step/end", "h1", "t"), ("t", 0, "step/end", "h0", None), ("t", 1, "step/start", "h2", "u")], "session_id string, seq int, type string, header string, call string")
    assert rows(sessions.provider_in_force(log, F.col("header")), "session_id", "header") == [("t", "h2")]
    tools = F.when(F.col("seq") == 0, F.array(F.struct(F.lit("t").alias("name"), F.lit("S").alias("schema"))))
    assert sorted(rows(trees.knobs(log, tools, F.col("call")), "session_id", "schema"), key=repr) == [("s", "S"), ("t", None)]


def test_orders(spark):
    jobs = spark.createDataFrame([(1, 5, None), (2, 3, None), (3, 1, 9), (4, 2, 10)], "id int, started int, finished int")
    assert rows(sessions.job_order(jobs), "id") == [(2,), (1,), (4,), (3,)]
    names = spark.createDataFrame([("z",), ("b",), ("a",), ("m",)], "name string")
    assert rows(ordering.configured(names, ["m", "...", "a"], "name"), "name") == [("m",), ("b",), ("z",), ("a",)]
    with pytest.raises(ValueError):
        ordering.configured(names, ["m"], "name")
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "k int, size int")
    assert rows(sessions.byte_capped(groups, "k", F.col("size"), 20), "k") == [(1,), (2,)] and rows(sessions.byte_capped(groups, "k", F.col("size"), 1), "k") == [(1,)]
    ids = spark.createDataFrame([("-y", 1), ("B", 1), ("_x", 1), ("a", 2)], "id string, created_at int")
    assert [r[0] for r in rows(ordering.by_creation(ids), "id")] == ["a", "_x", "-y", "B"]


def test_sets(spark):
    s = spark.createDataFrame([(["a", "b"],), (["a", "a"],)], "v array<string>")
    with pytest.raises(Exception, match="repeats"):
        s.select(joins.no_duplicates(F.col("v"), "a tag")).collect()
    ids = spark.createDataFrame([(1, "g", 0)], "id int, `group` string, position int")
    assert sorted(rows(joins.group_members(ids, spark.createDataFrame([(1,), (2,)], "id int")), "id", "group")) == [(1, "g"), (2, "ungrouped")]
    with pytest.raises(Exception, match="differ"):
        joins.overlay(spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y")], "id int, v string"), immutable=["v"]).collect()
    w = spark.createDataFrame([("a", "/x"), ("b", "/x"), ("c", None)], "id string, cwd string")
    assert sorted(rows(metrics.by_workspace(w, "b"), "cwd", "n", "has_current"), key=repr) == [("/x", 2, True), (None, 1, False)]


def test_memories_and_facts_round_trip(spark):
    from eventloom.sources import tables

    text = "# One\nId: memory-1\nKeywords: a, b\nRecorded: today\nOutcome: success\n\nbody\n# Two\nId: memory-2\n\nmore\n"
    held = tables.memories(spark.createDataFrame([(text,)], "text string"))
    again = "".join(r.text for r in tables.memory_records(held).orderBy("position").collect())
    back = tables.memories(spark.createDataFrame([(again,)], "text string"))
    assert rows(back.orderBy("position"), *held.columns) == rows(held.orderBy("position"), *held.columns)
    facts = spark.createDataFrame([("/x", "b", "2"), ("/x", "a", "1")], "cwd string, title string, body string")
    stored = tables.facts_json(facts)
    assert sorted(rows(tables.facts(stored), "title", "body")) == [("a", "1"), ("b", "2")]


def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("v")).first().v
    assert tuple(one(x.slash_command(F.col("t")), t="/plan  do it ")) == ("plan", "do it") and one(x.slash_command(F.col("t")), t="plan").name is None
    assert one(x.exit_status(F.col("t")), t="exited with code -3") == -3 and one(x.base_name(F.col("t")), t="/a/b/") == "b" and one(x.top_level(F.col("t")), t="./src/a.py") == "src"
    assert one(x.relative_to(F.col("t"), "/a"), t="/a/b/c") == "b/c" and one(x.file_name(F.col("t")), t=' a/b:c?. ') == "a_b_c_"
    assert one(x.mentions(F.col("t")), t="see session://a%20b and session://a%20b") == ["a b"] and one(x.session_of_uri(x.session_uri(F.col("t"))), t="ü b") == "ü b"
    assert one(x.charset(F.col("t")), t='text/html; charset="UTF-8"') == "utf-8" and one(x.media_type(F.col("t")), t=" Text/HTML ; x") == "text/html"
    assert one(x.without_ansi(F.col("t")), t="\x1b[31mred\x1b[0m") == "red" and one(x.id_number(F.col("t"), "memory"), t="memory-12") == 12
    assert one(x.local_instant(F.to_timestamp("t"), F.col("z")), t="2024-03-31 02:30:00", z="Europe/Berlin") is None
    assert str(one(x.local_instant(F.to_timestamp("t"), F.col("z")), t="2024-07-01 12:00:00", z="Europe/Berlin")) == "2024-07-01 10:00:00"
    assert one(x.keywords(F.split("t", ",")), t=" A,b,, a ") == ["a", "b"] and one(x.fts_phrase(F.col("t")), t='a"b') == '"a""b"'
    assert one(e.lossless(F.col("t")), t='{"a": 1}') is True and one(e.lossless(F.col("t")), t="{") is False
    assert one(e.same_header(F.col("a"), F.col("b")), a='{"system":"","tools":[]}', b="{}") is True
    refs = spark.createDataFrame([("s", '{"content":[{"type":"image","ref":"m1"},{"type":"image","ref":"m1"}]}')], "session_id string, data string")
    assert rows(e.image_refs(refs), "media_id") == [("m1",)]


def test_merged_hooks_give_the_reasons_that_won(spark):
    given = [("a", 3, "deny", "late", None, None), ("a", 0, "allow", "fine", "s0", "c0"), ("a", 1, "deny", "early", "s1", None), ("a", 2, "deny", None, None, "c2"), ("b", 0, "ask", None, None, None), (None, 1, "allow", "y", None, None), (None, 0, "allow", "x", None, None)]
    results = spark.createDataFrame(given, "event string, position int, decision string, reason string, stop string, context string").repartition(3)
    got = metrics.merge_hooks(results)
    assert set(rows(got, "event", "decision", "reason", "stop", "contexts")) == {("a", "deny", "early\nlate", "s0", 2), ("b", "ask", None, None, 0), (None, "allow", "x\ny", None, 0)}


def test_text_columns_hold_small_batches(spark):
    from eventloom.functions.pandas_text import BATCH_BYTES, column

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table = spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.repeat(F.lit("é"), 100), F.col("id").cast("string"))).alias("t"))
    got = table.select("id", column(str.upper, "string")("t").alias("u"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES
    assert rows(got.orderBy("id"), "id", "u") == [(k, "É" * 100 + str(k) if k % 7 else None) for k in range(300)]
    assert rows(got.where("id < 0"), "u") == []
