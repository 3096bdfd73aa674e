"""Golden cases of the text rules, the folds and the lookups."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions import pandas_text as p
from eventloom.functions import text as x
from eventloom.operators import filters as f
from eventloom.operators import joins, metrics, ordering, surface, traces
from eventloom.streaming import folds, projections
from eventloom.streaming.schedules import dispatch


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "a int")
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "most", "want"),
    [("  short\ntext  ", 20, "short text"), ("abcde[f]", 1, "…"), ("abcdefghij", 5, "abcd…"), ("ab[c]defghij", 5, "…bcd…"), ("ab[c]defghij", 3, "…c…"), ("abcde[f]", 2, "…f"), ("abcde[f]", 5, "…cdef"), ("  x—[café]\n y  ", 20, "x—café y")],
)
def test_snippet(text, most, want):
    assert p.snippet(text.replace("[", p.OPEN).replace("]", p.CLOSE), most) == want


def test_titles(spark):
    title = x.clean_title(F.col("t"))
    assert one(spark, title, t="\x1b]0;stolen\x07  Hello\t brave\nnew world  ") == "Hello brave new world"
    assert one(spark, x.first_words(F.col("t"), 3), t="one two three four") == "one two three"
    assert p.cut_bytes("你好世界", 7) == "你好" and len(p.cut_bytes("😀😀", 5).encode()) == 4


def test_white_space_rules(spark):
    assert one(spark, x.collapse(F.col("t")), t="﻿ a 　b\u0085c ") == "a b\u0085c"
    assert one(spark, f.literal_text(F.col("t"), "hello   (ai)+"), t="Hello\n(AI)+") is True
    assert one(spark, x.utf16_length(F.col("t")), t="a😀") == 3


def test_token_prices(spark):
    assert one(spark, x.text_tokens(F.col("t")), t="abcd") == 5
    assert one(spark, x.text_tokens(F.col("t")), t="abcdefgh") == 6
    assert one(spark, x.call_tokens(F.col("n"), F.col("a")), n="bash", a='{"a":1}') == 7
    assert one(spark, x.message_tokens(F.array(x.text_tokens(F.col("t")))), t="abcd") == 9


def test_predicates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, cwd string")
    got = lambda c: [r.id for r in rows.where(c).orderBy("id").collect()]
    cwd = F.col("cwd")
    assert got(f.one_of(cwd, [])) == [] and got(f.one_of(cwd, [None])) == [2] and got(f.one_of(cwd, ["a", None])) == [1, 2]
    assert got(f.within(F.col("id"))) == [1, 2, 3] and got(f.within(F.col("id"), 1.5, 3)) == [2, 3]
    for bad in (lambda: f.within(cwd, float("nan")), lambda: f.within(cwd, 3, 2), lambda: f.available(cwd, cwd, ["gone"]), lambda: f.literal_text(cwd, " \n"), lambda: f.EventFilter(surfaces=["x"]).column()):
        with pytest.raises(f.FilterError):
            bad()


def test_keyword_top_k(spark):
    rows = spark.createDataFrame([(1, ["encoding"]), (2, ["typescript", "encoding", "windows"]), (3, ["typescript", "encoding"]), (4, ["python"])], "position int, keywords array<string>")
    top = lambda q, k: [r.position for r in ordering.keyword_top_k(rows, q, k).collect()]
    assert top(["typescript", "encoding", "windows"], 3) == [1, 2, 3] and top(["typescript", "encoding"], 2) == [2, 3] and top(["rust"], 2) == []


def test_lineage(spark):
    rows = [("root", 0, None), ("parent", 1, "root"), ("target", 2, "parent"), ("b", 4, "target"), ("a", 4, "target"), ("older", 3, "target"), ("grandchild", 5, "a")]
    s = spark.createDataFrame(rows, "id string, created_at int, parent string")
    assert [r.ancestor for r in traces.ancestors(s, "target").collect()] == ["parent", "root"]
    tree = traces.descendants(s, "target").orderBy("path").collect()
    assert [(r.id, r.depth) for r in tree] == [("older", 1), ("a", 1), ("grandchild", 2), ("b", 1)]
    assert {r.id: r.descendants for r in traces.rollup(s, F.lit(True)).collect()}["root"] == 6
    loop = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a")], "id string, created_at int, parent string")
    with pytest.raises(Exception, match="cycle"):
        traces.ancestors(loop, "a").collect()


LOG = "session_id string, seq bigint, type string, time bigint, data string, source_event_seqs array<bigint>, surface_op struct<op: string, start: bigint, end: bigint>"


def test_surface(spark):
    rows = [("s", 0, "user/message", 10, None, None, ("append", None, None)), ("s", 1, "assistant/chunk", 11, None, None, None), ("s", 2, "assistant/message", 12, None, [0], ("replace", 0, 0)), ("s", 3, "turn/end", 13, None, None, None)]
    folded = surface.fold(spark.createDataFrame(rows, LOG))
    assert [r.surface for r in folded.orderBy("seq").collect()] == ["shadowed", "log-only", "current", "log-only"]
    for bad in (("s", 4, "user/message", 1, None, None, ("append", None, None)), ("s", 1, "user/message", 1, None, None, None), ("s", 1, "user/message", 1, None, [], ("replace", 0, 0)), ("s", 1, "user/message", 1, None, [0], ("replace", 7, 7))):
        log = spark.createDataFrame([rows[0], bad], LOG)
        assert surface.fold(log, strict=False).where("error is null").count() == 0
        with pytest.raises(Exception, match="row"):
            surface.fold(log).collect()


def test_replacement_chain(spark):
    append, n = ("append", None, None), "user/message"
    ops = [append, append, append, append, ("replace", 3, 3), append, append, append, ("replace", 2, 4)]
    sources = [None, None, None, [2], [3, 2], None, None, None, [2, 4]]
    rows = [("s", k, n, k, None, s, o) for k, (o, s) in enumerate(zip(ops, sources, strict=True))]
    log = spark.createDataFrame(rows, LOG)
    chains = {r.seq: r.chain for r in traces.replacement_chains(surface.fold(log)).collect()}
    assert chains == {3: [4, 8], 4: [8], 2: [8]}
    assert {r.seq: r.derived for r in traces.derived(log).collect()} == {2: [3, 4, 8], 3: [4], 4: [8]}


@pytest.mark.parametrize(
    ("samples", "want"),
    [
        ([(1, 1, 10, 4, 7, 2)] * 2, (10, 4, 7, 2)),
        ([(1, 1, 10, 2, 3, None), (1, 1, 14, 5, 8, 1)], (14, 5, 8, 1)),
        ([(1, 1, 10, 6, 2, None)] * 2 + [(1, 2, 20, 9, None, 4)] * 2, (30, 15, 2, 4)),
        ([(1, 1, 5, 0, 0, 0), (1, 2, 7, 0, 0, 0), (1, 1, 5, 0, 0, 0)], (17, 0, 0, 0)),
    ],
)
def test_usage(spark, samples, want):
    rows = [("s", k, *s) for k, s in enumerate(samples)]
    got = metrics.usage_totals(spark.createDataFrame(rows, "session_id string, seq int, turn int, step int, input int, output int, cache_read int, cache_write int")).first()
    assert tuple(got)[1:] == want


def test_turn_metrics(spark):
    steps = spark.createDataFrame([("s", 1, 2, 10000, 10200, 12200, 60), ("s", 1, 1, 1000, 2200, 5200, 40)], "session_id string, turn int, step int, start int, first_token int, end int, output int")
    got = metrics.turn_metrics(steps).first()
    assert (got.ttft, got.tokens_per_second) == (1200, 20.0)


def test_tool_pairing(spark):
    calls = spark.createDataFrame([("s", 1, "a", 1, 1100), ("s", 1, "b", 2, 1200)], "session_id string, turn int, call_id string, seq int, time int")
    results = spark.createDataFrame([("s", 1, "b", 3, 4200), ("s", 1, "a", 4, 1600), ("s", 1, "ghost", 5, 5000)], calls.schema)
    assert sum(r.duration for r in joins.paired_calls(calls, results).collect()) == 3500


def test_restore_floor():
    live = {"a": 1, "b": 1}
    floor = projections.restore_floor
    assert floor({}, {}) is None and floor(live, {}) == 0
    assert floor(live, {"a": (1, 10), "b": (1, 5)}) == 5 and floor(live, {"a": (1, 10), "b": (2, 5)}) == 0 and floor(live, {"a": (1, -1), "b": (1, -1)}) == 0


def test_recurrence(spark):
    at = lambda m, s=0: (12 * 60 + m) * 60_000 + s * 1000
    for now, last, following in ((at(5), at(5), at(10)), (at(17, 34), at(15), at(20)), (at(1), None, at(5))):
        row = spark.createDataFrame([(now,)], "now bigint").select(x.last_occurrence(F.lit(at(5)), F.lit(300_000), F.col("now")).alias("a"), x.next_occurrence(F.lit(at(5)), F.lit(300_000), F.col("now")).alias("b")).first()
        assert (row.a, row.b) == (last, following)


def test_dispatch(spark):
    rows = [("e1", "every", 100, 50, 0), ("e2", "every", 300, 50, 1), ("a", "at", 120, None, 2), ("b", "at", 110, None, 3)]
    s = spark.createDataFrame(rows, "id string, kind string, target bigint, interval bigint, position int")
    now = F.lit(270).cast("bigint")
    assert [r.id for r in dispatch(s, now).collect()] == ["b"]
    assert [(r.id, r.due, r.next) for r in dispatch(s.where("kind = 'every'"), now).collect()] == [("e1", 250, 300)]


def apply(projection, events):
    state = projection.init()
    for seq, (kind, time, data) in enumerate(events):
        state = projection.apply(state, {"seq": seq, "type": kind, "time": time, "data": json.dumps(data)})
    return projection.view(state)


def logged(spark, events, session="s"):
    return spark.createDataFrame([(session, k, kind, time, json.dumps(data)) for k, (kind, time, data) in enumerate(events)], "session_id string, seq bigint, type string, time bigint, data string")


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("turn/start", 5), ("subagent/descriptor", 8), ("turn/end", 20), ("turn/start", 30), ("x", 33)], (15, 30, 33)),
        ([("subagent/descriptor", 1), ("turn/start", 5), ("turn/end", 9), ("turn/start", 10), ("turn/end", 8)], (4, None, None)),
        ([("turn/start", 1), ("turn/end", 4), ("subagent/descriptor", 5), ("turn/end", 9)], (0, None, None)),
        ([("subagent/descriptor", 1), ("turn/start", 2), ("turn/end", 7), ("turn/start", 8), ("subagent/descriptor", 9)], (0, 8, 9)),
        ([("subagent/descriptor", 1), ("turn/start", 2)], (0, 2, 2)),
    ],
)
def test_subagent_timing(spark, events, want):
    got = metrics.subagent_timing(logged(spark, [(k, t, {}) for k, t in events]).unionByName(logged(spark, [("turn/start", 1, {})], "none"))).collect()
    assert [tuple(r)[1:] for r in got] == [want]


def test_consumed_work(spark):
    claim, end = ("agent/inbox/spliced", 0, {"removedCount": 1, "inserted": []}), lambda r: ("turn/end", 0, {"turn": 1, "reason": {"kind": r}})
    start = ("turn/start", 0, {"turn": 1})
    dropped = ("agent/inbox/spliced", 0, {"removedCount": 1, "outcome": "canceled", "inserted": []})
    replaced = ("agent/inbox/spliced", 0, {"removedCount": 1, "outcome": "canceled", "inserted": [{"id": "a"}]})
    cases = [
        ([start, claim, end("completed")], (None, False)), ([start, claim, end("aborted")], (2, False)), ([start, ("step/start", 0, {"turn": 1}), end("completed"), dropped], (2, True)),
        ([dropped, start, ("step/start", 0, {"turn": 1}), end("error")], (3, False)), ([start, end("aborted"), claim], (None, False)), ([start, end("completed"), replaced], (None, False)), ([dropped], (None, True)),
    ]
    for events, want in cases:
        assert tuple(metrics.consumed_work(logged(spark, events)).first())[1:] == want


def test_anchored_measurement(spark):
    surface_rows = spark.createDataFrame([("s", 1, 10), ("s", 3, 5), ("s", 5, -8), ("s", 7, 4), ("t", 0, 3)], "session_id string, seq bigint, delta bigint")
    samples = spark.createDataFrame([("s", 2, 30, "a"), ("s", 4, 12, "a")], "session_id string, seq bigint, used bigint, header string")
    headers = spark.createDataFrame([("s", 0, "a", 7), ("s", 6, "b", 9)], "session_id string, seq bigint, header string, tokens bigint")
    got = {(r.session_id, r.seq): (r.baseline, r.tokens, r.measured) for r in metrics.anchored(samples, surface_rows, headers).collect()}
    # Counted 30 where 17 were estimated; counted 12 where 22 were; then another header, so the estimate.
    assert got == {("s", 1): (None, 17, False), ("s", 3): (30, 35, True), ("s", 5): (22, 14, True), ("s", 7): (None, 20, False), ("t", 0): (None, 3, False)}


def test_failures_and_schedules():
    start, message, end = ("compaction/start", 0, {}), lambda t: ("assistant/message", 0, {"turn": t}), lambda t, r="error": ("turn/end", 0, {"turn": t, "reason": {"kind": r}})
    got = apply(folds.FAILURES, [message(1), start, start, message(1), end(1), message(2), end(2, "completed"), end(3)])
    assert got == {"failed": [[4, 3], [7, None]], "interrupted": [2, 1]}
    assert apply(folds.FAILURES, [start, ("compaction/end", 0, {}), end(1, "interrupted")])["interrupted"] == []
    every, once = ("schedule/created", 0, {"id": "e", "kind": "every", "target": 100, "interval": 50}), ("schedule/created", 0, {"id": "o", "kind": "at", "target": 10})
    run = lambda i, t: ("schedule/dispatched", t, {"id": i})
    assert apply(folds.SCHEDULES, [every, once, run("e", 270), run("o", 11)]) == {"e": {"kind": "every", "target": 300, "interval": 50}}
    assert apply(folds.SCHEDULES, [every, ("schedule/deleted", 0, {"id": "e"})]) == {}
    for bad in ([every, every], [every, run("e", 99)], [run("x", 1)]):
        with pytest.raises(folds.FoldError):
            apply(folds.SCHEDULES, bad)


def test_inbox_and_goals():
    put = lambda t, s, n, *ids: ("agent/inbox/spliced", 0, {"target": t, "start": s, "removedCount": n, "inserted": [{"id": i} for i in ids]})
    assert apply(folds.INBOX, [put("next-turn", 0, 0, "a", "b"), put("next-turn", 1, 1, "c")])["next-turn"] == [{"id": "a"}, {"id": "c"}]
    for bad in ([put("next-turn", 1, 0, "a")], [put("next-turn", 0, 0, "a"), put("next-step", 0, 0, "a")]):
        with pytest.raises(folds.FoldError):
            apply(folds.INBOX, bad)
    goal = lambda r, phase="active", **k: {"id": "g", "revision": r, "phase": phase, "maxGoalRounds": 2, "objective": "o", **k}
    change = lambda op, g, rounds=0, at=1: ("goal/change", 0, {"operation": op, "goal": g, "roundsStarted": rounds, "createdAt": 1, "updatedAt": at})
    started = ("user/message", 0, {"source": {"kind": "goal", "goalId": "g", "revision": 1, "round": 1}})
    got = apply(folds.GOALS, [change("create", goal(1)), started, change("pause", goal(2, "paused"), 1), change("resume", goal(3), 1)])
    assert got["roundsStarted"] == 1 and got["goal"]["revision"] == 3
    for bad in ([change("pause", goal(1))], [change("create", goal(1)), change("pause", goal(3, "paused"))], [change("create", goal(1)), change("pause", goal(2, "paused", objective="x"))], [change("create", goal(1)), started, started]):
        with pytest.raises(folds.FoldError):
            apply(folds.GOALS, bad)


def test_blocks():
    d = lambda **k: ("assistant/chunk", 0, k)
    events = [d(kind="text-delta", index=0, text="a"), d(kind="text-delta", index=0, text="b"), d(kind="block-end", index=0), d(kind="text-delta", index=0, text="late"), d(kind="tool-call-delta", index=1, text="{"), d(kind="finish", reason="max-tokens")]
    assert apply(folds.BLOCKS, events)["content"] == [{"type": "text", "text": "ab"}]


def test_byte_retention_and_paths():
    assert p.keep_bytes("abcdef", 4, "both") == ("ab", "ef", 2) and p.keep_bytes("你好", 4) == ("你", "", 3) and p.keep_bytes("你好", 4, "tail") == ("", "好", 3)
    assert p.path_segment("a b") == "a~0020b" and p.path_segment(".x") == "~002Ex" and p.path_segment("a~") != p.path_segment("a~007E")
    assert p.phrase_spans("a a a b".split(), ["a", "a"]) == 1 and p.fold("Café ＡＢ") == ["cafe", "ａｂ"]
    assert p.canonical('{"b": 1, "a": 2}') == p.canonical('{"a":2,"b":1}') and p.canonical("{") is None
    assert p.fuzzy_score("ab", "xyz") is None and p.fuzzy_score("oc", "open-chat") > p.fuzzy_score("oc", "rococo")
    assert p.fuzzy_score("oc", "open-chat") == 9 + 9 - 4 and p.fuzzy_score("oc", "rococo") == 1 - 1 + 1 + 4 and p.fuzzy_score("b", "a.b") == 1 - 2
    assert p.unified_diff("a\nb", "a\nc") == "@@ -1,2 +1,2 @@\n a\n-b\n+c"


def test_markdown():
    assert p.markdown("<h1>T</h1><p>a <b>b</b> <a href='/x'>l</a></p><script>no()</script><ul><li>1<li>2</ul>") == "# T\n\na **b** [l](/x)\n\n- 1\n- 2"
    assert "deep" in p.markdown("<div>" * 3000 + "deep" + "</div>" * 3000)


def test_event_text(spark):
    from eventloom.functions import events as e

    blocks = [{"type": "text", "text": " hi "}, {"type": "reasoning", "text": "no"}, {"type": "tool-call", "name": "bash", "arguments": "{}"}, {"type": "tool-result", "content": [{"type": "text", "text": "out"}]}]
    cases = [
        ("user/message", {"content": blocks}, "hi\nbash\n{}\nout"), ("assistant/message", {"message": {"content": blocks[:2]}}, "hi"), ("tool/call", {"name": "n", "arguments": "a"}, "n\na"),
        ("tool/result", {"message": {"content": blocks[:1]}, "error": {"name": "E", "code": None}}, "hi\nE"), ("todo/write", {"todos": [{"status": "done", "content": "x"}]}, "done\nx"),
        ("turn/end", {"reason": {"kind": "error", "error": {"message": "m"}}}, "error\nm"), ("turn/end", {"reason": {"kind": "interrupted"}}, "interrupted"), ("turn/end", {"reason": {"kind": "completed"}}, ""), ("unknown", {}, ""),
    ]
    rows = spark.createDataFrame([(k, t, json.dumps(d)) for k, (t, d, _) in enumerate(cases)], "seq int, type string, data string")
    got = rows.select("seq", e.event_text(F.col("type"), F.col("data")).alias("t")).orderBy("seq").collect()
    assert [r.t for r in got] == [w for _, _, w in cases]
    assert e.documents(rows).count() == 7
    prices = spark.createDataFrame([(json.dumps([{"type": "text", "text": "abcd"}, {"type": "tool-result", "content": [{"type": "text", "text": "abcd"}]}]),)], "b string").select(e.block_tokens(F.col("b")).alias("p"), e.text_length(F.col("b")).alias("n")).first()
    assert prices.p == [5, 9] and prices.n == 4
    keys = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ('{"a":1,"z":2}',), ('{"b":1}',)], "d string").select(e.exact_keys(F.col("d"), ["a"], ["b"]).isNotNull().alias("ok")).collect()
    assert [r.ok for r in keys] == [True, True, False, False]


def test_requests():
    from eventloom.functions import requests as q

    assert q.instant("2024-02-29T12:00Z").ms == 1709208000000 and q.instant("2024-01-01T00:00:00.0005+01:00") == q.Instant(1704063600000, "5")
    low, high = q.time_range("1970-01-01T00:00:00.0015Z", "1970-01-01T00:00:00.0015Z")
    assert 1 < low < 1.000001 and 1.999999 < high < 2
    for bad in ("2024-02-30T00:00Z", "2024-01-01T00:00", "2024-01-01T25:00Z", "2024-01-01T00:00+01:75"):
        with pytest.raises(q.TimeError):
            q.instant(bad)
    with pytest.raises(q.TimeError):
        q.time_range("2024-01-02T00:00Z", "2024-01-01T00:00Z")
    schema = {"type": "object", "fields": {"key": {"secret": True}, "list": {"type": "array", "inner": {"type": "object", "fields": {"p": {"secret": True}}}}}}
    assert q.redact(schema, {"key": "x", "a": 1, "list": [{"p": 1, "q": 2}]}) == ({"a": 1, "list": [{"q": 2}]}, [(("key",), True), (("list", "0", "p"), True)])
    assert q.inline("short", 10, "f") == "short" and len(q.inline("x" * 500, 100, "f").encode()) <= 100 and q.inline("x" * 30, 20, "f" * 30) == "x" * 30
    nested = {"type": "dict", "inner": {"type": "array", "inner": {"secret": True}}}
    assert q.redact(nested, {"a": [1, None], "b": 3}) == ({"a": [None, None], "b": 3}, [(("a", "0"), True), (("a", "1"), False)])
    assert q.redact({"secret": True}, "x") == (None, [((), True)]) and q.redact(None, {"a": 1}) == ({"a": 1}, []) and q.redact(schema, "odd")[0] == "odd"
    pages = {None: ([1, 2, 3], 1), 1: ([4, 5], None)}
    assert q.collect_pages(pages.get, lambda r: r % 2, 2) == ([1, 3], True) and q.collect_pages(pages.get, lambda r: r > 3, 9) == ([4, 5], False)
    import re

    assert re.match(q.wildcard("a.*c"), "a.bbc") and not re.match(q.wildcard("a.*c"), "aXbc")


def test_trees(spark):
    from eventloom.operators import trees

    rows = [(1, None, "x"), (2, 1, "subagent"), (3, 1, "y"), (4, 3, "subagent"), (5, 99, "x"), (6, 7, "x"), (7, 6, "x")]
    flat = trees.flatten(spark.createDataFrame(rows, "id int, parent int, origin string"), F.col("id")).cache()
    assert {r.id: (r.root, r.depth) for r in flat.collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    assert [r.id for r in trees.of_origin(flat, 1, "subagent").collect()] == [2, 4]
    assert [r.id for r in trees.post_order(flat.where("root = 1")).collect()] == [4, 2, 3, 1]
    starts = spark.createDataFrame([("a", None, 1), ("b", "a", 2)], "call_id string, parent string, seq int")
    ends = spark.createDataFrame([("b", "ok", 3), ("b", "late", 4)], "call_id string, outcome string, seq int")
    assert {r.call_id: (r.state, r.depth) for r in trees.call_tree(starts, ends).collect()} == {"a": ("running", 0), "b": ("ok", 1)}


def test_pressure_and_breakdown(spark):
    samples = spark.createDataFrame([("s", 1, 10, 5, None, 100), ("s", 4, 20, None, 2, None)], "session_id string, seq int, input int, cache_read int, cache_write int, window int")
    surface_rows = spark.createDataFrame([("s", 0, 7), ("s", 4, 3), ("s", 5, -30)], "session_id string, seq int, delta int")
    got = metrics.projected_pressure(samples, surface_rows).first()
    assert (got.pressure, got.window, got.projected) == (22, None, 0)
    headers = spark.createDataFrame([("s", 0, 6, 0), ("s", 3, 8, 2)], "session_id string, seq int, system int, tools int")
    assert tuple(metrics.breakdown(headers, surface_rows).first())[1:] == (-20, 8, 2)
    assert spark.createDataFrame([("memory-3",), ("memory-12",), ("x",)], "id string").agg(metrics.greatest_number(F.col("id")).alias("n")).first().n == 12


def test_retained(spark):
    from eventloom.operators import sessions

    def kept(messages, most):
        rows = spark.createDataFrame([("s", k, c, t) for k, (c, t) in enumerate(messages)], "session_id string, seq int, checkpoint boolean, text string")
        return [r.text for r in sessions.retained(rows, most).orderBy("seq").collect()]

    messages = [(None, "a" * 10), (True, "b" * 10), (False, "c" * 10)]
    assert kept(messages, 30) == ["a" * 10, "b" * 10, "c" * 10] and kept(messages, 15) == ["b" * 5, "c" * 10] and kept(messages, 4) == ["", "c" * 4]
    assert kept([(True, "head" + "x" * 20 + "tail"), (False, "é" * 3)], 14) == ["headtail", "é" * 3]
    assert kept([(False, "1" * 6), (False, "2" * 6), (False, "3" * 6), (False, "4")], 8) == ["3" * 6, "4"]


def test_fuzzy_candidates_against_every_alignment(spark):
    import itertools
    import random

    from eventloom.operators import ordering

    def score(query, name):
        best = None
        for at in itertools.combinations(range(len(name)), len(query)):
            if all(name[i] == c for i, c in zip(at, query, strict=True)):
                value = sum(1 + 8 * (i == 0 or name[i - 1] in "-_") for i in at) - at[0] + sum(4 if j == i + 1 else i + 1 - j for i, j in itertools.pairwise(at))
                best = value if best is None else max(best, value)
        return best

    rng = random.Random(3)
    names = ["".join(rng.choice("abA-_.") for _ in range(rng.randrange(1, 10))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(names)), "position int, name string").repartition(5)
    for query in ("a", "ab", "bA", "aab"):
        low = query.lower()
        want = sorted((not n.lower().startswith(low), -s, k, n) for k, n in enumerate(names) if (s := score(low, n.lower())) is not None)
        assert [(not r.prefix, -r.score, r.position, r.name) for r in ordering.fuzzy_candidates(rows, "name", query, "position").collect()] == want
    assert [r.position for r in ordering.fuzzy_candidates(rows, "name", "", "position").collect()] == list(range(200))


def test_duplicates_are_errors_and_long_runs_are_cut(spark, monkeypatch):
    from eventloom.operators import joins
    from eventloom.sources import jsonl

    rows = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("s", 2)], "session_id string, step int")
    assert [tuple(r) for r in joins.duplicates(rows, ["session_id", "step"]).collect()] == [("s", 2, 2)]
    assert joins.unique_rows(rows.where("step = 1"), ["session_id", "step"], "a step").count() == 2
    with pytest.raises(Exception, match="a step repeats"):
        joins.unique_rows(rows, ["session_id", "step"], "a step").collect()
    monkeypatch.setattr(jsonl, "MOST_RUN", 4)
    log = spark.createDataFrame([("s", k, 10 * k, "a", f"t{k}") for k in range(10)], "session_id string, seq bigint, time bigint, kind string, text string")
    packed = jsonl.pack(log, keys=("kind",))
    assert sorted((r.seq0, len(r.texts), r.packed) for r in packed.collect()) == [(0, 4, True), (4, 4, True), (8, 1, False), (9, 1, False)]
    assert sorted((r.seq, r.time, r.text) for r in jsonl.unpack_arrays(packed).collect()) == [(k, 10 * k, f"t{k}") for k in range(10)]
