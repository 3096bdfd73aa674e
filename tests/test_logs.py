"""Logs as files, packing, repair, projections in batch and stream, pages."""

import json
import os
import random
import re

import pytest
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators import ordering, sessions, surface
from eventloom.sources import jsonl, tables
from eventloom.streaming import projections

EVENTS = "session_id string, seq bigint, type string, time bigint, data string"


def write(folder, name, rows, tail="", packed=False):
    head = json.dumps({"type": "session", "version": 0, "id": name, "createdAt": 5})
    body = "".join(json.dumps(r) + "\n" for r in rows)
    data = (head + "\n" + body + tail).encode()
    path = folder / (f"{name}.jsonl.zstd" if packed else f"{name}.jsonl")
    path.write_bytes(zstandard.compress(data) if packed else data)
    return path


def ev(seq, kind="x", **data):
    return {"type": kind, "seq": seq, "time": 10 + seq, "data": data}


@pytest.mark.parametrize("packed", [False, True])
def test_read(spark, tmp_path, packed):
    run = {"type": "assistant/chunk", "seq0": 2, "time0": 100, "data": {"turn": 1, "step": 1, "index": 0, "dt": [10, -5], "texts": ["a", "b", "c"]}}
    write(tmp_path, "s1", [ev(0), ev(1), run, ev(5, "turn/end")], '{"type": "x", "se', packed)
    lines = jsonl.lines(spark, str(tmp_path))
    assert [r.id for r in jsonl.headers(lines).collect()] == ["s1"]
    got = jsonl.events(lines).orderBy("seq").collect()
    assert [(r.seq, r.time) for r in got] == [(0, 10), (1, 11), (2, 100), (3, 110), (4, 105), (5, 15)]
    assert json.loads(got[3].data)["text"] == "b"


def test_holes_before_the_last_turn_end_are_errors(spark, tmp_path):
    write(tmp_path, "s2", [ev(0), ev(2), ev(3, "turn/end")])
    lines = jsonl.lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="hole"):
        jsonl.events(lines).collect()
    assert [r.seq for r in jsonl.events(lines, strict=False).collect()] == [0]


def test_foreign_versions_are_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":"session","version":9,"id":"x","createdAt":1}\n')
    with pytest.raises(Exception, match="version"):
        jsonl.headers(jsonl.lines(spark, str(tmp_path))).collect()


def test_write_and_read_back(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, "x", 1, '{"k":1}'), ("a", 1, "turn/end", 2, "{}"), ("b", 0, "x", 3, '{"z":"é"}')], EVENTS)
    heads = spark.createDataFrame([("a", 1), ("b", 2)], "id string, created_at bigint")
    jsonl.write(heads, log, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.txt"))) == 1
    lines = jsonl.log_lines(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in jsonl.headers(lines).collect()) == ["a", "b"]
    assert {(r.seq, r.type, json.loads(r.data).get("z")) for r in jsonl.events(lines).collect()} == {(0, "x", None), (0, "x", "é"), (1, "turn/end", None)}


def test_torn_zstd(spark, tmp_path):
    whole = zstandard.compress(b"one\n") + zstandard.compress(b"two\n")
    (tmp_path / "a.zst").write_bytes(whole)
    (tmp_path / "b.zst").write_bytes(whole[:-3])
    got = sorted((r.path[-5:], r.frame, r.content and bytes(r.content), r.torn) for r in jsonl.zstd_frames(spark, str(tmp_path)).collect())
    assert got == [("a.zst", 0, b"one\n", False), ("a.zst", 1, b"two\n", False), ("b.zst", 0, b"one\n", False), ("b.zst", 1, None, True)]
    assert sorted((r.path[-5:], r.number, r.line) for r in jsonl.lines(spark, str(tmp_path)).collect()) == [("a.zst", 0, "one"), ("a.zst", 1, "two"), ("b.zst", 0, "one")]


def test_frames_are_unpacked_apart_and_lines_across_them_joined(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(rng.choice("ab\u00e9\u6f22\n\n") * rng.randrange(1, 9) for _ in range(4000)) + "end"
    data, cuts = text.encode(), sorted(rng.sample(range(1, 20_000), 60))
    packer = [zstandard.ZstdCompressor(level=3, write_checksum=bool(k % 2), write_content_size=bool(k % 3)) for k in range(6)]
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    frames = [packer[k % 6].compress(p) for k, p in enumerate(parts)]
    frames.insert(5, (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc")  # to be skipped
    frames.append(zstandard.ZstdCompressor().compress(os.urandom(300_000).hex().encode() * 2 + b"\n"))  # many blocks
    parts.append(zstandard.ZstdDecompressor().decompress(frames[-1]))
    (tmp_path / "x.zst").write_bytes(b"".join(frames) + frames[0][:-2])
    found = jsonl.zstd_frames(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted(found.collect(), key=lambda r: r.frame)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [bytes(r.content) for r in rows[:-1]] == parts and [r.torn for r in rows] == [False] * len(parts) + [True]
    assert len({r.task for r in rows}) > 1
    want = [(k, line) for k, line in enumerate(b"".join(parts).decode().split("\n")) if line]
    assert sorted((r.number, r.line) for r in jsonl.lines(spark, str(tmp_path)).collect()) == want


def test_many_logs_in_files_of_many_splits(spark, tmp_path):
    rng = random.Random(4)
    sizes = {f"s{k:03d}": rng.choice([0, 1, 3, 40]) for k in range(90)}
    log = spark.createDataFrame([(s, k, "turn/end", k, json.dumps({"k": k})) for s, n in sizes.items() for k in range(n)], EVENTS)
    heads = spark.createDataFrame([(s, 1) for s in sizes], "id string, created_at bigint")
    jsonl.write(heads, log, str(tmp_path / "out"), file_bytes=20_000)
    assert len(list((tmp_path / "out").glob("*.txt"))) > 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        lines = jsonl.log_lines(spark, str(tmp_path / "out"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        before = plan.split("MapInArrow")[1]  # what the plain lines go through
        assert "BroadcastHashJoin" in before and "Exchange hashpartitioning" not in before.split("FileScan text")[0]
        assert lines.rdd.getNumPartitions() > 10
        assert sorted(r.id for r in jsonl.headers(lines).collect()) == sorted(sizes)
        names = {r.path: r.id for r in jsonl.headers(lines).collect()}
        got = sorted((names[r.path], r.seq) for r in jsonl.events(lines).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((s, k) for s, n in sizes.items() for k in range(n))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 50)), min_size=1, max_size=30))
def test_packing_round_trip(spark, chunks):
    rows = [("s", k, kind, 1000 + gap, str(k)) for k, (kind, gap) in enumerate(chunks)]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, kind string, time bigint, text string")
    packed = jsonl.pack(log, keys=("kind",)).cache()
    assert all(len(r.texts) >= 3 if r.packed else len(r.texts) == 1 for r in packed.collect())
    back = jsonl.unpack_arrays(packed).select(*log.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_repair(spark):
    rows = [("s", 0, "turn/start", 1, '{"turn":1}'), ("s", 1, "step/start", 2, '{"turn":1,"step":1}'), ("s", 2, "tool/call", 3, '{"callId":"c"}'), ("t", 0, "turn/start", 1, '{"turn":1}'), ("t", 1, "turn/end", 2, '{"turn":1}')]
    got = jsonl.repair(spark.createDataFrame(rows, EVENTS)).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.type, r.time) for r in got][3:6] == [("s", 3, "tool/result", 3), ("s", 4, "step/end", 3), ("s", 5, "turn/end", 3)]
    assert len(got) == 8


COUNT = projections.Projection("count", 1, lambda: 0, lambda s, e: s + 1)
SUM = projections.Projection("sum", 2, lambda: 0, lambda s, e: s + e["time"], lambda s: {"total": s})


def test_folds_hold_no_session_whole(spark):
    rows = [(f"s{k % 3}" if k % 3 else None, k // 3, "user/message", k, None, list(range(k // 3)), ("replace", k // 3 - 2, k // 3 - 1) if k // 3 == 50 else ("append", None, None)) for k in range(300)]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, type string, time bigint, data string, source_event_seqs array<bigint>, surface_op struct<op: string, start: bigint, end: bigint>")
    opened = [("s", 0, "turn/start", 1, '{"turn":1}'), *(("s", k, "tool/call", k, f'{{"callId":"{k}"}}') for k in range(1, 40))]

    def sized(state, event):
        return state + [event["seq"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded, counted, closed = surface.fold(log), projections.fold(log, [projections.Projection("all", 1, list, sized)]), jsonl.repair(spark.createDataFrame(opened, EVENTS))
        for frame in (folded, counted, closed):
            plan = frame._jdf.queryExecution().toString()
            assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan
        states = {(r.session_id, r.seq): (r.surface, r.position, r.replaced_by) for r in folded.collect()}
        assert len(states) == 300
        for name in (None, "s1", "s2"):
            assert states[name, 48] == states[name, 49] == ("shadowed", None, 50)
            assert states[name, 50] == ("current", 48, None) and states[name, 99] == ("current", 97, None)
        assert {r.session_id: json.loads(r.val) for r in counted.collect()} == dict.fromkeys((None, "s1", "s2"), list(range(100)))
        assert [r.seq for r in closed.orderBy("seq").collect()] == list(range(80))
        wrong = log.withColumn("seq", F.expr("if(seq >= 60, seq + 1, seq)"))
        errors = surface.fold(wrong, strict=False).collect()
        assert sorted(r.seq for r in errors) == sorted(k + (k >= 60) for k in range(100) for _ in range(3)) and all(r.error and r.surface is None for r in errors)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batch_equals_stream_and_checkpoints(spark, tmp_path):
    rows = [(f"s{k % 3}", k // 3, "x", k, "{}") for k in range(30)]
    log = spark.createDataFrame(rows, EVENTS)
    whole = {(r.session_id, r.key): (r.seq, r.val) for r in projections.fold(log, [COUNT, SUM]).collect()}
    early = projections.fold(log.where("seq < 4"), [COUNT, SUM])
    assert {(r.session_id, r.key): (r.seq, r.val) for r in projections.fold(log, [COUNT, SUM], early).collect()} == whole
    stale = early.withColumn("ver", F.lit(7))
    assert {(r.session_id, r.key): (r.seq, r.val) for r in projections.fold(log, [COUNT, SUM], stale).collect()} == whole
    for k, part in enumerate((rows[:12], rows[9:12] + rows[12:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = projections.drive(stream, [COUNT, SUM]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    last = {(r.session_id, r.key): (r.seq, r.value) for r in projections.latest_values(changes).collect()}
    for (session, key), (seq, val) in whole.items():
        assert last[session, key][1] == (val if key == "count" else json.dumps({"total": json.loads(val)}))
    assert changes.where("key = 'count'").count() == 30


def test_registry():
    r = projections.Registry()
    a, b = r.register(COUNT), r.register(COUNT)
    with pytest.raises(ValueError):
        r.register(projections.Projection("count", 2, lambda: 0, lambda s, e: s))
    a(), a()
    assert len(r.all()) == 1
    b()
    assert r.all() == []


def test_pages(spark):
    rows = spark.createDataFrame([(k, k % 4) for k in range(45)], "id int, score int")
    keys, request, seen, cursor = [("score", True), ("id", False)], {"text": "x", "types": ["b", "a"]}, [], None
    while True:
        page = ordering.page(rows, keys, request, "g1", cursor, 20)
        seen += [r.id for r in page.rows]
        if page.next_cursor is None:
            break
        cursor = page.next_cursor
    assert seen == [r.id for r in rows.orderBy(F.desc("score"), "id").collect()]
    for bad in (({"text": "y"}, "g1"), (request, "g2")):
        with pytest.raises(ordering.CursorError):
            ordering.page(rows, keys, bad[0], bad[1], cursor)
    with pytest.raises(ValueError):
        ordering.page_size(101)
    assert ordering.fingerprint({"types": ["a", "b"]}) == ordering.fingerprint({"types": ["b", "a"], "x": None})


def test_tables(spark, tmp_path):
    text = "x\n| a | b |\n|---|---|\n| 1 | p\\|q |\n| 2 |\n\n| late |"
    rows = tables.markdown_tables(spark.createDataFrame([(1, text), (2, "none")], "id int, text string"))
    assert [r.cells for r in rows.orderBy("row").collect()] == [["a", "b"], ["1", "p|q"], ["2", ""]]
    tables.write_csv(rows, F.col("row"), F.col("cells"), str(tmp_path / "csv"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part*"))
    assert data == b"\xef\xbb\xbfa,b\r\n1,p|q\r\n2,\r\n"
    with pytest.raises(Exception, match="more cells"):
        tables.markdown_tables(spark.createDataFrame([(1, "| a |\n| 1 | 2 |")], "id int, text string")).collect()
    (tmp_path / "kv.json").write_text('{"tables": {"t": {"k": {"v": 1}}}}')
    assert [tuple(r) for r in tables.key_values(spark, str(tmp_path / "kv.json")).collect()] == [("t", "k", '{"v":1}')]
    memory = "# First one\nId: memory-1\nKeywords: A, b , a\nRecorded: today\nOutcome: success\n\nbody\nmore\n# Second\nId: memory-2\n"
    got = tables.memories(spark.createDataFrame([(memory,)], "text string")).orderBy("position").collect()
    assert (got[0].title, got[0].keywords, got[0].outcome, got[0].body) == ("First one", ["a", "b"], "success", "body\nmore") and got[1].id == "memory-2"


def test_sessions(spark):
    rows = [("a", "/x", 1, 3, None), ("b", "/x", 2, 0, None), ("c", None, 3, 1, None), ("d", "/y", 4, 1, "subagent")]
    s = spark.createDataFrame(rows, "id string, cwd string, created_at int, events int, origin string").withColumn("title", F.lit("T"))
    ids = lambda df: [r.id for r in df.collect()]
    assert sorted(ids(sessions.authorized(s, "a"))) == ["a", "b"] and ids(sessions.authorized(s, "c")) == ["c"]
    assert sorted(ids(sessions.visible(s, s.where("id = 'c'")))) == ["a"] and sorted(ids(sessions.visible(s, s.where("id = 'c'"), "b"))) == ["a", "b"]
    assert ids(sessions.reference_candidates(s, "a", "/x", "t", 5)) == ["b", "c", "d"]
    log = spark.createDataFrame([("a", 0, "turn/start"), ("a", 1, "turn/end"), ("a", 2, "step/start")], "session_id string, seq int, type string")
    assert sessions.fork(log, "a", "child", 2).select("session_id").distinct().first()[0] == "child"
    with pytest.raises(Exception, match="fork"):
        sessions.fork(log, "a", "child", 1).collect()
    assert [r.seq for r in sessions.before_open_step(log, "a").collect()] == [0, 1]
    order = lambda *k: spark.createDataFrame(list(enumerate(k)), "position int, key string")
    assert [r.key for r in sessions.spliced(order("b", "a"), order("new", "a", "x", "b", "last")).collect()] == ["x", "b", "new", "a", "last"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"{k}\n" for k in range(5000)) + "\n\nlast")
    (tmp_path / "b.jsonl").write_text("x\n\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = jsonl.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.number, r.line) for r in got if r.path.endswith("a.jsonl")) == [*((k, str(k)) for k in range(5000)), (5002, "last")]
    assert sorted((r.number, r.line) for r in got if r.path.endswith("b.jsonl")) == [(0, "x"), (2, "y")]


@pytest.mark.parametrize("phrase", ["of the", "a a", "one", "café bar", "x_y", "THE  end"])
def test_spans_of_ascii_texts_as_of_others(spark, phrase):
    from eventloom.functions import pandas_text as p

    texts = ["of the of the", "xof the", "of  The, of_the", "a a a a b", "one", "none one-one", "café bar CAFE BAR", "cafe bar", "x_y x y", "the end. THE\nEND", "", "of \u00e9 the", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.n for r in rows.select("id", p.span_count(F.col("text"), phrase).alias("n")).collect()}
    assert got == {k: 0 if t is None else p.phrase_spans(p.fold(t), p.fold(phrase)) for k, t in enumerate(texts)} or got == {k: None if t is None else p.phrase_spans(p.fold(t), p.fold(phrase)) for k, t in enumerate(texts)}


def test_fold_reads_only_what_no_checkpoint_holds(spark, tmp_path):
    count = projections.Projection("count", 1, lambda: 0, lambda state, event: state + 1)
    kinds = projections.Projection("kinds", 2, dict, lambda state, event: {**state, event["type"]: state.get(event["type"], 0) + 1})
    rows = [(name, k, f"t{k % 3}", k, None) for name, n in (("a", 30), ("b", 20), ("c", 5), ("d", 9)) for k in range(n)]
    log = spark.createDataFrame(rows, EVENTS)
    whole = {(r.session_id, r.key): (r.ver, r.seq, json.loads(r.val)) for r in projections.fold(log, [count, kinds]).collect()}
    assert whole["a", "count"] == (1, 29, 30) and whole["c", "kinds"] == (2, 4, {"t0": 2, "t1": 2, "t2": 1})
    # a and b have both states, c is complete, d has one of an older version; b has one beyond its end.
    held = projections.fold(log.where("session_id in ('a', 'b') and seq < 12 or session_id = 'c'"), [count, kinds])
    old = projections.fold(log.where("session_id = 'd' and seq < 4"), [count]).withColumn("ver", F.lit(0))
    beyond = spark.createDataFrame([("e", "count", 1, 99, "100")], projections.CHECKPOINT)
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    again = projections.fold(stored, [count, kinds], held.unionByName(old).unionByName(beyond))
    assert {(r.session_id, r.key): (r.ver, r.seq, json.loads(r.val)) for r in again.collect()} == whole
    ends = log.groupBy("session_id").agg(F.max("seq").alias("end"))
    later = projections.fold(stored, [count, kinds], held.where("session_id <> 'c'"), ends.where("session_id in ('a', 'b')"))
    assert {(r.session_id, r.key): (r.ver, r.seq, json.loads(r.val)) for r in later.collect()} == {k: v for k, v in whole.items() if k[0] in "ab"}
    assert "GreaterThan(seq,11)" in later._jdf.queryExecution().toString()


def test_stored_logs_are_filtered_in_the_scan(spark, tmp_path):
    from eventloom.operators import windows
    from eventloom.schema import store_log, stored_session

    log = spark.createDataFrame([(f"s{k % 40}", k // 40, "x", k, None) for k in range(2000)], EVENTS)
    store_log(log, str(tmp_path / "log"), 300)
    assert len(list((tmp_path / "log").glob("bucket=*"))) == 7
    found = windows.context(stored_session(spark, str(tmp_path / "log"), "s7"), "s7", 10, 2, 3)
    assert sorted(r.seq for r in found.collect()) == list(range(8, 14))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,s7)" in plan and "GreaterThanOrEqual(seq,8)" in plan and "PartitionFilters: [isnotnull(bucket" in plan


def test_manifest(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text("\ufeff" + json.dumps([{"id": "a", "repo": "r", "n": 1}, {"id": "b", "repo": "s"}, {"id": "a", "repo": "t"}]))
    got = tables.manifest(spark, str(path), ("repo",), "id").collect()
    assert {(r.id, r.repo) for r in got} == {("a", "t"), ("b", "s")} and json.loads(got[0].case)["id"] == got[0].id
    for bad, error in (([{"id": "a"}], "no repo"), ({"id": "a"}, "array")):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception, match=error):
            tables.manifest(spark, str(path), ("repo",), "id").collect()


def test_orders(spark):
    rows = spark.createDataFrame([("b", 5, 9), ("a", 5, 7), ("-c", 8, None), ("_d", 5, None)], "id string, updated_at int, target int")
    assert [r.id for r in ordering.by_recency(rows).collect()] == ["-c", "_d", "a", "b"]
    from eventloom.streaming.schedules import due_order

    assert [r.id for r in due_order(rows.where("target is not null").withColumn("position", F.lit(0))).collect()] == ["a", "b"]


def test_events_read_plain_files_once_and_open_only_packed_ones_whole(spark, tmp_path):
    log = [(s, k, "turn/end", k, json.dumps({"k": k})) for s in "abc" for k in range(5)]
    jsonl.write(spark.createDataFrame([(s, 1) for s in "abc"], "id string, created_at bigint"), spark.createDataFrame(log, EVENTS), str(tmp_path / "out"))
    lines = jsonl.log_lines(spark, str(tmp_path / "out"))
    got = jsonl.events(lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[value[^\n]*\] text", plan)) == 1
    assert jsonl.zstd_frames(spark, str(tmp_path / "out")).inputFiles() == []
    assert sorted((r.seq, r.time) for r in got.collect()) == sorted((k, k) for _, k, *_ in log)
    (tmp_path / "mixed.jsonl").write_text('{"type":"\\u0073ession","version":0,"id":"m","createdAt":1}\n{"type":"x","seq":0,"time":7,"data":{"a":"session"}}\n')
    assert [r.id for r in jsonl.headers(jsonl.log_lines(spark, str(tmp_path / "mixed.jsonl"))).collect()] == ["m"]
