import json
import time

import pytest

from eventloom.streaming import live as v
from eventloom.streaming import projections as p

SCHEMA = "session_id string, seq bigint, type string, time bigint, data string"
COUNT = p.Projection("count", 1, lambda: 0, lambda s, e: s + 1)
MARKS = p.Projection("marks", 1, list, lambda s, e: [*s, e["seq"]] if e["type"] == "mark" else s, lambda s: {"marks": s})
TYPES = p.Projection("types", 2, dict, lambda s, e: {**s, e["type"]: s.get(e["type"], 0) + 1})


class Source:
    """A folder that a stream reads file by file."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.rows, self.done = spark, path, 0, [], {}
        (path / "in").mkdir()

    def put(self, *rows):
        rows = [(s, q, k, 10 * q, None) for s, q, k in rows]
        self.rows += rows
        self.n += 1
        draft = self.path / f"draft{self.n}"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(draft))
        next(draft.glob("part-*")).rename(self.path / "in" / f"{self.n:03d}.json")

    def start(self, name, projections, initial=None, policy=None, once=False):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        out = v.live(stream, projections, initial, policy).writeStream.format("parquet").option("path", str(self.path / name)).option("checkpointLocation", str(self.path / f"{name}-state"))
        return out.trigger(availableNow=True).start() if once else out.trigger(processingTime="50 milliseconds").start()

    def run(self, name, projections, initial=None, policy=None):
        query = self.start(name, projections, initial, policy, once=policy is None)
        if policy is None:
            query.awaitTermination(120)
        else:  # timers keep such a query busy, so it never runs out of batches
            files = self.n - self.done.get(name, 0)
            until = time.time() + 60
            while sum(x["numInputRows"] > 0 for x in query.recentProgress) < files and time.time() < until:
                time.sleep(0.1)
            query.stop()
        self.done[name] = self.n
        return self.got(name)

    def got(self, name):
        return sorted(tuple(r) for r in self.spark.read.schema(v.LIVE).parquet(str(self.path / name)).collect()) if (self.path / name).exists() else []

    def log(self):
        return self.spark.createDataFrame(self.rows, SCHEMA).dropDuplicates(["session_id", "seq"])


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def test_changes_are_those_of_the_batch_fold(source):
    source.put(("a", 1, "x"), ("a", 0, "mark"), ("b", 0, "x"))
    first = source.run("out", [COUNT, MARKS])
    assert [r[:3] + r[4:] for r in first] == [("a", "change", "count", 0, "1"), ("a", "change", "count", 1, "2"), ("a", "change", "marks", 0, '{"marks": [0]}'), ("b", "change", "count", 0, "1")]
    source.put(("a", 1, "x"), ("a", 2, "mark"))  # the first comes again
    source.put(("a", 3, "x"))
    last = {(s, k): val for s, _, k, _, q, val in source.run("out", [COUNT, MARKS])}
    assert last == {("a", "count"): "4", ("a", "marks"): '{"marks": [0, 2]}', ("b", "count"): "1"}


def test_a_projection_joins_a_running_log(source):
    source.put(("a", 0, "mark"), ("a", 1, "x"), ("b", 0, "x"))
    source.run("one", [COUNT])
    source.put(("a", 2, "mark"))
    with pytest.raises(Exception, match="types joins after row 1"):
        source.run("one", [COUNT, TYPES])
    # What is stored is folded; the stream goes on from there, whatever it delivers again.
    initial = p.fold(source.log(), [COUNT, TYPES, MARKS])
    source.put(("a", 3, "mark"), ("b", 1, "x"), ("c", 0, "y"))
    got = source.run("two", [COUNT, TYPES], initial)
    assert {r[4] for r in got if r[0] == "a"} == {3}
    want = {(r.session_id, r.key): (r.seq, json.loads(r.val)) for r in p.fold(source.log(), [COUNT, TYPES]).collect()}
    assert {(s, k): (q, json.loads(x)) for s, _, k, _, q, x in got} == want


def test_holes_are_errors(source):
    source.put(("a", 0, "x"), ("a", 2, "x"))
    with pytest.raises(Exception, match="row 2 after 0"):
        source.run("out", [COUNT])


def test_only_changed_cells_are_written(source):
    source.put(*[("a", k, "mark" if k == 0 else "x") for k in range(5)])
    source.run("out", [MARKS])
    source.put(("a", 5, "x"))
    query = source.start("out", [MARKS], once=True)
    query.awaitTermination(120)
    # The watermark moves, the cell stays: one value is put.
    states = [s for progress in query.recentProgress for s in progress["stateOperators"]]
    assert sum(s["numRowsUpdated"] for s in states) == 1
    assert len(source.got("out")) == 1


def checkpoints(source, name):
    return [(s, k, q, x) for s, kind, k, _, q, x in source.got(name) if kind == "checkpoint"]


def test_checkpoint_at_the_end_of_a_turn(source):
    policy = v.Policy(rows=100, milliseconds=3_600_000)
    source.put(("a", 0, "mark"))
    source.run("out", [MARKS], policy=policy)
    assert checkpoints(source, "out") == []
    source.put(("a", 1, "turn/end"), ("a", 2, "mark"))
    source.run("out", [MARKS], policy=policy)
    assert checkpoints(source, "out") == [("a", "marks", 1, "[0]")]


def test_checkpoint_after_so_many_rows(source):
    policy = v.Policy(rows=3, milliseconds=3_600_000)
    source.put(("a", 0, "mark"), ("a", 1, "mark"))
    source.run("out", [MARKS], policy=policy)
    assert checkpoints(source, "out") == []
    source.put(("a", 2, "mark"), ("a", 3, "mark"))
    source.run("out", [MARKS], policy=policy)
    assert checkpoints(source, "out") == [("a", "marks", 2, "[0, 1, 2]")]
    stored = v.stored_checkpoints(source.spark.read.parquet(str(source.path / "out")))
    assert [tuple(r) for r in stored.collect()] == [("a", "marks", 1, 2, "[0, 1, 2]")]
    assert {(r.key, r.seq, r.val) for r in p.fold(source.log(), [MARKS], stored).collect()} == {("marks", 3, "[0, 1, 2, 3]")}


def test_checkpoint_after_so_long(source):
    source.put(("a", 0, "mark"), ("b", 0, "mark"))
    query = source.start("out", [MARKS], policy=v.Policy(rows=100, milliseconds=1500))
    try:
        until = time.time() + 60
        while len(checkpoints(source, "out")) < 2 and time.time() < until:
            time.sleep(0.3)
        time.sleep(2)  # each once
        assert checkpoints(source, "out") == [("a", "marks", 0, "[0]"), ("b", "marks", 0, "[0]")]
    finally:
        query.stop()
