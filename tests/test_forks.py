import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import sessions as n
from eventloom.streaming import folds
from eventloom.streaming import projections as p

COUNT = p.Projection("count", 1, lambda: 0, lambda s, e: s + 1)


def put(key, at=0):
    return json.dumps({"target": "next-turn", "start": at, "removedCount": 0, "inserted": [{"id": key}]})


def world(spark):
    """A root, its fork after four rows, a fork of that after two and one after five, and a chain of forks."""
    forks = [("root", None, None), ("child", "root", 4), ("early", "child", 2), ("late", "child", 5), *((f"c{k}", f"c{k - 1}" if k else "root", k + 1) for k in range(40))]
    own = {"root": 6, "child": 3, "early": 1, "late": 2, **{f"c{k}": 1 for k in range(40)}}
    seeds = {s: x or 0 for s, _, x in forks}
    rows = [(s, seeds[s] + k, "agent/inbox/spliced", 1, put(f"{s}-{k}")) for s, count in own.items() for k in range(count)]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, type string, time bigint, data string").repartition(3)
    return log, spark.createDataFrame(forks, "id string, parent string, seed_length bigint"), own, seeds


def test_views_share_rows_and_copy_none(spark):
    log, forks, own, seeds = world(spark)
    view = n.forked_log(log, forks)
    got = {}
    for r in view.collect():
        got.setdefault(r.session_id, {})[r.seq] = json.loads(r.data)["inserted"][0]["id"]
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    texts = {s: [x[k] for k in sorted(x)] for s, x in got.items()}
    assert texts["early"] == ["root-0", "root-1", "early-0"]
    assert texts["late"] == ["root-0", "root-1", "root-2", "root-3", "child-0", "late-0", "late-1"]
    assert texts["c39"] == ["root-0", *(f"c{k}-0" for k in range(40))]
    assert {s: len(x) for s, x in texts.items()} == {s: seeds[s] + own[s] for s in own}


def test_pending_messages_of_the_parent_stay_there(spark):
    log, forks, own, seeds = world(spark)
    states = {(r.session_id, r.key): json.loads(r.val) for r in p.fold(n.forked_log(log, forks), [folds.INBOX, COUNT]).collect()}
    for s in own:
        assert [m["id"] for m in states[s, "inbox"]["next-turn"]] == [f"{s}-{k}" for k in reversed(range(own[s]))]
        assert states[s, "count"] == seeds[s] + own[s]


def test_schedules_begin_at_the_fork_and_goals_do_not(spark):
    made = lambda key: json.dumps({"id": key, "kind": "at", "target": 5})
    goal = json.dumps({"operation": "create", "goal": {"id": "g", "revision": 1, "phase": "active", "maxGoalRounds": 3}, "roundsStarted": 0, "createdAt": 1, "updatedAt": 1})
    rows = [("a", 0, "schedule/created", 1, made("s")), ("a", 1, "goal/change", 1, goal), ("b", 2, "schedule/created", 1, made("s"))]
    log = spark.createDataFrame(rows, "session_id string, seq bigint, type string, time bigint, data string")
    forks = spark.createDataFrame([("a", None, None), ("b", "a", 2)], "id string, parent string, seed_length bigint")
    # The same id again: an error, were the parent's schedule there.
    states = {(r.session_id, r.key): json.loads(r.val) for r in p.fold(n.forked_log(log, forks), [folds.SCHEDULES, folds.GOALS]).collect()}
    assert list(states["b", "schedules"]) == ["s"] and states["b", "goal"]["goal"]["id"] == "g"
    with pytest.raises(Exception, match="there already"):
        p.fold(n.forked_log(log, forks).withColumn("seed_length", F.lit(0)), [folds.SCHEDULES]).collect()


def test_cycles_and_missing_parents(spark):
    schema = "id string, parent string, seed_length bigint"
    with pytest.raises(ValueError, match="cycle"):
        n.fork_segments(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], schema))
    alone = n.fork_segments(spark.createDataFrame([("a", "gone", 3), ("b", "a", None)], schema))
    assert sorted(tuple(r) for r in alone.collect()) == [("a", "a", 3, None), ("b", "b", 0, None)]
