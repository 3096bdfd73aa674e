import threading

import pytest
from pyspark.sql import functions as F

from eventloom import folders
from eventloom.sources import appends as a
from eventloom.streaming.write_behind import flush, write_behind

SCHEMA = "session_id string, seq bigint, type string, time bigint"


def batch(spark, *rows):
    return spark.createDataFrame([(s, k, "user/message", 1000 + k) for s, k in rows], SCHEMA)


def held(spark, folder, **options):
    return sorted((r.session_id, r.seq) for r in a.read(spark, folder, **options).collect())


def revisions(spark, folder):
    return {r.session_id: (r.end, r.revision) for r in a.sessions(spark, folder).collect()}


def test_batches_are_whole_or_not_there(spark, tmp_path):
    folder = f"{tmp_path}/log"
    assert a.append(batch(spark, ("a", 0), ("a", 1), ("b", 0)), folder) == 1
    for wrong in ([("a", 1), ("b", 1)], [("a", 3), ("b", 1)], [("a", 2), ("a", 4)], [("a", 2), ("a", 2)], [("c", 1)]):
        with pytest.raises(a.AppendError):
            a.append(batch(spark, *wrong), folder)
    broken = batch(spark, ("a", 2), ("b", 1)).withColumn("time", F.when(F.col("session_id") == "b", F.raise_error("disk")).otherwise(F.col("time")))
    with pytest.raises(Exception, match="disk"):
        a.append(broken, folder)
    assert held(spark, folder) == [("a", 0), ("a", 1), ("b", 0)] and a.revision(spark, folder) == 1
    assert len([p for p in (tmp_path / "log").iterdir() if p.name != "_commits"]) == 1  # nothing is left behind
    assert a.append(batch(spark, ("a", 2)), folder, 1) == 2
    assert held(spark, folder, number=1) == [("a", 0), ("a", 1), ("b", 0)]


def test_one_of_two_writers_wins(spark, tmp_path):
    folder = f"{tmp_path}/log"
    a.append(batch(spark, ("a", 0)), folder)
    with pytest.raises(a.Conflict):
        a.append(batch(spark, ("b", 0)), folder, 0)
    results = []

    def put(k):
        try:
            results.append(folders.put(spark, folder, 1, {"k": k}))
        except a.Conflict:
            results.append("lost")

    threads = [threading.Thread(target=put, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, results)) == ["2", *["lost"] * 5]
    assert not [p.name for p in (tmp_path / "log" / "_commits").iterdir() if p.name.endswith(".tmp")]


def test_snapshots_have_revisions_that_change_with_an_append(spark, tmp_path):
    folder = f"{tmp_path}/log"
    assert a.sessions(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        a.read(spark, folder)
    a.append(batch(spark, ("a", 0), ("b", 0)), folder)
    before, store = revisions(spark, folder), a.sessions(spark, folder).first().store
    a.append(batch(spark, ("a", 1)), folder)
    after = revisions(spark, folder)
    assert before == {"a": (0, 1), "b": (0, 1)} and after == {"a": (1, 2), "b": (0, 1)}
    assert {r.store for r in a.sessions(spark, folder).collect()} == {store}


def test_repair_in_one_commit(spark, tmp_path):
    folder = f"{tmp_path}/log"
    a.append(batch(spark, *[("a", k) for k in range(6)], ("b", 0)), folder)
    cuts = spark.createDataFrame([("a", 3)], "session_id string, from bigint")
    with pytest.raises(a.AppendError):
        a.append(batch(spark, ("a", 6)), folder, cuts=cuts)
    a.append(batch(spark, ("a", 3), ("a", 4)).withColumn("type", F.lit("turn/end")), folder, cuts=cuts)
    a.append(batch(spark, ("a", 5)), folder)
    a.append(batch(spark).limit(0), folder, cuts=spark.createDataFrame([("b", 0)], "session_id string, from bigint"))
    got = sorted((r.session_id, r.seq, r.type) for r in a.read(spark, folder).collect())
    assert got == [("a", k, "turn/end" if k in (3, 4) else "user/message") for k in range(6)]
    assert revisions(spark, folder) == {"a": (5, 3), "b": (-1, 2)}
    assert a.compact(spark, folder) == 5
    assert sorted((r.session_id, r.seq, r.type) for r in a.read(spark, folder).collect()) == got and revisions(spark, folder) == {"a": (5, 3), "b": (-1, 2)}
    a.append(batch(spark, ("b", 0), ("a", 6)), folder)
    assert revisions(spark, folder) == {"a": (6, 4), "b": (0, 3)}


def test_filters_reach_the_scan(spark, tmp_path):
    folder = f"{tmp_path}/log"
    a.append(batch(spark, *[("a", k) for k in range(50)]), folder)
    plan = a.read(spark, folder).where("session_id = 'a' and seq > 40")._jdf.queryExecution().toString()
    assert "EqualTo(session_id,a)" in plan and "GreaterThan(seq,40)" in plan


def test_a_sink_that_fails_once_yields_every_row_once(spark, tmp_path):
    source, folder, fails = tmp_path / "in", f"{tmp_path}/log", [True]
    source.mkdir()

    def put(n, *rows):
        batch(spark, *rows).coalesce(1).write.json(f"{tmp_path}/draft{n}")
        next((tmp_path / f"draft{n}").glob("part-*")).rename(source / f"{n}.json")

    def once(*args, **options):
        number = a.append(*args, **options)
        if fails.pop() if fails else False:
            raise OSError("the answer was lost")  # after the commit: the worst moment
        return number

    def start(write, attempts):
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        return write_behind(rows, folder, "in", f"{tmp_path}/state", interval="10 milliseconds", attempts=attempts, wait=0.01, write=write)

    put(1, ("a", 0), ("b", 0))
    query = start(once, 3)
    flush(query)
    put(2, ("a", 1))
    flush(query)
    query.stop()
    assert held(spark, folder) == [("a", 0), ("a", 1), ("b", 0)]

    def broken(*args, **options):
        raise OSError("no space")

    put(3, ("a", 2), ("b", 1))
    query = start(broken, 2)
    with pytest.raises(Exception, match="no space"):
        flush(query)
    put(4, ("a", 3))
    # The failed batch goes first, and rows that came before aren't written again.
    query = start(a.append, 1)
    flush(query)
    query.stop()
    assert held(spark, folder) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert a.revision(spark, folder) == 4 and revisions(spark, folder)["a"] == (3, 4)


def test_another_writer_in_between(spark, tmp_path):
    from eventloom.streaming.write_behind import write_batch

    folder, other = f"{tmp_path}/log", [True]

    def write(rows, where, base, **options):
        if other and other.pop():
            a.append(batch(spark, ("z", 0)), folder)
        return a.append(rows, where, base, **options)

    write_batch(batch(spark, ("a", 0)), 0, folder, "s", write=write)
    write_batch(batch(spark, ("a", 0)), 0, folder, "s", write=write)
    assert held(spark, folder) == [("a", 0), ("z", 0)]
