import random

import pytest

from eventloom.operators import surface
from eventloom.operators import surface_blocks as b
from eventloom.operators.surface import Surface, SurfaceError
from eventloom.schema import EVENT


def session(rng, n, faults=False):
    """Rows of a random session, and the state of the fold row by row, or None where it fails."""
    state, rows = Surface(), []
    for seq in range(n):
        current = state.current
        if rng.random() < 0.15:
            row = (seq, "turn/start", None, None, None, None)
        elif current and rng.random() < 0.45:
            i = rng.randrange(len(current))
            j = min(len(current) - 1, i + rng.choice([0, 0, 1, 3, 12]))
            gone = current[i : j + 1]
            extra = rng.sample(range(seq), min(seq, rng.randrange(3)))
            row = (seq, "user/message", "replace", gone[0], gone[-1], sorted(set(gone) | set(extra)))
        else:
            row = (seq, "assistant/message", "append", None, None, [])
        if faults and rng.random() < 0.03:
            row = rng.choice([(seq, "user/message", "replace", rng.randrange(n), rng.randrange(n), list(range(seq))), (*row[:5], []), (seq + 1, *row[1:]), (*row[:2], "swap", *row[3:]), (seq, "other", "append", None, None, None)])
        rows.append(row)
        try:
            state.apply(*row)
        except SurfaceError:
            # What comes after doesn't matter.
            return rows + [(k, "assistant/message", "append", None, None, []) for k in range(seq + 1, n)], None
    return rows, state


def by_blocks(rows, size):
    """The fold in blocks without Spark: what it says of each row, or None where it finds a fault."""
    surface_, blocks = b.Stretches(), []
    try:
        for first in range(0, len(rows), size):
            block = b.Block(first)
            for row in rows[first : first + size]:
                block.apply(*row)
            blocks.append(block)
            surface_.apply(b.Summary(first, block.next - first, block.pieces(), block.islands, block.ops))
    except (b.Fault, KeyError):
        return None
    current, gone = [], {}
    live = sorted(x for block in blocks for p in range(len(block.island_of)) for x in block.rows_of(p))
    if any(x not in live for x in surface_.named):
        return None
    inside = lambda s: [x for x in live if surface_.low[s] <= x <= surface_.high[s]]
    for s in surface_.order():
        current += inside(s)
    for s, by in enumerate(surface_.gone):
        if by is not None:
            gone |= dict.fromkeys(inside(s), by)
    for block in blocks:
        gone |= block.replaced_by
    cited = {r[0]: set(r[5] or ()) for r in rows}
    return None if any(x not in cited[by] for x, by in gone.items()) else (current, gone)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 1000])
def test_blocks_against_the_fold_row_by_row(size):
    for seed in range(150):
        rows, state = session(random.Random(seed), 60)
        assert by_blocks(rows, size) == (state.current, state.replaced_by), seed


@pytest.mark.parametrize("size", [1, 3, 10])
def test_faults_are_found_in_blocks(size):
    failed = 0
    for seed in range(400):
        rows, state = session(random.Random(seed), 40, faults=True)
        got = by_blocks(rows, size)
        failed += state is None
        assert got == (None if state is None else (state.current, state.replaced_by)), seed
    assert failed > 100


def frame(spark, sessions):
    rows = [(name, seq, kind, 0, None, src, None if op is None else (op, a, z)) for name, events in sessions.items() for seq, kind, op, a, z, src in events]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, EVENT).repartition(4)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_spark_in_blocks_and_in_one_task(spark):
    rng = random.Random(5)
    log = frame(spark, {f"s{k}": session(rng, n)[0] for k, n in enumerate([5, 40, 130, 300])})
    assert result(surface.fold(log, block_rows=25)) == result(surface.fold(log))


def test_faulty_long_sessions_say_why(spark):
    rng = random.Random(8)
    worlds = {}
    while len(worlds) < 3:
        rows, state = session(rng, 80, faults=True)
        if state is None and [r[0] for r in rows] == list(range(80)):
            worlds[f"bad{len(worlds)}"] = rows
    worlds["good"] = session(rng, 80)[0]
    log = frame(spark, worlds)
    got = result(surface.fold(log, strict=False, block_rows=9))
    assert got == result(surface.fold(log, strict=False)) and {r[0] for r in got if r[5]} == {"bad0", "bad1", "bad2"}
    with pytest.raises(Exception, match="row "):
        surface.fold(log, block_rows=9).collect()


def test_one_session_is_many_tasks_work(spark):
    """A hundred times more rows than other sessions: every block is its own unit."""
    rows = [(k, "user/message", "append", None, None, []) if k % 50 != 49 else (k, "user/message", "replace", k - 49, k - 1, list(range(k - 49, k))) for k in range(4000)]
    log = frame(spark, {"hot": rows})
    rows_ = log.select("session_id", "seq", "type", "surface_op.op", "surface_op.start", "surface_op.end", "source_event_seqs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from pyspark.sql import functions as F

        folded = b.fold_blocks(rows_, 100).withColumn("task", F.spark_partition_id())
        assert folded.select("task").distinct().count() == 4  # all that this session has
        assert result(surface.fold(log, block_rows=100)) == result(surface.fold(log))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
