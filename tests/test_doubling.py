"""Walks by doubled links: rounds, cycles, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import traces, trees


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that are written on the way: one a round, and one to begin with."""
    counted, real = [], traces._kept
    monkeypatch.setattr(traces, "_kept", lambda df: (counted.append(1), real(df))[1])
    return counted


def forest(spark, parents):
    rows = [(k, p, k * 7 % 5) for k, p in parents.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id int, parent int, events int").repartition(4)


def lines(parents, k):
    out = []
    while parents.get(k) in parents:
        k = parents[k]
        out.append(k)
    return out


def test_random_forests(spark):
    for seed in range(3):
        rng = random.Random(seed)
        parents = {k: rng.choice([None, 500, *range(k)[-4:]]) if k else None for k in range(60)}
        s = forest(spark, parents)
        above = {k: lines(parents, k) for k in parents}
        want = {k: (sum(k in a for a in above.values()), sum(k in a and u * 7 % 5 > 2 for u, a in above.items())) for k in parents}
        assert {r.id: (r.descendants, r.running) for r in traces.rollup(s, F.col("events") > 2).collect()} == want
        flat = {r.id: (r.root, r.depth, [p[0] for p in r.path]) for r in trees.flatten(s, F.col("id")).collect()}
        assert flat == {k: ([k, *a][-1], len(a), [*a[::-1], k]) for k, a in above.items()}
        for k in (0, 31, 59):
            assert [(r.ancestor, r.depth) for r in traces.ancestors(s, k).collect()] == [(a, d) for d, a in enumerate(above[k], 1)]
    assert traces.ancestors(s, 999).count() == 0


def test_a_chain_of_ten_thousand_takes_fifteen_rounds(spark, rounds):
    n = 10_000
    s = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).alias("events"))
    got = traces.rollup(s, F.col("id") % 2 == 0)
    assert len(rounds) <= 16
    assert got.where(f"descendants <> {n - 1} - id").count() == 0
    assert got.where("id = 1").first().running == n // 2 - 1
    rounds.clear()
    assert [r.depth for r in traces.ancestors(s, n - 1).collect()] == list(range(1, n))
    assert len(rounds) <= 32  # links and what they found


def test_chains_of_replacements_double(spark, rounds):
    n = 300
    folded = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("replaced_by"))
    got = {r.seq: r.chain for r in traces.replacement_chains(folded).collect()}
    assert got == {k: list(range(k + 1, n)) for k in range(n - 1)} and len(rounds) <= 11
    assert traces.replacement_chains(folded.where("seq < 0")).count() == 0


def test_cycles(spark):
    s = forest(spark, {0: None, 1: 0, 2: 4, 3: 2, 4: 3, 5: 4})
    for walk in (lambda: traces.rollup(s, F.lit(True)), lambda: traces.ancestors(s, 2)):
        with pytest.raises(ValueError, match="cycle"):
            walk()
    assert {r.id: (r.root, r.depth) for r in trees.flatten(s, F.col("id")).collect()} == {0: (0, 0), 1: (0, 1), **{k: (k, 0) for k in (2, 3, 4, 5)}}
    assert [r.ancestor for r in traces.ancestors(s, 1).collect()] == [0]


def test_deeper_than_allowed(spark):
    s = forest(spark, {k: k - 1 if k else None for k in range(20)})
    flat = {r.id: (r.root, r.depth, len(r.path)) for r in trees.flatten(s, F.col("id"), max_depth=6).collect()}
    assert flat == {k: (0, k, k + 1) if k <= 6 else (k, 0, 1) for k in range(20)}
