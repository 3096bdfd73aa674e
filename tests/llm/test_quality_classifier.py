import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import quality_classifier as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(t):
    """Each statistic from its words, a text at a time."""
    chars, words, b = len(t), WORD.findall(t), len(t.encode())

    def share(a, n):
        return a / max(n, 1)

    def count(chars_):
        return sum(c in chars_ for c in t)

    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    known = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?#*$%&|<>\"'()-\n \t\r\x0b\x0c")
    lens = [len(w) for w in words]
    lines = t.count("\n") + bool(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}

    def of_words(test):
        return share(sum(map(test, words)), len(words))

    ups = lambda w: sum("A" <= c <= "Z" for c in w)
    lows = lambda w: sum("a" <= c <= "z" for c in w)
    mean = share(sum(lens), len(words))
    return [
        np.log1p(b), np.log1p(len(words)), share(upper, upper + lower), share(sum(c in "0123456789" for c in t), chars), share(count(".,;:"), chars), share(count("!?"), chars), share(count("#*$%&"), chars), share(count("|<>"), chars), share(count("\"'()-"), chars),
        share(sum(c not in known and ord(c) < 128 for c in t), chars), share(sum(ord(c) >= 128 for c in t), chars), share(count("\n"), chars), share(count(" \t\r\x0b\x0c"), chars), mean, np.sqrt(max(share(sum(n * n for n in lens), len(words)) - mean**2, 0)), np.log1p(max(lens, default=0)),
        of_words(lambda w: len(w) == 1), of_words(lambda w: len(w) <= 3), of_words(lambda w: ups(w) > 1 and not lows(w)), of_words(lambda w: w[-1] in "#*$%&"), of_words(lambda w: w[-1] in "!?"), of_words(lambda w: w in ("|", "<", ">")), of_words(lambda w: "A" <= w[0] <= "Z" and lows(w) > 0),
        np.log1p(lines), share(dup, lines), share(len(again), len(words)), np.log1p(len(set(words))) / max(np.log1p(len(words)), 1), share(max(Counter(words).values(), default=0), len(words)), np.log1p(share(len(words), lines)),
    ]


def test_statistics_of_each_text(docs, rows):
    got = {r.id: r.stats for r in q.measure(docs).collect()}
    assert got.keys() == {k for k, _ in rows}
    for k, t in rows:
        assert got[k] == pytest.approx(plain_statistics(t or ""), rel=1e-5, abs=1e-6), (k, t)


def world(spark, n=1500):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 120))]
        bad = k % 5 == 0
        if bad:
            words = rng.choice([lambda: [w + "%%%" for w in words], lambda: words[:2] * 40, lambda: [w.upper() + "!!" for w in words]])()
        docs.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(not bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    docs, labels = world(spark)
    model = q.fit(q.measure(docs.where("doc_id < 1000")), labels)
    got = {r.id: r.score for r in q.score(q.measure(docs.where("doc_id >= 1000")), model).collect()}
    bad = [s for k, s in got.items() if k % 5 == 0]
    good = [s for k, s in got.items() if k % 5]
    assert np.mean([s < 0.3 for s in bad]) > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.98


def test_model_against_plain_numpy(spark):
    """The same ridge, folds and calibration from one matrix of all rows."""
    docs, labels = world(spark, 700)
    model = q.fit(q.measure(docs).repartition(5), labels)
    marks = {r.doc_id: r.quality for r in labels.where("doc_id is not null and quality is not null").collect()}
    rows = q.measure(docs).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(q.FOLDS))).collect()
    rows = [r for r in rows if r.id in marks]
    x, y, fold = np.array([r.stats for r in rows]), np.array([marks[r.id] for r in rows], float), np.array([r.fold for r in rows])
    assert np.allclose(x.mean(0), model.mean, atol=1e-5) and np.allclose(x.std(0), model.scale, atol=2e-3)
    z = q.features(x, model.mean, model.scale)

    def ridge(z, y, p):
        reg = p * len(z) * np.eye(z.shape[1])
        reg[-1, -1] = 0
        return np.linalg.solve(z.T @ z + reg, z.T @ y)

    unseen = {p: np.zeros(len(y)) for p in q.PENALTIES}
    for p in q.PENALTIES:
        for k in range(q.FOLDS):
            unseen[p][fold == k] = z[fold == k] @ ridge(z[fold != k], y[fold != k], p)
    best = min(q.PENALTIES, key=lambda p: ((unseen[p] - y) ** 2).sum())
    assert np.allclose(ridge(z, y, best), model.weights, atol=1e-7)
    step = np.round(np.clip(unseen[best], q.LOW, q.HIGH) / q.STEP)
    at = np.unique(step)
    assert np.array_equal(at * q.STEP, model.at)
    # The nearest monotone values by the minimax formula.
    weight, mean = np.array([(step == s).sum() for s in at]), np.array([y[step == s].mean() for s in at])
    total, count = np.r_[0, np.cumsum(weight * mean)], np.r_[0, np.cumsum(weight)]
    want = [max(min((total[j] - total[i]) / (count[j] - count[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))]
    assert np.allclose(model.value, want)


def test_same_model_whatever_the_partitions(spark):
    docs, labels = world(spark, 600)
    a, b = (q.fit(q.measure(docs.repartition(n)), labels.repartition(n)) for n in (1, 7))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.value, b.value)


def test_kernel_is_gaussian():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, len(q.STATISTICS)))
    z = q.features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    want = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * q.WIDTH**2))
    assert np.abs(2 / q.FEATURES * z @ z.T - want).mean() < 0.06


def test_nulls_clashes_and_empty(spark, docs, odd, empty):
    _, labels = world(spark, 60)
    none, clean = labels.limit(0), labels.where("doc_id is not null")
    assert {r.score for r in q.score(q.measure(docs), q.fit(q.measure(docs), none)).collect()} == {0.5}
    assert {r.score for r in q.score(q.measure(docs), q.fit(q.measure(docs), clean.where("quality = 1"))).collect()} == {1.0}
    model = q.fit(q.measure(docs), labels)
    scored = q.score(q.measure(docs), model)
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    assert q.score(q.measure(odd), model).count() == 6 and q.score(q.measure(empty), model).count() == 0
    assert q.fit(q.measure(empty), labels).value.tolist() == [0.5]
