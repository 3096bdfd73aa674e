import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import toxicity
from eventloom.llm._text import text_hashes

CLEAN = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(900):
        words = [rng.choice(CLEAN) for _ in range(40)]
        toxic = k % 8 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Scum", "idiot", "trashy"])
        docs.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs.where("doc_id < 600"), labels)
    assert 0.05 < model.prior < 0.2
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.where("doc_id >= 600"), model).collect()}
    toxic = [s for k, s in got.items() if k % 8 == 0]
    clean = [s for k, s in got.items() if k % 8]
    assert np.mean([s >= 0.3 for s in toxic]) > 0.95 and np.mean([s < 0.3 for s in clean]) > 0.95


def test_same_model_whatever_the_partitions(labelled):
    docs, labels = labelled
    a, b = (toxicity.fit(docs.repartition(n), labels, max_toxic=40, max_unlabelled=200) for n in (1, 7))
    assert a.features.tolist() == b.features.tolist() and np.allclose(a.weights, b.weights)


def test_clashes_nulls_and_empty(spark, labelled, docs, odd, empty):
    model = toxicity.fit(*labelled)
    scored = toxicity.score(docs.withColumn("toxicity", F.lit("old")), model)
    assert scored.columns == [*docs.columns, "toxicity"] and scored.where("toxicity between 0 and 1").count() == docs.count()
    assert toxicity.score(odd, model).count() == 6 and toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.toxicity for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.fit(empty, labelled[1]).bias.size == 0


def test_risk_never_rewards_negative_loss():
    rng = np.random.default_rng(0)
    toxic = [np.array([1, 2, k]) for k in rng.integers(10, 60, 30)]
    others = [np.array([3, k]) for k in rng.integers(10, 60, 100)]
    model = toxicity.train(toxic, others, 0.2)
    assert np.isfinite(model.weights).all() and (model.weights[:, model.features == 1] > 0).all()


@pytest.mark.parametrize("shift", [-3.0, 0.0, 2.0])
def test_step_against_differences_of_the_risk(shift):
    rng = np.random.default_rng(1)
    n, prior = 12, 0.4
    copies = np.r_[rng.random(4), np.zeros(8)]
    share = np.r_[np.zeros(4), np.full(8, 1 / 8)]
    f = rng.normal(size=n) + np.where(copies > 0, -shift, shift)

    def parts(x):
        clean = np.log1p(np.exp(x))
        return prior * (copies @ np.log1p(np.exp(-x))), share @ clean - prior * (copies @ clean)

    wanted = (lambda x: -parts(x)[1]) if parts(f)[1] < 0 else (lambda x: sum(parts(x)))
    steps = [(wanted(f + e) - wanted(f - e)) / 2e-5 for e in np.eye(n) * 1e-5]
    assert np.allclose(toxicity.step_gradient(f, copies, share, prior), steps, atol=1e-6)


def test_sample_is_bounded_by_hash_first(spark):
    ids = spark.range(50_000)
    wanted = [r.id for r in ids.orderBy(F.xxhash64("id"), "id").limit(700).collect()]
    assert [r.id for r in toxicity._least(ids, 700, 50_000).collect()] == wanted


class Plain:
    """The classifier from sets and dense matrices: features a word at a time, every step written out."""

    WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    @classmethod
    def features(cls, text):
        words = cls.WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))

        def named(data, salt):
            return int(text_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), salt)[0]) >> (64 - toxicity.FEATURE_BITS)

        return {named(w, 0) for w in words} | {named(w[:4], 1) for w in words if len(w) > 4}

    def __init__(self, toxic, others, prior, steps=100, rate=0.05, l1=1e-4):
        both = [*toxic, *others]
        n, m = len(toxic), len(others)
        chosen = []
        for f in sorted(set().union(*both)):
            a, b = sum(f in t for t in toxic), sum(f in t for t in others)
            p = (a + b) / (n + m)
            if a >= 3 and abs(a / n - b / m) > 5 * math.sqrt(p * (1 - p) * (1 / n + 1 / m)):
                chosen.append(f)
        self.chosen, self.models = chosen, []
        x = np.array([[f in t for f in chosen] for t in both], float).reshape(n + m, len(chosen))
        rng = np.random.default_rng(7)
        for _ in range(3):
            copies = np.bincount(rng.integers(0, n, n), minlength=n + m) / n
            share = np.r_[np.zeros(n), np.full(m, 1 / m)]
            w, first, second = np.zeros(len(chosen) + 1), 0.0, 0.0
            w[-1] = math.log(prior / (1 - prior))
            ones = np.c_[x, np.ones(n + m)]
            for step in range(1, steps + 1):
                f = ones @ w
                p = 1 / (1 + np.exp(-f))
                clean = (share - prior * copies) * p  # of the risk of calling clean what is not
                risk = share @ np.log1p(np.exp(f)) - prior * copies @ np.log1p(np.exp(f))
                g = ones.T @ (-clean if risk < 0 else clean - prior * copies * (1 - p))
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
                size = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
                w = w - size * first / (1 - 0.9**step)
                w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - size[:-1] * l1, 0)
            self.models.append(w)

    def score(self, text):
        have = self.features(text)
        x = np.array([*(f in have for f in self.chosen), 1.0])
        return float(np.mean([1 / (1 + math.exp(-x @ w)) for w in self.models]))


def test_scores_against_dense_matrices(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null").collect()}

    def ordered(group):
        sets = [np.array(sorted(Plain.features(t)), np.int32) for t in group]
        return [set(s.tolist()) for s in sorted(sets, key=lambda s: (zlib.crc32(s.tobytes()), s.tobytes()))]

    prior = sum(marks.values()) / len(marks)
    plain = Plain(ordered(texts[k] for k, m in marks.items() if m == 1), ordered(texts.values()), prior)
    assert plain.chosen == model.features.tolist() and len(plain.chosen) > 2 and model.prior == pytest.approx(prior)
    assert np.allclose(model.weights, [w[:-1] for w in plain.models], atol=1e-9) and np.allclose(model.bias, [w[-1] for w in plain.models], atol=1e-9)
    odd = [*list(texts.values())[:50], None, "", "SCUM idiot's trashy-scum", "x" * 5000, "漢字 égal"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(rows, model).collect()}
    assert got == pytest.approx({k: plain.score(t) for k, t in enumerate(odd)}, abs=1e-9)
