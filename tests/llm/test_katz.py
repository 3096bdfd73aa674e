import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Model:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.uni, self.pairs = Counter(), Counter()
        for w in texts:
            self.uni.update(w)
            self.pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.n = sum(self.uni.values())
        self.d1, self.d2 = (katz.discounts(np.array([sum(v == r for v in c.values()) for r in range(1, 7)])) for c in (self.uni, self.pairs))
        left = sum((1 - self.d1[c]) * c for c in self.uni.values() if c <= 5)
        total = self.n if left else self.n + 1
        self.p1 = {w: self.cut(c, self.d1) / total for w, c in self.uni.items()}
        self.unknown = left / self.n if left else 1 / (self.n + 1)
        self.after = defaultdict(dict)
        for (a, b), c in self.pairs.items():
            self.after[a][b] = c

    @staticmethod
    def cut(c, d):
        return c * (d[c] if c <= 5 else 1)

    def p(self, a, b):
        base = self.p1.get(b, self.unknown)
        if a not in self.after:
            return base
        f = self.after[a]
        size = sum(f.values()) + (0 if any(c <= 5 for c in f.values()) else 1)
        if b in f:
            return self.cut(f[b], self.d2) / size
        left = 1 - sum(self.cut(c, self.d2) for c in f.values()) / size
        return base * left / (1 - sum(self.p1[x] for x in f))


def tokens(text):
    return [*WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), None]


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_against_brute_force(docs, rows, chunk):
    train = F.col("doc_id") % 4 != 1
    got = {r.doc_id: r for r in katz.score(docs, train, chunk_bytes=chunk).collect()}
    model = Model([tokens(t) for k, t in rows if k % 4 != 1])
    assert len(got) == len(rows)
    for k, t in rows:
        w, r = tokens(t), got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (len(w), sum(x in model.uni for x in w), model.n, k % 4 != 1)
        assert r.base_score == pytest.approx(sum(math.log10((model.uni[x] + 1) / (model.n + len(model.uni) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(model.p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), rel=1e-9)


class Backoff:
    """A model of any order from dictionaries, by recursion."""

    def __init__(self, texts, order):
        self.order, self.low = order, Model(texts)
        self.after = [defaultdict(Counter) for _ in range(order + 1)]
        for w in texts:
            w = ["<s>", *w]
            for i in range(1, len(w)):
                for k in range(1, min(order - 1, i) + 1):
                    self.after[k][tuple(w[i - k : i])][w[i]] += 1
        self.d = [katz.discounts(np.array([sum(v == r for f in level.values() for v in f.values()) for r in range(1, 7)])) for level in self.after]

    def p(self, h, b):
        if not h:
            return self.low.p1.get(b, self.low.unknown)
        f = self.after[len(h)].get(h)
        if f is None:
            return self.p(h[1:], b)
        size = sum(f.values()) + (0 if any(c <= 5 for c in f.values()) else 1)
        if b in f:
            return Model.cut(f[b], self.d[len(h)]) / size
        left = 1 - sum(Model.cut(c, self.d[len(h)]) for c in f.values()) / size
        return self.p(h[1:], b) * left / (1 - sum(self.p(h[1:], x) for x in f))


@pytest.mark.parametrize(("order", "chunk"), [(3, 8 << 20), (3, 2000), (4, 2000)])
def test_higher_orders_against_brute_force(docs, rows, order, chunk):
    train = F.col("doc_id") % 4 != 1
    got = {r.doc_id: r.score for r in katz.score(docs, train, chunk_bytes=chunk, order=order).collect()}
    model = Backoff([tokens(t) for k, t in rows if k % 4 != 1], order)
    assert len(got) == len(rows)
    for k, t in rows:
        w = ["<s>", *tokens(t)]
        assert got[k] == pytest.approx(sum(math.log10(model.p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w))), rel=1e-9)
    for h in [("<s>",), *list(model.after[order - 1])[:20]]:
        assert sum(model.p(h, b) for b in [*model.low.uni, "unknown"]) == pytest.approx(1)


def test_trigrams_in_odd_tables(odd, empty, docs):
    assert katz.score(empty, F.lit(True), order=3).count() == 0
    assert all(r.train_tokens == 0 and r.score == 0 for r in katz.score(docs, F.lit(False), order=3).collect())
    got = katz.score(odd, F.col("doc_id") == 7, order=3).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) for r in got)


def test_tables(spark, docs, rows, tmp_path):
    katz.store(docs, F.col("doc_id") % 4 != 1, str(tmp_path / "model"), chunk_bytes=2000, order=3)
    words, pairs, triples = (spark.read.parquet(str(tmp_path / "model" / f"order={k}")).collect() for k in (1, 2, 3))
    texts = [tokens(t) for k, t in rows if k % 4 != 1]
    model = Backoff(texts, 3)
    assert sorted(r["count"] for r in words) == sorted(model.low.uni.values())
    assert sorted(r["count"] for r in pairs) == sorted(model.low.pairs.values())
    assert sorted(r["count"] for r in triples) == sorted(c for f in model.after[2].values() for c in f.values())
    ids = {r.id for r in words} | {0}
    assert len(ids) == len(model.low.uni) + 1 and all(r.history in ids and r.word in ids for r in pairs) and all(r.word in ids for r in triples)


def test_sums_to_one(rows):
    model = Model([tokens(t) for k, t in rows])
    for a in ["<s>", "the", "word", "never"]:
        assert sum(model.p(a, b) for b in [*model.uni, "unknown"]) == pytest.approx(1)


def test_odd_tables(odd, empty, docs):
    assert katz.score(empty, F.lit(True)).count() == 0
    none = katz.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 for r in none)
    got = katz.score(odd, F.col("doc_id") == 7).collect()
    assert len(got) == 6 and {r.train_tokens for r in got} == {162} and sum(r.train for r in got) == 2


def test_discounts():
    assert katz.discounts(np.array([100, 40, 22, 15, 11, 9])).tolist() == pytest.approx([1.0, *katz.discounts(np.array([100, 40, 22, 15, 11, 9]))[1:]])
    assert katz.discounts(np.zeros(6)).tolist() == [1.0, 0.5, 0.75, 2.5 / 3, 0.875, 0.9]


def test_words_of_equal_polynomials_are_told_apart(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate({97: 98, 98: 97})
    other = one.translate({97: 98, 98: 97})
    table = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_known for r in katz.score(table, F.col("doc_id") == 1, order=3).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_questions_follow_the_text_whatever_the_partitions(rows):
    """Of one chunk: entries of n-grams and histories don't grow with the number of partitions."""
    docs = pa.table({"text": pa.array([t for _, t in rows] * 3), "train": pa.array([k % 4 != 1 for k, _ in rows] * 3)})
    entries = {}
    for parts in (1, 16, 256, 4096, 1 << 20):
        chunk = katz.Chunk(docs, parts)
        seen = np.bincount(chunk.word_of, chunk.learnt, len(chunk.words)).astype(np.int64)
        chunk.learn_words(seen, katz._tally(seen))
        asked = list(chunk.ask(np.arange(len(chunk.words)) + 1))
        level = chunk.levels[0]
        grams, heads = len(level.head), len(np.unique(level.history[level.history_count > 0]))
        entries[parts] = sum(len(x[1][0]) for x in asked)
        assert len(asked) <= entries[parts] <= grams + heads
        assert sum(len(x[1][4]) for x in asked) == grams  # each n-gram in one place
        assert sum(level.at_home) == heads  # each history at one home
    assert len(np.unique(level.part[level.head == np.bincount(level.head).argmax()])) > 10  # a frequent history's n-grams are spread
