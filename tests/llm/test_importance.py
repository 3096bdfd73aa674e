import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import importance
from eventloom.llm._text import ALNUM, LOWER, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, target, *, max_run=2, buckets=10_000, min_words=20, percent=25, seed=7):
    """The contract from dictionaries and the standard library."""
    words = {k: WORD.findall((t or "").translate(UPPER)) for k, t in docs.items()}

    def features(w):
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    source = Counter(b for w in words.values() for b in features(w))
    wanted = Counter(b for t in target for b in features(WORD.findall((t or "").translate(UPPER))))
    s_all, t_all = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in source}
    out = {}
    for k, w in words.items():
        f = features(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        out[k] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[k][2], k) for k, w in words.items() if len(w) >= min_words)
    for rank, (_, k) in enumerate(able[: len(able) * percent // 100], 1):
        out[k][3] = rank
    return {k: tuple(v) for k, v in out.items()}


def rows_of(frame):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in frame.collect()}


@pytest.mark.parametrize("options", [{}, {"max_run": 3, "buckets": 97, "percent": 60, "min_words": 5}, {"max_run": 1, "buckets": 65536, "seed": 11}])
def test_against_brute_force(spark, docs, rows, options):
    target = [(k, t) for k, t in rows if k % 9 == 0]
    got = rows_of(importance.resample(docs, spark.createDataFrame(target, "item_id int, text string"), **options))
    assert got == brute(dict(rows), [t for _, t in target], **options)
    assert any(r[3] for r in got.values())


def test_joined_checksums():
    rng = random.Random(0)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(40)]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    got = importance.joined_checksums(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("max_run", [1, 2, 4])
def test_streams_of_few_words(max_run):
    texts = [b"", b"one", b"one two", b"--", b"A b c d e", "é漢 x".encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    stream, ends = importance.bucket_streams(Words(LOWER[data], at, ALNUM), max_run, 1000)
    for k, t in enumerate(texts):
        w = WORD.findall(t.decode().translate(UPPER))
        assert sorted(stream[ends[k] : ends[k + 1]].tolist()) == sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % 1000 for n in range(1, max_run + 1) for i in range(len(w) - n + 1))


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda id_, seed: F.lit(5).cast("bigint"))
    docs = spark.createDataFrame([(k, "a b " * 12) for k in range(40)], "doc_id bigint, text string").repartition(7)
    got = rows_of(importance.resample(docs, docs.limit(0)))
    assert [got[k][3] for k in range(40)] == [*range(1, 11), *[None] * 30]


def test_null_ids_repeated_rows_and_empty(spark, odd, empty):
    got = importance.resample(odd, odd, percent=100).collect()
    assert sorted((r.doc_id is None, r.score is None, r.rank is None) for r in got) == [(False, False, False)] * 3 + [(True, True, True)] * 3
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert importance.resample(empty, odd).count() == 0
    same = {r.weight for r in importance.resample(odd, empty).collect()}
    assert len(same) == 2  # the five texts, and the empty one
    with pytest.raises(ValueError):
        importance.resample(odd, odd, buckets=70_000)
