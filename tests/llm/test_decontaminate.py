import random
import re

import pytest

from eventloom.llm import decontaminate
from eventloom.llm.decontaminate import find_benchmark_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, passage in items:
        p = words(passage) if item is not None else []
        n = min(window, len(p))
        for k in range(len(p) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == p[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(3)
    long = [t for _, t in rows if len(words(t)) > 30]
    out = [(k, " ".join(rng.choice(long).split()[5:25])) for k in range(8)]
    return [*out, (8, out[0][1]), (9, "THE; of"), (10, "!!"), (11, None), (None, out[1][1]), (12, "never anywhere in these texts " * 4), (9, "égal")]


@pytest.mark.parametrize("table_bytes", [2 << 20, 400])
def test_against_brute_force(spark, docs, rows, items, table_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", table_bytes)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = find_benchmark_text(docs, bench)
    assert {"lang", "doc", "grams"} < set(found.columns) and found.columns.count("n_words") == 1
    got = {r.doc_id: (r.n_words, [i for s in r.hit_spans for i in range(s.start, s.end)], r.hit_items, r.n_hit) for r in found.collect()}
    for k, t in rows:
        n, hit, names = expected(t, items)
        assert got[k] == (n, hit, names, len(hit)), k


def test_empty_tables(spark, docs, empty, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_benchmark_text(docs, none).where("n_hit > 0 or size(hit_items) > 0").count() == 0
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id bigint, text string")
    assert find_benchmark_text(empty, bench).count() == 0
    assert find_benchmark_text(docs, bench, keep=["doc_id"]).columns == ["doc_id", "n_words", "n_hit", "hit_spans", "hit_items"]
    assert sorted(r.n_hit for r in find_benchmark_text(odd, bench).collect()) == [0, 11, 11, 11, 11, 11]
