import re

import numpy as np
import pytest

from eventloom.llm import minhash_join, substring_dedup, suffix_dedup
from eventloom.llm.minhash_join import HASHES, STEP, least_matches, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(rows, width):
    first = {}
    texts = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, w in texts:
        for i in range(len(w) - width + 1) if k is not None else ():
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, w in texts:
        gone = {j for i in range(len(w) - width + 1) if k is not None and first[tuple(w[i : i + width])] < k for j in range(i, i + width)}
        out.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [50, 12])
@pytest.mark.parametrize("hot", [None, 2, 40, 1 << 15])
def test_repeats_against_brute_force(docs, rows, width, hot):
    if hot is None:
        found = substring_dedup.remove_repeats(docs, keep=("lang", "grams"), width=width)
    else:
        found = suffix_dedup.remove_repeats(docs, keep=("lang", "grams"), width=width, piece=hot)
    assert found.columns == ["doc_id", "lang", "grams", "n_words", "n_removed", "removed", "kept_text"]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == without_repeats(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_repeats_in_odd_tables(module, odd, empty):
    assert module.remove_repeats(empty).count() == 0
    got = sorted((str(r.doc_id), r.n_removed) for r in module.remove_repeats(odd).collect())
    assert got == [("7", 0), ("7", 0), ("9", 80), ("None", 0), ("None", 0), ("None", 0)]


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_repeats_in_a_lone_short_document(spark, module):
    texts = [(k, " ".join(f"w{i}" for i in range(k))) for k in range(61)]
    rows = [(k if own else None, t) for k, t in texts for own in (True, False)]
    # A document a partition and so a batch of its own, those without an id too.
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = module.remove_repeats(table).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == without_repeats(rows, 50)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


@pytest.fixture(scope="module")
def alike(spark):
    """Texts that differ in one word of a pair that polynomials modulo 2**64 can't tell apart, and ids with two texts."""
    one = thue_morse(1024)
    other = one.translate({97: 98, 98: 97})
    words = [f"w{k}" for k in range(60)]
    with_word = lambda w: " ".join([*words[:30], w, *words[30:]])
    rows = [(1, with_word(one)), (2, with_word(other)), (3, "x " + with_word(one)), (4, other), (5, one)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_words_of_equal_polynomials(module, alike):
    rows, table = alike
    got = module.remove_repeats(table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == without_repeats(rows, 50)


def test_links_of_words_of_equal_polynomials(alike):
    rows, table = alike
    got = {r.doc_id: r for r in near_duplicates(table).collect()}
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == links_of(rows)
    assert all(r.copy_of == k for k, r in got.items())


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_kept_columns_with_names_of_the_result(spark, module):
    table = spark.createDataFrame([(1, "a b", 7, "x", 9)], "doc_id bigint, text string, n_words int, kept_text string, lang int")
    found = module.remove_repeats(table, keep=("n_words", "kept_text", "lang", "doc_id", "lang"))
    assert found.columns == ["doc_id", "lang", "n_words", "n_removed", "removed", "kept_text"]
    assert found.first().asDict() == {"doc_id": 1, "lang": 9, "n_words": 2, "n_removed": 0, "removed": [], "kept_text": "a b"}


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_a_passage_in_very_many_documents(spark, module):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{'a' * (k % 7)} b{k} {passage} c{k % 5} d{k}") for k in range(1500)] + [(2000, " ".join(f"q{k % 90}" for k in range(60_000)))]
    got = module.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == without_repeats(rows, 50)


def test_only_pairs_that_share_a_band_are_compared(spark):
    # Each text overlaps the next one by two thirds: a chain of bands without a link.
    words = [f"v{k}" for k in range(6_000)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 60])) for k in range(590)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    described = minhash_join.describe(table.selectExpr("doc_id as doc", "text", "xxhash64(text) as t"), "bigint", 5).toPandas()
    bands = np.stack(described["bands"].to_list())
    sharing = sum((bands[i] == bands[j]).any() for i in range(len(bands)) for j in range(i + 1, min(i + 7, len(bands))))
    met = minhash_join.units(spark.createDataFrame(described[["c1", "c2", "size", "bands"]])).toPandas().sort_values("unit", kind="stable")
    unit = met["unit"].to_numpy()
    ends = np.searchsorted(unit, unit, "right")
    found = minhash_join.candidate_pairs(ends, met["side"].to_numpy(), met["band"].to_numpy(), np.stack(met["bands"].to_list()), met["size"].to_numpy(), 0.8, 1e-9)
    assert sharing > 100 and sum(n for n, _, _ in found) == sharing
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in near_duplicates(table).collect())


def test_texts_of_one_id_are_documents_each(spark):
    a, b, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "abz")
    rows = [(1, a), (2, a), (2, z), (None, a), (None, a), (3, b + " more"), (4, b), (4, b), (5, None), (5, None), (6, z + " end")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got if r.stays and r.doc_id) == [1, 2, 3, 5, 5] and sum(r.doc_id is None and r.stays for r in got) == 2
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (2, 2), (None, None), (3, 3), (4, 3), (5, 5), (6, 2)}


def links_of(rows, threshold=0.8):
    sets = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    links = {k: {j for j in sets if j != k and sets[k] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])} for k in sets}
    classes = {}
    for k in sorted(links):
        todo, seen = [k], {k}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        classes[k] = min(seen)
    return {k: (classes[k], len(links[k])) for k in links}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_against_brute_force(docs, rows, block, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK_DOCS", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert got == links_of(rows)


def test_near_duplicates_in_odd_tables(odd, empty):
    assert near_duplicates(empty).count() == 0
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near_duplicates(odd).collect())
    assert got == [("7", "7", 2), ("7", "7", 2), ("9", "7", 2), ("None", "None", 0), ("None", "None", 0), ("None", "None", 0)]


def test_posterior_bound():
    least = least_matches(0.8, 1e-9)
    assert len(least) == HASHES // STEP and least == sorted(least) and 0 < least[0] < STEP and least[-1] < 0.8 * HASHES
    assert least_matches(0.8, 1e-2)[-1] > least[-1]
