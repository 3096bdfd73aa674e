import random
import re

import pytest
import zstandard

from eventloom.llm import quality
from eventloom.llm.quality import BANDS, quality as run


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    data = text.encode()
    press = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b))
    ratio = press(data) / len(data) if data else 0.0
    limits = lambda size: [(a, b) for n, a, b in BANDS if n <= size][-1]
    low, high = limits(len(data))
    bad = 0
    for i in range(0, len(data), 4096):
        part = data[i : i + 4096]
        a, b = limits(len(part))
        bad += 0 if a <= press(part) / len(part) <= b else len(part)
    odd = bad > 0.25 * len(data)
    kept = not failed and low <= ratio <= high and not odd
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed, kept


def test_against_brute_force(docs, rows):
    got = {r.doc_id: r for r in run(docs).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == expected(t), k


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(400))
    padded = " ".join(f"{rng.choice('abcdefgh')}{rng.choice('rstuv')}%%%%%%%%%%%%%%%%%%%%" for _ in range(400))
    got = {r.doc_id: r.reason for r in run(spark.createDataFrame([(1, noise), (2, padded), (3, "few words")], "doc_id bigint, text string")).collect()}
    assert got == {1: "incompressible", 2: "repetitive", 3: "base"}


def test_odd_tables(empty, odd):
    assert run(empty).count() == 0
    assert run(odd).count() == 6


def test_limits_by_length():
    low, high = quality.ratio_limits([0, 150, 5000])
    assert low.tolist() == [0.0, 0.64, 0.427] and high.tolist() == [1.30, 1.05, 0.60]


def test_every_part_of_a_text_is_judged(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900))[:4500]
    same = "same " * 700
    table = spark.createDataFrame(list(enumerate([prose, prose[:4096] + same, same + prose[:4096]])), "doc_id bigint, text string")
    got = {r.doc_id: r.reason for r in run(table, bands=((0, 0.0, 1.5), (1000, 0.2, 0.9)), max_repeat_percent=100).collect()}
    assert got == {0: None, 1: "chunks", 2: "chunks"}


def test_bands_are_measured_on_good_texts(spark, docs, empty):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, prose(rng.randrange(200, 400))) for k in range(300)] + [(k, "spam " + "again " * 300) for k in range(300, 340)]
    labels = spark.createDataFrame([(k, int(k < 300)) for k, _ in rows] + [(None, 1), (5, None), (7, 1)], "doc_id bigint, quality int")
    table = spark.createDataFrame([*rows, (None, "x"), (7, None)], "doc_id bigint, text string")
    held = "doc_id % 4 = 2"
    bands = quality.fit_bands(table.where(f"not {held}"), labels)
    assert len(bands) == len(BANDS) and bands != BANDS and all(a < b for _, a, b in bands)
    got = {r.doc_id: r.reason for r in run(table.where(held), bands=bands).collect()}
    assert all(got[k] is None for k in got if k < 300) and all(got[k] in ("base", "repetitive") for k in got if k >= 300)
    assert quality.fit_bands(empty, labels) == BANDS and quality.fit_bands(table, labels.limit(0)) == BANDS
    assert quality.fit_bands(table.repartition(7), labels) == quality.fit_bands(table.repartition(1), labels)


def test_bands_and_verdicts_against_one_text_at_a_time(spark):
    """Limits from every ratio of every good text, and what they say of each text, with plain loops."""
    import zstandard

    rng = random.Random(11)
    texts = {k: " ".join(rng.choice("the of and in that for with it as was".split()) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.choice([3, 60, 300, 900, 2000]))) for k in range(160)}
    texts |= {k: rng.choice(["spam spam eggs " * 400, "".join(rng.choice("0123456789abcdefghijklmnop ") for _ in range(6000))]) for k in range(160, 190)}
    marks = {k: int(k < 160) for k in texts if k % 5}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(3)
    labels = spark.createDataFrame(list(marks.items()), "doc_id int, quality int")

    def ratio(data):
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False).compress(data)) / len(data) if data else 0.0

    edges = [b[0] for b in quality.BANDS]

    def band(n):
        return max(i for i, e in enumerate(edges) if e <= n)

    seen = {}
    for k, mark in marks.items():
        if mark == 1:
            data = texts[k].encode()
            if data:
                seen.setdefault(band(len(data)), []).append(ratio(data))
            for size in [*(int(e) for e in edges if 0 < e <= quality.CHUNK_BYTES), quality.CHUNK_BYTES]:
                if len(data) > size:
                    at = (len(data) - size) // 2
                    seen.setdefault(band(size), []).append(ratio(data[at : at + size]))
    want = []
    for i, old in enumerate(quality.BANDS):
        r = seen.get(i, [])
        beyond = quality.MARGIN * (max(r) - min(r)) if r else 0
        want.append((old[0], max(min(r) - beyond, 0.0), max(r) + beyond) if len(r) >= quality.MIN_LABELLED else old)
    bands = quality.fit_bands(docs, labels)
    assert [x for b in bands for x in b] == pytest.approx([x for b in want for x in b])

    def fine(r, n):
        return want[band(n)][1] <= r <= want[band(n)][2]

    got = {r.doc_id: r for r in quality.quality(docs, bands=bands).collect()}
    rejected = 0
    for k, text in texts.items():
        data = text.encode()
        chunks = [data[i : i + quality.CHUNK_BYTES] for i in range(0, len(data), quality.CHUNK_BYTES)]
        odd = sum(len(c) for c in chunks if not fine(ratio(c), len(c))) / len(data)
        kept = not got[k].base_failed and fine(ratio(data), len(data)) and odd <= quality.BAD_CHUNKS
        assert got[k].kept == kept, k
        rejected += not kept and not got[k].base_failed
    assert rejected


def test_no_labelled_text_is_left_out_of_the_bands(spark):
    """The text that widens a band counts wherever its id's hash lies among many."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    n = 4600
    odd = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc(), F.desc("id")).limit(3).collect()}
    texts = [(k, "ab " * 50 if k in odd else "".join(rng.choice("etaoinshrdlu ") for _ in range(150))) for k in range(n)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1) for k in range(n)], "doc_id bigint, quality int")
    ratios = [len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False).compress(t.encode())) / len(t) for _, t in texts]
    beyond = quality.MARGIN * (max(ratios) - min(ratios))
    band = next(b for b in quality.fit_bands(docs, labels) if b[0] == 150)
    assert band[1:] == pytest.approx((max(min(ratios) - beyond, 0.0), max(ratios) + beyond))
