import random
import re

import pytest

from eventloom import folders
from eventloom.functions import pandas_text
from eventloom.operators import index, search
from eventloom.operators.filters import EventFilter, FilterError
from eventloom.sources.appends import Conflict

WORDS = "a b The the of Ünïcode x1 9".split()
PHRASES = ["the", "a b", "of the of", "the the", "a a a", "ünicode", "x1 9 b", "nothing here"]


def world(spark, seed, sessions=12):
    rng = random.Random(seed)
    rows = [(f"s{s}", k, 100 * s + k, rng.choice(["en", "fr"]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60)))) for s in range(sessions) for k in range(5)]
    rows[3] = (*rows[3][:4], None)
    return spark.createDataFrame(rows, "session_id string, seq bigint, time bigint, type string, text string").repartition(3)


def revisions(docs, number, *changed):
    from pyspark.sql import functions as F

    return docs.select("session_id").distinct().withColumn("revision", F.when(F.col("session_id").isin(*changed), number).otherwise(1) if changed else F.lit(1))


def found(df):
    return sorted((r.session_id, r.seq, r.time, r.type, r.spans, r.length) for r in df.collect())


@pytest.mark.parametrize("phrase", PHRASES)
def test_index_finds_what_the_scan_finds(spark, tmp_path_factory, phrase):
    docs = world(spark, 1)
    folder = str(tmp_path_factory.getbasetemp() / "index-1")
    index.reconcile(docs, folder, revisions(docs, 1))
    where = EventFilter(types=["en"], seq=(1, 4))
    assert found(index.matches(spark, folder, phrase)) == found(search.matches(docs, phrase))
    assert found(index.matches(spark, folder, phrase, where)) == found(search.matches(docs, phrase, where))


def test_reconcile_indexes_only_what_changed(spark, tmp_path, monkeypatch):
    folder, docs = f"{tmp_path}/index", world(spark, 2)
    assert index.reconcile(docs, folder, revisions(docs, 1)) == 1
    assert index.reconcile(docs, folder, revisions(docs, 1)) == 1  # nothing to do
    new = world(spark, 3)
    mixed = docs.where("session_id not in ('s1', 's2', 's5')").unionByName(new.where("session_id in ('s1', 's2')"))
    written = []
    real = index._write_generation
    monkeypatch.setattr(index, "_write_generation", lambda d, *a: (written.append(sorted({r.session_id for r in d.collect()})), real(d, *a)))
    assert index.reconcile(mixed, folder, revisions(mixed, 2, "s1", "s2")) == 2
    assert written == [["s1", "s2"]]
    for phrase in PHRASES:
        assert found(index.matches(spark, folder, phrase)) == found(search.matches(mixed, phrase))
        assert found(index.matches(spark, folder, phrase, number=1)) == found(search.matches(docs, phrase))
    assert index.compact(spark, folder) == 3
    for phrase in PHRASES:
        assert found(index.matches(spark, folder, phrase)) == found(search.matches(mixed, phrase))
    best = index.best_sessions(spark, folder, "the").collect()
    assert [(r.session_id, r.seq) for r in best] == [(r.session_id, r.seq) for r in search.best_sessions(mixed, "the").collect()]


def test_plan_reads_only_the_buckets_of_the_words(spark, tmp_path):
    folder, docs = f"{tmp_path}/index", world(spark, 4)
    index.reconcile(docs, folder, revisions(docs, 1))
    got = index.matches(spark, folder, "of the")
    files = {f for f in got.inputFiles() if "/postings/" in f}
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET|=)[^\]]*", plan)
    assert pruned and "PushedFilters: [In(term, [of,the])" in plan
    read = spark.read.option("basePath", f"{folder}/postings").parquet(*files).where("bucket in (-1)")
    assert read.count() == 0
    scanned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET) \(?([\d, ]+)", plan)
    assert scanned is None or len(scanned[1].split(",")) <= 2


def test_a_failed_or_late_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    folder, docs = f"{tmp_path}/index", world(spark, 5)
    with pytest.raises(FileNotFoundError):
        index.matches(spark, folder, "the")
    index.reconcile(docs, folder, revisions(docs, 1))
    files = lambda: {p for p in (tmp_path / "index").glob("*/*") if p.name != "_commits"}
    before, changed = files(), revisions(docs, 7, "s3")
    real = folders.put
    monkeypatch.setattr(index, "put", lambda spark_, f, base, content: (real(spark_, f, base, {**content}), real(spark_, f, base, content)))
    with pytest.raises(Conflict):
        index.reconcile(docs, folder, changed)
    assert {p for p in files() if "_commits" not in str(p)} == {p for p in before if "_commits" not in str(p)}
    with pytest.raises(FilterError):
        index.matches(spark, folder, "  ")


def test_postings_of_empty_and_very_long_texts(spark):
    docs = spark.createDataFrame([("a", 0, ""), ("a", 1, None), ("b", 0, "word " * 50_000)], "session_id string, seq bigint, text string")
    got = {(r.session_id, r.seq, r.term): r.positions for r in index.postings(docs).collect()}
    assert list(got) == [("b", 0, "word")] and got["b", 0, "word"] == list(range(50_000))
    assert pandas_text.fold("") == []


def test_a_word_of_many_documents_is_few_rows(spark, tmp_path):
    folder, docs = f"{tmp_path}/index", world(spark, 6, sessions=80).coalesce(2)
    index.reconcile(docs, folder, revisions(docs, 1))
    held = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/postings")
    words = {w for r in docs.collect() for w in pandas_text.fold(r.text or "")}
    assert held.count() <= 2 * len(words) and {r.term for r in held.collect()} == words
    want = {(r.session_id, r.seq, w): [k for k, x in enumerate(pandas_text.fold(r.text)) if x == w] for r in docs.collect() if r.text for w in pandas_text.fold(r.text)}
    assert {(r.session_id, r.seq, r.term): r.positions for r in index.postings(docs).collect()} == want
    assert index.compact(spark, folder) == 2
    assert found(index.matches(spark, folder, "of the")) == found(search.matches(docs, "of the"))


def test_marks_are_left_out_of_words_one_by_one():
    import unicodedata

    for c in map(chr, [*range(0x250), *range(0x300, 0x370), 0x591, 0x93C, 0x3099, 0x20D0, 0x1D165, 0x1F600]):
        plain = unicodedata.normalize("NFD", f"a{c}b".lower())
        assert pandas_text.fold(f"a{c}b") == re.findall(r"[^\W_]+", "".join(x for x in plain if not unicodedata.combining(x)))
