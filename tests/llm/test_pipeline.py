import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import bpe, queries


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Clean, toxic, copied, repeated and contaminated documents, each kind by its ids."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = {k: prose(120) for k in range(300)}
    for k in range(0, 300, 6):
        w = docs[k].split()
        w[7] = rng.choice(["scum", "idiot"])
        docs[k] = " ".join(w)
    # Labels of a quarter of the rows aren't learnt from, by the checksums of their ids.
    labels = [(k, 1, int(k % 6 == 0)) for k in range(300)]
    docs |= {300 + k: docs[k + 1] for k in range(3)} | {310: docs[5].replace(docs[5].split()[60], "edited")}
    passage = prose(60)
    docs |= {k: f"{prose(70)} {passage} {prose(70)}" for k in (320, 321)}
    item = prose(25)
    docs |= {330: f"{prose(50)} {item} {prose(40)}", 331: None, 332: ""}
    folder = tmp_path_factory.mktemp("world")
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as n_words").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, passage


def test_stages_take_effect(spark, world):
    folder, docs, passage = world
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    gone = {*range(0, 300, 6), 300, 301, 302, 310, 330}
    assert set(got) == set(docs) - gone
    assert passage in got[320].text and passage not in got[321].text
    for k, r in got.items():
        if k != 321:
            assert r.text == (docs[k] or "")
        assert r.n_tokens == len(r.token_ids)


def test_toxicity_rejects_what_the_operator_predicts(spark, world, monkeypatch):
    scores = F.col("doc_id") / 1000
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, model: docs.withColumn("toxicity", scores))
    table = spark.range(1000).selectExpr("id as doc_id", "'a' as text", "'en' as lang", "'s' as source", "1 as n_chars")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, world[0]).collect()}
    assert left == {k for k in range(1000) if k / 1000 < queries.TOXIC_AT}


def test_each_stage_alone_keeps_clean_documents(spark, world):
    folder, docs, _ = world
    table = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {"toxicity": set(range(0, 300, 6)), "near_duplicates": {300, 301, 302, 310}, "repeated_passages": set(), "decontamination": {330}, "encoding": set()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, folder)
        assert {r.doc_id for r in out.select("doc_id").collect()} == set(docs) - gone[name], name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS


def test_stages_on_odd_rows(spark, world):
    folder = world[0]
    rows = [(None, "a b", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", None, None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
        assert stage(spark, table, folder).count() == 5, name


def test_near_duplicates_go_by_id_and_content(spark, world):
    a, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "az")
    rows = [(1, a), (2, a), (2, z), (None, a), (None, a), (3, None), (3, None), (4, " "), (5, z), (5, z), (1, a)]
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, table, world[0]).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, a), (2, z), (None, a), (None, a), (3, None), (3, None), (4, " ")], key=repr)


def test_a_failed_run_goes_on(spark, world, tmp_path, monkeypatch):
    folder = str(tmp_path / "stages")
    done = []

    def watched(name, stage, fails=False):
        def run(*args):
            done.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f, fails=n == "repeated_passages") for n, f in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, world[0], folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(n, f) for n, f in stages])
    again = corpus_pipeline.run(spark, world[0], folder)
    assert done == ["toxicity", "near_duplicates", "repeated_passages", "repeated_passages", "decontamination", "encoding"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, world[0]).collect()}


def test_encoding_round_trip(spark, world):
    coded = corpus_pipeline.encode(spark, spark.read.parquet(f"{world[0]}/documents.parquet"), world[0])
    table = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = coded.where("doc_id = 5").first()
    assert b"".join(table.bytes[table.places[i] : table.places[i + 1]].tobytes() for i in r.token_ids).decode() == world[1][5]


def test_held_out_labels_teach_nothing(spark, world, monkeypatch):
    taught = []
    real = corpus_pipeline.toxicity.fit
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: (taught.append({r.doc_id for r in docs.select("doc_id").collect()}), real(docs, labels))[1])
    folder, docs, _ = world
    corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert taught == [{k for k in docs if zlib.crc32(str(k).encode()) % 4 != 2}]
