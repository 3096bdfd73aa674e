"""Every opN query on the smallest tables, against its SQL, the libraries or brute force, with the columns its contract names."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from eventloom.llm import katz, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

CONTRACT = {
    "op1_wu_manber": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_rank_merge": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_compression_bands": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_katz_backoff": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_nnpu": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_rabin_karp": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_sparse_suffix_array": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_bayes_minhash": "doc_id bigint, class_id bigint, n_links bigint",
    "op11_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12_viterbi_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_fourier_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {k: t or "" for k, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    from pyspark.sql import types as T

    got = queries.QUERIES[name](spark, SF).schema
    want = T.StructType.fromDDL(CONTRACT[name])
    assert {(f.name, f.dataType.simpleString()) for f in want} <= {(f.name, f.dataType.simpleString()) for f in got}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in places) for r in want.fetchall()), key=repr)


def test_piece_counts(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows_of(spark, "op2_rank_merge")
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        n = len(model.encode(t))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(t.encode()), n, n > 4096)


def test_quality_counts(spark, texts):
    got = rows_of(spark, "op3_compression_bands")
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        places = defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        again = len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
        failed = len(w) < 20 or 100 * again > 30 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, again, failed)
        assert not (failed and r.kept)


class Katz:
    """The trigram model from dictionaries; weights of histories are remembered."""

    def __init__(self, training):
        self.words, self.after = Counter(x for w in training for x in w), defaultdict(Counter)
        for w in training:
            w = ["<s>", *w]
            for i in range(1, len(w)):
                for k in (1, 2):
                    if i >= k:
                        self.after[tuple(w[i - k : i])][w[i]] += 1
        counts = [list(self.words.values()), *([c for h, f in self.after.items() if len(h) == k for c in f.values()] for k in (1, 2))]
        self.d = [katz.discounts(np.array([c.count(r) for r in range(1, 7)])) for c in counts]
        self.n, self.weight = sum(self.words.values()), {}
        left = sum((1 - self.d[0][c]) * c for c in self.words.values() if c <= 5)
        self.total, self.unknown = (self.n, left / self.n) if left else (self.n + 1, 1 / (self.n + 1))

    def cut(self, level, count):
        return count * (self.d[level][count] if count <= 5 else 1)

    def p(self, h, word):
        if not h:
            return self.cut(0, self.words[word]) / self.total if word in self.words else self.unknown
        if h not in self.after:
            return self.p(h[1:], word)
        f = self.after[h]
        size = sum(f.values()) + all(c > 5 for c in f.values())
        if word in f:
            return self.cut(len(h), f[word]) / size
        if h not in self.weight:
            self.weight[h] = (1 - sum(self.cut(len(h), c) for c in f.values()) / size) / (1 - sum(self.p(h[1:], x) for x in f))
        return self.p(h[1:], word) * self.weight[h]


def test_katz_scores(spark, texts):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    tokens = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in texts.items()}
    model = Katz([w for k, w in tokens.items() if not held[k]])
    got = rows_of(spark, "op5_katz_backoff")
    assert got.keys() == texts.keys()
    for k, w in tokens.items():
        r, padded = got[k], ["<s>", *w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(x in model.words for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.words[x] + 1) / (model.n + len(model.words) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(model.p(tuple(padded[max(0, i - 2) : i]), padded[i])) for i in range(1, len(padded))), rel=1e-9)


def test_toxicity_scores(spark, texts):
    got = rows_of(spark, "op6_nnpu")
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_toxicity_ignores_labels_of_held_out_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "labels":
            rows = rows.withColumn("toxic", F.when(queries.fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    flipped = {r.doc_id: r.score for r in queries.QUERIES["op6_nnpu"](spark, str(tmp_path)).collect()}
    assert flipped == pytest.approx({k: r.score for k, r in rows_of(spark, "op6_nnpu").items()})


def test_importance_ranks(spark, duck, texts):
    from test_importance import brute

    got = {k: (r.n_features, r.weight, r.score, r.rank) for k, r in rows_of(spark, "op11_importance_resampling").items()}
    assert got == brute(texts, [t for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()])


def test_quality_scores(spark, duck, texts):
    got, marks = rows_of(spark, "op13_fourier_quality"), dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    right = [r.predicted == marks[k] for k, r in got.items() if k in marks and r.held_out]
    assert np.mean(right) > 0.9


def test_quality_ignores_labels_of_held_out_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "labels":
            rows = rows.withColumn("quality", F.when(queries.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    flipped = {r.doc_id: r.score for r in queries.QUERIES["op13_fourier_quality"](spark, str(tmp_path)).collect()}
    assert flipped == {k: r.score for k, r in rows_of(spark, "op13_fourier_quality").items()}


def test_byte_pairs(spark, texts):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    got = rows_of(spark, "op9_byte_bpe")
    assert got.keys() == texts.keys()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for k, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(t.encode()))
