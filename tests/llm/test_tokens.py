import base64
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe, token_counts

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXT = st.lists(st.one_of(st.sampled_from(["the", "  ", " ", "\n", "'s", "'re", "'ll", " 'd", "ing", "<s>", "<0x0A>", "▁", "\x00", "１２", "é", "é", "漢字", "😀", " ", "　", "--", "'"]), st.text(max_size=6)), max_size=25).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def clean(text):
    return text.encode("utf-8", "ignore").decode()


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_equal_the_library(pieces, texts):
    texts = [clean(t) for t in texts]
    assert token_counts.load(PIECES).count_texts(pa.array(texts, pa.string())).tolist() == [len(x) for x in pieces.encode(texts)]


@pytest.mark.parametrize("text", ["a" * 3000, " " * 700 + "x", "\n" * 300, "漢" * 2000, "ab" * 900, *(" " * k + "y" + " " * k for k in range(0, 40, 3))])
def test_counts_of_runs(pieces, text):
    assert token_counts.load(PIECES).count_texts(pa.array([text])).tolist() == [len(pieces.encode(text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_equal_the_library_and_decode(ranks, texts):
    texts, b = [clean(t) for t in texts], bpe.load(RANKS)
    ids, at = b.encode(pa.array(texts, pa.string()))
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [ranks.encode_ordinary(t) for t in texts]
    data, places = b.decode(ids, b.offsets(ids, at), at)
    assert [data[x:y].tobytes().decode() for x, y in zip(places[:-1], places[1:], strict=True)] == texts


def test_scan_is_associative():
    s = bpe.Scanner()
    n = len(s.functions)
    assert all(s.then[s.then[a, b], c] == s.then[a, s.then[b, c]] for a in range(n) for b in range(n) for c in range(0, n, 2))


def test_count_tokens(docs, rows, pieces):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECES, limit=100).collect()}
    want = {k: (len((t or "").encode()), n := len(pieces.encode(t or "")), n > 100) for k, t in rows}
    assert got == want


def test_encode_and_decode(docs, rows, ranks):
    coded = bpe.encode(docs, RANKS, decoded=True)
    assert coded.columns == [*(c for c in docs.columns if c != "token_ids"), "token_ids", "token_starts", "decoded"]
    got = {r.doc_id: r for r in coded.collect()}
    for k, t in rows:
        assert got[k].token_ids == ranks.encode_ordinary(t or "")
        assert bytes(got[k].decoded).decode() == (t or "")
    again = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert {r.doc_id: bytes(r.decoded).decode() for r in again.collect()} == {k: t or "" for k, t in rows}


def test_empty_and_null_ids(empty, odd):
    assert token_counts.count_tokens(empty, PIECES).count() == bpe.encode(empty, RANKS).count() == 0
    assert token_counts.count_tokens(odd, PIECES).count() == bpe.encode(odd, RANKS).count() == 6


@pytest.mark.parametrize("text", [" " * 200_000 + "the", "ab" * 100_000, "é" * 200_000, "😀" * 200_000, "\n" * 200_000, "." * 200_000, "the " * 50_000])
def test_counts_of_very_long_runs(pieces, text):
    assert token_counts.load(PIECES).count_texts(pa.array([text])).tolist() == [len(pieces.encode(text))]


def test_a_million_spaces_take_seconds():
    start = time.perf_counter()
    assert token_counts.load(PIECES).count_texts(pa.array([" " * 1_000_000])).tolist() == [62_501]
    assert time.perf_counter() - start < 5


def test_models_that_change_texts_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: "▁" + text.lower())
    with pytest.raises(ValueError, match="changes texts"):
        token_counts.PieceModel(PIECES)
