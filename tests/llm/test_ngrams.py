import numpy as np
import pyarrow as pa

from eventloom.llm import _ngrams


def test_an_ngram_is_asked_for_only_if_another_chunk_may_have_it():
    texts = {0: ["a b c d e", "p q r s"], 1: ["a b c x", "q r y"], 2: ["z z z"]}
    docs = {k: pa.table({"text": t, "train": [True] * len(t), "chunk": pa.array([k] * len(t), pa.int32())}) for k, t in texts.items()}
    rounds = _ngrams.Rounds(1, 3, None)
    told = _ngrams._count(pa.concat_tables([rounds.words(t) for t in docs.values()])).to_pylist()
    asked = {}
    for k, t in docs.items():
        found = rounds.informed(t, [[x for x in told if x["chunk"] == k]], {})
        rows = rounds.grams(t, found, {}).to_pylist()
        asked[k] = sum(len(_ngrams.unpack(x["counts"])) for x in rows)
        level = found.levels[2]
        # What isn't asked for is counted by its chunk.
        assert sum(x["tally"][0] for x in rows if x["tally"]) + asked[k] == len(level.key)
    # <s> a b and a b c; all others hold a bigram that no other chunk has.
    assert asked == {0: 2, 1: 2, 2: 0}


def test_hashes_are_sent_as_differences():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 100_000, np.uint64))
    sent = _ngrams.pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))
    assert len(sent) < 6.5 * len(keys)
    assert (np.cumsum(_ngrams.unpack(sent).view(np.uint64)) == keys).all()
    for values in ([], [0], [255], [256], [65536], [1 << 32], [-1, 5]):
        assert _ngrams.unpack(_ngrams.pack(np.array(values, np.int64))).tolist() == values


def test_hashes_that_differ_in_the_lowest_bits_are_told_apart():
    values = np.array([9, 7, 8, 7, 1 << 60, 3, (1 << 60) + 1, 9, 0], np.uint64)
    names, of, first = _ngrams._grouped(values)
    assert names.tolist() == sorted(set(values.tolist()))
    assert (names[of] == values).all() and (values[first] == names).all()


def test_texts_come_out_of_their_chunks_as_they_went_in():
    rows = pa.table({"doc": [5, None, 7, 8], "text": ["b é", "", "a\nb", ""], "train": [True, False, True, False], "chunk": pa.array([1, 0, 1, 2], pa.int32())})
    (packed,) = _ngrams._packed_texts(iter(rows.to_batches()))
    packed = pa.Table.from_batches([packed])
    got = [r for k in range(packed.num_rows) for r in _ngrams._opened(packed.slice(k, 1)).to_pylist()]
    assert got == rows.take([1, 0, 2, 3]).to_pylist()
