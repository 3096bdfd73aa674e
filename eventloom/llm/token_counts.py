"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import PairRanks, all_splits, merge
from ._text import binaries, buffers, chunks

#: Distinct pre-tokens whose counts a worker remembers before it starts anew.
CACHE = 300_000
_SPACE = "▁"
#: Characters that the usual normalisers change: ligatures, wide forms, accents apart, white space.
_PROBE = "ﬁ Ａ e\u0301 ½  a\u3000b\u00a0c\td \u200b "


class PieceModel:
    """What counting needs of a BPE model with byte fallback.

    White space becomes a mark that only ever begins a piece, so a text falls
    into pre-tokens before each mark that follows something else; control
    characters that no longer piece contains stand alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(_PROBE) != _SPACE + _PROBE.replace(" ", _SPACE):
            raise ValueError("the model changes texts before it cuts them")
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(b == _SPACE != a for p in scores for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds white space after other characters")
        chars = {c for p in scores for c in p} - scores.keys()
        pieces = {p: k for k, p in enumerate([*scores, *sorted(chars)])}
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: levels[s] for p, s in scores.items()}
        counts = np.bincount([rank[p] for p in scores if len(p) > 1], minlength=1)
        tied = np.flatnonzero(counts > 1)
        if len(tied) > 1:
            raise ValueError("more than one score is shared by several pieces")
        self.tied = int(tied[0]) if len(tied) else -1
        left, right, ranks, product = all_splits(pieces, rank)
        if self.tied >= 0 and (ranks.max() > self.tied or np.isin(np.r_[left[ranks < self.tied], right[ranks < self.tied]], product[ranks == self.tied]).any()):
            raise ValueError("pieces of a shared score aren't the last to be merged")
        self.pairs = PairRanks(left, right, ranks, product)
        self.weight = np.array([1 if p in scores else len(p.encode()) for p in pieces] + [1, 2, 3, 4], np.int64)
        self.symbol = np.full(0x110000, len(pieces), np.int32)
        self.symbol[0x80:] += 1
        self.symbol[0x800:] += 1
        self.symbol[0x10000:] += 1
        for p, k in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = k
        joined = {c for p in scores if len(p) > 1 for c in p}
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in range(128) if chr(b) not in joined and chr(b) != " "]] = True
        self.cache: dict[bytes, int] = {}

    def pre_tokens(self, data: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each pre-token begins, and the end."""
        if not len(data):
            return np.zeros(1, np.int64)
        space, alone = data == 0x20, self.alone[data]
        begin = alone.copy()
        begin[0] = True
        begin[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
        begin[docs[:-1][docs[:-1] < docs[1:]]] = True
        return np.append(np.flatnonzero(begin), len(data))

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        names = words.to_pylist()
        cache = self.cache
        known = [cache.get(w, -1) for w in names]
        out = np.array(known, np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            texts = [names[k].decode().replace(" ", _SPACE) for k in missing]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            offsets = np.r_[0, np.cumsum(lengths)]
            symbols, places = merge(self.symbol[points], offsets, self.pairs, self.tied)
            total = np.r_[0, np.cumsum(self.weight[symbols])]
            at = np.searchsorted(places, offsets)
            out[missing] = np.diff(total[at])
            if len(cache) > CACHE:
                cache.clear()
            cache.update(zip([names[k] for k in missing], out[missing].tolist(), strict=True))
        return out

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; the library puts a space before a text that isn't empty."""
        empty = pc.equal(pc.binary_length(texts), 0)
        texts = pc.binary_join_element_wise(" ", texts, "")
        texts = pc.replace_substring(pc.if_else(empty, "", texts), _SPACE, " ")
        data, docs = buffers(texts)
        begins = self.pre_tokens(data, docs)
        coded = binaries(data, begins).dictionary_encode()
        each = self.counts(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        total = np.r_[0, np.cumsum(each)]
        return np.diff(total[np.searchsorted(begins, docs)])


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """One model a worker process."""
    return PieceModel(path)


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Counts are those of the library for ``model_path``, without begin or end
    tokens; strings of special tokens inside a text are ordinary text.  Rows
    stay where they are: no shuffle.  A null text counts as empty (0 bytes, 0
    tokens); a null id stays null; repeated rows give a row each; other columns
    are ignored, whatever their names.

    Memory follows the longest text.  A text of one unbroken run of letters
    takes as many rounds as it has different merges; a run of spaces is merged
    in one go.  A model that normalises texts, or whose scores tie in other
    ways, raises an error rather than be counted wrongly.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in chunks(batches, "text", 4 << 20):
            texts = batch.column(1)
            n = model.count_texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
