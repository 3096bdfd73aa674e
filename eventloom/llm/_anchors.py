"""Which documents can share a long passage, found from few positions.

Of every window of ``width`` words, the gram of half its length with the
smallest hash is its anchor.  Equal windows have equal anchors, so a window can
only repeat in another document if its anchor does: the anchors, one position
in a dozen, are compared first, and only windows on repeated anchors go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import CHECK, GRAMS, NOT_SPACE, WIDE, Words, buffers, chunks, ragged, span_hashes, spans_of, window_hashes, window_starts


class Windows:
    """Windows and anchors of the documents of a batch; positions are words."""

    def __init__(self, texts: pa.Array, width: int):
        self.width, self.gram = width, width // 2 + 1
        data, at = buffers(texts)
        self.words = Words(data, at, NOT_SPACE)
        self.hashes = self.words.hashes()
        self.starts = window_starts(self.words.docs, width)
        self.grams = window_hashes(self.hashes, self.gram, GRAMS)
        self.anchor = self._anchors()
        chosen = np.zeros(len(self.words) + 1, bool)
        chosen[self.anchor] = True
        self.selected = np.flatnonzero(chosen)
        self.doc_of = self.words.doc_of()

    def _anchors(self) -> np.ndarray:
        """The place of the smallest gram of each window, the first of equals."""
        if not len(self.starts):
            return self.starts
        reach, best = self.width - self.gram + 1, np.arange(len(self.grams))
        have = 1
        while have < reach:
            step = min(have, reach - have)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(self.grams[right] < self.grams[left], right, left)
            have += step
        return best[self.starts]

    def window_keys(self, which: np.ndarray) -> np.ndarray:
        """Rabin-Karp hashes of the windows that start at ``starts[which]``."""
        first = self.starts[which]
        return span_hashes(self.hashes, first, first + self.width, WIDE).view(np.int64)

    def window_checks(self, which: np.ndarray) -> np.ndarray:
        """The same from other hashes of the words and other primes."""
        first = self.starts[which]
        return span_hashes(self.words.hashes(1), first, first + self.width, CHECK).view(np.int64)

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and grams of the anchors, each pair once."""
        doc, key = self.doc_of[self.selected], self.grams[self.selected].view(np.int64)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(doc)]
        return doc[new], key[new]

    def on(self, docs: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Which of ``selected`` are among these pairs of document and gram."""
        return pairs_in(self.doc_of[self.selected], self.grams[self.selected].view(np.int64), docs, grams)

    def windows_on(self, selected: np.ndarray) -> np.ndarray:
        """Windows, as places in ``starts``, whose anchor is chosen."""
        flag = np.zeros(len(self.words) + 1, bool)
        flag[self.selected[selected]] = True
        return np.flatnonzero(flag[self.anchor])

    def without(self, removed: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Words, removed words, removed spans, and the kept words joined by a space."""
        w = self.words
        start, end, at = spans_of(removed, w.docs)
        spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"]))
        left = ~removed
        size = (w.ends - w.starts)[left] + 1
        total = np.r_[0, np.cumsum(size)]
        kept = np.r_[0, np.cumsum(left)][w.docs]
        out = np.full(total[-1], 0x20, np.uint8)
        out[ragged(total[:-1], size - 1)] = w.data[ragged(w.starts[left], size - 1)]
        # Each document loses the space after its last word.
        some = kept[1:] > kept[:-1]
        keep = np.ones(len(out), bool)
        keep[total[kept[1:][some]] - 1] = False
        places = total[kept] - np.r_[0, np.cumsum(some)]
        texts = pa.StringArray.from_buffers(len(kept) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(out[keep]))
        n = w.counts()
        return pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), spans, texts


def pairs_in(docs: np.ndarray, keys: np.ndarray, other_docs: np.ndarray, other_keys: np.ndarray) -> np.ndarray:
    """Which pairs of document and key are among the other pairs."""
    if not len(docs) or not len(other_docs):
        return np.zeros(len(docs), bool)
    names, code = np.unique(np.concatenate([keys, other_keys]), return_inverse=True)
    mine, others = docs * len(names) + code[: len(docs)], other_docs * len(names) + code[len(docs) :]
    return np.isin(mine, others)


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; null is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def over(docs: DataFrame, width: int, schema: str, make: Callable[[Windows, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``make`` for the windows of every batch of ``docs``, whose texts are in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield make(Windows(batch.column("text"), width), batch)

    return docs.mapInArrow(run, schema)


def anchors(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    """``doc, gram``: the anchors of each document, each once."""

    def make(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, key = windows.anchor_keys()
        return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc)), pa.array(key)], names=["doc", "gram"])

    return over(docs.select("doc", "text"), width, f"doc {id_type}, gram bigint", make)


def repeated(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    """``doc, grams``: of each document of ``docs`` (``doc, text``), the anchors that other documents have too.

    The documents of a gram are compared by their least and greatest, with
    partial results, and joined back; both sides of the join come from shuffles
    that Spark may split, so a passage that very many documents share stays many
    tasks' work.
    """
    all_anchors = anchors(docs, width, id_type)
    shared = all_anchors.groupBy("gram").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # A key of its own makes Spark deal both sides out for the join.
    shared = shared.select(F.bitwise_not("gram").alias("key"))
    found = all_anchors.withColumn("key", F.bitwise_not("gram")).join(shared, "key")
    return found.groupBy("doc").agg(F.collect_list("gram").alias("grams"))


def first_holders(candidates: DataFrame) -> DataFrame:
    """``doc, firsts``: of each document, its windows that no document of a smaller id has.

    ``candidates``: ``doc, window, check``, two hashes of each window.  Every window has one first holder, so each
    list is no longer than its document; nothing is sent to the other holders.
    """
    holders = candidates.groupBy("window", "check").agg(F.min("doc").alias("doc"))
    return holders.groupBy("doc").agg(F.collect_list("window").alias("firsts"))


