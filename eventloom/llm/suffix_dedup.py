"""Suffix-array dedup: sparse suffix arrays over anchors.

Suffixes are kept only at anchors, positions that the text itself selects.
Sorted over the whole cluster, equal beginnings stand next to each other:
neighbours are compared, which gives how far they agree to the right, and where
that falls short of a whole passage, to the left.  What a border between two
stretches of the array cuts apart is compared once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import Windows, flat, over, repeated
from ._text import CHECK, covered, mix, span_hashes
from .substring_dedup import WIDTH, prepared, result

#: Bytes of hash for each word that follows or precedes an anchor.
WORD_BYTES = 5
#: Suffixes that are compared at once, in memory.
PIECE = 1 << 15


class Contexts:
    """What follows and precedes the chosen anchors: up to ``reach`` words on each side."""

    def __init__(self, windows: Windows, chosen: np.ndarray):
        w, gram = windows, windows.gram
        self.width, self.reach = gram, w.width - gram
        reach = self.reach
        self.place = w.selected[chosen]
        doc = w.doc_of[self.place]
        self.doc, self.gram = doc, w.grams[self.place].view(np.int64)
        after = self.place + gram
        self.n_right = np.minimum(w.words.docs[doc + 1] - after, reach)
        self.n_left = np.minimum(self.place - w.words.docs[doc], reach)
        # The key of a context: its words, with those on the left by their number.
        whole = span_hashes(w.hashes, self.place - self.n_left, after + self.n_right, CHECK)
        self.key = mix(whole ^ mix(self.n_left.astype(np.uint64) + np.uint64(1))).view(np.int64)
        self.short = w.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]

    def once(self) -> np.ndarray:
        """One anchor for each context of a document."""
        order = np.lexsort((self.key, self.doc))
        doc, key = self.doc[order], self.key[order]
        return order[np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(doc)]]

    def sides(self, which: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The words on both sides, nearest first."""
        steps, n = np.arange(self.reach), len(self.short) - 1
        out = []
        for count, at in ((self.n_right[which], self.place[which, None] + (self.width + steps)), (self.n_left[which], self.place[which, None] - 1 - steps)):
            inside = steps < count[:, None]
            out.append(_binary(self.short[np.clip(at, 0, n)[inside]].tobytes(), WORD_BYTES * count))
        return out[0], out[1]


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(data)])


def _matrix(column: pa.ChunkedArray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``reach`` word hashes for each value, and how many there are."""
    column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // WORD_BYTES
    count = np.diff(offsets)
    out = np.zeros((len(column), reach, 8), np.uint8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8).reshape(-1, WORD_BYTES)[offsets[0] : offsets[-1]]
    out[np.arange(reach) < count[:, None], :WORD_BYTES] = data
    return out.reshape(len(column), reach * 8).view(">u8").astype(np.uint64), count


def compare_neighbours(gram: np.ndarray, doc: np.ndarray, right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], cut_apart: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For contexts sorted by gram and words on the right: which windows an earlier document has.

    ``doc`` is the rank of the least document with the context.  Bit k of a
    row's result: the window that begins k words before its anchor also stands in
    another context, of a smaller document.  The second result has, for the
    grams of which other stretches may hold more (``cut_apart``), of every
    window its row of the least document here, k, and the window's hash.
    """
    n, reach = right[0].shape
    follows, n_right = right
    before, n_left = left
    same = np.zeros(n, bool)
    same[1:] = gram[1:] == gram[:-1]
    agree = np.zeros(n, np.int64)
    both = np.minimum(n_right[1:], n_right[:-1])
    unequal = (follows[1:] != follows[:-1]) | (np.arange(reach) >= both[:, None])
    agree[1:] = np.where(unequal.any(1), unequal.argmax(1), reach)
    # Hashes of the first words on the right, for rows whose windows are named.
    named = np.cumsum(cut_apart) - 1
    beginnings = np.zeros((int(cut_apart.sum()), reach + 1), np.uint64)
    beginnings[:, 0] = mix(gram[cut_apart].view(np.uint64) + np.uint64(1))
    for k in range(reach):
        beginnings[:, k + 1] = mix(beginnings[:, k] ^ mix(follows[cut_apart, k] + np.uint64(1)))
    prefix, out = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    open_rows, open_bits, open_keys = [], [], []
    for k in range(reach + 1):
        if k:
            prefix = mix(prefix ^ (before[:, k - 1] + np.uint64(1)))
        # Runs of neighbours that agree for the rest of the window.
        run = np.cumsum(~(same & (agree >= reach - k))).astype(np.uint64)
        rows = np.flatnonzero((n_left >= k) & (n_right >= reach - k))
        if not len(rows):
            continue
        key = mix(run[rows] ^ prefix[rows])
        order = np.lexsort((doc[rows], key))
        rows, key = rows[order], key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = rows[new]
        later = doc[rows] > np.repeat(doc[least], np.diff(np.r_[new, len(rows)]))
        out[rows[later]] |= 1 << k
        least = least[cut_apart[least]]
        open_rows.append(least)
        open_bits.append(np.full(len(least), 1 << k, np.int64))
        open_keys.append(mix(beginnings[named[least], reach - k] ^ mix(prefix[least] + np.uint64(k))).view(np.int64))
    none = [np.zeros(0, np.int64)]
    return out, [np.concatenate(x or none) for x in (open_rows, open_bits, open_keys)]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Stretches of a sorted partition, and whether their first and their last gram may go on outside.

    A stretch ends with a gram, unless a gram alone has more than ``rows``.
    """
    held: list[pa.RecordBatch] = []
    count, before = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        gram = t.column("gram").to_numpy()
        last = int(np.searchsorted(gram, gram[-1], "left"))
        if last:
            yield t.slice(0, last), before, False
            t, before = t.slice(last), False
        if t.num_rows >= rows:
            yield t, before, True
            held, count, before = [], 0, True
        else:
            held, count = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held), before, True


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """Each document without the passages it repeats from documents with smaller ids.

    Columns: ``id_col``, those of ``keep``, ``n_words, n_removed, removed, kept_text``.  A passage is a
    run of at least ``width`` words that also stands in a document with a smaller
    id.  ``removed`` are maximal intervals of such words, ``kept_text`` the other
    words joined by a space.

    Anchors that only one document has are dropped first.  Documents with the
    same words around an anchor are one suffix, which its least document holds.
    The suffixes are dealt out by ranges of anchor, following and preceding
    words, and sorted, so a gram that very many documents have is many tasks'
    work; in stretches of ``piece`` suffixes each is compared with its
    neighbours.  Only for the grams at the ends of a stretch the least holders
    of their windows are compared across stretches, by hash: a row for each
    window and stretch.  Anchors have 62-bit hashes, words beside them 40 bits
    each, of one kind; the whole around an anchor has 62 bits of another.

    Null texts have no words.  Rows with a null id neither lose words nor take
    them from others.  Rows that share an id don't take words from each other.
    Columns that aren't in ``keep`` are ignored; of kept ones with a name of the
    result, the result's replace them.  A very long text is one row of one task,
    some forty bytes of memory a word.
    """
    if not 2 <= width <= 120:
        raise ValueError("width must be from 2 to 120")
    id_type = docs.schema[id_col].dataType.simpleString()
    texts, loose, schema, keep = prepared(docs, id_col, text_col, keep)
    with_grams = texts.repartition("doc").join(repeated(texts, width, id_type), "doc", "left")
    reach = width - (width // 2 + 1)

    def contexts(windows: Windows, grams: pa.Array) -> Contexts:
        doc, key = flat(grams)
        return Contexts(windows, windows.on(doc, key.to_numpy(zero_copy_only=False)))

    def suffixes(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
        c = contexts(windows, batch.column("grams"))
        which = c.once()
        right, left = c.sides(which)
        return pa.RecordBatch.from_arrays([pa.array(c.gram[which]), batch.column("doc").take(pa.array(c.doc[which])), right, left, pa.array(c.key[which])], names=["gram", "doc", "right", "left", "context"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, before, after in _pieces(batches, piece):
            gram, ids = t.column("gram").to_numpy(), t.column("doc").combine_chunks()
            rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            cut_apart = (before & (gram == gram[0])) | (after & (gram == gram[-1]))
            bits, (rows, bit, key) = compare_neighbours(gram, rank, _matrix(t.column("right"), reach), _matrix(t.column("left"), reach), cut_apart)
            at = pa.array(np.r_[np.arange(t.num_rows), rows])
            window = pa.array(np.r_[np.zeros(t.num_rows, np.int64), key], mask=np.arange(len(at)) < t.num_rows)
            yield pa.RecordBatch.from_arrays([ids.take(at), t.column("context").combine_chunks().take(at), pa.array(np.r_[bits, bit]), window], names=["doc", "context", "bits", "window"])

    rows = over(with_grams, width, f"gram bigint, doc {id_type}, right binary, left binary, context bigint", suffixes)
    array = rows.groupBy("gram", "right", "left", "context").agg(F.min("doc").alias("doc")).repartitionByRange("gram", "right", "left").sortWithinPartitions("gram", "right", "left")
    # Both uses below read the same sorted shuffle.
    found = array.mapInArrow(compare, f"doc {id_type}, context bigint, bits bigint, window bigint")
    # At most a row for each stretch that has the window.
    across = found.where("window is not null").groupBy("window").agg(F.min("doc").alias("least"), F.collect_list(F.struct("doc", "context", "bits")).alias("held"))
    across = across.select("least", F.explode("held").alias("h")).where("h.doc > least").select("h.*")
    matches = found.where("window is null").select("doc", "context", "bits").unionByName(across).groupBy("doc").agg(F.collect_list(F.struct("context", "bits")).alias("matches"))

    def make(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
        removed = np.zeros(len(windows.words), bool)
        c = contexts(windows, batch.column("grams"))
        doc, pairs = flat(batch.column("matches"))
        bits = _look_up(c.doc, c.key, doc, *(pairs.field(k).to_numpy(zero_copy_only=False) for k in range(2)))
        for k in range(reach + 1):
            whole = (c.n_left >= k) & (c.n_right >= reach - k)
            removed |= covered(c.place[whole & ((bits >> k) & 1 == 1)] - k, width, len(removed))
        return result(batch, windows, removed, id_col, keep)

    both = with_grams.join(matches, "doc", "left")
    none = loose.withColumns({c: F.lit(None).cast(both.schema[c].dataType) for c in ("grams", "matches")})
    return over(both, width, schema, make).unionByName(over(none, width, schema, make))


def _look_up(docs: np.ndarray, keys: np.ndarray, other_docs: np.ndarray, other_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The bits of each pair of document and context that the document is the first to hold; all bits for others."""
    out = np.full(len(docs), -1, np.int64)
    if not len(docs) or not len(other_docs):
        return out
    names, code = np.unique(np.concatenate([keys, other_keys]), return_inverse=True)
    mine, others = docs * len(names) + code[: len(docs)], other_docs * len(names) + code[len(docs) :]
    order = np.argsort(others, kind="stable")
    others, values = others[order], values[order]
    new = np.flatnonzero(np.r_[True, others[1:] != others[:-1]])
    others, values = others[new], np.bitwise_or.reduceat(values, new)
    at = np.minimum(np.searchsorted(others, mine), len(others) - 1)
    hit = others[at] == mine
    out[hit] = values[at[hit]]
    return out
