"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression: an automaton over classes of
code points says where each begins.  Its transition functions are the elements
of a small monoid, so they compose by table look-up and a scan over blocks
finds the state before every character of a batch at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import PairRanks, all_splits, merge
from ._text import binaries, buffers, chunks, ragged

#: Distinct pre-tokens whose ids a worker remembers before it starts anew.
CACHE = 120_000

# Classes of code points.  The letters that may follow an apostrophe in a
# contraction are told apart: one alone (s t m d), or a first of two (re ve ll).
LETTER, SUFFIX, SUFFIX2, NUMBER, QUOTE, OTHER, BLANK_IN, SPACE_LAST, BLANK_LAST = range(9)
N_CLASSES = 9
# States: what the token so far is.  EDGE: nothing may join it.
EDGE, WORD, DIGITS, SIGNS, TICK, TICK2, JOIN, BLANKS = range(8)
N_STATES = 8

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this character."""
    if kind in (LETTER, SUFFIX, SUFFIX2):
        if state == TICK and kind != LETTER:
            return (EDGE, False) if kind == SUFFIX else (TICK2, False)
        if state == TICK2:
            return EDGE, False
        return WORD, state not in (WORD, JOIN)
    if kind == NUMBER:
        return DIGITS, state not in (DIGITS, JOIN)
    if kind == QUOTE:
        return (SIGNS, False) if state in (SIGNS, TICK, JOIN) else (TICK, True)
    if kind == OTHER:
        return SIGNS, state not in (SIGNS, TICK, JOIN)
    if kind == BLANK_IN:
        return BLANKS, state != BLANKS
    return (JOIN if kind == SPACE_LAST else EDGE), True


class Scanner:
    """The automaton as a monoid of functions from states to states."""

    def __init__(self) -> None:
        import sys
        import unicodedata

        names = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(c))[0]
            names[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
        names[WHITE_SPACE] = BLANK_IN
        names[ord("'")] = QUOTE
        self.kinds = names
        steps = [tuple(_step(s, k)[0] for s in range(N_STATES)) for k in range(N_CLASSES)]
        # A document starts at EDGE whatever came before it.
        steps += [tuple([f[EDGE]] * N_STATES) for f in steps]
        elements: dict[tuple[int, ...], int] = {}
        for f in steps:
            elements.setdefault(f, len(elements))
        grown = list(elements)
        for f in grown:
            for g in steps:
                h = tuple(g[x] for x in f)
                if h not in elements:
                    elements[h] = len(elements)
                    grown.append(h)
        self.functions = np.array(grown, np.uint8)
        self.of_class = np.array([elements[f] for f in steps], np.uint16)
        self.then = np.array([[elements[tuple(g[x] for x in f)] for g in grown] for f in grown], np.uint16)
        self.begins = np.array([[_step(s, k)[1] for k in range(N_CLASSES)] for s in range(N_STATES)])

    def classes(self, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The class of each code point; ``last``: it ends a document."""
        kind = self.kinds[points]
        after = np.empty_like(points)
        after[:-1], after[-1:] = points[1:], 0
        after[last] = 0
        blank = kind == BLANK_IN
        solid = np.empty(len(points), bool)
        solid[:-1], solid[-1:] = ~blank[1:], False
        solid[last] = False
        kind[blank & solid] = BLANK_LAST
        kind[blank & solid & (points == 0x20)] = SPACE_LAST
        kind[(points == ord("s")) | (points == ord("t")) | (points == ord("m")) | (points == ord("d"))] = SUFFIX
        kind[((points == ord("r")) | (points == ord("v"))) & (after == ord("e"))] = SUFFIX2
        kind[(points == ord("l")) & (after == ord("l"))] = SUFFIX2
        return kind

    def starts(self, points: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where tokens begin; ``docs``: offsets of the documents."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        filled = docs[:-1] < docs[1:]
        last, first = docs[1:][filled] - 1, docs[:-1][filled]
        kind = self.classes(points, last)
        wide = -(-n // BLOCK)
        f = np.zeros(wide * BLOCK, np.uint16)
        f[:n] = self.of_class[kind]
        f[first] = self.of_class[kind[first].astype(np.int64) + N_CLASSES]
        f = np.ascontiguousarray(f.reshape(wide, BLOCK).T)
        # Up: compose within each block, all blocks side by side.
        for k in range(1, BLOCK):
            f[k] = self.then[f[k - 1], f[k]]
        # Across: an inclusive scan of the blocks' functions.
        total, gap = f[-1].copy(), 1
        while gap < wide:
            total[gap:] = self.then[total[:-gap], total[gap:]]
            gap *= 2
        # Down: the state before each block, then before each character.
        enter = np.zeros(wide, np.uint8)
        enter[1:] = self.functions[total[:-1], EDGE]
        state = np.empty((BLOCK, wide), np.uint8)
        state[0] = enter
        for k in range(1, BLOCK):
            state[k] = self.functions[f[k - 1], enter]
        begin = self.begins[state.T.reshape(-1)[:n], kind]
        begin[first] = True
        return np.flatnonzero(begin)


class ByteBpe:
    """Ranks of byte strings, with a cache of the pre-tokens merged so far."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = PairRanks(*all_splits(ranks, ranks))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.places = np.r_[0, np.cumsum(self.sizes)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.scanner = Scanner()
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _remember(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        base = len(self.cache)
        while base + len(words) > len(self.at):
            self.at, self.n = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.n, np.zeros_like(self.n)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[base : base + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.n[base : base + len(words)] = sizes
        self.used += len(ids)
        self.cache.update(zip(words, range(base, base + len(words)), strict=True))
        return np.arange(base, base + len(words))

    def slots(self, words: pa.Array) -> np.ndarray:
        """The cache's slot of each distinct pre-token; unseen ones are merged first."""
        if len(self.cache) > CACHE:
            self.forget()
        names = words.to_pylist()
        out = np.array([self.cache.get(w, -1) for w in names], np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [names[k] for k in missing]
            offsets = np.r_[0, np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))]
            ids, places = merge(self.of_byte[np.frombuffer(b"".join(new), np.uint8)], offsets, self.pairs)
            out[missing] = self._remember(new, ids, np.diff(np.searchsorted(places, offsets)))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        data, docs = buffers(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(docs), np.int64)
        lead = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        char_at = np.flatnonzero(lead)
        begins = char_at[self.scanner.starts(points, np.searchsorted(char_at, docs))]
        coded = binaries(data, np.append(begins, len(data))).dictionary_encode()
        slot = self.slots(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.n[slot]
        total = np.r_[0, np.cumsum(sizes)]
        return self.ids[ragged(self.at[slot], sizes)], total[np.searchsorted(begins, docs)]

    def offsets(self, ids: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The byte at which each token starts in its own document."""
        ends = np.cumsum(self.sizes[ids])
        total = np.r_[0, ends]
        return total[:-1] - np.repeat(total[docs[:-1]], np.diff(docs))

    def decode(self, ids: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all documents and their offsets, from ids and the places they start at."""
        sizes = self.sizes[ids]
        long = np.zeros(len(docs) - 1, np.int64)
        some = docs[:-1] < docs[1:]
        long[some] = (starts + sizes)[docs[1:][some] - 1] if len(ids) else 0
        where = np.r_[0, np.cumsum(long)]
        out = np.zeros(where[-1], np.uint8)
        first = starts + np.repeat(where[:-1], np.diff(docs))
        out[ragged(first, sizes)] = self.bytes[ragged(self.places[ids], sizes)]
        return out, where


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One table a worker process."""
    return ByteBpe(path)


def _lists(flat: np.ndarray, docs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(docs, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, *, text_col: str = "text", decoded: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` and ``token_starts`` (arrays of int).

    ``token_starts`` are the byte places of the tokens in the text, from which
    :func:`decode` rebuilds it; with ``decoded``, the same task does so and adds
    ``decoded`` (binary).  Other columns stay, or those in ``keep``; any of
    these three names is replaced.  Rows stay where they are: no shuffle.  A null or empty text has
    no tokens.  Strings of special tokens are ordinary text.  Memory follows the
    longest text.
    """
    own = ["token_ids", "token_starts", *["decoded"] * decoded]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    array = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(own[0], array), T.StructField(own[1], array), *[T.StructField("decoded", T.BinaryType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in chunks(batches, "__text__"):
            ids, at = bpe.encode(batch.column(len(kept)))
            starts = bpe.offsets(ids, at)
            out = [*batch.columns[: len(kept)], _lists(ids, at), _lists(starts, at)]
            if decoded:
                out.append(binaries(*bpe.decode(ids, starts, at)).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *own])

    return docs.select(*kept, F.col(text_col).cast("string").alias("__text__")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary), from ``token_ids`` and ``token_starts``.

    A null array gives an empty value.  Other columns stay.
    """
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path)
        for batch in batches:
            ids, starts = batch.column("token_ids"), batch.column("token_starts")
            at = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, binaries(*bpe.decode(*flat, at)).cast(pa.binary())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
