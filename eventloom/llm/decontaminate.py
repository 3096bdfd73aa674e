"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark items.  A table
of shifts, indexed by the hash of a block of words, says how far a window's end
may move on; where it says zero, buckets by the hashes of the last and the
first block select test strings, and their bytes are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ALNUM, LOWER, WIDE, Words, buffers, chunks, covered, mix, ragged, spans_of, window_hashes

WINDOW = 10
#: Words of a block: the unit of the shift table.
BLOCK = 3
#: Bytes of benchmark text in one search table; a larger benchmark takes more passes.
TABLE_BYTES = 2 << 20
#: A word in a text before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEGMENT = 64
_SHIFT_BITS = 17


class _Group:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, width: int, words: list[tuple[bytes, ...]], items: list[list[str]]):
        self.width, self.block = width, min(BLOCK, width)
        self.items = items
        data = np.frombuffer(b" ".join(b" ".join(w) for w in words), np.uint8)
        seen = Words(data, np.array([0, len(data)]), ALNUM)
        hashes = seen.hashes().reshape(-1, width)
        self.sizes = (seen.ends - seen.starts).reshape(-1, width)
        self.data = seen.packed()[0]
        self.places = np.r_[0, np.cumsum(self.sizes.sum(1))]
        blocks = np.stack([window_hashes(row, self.block, WIDE) for row in hashes])
        self.shift = np.full(1 << _SHIFT_BITS, width - self.block + 1, np.int64)
        for j in range(width - self.block + 1):
            np.minimum.at(self.shift, (blocks[:, j] >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64), width - self.block - j)
        key = mix(blocks[:, -1] ^ mix(blocks[:, 0]))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def find(self, hashes: np.ndarray, words: Words, packed: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and the patterns that occur there."""
        none = np.zeros(0, np.int64)
        n, m, b = len(hashes), self.width, self.block
        if n < m:
            return none, none
        blocks = window_hashes(hashes, b, WIDE)
        step = self.shift[(blocks >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)]
        # Cursors stand on the last word of a window, one in each segment.
        at = np.arange(m - 1, n, _SEGMENT)
        stop = np.minimum(at + _SEGMENT, n)
        found = []
        while len(at):
            move = step[at - b + 1]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            at, stop = at[at < stop], stop[at < stop]
        first = np.sort(np.concatenate(found)) - m + 1
        doc = np.searchsorted(words.docs, first, side="right")
        first = first[words.docs[doc] >= first + m] if len(first) else none
        key = mix(blocks[first + m - b] ^ mix(blocks[first]))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        first, pattern = np.repeat(first, high - low), self.order[ragged(low, high - low)]
        if not len(first):
            return none, none
        sizes = words.ends - words.starts
        same = (sizes[first[:, None] + np.arange(m)] == self.sizes[pattern]).all(1)
        first, pattern = first[same], pattern[same]
        if not len(first):
            return none, none
        long = self.places[pattern + 1] - self.places[pattern]
        equal = packed[ragged(places[first], long)] == self.data[ragged(self.places[pattern], long)]
        same = np.logical_and.reduceat(equal, np.cumsum(long) - long)
        return first[same], pattern[same]


class Matcher:
    """Search tables of the items ``(item_id, text)``, one for each window length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        by_width: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            w = Words(data, np.array([0, len(data)]), ALNUM)
            names = [data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
            if names:
                width = min(window, len(names))
                here = by_width.setdefault(width, {})
                for k in range(len(names) - width + 1):
                    owners = here.setdefault(tuple(names[k : k + width]), [])
                    if not owners or owners[-1] != item:
                        owners.append(item)
        self.groups = [_Group(width, list(d), list(d.values())) for width, d in sorted(by_width.items())]

    def search(self, texts: pa.Array) -> tuple[Words, np.ndarray, list[list[str]]]:
        """The words of the texts, which of them are hit, and the items that each text holds."""
        data, offsets = buffers(texts)
        words = Words(LOWER[data], offsets, ALNUM)
        hashes, (packed, places) = words.hashes(), words.packed()
        hit = np.zeros(len(words), bool)
        items: list[set[str]] = [set() for _ in range(len(texts))]
        for group in self.groups:
            first, pattern = group.find(hashes, words, packed, places)
            hit |= covered(first, group.width, len(words))
            doc = np.searchsorted(words.docs, first, side="right") - 1
            for pair in np.unique(doc * len(group.items) + pattern).tolist():
                items[pair // len(group.items)].update(group.items[pair % len(group.items)])
        return words, hit, [sorted(x) for x in items]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in parts of bounded size; long texts in pieces that overlap by a window."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= TABLE_BYTES:
        yield [tuple(r) for r in rows.collect()]
        return

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                w = Words(LOWER[np.frombuffer(data, np.uint8)], np.array([0, len(data)]), ALNUM)
                for k in range(0, max(len(w) - window + 1, 1), 4096):
                    part = w.starts[k : k + 4096 + window - 1], w.ends[k : k + 4096 + window - 1]
                    if len(part[0]):
                        out.append((item, data[part[0][0] : part[1][-1]].decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["item", "text"])

    parts = -(-2 * size // TABLE_BYTES)
    pieced = rows.mapInArrow(pieces, "item string, text string")
    for k in range(parts):
        yield [tuple(r) for r in pieced.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()]


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` and ``hit_items``.

    A-Z count as a-z; words are runs of digits, letters a-z and characters
    beyond ASCII.  A window is ``window`` consecutive words of an item; an item
    of fewer words, but not none, is one window.  ``hit_spans`` are maximal runs
    ``[start, end)`` of words inside any occurrence of a window, ``hit_items``
    the ids, as sorted strings, of the items with an occurring window.

    Documents stay where they are: no shuffle.  The benchmark goes to the tasks
    as search tables of at most ``TABLE_BYTES`` of text each.  A larger one takes
    a scan of the documents for each table, and no text is written: from each
    scan come only the finds of different texts with a find, which are put
    together and joined back by two hashes of the text.

    Null texts have no words; items with a null id or text are ignored.  Other
    columns stay, or those in ``keep``; of columns with the names above, the new
    ones replace the old.
    Repeated rows give a row each, and of equal items each is named.  A very long
    text is searched whole, in one task.
    """
    own = T.StructType.fromDDL("n_words bigint, n_hit bigint, hit_spans array<struct<start: bigint, end: bigint>>, hit_items array<string>")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own.names]
    out = docs.select(*kept, F.col(text_col).cast("string").alias("__text__"))
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    items = next(blocks)
    if (later := next(blocks, None)) is None:
        return _search(out, items, window, kept, own)
    key = [F.xxhash64("__text__").alias("__k1__"), F.xxhash64("__text__", F.lit(1)).alias("__k2__")]
    texts = out.select("__text__", *key)
    finds = [_search(texts, part, window, ["__k1__", "__k2__"], own).where("n_hit > 0").select("__k1__", "__k2__", "hit_spans", "hit_items").dropDuplicates(["__k1__", "__k2__"]) for part in (items, later, *blocks)]
    # No more rows of a text than tables.
    found = reduce(DataFrame.unionByName, finds).groupBy("__k1__", "__k2__").agg(F.sort_array(F.flatten(F.collect_list("hit_spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("items"))
    merged = F.aggregate("spans", F.array().cast("array<struct<start: bigint, end: bigint>>"), _join_spans)
    found = found.select("__k1__", "__k2__", merged.alias("hit_spans"), F.col("items").alias("hit_items"))
    out = out.withColumns({"__k1__": key[0], "__k2__": key[1]}).join(found, ["__k1__", "__k2__"], "left")
    n_words = F.coalesce(F.regexp_count("__text__", F.lit(WORD)), F.lit(0)).cast("bigint")
    spans, names = (F.coalesce(c, F.array().cast(own[c].dataType)) for c in ("hit_spans", "hit_items"))
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*kept, n_words.alias("n_words"), n_hit.alias("n_hit"), spans.alias("hit_spans"), names.alias("hit_items"))


def _join_spans(done, span):
    last = F.element_at(done, -1)
    return (
        F.when((F.size(done) > 0) & (last["end"] >= span["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(span)))
    )


def _search(docs: DataFrame, items: list[tuple[str, str]], window: int, kept: list[str], own: T.StructType) -> DataFrame:
    """One pass over ``docs``, whose texts are in ``__text__``."""
    matcher = Matcher(items, window)
    schema = T.StructType([*(docs.schema[c] for c in kept), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text__"):
            words, hit, found = matcher.search(batch.column("__text__"))
            start, end, at = spans_of(hit, words.docs)
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"]))
            n_hit = np.diff(np.r_[0, np.cumsum(hit)][words.docs])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(words.counts(), pa.int64()), pa.array(n_hit, pa.int64()), spans, pa.array(found, pa.list_(pa.string()))], names=[*kept, *own.names])

    return docs.mapInArrow(run, schema)
