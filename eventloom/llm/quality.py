"""Quality rules: compression bands, beside counts of repetition.

A text is compressed with zstandard, whole and in fixed chunks.  How far good
texts of each length shrink is measured on labelled ones; a text that shrinks
much more repeats itself, one that shrinks much less is noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NOT_SPACE, Words, binaries, buffers, chunks, covered, ragged, sums, window_starts

LEVEL = 3
CHUNK_BYTES = 4096
#: Compressed size over size: from this length in bytes, the least and the
#: greatest ratio of a whole text.  Where no labels are at hand; :func:`fit_bands`
#: measures them.  Longer texts compress better.
BANDS = (
    (0, 0.0, 1.30), (150, 0.64, 1.05), (200, 0.60, 0.95), (300, 0.55, 0.90), (400, 0.515, 0.85), (600, 0.50, 0.80), (800, 0.485, 0.75),
    (1000, 0.47, 0.72), (1500, 0.453, 0.68), (2000, 0.445, 0.66), (3000, 0.438, 0.62), (4000, 0.427, 0.60), (6000, 0.418, 0.56), (8000, 0.408, 0.55),
    (12000, 0.404, 0.54), (16000, 0.397, 0.53), (24000, 0.393, 0.52), (32000, 0.386, 0.51), (48000, 0.38, 0.51), (100000, 0.37, 0.51),
)
#: How many measures a length needs for a band of its own.
MIN_LABELLED = 40
#: What is added to the range of the good texts, as a share of its width.
MARGIN = 0.15
#: A text is rejected when more than this share of its chunks lies outside the band.
BAD_CHUNKS = 0.25
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def ratio_limits(n_bytes: np.ndarray, bands=BANDS) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest ratio for texts of these lengths."""
    table = np.array(bands)
    row = np.searchsorted(table[:, 0], n_bytes, side="right") - 1
    return table[row, 1], table[row, 2]


def compression(data: np.ndarray, docs: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ratio of each text, and those of all its chunks, the last and shorter one too; 0 for an empty text."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
    whole, parts, view = np.zeros(len(docs) - 1), [], memoryview(np.ascontiguousarray(data))
    for k, (a, b) in enumerate(zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)):
        whole[k] = len(press(view[a:b])) / (b - a) if b > a else 0.0
        parts.append(np.array([len(press(view[i : min(i + chunk_bytes, b)])) / (min(i + chunk_bytes, b) - i) for i in range(a, b, chunk_bytes)]) if b - a > chunk_bytes else whole[k : k + 1] if b > a else np.zeros(0))
    return whole, parts


def _odd_share(parts: list[np.ndarray], sizes: np.ndarray, bands, chunk_bytes: int) -> np.ndarray:
    """Of each text, the share of its bytes in chunks outside their bands."""
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), count)
    if not len(owner):
        return np.zeros(len(parts))
    left = sizes[owner] - ragged(np.zeros(len(parts), np.int64), count) * chunk_bytes
    size, ratio = np.minimum(left, chunk_bytes), np.concatenate(parts)
    low, high = ratio_limits(size, bands)
    return np.bincount(owner, size * ((ratio < low) | (ratio > high)), len(parts)) / np.maximum(sizes, 1)


def repeated_words(words: Words, width: int = 8) -> np.ndarray:
    """Words of each document inside windows found twice or more in it.

    Windows get exact ids by doubling: pairs of words, of pairs, and so on.
    """
    first = window_starts(words.docs, width)
    if not len(first):
        return np.zeros(len(words.docs) - 1, np.int64)
    ids, reach = words.ids()[0], 1
    while reach < width:
        paired = (ids[:-reach] << 32) | ids[reach:]
        ids, reach = pa.array(paired).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), reach * 2
    owner = words.doc_of()[first]
    same = pa.array((owner << 32) | ids[first]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = np.bincount(same)[same] > 1
    return sums(covered(first[again], width, len(words)), words.docs)


def repeated_lines(data: np.ndarray, docs: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word, equal to an earlier line of their document."""
    n = len(docs) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(docs, breaks, side="right") - 1
    starts = np.sort(np.r_[docs[:-1], breaks + 1], kind="stable")
    line_doc = np.sort(np.r_[np.arange(n), owner], kind="stable")
    # Of one document, its start comes first and each break begins a further line.
    order = np.lexsort((starts, line_doc))
    starts, line_doc = starts[order], line_doc[order]
    ends = np.r_[starts[1:] - 1, docs[-1]]
    last = np.r_[line_doc[1:] != line_doc[:-1], True]
    ends[last] = docs[1:][line_doc[last]]
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_doc = starts[filled], ends[filled], line_doc[filled]
    if not len(starts):
        return np.zeros(n, np.int64)
    cuts = np.empty(2 * len(starts) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
    base = cuts[0]
    # Every second slice is a line, the others are what lies between.
    text = binaries(data[base:], cuts - base).take(pa.array(np.arange(0, 2 * len(starts), 2)))
    ids = text.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (line_doc << 32) | ids
    _, earliest = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[earliest] = False
    return np.bincount(line_doc[dup], minlength=n)


def fit_bands(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", bands=BANDS, chunk_bytes: int = CHUNK_BYTES) -> tuple[tuple[float, float, float], ...]:
    """Bands of the lengths of ``bands``, measured on texts of ``docs`` with a label of 1.

    Every such text counts, whole and in a chunk of every length in ``bands`` up
    to ``chunk_bytes``.  A band reaches from the least to the greatest ratio, and
    ``MARGIN`` of that range beyond both; a length with fewer than
    ``MIN_LABELLED`` measures keeps the band it has in ``bands``.  Hold rows out
    by leaving them out.  Null ids, texts and labels aren't used; of several
    labels of an id the least counts.

    Ratios, not texts, meet the labels: each row of ``docs`` is measured where it
    lies, and a row for each band is what is left.
    """
    good = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg(F.min("mark").alias("mark")).where("mark = 1").select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    edges = np.array([b[0] for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, at = buffers(batch.column(1))
            owners, rows, ratios = [], [], []
            for size in (0, *(int(e) for e in edges if 0 < e <= chunk_bytes), chunk_bytes):
                if not size:
                    some = np.flatnonzero(np.diff(at))
                    owners.append(some)
                    rows.append(np.searchsorted(edges, np.diff(at)[some], "right") - 1)
                    ratios.append(compression(data, at)[0][some])
                    continue
                # One piece of each text, from its middle.
                long = np.flatnonzero(np.diff(at) > size)
                first = at[long] + (np.diff(at)[long] - size) // 2
                pieces = data[ragged(first, np.full(len(long), size))]
                owners.append(long)
                rows.append(np.full(len(long), np.searchsorted(edges, size, "right") - 1))
                ratios.append(compression(pieces, np.arange(len(long) + 1) * size, size)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owners), pa.int64())), pa.array(np.concatenate(rows), pa.int64()), pa.array(np.concatenate(ratios), pa.float64())], names=["id", "row", "ratio"])

    each = texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, row bigint, ratio double")
    found = each.join(good, "id").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    measured = {r["row"]: r for r in found.collect()}
    out = []
    for k, band in enumerate(bands):
        r = measured.get(k)
        if r and r["n"] >= MIN_LABELLED:
            beyond = MARGIN * (r["high"] - r["low"])
            band = (band[0], max(r["low"] - beyond, 0.0), r["high"] + beyond)
        out.append(band)
    return tuple(out)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, bands=BANDS, bad_chunks: float = BAD_CHUNKS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Counts and a verdict for every row of ``docs``.

    ``n_words`` (runs of characters other than space and \\t to \\r),
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` (fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them in repeated 8-word windows), ``ratio``
    (compressed size over size, 0 for an empty text), ``chunk_ratios``,
    ``reason`` (null, "base", "repetitive", "incompressible" or "chunks") and
    ``kept``.

    The bands are limits by length; a text passes when its ratio lies within
    that of its length, and at most ``bad_chunks`` of its chunks, by bytes, lie
    outside those of theirs: every chunk of ``chunk_bytes`` and what is left at
    the end.

    Rows stay where they are: no shuffle.  Null texts have no words and fail the
    base rule; a very long text is one row of one task, judged whole.  Other columns are ignored, whatever their names; repeated rows
    give a row each.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, at = buffers(batch.column(1))
            words = Words(data, at, NOT_SPACE)
            n = words.counts()
            repeat = repeated_words(words)
            counts = [n, sums(words.mask & ((data & 0xC0) != 0x80), at), sums(SYMBOLS[data], at), repeated_lines(data, at, words), repeat]
            failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
            whole, parts = compression(data, at, chunk_bytes)
            low, high = ratio_limits(np.diff(at), bands)
            odd = _odd_share(parts, np.diff(at), bands, chunk_bytes) > bad_chunks
            reason = np.select([failed, whole < low, whole > high, odd], ["base", "repetitive", "incompressible", "chunks"], "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(whole), pa.array([p.tolist() for p in parts], pa.list_(pa.float64())), pa.array(reason, mask=reason == "", type=pa.string()), pa.array(reason == "")],
                names=[id_col, *names, "base_failed", "ratio", "chunk_ratios", "reason", "kept"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{x} bigint" for x in names) + ", base_failed boolean, ratio double, chunk_ratios array<double>, reason string, kept boolean")
