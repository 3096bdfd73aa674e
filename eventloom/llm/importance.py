"""Importance resampling towards a target distribution.

Every text is a bag of hashed runs of words.  A bucket's gain is the log ratio of
its smoothed shares in the target texts and in the corpus; a text's weight is the
mean gain of its features.  Gumbel noise of the id added to the weights makes
the greatest scores a draw without replacement.

The features are written once, as packed 16-bit bucket streams with the offsets
of their documents.  Counts come from sorting the streams and encoding runs of
equal buckets; weights from gathering gains over the same streams.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._graph import cut, delete, shared_folder
from ._text import ALNUM, LOWER, Words, buffers, chunks, ragged, window_starts

BUCKETS = 10_000
#: Buckets must fit 16 bits.
MAX_BUCKETS = 1 << 16


def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1)
    return v


#: What a zero byte does to each of the four bytes of a checksum, then two, four ... zero bytes.
_DOUBLINGS: list[np.ndarray] = []
_SHIFTS: dict[int, np.ndarray] = {}


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


def _shift_table(n: int) -> np.ndarray:
    """The checksums of ``v`` followed by ``n`` zero bytes, by byte of ``v``: a linear map as four tables."""
    if n not in _SHIFTS:
        if not _DOUBLINGS:
            of_byte = _byte_table()
            v = np.arange(256, dtype=np.uint32)
            _DOUBLINGS.append(np.stack([of_byte, *(v << np.uint32(8 * k - 8) for k in (1, 2, 3))]))
        while len(_DOUBLINGS) < n.bit_length():
            _DOUBLINGS.append(np.stack([_apply(_DOUBLINGS[-1], row) for row in _DOUBLINGS[-1]]))
        table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for k in range(n.bit_length()):
            if n >> k & 1:
                table = np.stack([_apply(_DOUBLINGS[k], row) for row in table])
        if len(_SHIFTS) > 4096:
            _SHIFTS.clear()
        _SHIFTS[n] = table
    return _SHIFTS[n]


def joined_checksums(first: np.ndarray, second: np.ndarray, n_second: np.ndarray) -> np.ndarray:
    """The checksums of each two texts one after the other, from theirs and the second ones' lengths."""
    lengths, row = np.unique(n_second, return_inverse=True)
    tables = np.stack([_shift_table(int(n)) for n in lengths]).reshape(-1) if len(lengths) else np.zeros(0, np.uint32)
    at = row.reshape(-1).astype(np.int64) * 1024
    out = second.astype(np.uint32)
    for k in range(4):
        out = out ^ tables[at + 256 * k + ((first >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def bucket_streams(words: Words, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all runs of 1 to ``max_run`` words, by document, and the documents' offsets into them."""
    ids, distinct = words.ids()
    sizes = (words.ends - words.starts).astype(np.int64)
    single = np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.uint32, len(distinct))[ids]
    spaced = joined_checksums(np.full(len(words), zlib.crc32(b" "), np.uint32), single, sizes)
    runs, counts, at = single, [], []
    streams = []
    for n in range(1, max_run + 1):
        start = window_starts(words.docs, n)
        if n > 1:
            # ``runs`` are those one word shorter, at every word.
            more = max(len(words) - n + 1, 0)
            runs = np.r_[joined_checksums(runs[:more], spaced[n - 1 :], sizes[n - 1 :] + 1), np.zeros(len(words) - more, np.uint32)]
        streams.append((runs[start] % np.uint32(buckets)).astype(np.uint16))
        at.append(np.searchsorted(start, words.docs))
        counts.append(np.diff(at[-1]))
    total = np.r_[0, np.cumsum(np.sum(counts, axis=0))].astype(np.int64)
    out, place = np.zeros(total[-1], np.uint16), total[:-1].copy()
    for stream, n in zip(streams, counts, strict=True):
        out[ragged(place, n)] = stream
        place += n
    return out, total


def streams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_run: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``id, n_words, stream`` of every row: the packed buckets of its features, two bytes each.

    No shuffle.  Texts are taken whole; null and empty ones have no features.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"1 to {MAX_BUCKETS} buckets")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, at = buffers(batch.column(1))
            words = Words(LOWER[data], at, ALNUM)
            stream, ends = bucket_streams(words, max_run, buckets)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(stream.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts(), pa.int64()), packed], names=["id", "n_words", "stream"])

    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, stream binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers(column)
    return np.frombuffer(data.tobytes(), "<u2"), at // 2


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: streams are sorted by batch, runs of equal buckets added up, first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            stream = np.sort(_unpacked(batch.column(0))[0], kind="stable")  # a radix sort
            first = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]]) if len(stream) else np.zeros(0, np.int64)
            counts[stream[first]] += np.diff(np.r_[first, len(stream)])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    found = packed.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(share in the target / share in the source))`` of each bucket, both smoothed by one."""
    k = len(source)
    all_source, all_target = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight``: the floored mean gain of each row's features; 0 where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream, at = _unpacked(batch.column(2))
            n, some = np.diff(at), np.flatnonzero(np.diff(at))
            weight = np.zeros(batch.num_rows, np.int64)
            if len(some):
                # Rows without features take no part: their offsets would repeat.
                weight[some] = np.add.reduceat(gains[stream], at[:-1][some]) // n[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, f"id {packed.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int) -> Column:
    """``floor(1000 * g)`` for Gumbel noise ``g`` from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Ranks of the drawn rows: how many rows of greater scores there are, by a histogram, and the place among equals.

    Scores are whole thousandths of logarithms, so there are some ten thousand
    different ones at any size, and rows of one score are a small share of all.
    """
    spark = scored.sparkSession
    histogram = scored.where("able").groupBy("score").count().toArrow()  # a row a different score
    score, n = histogram.column("score").to_numpy(), histogram.column("count").to_numpy()
    order = np.argsort(-score)
    score, n = score[order], n[order]
    drawn = int(n.sum()) * percent // 100
    above = np.cumsum(n) - n
    taken = above < drawn
    bases = F.broadcast(spark.createDataFrame(pa.table({"score": pa.array(score[taken], pa.int64()), "above": pa.array(above[taken], pa.int64())})))
    rows = scored.join(bases, "score", "left")
    in_reach = F.col("able") & F.col("above").isNotNull()
    equals = Window.partitionBy("score").orderBy("id", "weight", "n_features")
    drawable = rows.where(in_reach).withColumn("rank", F.col("above") + F.row_number().over(equals))
    drawable = drawable.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return drawable.unionByName(rows.where(~in_reach).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_run: int = 2, buckets: int = BUCKETS, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row; the drawn rows have a rank from 1 on.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded
    down) are drawn, by score; ties go to the smaller id.  The bucket streams lie in
    the shared folder until the weights are known; a lost executor costs the tasks it
    had.  No text is shuffled: ten thousand counts a task are, and of each drawn row
    a few numbers.

    A null or empty text has no features, a weight of 0, and isn't drawn.  A row with
    a null id has no score and isn't drawn nor counted among those drawn from; its
    features count.  Of repeated rows of an id each is drawn by itself.  Without
    target texts the gains come from smoothing alone.  Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"
    streams(docs, id_col=id_col, text_col=text_col, max_run=max_run, buckets=buckets).write.option("compression", "zstd").parquet(path)
    packed = spark.read.parquet(path)
    source = bucket_counts(packed, buckets)
    wanted = bucket_counts(streams(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), id_col="id", max_run=max_run, buckets=buckets), buckets)
    weighed = weigh(packed, gains_of(source, wanted))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("id").isNotNull() & (F.col("n_words") >= min_words)))
    delete(spark, path)
    return _ranked(scored, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
