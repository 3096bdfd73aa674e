"""A quality classifier: ridge regression on random Fourier features, calibrated.

Each text is some thirty statistics: shares of kinds of characters, words and
lines, and how much repeats.  Random cosines of the standardised statistics
approximate a Gaussian kernel; the ridge scores come from normal equations that
tasks sum over their labelled rows.  The sums are kept by fold, so each fold is
scored by what the others taught, and isotonic regression over those scores
makes probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import NOT_SPACE, Words, buffers, chunks, lists
from .quality import repeated_lines, repeated_words

#: Random features; the normal equations have a row for each and one for the mean.
FEATURES = 256
FOLDS = 4
#: The kernel is ``exp(-|x - y|^2 / (2 * WIDTH^2))`` over standardised statistics.
WIDTH = 6.0
#: Standardised statistics are cut here.
FAR = 4.0
#: Ridge penalties by row, of which the folds choose.
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2)
#: Features are rounded to this, so that sums of products are exact and don't
#: depend on the order of rows up to half a billion of them.
GRAIN = 2.0**-12
#: Scores go to the calibration in steps of this, between the two ends.
STEP, LOW, HIGH = 2.0**-9, -0.5, 1.5

#: Kinds of bytes.
_KINDS = np.full(256, 0, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&", b"|<>", b"\"'()-", b"\n", b" \t\r\x0b\x0c"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[0x80:0xC0] = 11  # inside a character
_KINDS[0xC0:] = 12  # begins one
_N_KINDS = 13
STATISTICS = (
    "log_bytes", "log_words", "upper_share", "digit_share", "stop_share", "cry_share", "symbol_share", "bar_share", "bracket_share", "other_share", "wide_share",
    "line_rate", "blank_share", "mean_word", "spread_word", "longest_word", "single_words", "short_words", "capital_words", "symbol_words", "cry_words", "bar_words", "begun_words",
    "log_lines", "dup_lines", "repeat_words", "distinct_words", "top_word", "log_line_words",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text between the offsets; all zero for an empty one."""
    n = len(at) - 1
    size = np.diff(at)
    words = Words(data, at, NOT_SPACE)
    kind = _KINDS[data]
    kinds = np.bincount(np.repeat(np.arange(n), size) * _N_KINDS + kind, minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    chars = size - kinds[:, 11]
    n_words, owner = words.counts(), words.doc_of()

    def before(mask: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(mask)]

    def inside(mask: np.ndarray) -> np.ndarray:
        total = before(mask)
        return total[words.ends] - total[words.starts]

    length = (words.ends - words.starts) - inside(kind == 11)
    upper, lower = inside(kind == 2), inside(kind == 1)
    first, last = kind[words.starts], kind[words.ends - 1]

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, mask, minlength=n)[:n] if len(owner) else np.zeros(n)

    mean = _share(by_doc(length), n_words)
    spread = np.sqrt(np.maximum(_share(by_doc(length.astype(float) ** 2), n_words) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    ids = words.ids()[0]
    pairs, times = np.unique(owner << 32 | ids, return_counts=True)
    distinct = np.bincount(pairs >> 32, minlength=n)[:n] if len(pairs) else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, pairs >> 32, times)
    lines = kinds[:, 9] + (size > 0)
    columns = [
        np.log1p(size), np.log1p(n_words), _share(kinds[:, 2], kinds[:, 1] + kinds[:, 2]), _share(kinds[:, 3], chars), _share(kinds[:, 4], chars), _share(kinds[:, 5], chars), _share(kinds[:, 6], chars), _share(kinds[:, 7], chars), _share(kinds[:, 8], chars), _share(kinds[:, 0], chars), _share(kinds[:, 12], chars),
        _share(kinds[:, 9], chars), _share(kinds[:, 10], chars), mean, spread, np.log1p(longest), _share(by_doc(length == 1), n_words), _share(by_doc(length <= 3), n_words), _share(by_doc((upper > 1) & (lower == 0)), n_words), _share(by_doc(last == 6), n_words), _share(by_doc(last == 5), n_words), _share(by_doc((last == 7) & (length == 1)), n_words), _share(by_doc((first == 2) & (lower > 0)), n_words),
        np.log1p(lines), _share(repeated_lines(data, at, words), lines), _share(repeated_words(words), n_words), _share(np.log1p(distinct), np.log1p(n_words)), _share(top, n_words), np.log1p(_share(n_words, lines)),
    ]
    return np.stack(columns, axis=1).astype(np.float32) if n else np.zeros((0, len(STATISTICS)), np.float32)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stats``: the statistics of every row's whole text.  No shuffle; null texts are empty ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x = statistics(*buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.reshape(-1), np.arange(len(x) + 1) * x.shape[1], pa.float32())], names=["id", "stats"])

    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS)).astype(np.float64)


@dataclass
class Model:
    """What a score needs: the scale of the statistics, the ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.value[0])
        return np.interp(features(stats, self.mean, self.scale) @ self.weights, self.at, self.value)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random cosines of the standardised statistics, and a last column of ones."""
    rng = np.random.default_rng(13)
    directions = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -FAR, FAR)
    z = np.round(np.cos(x @ directions + shift) / GRAIN) * GRAIN
    return np.c_[z, np.ones(len(z))]


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By fold: the sums of ``z z'``, of ``z mark`` and of marks squared.

    A task sends the upper half of each fold's sums, one matrix row a record; the
    records of a matrix row meet in one task, which adds them as they come.
    """
    size = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size + 1, size + 1))
        seen = np.zeros(FOLDS, bool)
        for batch in batches:
            z, mark, fold = features(_matrix(batch.column(2)), mean, scale), batch.column(1).to_numpy().astype(float), batch.column(0).to_numpy()
            z = np.c_[z, mark]
            for k in np.unique(fold):
                total[k] += z[fold == k].T @ z[fold == k]
                seen[k] = True
        for k in np.flatnonzero(seen):
            values = [total[k, i, i:] for i in range(size + 1)]
            at = np.r_[0, np.cumsum([len(v) for v in values])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, k), pa.int32()), pa.array(np.arange(size + 1), pa.int32()), lists(np.concatenate(values), at, pa.float64())], names=["fold", "i", "values"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total[k, i] = total.get((k, i), 0) + v.values.to_numpy()
        if total:
            at = np.r_[0, np.cumsum([len(v) for v in total.values()])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int32()), lists(np.concatenate(list(total.values())), at, pa.float64())], names=["fold", "i", "values"])

    schema = "fold int, i int, values array<double>"
    out = np.zeros((FOLDS, size + 1, size + 1))
    for r in rows.select("fold", "mark", "stats").mapInArrow(part, schema).repartition("fold", "i").mapInArrow(add, schema).collect():  # a few folds of one matrix
        out[r["fold"], r["i"], r["i"] :] = out[r["fold"], r["i"] :, r["i"]] = r["values"]
    return out[:, :size, :size], out[:, :size, size], out[:, size, size]


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``value`` by weighted squares: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + w, blocks[-1][2] + n]
    return np.repeat([t / w for t, w, _ in blocks], [int(n) for *_, n in blocks])


def fit(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality") -> Model:
    """Learn from every row of ``measured`` (see :func:`measure`) that has a label; hold rows out by leaving them out.

    Nothing is sampled: statistics, not texts, meet the labels; sums of one bounded
    matrix a fold, and one count for each step of a score, come to the driver.
    Null ids and labels aren't used; of several labels of an id the least counts.
    Repeated rows of an id count each.  With labels of one kind only, every text gets
    that kind's share, and without labels one half.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg((F.min("mark") == 1).cast("int").alias("mark"))
    rows = measured.join(marks, "id").select((F.pmod(F.xxhash64("id"), F.lit(FOLDS))).cast("int").alias("fold"), "mark", "stats").persist()
    try:
        return _fit(rows)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame) -> Model:
    size = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(size), np.zeros(size), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            total, squares, n = total + x.sum(0), squares + (x**2).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n), pa.int64()), pa.array(total), pa.array(squares)], names=["i", "n", "total", "squares"])

    found = rows.select("stats").mapInArrow(moments, "i int, n bigint, total double, squares double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).orderBy("i").collect()
    n = found[0]["n"] if found else 0
    positive = rows.agg(F.sum("mark")).first()[0] or 0
    if not 0 < positive < n:
        return Model(np.zeros(size), np.ones(size), np.zeros(0), np.zeros(1), np.array([positive / n if n else 0.5]))
    total, squares = (np.array([r[c] for r in found]) for c in ("total", "squares"))
    # Rounded, so that the order in which tasks end doesn't show.
    mean = np.round(total / n, 6)
    scale = np.round(np.sqrt(np.maximum(squares / n - mean**2, 1e-8)), 6) + 1e-6
    a, b, yy = _sums(rows, mean, scale)

    def solve(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
        ridge = penalty * a[-1, -1] * np.eye(len(b))
        ridge[-1, -1] = 0
        return np.linalg.solve(a + ridge, b)

    folds = [k for k in range(FOLDS) if a[k, -1, -1] and a[k, -1, -1] < n]
    if not folds:  # all rows in one fold
        folds, left = [int(np.argmax(a[:, -1, -1]))], lambda k: (a[k], b[k])
    else:
        left = lambda k: (a.sum(0) - a[k], b.sum(0) - b[k])
    # The squared error of a fold follows from its sums alone.
    models = {p: {k: solve(*left(k), p) for k in folds} for p in PENALTIES}
    penalty = min(PENALTIES, key=lambda p: sum(yy[k] - 2 * w @ b[k] + w @ a[k] @ w for k, w in models[p].items()))
    unseen = np.stack([models[penalty].get(k, np.zeros(FEATURES + 1)) for k in range(FOLDS)])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = features(_matrix(batch.column(2)), mean, scale)
            s = np.clip(np.einsum("ij,ij->i", z, unseen[batch.column(0).to_numpy()]), LOW, HIGH)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s / STEP).astype(np.int32)), batch.column(1)], names=["step", "mark"])

    steps = rows.mapInArrow(scores, "step int, mark int").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("good")).orderBy("step").collect()  # at most a thousand
    weight = np.array([r["n"] for r in steps], float)
    value = isotonic(np.array([r["good"] for r in steps]) / weight, weight)
    return Model(mean, scale, solve(a.sum(0), b.sum(0), penalty), np.array([r["step"] for r in steps]) * STEP, value)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``id, score`` of every measured row: how likely label 1 is, from 0 to 1.

    Nothing but the statistics is looked at.  Rows stay where they are; a null or
    empty text has statistics of zero and a score like any other, and repeated rows
    have one each.
    """
    schema = T.StructType([measured.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(model.score(_matrix(batch.column(1))), 0, 1), pa.float64())], names=["id", "score"])

    return measured.select("id", "stats").mapInArrow(run, schema)
