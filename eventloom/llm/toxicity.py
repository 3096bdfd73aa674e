"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; all other text is unlabelled.  With
the class prior ``p``, the risk of calling clean text toxic is estimated as
``risk(unlabelled as clean) - p * risk(toxic as clean)``; where that estimate
falls below zero the model has begun to overfit, and the step is turned round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ALNUM, LOWER, Words, buffers, chunks, lists, ragged, text_hashes

FEATURE_BITS = 20
#: Bounds of the training sample, which goes to the driver as word hashes.
MAX_TOXIC, MAX_UNLABELLED = 4000, 16000
#: A feature is in at least so many toxic texts, and its share of them differs
#: from its share of all text by so many standard errors.
MIN_TEXTS, MIN_ERRORS = 3, 5.0
MEMBERS = 3
#: Bytes of a longer word that make a feature of their own.
PREFIX = 4


@dataclass
class Model:
    """Weights of hashed words, by presence, for each member of the ensemble."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: float

    def table(self) -> np.ndarray:
        """Each feature's row of ``weights``; the last row is for all others."""
        rows = np.full(1 << FEATURE_BITS, len(self.features), np.int32)
        rows[self.features] = np.arange(len(self.features))
        return rows

    def score(self, words: Words, rows: np.ndarray) -> np.ndarray:
        n = len(words.docs) - 1
        if not len(self.bias):
            return np.full(n, self.prior)
        owner, feature = features_of(words)
        row = rows[feature]
        used = np.flatnonzero(row < len(self.features))
        pairs = np.unique(owner[used] * np.int64(len(self.features) + 1) + row[used])
        doc, row = pairs // (len(self.features) + 1), pairs % (len(self.features) + 1)
        logits = [np.bincount(doc, w[row], minlength=n)[:n] + b for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean([1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in logits], axis=0)


def words_of(texts: pa.Array) -> Words:
    data, at = buffers(texts)
    return Words(LOWER[data], at, ALNUM)


def features_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The documents and features of all words, and of the beginnings of the longer ones."""
    owner, long = words.doc_of(), words.ends - words.starts > PREFIX
    n = int(long.sum())
    stems = text_hashes(words.data[ragged(words.starts[long], np.full(n, PREFIX))], np.arange(n + 1) * PREFIX, 1)
    hashes = np.r_[words.hashes(), stems]
    return np.r_[owner, owner[long]], (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def step_gradient(f: np.ndarray, copies: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk by each text's logit ``f``.

    ``copies`` are the toxic texts' weights, ``share`` the unlabelled ones'.  The
    risk is ``prior * loss(toxic as toxic) + max(0, loss(unlabelled as clean) -
    prior * loss(toxic as clean))`` with the logistic loss; where the part in
    brackets is negative, its gradient is turned round and the rest left out.
    """
    p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    as_clean = np.logaddexp(0, f)
    negative = share @ as_clean - prior * (copies @ as_clean)
    of_negative = (share - prior * copies) * p
    return -of_negative if negative < 0 else of_negative - prior * copies * (1 - p)


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 100, rate: float = 0.05, l1: float = 1e-4, seed: int = 7) -> Model:
    """Fit ``MEMBERS`` linear models with the logistic loss, each on its own resample of the toxic texts."""
    if not toxic or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), prior if toxic else 0.0)
    flat = np.concatenate([*toxic, *unlabelled]).astype(np.int32)
    sizes = np.fromiter(map(len, [*toxic, *unlabelled]), np.int64, len(toxic) + len(unlabelled))
    owner, is_toxic = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.arange(len(sizes)) < len(toxic)
    in_toxic = np.bincount(flat[is_toxic[owner]], minlength=1 << FEATURE_BITS)
    in_rest = np.bincount(flat[~is_toxic[owner]], minlength=1 << FEATURE_BITS)
    # Words whose share of toxic texts differs from their share of all text.
    a, b = in_toxic / len(toxic), in_rest / len(unlabelled)
    pooled = (in_toxic + in_rest) / len(sizes)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / len(toxic) + 1 / len(unlabelled)))
    features = np.flatnonzero((in_toxic >= MIN_TEXTS) & (np.abs(a - b) > MIN_ERRORS * spread))
    row = np.full(1 << FEATURE_BITS, -1, np.int32)
    row[features] = np.arange(len(features))
    used = row[flat] >= 0
    col, owner = row[flat[used]], owner[used]
    rng, n = np.random.default_rng(seed), len(features)
    weights, bias = [], []
    for _ in range(MEMBERS):
        copies = np.bincount(rng.integers(0, len(toxic), len(toxic)), minlength=len(sizes)) / len(toxic)
        share = np.where(is_toxic, 0.0, 1 / len(unlabelled))
        w, c = np.zeros(n), np.log(prior / (1 - prior))
        m, v, mc, vc = np.zeros(n), np.zeros(n), 0.0, 0.0
        for step in range(1, steps + 1):
            f = np.bincount(owner, w[col], minlength=len(sizes)) + c
            g = step_gradient(f, copies, share, prior)
            gw, gc = np.bincount(col, g[owner], minlength=n), g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
            mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc**2
            at, av = 1 - 0.9**step, 1 - 0.999**step
            size = rate / (np.sqrt(v / av) + 1e-6)
            w -= size * m / at
            w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0)
            c -= rate * (mc / at) / (np.sqrt(vc / av) + 1e-6)
        weights.append(w)
        bias.append(c)
    return Model(features, np.array(weights), np.array(bias), prior)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", prior: float | None = None, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train on the rows of ``docs``; hold rows out by leaving them out.

    Toxic texts are those with a label of 1, at most ``max_toxic``; the
    unlabelled text is any text, at most ``max_unlabelled``.  Both samples are
    the rows with the smallest hashes of their ids, so a rerun takes the same.
    Rows whose hash is surely too great, by the number of rows, go first: about
    twice the sample is sorted, not the table.  The prior is the share of toxic
    labels among all labels of these documents, unless given.

    Ids or labels that are null are not used; of several labels of an id the
    greatest counts.  Repeated rows of an id, where the id is chosen, are texts
    each.  Equal hashes go by id.  Null and empty texts have no features, and
    very long ones are whole sets of features like any other.  Without toxic
    labels, or without texts, the model gives every text the prior.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    marks = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).cast("int").alias("mark")).where("id is not null and mark is not null").groupBy("id").agg(F.max("mark").alias("mark"))
    marked = marks.join(ids, "id", "left_semi")
    share, n_toxic = marked.agg(F.avg((F.col("mark") == 1).cast("double")), F.count_if(F.col("mark") == 1)).first()
    if prior is None:
        prior = min(max(share or 0.0, 1e-4), 0.9)
    toxic = _least(marked.where("mark = 1").select("id"), max_toxic, n_toxic).select("id", F.lit(True).alias("toxic"), F.lit(False).alias("sampled"))
    sampled = _least(ids, max_unlabelled, ids.count()).select("id", F.lit(False).alias("toxic"), F.lit(True).alias("sampled"))
    # At most max_toxic + max_unlabelled ids.
    chosen = F.broadcast(toxic.unionByName(sampled).groupBy("id").agg(F.max("toxic").alias("toxic"), F.max("sampled").alias("sampled")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("toxic", "sampled", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column(2))
            owner, feature = features_of(words)
            pairs = np.unique((owner << FEATURE_BITS) | feature)
            at = np.searchsorted(pairs >> FEATURE_BITS, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32), at, pa.int32())], names=["toxic", "sampled", "words"])

    sample = texts.mapInArrow(run, "toxic boolean, sampled boolean, words array<int>").toArrow()
    groups: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for batch in sample.to_batches():
        at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        for k, marks in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            for group, mark in zip(groups, marks, strict=True):
                if mark:
                    group.append(flat[at[k] : at[k + 1]])
    for group in groups:  # in an order that doesn't depend on the partitions
        group.sort(key=lambda x: (zlib.crc32(x.tobytes()), x.tobytes()))
    return train(*groups, prior)


def _least(ids: DataFrame, most: int, n: int) -> DataFrame:
    """The ``most`` different ids with the smallest hashes, of ``n`` rows.

    Of different ids, more than ``most`` are almost surely below the bound; where
    many rows share an id, fewer may be, and the sample is that much smaller.
    """
    pick = F.xxhash64("id")
    if n > 2 * (2 * most + 1000):
        span = (1 << 64) * (2 * most + 1000) // n
        ids = ids.where(pick < F.lit(-(1 << 63) + span))
    return ids.distinct().orderBy(pick, "id").limit(most)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1, higher: likelier toxic).

    Whole texts are scored by the presence of words; labels, ids and other
    columns are not looked at.  A null or empty text gets the score of no words.
    Rows stay where they are: no shuffle.  Other columns stay, or those in
    ``keep``; one of this name is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "toxicity"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = model.table()
        for batch in chunks(batches, "__text__"):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(model.score(words_of(batch.column(len(kept))), rows), pa.float64())], names=[*kept, "toxicity"])

    return docs.select(*kept, F.col(text_col).cast("string").alias("__text__")).mapInArrow(run, schema)
