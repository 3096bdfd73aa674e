"""N-gram Jaccard join with Bayesian candidate pruning.

Candidates share a band of MinHash values, and are compared where they do.
Their values are compared a few at a time: from the matches so far follows the
posterior distribution of the similarity, and a pair is dropped as soon as the
threshold has become too unlikely.  The pairs that remain are verified on their
sets of shingles, and only verified links join documents to classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected, cut
from ._text import NOT_SPACE, WIDE, Words, buffers, chunks, lists, mix, ragged, sequence_hashes, span_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values of 16 bits, and how many make a band, which is one number of
#: 64: two texts at the threshold share none of the 32 with a probability of 5e-8.
HASHES, BAND = 128, 4
BANDS = HASHES // BAND
#: Values compared before each look at the posterior, and the probability of
#: reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-9
#: Documents and shingles of one block; buckets of more are compared in pairs of blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
_PAIRS = 1 << 17


class Shingles:
    """Sets of shingles of the texts of a batch."""

    def __init__(self, texts: pa.Array, size: int):
        data, at = buffers(texts)
        self.words = w = Words(data, at, NOT_SPACE)
        n = w.counts()
        per_doc = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
        self.docs = np.r_[0, np.cumsum(per_doc)]
        first = ragged(w.docs[:-1], per_doc)
        self.word_hashes = w.hashes()
        ends = np.minimum(first + size, np.repeat(w.docs[1:], per_doc))
        self.values = span_hashes(self.word_hashes, first, ends, WIDE)

    def signatures(self) -> np.ndarray:
        """The bands of each document, ``BAND`` values in each number; zeros where it has no words."""
        some = self.docs[:-1] < self.docs[1:]
        out = np.zeros((len(some), HASHES), np.uint16)
        if some.any():
            first = self.docs[:-1][some]
            for k, (a, b) in enumerate(_SEEDS):
                least = np.minimum.reduceat((((self.values ^ b) * a) >> np.uint64(32)).astype(np.uint32), first)
                out[some, k] = mix(least.astype(np.uint64)) >> np.uint64(48)
        return out.view(np.int64)

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each document's sequence of words, from independent hashes of the words."""
        return tuple(sequence_hashes(v, self.words.docs).view(np.int64) for v in (self.word_hashes, self.words.hashes(1)))

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """The different shingles of each document, and offsets."""
        owner = np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))
        order = np.lexsort((self.values, owner))
        owner, value = owner[order], self.values[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])][: len(owner)]
        return value[new].view(np.int64), np.searchsorted(owner[new], np.arange(len(self.docs)))


_rng = np.random.default_rng(20240611)
_SEEDS = [(a | np.uint64(1), b) for a, b in _rng.integers(0, 1 << 64, (HASHES, 2), np.uint64)]


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[int]:
    """After each step: the fewest matches with which a pair goes on.

    With every similarity equally likely beforehand, the probability of at least
    ``t`` after ``m`` matches of ``n`` is that of at most ``m`` successes in
    ``n + 1`` trials of probability ``t``.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def candidate_pairs(ends: np.ndarray, side: np.ndarray, band: np.ndarray, bands: np.ndarray, sizes: np.ndarray, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of rows that aren't pruned, in portions, and how many were compared for each.

    Row k may pair with the rows after it and before ``ends[k]``; in a unit of
    two blocks only with rows of the other ``side``.  The rows share the band
    ``band[k]``; a pair that shares an earlier one is compared there.
    """
    n, least, values = len(ends), least_matches(threshold, tolerance), bands.view(np.uint16)
    partners = np.maximum(ends - np.arange(n) - 1, 0)
    total = np.r_[0, np.cumsum(partners)]
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, total[low] + _PAIRS, "right")) - 1)
        rows = np.arange(low, high)
        left, right = np.repeat(rows, partners[low:high]), ragged(rows + 1, partners[low:high])
        low = high
        here = (side[left] != side[right]) | (side[left] < 0)
        left, right = left[here], right[here]
        for k in range(int(band[rows].max(initial=0))):
            if not len(left):
                break
            here = (band[left] <= k) | (bands[left, k] != bands[right, k])
            left, right = left[here], right[here]
        compared = len(left)
        # Sizes too different for the threshold, whatever the overlap.
        alike = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9
        left, right = left[alike], right[alike]
        matches = np.zeros(len(left), np.int64)
        for k, need in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (values[left, part] == values[right, part]).sum(1)
            go = matches >= need
            left, right, matches = left[go], right[go], matches[go]
        yield compared, left, right


def verified(left: np.ndarray, right: np.ndarray, ids: np.ndarray, places: np.ndarray, flag: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: the shingles of the left row are marked, those of its partners counted."""
    sizes = np.diff(places)
    first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    shared = np.zeros(len(left), np.int64)
    for a, b in zip(first, np.r_[first[1:], len(left)], strict=True):
        own = ids[places[left[a]] : places[left[a] + 1]]
        flag[own] = 1
        others, count = places[right[a:b]], sizes[right[a:b]]
        shared[a:b] = np.add.reduceat(flag[ids[ragged(others, count)]], np.cumsum(count) - count, dtype=np.int64)
        flag[own] = 0
    return shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column one after another, and offsets into them."""
    array = column.combine_chunks()
    places = array.offsets.to_numpy().astype(np.int64)
    return array.values.to_numpy()[places[0] : places[-1]], places - places[0]


def _candidates(t: pa.Table, sizes: np.ndarray, threshold: float, tolerance: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    unit = t.column("unit").to_numpy()
    change = np.r_[True, unit[1:] != unit[:-1]]
    ends = np.r_[np.flatnonzero(change)[1:], len(unit)][np.cumsum(change) - 1]
    bands = np.ascontiguousarray(_flat(t.column("bands"))[0].reshape(len(unit), BANDS))
    return candidate_pairs(ends, t.column("side").to_numpy(), t.column("band").to_numpy(), bands, sizes, threshold, tolerance)


def _survivors(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that have a pair left; rows come sorted by unit."""
    for t in _units(batches):
        some = np.zeros(t.num_rows, bool)
        for _, left, right in _candidates(t, t.column("size").to_numpy(), threshold, tolerance):
            some[left] = some[right] = True
        yield from t.filter(pa.array(some)).select(["c1", "c2", "unit", "band", "side"]).to_batches()


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Links and roots of the texts of each unit; rows come sorted by unit and text."""
    for t in _units(batches):
        key = [t.column(c).to_numpy() for c in ("unit", "c1", "c2")]
        # Repeated rows of a text stand next to each other.
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]
        if not new.all():
            t = t.filter(pa.array(new))
        n = t.num_rows
        values, places = _flat(t.column("shingles"))
        ids = np.unique(values, return_inverse=True)[1].astype(np.int32)
        flag = np.zeros(int(ids.max(initial=0)) + 1, np.int8)
        weight, root, links = t.column("copies").to_numpy(), np.arange(n), np.zeros(n, np.int64)
        for _, left, right in _candidates(t, np.diff(places), threshold, tolerance):
            if not len(left):
                continue
            good = verified(left, right, ids, places, flag, threshold)
            left, right = left[good], right[good]
            links += np.bincount(left, weight[right], n).astype(np.int64) + np.bincount(right, weight[left], n).astype(np.int64)
            while True:
                a, b = root[left], root[right]
                least = np.minimum(a, b)
                if (a == b).all():
                    break
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
                while (root[root] != root).any():
                    root = root[root]
        own, at = [t.column(c).combine_chunks() for c in ("doc", "c1", "c2")], pa.array(root)
        yield pa.RecordBatch.from_arrays([*own, pa.array(links), *(c.take(at) for c in own)], names=["doc", "c1", "c2", "links", "d0", "r1", "r2"])


def _units(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.Table]:
    """Tables of whole units, several small ones together."""
    held: list[pa.RecordBatch] = []
    count, weight = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != unit[0] and (count >= rows or weight > BLOCK_SHINGLES * 8):
            yield pa.Table.from_batches(held)
            held, count, weight = [], 0, 0
        cut_at = int(np.searchsorted(unit, unit[-1], "left"))
        if cut_at and count + cut_at >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held, count, weight = [], 0, 0
            batch = batch.slice(cut_at)
        held.append(batch)
        count, weight = count + batch.num_rows, weight + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def describe(rows: DataFrame, id_type: str, shingle: int) -> DataFrame:
    """``doc, t, c1, c2, size, bands`` of ``rows`` (``doc, text, t``): hashes of the words, and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = Shingles(batch.column(1), shingle)
            n = np.diff(s.docs)
            bands = lists(s.signatures()[n > 0].reshape(-1), np.r_[0, np.cumsum((n > 0) * BANDS)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, mask=n == 0) for c in s.contents()), pa.array(n), bands], names=["doc", "t", "c1", "c2", "size", "bands"])

    return rows.mapInArrow(run, f"doc {id_type}, t bigint, c1 bigint, c2 bigint, size bigint, bands array<bigint>")


def units(nodes: DataFrame) -> DataFrame:
    """``unit, band, side, c1, c2, size, bands``: where each text (``c1, c2, size, bands``) is compared.

    A bucket has the texts that share a band.  Buckets of the same texts are
    one, that of the first band.  A bucket is a unit, or one for every two of
    its blocks.
    """
    bands = nodes.select("c1", "c2", "size", F.posexplode("bands").alias("band", "value")).select("c1", "c2", "size", "band", F.xxhash64("band", "value").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.expr("bit_xor(xxhash64(c1, c2))").alias("texts")).where("n > 1")
    first = buckets.groupBy("n", "total", "texts").agg(F.min(F.struct("band", "key")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    # A key of its own lets Spark deal out, and split, both sides of the join.
    chosen = first.select(F.bitwise_not("b.key").alias("at"), blocks.alias("blocks"))
    members = bands.withColumn("at", F.bitwise_not("key")).join(chosen, "at").select("c1", "c2", "band", "at", "blocks")
    block = F.pmod(F.xxhash64("c1", "c2"), F.col("blocks"))
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    unit = F.xxhash64("at", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), F.lit(-1).cast("bigint")).otherwise(F.col("block"))
    return dealt.select("c1", "c2", unit.alias("unit"), "band", side.alias("side")).join(nodes.select("c1", "c2", "size", "bands"), ["c1", "c2"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``id_col, text_hash, copy_of, class_id, n_links, stays`` of every row.

    Two documents are linked when the Jaccard similarity of their sets of
    ``shingle`` consecutive words (runs of characters other than space and \\t to
    \\r; a text of fewer words is one shingle) is at least ``threshold``.
    ``n_links`` counts a document's links, those to its exact copies included;
    ``class_id`` is the least id of its connected component of links;
    ``copy_of`` the least id among the documents with the same words.  ``stays``
    is true for one text of each class, under its least id; ``text_hash`` is
    ``xxhash64`` of the text, which tells the texts of one id apart.

    Exact copies are one node from the start, so they are never paired.  Texts
    that share a band meet in its bucket, first with their MinHash values alone,
    and where a pair is left there, once more with their shingles.  A pair is
    compared in the bucket of the first band it shares, and nowhere else.  A
    bucket of more than ``BLOCK_DOCS`` texts or ``BLOCK_SHINGLES`` shingles is a
    unit of work for every two of its blocks.  A task returns a row for each
    text, not the pairs: the count of links and a root.  Nothing is capped or
    sampled.

    Documents without words, or with a null id, are linked to nothing and stay; a
    null id has a null class.  Repeated rows of one id and text count as one copy
    each, and stay or go together.  Texts under one id are documents each.
    Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("t"))
    described = cut(describe(rows, id_type, shingle))
    texts = described.where("c1 is not null and doc is not null")
    nodes = cut(texts.groupBy("c1", "c2").agg(F.min(F.struct("doc", "t")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("c1", "c2", "least.doc", "least.t", "copies", "size", "bands"))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _survivors(batches, threshold, tolerance)

    met = units(nodes).repartition("unit").sortWithinPartitions("unit").mapInArrow(survivors, "c1 bigint, c2 bigint, unit bigint, band int, side bigint")
    placed = met.groupBy("c1", "c2").agg(F.collect_list(F.struct("unit", "band", "side")).alias("units")).join(nodes.select("c1", "c2", "doc", "t", "copies"), ["c1", "c2"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = Shingles(batch.column(1), shingle)
            value, at = s.sets()
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "c1", "c2", "copies", "units")]
            yield pa.RecordBatch.from_arrays([*own, lists(value, at, pa.int64()), lists(s.signatures().reshape(-1), np.arange(batch.num_rows + 1) * BANDS, pa.int64())], names=["doc", "c1", "c2", "copies", "units", "shingles", "bands"])

    chosen = rows.join(placed, ["doc", "t"]).select("doc", "text", "c1", "c2", "copies", "units")
    ready = chosen.mapInArrow(prepare, f"doc {id_type}, c1 bigint, c2 bigint, copies bigint, units array<struct<unit: bigint, band: int, side: bigint>>, shingles array<bigint>, bands array<bigint>")
    dealt = ready.withColumn("u", F.explode("units")).select("u.unit", "u.band", "u.side", "doc", "c1", "c2", "copies", "shingles", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, threshold, tolerance)

    found = cut(dealt.repartition("unit").sortWithinPartitions("unit", "c1", "c2").mapInArrow(compare, f"doc {id_type}, c1 bigint, c2 bigint, links bigint, d0 {id_type}, r1 bigint, r2 bigint"))
    links = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    edges = found.where("r1 <> c1 or r2 <> c2").select(F.struct(F.col("d0").alias("doc"), F.col("r1").alias("c1"), F.col("r2").alias("c2")).alias("u"), F.struct("doc", "c1", "c2").alias("v"))
    classes = connected(edges).select("node.c1", "node.c2", "component")
    known = nodes.drop("size", "bands").join(links, ["c1", "c2"], "left").join(classes, ["c1", "c2"], "left")
    whole = F.coalesce((F.col("component.c1") == F.col("c1")) & (F.col("component.c2") == F.col("c2")), F.lit(True))
    known = known.select(F.bitwise_not("c1").alias("k1"), F.bitwise_not("c2").alias("k2"), F.col("doc").alias("copy_of"), F.coalesce("component.doc", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(whole, F.col("t")).alias("least_t"))
    keyed = described.select("doc", "t", F.bitwise_not("c1").alias("k1"), F.bitwise_not("c2").alias("k2"))
    stays = F.coalesce((F.col("doc") == F.col("copy_of")) & (F.col("t") == F.col("least_t")), F.lit(False))
    linked = keyed.where("k1 is not null and doc is not null").join(known, ["k1", "k2"]).select("doc", "t", "copy_of", "class_id", "n_links", stays.alias("stays"))
    alone = keyed.where("k1 is null or doc is null").select("doc", "t", F.col("doc").alias("copy_of"), F.col("doc").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("stays"))
    return linked.unionByName(alone).withColumnRenamed("doc", id_col).withColumnRenamed("t", "text_hash")
