"""N-grams of chunks of documents, counted over the whole corpus, and what follows them.

Every n-gram is a 64-bit hash, and the partition that answers for it is told by
its highest bits, so none is spread over several and none has more entries than
there are chunks.  A chunk sends its sorted hashes as differences.  What no other
chunk has is not asked about again: an n-gram that holds one of those is
nowhere else either, and the chunk knows all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, NOT_SPACE, Words, buffers, chunks, mix

#: Counts up to here are discounted.
DISCOUNTED = 5
#: Fixed marks for the end of a text, which is a token, and for what precedes it.
END, START = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000E2)
#: Sums of probabilities are whole numbers of this share, so that they don't depend on the order.
MASS = 2.0**44
STATS = DISCOUNTED + 3  # types, tokens, types of count 1 to DISCOUNTED + 1
#: Texts that are dealt out at once, for compression.
PACKED_BYTES = 32 << 20
_ROW = "part int, chunk int, level int, "
_ASKED, _COUNTED = _ROW + "keys binary, counts binary, tally array<bigint>", _ROW + "body binary, tally array<bigint>"


def tally(total: np.ndarray) -> np.ndarray:
    return np.r_[(total > 0).sum(), total.sum(), [(total == r).sum() for r in range(1, DISCOUNTED + 2)]].astype(np.int64)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers(texts)
    return LOWER[data], at


class Grams:
    """The different n-grams of one order in a chunk, sorted by hash; ``of``: which of them ends at each token, -1 if none."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, learnt: np.ndarray, below: Grams | None):
        self.below, self.order = below, 1 if below is None else below.order + 1
        self.key, of, place = _grouped(hashes[at])
        self.of = np.full(len(hashes), -1)
        self.of[at] = of
        self.seen = np.bincount(of, learnt[at], len(self.key)).astype(np.int64)
        self.asked = np.arange(len(self.key))
        if below is None:
            return
        place = at[place]
        self.head, self.tail = below.of[place - 1], below.of[place]
        if self.order > 2:
            self.asked = np.flatnonzero(below.shared[self.head] & below.shared[self.tail])

    def learn(self, codes: np.ndarray) -> None:
        """Take the answers of :meth:`Counts.codes`.

        ``alone``: no other chunk has it; ``owned``: of the chunks that have it, this one adds it to sums.
        """
        below = self.below
        self.alone = np.ones(len(self.key), bool) if below is None else below.alone[self.head] | below.alone[self.tail]
        self.total, self.owned = self.seen.copy(), self.alone.copy()
        self.alone[self.asked] = codes == 0
        self.owned[self.asked] = (codes == 0) | (codes & 1 == 0)
        self.total[self.asked] = np.where(codes == 0, self.seen[self.asked], (codes - 1) >> 1)
        self.shared = ~self.alone & (self.total > 0)
        self.open = np.flatnonzero(self.shared)

    def follow(self, longer: Grams) -> None:
        """As histories, from this chunk's n-grams one ``longer``: whose weight it needs, and which have a discounted one."""
        self.wants, self.small = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        self.wants[longer.head[longer.total == 0]] = True
        self.wants &= self.total > 0
        self.small[longer.head[(longer.total > 0) & (longer.total <= DISCOUNTED)]] = True

    def learn_flags(self, flags: np.ndarray) -> None:
        """Take of the open histories whether any chunk needs the weight, and has a discounted n-gram."""
        self.summed = self.open[flags & 1 > 0]
        self.small[self.open] |= flags & 2 > 0
        # A history whose n-grams are all frequent has nothing taken off: one occurrence is added to it.
        self.size = self.total + ~self.small

    def add_up(self, longer: Grams, shorter: np.ndarray) -> None:
        """Of each history: the n-grams of each small count that follow it, and the sum of their ``shorter`` probabilities."""
        needed = self.alone & self.wants
        needed[self.summed] = True
        mine = np.flatnonzero(longer.owned & (longer.total > 0) & needed[longer.head])
        head, total, n = longer.head[mine], longer.total[mine], len(self.key)
        each = np.bincount(head * (DISCOUNTED + 1) + np.where(total <= DISCOUNTED, total, 0), minlength=n * (DISCOUNTED + 1))
        self.few = each.reshape(n, DISCOUNTED + 1)[:, 1:].astype(np.int32)
        self.mass = np.bincount(head, np.rint(shorter[mine] * MASS), n).astype(np.int64)

    def learn_sums(self, few: np.ndarray, mass: np.ndarray) -> None:
        wanted = self.summed[self.wants[self.summed]]
        self.few[wanted], self.mass[wanted] = few, mass


class Texts:
    """A chunk's documents as tokens, each document after ``START``, and their n-grams."""

    def __init__(self, docs: pa.Table):
        tokens, counts = [], []
        for batch in chunks(docs.select(["text"]).to_batches(), "text", 1 << 18):
            words = Words(*lowered(batch.column(0)), NOT_SPACE)
            count = words.counts() + 2
            token = np.full(len(words) + 2 * len(count), END, np.uint64)
            token[np.arange(len(words)) + 2 * words.doc_of() + 1] = words.hashes()
            token[np.cumsum(count) - count] = START
            tokens.append(token)
            counts.append(count)
        self.token, self.count = np.concatenate(tokens), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.token)) - np.repeat(self.first, self.count)
        self.learnt = np.repeat(docs.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool), self.count)
        self.hashes, self.levels = self.token, []
        self.lengthen()

    def lengthen(self) -> None:
        """Find the n-grams one longer than the last ones."""
        n, below = len(self.levels), self.levels[-1] if self.levels else None
        if n:
            self.hashes = np.r_[np.uint64(0), mix(self.hashes[:-1] ^ mix(self.token[1:]))]
        self.levels.append(Grams(self.hashes, np.flatnonzero(self.place >= n), self.learnt, below))


class Counts:
    """What one partition was asked of the n-grams of one order, in the order of the chunks."""

    def __init__(self, asked: pa.Table):
        keys = [np.cumsum(unpack(x).view(np.uint64)) for x in asked.column("keys").to_pylist()]
        key = np.concatenate(keys)
        self.names, self.of, _ = _grouped(key)
        self.total = np.bincount(self.of, np.concatenate([unpack(x) for x in asked.column("counts").to_pylist()]), len(self.names)).astype(np.int64)
        self.alone = np.bincount(self.of, minlength=len(self.names)) == 1
        self.row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        self.size = np.bincount(self.row, minlength=len(keys))

    def codes(self) -> np.ndarray:
        """0 if no other chunk asked, else 1 or 2 and twice the count: 2 for the first chunk that asked."""
        first = np.zeros(len(self.of), np.int64)
        place = np.empty(len(self.names), np.int64)
        place[self.of[::-1]] = np.arange(len(self.of) - 1, -1, -1)
        first[place] = 1
        return np.where(self.alone[self.of], 0, 2 * self.total[self.of] + 1 + first)

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries that several chunks have and that have a count: which n-gram and row each is."""
        at = np.flatnonzero((~self.alone & (self.total > 0))[self.of])
        return self.of[at], self.row[at]


def _order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.argsort``, and the sorted values: hashes with their places in the lowest bits sort three times faster."""
    mask = np.uint64((1 << max(1, len(values)).bit_length()) - 1)
    mixed = values & ~mask
    mixed |= np.arange(len(values), dtype=np.uint64)
    mixed.sort()
    order = (mixed & mask).view(np.int64)
    ordered = values[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    # The few that differ in the lowest bits alone.
    for x in np.unique(mixed[wrong] & ~mask):
        a, b = np.searchsorted(mixed, x), np.searchsorted(mixed, x | mask, "right")
        order[a:b] = order[a:b][np.argsort(ordered[a:b], kind="stable")]
        ordered[a:b] = values[order[a:b]]
    return order, ordered


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, sorted, which of them each value is, and a place of each."""
    order, ordered = _order(values)
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.cumsum(new)
    rank -= 1
    of = np.empty(len(values), np.int64)
    of[order] = rank
    return ordered[new], of, order[new]


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the lowest byte of all first, after how many bytes a number has."""
    values = np.ascontiguousarray(values, np.int64).view(np.uint64)
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = values.astype(f"u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    width, planes = packed[0], zstandard.ZstdDecompressor().decompress(packed[1:])
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(f"u{width}").reshape(-1).astype(np.int64)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk that has any of the next ``PACKED_BYTES``, with compressed texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACKED_BYTES:
            yield _packed_rows(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _packed_rows(pa.Table.from_batches(held))


def _packed_rows(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.sort_by("chunk").combine_chunks()
    data, at = buffers(rows.column("text").combine_chunks())
    runs, compress = list(_runs(rows.column("chunk").to_numpy())), zstandard.ZstdCompressor(level=6).compress
    edges = pa.array([a for _, a, _ in runs] + [len(at) - 1], pa.int32())
    lists = [pa.ListArray.from_arrays(edges, rows.column(name).combine_chunks()) for name in ("doc", "train")]
    sizes, texts = [pack(np.diff(at[a : b + 1])) for _, a, b in runs], [compress(data[at[a] : at[b]].tobytes()) for _, a, b in runs]
    return pa.RecordBatch.from_arrays([*lists, pa.array([c for c, _, _ in runs], pa.int32()), pa.array(sizes, pa.binary()), pa.array(texts, pa.binary())], ["docs", "train", "chunk", "sizes", "texts"])


def _opened(packed: pa.Table) -> pa.Table:
    """The rows of a chunk again: ``doc, text, train, chunk``."""
    decompress = zstandard.ZstdDecompressor().decompress
    size = np.concatenate([unpack(x) for x in packed.column("sizes").to_pylist()])
    data = b"".join(decompress(x) for x in packed.column("texts").to_pylist())
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(data))
    docs, train = (pa.chunked_array([x.flatten() for x in packed.column(name).chunks]) for name in ("docs", "train"))
    return pa.table({"doc": docs, "text": text, "train": train, "chunk": pa.array(np.full(len(size), packed.column("chunk")[0].as_py()), pa.int32())})


def _runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each different part, and where it starts and ends; ``parts`` are sorted."""
    edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(parts) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(parts[a]), int(a), int(b)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _levels(asked: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    asked = asked.sort_by([("level", "ascending"), ("chunk", "ascending")])
    for level, a, b in _runs(asked.column("level").to_numpy()):
        yield level, asked.slice(a, b - a)


def _of(cell: list[dict] | None, level: int, name: str = "body") -> np.ndarray:
    """All that a chunk was told of one level, in the order of the partitions."""
    found = sorted((x["part"], x[name]) for x in cell or [] if x["level"] == level)
    return np.concatenate([unpack(x) for _, x in found]) if found else np.zeros(0, np.int64)


@dataclass
class Rounds:
    """What tasks do.  ``lower``: of each of a chunk's n-grams of an order, the probability of its last word without the first."""

    parts: int
    order: int
    lower: Callable[[list[Grams], int, dict[int, np.ndarray]], np.ndarray]

    def informed(self, docs: pa.Table, cells: list[list[dict]], stats: dict[int, np.ndarray]) -> Texts:
        texts, counted = Texts(docs), min(len(cells), self.order - 1)
        for k in range(1, counted + 2):
            if k > 1:
                texts.lengthen()
            texts.levels[-1].learn(_of(cells[max(0, k - 2)], k))
        levels = texts.levels
        if counted < self.order - 1:
            return texts
        for level, longer in zip(levels[:-1], levels[1:], strict=True):
            level.follow(longer)
        if len(cells) > counted:
            for level in levels[:-1]:
                level.learn_flags(_of(cells[counted], level.order))
        if len(cells) > counted + 1:
            self.add_up(levels, stats)
            for level in levels[:-1]:
                level.learn_sums(_of(cells[counted + 1], level.order).reshape(-1, DISCOUNTED), _of(cells[counted + 1], level.order, "mass"))
        return texts

    def add_up(self, levels: list[Grams], stats: dict[int, np.ndarray]) -> None:
        for level, longer in zip(levels[:-1], levels[1:], strict=True):
            level.add_up(longer, self.lower(levels, longer.order, stats))

    def questions(self, docs: pa.Table, levels: list[Grams]) -> pa.Table:
        rows, number = [], docs.column("chunk")[0].as_py()
        for level in levels:
            key, seen = level.key[level.asked], level.seen[level.asked]
            unasked = level.seen.copy()
            unasked[level.asked] = 0
            stats = tally(unasked).tolist()
            for part, a, b in list(_runs(_part(key, self.parts))) or [(number % self.parts, 0, 0)]:
                rows.append((part, number, level.order, pack(np.diff(key[a:b], prepend=np.uint64(0)).view(np.int64)), pack(seen[a:b]), stats))
                stats = None
        return _rows(rows, _ASKED)

    def words(self, docs: pa.Table) -> pa.Table:
        texts = Texts(docs)
        texts.lengthen()
        return self.questions(docs, texts.levels)

    def grams(self, docs: pa.Table, texts: Texts, stats: dict) -> pa.Table:
        texts.lengthen()
        return self.questions(docs, texts.levels[-1:])

    def flags(self, docs: pa.Table, texts: Texts, stats: dict) -> pa.Table:
        rows, number = [], docs.column("chunk")[0].as_py()
        for level in texts.levels[:-1]:
            flags = level.wants[level.open] + 2 * level.small[level.open]
            rows += [(part, number, level.order, pack(flags[a:b])) for part, a, b in _runs(_part(level.key[level.open], self.parts))]
        return _rows(rows, _ROW + "body binary")

    def sums(self, docs: pa.Table, texts: Texts, stats: dict) -> pa.Table:
        self.add_up(texts.levels, stats)
        rows, number = [], docs.column("chunk")[0].as_py()
        for level in texts.levels[:-1]:
            summed = np.zeros(len(level.key), np.int64)
            summed[level.summed] = 1
            flags = (summed + 2 * level.wants)[level.open]
            some = summed[level.open] > 0
            for part, a, b in _runs(_part(level.key[level.open], self.parts)):
                at = level.open[a:b][some[a:b]]
                mass = level.mass[at]
                rows.append((part, number, level.order, pack(flags[a:b]), pack(np.c_[mass > 0, level.few[at]].T.reshape(-1)), pack(mass[mass > 0])))
        return _rows(rows, _ROW + "flags binary, few binary, mass binary")


class Corpus:
    """The rounds of questions and answers.

    Words and bigrams are asked for at once, longer n-grams a length a round; then
    which histories need weights, and last the sums for those.
    """

    def __init__(self, docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_bytes: int, order: int, lower: Callable[[list[Grams], int, dict[int, np.ndarray]], np.ndarray]):
        rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
        size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        n_chunks, parts = (max(1, -(-size // b)) for b in (chunk_bytes, 2 * chunk_bytes))
        # By content, so that a task that runs again deals out the same.
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc", "text"), F.lit(n_chunks)).cast("int"))
        id_type = docs.schema[id_col].dataType.simpleString()
        self.chunked = dealt.mapInArrow(_packed_texts, f"docs array<{id_type}>, train array<boolean>, chunk int, sizes binary, texts binary").repartition("chunk")
        self.rounds = does = Rounds(parts, order, lower)
        asked, told = [self.chunked.groupBy("chunk").applyInArrow(lambda docs: does.words(_opened(docs)), _ASKED).repartition("part")], []
        told.append(_told(asked[0].groupBy("part").applyInArrow(_count, _COUNTED), 0))
        for _ in range(3, order + 1):
            asked.append(self.each_chunk(told, does.grams, _ASKED).repartition("part"))
            told.append(_told(asked[-1].groupBy("part").applyInArrow(_count, _COUNTED), len(told)))
        stats = _stats(told)
        # The last round's n-grams are nobody's history, unless it is the first round too.
        histories = reduce(DataFrame.unionByName, asked[:-1] or asked)
        flags = self.each_chunk(told, does.flags, _ROW + "body binary").repartition("part")
        told.append(_told(histories.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_answer_flags, _ROW + "body binary"), len(told)))
        sums = self.each_chunk(told, does.sums, _ROW + "flags binary, few binary, mass binary", stats).repartition("part")
        told.append(_told(histories.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(_answer_sums, _ROW + "body binary, mass binary"), len(told)))
        self.told, self.stats = told, stats

    def each_chunk(self, told: list[DataFrame], work: Callable[[pa.Table, Texts, dict], pa.Table], schema: str, stats: DataFrame | None = None) -> DataFrame:
        """``work`` on each chunk's documents and n-grams, with what it was told so far."""
        answers = reduce(lambda a, b: a.join(b.hint("merge"), "chunk", "left"), told)
        if stats is not None:
            answers = answers.crossJoin(F.broadcast(stats))  # one row, whatever the corpus
        n, does = len(told), self.rounds

        def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
            docs, cells = _opened(docs), answers.to_pylist()[0]
            known = {x["level"]: np.array(x["stats"]) for x in cells.get("stats") or []}
            return work(docs, does.informed(docs, [cells[f"told{k}"] for k in range(n)], known), known)

        return self.chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _told(answers: DataFrame, n: int) -> DataFrame:
    """A row for each chunk with all its answers of a round."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "chunk"))).alias(f"told{n}"))


def _stats(told: list[DataFrame]) -> DataFrame:
    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From what the chunks were told, which is read as it lies there."""
        for batch in batches:
            rows = batch.column(1).flatten()
            found = pa.RecordBatch.from_arrays([rows.field("level"), rows.field("tally")], ["level", "tally"])
            yield found.filter(rows.field("tally").is_valid())

    rows = reduce(DataFrame.union, [x.mapInArrow(tallies, "level int, tally array<bigint>") for x in told])
    sums = rows.groupBy("level").agg(F.array(*(F.sum(F.col("tally")[k]) for k in range(STATS))).alias("stats"))
    return sums.agg(F.collect_list(F.struct("level", "stats")).alias("stats"))


def _count(asked: pa.Table) -> pa.Table:
    rows, part = [], asked.column("part")[0].as_py()
    for level, questions in _levels(asked):
        counts = Counts(questions)
        # With those that a chunk didn't ask for because nobody else has them.
        stats = sum((np.array(x) for x in questions.column("tally").to_pylist() if x), tally(counts.total[counts.names != START] if level == 1 else counts.total)).tolist()
        codes = np.split(counts.codes(), np.cumsum(counts.size)[:-1])
        for k, chunk in enumerate(questions.column("chunk").to_pylist()):
            rows.append((part, chunk, level, pack(codes[k]), None if k else stats))
    return _rows(rows, _COUNTED)


def _all(questions: pa.Table, name: str) -> np.ndarray:
    """All numbers of a packed column."""
    return np.concatenate([unpack(x) for x in questions.column(name).to_pylist()])


def _open(histories: pa.Table, questions: pa.Table) -> Iterator[tuple[int, pa.Table, Counts, np.ndarray, np.ndarray]]:
    of_level = dict(_levels(questions))
    for level, asked in _levels(histories):
        if level in of_level:
            counts = Counts(asked)
            at, row = counts.open()
            rows = np.unique(row)  # chunks that have open ones, as their questions lie
            yield level, of_level[level], counts, at, np.searchsorted(rows, row)


def _answer_flags(histories: pa.Table, questions: pa.Table) -> pa.Table:
    rows, part = [], histories.column("part")[0].as_py() if histories.num_rows else 0
    for level, asked, counts, at, row in _open(histories, questions):
        flags, every = _all(asked, "body"), np.zeros(len(counts.names), np.int64)
        for bit in (1, 2):
            has = np.zeros(len(every), bool)
            has[at[flags & bit > 0]] = True
            every += bit * has
        told = np.split(every[at], np.flatnonzero(np.diff(row)) + 1)
        rows += [(part, chunk, level, pack(x)) for chunk, x in zip(asked.column("chunk").to_pylist(), told, strict=True)]
    return _rows(rows, _ROW + "body binary")


def _answer_sums(histories: pa.Table, questions: pa.Table) -> pa.Table:
    rows, part = [], histories.column("part")[0].as_py() if histories.num_rows else 0
    for level, asked, counts, at, row in _open(histories, questions):
        flags, n = _all(asked, "flags"), len(counts.names)
        some = flags & 1 > 0
        sent = [unpack(x).reshape(DISCOUNTED + 1, -1).T for x in asked.column("few").to_pylist()]
        few, at_some = np.concatenate(sent), at[some]
        present = few[:, 0] > 0
        mass = np.bincount(at_some[present], _all(asked, "mass"), n).astype(np.int64)
        each = np.stack([np.bincount(at_some, few[:, r], n) for r in range(1, DISCOUNTED + 1)], 1).astype(np.int64)
        wanted = flags & 3 == 3
        to, edges = at[wanted], np.searchsorted(row[wanted], np.arange(asked.num_rows + 1))
        for k, chunk in enumerate(asked.column("chunk").to_pylist()):
            x = to[edges[k] : edges[k + 1]]
            if len(x):
                rows.append((part, chunk, level, pack(each[x].reshape(-1)), pack(mass[x])))
    return _rows(rows, _ROW + "body binary, mass binary")
