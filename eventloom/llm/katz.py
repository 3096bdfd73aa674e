"""LM scoring: a Katz backoff model of any order with Good-Turing discounts.

Scores come from the counts of :mod:`._ngrams`: documents are dealt out in chunks, and
a chunk asks for the counts of the whole corpus, a partition at a time.

The model's tables (:func:`store`) are partitioned by what they are asked for: words by
their hash, bigrams and longer by their history.  There a chunk asks each partition once for all its different words, then for
all its different bigrams and so on.  What a chunk must know of a history as a whole comes
from one partition.  So no table of the vocabulary goes anywhere whole, and a frequent word
costs one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._ngrams import DISCOUNTED, END, MASS, START, STATS, Corpus, Grams, Texts, lowered, tally
from ._text import NOT_SPACE, Words, chunks, mix

#: Text of a chunk in bytes, for scores and for tables; one partition answers for twice as much.
SCORED_BYTES, CHUNK_BYTES = 8 << 20, 2 << 20
_STATS, _tally = STATS, tally
_SALT = np.uint64(0xD6E8FEB86659FD93)


def discounts(types: np.ndarray) -> np.ndarray:
    """Good-Turing factors of the counts 0 to ``DISCOUNTED``; ``types[r - 1]`` have count r.

    Where the counts of counts are too few for a factor between 0 and 1, half an
    occurrence is taken off instead.
    """
    n, k = np.asarray(types, float), DISCOUNTED
    out = np.ones(k + 1)
    with np.errstate(all="ignore"):
        tail = (k + 1) * n[k] / n[0]
        for r in range(1, k + 1):
            d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            out[r] = d if np.isfinite(d) and 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """The lowest level: discounted shares of known words, the rest for one unknown word."""

    types: int
    tokens: int
    factors: np.ndarray
    unknown: float

    @classmethod
    def of(cls, stats: np.ndarray) -> Unigrams:
        types, tokens = int(stats[0]), int(stats[1])
        factors = discounts(stats[2:])
        r = np.arange(1, DISCOUNTED + 1)
        free = float(((1 - factors[1:]) * r * stats[2 : 2 + DISCOUNTED]).sum())
        return cls(types, tokens, factors, free / tokens if free else 1 / (tokens + 1))

    def probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        known = count * self.factors[np.where(count <= DISCOUNTED, count, 0)]
        total = self.tokens if (self.factors[1:] < 1).any() and self.unknown != 1 / (self.tokens + 1) else self.tokens + 1
        return np.where(count > 0, known / total, self.unknown)


class Chunk:
    """Tokens of a chunk's documents, its different words and n-grams, and whom to ask for them."""

    def __init__(self, docs: pa.Table, parts: int):
        tokens, counts = [], []
        for batch in chunks(docs.select(["text"]).to_batches(), "text"):
            words = Words(*lowered(batch.column(0)), NOT_SPACE)
            count = words.counts() + 1
            token = np.full(len(words) + len(count), END, np.uint64)
            token[np.arange(len(words)) + words.doc_of()] = words.hashes()
            tokens.append(token)
            counts.append(count)
        self.token, count = np.concatenate(tokens), np.concatenate(counts)
        self.docs = np.r_[0, np.cumsum(count)]
        learnt = docs.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.learnt = np.repeat(learnt, count)
        self.parts = parts
        # Different words, in the order of the partitions that know them.
        word, self.word_of, _ = _distinct(self.token)
        part = (mix(word) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((word, part))
        self.words, self.word_part = word[order], part[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.word_of = rank[self.word_of]

    def ask_words(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        seen = np.bincount(self.word_of, self.learnt, len(self.words)).astype(np.int32)
        for part, a, b in _runs(self.word_part):
            yield part, self.words[a:b].view(np.int64), seen[a:b]

    def learn_words(self, totals: np.ndarray, stats: np.ndarray) -> None:
        """Take the corpus counts of the words, and find the bigrams that can be known."""
        self.unigrams, self.known = Unigrams.of(stats), totals[self.word_of]
        end = np.flatnonzero(self.words == END)
        texts = totals[end[0]] if len(end) else 0
        history = np.empty(len(self.token), np.int64)
        history[1:] = self.word_of[:-1]
        history[self.docs[:-1]] = len(self.words)
        self.levels = [Level(self, history, np.append(totals, texts), np.append(self.words, START), self.known, None)]

    def ask(self, ids: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The questions of the last level to each partition; ``ids``: numbers of the words, from 1 on, shorter than hashes."""
        return self.levels[-1].ask(np.append(ids, 0))

    def learn(self, stats: np.ndarray, totals: np.ndarray, low: np.ndarray, few: np.ndarray, mass: np.ndarray) -> None:
        """Take the corpus counts that the last level asked for."""
        self.levels[-1].learn(stats, totals, low, few, mass)

    def lengthen(self) -> None:
        """Find the n-grams one longer than the last level's that can be known."""
        last = self.levels[-1]
        gram = np.full(len(self.token), -1)
        gram[last.asked] = last.gram_of
        history = np.r_[-1, gram[:-1]]
        history[self.docs[:-1]] = -1
        hashes = mix(last.head_hash[last.head] ^ mix(self.words[last.tail]))
        self.levels.append(Level(self, history, last.totals, hashes, last.gram, last))


class Level:
    """What a chunk asks and is told of the n-grams of one order.

    ``history``: of each token, which of the level's heads precedes it, -1 if
    none that can be known; ``low``: the count of the n-gram one shorter.
    """

    def __init__(self, chunk: Chunk, history: np.ndarray, counts: np.ndarray, hashes: np.ndarray, low: np.ndarray, below: Level | None):
        self.chunk, self.history, self.head_count, self.head_hash, self.below = chunk, history, counts, hashes, below
        n, words, parts = len(counts), chunk.words, np.uint64(chunk.parts)
        self.history_count = np.append(counts, 0)[history]
        self.asked = np.flatnonzero((low > 0) & (self.history_count > 0))
        code, self.gram_of, first = _distinct(history[self.asked] * len(words) + chunk.word_of[self.asked])
        head, tail = code // len(words), code % len(words)
        # A frequent history is spread over several partitions by its next word.
        share = np.clip(-(-4 * counts * chunk.parts // max(chunk.unigrams.tokens, 1)), 1, chunk.parts)
        salt = words[tail] % share[head].astype(np.uint64)
        part = (mix(hashes[head] + salt * _SALT) % parts).astype(np.int64)
        order = np.lexsort((code, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.gram_of = rank[self.gram_of]
        self.head, self.tail, self.part = head[order], tail[order], part[order]
        self.low = low[self.asked[first]][order]
        # One partition, its home, is asked about a history as a whole; the others that
        # have n-grams of it send their sums there.
        used = np.unique(history[self.history_count > 0])
        self.home = np.full(n + 1, -1)
        self.home[used] = (mix(hashes[used]) % parts).astype(np.int64)
        both = np.unique(np.r_[self.home[used] * max(n, 1) + used, self.part * max(n, 1) + self.head])
        self.side_part, self.side_head = both // max(n, 1), both % max(n, 1)
        self.at_home = self.home[self.side_head] == self.side_part
        self.held = np.zeros(n + 1, bool)
        self.held[history[~chunk.learnt]] = True

    def ask(self, ids: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        seen = np.bincount(self.gram_of, self.chunk.learnt[self.asked], len(self.head)).astype(np.int32)
        names, size = ids, np.zeros(0, np.int64)
        if self.below is not None:
            names, size = self.head_hash.view(np.int64), np.zeros(len(self.head_count) + 1, np.int64)
            size[self.history] = self.below.size
        grams = {part: (a, b) for part, a, b in _runs(self.part)}
        for part, a, b in _runs(self.side_part):
            c, d = grams.get(part, (0, 0))
            heads = self.side_head[a:b]
            degree = np.bincount(np.searchsorted(heads, self.head[c:d]), minlength=len(heads)).astype(np.int32)
            yield part, [names[heads], self.held[heads] & self.at_home[a:b], self.home[heads], degree, ids[self.tail[c:d]], seen[c:d], self.low[c:d], size[heads] if len(size) else size]

    def learn(self, stats: np.ndarray, totals: np.ndarray, low: np.ndarray, few: np.ndarray, mass: np.ndarray) -> None:
        n, wanted = len(self.head_count), self.side_head[self.held[self.side_head] & self.at_home]
        self.stats, self.factors, self.totals = stats, discounts(stats[2:]), totals
        small = np.zeros(n + 1, bool)
        np.logical_or.at(small, self.side_head, low)
        left, self.seen_mass = np.zeros(n + 1), np.zeros(n + 1)
        r = np.arange(1, DISCOUNTED + 1)
        np.add.at(left, wanted, (few * ((1 - self.factors[1:]) * r)).sum(1))
        np.add.at(self.seen_mass, wanted, mass)
        self.gram = np.zeros(len(self.history), np.int64)
        self.gram[self.asked] = totals[self.gram_of]
        # A history whose n-grams are all frequent has nothing taken off: one occurrence is added to it.
        self.size = self.history_count + ~small[self.history]
        self.free = np.where(small, left, 1.0)


def _cut(count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return count * factors[np.where(count <= DISCOUNTED, count, 0)]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in the order of their first places, which of them each value is, and those places."""
    coded = pa.array(values).dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    return values[first], of, first


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]) if len(sorted_values) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(sorted_values[a]), int(a), int(b)


def _join(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a list column, or all numbers of a packed one."""
    column = table.column(name)
    if pa.types.is_binary(column.type):
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(unpack(x), np.uint8).reshape(8, -1).T.copy().view(np.int64)[:, 0] for x in column.to_pylist()]
    else:
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _sizes(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in table.column(name).chunks] or [np.zeros(0, np.int64)]).astype(np.int64)


def _packed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Numbers as compressed bytes, the lowest byte of all first: counts are small, and zeros in a row shrink to nothing."""
    pack = zstandard.ZstdCompressor(level=1).compress
    values, at = np.ascontiguousarray(values, np.int64), np.r_[0, np.cumsum(sizes)]
    return pa.array([pack(values[a:b].view(np.uint8).reshape(-1, 8).T.tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def _list(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _table(names: str, columns: list[pa.Array]) -> pa.Table:
    return pa.Table.from_arrays(columns, names=names.split())


def _word_totals(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts and places among the partition's sorted words, in the order asked; counts of each different word."""
    names, at, _ = _distinct(_join(asked, "keys"))
    total = np.bincount(at, _join(asked, "counts"), len(names)).astype(np.int64)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names)] = np.arange(len(names))
    return total[at], rank[at], total


def _stats_row(total: np.ndarray) -> pa.Table:
    return _table("stats", [_list(np.array([_STATS]), _tally(total), pa.int64())])


class _Grams:
    """The n-grams of one order that one partition was asked for."""

    def __init__(self, asked: pa.Table):
        head, degree, tail = _join(asked, "heads").view(np.uint64), _join(asked, "degrees"), _join(asked, "tails").view(np.uint64)
        key = mix(np.repeat(head, degree) ^ mix(tail))
        _, self.at, first = _distinct(key)
        self.total = np.bincount(self.at, _join(asked, "counts"), len(first)).astype(np.int64)
        self.names, self.side_of, entry = _distinct(head)
        self.home = _join(asked, "homes")[entry]
        self.head = np.repeat(self.side_of, degree)[first]
        self.low, self.heads = _join(asked, "known")[first], len(self.names)
        self.size = np.zeros(self.heads, np.int64)
        if "sizes" in asked.column_names:
            self.size[self.side_of] = _join(asked, "sizes")


@dataclass
class _Counts:
    """Documents in chunks, and what their chunks ask and are told."""

    chunked: DataFrame
    asked: DataFrame  # words, dealt out by the partition that counts them
    grams: list[DataFrame]  # bigrams and longer, dealt out by the partition that counts them
    answers: DataFrame  # counts of all but the last of these, by chunk
    parts: int
    informed: Callable[[pa.Table, pa.Table, int], Chunk]


def _with_stats(answers: DataFrame, tallies: DataFrame) -> DataFrame:
    sums = tallies.agg(F.array(*(F.sum(F.col("stats")[k]) for k in range(_STATS))).alias("stats"))
    # One row, whatever the corpus.
    return answers.withColumn("one", F.col("part") >= 0).join(F.broadcast(sums.withColumn("one", F.col("stats")[0] >= 0)), "one").drop("one")


def _counted(docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_bytes: int, order: int) -> _Counts:
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts, n_chunks = (max(1, -(-size // b)) for b in (2 * chunk_bytes, chunk_bytes))
    # By content, so that a task that runs again deals out the same.
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc", "text"), F.lit(n_chunks)).cast("int")).repartition("chunk")

    def ask_words(docs: pa.Table) -> pa.Table:
        asked = list(Chunk(docs, parts).ask_words())
        sizes, chunk = np.array([len(x[1]) for x in asked]), docs.column("chunk")[0].as_py()
        return _table("part chunk keys counts", [pa.array([x[0] for x in asked], pa.int32()), pa.array([chunk] * len(asked), pa.int32()), _list(sizes, np.concatenate([x[1] for x in asked]), pa.int64()), _packed(sizes, np.concatenate([x[2] for x in asked]))])

    asked = chunked.groupBy("chunk").applyInArrow(ask_words, "part int, chunk int, keys array<bigint>, counts binary").repartition("part")

    def answer_words(asked: pa.Table) -> pa.Table:
        total, rank, _ = _word_totals(asked)
        sizes = _sizes(asked, "keys")
        return _table("chunk part totals ids", [asked.column("chunk"), asked.column("part"), _packed(sizes, total), _packed(sizes, rank * parts + asked.column("part")[0].as_py() + 1)])

    def tally_words(asked: pa.Table) -> pa.Table:
        return _stats_row(_word_totals(asked)[2])

    words = _with_stats(asked.groupBy("part").applyInArrow(answer_words, "chunk int, part int, totals binary, ids binary"), asked.groupBy("part").applyInArrow(tally_words, "stats array<bigint>"))

    def informed(docs: pa.Table, answers: pa.Table, level: int) -> Chunk:
        """The chunk with what it was told of the n-grams of up to ``level`` words."""
        chunk = Chunk(docs, parts)
        for k in range(1, level + 1):
            told = answers.filter(pc.equal(answers.column("level"), k)).sort_by("part")
            stats = told.column("stats")[0].values.to_numpy(zero_copy_only=False) if told.num_rows else np.zeros(_STATS, np.int64)
            if k == 1:
                chunk.learn_words(_join(told, "totals"), stats)
                continue
            if k > 2:
                chunk.lengthen()
            chunk.learn(stats, _join(told, "totals"), _join(told, "low").astype(bool), _join(told, "few").reshape(-1, DISCOUNTED), _join(told, "mass"))
        return chunk

    def ask(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        names = "heads wanted homes degrees tails counts known".split() + ["sizes"] * (level > 2)

        def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = informed(docs, answers, level - 1)
            if level > 2:
                chunk.lengthen()
            one = answers.filter(pc.equal(answers.column("level"), 1)).sort_by("part")
            below = answers.filter(pc.equal(answers.column("level"), level - 1))
            stats = below.column("stats")[0].values.to_numpy(zero_copy_only=False) if below.num_rows else np.zeros(_STATS, np.int64)
            got = list(chunk.ask(_join(one, "ids")))
            lists = []
            for k, name in enumerate(names):
                sizes, values = np.array([len(x[1][k]) for x in got], np.int64), np.concatenate([x[1][k] for x in got]) if got else np.zeros(0, np.int64)
                lists.append(_list(sizes, values, pa.bool_()) if name == "wanted" else _packed(sizes, values))
            n, number = len(got), docs.column("chunk")[0].as_py()
            return _table(" ".join(["part chunk", *names, "stats"]), [pa.array([x[0] for x in got], pa.int32()), pa.array([number] * n, pa.int32()), *lists, _list(np.full(n, _STATS), np.tile(stats, n), pa.int64())])

        return run

    answers, grams = words.withColumn("level", F.lit(1)), []
    for level in range(2, order + 1):
        if level > 2:
            answers = answers.unionByName(_answered(grams[-1], level - 1), allowMissingColumns=True)
        schema = "part int, chunk int, heads binary, wanted array<boolean>, homes binary, degrees binary, tails binary, counts binary, known binary, " + "sizes binary, " * (level > 2) + "stats array<bigint>"
        grams.append(chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask(level), schema).repartition("part"))
    return _Counts(chunked, asked, grams, answers, parts, informed)


def _answered(grams: DataFrame, level: int) -> DataFrame:
    """What the chunks are told of the n-grams of ``level`` words: counts, and of histories what their shares leave."""

    def sums(asked: pa.Table) -> tuple[_Grams, np.ndarray, np.ndarray]:
        """Of each history, as far as this partition has it: its n-grams of each small count, and their shorter probabilities."""
        g = _Grams(asked)
        stats = asked.column("stats")[0].values.to_numpy(zero_copy_only=False)
        seen = g.total > 0
        few = np.stack([np.bincount(g.head[g.total == r], minlength=g.heads) for r in range(1, DISCOUNTED + 1)], 1)
        shorter = Unigrams.of(stats).probability(g.low[seen]) if level == 2 else _cut(g.low[seen], discounts(stats[2:])) / g.size[g.head[seen]]
        return g, few, np.bincount(g.head[seen], shorter, g.heads)

    def abroad(asked: pa.Table) -> pa.Table:
        """The sums of histories that are at home in another partition: a row for each, whatever the number of chunks."""
        g, few, mass = sums(asked)
        away = np.flatnonzero(g.home != asked.column("part")[0].as_py())
        return _table("part head few mass", [pa.array(g.home[away], pa.int32()), pa.array(g.names[away].view(np.int64)), _list(np.full(len(away), DISCOUNTED), few[away].reshape(-1), pa.int64()), pa.array(mass[away])])

    def answer(asked: pa.Table, others: pa.Table) -> pa.Table:
        g, few, mass = sums(asked)
        if others.num_rows:
            order = np.argsort(g.names)
            place = order[np.searchsorted(g.names[order], others.column("head").to_numpy().view(np.uint64))]
            np.add.at(few, place, _join(others, "few").reshape(-1, DISCOUNTED))
            np.add.at(mass, place, others.column("mass").to_numpy())
        wanted = _join(asked, "wanted").astype(bool)
        sizes, at = _sizes(asked, "wanted"), g.side_of
        edges = np.r_[0, np.cumsum(sizes)]
        some = np.diff(np.r_[0, np.cumsum(wanted)][edges])
        per_gram = np.diff(np.r_[0, np.cumsum(_join(asked, "degrees"))][edges])
        return _table(
            "chunk part totals low few mass",
            [asked.column("chunk"), asked.column("part"), _packed(per_gram, g.total[g.at]), _list(sizes, (few.sum(1) > 0)[at], pa.bool_()), _packed(some * DISCOUNTED, few[at[wanted]].reshape(-1)), _list(some, mass[at[wanted]], pa.float64())],
        )

    def tally(asked: pa.Table) -> pa.Table:
        return _stats_row(_Grams(asked).total)

    elsewhere = grams.groupBy("part").applyInArrow(abroad, "part int, head bigint, few array<bigint>, mass double")
    told = _with_stats(grams.groupBy("part").cogroup(elsewhere.groupBy("part")).applyInArrow(answer, "chunk int, part int, totals binary, low array<boolean>, few binary, mass array<double>"), grams.groupBy("part").applyInArrow(tally, "stats array<bigint>"))
    return told.withColumn("level", F.lit(level))


def _lower(levels: list[Grams], order: int, stats: dict[int, np.ndarray]) -> np.ndarray:
    """Of each n-gram of ``order`` words that has a count: its last word's probability without the first."""
    grams = levels[order - 1]
    if order == 2:
        return Unigrams.of(stats[1]).probability(levels[0].total[grams.tail])
    below = levels[order - 2]
    return (_cut(below.total, _factors(stats, order - 1)) / levels[order - 3].size[below.head])[grams.tail]


def _factors(stats: dict[int, np.ndarray], order: int) -> np.ndarray:
    return discounts(stats.get(order, np.zeros(_STATS, np.int64))[2:])


def _probabilities(levels: list[Grams], stats: dict[int, np.ndarray]) -> np.ndarray:
    """Of every token, from that under each history one word shorter."""
    p = Unigrams.of(stats[1]).probability(levels[0].total[levels[0].of])
    r = np.arange(1, DISCOUNTED + 1)
    for history, grams in zip(levels[:-1], levels[1:], strict=True):
        factors = _factors(stats, grams.order)
        left = np.where(history.small, (history.few * ((1 - factors[1:]) * r)).sum(1), 1.0)
        at = np.flatnonzero(grams.of >= 0)
        gram = grams.of[at]
        head = grams.head[gram]
        with np.errstate(all="ignore"):
            seen = _cut(grams.total, factors) / history.size[grams.head]
            unseen = p[at] * (left / history.size / (1 - history.mass / MASS))[head]
        p[at] = np.where(history.total[head] == 0, p[at], np.where(grams.total[gram] > 0, seen[gram], unseen))
    return p


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = SCORED_BYTES, order: int = 2) -> DataFrame:
    """``id_col, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows for which ``train`` (a column over ``docs``)
    is true.  Tokens are words (runs of characters other than space and \\t to
    \\r, A-Z as a-z) and one end a text.  ``n_known`` tokens occur in the
    ``train_tokens`` learnt; ``base_score`` is the log10 probability with one
    added to each word's count, ``score`` that of the Katz model:

    an n-gram of ``order`` words (2 or more) with a count has its discounted
    share of its history's count; any other token the probability after the
    history without its first word, times the weight by which the shares of all
    words that never followed the history sum to what the discounts left over;
    and so on down to the word alone.  A word's probability is its discounted
    share of all tokens; what is left there is one unknown word's.  A history
    that was never seen leaves the shorter one's probability as it is.  What
    precedes a text counts as one word, and histories don't reach beyond it.

    Texts are dealt out once, in chunks of about ``chunk_bytes``; half as many
    partitions answer.  An n-gram is asked for where its hash says, by each chunk that
    has it and only if another chunk may have it too; of the chunks that have it one adds
    it to the sums of its history, and only for histories whose weight some chunk
    needs.  So the work is in proportion to the corpus.  Larger chunks, on executors with
    more memory, send less.  A null text is empty: one token.
    A very long text is one chunk, and so are all rows of one id and text.  Where ``train`` is
    null the row isn't learnt from.  Repeated rows count each.  Other columns are
    ignored.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    id_type = docs.schema[id_col].dataType.simpleString()
    corpus = Corpus(docs, train, id_col, text_col, chunk_bytes, order, _lower)
    out = f"`{id_col}` {id_type}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def evaluate(docs: pa.Table, texts: Texts, stats: dict[int, np.ndarray]) -> pa.Table:
        unigrams = Unigrams.of(stats[1])
        known = texts.levels[0].total[texts.levels[0].of]
        base, each = np.log10((known + 1) / (unigrams.tokens + unigrams.types + 1)), np.log10(_probabilities(texts.levels, stats))
        before, n = texts.place == 0, len(texts.first)
        known[before], base[before], each[before] = 0, 0, 0
        base, each, known = (np.add.reduceat(x, texts.first) for x in (base, each, (known > 0).astype(np.int64)))
        return _table(
            f"{id_col} train n_tokens n_known train_tokens base_score score",
            [docs.column("doc"), docs.column("train"), pa.array(texts.count - 1), pa.array(known), pa.array(np.full(n, unigrams.tokens)), pa.array(base), pa.array(each)],
        )

    return corpus.each_chunk(corpus.told, evaluate, out, corpus.stats)


def count_tables(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, order: int = 2) -> list[DataFrame]:
    """The model's tables: ``part, id, word, count``, then ``part, history, word, count`` for each order from 2 on.

    ``word`` of the first is the word's hash, of the others its ``id``; the
    ``history`` of a bigram is an id, 0 for what precedes a text, that of a
    longer n-gram a hash.  Rows lie in the partitions that count them, and only
    counts above 0 are there.
    """
    counts = _counted(docs, train, id_col, text_col, chunk_bytes, order)
    parts = counts.parts

    def words_of(asked: pa.Table) -> pa.Table:
        keys, part = _join(asked, "keys"), asked.column("part")[0].as_py()
        total, rank, _ = _word_totals(asked)
        _, _, first = _distinct(keys)
        known = first[total[first] > 0]
        return _table("part id word count", [pa.array(np.full(len(known), part), pa.int32()), pa.array(rank[known] * parts + part + 1), pa.array(keys[known]), pa.array(total[known])])

    def grams_of(asked: pa.Table) -> pa.Table:
        g, heads = _Grams(asked), _join(asked, "heads")
        seen = np.flatnonzero(g.total > 0)
        first = _distinct(g.at)[2]
        history, word = np.repeat(heads, _join(asked, "degrees"))[first], _join(asked, "tails")[first]
        return _table("part history word count", [pa.array(np.full(len(seen), asked.column("part")[0].as_py()), pa.int32()), pa.array(history[seen]), pa.array(word[seen]), pa.array(g.total[seen])])

    words = counts.asked.groupBy("part").applyInArrow(words_of, "part int, id bigint, word bigint, count bigint")
    return [words, *(level.groupBy("part").applyInArrow(grams_of, "part int, history bigint, word bigint, count bigint") for level in counts.grams)]


def store(docs: DataFrame, train: Column, path: str, **options) -> None:
    """The model's tables as Parquet, ``order=1`` and so on, each in folders by ``part``, so that a history is in one."""
    for order, rows in enumerate(count_tables(docs, train, **options), 1):
        rows.write.partitionBy("part").parquet(f"{path}/order={order}")
