"""The surface fold of long sessions, by blocks of rows.

A block is folded without knowing what stands before it.  Its own rows form
pieces: the rows appended at the end, and one for each operation that reaches
beyond what the block knows; within a piece everything is decided at once.  What
is left is a summary: the pieces as stretches of rows, and the operations that
reach further.  Summaries are replayed one after another over a list of stretches
in which each is one entry, however many rows it has; then every block reads off
what became of its stretches.

The result is that of the fold row by row.  A session in which anything is at
fault is folded row by row instead, which says what.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SURFACE_TYPES

#: A reference to an own piece is -1 - its number, to an earlier row its number.
Ref = int


class Fault(Exception):
    """Something that the fold row by row will name."""


@dataclass
class Piece:
    runs: list[tuple[int, int]] = field(default_factory=list)
    #: The last row that changed the piece.
    touched: int = -1


class Block:
    """One block's rows, folded as far as the block knows."""

    def __init__(self, first: int) -> None:
        self.first = self.next = first
        self.ops: list[tuple[int, Ref, Ref]] = []  # the row, and where its range starts and ends
        self.islands: list[list[int]] = [[0]]  # pieces side by side; the first island stands at the end
        self.island_of = [0]
        self.replaced_by: dict[int, int] = {}
        self.rank: dict[int, int] = {}  # place among the block's surface rows
        # A piece's rows in a ring around -1 - its number.
        self._after, self._before = {-1: -1}, {-1: -1}
        self._taken: dict[int, list[int]] = {}  # the rows of pieces that an operation took off others
        self._touched = [first - 1]

    def _piece(self, island: int, rows: list[int], touched: int) -> int:
        number = len(self.island_of)
        self.island_of.append(island)
        self._touched.append(touched)
        ring = -1 - number
        self._after[ring] = self._before[ring] = ring
        for row in rows:
            self._put(row, ring)
        return number

    def _put(self, row: int, ring: int) -> None:
        last = self._before[ring]
        self._after[last], self._before[row], self._after[row], self._before[ring] = row, last, ring, row

    def _cut(self, rows: list[int]) -> None:
        """Take neighbouring rows out of their ring."""
        a, b = self._before[rows[0]], self._after[rows[-1]]
        self._after[a], self._before[b] = b, a
        for row in rows:
            del self._after[row], self._before[row]

    def _walk(self, row: int, links: dict[int, int], stop: int | None) -> list[int]:
        out = [row]
        while out[-1] != stop and links[out[-1]] >= 0:
            out.append(links[out[-1]])
        return out

    def apply(self, seq: int, kind: str, op: str | None, start: int | None, end: int | None, sources: list[int] | None) -> None:
        if seq != self.next:
            raise Fault
        self.next += 1
        if kind not in SURFACE_TYPES:
            if op is not None:
                raise Fault
            return
        cited = set(sources or ())
        if len(cited) < len(sources or ()) or any(not 0 <= s < seq for s in cited):
            raise Fault
        self.rank[seq] = len(self.rank)
        if op == "append":
            last = self.islands[0][-1]
            self._put(seq, -1 - last)
            self._touched[last] = seq
        elif op == "replace":
            self._replace(seq, start, end, cited)
        else:
            raise Fault

    def _replace(self, seq: int, start: int | None, end: int | None, cited: set[int]) -> None:
        if start is None or end is None or start < 0 or end < 0 or any(x >= self.first and x not in self._after for x in (start, end)):
            raise Fault
        ahead = self._walk(start, self._after, end) if start >= self.first else []
        if ahead and ahead[-1] == end:
            if not cited.issuperset(ahead):
                raise Fault
            before, ring = self._before[start], self._after[end]
            self._cut(ahead)
            self._after[before], self._before[seq], self._after[seq], self._before[ring] = seq, before, ring, seq
            self.replaced_by.update(dict.fromkeys(ahead, seq))
            while ring >= 0:  # the piece's number stands at its end
                ring = self._after[ring]
            self._touched[-1 - ring] = seq
            return
        back = self._walk(end, self._before, None)[::-1] if end >= self.first else []
        if set(ahead) & set(back):
            raise Fault
        refs = [start, end]
        for side, rows in enumerate((ahead, back)):
            if rows:
                ring = self._after[rows[-1]] if side == 0 else self._before[rows[0]]
                self._cut(rows)
                piece = -1 - ring
                island = self.islands[self.island_of[piece]]
                number = self._piece(self.island_of[piece], [], self._touched[piece])
                self._taken[number] = rows
                island.insert(island.index(piece) + (side == 0), number)
                refs[side] = -1 - number
                if side == 0 and island is self.islands[0] and island[-1] == number:
                    # Rows appended from now on stand behind the piece that was taken.
                    island.append(self._piece(0, [], seq))
        self.ops.append((seq, *refs))
        self.islands.append([])
        self.islands[-1].append(self._piece(len(self.islands) - 1, [seq], seq))

    def rows_of(self, piece: int) -> list[int]:
        if piece in self._taken:
            return self._taken[piece]
        ring = -1 - piece
        return self._walk(self._after[ring], self._after, None) if self._after[ring] >= 0 else []

    def pieces(self) -> list[Piece]:
        """Each piece's rows as runs of neighbours among the block's surface rows."""
        out = []
        for number, touched in enumerate(self._touched):
            piece = Piece(touched=touched)
            for row in self.rows_of(number):
                if piece.runs and self.rank[row] == self.rank[piece.runs[-1][1]] + 1:
                    piece.runs[-1] = (piece.runs[-1][0], row)
                else:
                    piece.runs.append((row, row))
            out.append(piece)
        return out


@dataclass
class Summary:
    first: int
    rows: int
    pieces: list[Piece]
    islands: list[list[int]]
    ops: list[tuple[int, Ref, Ref]]


class Stretches:
    """The surface as a list of stretches of rows, which summaries change one after another."""

    def __init__(self) -> None:
        self.low, self.high = [], []  # of each stretch; they never grow
        self.gone: list[int | None] = []
        self.touched: list[int] = []
        self.after, self.before = {-1: -1}, {-1: -1}
        self._lows: list[int] = []
        self._at: dict[int, int] = {}
        self.named: list[int] = []  # rows that operations of later blocks name
        self.next = 0

    def _add(self, low: int, high: int, touched: int, before: int) -> int:
        number = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.gone.append(None)
        self.touched.append(touched)
        self._at[low] = number
        bisect.insort(self._lows, low)
        after = self.after[before]
        self.after[before] = self.before[after] = number
        self.before[number], self.after[number] = before, after
        return number

    def _holding(self, row: int) -> int:
        k = bisect.bisect_right(self._lows, row) - 1
        number = self._at[self._lows[k]] if k >= 0 else -1
        if number < 0 or self.high[number] < row or self.gone[number] is not None:
            raise Fault
        self.named.append(row)
        return number

    def _from(self, row: int) -> int:
        """The stretch that begins with a row, which may have to be split."""
        number = self._holding(row)
        if self.low[number] == row:
            return number
        high, self.high[number] = self.high[number], row - 1
        return self._add(row, high, self.touched[number], number)

    def _to(self, row: int) -> int:
        number = self._holding(row)
        if self.high[number] > row:
            self._add(row + 1, self.high[number], self.touched[number], number)
            self.high[number] = row
        return number

    def apply(self, block: Summary) -> None:
        if block.first != self.next:
            raise Fault
        self.next += block.rows
        ends: dict[int, tuple[int, int]] = {}

        def place(island: list[int], before: int) -> None:
            for number in island:
                for k, (low, high) in enumerate(block.pieces[number].runs):
                    before = self._add(low, high, block.pieces[number].touched, before)
                    ends[number] = (ends[number][0] if k else before, before)

        place(block.islands[0], self.before[-1])
        for island, (seq, start, end) in zip(block.islands[1:], block.ops, strict=True):
            # A named piece is one that this operation took, so its stretches are whole.
            a = ends[-1 - start][0] if start < 0 else self._from(start)
            b = ends[-1 - end][1] if end < 0 else self._to(end)
            if start >= 0 and self.low[a] != start:
                raise Fault
            if self.gone[a] is not None or self.gone[b] is not None:
                raise Fault
            before, number = self.before[a], a
            while True:
                if number == -1 or self.touched[number] >= seq:
                    raise Fault
                self.gone[number] = seq
                if number == b:
                    break
                number = self.after[number]
            after = self.after[b]
            self.after[before], self.before[after] = after, before
            place(island, before)

    def order(self) -> list[int]:
        out, number = [], self.after[-1]
        while number != -1:
            out.append(number)
            number = self.after[number]
        return out


_ROW = ["seq", "type", "op", "start", "end", "source_event_seqs"]
_SUMMARY = "session_id string, block bigint, first bigint, rows bigint, lows array<array<bigint>>, highs array<array<bigint>>, touched array<bigint>, islands array<array<int>>, ops array<array<bigint>>"
_OUTCOME = "session_id string, block bigint, lows array<bigint>, highs array<bigint>, orders array<bigint>, gone array<bigint>, named array<bigint>, fault boolean"
_FOLDED = "session_id string, seq bigint, surface string, stretch bigint, place bigint, replaced_by bigint, fault boolean"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            start = 0
            for key, run in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True)):
                n = sum(1 for _ in run)
                yield key, batch.slice(start, n)
                start += n

    for key, group in itertools.groupby(slices(), key=lambda x: x[0]):
        yield key, (part for _, part in group)


def _replayed(first: int, parts: Iterable[pa.RecordBatch]) -> Block:
    block = Block(first)
    for part in parts:
        for row in part.select(_ROW).to_pylist():
            block.apply(*row.values())
    return block


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64())), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(types)], names=list(names))


def fold_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``session_id, seq, surface, stretch, place, replaced_by, fault`` of every row, in blocks of ``size`` rows.

    ``rows``: ``session_id, seq, type, op, start, end, source_event_seqs``.  A
    session with any ``fault`` must be folded row by row.  A task holds a block, or
    the stretches of one session.
    """
    blocks = rows.withColumn("block", F.floor(F.col("seq") / size).cast("bigint")).select("session_id", "block", *_ROW)
    ordered = blocks.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "seq")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, number), parts in _groups(batches, 2):
            try:
                block = _replayed(number * size, parts)
            except (Fault, TypeError):
                for _ in parts:  # the rest of the block
                    pass
                yield _batch(_SUMMARY, (name, number, -1, 0, [], [], [], [], []))
                continue
            pieces = block.pieces()
            yield _batch(_SUMMARY, (name, number, block.first, block.next - block.first, [[a for a, _ in p.runs] for p in pieces], [[b for _, b in p.runs] for p in pieces], [p.touched for p in pieces], block.islands, [list(o) for o in block.ops]))

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), parts in _groups(batches, 1):
            surface, numbers, fault = Stretches(), [], False
            for part in parts:
                for r in part.to_pylist():
                    numbers.append(r["block"])
                    if not fault:
                        pieces = [Piece(list(zip(a, b, strict=True)), t) for a, b, t in zip(r["lows"], r["highs"], r["touched"], strict=True)]
                        try:
                            surface.apply(Summary(r["first"], r["rows"], pieces, r["islands"], [tuple(o) for o in r["ops"]]))
                        except (Fault, KeyError):
                            fault = True
            if fault:
                yield _batch(_OUTCOME, *((name, n, [], [], [], [], [], True) for n in numbers))
                continue
            place = {s: k for k, s in enumerate(surface.order())}
            of_block: dict[int, list[int]] = {n: [] for n in numbers}
            for s in sorted(range(len(surface.low)), key=surface.low.__getitem__):
                of_block[surface.low[s] // size].append(s)
            named: dict[int, list[int]] = {n: [] for n in numbers}
            for row in surface.named:
                named[row // size].append(row)
            for n, mine in of_block.items():
                yield _batch(_OUTCOME, (name, n, [surface.low[s] for s in mine], [surface.high[s] for s in mine], [place.get(s) for s in mine], [surface.gone[s] for s in mine], named[n], False))

    decided = ordered.mapInArrow(summaries, _SUMMARY).repartition("session_id").sortWithinPartitions("session_id", "block").mapInArrow(outcomes, _OUTCOME)
    both = blocks.select("session_id", "block", F.lit(1).alias("kind"), F.struct(*_ROW).alias("row"), F.lit(None).cast("struct<lows:array<bigint>,highs:array<bigint>,orders:array<bigint>,gone:array<bigint>,named:array<bigint>,fault:boolean>").alias("outcome"))
    told = decided.select("session_id", "block", F.lit(0).alias("kind"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.struct("lows", "highs", "orders", "gone", "named", "fault").alias("outcome"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, number), parts in _groups(batches, 2):
            outcome, block, seqs = None, Block(number * size), []
            for part in parts:
                if outcome is None:
                    outcome, part = part.column("outcome")[0].as_py(), part.slice(1)
                for row in part.column("row").to_pylist():
                    seqs.append(row["seq"])
                    if not outcome["fault"]:
                        block.apply(*row.values())
            if outcome["fault"]:
                yield _batch(_FOLDED, *((name, s, None, None, None, None, True) for s in seqs))
                continue
            state: dict[int, tuple] = {}
            live = {row for piece in range(len(block.island_of)) for row in block.rows_of(piece)}
            fault = any(x not in live for x in outcome["named"])
            own = sorted(live)
            for low, high, order, gone in zip(outcome["lows"], outcome["highs"], outcome["orders"], outcome["gone"], strict=True):
                for k, row in enumerate(own[bisect.bisect_left(own, low) : bisect.bisect_right(own, high)]):
                    state[row] = ("shadowed", None, None, gone) if order is None else ("current", order, k, None)
            state |= {row: ("shadowed", None, None, by) for row, by in block.replaced_by.items()}
            for a in range(0, len(seqs), 10_000):
                yield _batch(_FOLDED, *((name, s, *state.get(s, ("log-only", None, None, None)), fault) for s in seqs[a : a + 10_000]))

    return both.unionByName(told).repartition("session_id", "block").sortWithinPartitions("session_id", "block", "kind", "row.seq").mapInArrow(states, _FOLDED)


def positioned(folded: DataFrame) -> DataFrame:
    """``position`` from the stretch and the place in it: stretches' sizes are added up, not rows."""
    sizes = folded.where("stretch is not null").groupBy("session_id", "stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("session_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return folded.join(base, ["session_id", "stretch"], "left").withColumn("position", F.col("_base") + F.col("place")).drop("_base")


def uncited(folded: DataFrame, rows: DataFrame) -> DataFrame:
    """Sessions in which a row replaces one that it doesn't cite."""
    pairs = folded.where("replaced_by is not null").select("session_id", F.col("replaced_by").alias("by"), "seq")
    cited = rows.where("op = 'replace'").select("session_id", F.col("seq").alias("by"), F.explode("source_event_seqs").alias("seq"))
    return pairs.join(cited, ["session_id", "by", "seq"], "left_anti").select("session_id").distinct()
