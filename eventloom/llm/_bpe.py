"""Rank-synchronous pair merging over ragged arrays of symbols.

The two tokenizers of this subpackage share it.  Sequences lie one after
another in one array; in each round every sequence merges its lowest-ranked
pair, wherever it occurs, at the same time as all the other sequences.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(np.iinfo(np.int32).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairRanks:
    """Rank and product of each pair of symbols, in an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, product: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.rank, self.product = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        todo = np.arange(len(keys))
        slot = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        while len(todo):
            free = todo[self.keys[slot[todo]] == _EMPTY]
            where, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[where], self.rank[where], self.product[where] = keys[put], rank[put], product[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self.last

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; slots of unknown pairs have rank ``NONE``."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        there = self.keys[slot]
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != _EMPTY)]
        return slot


def merge(symbols: np.ndarray, offsets: np.ndarray, pairs: PairRanks, tied: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no sequence has a known pair.

    Returns the surviving symbols and, for each, the position of its first
    symbol in the input.  Products of the rank ``tied`` compete by place, the
    leftmost first: where nothing else is left to merge, the sequence is run
    through once (see :func:`_leftmost_first`).
    """
    place, owner = np.arange(len(symbols)), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    symbols = symbols.astype(np.int32)
    pair, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), NONE, np.int32)
    stale = np.arange(len(symbols))
    done_symbols, done_place = [], []
    while len(symbols):
        rank[stale] = NONE
        stale = stale[stale < len(symbols) - 1]
        stale = stale[owner[stale] == owner[stale + 1]]
        pair[stale] = pairs.find(symbols[stale], symbols[stale + 1])
        rank[stale] = pairs.rank[pair[stale]]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[first, len(owner)])
        best = np.minimum.reduceat(rank, first)
        alive = best != NONE
        if not alive.all():
            gone = ~np.repeat(alive, sizes)
            done_symbols.append(symbols[gone])
            done_place.append(place[gone])
            here = ~gone
            symbols, place, owner, rank, pair = symbols[here], place[here], owner[here], rank[here], pair[here]
            best, sizes = best[alive], sizes[alive]
        if tied >= 0 and (best == tied).any():
            last = np.repeat(best == tied, sizes)
            merged, at = _leftmost_first(symbols[last], place[last], owner[last], pairs)
            done_symbols.append(merged)
            done_place.append(at)
            here = ~last
            symbols, place, owner, rank, pair = symbols[here], place[here], owner[here], rank[here], pair[here]
            best, sizes = best[best != tied], sizes[best != tied]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        touching = np.r_[False, hit[1:] == hit[:-1] + 1][: len(hit)]
        if touching.any():
            run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(hit))))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = pairs.product[pair[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        changed = np.zeros(len(symbols) + 1, bool)
        at = (np.cumsum(keep) - 1)[hit]
        changed[at] = changed[np.maximum(at - 1, 0)] = True
        symbols, place, owner, rank, pair = symbols[keep], place[keep], owner[keep], rank[keep], pair[keep]
        stale = np.flatnonzero(changed)
    if not done_place:
        return symbols, place[:0]
    all_symbols, all_places = np.concatenate(done_symbols), np.concatenate(done_place)
    order = np.argsort(all_places, kind="stable")
    return all_symbols[order], all_places[order]


def _leftmost_first(symbols: np.ndarray, places: np.ndarray, owners: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge known pairs from the left, in time linear in the symbols.

    What stands before the symbol at hand has no known pair; the symbol joins
    its left neighbour as long as the pair is known.
    """
    known: dict[tuple[int, int], int] = {}
    done: list[int] = []
    at: list[int] = []
    who: list[int] = []
    for symbol, place, owner in zip(symbols.tolist(), places.tolist(), owners.tolist(), strict=True):
        while done and who[-1] == owner:
            both = done[-1], symbol
            if both not in known:
                slot = pairs.find(np.array(both[:1]), np.array(both[1:]))[0]
                known[both] = int(pairs.product[slot]) if pairs.rank[slot] != NONE else -1
            if known[both] < 0:
                break
            symbol, place = known[both], at.pop()
            done.pop()
            who.pop()
        done.append(symbol)
        at.append(place)
        who.append(owner)
    return np.array(done, np.int32), np.array(at, np.int64)


def all_splits(pieces: dict, rank: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, right, rank and product of every pair of pieces that makes a piece."""
    rows = []
    for piece, symbol in pieces.items():
        for cut in range(1, len(piece)):
            a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
            if a is not None and b is not None and piece in rank:
                rows.append((a, b, rank[piece], symbol))
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32)
