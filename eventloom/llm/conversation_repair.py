"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A repaired conversation has the role initials ``(s?(ua)+)?``.  A forward Viterbi
search over four grammar states carries the least (cost, audit string) into each
state, the audit string being the initials of the edits: Keep, Rerole, Delete and
Insert.  After each row the layer is closed with inserts, of which two in a row
are always enough.

Of the same rows, strings of one cost are never proper prefixes of each other (a
longer one costs more), so the least string of a state stays least whatever
follows.  A stretch of rows is therefore a matrix of least (cost, string) from
each state to each, and matrices of consecutive stretches can be joined: long
conversations are cut into blocks of turns, which tasks search apart.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What follows a state on a role's initial.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that a state wants next, where one must be made.
_WANTS = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
#: Turns of one block.
BLOCK_TURNS = 1024
#: Faults as they stand in a block's fault string.
_FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated", "-": None}

Layer = list[tuple[int, str] | None]


def _least(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or b < a else a


def close(layer: Layer) -> Layer:
    """The layer with what inserts reach: a user row, and after it an assistant row."""
    out = list(layer)
    for state in (START, SYSTEM, ASSISTANT):
        if layer[state] is not None:
            cost, audit = layer[state]
            out[USER] = _least(out[USER], (cost + INSERT, audit + "I"))
    if out[USER] is not None:
        cost, audit = out[USER]
        out[ASSISTANT] = _least(out[ASSISTANT], (cost + INSERT, audit + "I"))
    return out


def moves(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, letter)`` of all edits of a row with this role initial and fault."""
    out = [(s, s, DELETE, "D") for s in range(STATES)]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        for s in range(STATES):
            if (s, initial) in _NEXT:
                out.append((s, _NEXT[s, initial], KEEP + more, "K"))
            out.append((s, _NEXT[s, _WANTS[s][0]], REROLE + more, "R"))
    return out


def step(layer: Layer, row: list[tuple[int, int, int, str]]) -> Layer:
    out: Layer = [None] * STATES
    for a, b, cost, letter in row:
        if layer[a] is not None:
            out[b] = _least(out[b], (layer[a][0] + cost, layer[a][1] + letter))
    return close(out)


def matrix(rows: list[tuple[str, str]]) -> list[Layer]:
    """The least (cost, string) from each state to each, over rows of (initial, fault)."""
    known: dict[tuple[str, str], list[tuple[int, int, int, str]]] = {}
    layers: list[Layer] = [[(0, "") if s == k else None for s in range(STATES)] for k in range(STATES)]
    for row in rows:
        if row not in known:
            known[row] = moves(*row)
        layers = [step(layer, known[row]) for layer in layers]
    return layers


@functools.lru_cache(1 << 16)
def _short_matrix(rows: tuple[tuple[str, str], ...]) -> list[Layer]:
    """Short stretches are much alike."""
    return matrix(list(rows))


_SHORT = 16
#: Blocks or conversations of one batch of a result.
_BATCH = 2000


def join(blocks: list[list[Layer]]) -> list[tuple[int, str]]:
    """Of consecutive blocks, the state before each and its part of the cheapest audit string."""
    layer = close([(0, ""), None, None, None])
    lead, came = [x[1] if x else "" for x in layer], []
    for block in blocks:
        after: Layer = [None] * STATES
        source = [START] * STATES
        for a, b in itertools.product(range(STATES), repeat=2):
            if layer[a] is not None and block[a][b] is not None:
                reached = (layer[a][0] + block[a][b][0], layer[a][1] + block[a][b][1])
                if after[b] is None or reached < after[b]:
                    after[b], source[b] = reached, a
        layer = after
        came.append(source)
    state = min((s for s in (START, ASSISTANT) if layer[s] is not None), key=lambda s: layer[s])
    out = []
    for block, source in zip(reversed(blocks), reversed(came), strict=True):
        before = source[state]
        out.append((before, block[before][state][1]))
        state = before
    out.reverse()
    if out:  # inserts before the first row
        out[0] = (START, lead[state] + out[0][1])
    return out


_KEYS = ["id", "block"]
_IN_BLOCK = ["turn", "h", "g"]  # nulls go first


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches with equal first columns."""
    for batch in batches:
        start = 0
        for key, run in itertools.groupby(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True)):
            n = sum(1 for _ in run)
            yield key, batch.slice(start, n)
            start += n


def _batched(rows: Iterator[tuple], schema: T.StructType, id_type: list) -> Iterator[pa.RecordBatch]:
    """Rows as batches; the first column has the type that ``id_type`` holds by then."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names = schema.fieldNames()
    while part := list(itertools.islice(rows, _BATCH)):
        types = [id_type[0], *(kinds[f.dataType.simpleString()] for f in schema.fields[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _of_id(conversation: T.DataType, others: str) -> T.StructType:
    return T.StructType([T.StructField("id", conversation), *T.StructType.fromDDL(others)])


def _summaries(rows: DataFrame) -> DataFrame:
    """A row for each block: its rows' faults, its matrix, and the initials at its ends."""
    # The first row of a text and role: partial minima, so a text that fills a conversation is one row.
    firsts = rows.groupBy("id", "h", "g").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "block")).alias("at"))
    firsts = firsts.select("id", F.col("at.block").alias("block"), F.col("at.turn").alias("turn"), "h", "g", F.lit("").alias("initial"), F.lit("").alias("fault"), F.lit(0).alias("kind"))
    both = firsts.unionByName(rows.select("id", "block", "turn", "h", "g", "initial", "fault", F.lit(1).alias("kind")))
    schema = _of_id(rows.schema["id"].dataType, "block bigint, faults string, costs array<bigint>, audits array<string>, first string, last string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list = []

        def blocks() -> Iterator[tuple]:
            for (name, block), group in itertools.groupby(_runs(batches, 2), key=lambda x: x[0]):
                found: list[tuple[str, str]] = []
                new = None
                for _, part in group:
                    id_type[:] = [part.schema.types[0]]
                    for turn, h, g, initial, fault, kind in zip(*(part.column(k).to_pylist() for k in range(2, 8)), strict=True):
                        if kind == 0:
                            new = (turn, h, g)
                        else:
                            again = new != (turn, h, g)
                            found.append((initial, "b" if fault == "b" else "d" if again else fault))
                            new = None
                layers = _short_matrix(tuple(found)) if len(found) <= _SHORT else matrix(found)
                cells = [x for layer in layers for x in layer]
                yield name, block, "".join(f for _, f in found), [c[0] if c else -1 for c in cells], [c[1] if c else "" for c in cells], found[0][0], found[-1][0]

        yield from _batched(blocks(), schema, id_type)

    # With the flag first of its equals.
    return both.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *_IN_BLOCK, "kind").mapInArrow(run, schema)


def _decisions(summaries: DataFrame) -> DataFrame:
    """A row for each block: its part of the audit string, the state before it, and the initial of the row before."""
    schema = _of_id(summaries.schema["id"].dataType, "block bigint, faults string, audit string, state int, before string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                id_type[:] = [batch.schema.types[0]]
                yield from zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)

        def blocks() -> Iterator[tuple]:
            for name, group in itertools.groupby(rows(), key=lambda x: x[0]):
                parts = list(group)
                matrices = []
                for _, _, _, costs, audits, _, _ in parts:
                    cells = [None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True)]
                    matrices.append([cells[k : k + STATES] for k in range(0, STATES * STATES, STATES)])
                before = None
                for (_, block, faults, _, _, _, last), (state, audit) in zip(parts, join(matrices), strict=True):
                    yield name, block, faults, audit, state, before
                    before = last

        yield from _batched(blocks(), schema, id_type)

    return summaries.repartition("id").sortWithinPartitions(*_KEYS).mapInArrow(run, schema)


def _prepared(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, block_turns: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block and place in it, and what was decided of each block."""
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(7), "text", "role")})
    by_hash = F.lit(-(1 << 62)) + F.shiftright("h", 54)
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns).cast("bigint"), by_hash))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    codes = rows.withColumns({"initial": F.substring("role", 1, 1), "fault": F.when(blank, "b").when(cut_off, "t").otherwise("-")})
    return rows, _decisions(_summaries(codes.drop("role", "text")))


def _together(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Decisions (``kind`` 0) and rows (1) in one table."""

    def part(frame: DataFrame, order: int) -> DataFrame:
        names = {"turn": "bigint", "h": "bigint", "g": "bigint", "role": "string", "text": "string", "faults": "string", "audit": "string", "state": "int", "before": "string"}
        return frame.select("id", "block", F.lit(order).alias("kind"), *(F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()))

    return part(decided, 0).unionByName(part(rows, 1))


def repair(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every row of every conversation with its cheapest edit, and the inserted ones.

    Columns ``id_col``, ``block`` and ``place`` (a conversation's order, by
    both), ``turn``, ``role``, ``text``, ``edit`` (K, R, D or I), ``fault`` (blank,
    duplicate, truncated or null: the first that holds), ``illegal`` (the role's
    initial may not follow that of the row before), ``new_role`` (null where the row
    is deleted) and ``cost``.  A blank row has nothing but space, a duplicate has
    role and text of an earlier row (by 128 bits of hash), a truncated one doesn't
    end in ``.``, ``!`` or ``?``.  Keep costs 0, Rerole 2, Delete 3, Insert 2; blank
    and duplicate rows must go; a truncated row that stays adds 1.  Of the cheapest
    edits those with the least string of initials are taken.

    Rows go by turn, those without one first; rows of one turn by a hash of role and
    text.  A null role or text is one space.  A null id is a conversation like any
    other.  An empty role has no initial and can't be kept.  Repeated rows are
    duplicates of the first.  Extra columns are ignored; an empty table has no rows.

    A block is ``block_turns`` turns; rows without a turn are split by hash.  Blocks
    are tasks' units, whose rows stream through; of a conversation, a task joins
    matrices, which hold some sixteen bytes a row.  Texts are dealt out once.
    """
    rows, decided = _prepared(conversations, id_col, turn_col, role_col, text_col, block_turns)
    both = _together(rows, decided).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind", *_IN_BLOCK)
    schema = T.StructType([T.StructField(id_col, conversations.schema[id_col].dataType), *T.StructType.fromDDL("block bigint, place bigint, turn bigint, role string, text string, edit string, fault string, illegal boolean, new_role string, cost bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None
        for batch in batches:
            source: list[int | None] = []
            owner: list[int] = []
            edits: list[tuple] = []
            for k, (kind, role, *decision) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 6, 8, 9, 10, 11)), strict=True)):
                if kind == 0:
                    walk = _Walk(*decision)
                    continue
                for edit in walk.row(role):
                    source.append(None if edit[1] == "I" else k)
                    owner.append(k)
                    edits.append(edit)
            at, of = pa.array(source, pa.int64()), pa.array(owner, pa.int64())
            place, letter, fault, illegal, to, cost = zip(*edits, strict=True) if edits else [()] * 6
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(place, pa.int64()), batch.column(3).take(at), batch.column(6).take(at), batch.column(7).take(at).fill_null(""), pa.array(letter, pa.string()), pa.array(fault, pa.string()), pa.array(illegal, pa.bool_()), pa.array(to, pa.string()), pa.array(cost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return both.mapInArrow(run, schema)


def digests(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each conversation that has rows: what :func:`repair` finds, counted, and a digest of the result.

    Columns ``id_col``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``gaps``
    (numbers that are missing between the least and the greatest turn), ``cost``,
    ``audit`` and ``repaired_sha256`` (of the repaired rows as ``role:text``, one a
    line).  Blocks are searched apart; a digest is a chain of bytes, so for it a
    conversation's rows stream through one task, which holds two bytes a row.
    """
    rows, decided = _prepared(conversations, id_col, turn_col, role_col, text_col, block_turns)
    schema = _of_id(conversations.schema[id_col].dataType, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list = []

        def read() -> Iterator[tuple]:
            for batch in batches:
                id_type[:] = [batch.schema.types[0]]
                yield from zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 6, 7, 8, 9)), strict=True)

        def conversations_() -> Iterator[tuple]:
            for name, group in itertools.groupby(read(), key=lambda x: x[0]):
                faults, audit, walk, digest, lines = [], [], None, hashlib.sha256(), 0
                counts, illegal, cost, turns, least, last = dict.fromkeys("bdt", 0), 0, 0, 0, None, None
                for _, kind, turn, role, text, *decision in group:
                    if kind == 0:
                        faults.append(decision[0])
                        audit.append(decision[1])
                        continue
                    if walk is None:
                        walk = _Walk("".join(faults), "".join(audit), START, None)
                        counts = {f: walk.faults.count(f) for f in counts}
                    if turn is not None and turn != last:
                        turns, last = turns + 1, turn
                        least = turn if least is None else least
                    for _, letter, _, wrong, to, paid in walk.row(role):
                        illegal += wrong
                        cost += paid
                        if to is not None:
                            digest.update(f"{chr(10) if lines else ''}{to}:{'' if letter == 'I' else text}".encode())
                            lines += 1
                gaps = last - least + 1 - turns if turns else 0
                yield name, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, walk.audit, digest.hexdigest()

        yield from _batched(conversations_(), schema, id_type)

    both = _together(rows, decided).repartition("id").sortWithinPartitions("id", "kind", "block", *_IN_BLOCK)
    return both.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class _Walk:
    """The edits of consecutive rows, as they come."""

    def __init__(self, faults: str, audit: str, state: int, before: str | None) -> None:
        self.faults, self.audit, self.state, self.before = faults, audit, state, before
        self.number = self.at = 0

    def _inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = _WANTS[self.state]
            self.state = _NEXT[self.state, role[0]]
            self.at += 1
            yield self.at - 1, "I", None, False, role, INSERT

    def row(self, role: str) -> list[tuple]:
        """``(place, edit, fault, illegal, new role, cost)`` of the next row, and of the inserted ones around it."""
        out = list(self._inserts()) if self.number == 0 else []
        letter, f = self.audit[self.at], self.faults[self.number]
        wrong = self.before is not None and (self.before + role[:1]) not in ("su", "ua", "au")
        to = None if letter == "D" else role if letter == "K" else _WANTS[self.state]
        if to is not None:
            self.state = _NEXT[self.state, to[0]]
        out.append((self.at, letter, _FAULTS[f], wrong, to, _COST[letter] + (TRUNCATED if f == "t" and letter != "D" else 0)))
        self.before, self.number, self.at = role[:1], self.number + 1, self.at + 1
        out += self._inserts()
        return out
