import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from eventloom.llm import conversation_repair as r
from eventloom.llm import queries

GRAMMAR = re.compile(r"(s?(ua)+)?")
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]
TEXTS = ["Yes.", "No!", "cut off", "", " \t", "why?", "Ends. \n", "漢字。"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        out.append("b" if blank else "d" if (role, text) in seen else "-" if last in (".", "!", "?") else "t")
        seen.add((role, text))
    return out


def best(rows):
    """The cheapest edits from the last row back, by what has been written so far: no layers, no matrices."""
    marks = faults(rows)
    wants = {"": "ua", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def rest(k, last):
        options = [(0, "", ())] if k == len(rows) and last in ("", "a") else []
        if k < len(rows):
            (role, text), mark = rows[k], marks[k]
            cost, audit, out = rest(k + 1, last)
            options.append((cost + 3, "D" + audit, out))
            if mark not in "bd":
                more = int(mark == "t")
                if role[:1] and (role[:1] in wants[last] or last == "" and role[0] == "s") and not (last == "" and role[0] == "a"):
                    cost, audit, out = rest(k + 1, role[0])
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *out)))
                to = "assistant" if last == "u" else "user"
                cost, audit, out = rest(k + 1, to[0])
                options.append((cost + 2 + more, "R" + audit, (f"{to}:{text}", *out)))
        # An insert may follow an insert; three in a row gain nothing.
        if last == "u":
            options += [(c + 2, "I" + a, ("assistant:", *o)) for c, a, o in rest_after_insert(k, "a")]
        else:
            options += [(c + 2, "I" + a, ("user:", *o)) for c, a, o in rest_after_insert(k, "u")]
        return min(options, key=lambda x: x[:2])

    @functools.cache
    def rest_after_insert(k, last, more=1):
        options = [(0, "", ())] if k == len(rows) and last == "a" else []
        if k < len(rows):
            (role, text), mark = rows[k], marks[k]
            cost, audit, out = rest(k + 1, last)
            options.append((cost + 3, "D" + audit, out))
            if mark not in "bd":
                extra = int(mark == "t")
                if role[:1] and role[:1] in wants[last]:
                    cost, audit, out = rest(k + 1, role[0])
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *out)))
                to = "assistant" if last == "u" else "user"
                cost, audit, out = rest(k + 1, to[0])
                options.append((cost + 2 + extra, "R" + audit, (f"{to}:{text}", *out)))
        if more:
            to = "assistant" if last == "u" else "user"
            options += [(c + 2, "I" + a, (to + ":", *o)) for c, a, o in rest_after_insert(k, to[0], more - 1)]
        return [min(options, key=lambda x: x[:2])] if options else []

    return rest(0, "")


def exhaustive(rows):
    """The least over all strings of edits, tried one by one."""
    marks, found = faults(rows), []
    for letters in itertools.product(*([["", "I", "II"]] + [[e + i for e in "KRD" for i in ("", "I", "II")] for _ in rows])):
        audit, out, cost, k, bad = "".join(letters), [], 0, 0, False
        for e in audit:
            to = "assistant" if out and out[-1][:1] == "u" else "user"
            if e == "I":
                out.append(to + ":")
                cost += 2
                continue
            (role, text), mark = rows[k], marks[k]
            k += 1
            cost += {"K": 0, "R": 2, "D": 3}[e] + (mark == "t" and e != "D")
            bad |= e != "D" and mark in "bd"
            if e != "D":
                bad |= e == "K" and not role
                out.append(f"{role if e == 'K' else to}:{text}")
        if not bad and GRAMMAR.fullmatch("".join(x[0] for x in out)):
            found.append((cost, audit, tuple(out)))
    return min(found, key=lambda x: x[:2])


def test_recursion_against_all_strings():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randrange(4))]
        assert best(tuple(rows)) == exhaustive(rows), rows


def repaired(frame, **options):
    out = defaultdict(list)
    for x in r.repair(frame, **options).collect():
        out[x.conv_id].append(x)
    return {k: sorted(v, key=lambda x: (x.block, x.place)) for k, v in out.items()}


@pytest.mark.parametrize("block_turns", [2, 5, 1024])
def test_against_recursion_in_blocks_of_any_size(spark, block_turns):
    rng = random.Random(3)
    worlds = {k: [(rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"text {rng.random()}.") for _ in range(rng.choice([1, 2, 5, 9, 30]))] for k in range(60)}
    data = [(k, t, role, text, "clash", 1) for k, rows in worlds.items() for t, (role, text) in enumerate(rows)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "conv_id int, turn int, role string, text string, block string, kind int").repartition(5)
    got = repaired(frame, block_turns=block_turns)
    assert got.keys() == worlds.keys()
    for k, rows in worlds.items():
        cost, audit, out = best(tuple(rows))
        assert "".join(x.edit for x in got[k]) == audit and sum(x.cost for x in got[k]) == cost
        assert [f"{x.new_role}:{x.text}" for x in got[k] if x.new_role is not None] == list(out)
        names = {"b": "blank", "d": "duplicate", "t": "truncated", "-": None}
        assert [x.fault for x in got[k] if x.edit != "I"] == [names[f] for f in faults(rows)]
        pairs = [a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(rows)]
        assert [x.illegal for x in got[k] if x.edit != "I"] == [False, *pairs]


def test_nulls_repeated_rows_and_empty(spark):
    schema = "conv_id string, turn bigint, role string, text string"
    data = [(None, 0, "user", "Hi."), (None, 1, None, None), ("a", None, "user", "Hm."), ("a", None, "user", "Hm."), ("a", 3, "assistant", "So."), ("a", 3, "assistant", "So."), ("b", 1, "assistant", "x" * 100_000 + ".")]
    got = repaired(spark.createDataFrame(data, schema))
    assert {k: "".join(x.edit for x in v) for k, v in got.items()} == {None: "KDI", "a": "KDKD", "b": "IK"}
    assert [x.fault for x in got["a"]] == [None, "duplicate", None, "duplicate"] and got[None][1].fault == "blank"
    assert len(got["b"][1].text) == 100_001
    assert r.repair(spark.createDataFrame([], schema)).count() == 0


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(rng.choice(ROLES[:3]), rng.choice(["So.", f"t {k}", f"Text {k}."])) for k in range(3000)]
    frame = spark.createDataFrame([("x", k, *x) for k, x in enumerate(rows)], "conv_id string, turn int, role string, text string").repartition(4)
    a, b = (repaired(frame, block_turns=n)["x"] for n in (64, 100_000))
    assert [x[3:] for x in a] == [x[3:] for x in b]
    assert len({x.block for x in a}) == 47


def test_rows_without_turns_are_split(spark):
    frame = spark.range(500).selectExpr("'x' conv_id", "cast(null as bigint) turn", "'user' role", "concat('Text ', id, '.') text")
    got = repaired(frame)["x"]
    assert len({x.block for x in got}) > 100
    assert "".join(x.edit for x in got) == "KR" * 250 and sum(x.cost for x in got) == 500
    assert GRAMMAR.fullmatch("".join(x.new_role[0] for x in got))


def test_query_against_recursion(spark, tmp_path):
    rng = random.Random(4)
    data = [(k, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant", "user", "assistant", "system", None]), rng.choice([*TEXTS, None, f"Text {k} {t}."])) for k in range(300) for t in range(rng.randrange(1, 9)) if rng.random() < 0.95]
    data = [x for k, x in {(a, b): (a, b, c, d) for a, b, c, d in data}.items()]
    spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in queries.op12_viterbi_repair(spark, str(tmp_path)).collect()}
    worlds = defaultdict(list)
    for conv, turn, role, text in data:
        worlds[conv].append((turn, role or " ", " " if text is None else text))
    assert got.keys() == worlds.keys()
    dropped = 0
    for conv, rows in worlds.items():
        after = []
        for turn, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
            fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
            row = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            after += [row] * {0: 0, 3: 2}.get(fault, 1)
        plain = [x[1:] for x in after]
        marks, turns = faults(plain), [x[0] for x in after if x[0] is not None]
        cost, audit, out = best(tuple(plain))
        x = got[conv]
        dropped += not after
        assert (x.gaps, x.blank, x.duplicate, x.truncated) == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("b"), marks.count("d"), marks.count("t"))
        assert x.illegal == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(plain))
        assert (x.cost, x.audit, x.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    assert dropped
