"""Orders, limits, samples and pages."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pandas_text import fuzzy_score

DEFAULT_PAGE, MAX_PAGE = 20, 100


class CursorError(ValueError):
    """A cursor of another request or of another state of the index."""


def page_size(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_PAGE
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    return limit


def fingerprint(request: dict) -> str:
    """One text for requests that mean the same: lists sorted, keys in order, absent values left out."""

    def normal(value):
        if isinstance(value, dict):
            return {k: normal(v) for k, v in sorted(value.items()) if v is not None}
        if isinstance(value, list | tuple | set):
            return sorted((normal(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
        return value

    return json.dumps(normal(request), sort_keys=True, separators=(",", ":"))


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], request: dict, generation: str, cursor: str | None = None, limit: int | None = None) -> Page:
    """One page by keyset: rows after the cursor's, and a cursor if a further row is there.

    ``keys`` are column names and whether they fall; together they must tell rows
    apart.  At most ``MAX_PAGE + 1`` rows come to the driver.
    """
    n, mark = page_size(limit), fingerprint(request)
    if cursor is not None:
        try:
            held = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise CursorError("not a cursor") from e
        if (held.get("request"), held.get("generation")) != (mark, generation):
            raise CursorError("the cursor is of another request or an older index")
        df = df.where(after(keys, held["last"]))
    rows = df.orderBy(*(F.col(c).desc() if falls else F.col(c).asc() for c, falls in keys)).limit(n + 1).collect()
    more = len(rows) > n
    rows = rows[:n]
    last = {"request": mark, "generation": generation, "last": [rows[-1][c] for c, _ in keys]} if more else None
    return Page(rows, base64.urlsafe_b64encode(json.dumps(last).encode()).decode() if last else None)


def after(keys: Sequence[tuple[str, bool]], last: Sequence) -> Column:
    """Rows that come after ``last`` in the order of ``keys``."""
    test, equal = F.lit(False), F.lit(True)
    for (name, falls), value in zip(keys, last, strict=True):
        column = F.col(name)
        test = test | (equal & (column < F.lit(value) if falls else column > F.lit(value)))
        equal = equal & (column == F.lit(value))
    return test


def by_recency(df: DataFrame, time: str = "updated_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(key))


def by_creation(df: DataFrame) -> DataFrame:
    """Newest first; ids in the order of a dictionary."""
    return df.orderBy(F.desc("created_at"), F.collate("id", "UNICODE"))


def head(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, and how many more it has.

    Spark cuts groups to ``n`` rows before it brings them together; the counts
    are sums with partial results.
    """
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    counts = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("omitted"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(counts, same).drop(*(f"_{k}" for k in keys))


def keyword_top_k(memories: DataFrame, query: Sequence[str], k: int) -> DataFrame:
    """The ``k`` memories that share most keywords, earlier ones first; shown by their numbers."""
    wanted = F.array(*(F.lit(w.strip().lower()) for w in dict.fromkeys(query)))
    scored = memories.withColumn("score", F.size(F.array_intersect("keywords", wanted))).where("score > 0")
    return scored.orderBy(F.desc("score"), F.asc("position")).limit(k).orderBy("position")


def round_robin(df: DataFrame, group: Column, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows dealt out one a group and round, groups by their first row; shown by group.

    Only the first ``n`` rows of each group can be dealt, so a large group is cut
    to them before groups are compared.
    """
    first = Window.partitionBy("_group").orderBy(*order)
    rows = df.withColumn("_group", group).withColumn("_round", F.row_number().over(first)).where(F.col("_round") <= n)
    firsts = rows.where("_round = 1").select(F.col("_group").alias("_g"), F.struct(*order).alias("_first"))
    dealt = rows.join(firsts, F.col("_group") == F.col("_g")).orderBy("_round", "_first").limit(n)
    return dealt.orderBy("_first", "_round").drop("_group", "_g", "_round", "_first")


def stored_order(df: DataFrame, stored: DataFrame, key: str, time: str) -> DataFrame:
    """Rows in their stored order (``key, position``), the others after them by recency."""
    return df.join(stored, key, "left").orderBy(F.col("position").asc_nulls_last(), F.desc(time), key)


def configured(df: DataFrame, names: Sequence[str], key: str, rest: str = "...") -> DataFrame:
    """Rows in the order of ``names``; the others, by name, at the place of ``rest``."""
    if rest not in names:
        raise ValueError("the order has no place for the rest")
    places = F.create_map(*(F.lit(x) for pair in ((n, k) for k, n in enumerate(names)) for x in pair))
    return df.orderBy(F.coalesce(F.try_element_at(places, F.col(key)), F.lit(list(names).index(rest))), key)


def fuzzy_candidates(candidates: DataFrame, name: str, query: str, position: str) -> DataFrame:
    """Candidates whose name holds the query's characters in order, with ``prefix`` and ``score``.

    Names that begin with the query go first, then the higher score, then the
    earlier ``position``; an empty query keeps all, as they came.
    """
    if not query:
        return candidates.withColumns({"prefix": F.lit(True), "score": F.lit(0).cast("bigint")}).orderBy(position)
    score = F.pandas_udf(lambda names: names.map(lambda x: None if x is None else fuzzy_score(query, x)).astype("Int64"), "bigint")
    # Most names lack a character, which the JVM can tell.
    low = F.lower(name)
    able = reduce(lambda a, b: a & b, [F.contains(low, F.lit(c)) for c in set(query.lower())])
    rows = candidates.where(able).withColumns({"prefix": F.startswith(low, F.lit(query.lower())), "score": score(F.col(name))})
    return rows.where("score is not null").orderBy(F.desc("prefix"), F.desc("score"), position)


def move_before(items: Column, item: Column, anchor: Column | None) -> Column:
    """The list with one item before another, or last; both must be in it."""
    rest = F.filter(items, lambda x: x != item)
    if anchor is None:
        moved = F.concat(rest, F.array(item))
    else:
        at = F.array_position(rest, anchor).cast("int")
        moved = F.concat(F.slice(rest, 1, at - 1), F.array(item), F.slice(rest, at, F.size(rest)))
        moved = F.when(at > 0, moved).otherwise(F.raise_error("the anchor isn't in the list"))
    return F.when(F.array_contains(items, item), moved).otherwise(F.raise_error("the item isn't in the list"))


def line_window(text: Column, offset: int, limit: int, max_bytes: int) -> Column:
    """Lines from ``offset`` on, up to ``limit`` of them and to the first that would pass ``max_bytes``."""
    lines = F.slice(F.split(text, "\n"), offset + 1, limit)
    start = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.array().cast("array<string>").alias("lines"), F.lit(True).alias("open"))

    def add(state, line):
        size = state["bytes"] + F.octet_length(line) + 1
        fits = state["open"] & (size <= max_bytes)
        return F.struct(F.when(fits, size).otherwise(state["bytes"]).alias("bytes"), F.when(fits, F.concat(state["lines"], F.array(line))).otherwise(state["lines"]).alias("lines"), fits.alias("open"))

    return F.aggregate(lines, start, add, lambda s: s["lines"])
