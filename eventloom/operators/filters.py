"""Conjunctive filters: clauses are joined by AND, the values of one clause by OR.

Requests are checked before a plan is built; unknown kinds and values raise
``FilterError`` rather than match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SURFACES

#: White space of the text rules: Unicode spaces and U+FEFF, without U+0085.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SPACE = re.compile(r"[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")

#: Greatest number of predicates in one search, over sessions and in one session.
MAX_PREDICATES, MAX_PREDICATES_IN_SESSION = 14, 13


class FilterError(ValueError):
    """A request that can't be meant."""


def one_of(column: Column, values: Iterable) -> Column:
    """The value is in the list; None in the list stands for an absent value; an empty list matches nothing."""
    values = list(values)
    given = [v for v in values if v is not None]
    test = column.isin(given) if given else F.lit(False)
    if len(given) < len(values):
        test = column.isNull() | test
    return F.coalesce(test, F.lit(False))


def within(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive bounds, either of which may be absent."""
    for bound in (low, high):
        if bound is not None and (isinstance(bound, bool) or not isinstance(bound, int | float) or not math.isfinite(bound)):
            raise FilterError(f"a bound must be a finite number: {bound!r}")
    if low is not None and high is not None and low > high:
        raise FilterError("the range ends before it starts")
    test = F.lit(True)
    if low is not None:
        test = test & (column >= F.lit(low))
    if high is not None:
        test = test & (column <= F.lit(high))
    return test


def available(live: Column, persisted: Column, wanted: Iterable[str]) -> Column:
    """Sessions that are live or persisted; both kinds restrict nothing, none matches nothing."""
    wanted = set(wanted)
    if unknown := wanted - {"live", "persisted"}:
        raise FilterError(f"unknown availability: {sorted(unknown)}")
    if len(wanted) == 2:
        return F.lit(True)
    return live if wanted == {"live"} else persisted if wanted else F.lit(False)


def literal_text(column: Column, phrase: str) -> Column:
    """A literal, case-insensitive substring in which any white space matches any other."""
    words = [w for w in _SPACE.split(phrase) if w]
    if not words:
        raise FilterError("the text is blank")
    pattern = (SPACE_CLASS + "+").join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return column.rlike("(?iu)" + pattern)


def has_terms(column: Column, query: str) -> Column:
    """Every term of the query is a substring, whatever the case; a blank query restricts nothing."""
    test = F.lit(True)
    for term in (w for w in _SPACE.split(query.lower()) if w):
        test = test & F.contains(F.lower(column), F.lit(term))
    return test


def matches_hook(column: Column, matcher: str | None) -> Column:
    """None, "" and "*" match all; names joined by ``|`` match exactly; anything else is a pattern."""
    if matcher in (None, "", "*"):
        return F.lit(True)
    if re.fullmatch(r"[\w|]+", matcher):
        return column.isin(matcher.split("|"))
    try:
        re.compile(matcher)
    except re.error:
        return F.lit(False)
    return column.rlike(matcher)


def overlaps(start: Column, end: Column, low: float, high: float) -> Column:
    """The span shares a moment with ``[low, high]``."""
    return (start <= F.lit(high)) & (end >= F.lit(low))


@dataclass(frozen=True)
class EventFilter:
    """What an event search may ask for; absent clauses restrict nothing."""

    types: Sequence[str] | None = None
    surfaces: Sequence[str] | None = None
    seq: tuple[float | None, float | None] | None = None
    time: tuple[float | None, float | None] | None = None
    text: str | None = None

    def column(self) -> Column:
        if self.surfaces is not None and (unknown := set(self.surfaces) - set(SURFACES)):
            raise FilterError(f"unknown surface: {sorted(unknown)}")
        tests = [F.lit(True)]
        if self.types is not None:
            tests.append(one_of(F.col("type"), self.types))
        if self.surfaces is not None:
            tests.append(one_of(F.col("surface"), self.surfaces))
        if self.seq is not None:
            tests.append(within(F.col("seq"), *self.seq))
        if self.time is not None:
            tests.append(within(F.col("time"), *self.time))
        if self.text is not None:
            tests.append(literal_text(F.col("text"), self.text))
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def predicates(self) -> int:
        return sum(x is not None for x in (self.types, self.surfaces, self.text)) + sum(b is not None for r in (self.seq, self.time) for b in (r or ()))
