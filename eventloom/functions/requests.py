"""Checks and conversions of requests, before a plan is built."""

from __future__ import annotations

import copy
import math
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, timezone
from typing import Any

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d)")


class TimeError(ValueError):
    """Not a time with a zone, or a range that ends before it starts."""


@dataclass(frozen=True, order=True)
class Instant:
    """Milliseconds, and the decimal digits below one."""

    ms: int
    rest: str

    @property
    def low(self) -> float:
        """The least number that isn't before the instant."""
        return math.nextafter(self.ms, math.inf) if self.rest else self.ms

    @property
    def high(self) -> float:
        """The greatest number that isn't after the instant."""
        return math.nextafter(self.ms + 1, -math.inf) if self.rest else self.ms


def instant(text: str) -> Instant:
    m = _ISO.fullmatch(text)
    if not m:
        raise TimeError(f"not an ISO 8601 time with Z or an offset: {text}")
    year, month, day, hour, minute = map(int, m.groups()[:5])
    fraction, zone = m[7] or "", m[8]
    try:
        offset = UTC if zone == "Z" else timezone((1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])))
        if zone != "Z" and int(zone[4:]) > 59:
            raise ValueError("offset")
        at = datetime(year, month, day, hour, minute, int(m[6] or 0), tzinfo=offset)
    except ValueError as e:
        raise TimeError(f"not a valid time: {text}") from e
    ms = (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
    return Instant(ms + int(fraction[:3].ljust(3, "0")), fraction[3:].rstrip("0"))


def time_range(low: str | None, high: str | None) -> tuple[float | None, float | None]:
    """Bounds for a filter on milliseconds."""
    a, b = low and instant(low), high and instant(high)
    if a and b and b < a:
        raise TimeError("the range ends before it starts")
    return a.low if a else None, b.high if b else None


def wildcard(pattern: str) -> str:
    """A name with ``*`` as an anchored pattern."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


#: Any key of a dictionary or place of a list, in a path.
EACH = object()


def secret_paths(schema: dict | None) -> list[tuple]:
    """Paths of the secret fields of a schema.

    ``schema``: nodes with ``type`` (object, dict, array), ``fields`` or
    ``inner``, and ``secret``.
    """
    out, todo = [], [((), schema or {})]
    for path, node in todo:
        if node.get("secret"):
            out.append(path)
            continue
        inner = {"object": node.get("fields") or {}, "dict": {EACH: node.get("inner")}, "array": {EACH: node.get("inner")}}
        todo += [((*path, name), child) for name, child in inner.get(node.get("type"), {}).items() if child]
    return out


def _children(value: Any, name) -> dict:
    if name is not EACH:
        return {name: value.get(name) if isinstance(value, dict) else None}
    return value if isinstance(value, dict) else {str(k): v for k, v in enumerate(value)} if isinstance(value, list) else {}


def redact(schema: dict | None, value: Any) -> tuple[Any, list[tuple[tuple[str, ...], bool]]]:
    """The value without its secret fields, and where they are and whether they were set.

    A secret element of a list leaves null in its place.
    """
    value, found = copy.deepcopy(value), []
    for pattern in secret_paths(schema):
        places = [((), value, None)]
        for name in pattern:
            places = [((*path, key), child, held) for path, held, _ in places for key, child in _children(held, name).items()]
        for path, secret, owner in places:
            found.append((path, secret is not None))
            if not path:
                value = None
            elif isinstance(owner, list):
                owner[int(path[-1])] = None
            elif isinstance(owner, dict):
                owner.pop(path[-1], None)
    return value, found


def inline(text: str, cap: int, place: str) -> str:
    """Head and tail with a note on where the whole is, within ``cap`` bytes; the text itself if no note fits."""
    from .pandas_text import keep_bytes

    total = len(text.encode())
    if total <= cap:
        return text

    def note(n: int) -> str:
        # A fixed text.
        return f"({n} bytes omitted. Full result stored at: {place})"

    head, tail, omitted = keep_bytes(text, max(0, cap - len(note(total).encode()) - 2), "both")
    out = f"{head}{tail}\n\n{note(omitted)}" if head + tail else note(omitted)
    return out if len(out.encode()) <= cap else text


def collect_pages(fetch, accept, most: int) -> tuple[list, bool]:
    """Accepted rows of page after page, up to ``most``, and whether more were left.

    ``fetch(cursor)`` gives rows and the next cursor.
    """
    out, cursor = [], None
    while True:
        rows, cursor = fetch(cursor)
        for row in rows:
            if accept(row):
                if len(out) == most:
                    return out, True
                out.append(row)
        if cursor is None:
            return out, False
