"""Text rules that Spark has no expression for, as pandas functions over Arrow batches."""

from __future__ import annotations

import difflib
import html
import json
import re
import sys
import unicodedata
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(r"[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
OPEN, CLOSE = "\ue000", "\ue001"
MAX_DEPTH = 512


def snippet(text: str, most: int, open_mark: str = OPEN, close_mark: str = CLOSE) -> str:
    """At most ``most`` characters around the first marked match, a third of them before it."""
    text = _SPACE.sub(" ", text).strip(" ")
    at = max(text.find(open_mark), 0)
    plain = text.replace(open_mark, "").replace(close_mark, "")
    if len(plain) <= most:
        return plain
    body = max(most - 2, 0)
    start = max(at - body // 3, 0)
    if start == 0:
        return plain[: most - 1] + "…"
    if start + body >= len(plain) or most <= 2:
        return "…" + (plain[-(most - 1) :] if most > 1 else "")
    return "…" + plain[start : start + body] + "…"


def cut_bytes(text: str, most: int) -> str:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends between characters."""
    return text.encode()[:most].decode(errors="ignore")


def keep_bytes(text: str, most: int, mode: str = "head") -> tuple[str, str, int]:
    """Head, tail and the bytes left out; ``mode``: head, tail or both halves."""
    data = text.encode()
    if len(data) <= most:
        return text, "", 0
    for_head = {"head": most, "tail": 0, "both": most - most // 2}[mode]
    head, for_tail = data[:for_head].decode(errors="ignore"), most - for_head
    rest = data[len(data) - for_tail :]
    while rest and (rest[0] & 0xC0) == 0x80:
        rest = rest[1:]
    tail = rest.decode()
    return head, tail, len(data) - len(head.encode()) - len(tail.encode())


def ends(sized: str) -> str:
    """Head and tail of a text within the bytes that its first line names."""
    most, text = sized.split("\n", 1)
    head, tail, _ = keep_bytes(text, int(most), "both")
    return head + tail


#: Marks that search looks through.
_MARKS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))


def fold(text: str) -> list[str]:
    """Search tokens: runs of letters and digits, case folded, without diacritics."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        # A text has few different ones.
        for mark in _MARKS.intersection(text):
            text = text.replace(mark, "")
    return re.findall(r"[^\W_]+", text)


def phrase_spans(tokens: list[str], phrase: list[str]) -> int:
    """How often the phrase occurs, overlapping occurrences counted as one."""
    n, count, at, end = len(phrase), 0, -1, -1
    for _ in range(tokens.count(phrase[0])):
        at = tokens.index(phrase[0], at + 1)
        if tokens[at : at + n] == phrase:
            count += at >= end
            end = at + n
    return count


def fuzzy_score(query: str, name: str) -> int | None:
    """Best score of the query as a subsequence: a character 1, beginnings of words 8 more, neighbours 4, gaps and lead cost 1.

    A word begins at the start of the name and after ``-`` or ``_``.
    """
    query, low = query.lower(), name.lower()
    best: dict[int, int] = {}
    for k, c in enumerate(query):
        found: dict[int, int] = {}
        for i, x in enumerate(low):
            if x != c:
                continue
            own = 9 if i == 0 or low[i - 1] in "-_" else 1
            if k == 0:
                found[i] = own - i
            elif earlier := [s + (4 if j == i - 1 else -(i - 1 - j)) for j, s in best.items() if j < i]:
                found[i] = own + max(earlier)
        best = found
    return max(best.values(), default=0 if not query else None)


def unified_diff(old: str, new: str, context: int = 3) -> str:
    lines = difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=context)
    return "\n".join(x for k, x in enumerate(lines) if k > 1)


def canonical(text: str | None) -> str | None:
    """JSON with keys in order, so equal values are equal strings; null where it isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


def path_segment(text: str) -> str:
    """A name any file system takes, different for different texts: other characters as ~XXXX."""
    units = text.encode("utf-16-be")
    codes = [int.from_bytes(units[k : k + 2]) for k in range(0, len(units), 2)]
    return "".join(chr(c) if c < 128 and (chr(c).isalnum() or chr(c) in "._-") and not (k == 0 and c == 46) else f"~{c:04X}" for k, c in enumerate(codes))


class _Markdown(HTMLParser):
    """The text of a page, with headings, lists, links, code and emphasis kept."""

    SKIP = {"script", "style", "noscript", "template", "svg", "head"}
    BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "table", "tr", "ul", "ol", "blockquote", "pre", "form", "figure"}
    MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.depth = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag not in ("br", "img", "hr", "meta", "link", "input")
        if tag in self.SKIP:
            self.skip += 1
        if self.skip or self.depth > MAX_DEPTH:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCK:
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or self.depth >= MAX_DEPTH:
            return
        if tag in self.MARK:
            self.out.append(self.MARK[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(page: str) -> str:
    """HTML as Markdown; what lies deeper than ``MAX_DEPTH`` elements is plain text."""
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def unescape(text: str) -> str:
    return html.unescape(text)


#: Bytes of a batch that Spark sends to a Python worker, and rows that become Python strings at a time.
BATCH_BYTES, SLICE_ROWS = 4 << 20, 64


def narrow_batches(spark: SparkSession) -> None:
    """Make this session's record batches no larger than ``BATCH_BYTES``, or one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def column(function, kind: str, *args):
    """A function over one text column; nulls stay null.

    A worker holds a batch and its results as Arrow values, and no more than
    ``SLICE_ROWS`` texts as Python strings, so its memory doesn't follow the table.
    """
    narrow_batches(SparkSession.active())
    result = {"string": pa.string(), "int": pa.int32()}[kind]

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        slices = (texts.slice(k, SLICE_ROWS) for k in range(0, len(texts), SLICE_ROWS))
        return pa.concat_arrays([pa.array([], result), *(pa.array([None if x is None else function(x, *args) for x in part.to_pylist()], result) for part in slices)])

    return run


def span_count(text: Column, phrase: str) -> Column:
    """Spans of the phrase in a text.

    Of texts in ASCII a pattern finds the tokens in the JVM; only other texts, in
    which case and diacritics need folding, are sent to Python.  A phrase that
    can overlap itself always is: overlapping places are one span.
    """
    wanted = fold(phrase)

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: 0 if x is None or not wanted else phrase_spans(fold(x), wanted))

    if any(wanted[:k] == wanted[-k:] for k in range(1, len(wanted))) or not wanted:
        return run(text)
    ascii_only = F.octet_length(text) == F.length(text)
    if all(w.isascii() for w in wanted):
        found = F.regexp_count(F.lower(text), F.lit("(?<![a-z0-9])" + "[^a-z0-9]+".join(wanted) + "(?![a-z0-9])"))
    else:
        found = F.lit(0)
    return F.when(ascii_only, found).otherwise(run(F.when(~ascii_only, text)))
