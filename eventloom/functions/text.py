"""Text, time and token functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import SPACE_CLASS

_ESCAPES = r"\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)?|\x1B\[[0-?]*[ -/]*[@-~]|\x1B[@-Z\\^_]"
_CONTROLS = r"[\x00-\x08\x0E-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def collapse(text: Column) -> Column:
    """White space at the ends removed, and elsewhere one space for each run."""
    one = F.regexp_replace(text, SPACE_CLASS + "+", " ")
    return F.regexp_replace(one, "^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def clean_title(text: Column) -> Column:
    """Terminal sequences, control and direction characters removed, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(text, _ESCAPES, ""), _CONTROLS, ""))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, n), " ")


def truncate(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends between characters."""
    data = F.encode(text, "UTF-8")

    def inside(place: int) -> Column:
        return F.hex(F.substring(data, place + 1, 1)).between("80", "BF")

    end = F.lit(max(most - 3, 0))
    for place in range(max(most - 2, 0), most + 1):
        end = F.when(~inside(place), F.lit(place)).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))


def fallback_title(text: Column, words: int, most: int) -> Column:
    """The first words of a cleaned text, within ``most`` bytes."""
    return F.regexp_replace(cut_bytes(first_words(clean_title(text), words), most), f"{SPACE_CLASS}+$", "")


#: What marks a line that was cut; the second ends with the limit and `` chars)``.
LINE_CUT, SHOWN_CUT = " (line truncated)", "... (line truncated to "


def preview(line: Column, most: int) -> Column:
    """A line within ``most`` bytes, marked where it was cut."""
    return F.concat(cut_bytes(line, most), F.when(F.octet_length(line) > most, F.lit(LINE_CUT)).otherwise(F.lit("")))


def shown_line(line: Column, most: int) -> Column:
    """A line of at most ``most`` UTF-16 units; a character that the limit divides is left out."""
    units = F.regexp_replace(line, r"([\x{10000}-\x{10FFFF}])", "$1\x01")
    start = F.replace(F.substring(units, 1, most), F.lit("\x01"), F.lit(""))
    divided = F.substring(units, most + 1, 1) == "\x01"
    start = F.when(divided, F.left(start, F.length(start) - 1)).otherwise(start)
    return F.when(utf16_length(line) > most, F.concat(start, F.lit(f"{SHOWN_CUT}{most} chars)"))).otherwise(line)


#: How image tags of benchmark cases are written.
IMAGE_PREFIX, IMAGE_SEPARATOR, IMAGE_SUFFIX = "swebench/sweb.eval.x86_64.", "_1776_", ":latest"


def image_tag(instance: Column) -> Column:
    """The image of a case; only its first double underscore is replaced."""
    parts = F.split(instance, "__", 2)
    return F.concat(F.lit(IMAGE_PREFIX), F.array_join(parts, IMAGE_SEPARATOR), F.lit(IMAGE_SUFFIX))


def runner(instance: Column) -> Column:
    return F.when(F.startswith(instance, F.lit("django")), "runtests").otherwise("pytest")


def csv_field(text: Column) -> Column:
    """Quoted where it holds a quote, comma or line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def file_name(text: Column, fallback: str = "file") -> Column:
    """Characters that a file name can't hold become ``_``; dots and spaces at the ends go."""
    clean = F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1F]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)


def top_level(path: Column) -> Column:
    """The first segment of a relative path."""
    return F.split_part(F.regexp_replace(path, r"^(\./)+", ""), F.lit("/"), F.lit(1))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def slash_command(text: Column) -> Column:
    """``name`` and ``args`` of a line like "/name args"; null names where it is none."""
    name = F.nullif(F.regexp_extract(text, r"^/([A-Za-z][\w:-]*)(?:\s|$)", 1), F.lit(""))
    return F.struct(name.alias("name"), F.when(name.isNotNull(), strip(F.regexp_extract(text, r"^/\S+([\s\S]*)$", 1))).alias("args"))


def exit_status(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"exit(?:ed with)?(?: code| status)?:? (-?\d+)", 1), F.lit("")).cast("int")


def keywords(words: Column) -> Column:
    """Trimmed, lower-cased, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(strip(w))), lambda w: w != ""))


def fact_title(title: Column) -> Column:
    return F.lower(strip(title))


def workspace_key(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(16))


def id_number(text: Column, prefix: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"^{prefix}-(\\d+)$", 1), F.lit("")).cast("bigint")


def fts_phrase(text: Column) -> Column:
    """One quoted phrase; NUL removed."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def source_label(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, with a line on how many were left out."""
    over = F.length(text) - limit
    return F.when(over > 0, F.concat(F.left(text, F.lit(limit)), F.lit("\n[... "), over.cast("string"), F.lit(" characters omitted]"))).otherwise(text)


def prune_middle(text: Column, head: int, tail: int) -> Column:
    """Head, a mark with the number left out, and tail."""
    n = F.length(text) - head - tail
    return F.when(n > 0, F.concat(F.left(text, F.lit(head)), F.lit("\n[... "), n.cast("string"), F.lit(" characters pruned]\n"), F.right(text, F.lit(tail)))).otherwise(text)


def prune_blocks(blocks: Column, head: int, tail: int) -> Column:
    """The texts of blocks, of which together only head and tail stay; the mark stands where the gap begins.

    Each block keeps what lies in the first ``head`` or the last ``tail``
    characters of all of them; blocks that keep nothing are left out.
    """
    sizes = F.transform(blocks, F.length)
    total = F.aggregate(sizes, F.lit(0), lambda n, x: n + x)
    gone = total - head - tail

    def kept(text, k):
        start = F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda n, x: n + x)
        n = F.length(text)
        before, after = F.least(F.greatest(head - start, F.lit(0)), n), F.least(F.greatest(start + n - (total - tail), F.lit(0)), n)
        mark = F.when((start <= head) & (head < start + n), F.concat(F.lit("\n[... "), gone.cast("string"), F.lit(" characters pruned]\n"))).otherwise(F.lit(""))
        return F.concat(F.left(text, before), mark, F.right(text, after))

    return F.when(gone > 0, F.filter(F.transform(blocks, kept), lambda t: t != "")).otherwise(blocks)


def media_type(header: Column) -> Column:
    return F.lower(strip(F.split_part(header, F.lit(";"), F.lit(1))))


def charset(header: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(header, r'(?i)charset\s*=\s*"?([\w.:-]+)', 1), F.lit("")))


def session_uri(session_id: Column) -> Column:
    return F.concat(F.lit("session://"), F.replace(F.url_encode(session_id), F.lit("+"), F.lit("%20")))


def session_of_uri(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit("session://")), F.url_decode(F.substring(uri, 11, 1 << 30)))


def mentions(text: Column) -> Column:
    """The sessions that a text mentions, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(session://[A-Za-z0-9%._~-]+)"), F.lit(1)), session_of_uri))


def tag_safe(json: Column) -> Column:
    """JSON that can stand inside a tag."""
    return F.replace(F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def without_ansi(line: Column) -> Column:
    return F.regexp_replace(line, _ESCAPES, "")


def relative_time(then: Column, now: Column) -> Column:
    """``now``, then minutes, hours, days, months of 30 days and years of 365."""
    s = F.floor((now - then) / 1000)
    parts = F.when(s < 60, F.lit("now"))
    for limit, size, unit in ((3600, 60, "m"), (86400, 3600, "h"), (30 * 86400, 86400, "d"), (365 * 86400, 30 * 86400, "mo")):
        parts = parts.when(s < limit, F.concat(F.floor(s / size).cast("string"), F.lit(unit)))
    return parts.otherwise(F.concat(F.floor(s / (365 * 86400)).cast("string"), F.lit("y")))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _decimal(tenths: Column) -> Column:
    """Tenths as a number, without a zero after the point."""
    return F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))))


def duration(ms: Column) -> Column:
    """``0.9s``, ``45s`` or, from a minute on, ``2m5s``."""
    seconds = round_half_up(ms / 1000)
    return F.when(ms < 60_000, F.concat(_decimal(round_half_up(ms / 100)), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s")))


def token_count(n: Column) -> Column:
    """``517``, ``12.2K``, ``517K`` or ``1.2M``."""

    def scaled(unit: int) -> Column:
        return F.when(n >= 100 * unit, round_half_up(n / unit).cast("string")).otherwise(_decimal(round_half_up(n * 10 / unit)))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(scaled(1000), F.lit("K"))).otherwise(F.concat(scaled(1_000_000), F.lit("M")))


def last_occurrence(anchor: Column, interval: Column, now: Column) -> Column:
    """The latest time of a fixed-rate schedule that isn't after ``now``; null before its first."""
    return F.when(now >= anchor, anchor + F.floor((now - anchor) / interval) * interval)


def next_occurrence(anchor: Column, interval: Column, now: Column) -> Column:
    return F.when(now < anchor, anchor).otherwise(anchor + (F.floor((now - anchor) / interval) + 1) * interval)


def local_instant(local: Column, zone: Column) -> Column:
    """A local date and time in its zone; null where the clocks skipped it."""
    instant = F.to_utc_timestamp(local.cast("timestamp_ntz"), zone)
    return F.when(F.from_utc_timestamp(instant, zone) == local, instant)


def backoff(attempt: Column, first: float = 500.0, most: float = 10_000.0) -> Column:
    return F.least(first * F.pow(F.lit(2.0), attempt), F.lit(most))


def jittered(delay: Column, chance: Column, ratio: float = 0.1) -> Column:
    """The delay times a number around one; ``chance`` from 0 to 1 says where in the range."""
    return delay * (1 + ratio * (2 * chance - 1))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def text_tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-16 length, and four for the block."""
    return F.ceil(utf16_length(text) / 4) + 4


def call_tokens(name: Column, arguments: Column) -> Column:
    return F.ceil((utf16_length(name) + utf16_length(arguments)) / 4) + 4


def message_tokens(block_tokens: Column) -> Column:
    """Of an array of the blocks' tokens."""
    return F.aggregate(block_tokens, F.lit(0).cast("bigint"), lambda a, b: a + b) + 4


def normal_system(system: Column) -> Column:
    return F.nullif(system, F.lit(""))


def retained(count: Column, limit: int) -> Column:
    """Of ``count`` items: seen, kept, omitted, and whether any was left out."""
    kept = F.least(count, F.lit(limit).cast("bigint"))
    return F.struct(count.alias("seen"), kept.alias("kept"), (count - kept).alias("omitted"), (count > kept).alias("truncated"))
