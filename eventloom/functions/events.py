"""What an event says: searchable text, prices, references, checked decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SURFACE_TYPES
from .text import call_tokens, strip, text_tokens

_INNER = "type: string, text: string, name: string, arguments: string, id: string"
_BLOCKS = f"array<struct<{_INNER}, content: array<struct<{_INNER}>>>>"
_DATA = (
    f"content {_BLOCKS}, message struct<content: {_BLOCKS}>, name string, arguments string, error struct<name: string, code: string>, "
    "todos array<struct<status: string, content: string>>, reason struct<kind: string, error: struct<message: string>>"
)


def join_text(parts: Column) -> Column:
    """Trimmed parts, without blank ones, on lines of their own."""
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n")


def _parts(block: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(block["type"] == "text", F.array(block["text"])).when(block["type"] == "tool-call", F.array(block["name"], block["arguments"])).otherwise(none)


def content_text(blocks: Column) -> Column:
    """Text and calls of content blocks and of results inside them; reasoning and images say nothing."""
    parts = F.transform(F.coalesce(blocks, F.array().cast(_BLOCKS)), lambda b: F.when(b["type"] == "tool-result", F.array(join_text(F.flatten(F.transform(F.coalesce(b["content"], F.array().cast(f"array<struct<{_INNER}>>")), _parts))))).otherwise(_parts(b)))
    return join_text(F.flatten(parts))


def event_text(kind: Column, data: Column) -> Column:
    """The searchable text of an event; empty where it has none."""
    d = F.from_json(data, _DATA)
    failed = d["reason"]["kind"]
    return F.coalesce(
        F.when(kind == "user/message", content_text(d["content"]))
        .when(kind == "assistant/message", content_text(d["message"]["content"]))
        .when(kind == "tool/call", join_text(F.array(d["name"], d["arguments"])))
        .when(kind == "tool/result", join_text(F.array(content_text(d["message"]["content"]), d["error"]["name"], d["error"]["code"])))
        .when(kind == "todo/write", join_text(F.flatten(F.transform(d["todos"], lambda t: F.array(t["status"], t["content"])))))
        .when((kind == "turn/end") & (failed == "error"), join_text(F.array(F.lit("error"), d["reason"]["error"]["message"])))
        .when((kind == "turn/end") & failed.isin("aborted", "max-tokens", "interrupted"), failed),
        F.lit(""),
    )


def documents(log: DataFrame) -> DataFrame:
    """A search document for each event that says something."""
    return log.withColumn("text", event_text(F.col("type"), F.col("data"))).where("text <> ''")


def on_surface(kind: Column) -> Column:
    return kind.isin(*SURFACE_TYPES)


def message_of(kind: Column, data: Column) -> Column:
    """The JSON of the message that a surface event stands for; null without content."""
    message = F.when(kind == "user/message", data).when(kind.isin("assistant/message", "tool/result"), F.get_json_object(data, "$.message"))
    return F.when(F.coalesce(F.get_json_object(message, "$.content"), F.lit("[]")) != "[]", message)


def block_tokens(blocks: Column) -> Column:
    """Estimated tokens of each block; a result costs its content and four more."""

    def price(b):
        return F.when(b["type"].isin("text", "reasoning"), text_tokens(b["text"])).when(b["type"] == "tool-call", call_tokens(b["name"], b["arguments"])).otherwise(text_tokens(F.to_json(b)))

    def outer(b):
        return F.when(b["type"] == "tool-result", F.aggregate(F.transform(b["content"], price), F.lit(4).cast("bigint"), lambda a, x: a + x)).otherwise(price(b))

    return F.transform(F.from_json(blocks, _BLOCKS), outer)


def text_length(blocks: Column) -> Column:
    """Code points in the text blocks."""
    texts = F.filter(F.from_json(blocks, _BLOCKS), lambda b: b["type"] == "text")
    return F.aggregate(texts, F.lit(0), lambda n, b: n + F.length(b["text"]))


_NAMED = "type: string, ref: string"
_IMAGES = f"array<struct<{_NAMED}, content: array<struct<{_NAMED}, content: array<struct<{_NAMED}>>>>>>"


def image_refs(log: DataFrame) -> DataFrame:
    """``session_id, media_id``: images named in content blocks, results inside them included, each once."""
    d = F.from_json("data", f"content {_IMAGES}, message struct<content: {_IMAGES}>")
    outer = F.coalesce(d["content"], d["message"]["content"])
    level = lambda blocks: F.flatten(F.filter(F.transform(blocks, lambda b: b["content"]), F.isnotnull))
    named = lambda blocks: F.transform(F.filter(F.coalesce(blocks, F.array()), lambda b: (b["type"] == "image") & b["ref"].isNotNull()), lambda b: b["ref"])
    rows = log.select("session_id", outer.alias("a")).where("a is not null").withColumn("b", level(F.col("a"))).withColumn("c", level(F.col("b")))
    return rows.select("session_id", F.explode(F.concat(named(F.col("a")), named(F.col("b")), named(F.col("c")))).alias("media_id")).distinct()


def exact_keys(data: Column, required: list[str], optional: list[str] = []) -> Column:
    """The JSON object if it has the required keys and no unknown ones, else null."""
    keys = F.json_object_keys(data)
    known = F.array(*(F.lit(k) for k in [*required, *optional]))
    need = F.array(*(F.lit(k) for k in required))
    return F.when((F.size(F.array_except(keys, known)) == 0) & (F.size(F.array_except(need, keys)) == 0), data)


def lossless(data: Column) -> Column:
    """Whether a text is JSON and valid UTF-8."""
    return F.is_valid_utf8(data) & F.try_parse_json(data).isNotNull()


def same_header(a: Column, b: Column) -> Column:
    """Headers are equal when system texts and tools are; an empty one is an absent one."""

    def normal(h):
        return F.struct(F.nullif(F.get_json_object(h, "$.system"), F.lit("")).alias("s"), F.nullif(F.get_json_object(h, "$.tools"), F.lit("[]")).alias("t"))

    return normal(a).eqNullSafe(normal(b))
