"""Small text tables: Markdown tables, memories, CSV, key-value documents, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, csv_field, keywords, strip


def _cells(line: Column) -> Column:
    """Cells of a table's line; ``\\|`` is a bar inside a cell."""
    bare = F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def markdown_tables(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, row, cells`` of the first pipe table of each text; row 0 is the header.

    A line of dashes after the header is left out, short rows are filled with
    empty cells, a row with more cells than the header raises an error.
    """
    lines = texts.select(F.col(id_col).alias("id"), F.split(text_col, r"\r?\n").alias("lines"))
    piped = F.transform("lines", lambda x: F.startswith(strip(x), F.lit("|")))
    first = F.array_position(piped, True).cast("int")
    begin = F.greatest(first, F.lit(1))
    rest = F.slice(piped, begin, F.size("lines"))
    stop = F.array_position(rest, False).cast("int")
    block = F.slice("lines", begin, F.when(stop > 0, stop - 1).otherwise(F.size("lines")))
    rows = lines.where(first > 0).select("id", F.transform(block, _cells).alias("rows"))
    ruled = F.forall(F.col("rows")[1], lambda c: c.rlike(r"^:?-+:?$"))
    rows = rows.withColumn("rows", F.when((F.size("rows") > 1) & ruled, F.concat(F.slice("rows", 1, 1), F.slice("rows", 3, F.size("rows")))).otherwise(F.col("rows")))
    width = F.size(F.col("rows")[0])
    opened = rows.select("id", width.alias("width"), F.posexplode("rows").alias("row", "cells"))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0))))
    return opened.select("id", "row", F.when(F.size("cells") <= F.col("width"), filled).otherwise(F.raise_error("a row has more cells than the header")).alias("cells"))


def csv_lines(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_field), ",")


def write_csv(rows: DataFrame, order: Column, cells: Column, path: str) -> None:
    """CSV with CRLF, quotes only where needed and a byte-order mark, in one file: a small table, in one task."""
    lines = rows.orderBy(order).select(csv_lines(cells).alias("value"), F.row_number().over(_all(order)).alias("n"))
    lines.select(F.when(F.col("n") == 1, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))).coalesce(1).write.option("lineSep", "\r\n").text(path)


def _all(order: Column):
    from pyspark.sql import Window

    return Window.orderBy(order)


def memories(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Records of a Markdown file: a title line ``# ``, lines ``Key: value``, a blank line and a body."""
    parts = texts.select(F.posexplode(F.filter(F.split(text_col, r"(?m)^# "), lambda p: strip(p) != "")).alias("position", "part"))
    field = lambda name: F.nullif(strip(F.regexp_extract("part", f"(?m)^{name}: (.*)$", 1)), F.lit(""))
    outcome = field("Outcome")
    return parts.select(
        field("Id").alias("id"),
        strip(F.regexp_extract("part", r"^(.*)", 1)).alias("title"),
        keywords(F.split(F.coalesce(field("Keywords"), F.lit("")), ",")).alias("keywords"),
        field("Recorded").alias("recorded_at"),
        F.when(outcome.isin("success", "failure", "partial") | outcome.isNull(), outcome).otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), outcome))).alias("outcome"),
        strip(F.regexp_extract("part", r"\n\s*\n([\s\S]*)$", 1)).alias("body"),
        "position",
    )


def memory_records(memories: DataFrame) -> DataFrame:
    """``position, text``: each memory as its part of a Markdown file, which :func:`memories` reads back."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\n{name}: "), value)).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), F.col("title"), line("Id", F.col("id")), line("Keywords", F.array_join("keywords", ", ")), line("Recorded", F.col("recorded_at")), line("Outcome", F.col("outcome")))
    return memories.select("position", F.concat(head, F.lit("\n\n"), "body", F.lit("\n")).alias("text"))


def facts_json(facts: DataFrame, folder: str = "cwd") -> DataFrame:
    """A JSON array of the facts of each folder, by title."""
    return facts.groupBy(folder).agg(F.to_json(F.array_sort(F.collect_list(F.struct("title", "body")))).alias("text"))


def facts(json: DataFrame, text_col: str = "text") -> DataFrame:
    """Facts of a JSON array; titles are compared without case, the last of equal ones holds."""
    rows = json.select(F.posexplode(F.from_json(text_col, "array<struct<title: string, body: string>>")).alias("position", "fact"))
    return rows.groupBy(F.lower(strip(F.col("fact.title"))).alias("title")).agg(F.max_by("fact.body", "position").alias("body"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """``table, key, value`` of documents ``{"tables": {name: {key: value}}}``; values stay JSON."""
    text = spark.read.text(path, wholetext=True)
    tables = text.select(F.explode(F.from_json(F.get_json_object("value", "$.tables"), "map<string, string>")).alias("table", "rows"))
    return tables.select("table", F.explode(F.from_json("rows", "map<string, string>")).alias("key", "value"))


def manifest(spark: SparkSession, path: str, required: tuple[str, ...], id_col: str) -> DataFrame:
    """``id_col``, the required fields and ``case`` (its JSON) of the cases of a JSON array.

    A byte order mark is skipped.  What isn't an array, or a case without one of
    the fields, raises an error; of equal ids the last holds.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    cases = F.from_json(text, "array<string>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.when(cases.isNotNull(), cases).otherwise(F.raise_error("the manifest isn't an array"))).alias("place", "case"))

    def field(name: str) -> Column:
        value = F.get_json_object("case", f"$.{name}")
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(f"a case has no {name}")).alias(name)

    names = list(dict.fromkeys((id_col, *required)))
    found = rows.select("place", "case", *(field(c) for c in names))
    return found.groupBy(id_col).agg(F.max_by(F.struct(*(c for c in names if c != id_col), "case"), "place").alias("_last")).select(id_col, "_last.*")


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """``path, line, text`` of the lines that match, from files ``path, value``."""
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("number", "text")).where(F.col("text").rlike(pattern)).select("path", (F.col("number") + 1).alias("line"), "text")


def glob(spark: SparkSession, path: str, pattern: str, excluded: str = r"/\.(git|hg|svn)/") -> DataFrame:
    """Files by pattern, the newest first; folders of version control are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("modificationTime").alias("changed"), "length").where(~F.col("path").rlike(excluded)).orderBy(F.desc("changed"), "path")


def spaced(text: Column) -> Column:
    return collapse(text)
