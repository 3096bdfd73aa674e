"""Pages as Markdown, snippets and diffs: text rules with golden cases instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pandas_text as p
from ..operators import ordering as o
from ..schema import conversation_log, table
from . import query


@query()
def html_to_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", p.column(p.markdown, "string")(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS label FROM pages")
def source_label(spark, sf_dir):
    from ..functions.text import source_label as label

    return table(spark, sf_dir, "pages").select("page_id", label(F.lit(" "), F.col("url")).alias("label"))


@query()
def snippets(spark, sf_dir):
    rows = conversation_log(spark, sf_dir)
    marked = F.regexp_replace("text", r"(?i)\bthe\b", p.OPEN + "$0" + p.CLOSE)
    return rows.select("session_id", "seq", p.column(p.snippet, "string", 80)(marked).alias("snippet"))


@query("SELECT doc_id, left(text, list_max(list_filter(range(0, 201), lambda n: strlen(left(text, n)) <= 200))) AS text, strlen(text) > 200 AS cut FROM documents")
def byte_retention(spark, sf_dir):
    from ..functions.text import cut_bytes

    return table(spark, sf_dir, "documents").select("doc_id", cut_bytes(F.col("text"), 200).alias("text"), (F.octet_length("text") > 200).alias("cut"))


@query("SELECT doc_id, position('than' IN lower(text)) > 0 AS found FROM documents WHERE contains(lower(text), 'than')")
def substring_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.contains(F.lower("text"), F.lit("than"))).select("doc_id", F.lit(True).alias("found"))


#: Both places of a query of two characters, 0-based; the first costs its lead, the second its gap.
_EO = """list_max(list_transform(flatten(list_transform(range(0, length(name)), lambda i: list_transform(range(i + 1, length(name)), lambda j: [i, j]))), lambda p:
    CASE WHEN name[p[1] + 1] = 'e' AND name[p[2] + 1] = 'o' THEN 2 - p[1] + CASE WHEN p[1] = 0 OR name[p[1]] = '-' THEN 8 ELSE 0 END + CASE WHEN name[p[2]] = '-' THEN 8 ELSE 0 END + CASE WHEN p[2] = p[1] + 1 THEN 4 ELSE p[1] + 1 - p[2] END END))"""


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), n AS (SELECT word || '-' || reverse(word) AS name FROM w), s AS (SELECT name, {_EO} AS score FROM n)
        SELECT name, starts_with(name, 'eo') AS prefix, CAST(score AS BIGINT) AS score FROM s WHERE score IS NOT NULL"""
)
def fuzzy_ranking(spark, sf_dir):
    """Words of the benchmark, each with itself backwards, by how well a query is a subsequence of them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).distinct()
    return o.fuzzy_candidates(words.select(F.concat_ws("-", "word", F.reverse("word")).alias("name")), "name", "EO", "name").select("name", "prefix", "score")
