"""Names, paths, headers and other short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..schema import conversation_log, session_events, table
from . import query
from .search import _CONV, _LOG

_TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[\\/:*?"<>|\x00-\x1F]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS file, regexp_extract(regexp_replace(url, '[\\/]+$', ''), '[^\\/]*$') AS base,
        string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS top, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS relative FROM pages"""
)
def path_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", x.file_name(url).alias("file"), x.base_name(url).alias("base"), x.top_level(F.regexp_replace(url, "^[a-z]+://", "./")).alias("top"), x.relative_to(url, "https:/").alias("relative"))


@query(
    f"""SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN type END AS name, CASE WHEN seq % 3 = 0 THEN data END AS args, CAST(CASE WHEN seq % 2 = 0 THEN floor(value) ELSE -floor(value) END AS INTEGER) AS status, CASE WHEN seq % 4 > 0 THEN seq END AS number FROM {_LOG}"""
)
def parsed_lines(spark, sf_dir):
    """A command, an exit status and a numbered id, each where a line has one."""
    seq = F.col("seq")
    command = F.concat(F.when(seq % 3 == 0, F.lit("/")).when(seq % 3 == 1, F.lit("")).otherwise(F.lit(" /")), "type", F.lit(" \t"), "data", F.lit("  "))
    code = F.concat(F.lit("process exited with code "), F.when(seq % 2 == 1, F.lit("-")).otherwise(F.lit("")), F.floor("value").cast("string"), F.lit("\n"))
    ident = F.concat(F.when(seq % 4 > 0, F.lit("task-")).otherwise(F.lit("job-")), seq.cast("string"))
    parsed = x.slash_command(command)
    return session_events(spark, sf_dir).select("session_id", "seq", parsed["name"].alias("name"), parsed["args"].alias("args"), x.exit_status(code).alias("status"), x.id_number(ident, "task").alias("number"))


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS u, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), k AS (SELECT doc_id, {_TRIMMED.format('lower(u)')} AS t, min(i) AS i FROM w GROUP BY 1, 2),
        j AS (SELECT doc_id, string_agg(t, '|' ORDER BY i) AS keywords FROM k WHERE t <> '' GROUP BY doc_id)
        SELECT d.doc_id, coalesce(keywords, '') AS keywords, lower({_TRIMMED.format('text')}) AS fact, '"' || replace(text, '"', '""') || '"' AS phrase, left(text, 120) AS title FROM documents d LEFT JOIN j USING (doc_id)"""
)
def normal_phrases(spark, sf_dir):
    """Keywords, fact and quoted phrase of each whole text, and its title of 120 characters."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(x.keywords(F.split(text, " ")), "|").alias("keywords"), x.fact_title(text).alias("fact"), x.fts_phrase(text).alias("phrase"), x.truncate(text, 120).alias("title"))


@query("SELECT doc_id, left(text, 500) || CASE WHEN length(text) > 500 THEN chr(10) || '[... ' || (length(text) - 500) || ' characters omitted]' ELSE '' END AS text FROM documents")
def capped_output(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.capped(F.col("text"), 500).alias("text"))


_LINES = "(SELECT doc_id, CAST(i AS INTEGER) AS number, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"
_UNITS = r"(length({0}) + length(regexp_replace({0}, '[\x{{0}}-\x{{FFFF}}]', '', 'g')))"


@query(
    rf"""SELECT doc_id, number, CASE WHEN strlen(line) <= 60 THEN line ELSE left(line, list_max(list_filter(range(0, 61), lambda n: strlen(left(line, n)) <= 60))) || ' (line truncated)' END AS preview,
        CASE WHEN {_UNITS.format('line')} <= 50 THEN line ELSE left(line, list_max(list_filter(range(0, 51), lambda n: {_UNITS.format('left(line, n)')} <= 50))) || '... (line truncated to 50 chars)' END AS shown FROM {_LINES}"""
)
def line_previews(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return lines.select("doc_id", "number", x.preview(F.col("line"), 60).alias("preview"), x.shown_line(F.col("line"), 50).alias("shown"))


@query("SELECT page_id, 'text/' || CASE page_id % 2 WHEN 0 THEN 'html' ELSE 'plain' END AS media, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' END AS charset FROM pages")
def content_types(spark, sf_dir):
    n = F.col("page_id")
    kind, name = F.when(n % 2 == 0, F.lit(" Text/HTML ")).otherwise(F.lit("text/plain")), F.when(n % 3 == 0, F.lit('; q=1; Charset="UTF-8"')).when(n % 3 == 1, F.lit(";charset = ISO-8859-1")).otherwise(F.lit("; q=1"))
    header = F.concat(kind, name)
    return table(spark, sf_dir, "pages").select("page_id", x.media_type(header).alias("media"), x.charset(header).alias("charset"))


@query(f"SELECT session_id, seq, type || ' ' || session_id || '/' || seq AS back, 'session://' || type || '%20' || session_id || '%2F' || seq AS uri, CASE WHEN seq % 2 = 0 THEN session_id ELSE session_id || ',' || type END AS mentioned FROM {_LOG}")
def session_references(spark, sf_dir):
    """Ids as references and back, and the sessions that a text mentions."""
    ident = F.concat_ws("", "type", F.lit(" "), "session_id", F.lit("/"), F.col("seq").cast("string"))
    again = F.when(F.col("seq") % 2 == 0, F.col("session_id")).otherwise(F.col("type"))
    text = F.concat(F.lit("see "), x.session_uri(F.col("session_id")), F.lit(", then "), x.session_uri(again), F.lit(" and session:/none"))
    return session_events(spark, sf_dir).select("session_id", "seq", x.session_of_uri(x.session_uri(ident)).alias("back"), x.session_uri(ident).alias("uri"), F.array_join(x.mentions(text), ",").alias("mentioned"))


@query(f"SELECT session_id, seq, text AS line FROM {_CONV}")
def plain_lines(spark, sf_dir):
    """Lines dressed in terminal codes, and taken out of them."""
    dressed = F.concat(F.lit("\x1b[31;1m"), "text", F.lit("\x1b[0m\x1b]0;title\x07"))
    return conversation_log(spark, sf_dir).select("session_id", "seq", x.without_ansi(dressed).alias("line"))


@query("SELECT doc_id, 'swebench/sweb.eval.x86_64.' || source || '_1776_' || lang || '__' || doc_id || ':latest' AS image, CASE WHEN doc_id % 3 = 0 THEN 'runtests' ELSE 'pytest' END AS runner FROM documents")
def case_images(spark, sf_dir):
    instance = F.concat_ws("__", "source", "lang", F.col("doc_id").cast("string"))
    named = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("django")).otherwise(F.lit("a-django")), F.lit("__x-1"))
    return table(spark, sf_dir, "documents").select("doc_id", x.image_tag(instance).alias("image"), x.runner(named).alias("runner"))


_TITLE = r"array_to_string(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), ' ')[1:8], ' ')"


@query(f"SELECT doc_id, rtrim(left(title, list_max(list_filter(range(0, 41), lambda n: strlen(left(title, n)) <= 40)))) AS title FROM (SELECT doc_id, {_TITLE} AS title FROM documents)")
def fallback_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", x.fallback_title(F.col("text"), 8, 40).alias("title"))


@query(
    """WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY * (event_id % 366) AS t FROM events)
        SELECT event_id, CASE WHEN t >= TIMESTAMP '2024-03-31 02:00:00' AND t < TIMESTAMP '2024-03-31 03:00:00' THEN NULL WHEN t >= TIMESTAMP '2024-03-31 03:00:00' AND t < TIMESTAMP '2024-10-27 03:00:00' THEN t - INTERVAL 2 HOUR ELSE t - INTERVAL 1 HOUR END AS instant FROM e"""
)
def local_instants(spark, sf_dir):
    """Times of a year as local ones; the clocks skip an hour in spring, and in autumn the first of two equal ones is meant."""
    local = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 366).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", x.local_instant(local, F.lit("Europe/Berlin")).cast("timestamp_ntz").alias("instant"))


@query(
    """WITH b AS (SELECT doc_id, left(text, 300) AS a, substr(text, 301) AS b, length(text) AS n FROM documents)
        SELECT doc_id, CASE WHEN n <= 250 THEN a || '|' || b WHEN n <= 300 THEN left(a, 200) || chr(10) || '[... ' || (n - 250) || ' characters pruned]' || chr(10) || right(a, 50) || ''
            WHEN n < 350 THEN left(a, 200) || chr(10) || '[... ' || (n - 250) || ' characters pruned]' || chr(10) || right(a, 350 - n) || '|' || b
            ELSE left(a, 200) || chr(10) || '[... ' || (n - 250) || ' characters pruned]' || chr(10) || '|' || right(b, 50) END AS text FROM b"""
)
def prune_blocks(spark, sf_dir):
    """A text as two blocks, of which the first 200 and the last 50 characters stay."""
    blocks = F.array(F.left("text", F.lit(300)), F.substring("text", 301, 1 << 30))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(x.prune_blocks(blocks, 200, 50), "|").alias("text"))
