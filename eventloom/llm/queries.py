"""One query for each operator, over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontaminate, importance, katz, minhash_join, perspectives, quality, quality_classifier, substring_dedup, suffix_dedup, token_counts, toxicity
from ._graph import cut
from ._text import narrow_batches


TOXIC_AT = 0.3
GOOD_AT = 0.3


def fold(id_col: str, n: int) -> Column:
    """Remainder of the checksum by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in benchmark passages, and of which items."""
    found = decontaminate.find_benchmark_text(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the 32k piece model."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document and the verdict of the compression bands, measured on labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bands = quality.fit_bands(docs.where(fold("doc_id", 4) != 2), labels)
    return quality.quality(docs, bands=bands).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant's rendering of each conversation, with its targets as ``start:end`` joined by commas."""
    parts = perspectives.render(table(spark, sf_dir, "conversations"))
    spans = F.transform("targets", lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string")))
    chars = F.aggregate("targets", F.lit(0).cast("bigint"), lambda n, t: n + t["end"] - t["start"])
    return parts.select("conv_id", "speaker", "part", "n_messages", F.length("text").cast("bigint").alias("n_chars"), chars.alias("n_target_chars"), "text", F.array_join(spans, ",").alias("targets"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of each document, learnt from the rows that are not held out."""
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    scored = katz.score(table(spark, sf_dir, "documents"), ~held_out, order=3)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(fold("doc_id", 4) != 2), labels)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_AT).cast("int").alias("predicted"))


def _kept(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps after windows of 50 words that an earlier document has."""
    return _kept(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps after passages of 50 words or more that an earlier document has."""
    return _kept(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document under the 50k byte ranks, and what they decode to."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True, keep=["doc_id"])
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document at a similarity of 0.8 on 5-word shingles."""
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, a quarter of the longer ones drawn towards ``benchmark``."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by a checksum of ``conv_id:turn``; nulls are one space."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, the cost and audit string of its repair, and a digest of the repaired rows."""
    conversations = table(spark, sf_dir, "conversations")
    found = conversation_repair.digests(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    # Conversations of which no row is left are there by their ids.
    rows = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    none = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return rows.select("conv_id", *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learnt from all labelled rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    # Statistics are a twentieth of the texts; they are read by the fit and by the scores.
    measured = cut(quality_classifier.measure(table(spark, sf_dir, "documents")))
    model = quality_classifier.fit(measured.where(~held_out), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(measured, model)
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_wu_manber, op2_rank_merge, op3_compression_bands, op4_perspective_rotation, op5_katz_backoff, op6_nnpu, op7_rabin_karp, op8_sparse_suffix_array, op9_byte_bpe, op10_bayes_minhash, op11_importance_resampling, op12_viterbi_repair, op13_fourier_quality)}

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_wu_manber": f"""
        WITH items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
        windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
        docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
        places AS (
            SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
            FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(p)),
        found AS (SELECT doc_id, p, places.n, item FROM places JOIN windows USING (n, words)),
        hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
        owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)""",
    "op4_perspective_rotation": r"""
        WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL),
        speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
        heads AS (
            SELECT conv_id, speaker, turn, role, text, role = speaker AS own,
                   CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user:' || replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') || '|>' || chr(10) END AS head
            FROM turns JOIN speakers USING (conv_id)),
        rows AS (SELECT *, head || text || '<|end|>' || chr(10) AS message FROM heads),
        placed AS (
            SELECT *, coalesce(sum(length(message)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM rows),
        parted AS (SELECT *, CAST(floor(char_start / 32768) AS BIGINT) AS part FROM placed),
        based AS (SELECT *, char_start - min(char_start) OVER (PARTITION BY conv_id, speaker, part) AS place FROM parted)
        SELECT conv_id, speaker, part, count(*) AS n_messages, CAST(sum(length(message)) AS BIGINT) AS n_chars,
               CAST(coalesce(sum(length(message) - length(head)) FILTER (WHERE own), 0) AS BIGINT) AS n_target_chars,
               string_agg(message, '' ORDER BY char_start) AS text,
               coalesce(string_agg(CAST(CAST(place + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(place + length(message) AS BIGINT) AS VARCHAR), ',' ORDER BY char_start) FILTER (WHERE own), '') AS targets
        FROM based GROUP BY conv_id, speaker, part""",
}

_REPEATS = r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS words FROM docs, unnest(range(1, len(w) - 48)) AS t(p) WHERE doc_id IS NOT NULL),
    firsts AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, q FROM windows JOIN firsts USING (words), unnest(range(p, p + 50)) AS t(q) WHERE first < doc_id),
    lists AS (SELECT doc_id, list(q) AS places FROM gone GROUP BY doc_id),
    kept AS (SELECT docs.doc_id, w, coalesce(len(places), 0) AS n, CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS k FROM docs LEFT JOIN lists USING (doc_id))
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""
ORACLE_SQL |= {"op7_rabin_karp": _REPEATS, "op8_sparse_suffix_array": _REPEATS}

ORACLE_SQL["op10_bayes_minhash"] = r"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 10 * k >= 8 * (x.n + y.n - k)),
    reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
    SELECT doc_id, least(doc_id, coalesce((SELECT min(other) FROM reach WHERE reach.doc_id = docs.doc_id), doc_id)) AS class_id,
           (SELECT count(*) FROM links WHERE links.a = docs.doc_id) AS n_links FROM docs"""
