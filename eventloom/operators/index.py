"""A positional index for phrase search, kept up by revision.

Postings (a word, and its places in each document of a block) lie in folders by
the word's bucket, sorted by word; a search reads the folders of its words only.
Each reconcile indexes the documents of new and changed sessions into a
generation of their own; a commit then names all generations and the table that
says which generation each session's documents are in, so a reader never sees
half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import commit_of, delete, put, revision
from ..functions.pandas_text import fold
from .filters import MAX_PREDICATES, EventFilter, FilterError
from .metrics import best_per_group
from .search import normal_phrase, rank

#: Bytes of text whose postings one bucket holds, about.
BUCKET_BYTES = 256 << 20
#: Bytes of text of the documents that share a posting; a longer text is alone.
BLOCK_BYTES = 4 << 20
#: A posting of so many documents is a frequent word's.
MANY = 256


def postings(documents: DataFrame) -> DataFrame:
    """``session_id, seq, term, positions`` of every different word of every document, places counted in words."""
    return _opened(blocks(documents))


def _opened(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "term", F.explode("documents").alias("d")).select(*keys, "d.session_id", "d.seq", "term", "d.positions")


def blocks(documents: DataFrame) -> DataFrame:
    """``term, documents`` (``session_id, seq, positions``) of every different word of every block of documents.

    A block is neighbours in a task, of about ``BLOCK_BYTES`` of text: a frequent
    word is one row there, not one for each document that has it.
    """
    rows = documents.where("text is not null").select("session_id", "seq", "text")
    kinds = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in ("session_id", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, "right")))
                yield _block(batch.slice(start, stop - start))
                start = stop

    return rows.mapInArrow(run, f"term string, documents array<struct<{kinds}, positions: array<int>>>")


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    counts, words = [], []
    for text in rows.column(2):
        found = fold(text.as_py())
        counts.append(len(found))
        words += found
    coded = pa.array(words, pa.string()).dictionary_encode()
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Documents and places of a word stay in order.
    order = np.argsort(term, kind="stable")
    term, owner, place = term[order], owner[order], place[order]
    new_term = np.r_[True, term[1:] != term[:-1]][: len(term)]
    first = np.flatnonzero(new_term | np.r_[True, owner[1:] != owner[:-1]][: len(term)])
    at = pa.array(owner[first], pa.int64())
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(term)], pa.int32()), pa.array(place, pa.int32()))
    entries = pa.StructArray.from_arrays([rows.column(0).take(at), rows.column(1).take(at), places], names=["session_id", "seq", "positions"])
    edges = np.r_[np.flatnonzero(new_term[first]), len(first)]
    terms = coded.dictionary.take(pa.array(term[first[edges[:-1]]], pa.int64()))
    return pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries)], names=["term", "documents"])


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_generation(documents: DataFrame, folder: str, generation: int, name: str, buckets: int) -> None:
    _write_postings(blocks(documents).withColumn("bucket", _bucket(F.col("term"), buckets)), f"{folder}/postings/{name}/generation={generation}")
    documents.withColumn("length", F.length("text").cast("bigint")).drop("text").write.parquet(f"{folder}/documents/{name}/generation={generation}")


def _write_postings(rows: DataFrame, path: str) -> None:
    # By hash, so that texts are read for their words once; a bucket is several
    # tasks' work, and a word that most documents have is many tasks'.
    some = F.pmod(F.hash("term"), F.lit(4))
    many = 4 + F.pmod(F.hash(F.col("documents")[0]["session_id"], F.col("documents")[0]["seq"]), F.lit(28))
    dealt = rows.withColumn("_part", F.when(F.size("documents") >= MANY, many).otherwise(some)).repartition("bucket", "_part").drop("_part")
    # The second format version packs sorted places as differences.
    dealt.sortWithinPartitions("bucket", "term").write.option("parquet.writer.version", "v2").partitionBy("bucket").parquet(path)


def reconcile(documents: DataFrame, folder: str, sessions: DataFrame) -> int:
    """Bring an index up to ``documents`` and return its revision; the first call makes it.

    ``documents``: ``session_id, seq, time, text`` and what filters look at.
    ``sessions``: ``session_id, revision`` of every session that there is.  Only
    documents of sessions that are new or have another revision are read for their
    words; sessions that are gone go.  Without a change nothing is written.  Of two
    writers one raises ``Conflict`` and leaves nothing.  A session without documents
    is indexed as empty; null texts have no words.
    """
    spark = documents.sparkSession
    base = revision(spark, folder)
    held = commit_of(spark, folder, base)
    generation, name = base + 1, uuid.uuid4().hex
    now = sessions.select("session_id", "revision")
    if held:
        before = spark.read.parquet(f"{folder}/sessions/{held['sessions']}")
        same = before.join(now, ["session_id", "revision"], "left_semi")
        changed = now.join(before, ["session_id", "revision"], "left_anti")
        if changed.isEmpty() and before.join(now, "session_id", "left_anti").isEmpty():
            return base
        buckets, fresh = held["buckets"], documents.join(changed.select("session_id"), "session_id", "left_semi")
        live = same.unionByName(changed.withColumn("generation", F.lit(generation)))
    else:
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets, fresh, live = max(16, -(-size // BUCKET_BYTES)), documents, now.withColumn("generation", F.lit(generation))
    try:
        _write_generation(fresh, folder, generation, name, buckets)
        live.write.parquet(f"{folder}/sessions/{name}")
        return put(spark, folder, base, {"buckets": buckets, "sessions": name, "generations": [*held.get("generations", []), [generation, name]]})
    except BaseException:
        for kind in ("postings", "documents", "sessions"):
            delete(spark, f"{folder}/{kind}/{name}")
        raise


def _generations(spark: SparkSession, folder: str, held: dict, kind: str) -> DataFrame:
    tables = [spark.read.option("basePath", f"{folder}/{kind}/{name}").parquet(f"{folder}/{kind}/{name}/generation={number}") for number, name in held["generations"]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _moved_back(places: str, by: int):
    return F.transform(places, lambda x: x - by)


def matches(spark: SparkSession, folder: str, phrase: str, where: EventFilter = EventFilter(), number: int | None = None) -> DataFrame:
    """Documents with the phrase, with ``spans`` and ``length``: what ``search.matches`` finds by reading all texts.

    Reads the postings of the phrase's words, which meet by document: places,
    moved back by each word's place in the phrase, are intersected.  Places that
    overlap are one span.
    """
    if where.predicates() > MAX_PREDICATES:
        raise FilterError(f"at most {MAX_PREDICATES} predicates")
    wanted = fold(normal_phrase(phrase))
    held = commit_of(spark, folder, number)
    if not held:
        raise FileNotFoundError(f"no index in {folder}")
    terms = sorted(set(wanted))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), held["buckets"])).distinct().collect()] if terms else []
    found = _generations(spark, folder, held, "postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    found, keys = _opened(found, "generation"), ["generation", "session_id", "seq"]
    columns = {t: f"places_{k}" for k, t in enumerate(terms)}
    by_document = found.groupBy(*keys).agg(F.lit(1).alias("_"), *(F.any_value(F.when(F.col("term") == t, F.col("positions")), F.lit(True)).alias(c) for t, c in columns.items()))
    for c in columns.values():
        by_document = by_document.where(F.col(c).isNotNull())
    shifted = [_moved_back(columns[t], k) for k, t in enumerate(wanted)]
    starts = by_document.withColumn("starts", reduce(F.array_intersect, shifted) if shifted else F.array().cast("array<int>"))
    spans = F.size(F.filter("starts", lambda x, i: (i == 0) | (x - F.get("starts", i - 1) >= len(wanted))))
    hits = starts.select(*keys, spans.alias("spans")).where("spans > 0")
    live = spark.read.parquet(f"{folder}/sessions/{held['sessions']}").select("session_id", "generation")
    documents = _generations(spark, folder, held, "documents").where(where.column())
    return documents.join(hits, keys).join(live, ["session_id", "generation"], "left_semi").drop("generation")


def best_sessions(spark: SparkSession, folder: str, phrase: str, where: EventFilter = EventFilter()) -> DataFrame:
    """The strongest row of each session, strongest sessions first."""
    best = best_per_group(matches(spark, folder, phrase, where), "session_id", *rank())
    return best.orderBy(F.desc("spans"), "length", F.desc("time"), "session_id", "seq")


def compact(spark: SparkSession, folder: str) -> int:
    """Make one generation of the live postings, without reading a text; old files are the caller's to delete."""
    base = revision(spark, folder)
    held = commit_of(spark, folder, base)
    live = spark.read.parquet(f"{folder}/sessions/{held['sessions']}")
    generation, name = base + 1, uuid.uuid4().hex
    try:
        opened = _opened(_generations(spark, folder, held, "postings").withColumn("block", F.monotonically_increasing_id()), "generation", "bucket", "block")
        kept = opened.join(live.select("session_id", "generation"), ["session_id", "generation"], "left_semi")
        # What is left of a block's posting is one again.
        packed = kept.groupBy("bucket", "term", "block").agg(F.collect_list(F.struct("session_id", "seq", "positions")).alias("documents")).drop("block")
        _write_postings(packed, f"{folder}/postings/{name}/generation={generation}")
        _generations(spark, folder, held, "documents").join(live.select("session_id", "generation"), ["session_id", "generation"], "left_semi").drop("generation").write.parquet(f"{folder}/documents/{name}/generation={generation}")
        live.withColumn("generation", F.lit(generation)).write.parquet(f"{folder}/sessions/{name}")
        return put(spark, folder, base, held | {"sessions": name, "generations": [[generation, name]]})
    except BaseException:
        for kind in ("postings", "documents", "sessions"):
            delete(spark, f"{folder}/{kind}/{name}")
        raise
