"""The event model, and how the test tables stand for it.

A log is a DataFrame with ``session_id, seq, type, time`` and a payload;
``seq`` counts from 0 without holes in each session and ``time`` is in epoch
milliseconds.  A session table has ``id, created_at`` and optional columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import commit_of, put

#: Event types whose rows form the visible conversation.
SURFACE_TYPES = ("user/message", "assistant/message", "tool/result")
SURFACES = ("current", "shadowed", "log-only")
MAX_SAFE_INTEGER = 2**53 - 1

SURFACE_OP = T.StructType([T.StructField("op", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
EVENT = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("time", T.LongType(), False),
        T.StructField("data", T.StringType()),
        T.StructField("source_event_seqs", T.ArrayType(T.LongType())),
        T.StructField("surface_op", SURFACE_OP),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one log a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        F.col("event_type").alias("type"),
        F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("time"),
        "value",
        F.col("props").alias("data"),
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as one log each."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message").alias("type"),
        F.col("turn").alias("time"),
        "role",
        "text",
    )


def store_log(log: DataFrame, path: str, bucket_rows: int = 4_000_000) -> None:
    """The log as Parquet, in folders by the session's bucket, sorted by session and ``seq``.

    There are as many buckets as ``bucket_rows`` make of the log; a commit in the
    folder says how many.  Rows go by ranges of bucket, session and ``seq``, so a
    long session is in many files.  Sorted files have narrow ranges of sessions, so a
    filter on ``session_id`` and ``seq`` skips most row groups.
    """
    buckets = max(1, -(-log.count() // bucket_rows))
    rows = log.withColumn("bucket", bucket_of(F.col("session_id"), buckets))
    keys = ["bucket", "session_id", "seq"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("bucket").parquet(path)
    put(log.sparkSession, path, 0, {"buckets": buckets})


def bucket_of(session_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session_id.cast("string")), F.lit(buckets)).cast("int")


def stored_session(spark: SparkSession, path: str, session_id) -> DataFrame:
    """One session of a stored log: its bucket's folder, and filters that reach the scan."""
    rows = spark.read.parquet(path)
    kind = rows.schema["session_id"].dataType
    bucket = bucket_of(F.lit(session_id), commit_of(spark, path, 1)["buckets"])
    return rows.where((F.col("bucket") == bucket) & (F.col("session_id") == F.lit(session_id).cast(kind))).drop("bucket")


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as search documents.

    The test documents belong to few sources, of which one may hold a third of
    all rows; a running number over a source would put it into one task, so the
    document's id is its ``seq``, which orders a source as well.
    """
    return table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("time"), F.col("lang").alias("type"), "text")


def conversation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation; its parent is the conversation of half its number."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("id"))
        .agg(F.min("turn").alias("created_at"), F.count(F.lit(1)).alias("events"))
        .withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)))
    )
