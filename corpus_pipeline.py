"""A corpus pipeline of five stages, each an operator of ``eventloom.llm``.

Toxic documents go, then all but one of each group of near duplicates, then
passages that an earlier document has, then documents with benchmark passages;
what is left is encoded.  Every stage works on all that the one before it kept.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontaminate, minhash_join, suffix_dedup, toxicity
from eventloom.llm._text import narrow_batches
from eventloom.llm.queries import TOXIC_AT, fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't predict toxic, at the score of ``op6_nnpu``.

    As there, rows whose ``crc32(doc_id) mod 4`` is 2 are never learnt from.
    A document with a null or empty text gets the score of no words and stays.
    Without any toxic label nothing is rejected.
    """
    narrow_batches(spark)
    model = toxicity.fit(docs.where(fold("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("toxicity") < TOXIC_AT).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near duplicates, that of the least id.

    Texts go by id and content, so another text under a removed text's id stays.
    Documents without words and rows with a null id are in no class and stay, all
    of them; of repeated rows with one id and text, one stays.
    """
    narrow_batches(spark)
    found = minhash_join.near_duplicates(docs).where("doc_id is not null")
    gone = found.where("not stays").select("doc_id", F.col("text_hash").alias("_text")).distinct()
    # Both tests go by the same keys, so the texts are dealt out once.
    kept = docs.select(*COLUMNS, F.xxhash64("text").alias("_text")).join(gone, ["doc_id", "_text"], "left_anti")
    in_class = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(in_class).dropDuplicates(["doc_id", "_text"]).unionByName(kept.where(~in_class)).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of 50 words or more that an earlier one has.

    A text that loses no words stays as it is; of others the words that are left
    are joined by a space, and ``n_chars`` is counted anew.
    """
    narrow_batches(spark)
    found = suffix_dedup.remove_repeats(docs, keep=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return found.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark passage; null and empty texts stay."""
    narrow_batches(spark)
    found = decontaminate.find_benchmark_text(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens and the text they decode to (null: no tokens, empty text)."""
    narrow_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True, keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: SQL can't express the classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def workspace(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; a temporary one on one machine where none is set, as in tests."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pipeline-")
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written whole."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written and read again.

    The stages go to a new folder, or to ``folder``: there a run that failed goes
    on after the last stage that was written whole.  Use a folder for one input
    only; the stages in it are the caller's to delete.
    """
    resumed, folder = folder is not None, folder or workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{k}_{name}"
        if k == len(STAGES):
            return stage(spark, docs, sf_dir)
        if not (resumed and _finished(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite" if resumed else "errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return docs
