"""Folders that all executors share, and commits that make files in them count.

A versioned folder holds numbered commits.  A commit is one small JSON file that
names other files; it is put only where none of its number is, so of two writers
that start from one revision one fails.  Files that no commit names aren't there.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else has put the commit of this number."""


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only on one machine, where none is set, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder that nobody else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def revision(spark: SparkSession, folder: str) -> int:
    """The number of the last commit, 0 where there is none."""
    where, files = _at(spark, f"{folder}/_commits")
    if not files.exists(where):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return max((int(name.removesuffix(".json")) for name in names if name.endswith(".json")), default=0)


def commit_of(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """What a commit says, the last one by default; empty before the first."""
    number = revision(spark, folder) if number is None else number
    if not number:
        return {}
    where, files = _at(spark, f"{folder}/_commits/{number:012d}.json")
    stream = files.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def put(spark: SparkSession, folder: str, base: int, content: dict) -> int:
    """Put the commit that follows ``base``; raises ``Conflict`` where one is there already.

    The file gets its name when it is whole: by a hard link on a local disk, by a
    rename that doesn't overwrite elsewhere, both of which only one writer can do.
    """
    target, files = _at(spark, f"{folder}/_commits/{base + 1:012d}.json")
    draft, _ = _at(spark, f"{folder}/_commits/.{uuid.uuid4().hex}.tmp")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    try:
        if revision(spark, folder) != base:
            raise Conflict(f"{folder} isn't at revision {base} any more")
        if files.getUri().getScheme() == "file":
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
    except Exception as e:
        if isinstance(e, Conflict) or "AlreadyExists" in str(e):
            raise Conflict(f"{folder} isn't at revision {base} any more") from e
        raise
    finally:
        files.delete(draft, False)
    return base + 1
