"""Lineage cuts and connected components on DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there.

    The folder is the one that ``spark.checkpoint.dir`` names; only on one
    machine, as in tests, a temporary one is used where none is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; it becomes the checkpoint folder where none was set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``u, v``); a component is its least node.

    Labels only fall: in each round a node takes the least label around it, then
    the label of its label.  A round costs three joins over edges or nodes, whose
    sides Spark may split where one node has very many edges.  Nothing but one
    number a round comes to the driver.  No edges give no rows; edges with a null
    end are left out; repeated edges and loops change nothing.
    """
    good = cut(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    # Every node goes to its least neighbour, and so do its other lesser ones:
    # where many nodes share the same few hubs, hardly more edges than nodes stay.
    least = good.groupBy("v").agg(F.min("u").alias("m"))
    moved = good.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).distinct()
    good = least.select(F.col("m").alias("u"), "v").unionByName(moved)
    both = cut(good.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(good.select(F.col("v").alias("a"), F.col("u").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")))
    state = _state(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"))
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = cut(lower.join(of_label, "label").select("node", F.col("root").alias("label")))
        before, state = state, _state(labels)
        if state == before:
            return labels.withColumnRenamed("label", "component")


def _state(labels: DataFrame):
    return labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(20,0)"))).first()[0]
