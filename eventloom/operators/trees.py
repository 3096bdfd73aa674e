"""Trees as flat rows: pre-order with depth, call trees, post-order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traces import _doubling, _linked

MAX_DEPTH = 256


def flatten(nodes: DataFrame, order: Column, id_col: str = "id", parent_col: str = "parent", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every node with ``root, depth`` and a ``path`` that sorts rows in pre-order.

    Nodes without a parent in the table are roots, and so are members of cycles and
    what hangs on them, which no root leads to.  Walks stop at ``max_depth``; deeper
    nodes count as roots.  Paths double in each round.
    """
    rows = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.array(F.struct(order, F.col(id_col))).alias("path"))
    start = _linked(rows).select("id", "jump", F.coalesce("jump", "id").alias("root"), F.when(F.col("jump").isNotNull(), 1).otherwise(0).alias("depth"), "path")

    def step(state: DataFrame) -> DataFrame:
        live = state.where("jump is not null")
        up = state.select(F.col("id").alias("jump"), F.col("jump").alias("_far"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        moved = live.join(up, "jump").select("id", F.col("_far").alias("jump"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", "path").alias("path"))
        return moved.unionByName(state.where("jump is null"))

    placed = _doubling(start, step, max_depth)
    lost = F.col("jump").isNotNull() | (F.col("depth") > max_depth)
    flat = placed.select(F.col("id").alias(id_col), F.when(lost, F.col("id")).otherwise(F.col("root")).alias("root"), F.when(lost, 0).otherwise(F.col("depth")).alias("depth"), F.when(lost, F.slice("path", -1, 1)).otherwise(F.col("path")).alias("path"))
    return nodes.join(flat, id_col)


def of_origin(flat: DataFrame, root, origin: str) -> DataFrame:
    """Rows under a root that have an origin, in pre-order; the walk went on through the others."""
    return flat.where((F.col("root") == root) & (F.col("depth") > 0) & (F.col("origin") == origin)).orderBy("path")


def post_order(flat: DataFrame) -> DataFrame:
    """Children before their parents, with ``deeper``: how many nodes of the tree lie deeper, from counts by depth."""
    below = Window.partitionBy("root").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    levels = flat.groupBy("root", "depth").count().select("root", "depth", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("deeper"))
    return flat.join(levels, ["root", "depth"]).orderBy("root", F.desc("depth"), "path")


def call_tree(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Calls under their parent calls (``call_id, parent, seq``), an end (``call_id, outcome``) in place of running."""
    settled = ends.groupBy("call_id").agg(F.min_by("outcome", "seq").alias("outcome"))
    rows = starts.join(settled, "call_id", "full_outer").where("seq is not null").withColumn("state", F.coalesce("outcome", F.lit("running")))
    return flatten(rows, F.col("seq"), "call_id")


def knobs(log: DataFrame, tools: Column, call: Column) -> DataFrame:
    """Each call with the schema of its tool in the header that was in force."""
    from .joins import in_force

    rows = in_force(log, tools, "tools").where(call.isNotNull())
    found = F.filter("tools", lambda t: t["name"] == call)
    return rows.withColumn("schema", F.try_element_at(F.transform(found, lambda t: t["schema"]), F.lit(1)))
