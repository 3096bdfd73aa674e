"""Lineage: parents, descendants, replacement chains and rollups, by joins in rounds.

Where every row has one link at most, links are doubled: after k rounds a row
knows what lies 2^k links ahead, so a line of d links takes log d rounds.  Rows
that still have a link after as many steps as there are rows are on a cycle.
Other walks take a round a level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, written to the cluster's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ancestor_pairs(sessions: DataFrame, id_col: str = "id", parent_col: str = "parent", max_depth: int | None = None) -> DataFrame:
    """``node, ancestor, depth`` for every ancestor that the table holds.

    Ids are unique.  Walks stop at a parent that isn't there.  A cycle raises an
    error: its members would come back to themselves.
    """
    links = sessions.select(F.col(id_col).alias("child"), F.col(parent_col).alias("up")).where("up is not null")
    there = sessions.select(F.col(id_col).alias("up"))
    links = _kept(links.join(there, "up", "left_semi").select("child", "up"))
    step = links.select(F.col("child").alias("node"), F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    total, depth = step, 1
    while max_depth is None or depth < max_depth:
        looped = F.when(F.col("up") == F.col("node"), F.raise_error("the sessions form a cycle")).otherwise(F.col("up"))
        step = _kept(step.join(links.withColumnRenamed("child", "ancestor"), "ancestor").select("node", looped.alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        if step.isEmpty():
            break
        total, depth = total.unionByName(step), depth + 1
    return total


def _linked(rows: DataFrame) -> DataFrame:
    """``rows`` (``id, parent, ...``) with ``jump``: the parent, where the table has it."""
    there = rows.select(F.col("id").alias("parent"), F.col("id").alias("jump"))
    above = rows.where("parent is not null").join(there, "parent", "left")
    return above.unionByName(rows.where("parent is null").withColumn("jump", F.lit(None).cast(rows.schema["id"].dataType)))


def _doubling(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """``state`` (with ``jump``) after rounds of ``step``, until no row has a jump or they reach over ``most`` links.

    A jump over more links than there are rows is on a cycle: an error without ``most``.
    """
    state, reach = _kept(state), 1
    rows, left = state.agg(F.count(F.lit(1)), F.count("jump")).first()
    while left and (most is None or reach <= most):
        if reach > rows:
            if most is None:
                raise ValueError("the sessions form a cycle")
            break
        state, reach = _kept(step(state)), 2 * reach
        left = state.agg(F.count("jump")).first()[0]
    return state


def ancestors(sessions: DataFrame, target) -> DataFrame:
    """The ancestors of one session, nearest first.

    Links are doubled for all sessions while the found ancestors look further: in
    round k each of them finds the one 2^k links above it.
    """
    kind = sessions.schema["id"].dataType
    found = sessions.where(F.col("id") == F.lit(target).cast(kind)).select(F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    links = _kept(_linked(sessions.select("id", "parent")).where("jump is not null").select("id", "jump"))
    rows, reach = links.count(), 1
    while True:
        further = found.join(links.withColumnRenamed("id", "ancestor"), "ancestor").select(F.col("jump").alias("ancestor"), (F.col("depth") + reach).alias("depth"))
        found, before = _kept(found.unionByName(further)), found
        if found.count() == before.count():
            break
        if reach > rows:
            raise ValueError("the sessions form a cycle")
        links, reach = _kept(links.join(links.select(F.col("id").alias("jump"), F.col("jump").alias("far")), "jump").select("id", F.col("far").alias("jump"))), 2 * reach
    return found.where("depth > 0").orderBy("depth")


def descendants(sessions: DataFrame, target, order: Column | None = None) -> DataFrame:
    """The tree under one session, with depth and a path that sorts it in pre-order.

    Only rows under the target are walked.  Siblings go by creation, then id.
    """
    place = F.struct(F.col("created_at"), F.col("id").cast("string").alias("id")) if order is None else order
    rows = sessions.withColumn("_place", place)
    level = rows.where(F.col("parent") == target).select("id", "parent", F.lit(1).alias("depth"), F.array("_place").alias("path"))
    total = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        looped = F.when(F.col("id") == target, F.raise_error("the sessions form a cycle")).otherwise(F.col("id"))
        level = _kept(rows.join(up, "parent").select(looped.alias("id"), "parent", (F.col("_d") + 1).alias("depth"), F.concat("_p", F.array("_place")).alias("path")))
        total = total.unionByName(level)
    return total


def rollup(sessions: DataFrame, running: Column) -> DataFrame:
    """For each session: how many descendants it has, and how many of them run.

    With sums over all descendants fewer than 2^k links below, those of 2^k and more
    are the sums of the sessions exactly 2^k links below: added up by session, with
    partial sums first, so neither a deep tree nor a session with very many
    children is one task's work.
    """
    own = F.coalesce(running.cast("bigint"), F.lit(0)).alias("own")
    rows = sessions.select("id", "parent", own).withColumns({"descendants": F.lit(1).cast("bigint"), "running": F.col("own")})

    def step(state: DataFrame) -> DataFrame:
        live = state.where("jump is not null")
        sums = live.groupBy(F.col("jump").alias("id")).agg(F.sum("descendants").alias("_d"), F.sum("running").alias("_r"))
        far = live.select(F.col("id").alias("jump"), F.col("jump").alias("_far"))
        moved = live.join(far, "jump", "left").withColumn("jump", F.col("_far")).drop("_far")
        new = moved.unionByName(state.where("jump is null")).join(sums, "id", "left")
        return new.select("id", "own", "jump", (F.col("descendants") + F.coalesce("_d", F.lit(0))).alias("descendants"), (F.col("running") + F.coalesce("_r", F.lit(0))).alias("running"))

    summed = _doubling(_linked(rows).drop("parent"), step)
    return summed.select("id", (F.col("descendants") - 1).alias("descendants"), (F.col("running") - F.col("own")).alias("running"))


def roots(sessions: DataFrame) -> DataFrame:
    """Sessions without a parent in the table."""
    there = sessions.select(F.col("id").alias("parent")).distinct()
    return sessions.join(there, "parent", "left_anti").unionByName(sessions.where("parent is null")).dropDuplicates(["id"])


def replacement_chains(folded: DataFrame) -> DataFrame:
    """``session_id, seq, chain``: the rows that replaced a row, one after another.

    A row's chain so far grows by that of the row it has reached.
    """
    rows = folded.where("replaced_by is not null").select("session_id", F.struct("session_id", "seq").alias("id"), F.struct("session_id", F.col("replaced_by").alias("seq")).alias("jump"), F.array("replaced_by").alias("chain"))

    def step(state: DataFrame) -> DataFrame:
        live = state.where("jump is not null")
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("_far"), F.col("chain").alias("_chain"))
        moved = live.join(far, "jump", "left").select("session_id", "id", F.col("_far").alias("jump"), F.concat("chain", F.coalesce("_chain", F.array().cast("array<bigint>"))).alias("chain"))
        return moved.unionByName(state.where("jump is null"))

    return _doubling(rows, step).select("session_id", "id.seq", "chain")


def derived(log: DataFrame) -> DataFrame:
    """``session_id, seq, derived``: later rows that cite a row as their source."""
    edges = log.select("session_id", F.col("seq").alias("by"), F.explode("source_event_seqs").alias("seq")).where("seq < by")
    return edges.groupBy("session_id", "seq").agg(F.array_sort(F.collect_set("by")).alias("derived"))


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, layer``: one more than the greatest layer of what it depends on.

    ``edges``: ``node, needs``.  A round places all nodes whose needs are placed;
    a round that places none although nodes are left has found a cycle.
    """
    left, edges, done, layer = nodes.select("node"), edges.select("node", "needs"), None, 0
    while not left.isEmpty():
        waiting = edges.join(left.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct()
        ready = _kept(left.join(waiting, "node", "left_anti").select("node"))
        if ready.isEmpty():
            raise ValueError("the dependencies form a cycle")
        placed = ready.select("node", F.lit(layer).alias("layer"))
        done = placed if done is None else done.unionByName(placed)
        left, layer = _kept(left.join(ready, "node", "left_anti")), layer + 1
    return nodes.select("node", F.lit(0).alias("layer")).limit(0) if done is None else done
