"""Usage, latency and timeline metrics of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("input", "output", "cache_read", "cache_write")


def usage_totals(samples: DataFrame) -> DataFrame:
    """Token totals of each session from samples (``session_id, seq, turn, step`` and the buckets).

    A sample of the turn and step just before it replaces that one; coming back
    to an older step adds again.  A missing bucket counts as none.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    following = F.lead(F.struct("turn", "step")).over(order)
    last = samples.withColumn("_last", ~F.coalesce(following.eqNullSafe(F.struct("turn", "step")), F.lit(False)))
    return last.where("_last").groupBy("session_id").agg(*(F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in BUCKETS))


def context_pressure(samples: DataFrame) -> DataFrame:
    """The newest input with cache of each session, and the newest window size."""
    used = F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    return samples.groupBy("session_id").agg(F.max_by(used, "seq").alias("pressure"), F.max_by("window", "seq").alias("window"))


def projected_pressure(samples: DataFrame, surface: DataFrame) -> DataFrame:
    """The newest pressure with what the surface has gained since, never below nothing.

    ``surface``: ``session_id, seq, delta``.  A sample's own row is part of what
    it measured only through rows before it.
    """
    base = context_pressure(samples).join(samples.groupBy("session_id").agg(F.max("seq").alias("at")), "session_id")
    grown = surface.join(base.select("session_id", "at"), "session_id").groupBy("session_id").agg(F.sum(F.when(F.col("seq") >= F.col("at"), F.col("delta"))).alias("grown"))
    return base.join(grown, "session_id", "left").select("session_id", "pressure", "window", F.greatest(F.lit(0), F.col("pressure") + F.coalesce("grown", F.lit(0))).alias("projected"))


def breakdown(headers: DataFrame, surface: DataFrame) -> DataFrame:
    """Tokens of the newest system text and tools (``system, tools``) and of all messages (``delta``)."""
    newest = headers.groupBy("session_id").agg(F.max_by("system", "seq").alias("system"), F.max_by("tools", "seq").alias("tools"))
    return surface.groupBy("session_id").agg(F.sum("delta").alias("messages")).join(newest, "session_id", "full_outer").fillna(0)


def surface_tokens(folded: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens of the rows that are current after the fold."""
    return folded.where("surface = 'current'").join(prices, ["session_id", "seq"]).groupBy("session_id").agg(F.sum("tokens").alias("tokens"))


def by_workspace(sessions: DataFrame, current=None) -> DataFrame:
    """Sessions of each folder: how many, and whether the current one is among them."""
    return sessions.groupBy("cwd").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("id") == F.lit(current)), F.lit(False)).alias("has_current"))


def greatest_number(ids: Column) -> Column:
    """The greatest n of ids "memory-n", 0 without one."""
    return F.coalesce(F.max(F.regexp_extract(ids, r"^memory-(\d+)$", 1).try_cast("bigint")), F.lit(0))


def token_deltas(surface: DataFrame) -> DataFrame:
    """The change of a session's tokens at each surface row: what is added, less what it replaces."""
    return surface.withColumn("delta", F.col("tokens") - F.coalesce("replaced_tokens", F.lit(0)))


def first_tokens(chunks: DataFrame) -> DataFrame:
    """Time of the first chunk with text of each turn and step."""
    return chunks.where("text <> ''").groupBy("session_id", "turn", "step").agg(F.min_by("time", "seq").alias("first_token"))


def step_timing(starts: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Start, first token and end of each step that has a message; a chunk may come before the start."""
    keys = ["session_id", "turn", "step"]
    started = starts.groupBy(*keys).agg(F.max_by("time", "seq").alias("start"))
    ended = messages.groupBy(*keys).agg(F.min_by(F.struct("time", "output"), "seq").alias("m"))
    rows = ended.join(started, keys, "left").join(first_tokens(chunks), keys, "left")
    return rows.select(*keys, "start", "first_token", F.col("m.time").alias("end"), F.col("m.output").alias("output"))


def _span(a: Column, b: Column) -> Column:
    return F.greatest(b - a, F.lit(0))


def session_stats(steps: DataFrame, tools: DataFrame, ends: DataFrame) -> DataFrame:
    """Totals of each session of well-formed logs.

    ``steps``: from :func:`step_timing`; ``tools``: from ``joins.paired_calls``;
    ``ends``: ``session_id, seq, turn`` of step ends.  ``turns`` counts changes
    of turn from one step end to the next, the first included.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    changes = ends.withColumn("_new", ~F.col("turn").eqNullSafe(F.lag("turn").over(order)) | F.lag("seq").over(order).isNull())
    counted = changes.groupBy("session_id").agg(F.count_if("_new").alias("turns"), F.count(F.lit(1)).alias("steps"))
    sampled = F.col("first_token").isNotNull()
    decoded = sampled & (F.coalesce("output", F.lit(-1)) >= 0)
    times = steps.groupBy("session_id").agg(
        F.sum(_span(F.col("start"), F.col("end"))).alias("llm_ms"),
        F.sum(F.when(sampled, _span(F.col("start"), F.col("first_token")))).alias("ttft_ms"),
        F.count_if(sampled).alias("ttft_steps"),
        F.sum(F.when(decoded, _span(F.col("first_token"), F.col("end")))).alias("decode_ms"),
        F.sum(F.when(decoded, F.col("output"))).alias("decode_tokens"),
    )
    tool = tools.groupBy("session_id").agg(F.sum("duration").alias("tool_ms"))
    return counted.join(times, "session_id", "left").join(tool, "session_id", "left").fillna(0)


def _in_order():
    return Window.partitionBy("session_id").orderBy("seq")


def _last_before(value: Column) -> Column:
    """The last value that isn't null in the rows before."""
    return F.last(value, ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))


def _open_turn(log: DataFrame, value: Column) -> DataFrame:
    """``log`` with ``opened``: ``seq`` and ``value`` of the turn start that no end has closed before the row."""
    kind = F.col("type")
    rows = log.withColumn("_start", _last_before(F.when(kind == "turn/start", F.struct("seq", value.alias("value"))))).withColumn("_end", _last_before(F.when(kind == "turn/end", F.col("seq"))))
    return rows.withColumn("opened", F.when(F.col("_start.seq") > F.coalesce("_end", F.lit(-1)), F.col("_start"))).drop("_start", "_end")


def subagent_timing(log: DataFrame) -> DataFrame:
    """``session_id, settled_ms, since, through`` of every session with a descriptor.

    Turns are intervals from their start to the next end.  ``settled_ms`` is the
    time of those that end after the last descriptor; a turn that is open at the
    end of the log reaches from ``since`` ``through`` the last row.
    """
    kind = F.col("type")
    rows = _open_turn(log, F.col("time")).withColumn("descriptor", F.max(F.when(kind == "subagent/descriptor", F.col("seq"))).over(Window.partitionBy("session_id")))
    took = F.greatest(F.col("time") - F.col("opened.value"), F.lit(0))
    still = F.when(kind == "turn/start", F.col("time")).when(kind != "turn/end", F.col("opened.value"))
    return rows.where("descriptor is not null").groupBy("session_id").agg(
        F.coalesce(F.sum(F.when((kind == "turn/end") & (F.col("seq") > F.col("descriptor")), took)), F.lit(0)).alias("settled_ms"),
        F.max_by(F.struct(still.alias("since"), F.when(still.isNotNull(), F.col("time")).alias("through")), "seq").alias("last"),
    ).select("session_id", "settled_ms", "last.since", "last.through")


def consumed_work(log: DataFrame) -> DataFrame:
    """``session_id, end, dropped_unrun``: the last turn end that accounts for work, and whether work was thrown away since.

    A turn has worked if a step of it started, and has taken messages if the
    inbox gave some up while it was open.  Its end accounts for the work if it
    has worked, or if it took messages and ended otherwise than completed.
    Messages that are cancelled with nothing in their place are thrown away.
    """
    kind, splice = F.col("type"), F.col("type") == "agent/inbox/spliced"
    field = lambda name: F.get_json_object("data", f"$.{name}")
    cancelled = splice & field("removedCount").isNotNull() & F.coalesce(field("outcome") == "canceled", F.lit(False))
    taken = splice & field("removedCount").isNotNull() & ~cancelled
    nothing = F.coalesce(field("inserted"), F.lit("[]")) == "[]"
    turn = F.when(kind.isin("step/start", "turn/end"), field("turn")).when(taken, F.col("opened.value"))
    facts = _open_turn(log, field("turn")).select("session_id", "seq", turn.alias("turn"), (kind == "step/start").alias("works"), taken.alias("takes"), (kind == "turn/end").alias("ends"), F.coalesce(field("reason.kind"), F.lit("")).alias("reason"), (cancelled & nothing).alias("drops"))
    turns = facts.where("turn is not null").groupBy("session_id", "turn").agg(F.bool_or("works").alias("works"), F.bool_or("takes").alias("takes"), F.max(F.when(F.col("ends"), F.col("seq"))).alias("seq"), F.max_by("reason", F.when(F.col("ends"), F.col("seq"))).alias("reason"))
    ends = turns.where(F.col("works") | (F.col("takes") & (F.col("reason") != "completed"))).groupBy("session_id").agg(F.max("seq").alias("end"))
    drops = facts.groupBy("session_id").agg(F.max(F.when(F.col("drops"), F.col("seq"))).alias("drop"))
    return drops.join(ends, "session_id", "left").select("session_id", "end", F.coalesce(F.col("drop") > F.coalesce("end", F.lit(-1)), F.lit(False)).alias("dropped_unrun"))


def anchored(samples: DataFrame, surface: DataFrame, headers: DataFrame) -> DataFrame:
    """``session_id, seq, baseline, tokens, measured``: the size of the context after each surface row.

    ``samples`` (``session_id, seq, used, header``) are what a provider counted
    and under which header, ``surface`` (``session_id, seq, delta``) estimated
    changes, ``headers`` (``session_id, seq, header, tokens``) the estimated size
    of each header.  The anchor is the last sample, if the header in force is
    still the one it was counted under; its count, or the estimate at that row
    if that is greater, is the baseline, and the changes since are added.
    Without an anchor the estimate stands.
    """
    rows = surface.select("session_id", "seq", "delta").unionByName(samples.select("session_id", "seq", "used", F.col("header").alias("counted")), allowMissingColumns=True)
    rows = rows.unionByName(headers.select("session_id", "seq", "header", F.col("tokens").alias("size")), allowMissingColumns=True)
    upto = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("size").isNotNull(), F.struct("header", "size")), ignorenulls=True).over(upto)
    rows = rows.withColumn("grown", F.coalesce(F.sum("delta").over(upto), F.lit(0))).withColumn("head", head)
    estimate = F.col("grown") + F.coalesce("head.size", F.lit(0))
    rows = rows.withColumn("estimate", estimate)
    anchor = F.last(F.when(F.col("used").isNotNull(), F.struct("used", "counted", "estimate", "grown")), ignorenulls=True).over(upto)
    rows = rows.withColumn("anchor", anchor).where("delta is not null")
    good = F.coalesce(F.col("anchor.counted").eqNullSafe(F.col("head.header")) & F.col("anchor.used").isNotNull(), F.lit(False))
    base = F.when(good, F.greatest("anchor.used", "anchor.estimate"))
    tokens = F.greatest(F.when(good, base + F.col("grown") - F.col("anchor.grown")).otherwise(F.col("estimate")), F.lit(0))
    return rows.select("session_id", "seq", base.alias("baseline"), tokens.alias("tokens"), good.alias("measured"))


def window_stats(steps: DataFrame) -> DataFrame:
    """Turns, steps and output of each session in a window of a log."""
    return steps.groupBy("session_id").agg(F.countDistinct("turn").alias("turns"), F.count(F.lit(1)).alias("steps"), F.sum("output").alias("output"))


def turn_metrics(steps: DataFrame) -> DataFrame:
    """Time to the first token of each turn's lowest step, and tokens a second over its sampled steps."""
    ttft = F.when(F.col("first_token").isNotNull(), _span(F.col("start"), F.col("first_token")))
    ms, n = _span(F.col("first_token"), F.col("end")), F.col("output")
    sampled = F.col("first_token").isNotNull() & (n > 0) & (ms > 0)
    rows = steps.groupBy("session_id", "turn").agg(F.min_by(ttft, "step").alias("ttft"), F.sum(F.when(sampled, n)).alias("tokens"), F.sum(F.when(sampled, ms)).alias("ms"))
    return rows.select("session_id", "turn", "ttft", (F.col("tokens") / (F.col("ms") / 1000)).alias("tokens_per_second"))


def ratios(usage: DataFrame, window: Column) -> DataFrame:
    """Billed input, the share of it read from cache, and how full the window is, in whole percent."""
    total = F.col("input") + F.col("cache_read") + F.col("cache_write")
    percent = lambda x: F.floor(100 * x + 0.5)
    return usage.select("*", total.alias("billed_input"), F.when(total > 0, percent(F.col("cache_read") / total)).alias("cache_hit"), F.when(window > 0, F.least(percent(total / window), F.lit(100))).alias("occupancy"))


def best_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group by ``order``; a minimum with partial results, so no group is sorted."""
    rows = df.withColumn("_key", F.struct(*order)).withColumn("_row", F.struct(*(c for c in df.columns)))
    return rows.groupBy(F.col(group).alias("_group")).agg(F.min_by("_row", "_key").alias("_row")).select("_row.*")


def merge_hooks(results: DataFrame) -> DataFrame:
    """One decision of several hooks (``event, position, decision, reason, stop, context``): ``event, decision, reason, stop, contexts``.

    Deny outranks ask, ask outranks allow; the reasons of the winning rank are joined
    by line breaks in the order of position; the first stop wins; ``contexts`` counts
    those given, whose texts stay rows, see :func:`hook_texts`.  A task holds no more
    of an event than its joined reasons; the other rows are sorted and may spill.
    """
    ranked = results.withColumn("rank", _hook_rank()).withColumn("_top", F.max("rank").over(Window.partitionBy("event")))
    grouped = ranked.groupBy("event").agg(
        F.max("rank").alias("top"),
        F.expr("listagg(reason, '\n') WITHIN GROUP (ORDER BY position) FILTER (WHERE rank = _top)").alias("reason"),
        F.min_by(F.when(F.col("stop").isNotNull(), F.col("stop")), F.when(F.col("stop").isNotNull(), F.col("position"))).alias("stop"),
        F.count("context").alias("contexts"),
    )
    decision = F.element_at(F.array(F.lit(None).cast("string"), F.lit("allow"), F.lit("ask"), F.lit("deny")), F.col("top") + 1)
    return grouped.select("event", decision.alias("decision"), "reason", "stop", "contexts")


def _hook_rank() -> Column:
    return F.when(F.col("decision") == "deny", 3).when(F.col("decision") == "ask", 2).when(F.col("decision") == "allow", 1).otherwise(0)


def hook_texts(results: DataFrame) -> DataFrame:
    """``event, position, kind, text``: the reasons of each event's winning rank, and all contexts, to be read by position."""
    rows = results.withColumn("rank", _hook_rank())
    top = rows.groupBy("event").agg(F.max("rank").alias("_top"))
    reasons = rows.where("reason is not null").join(top, "event").where("rank = _top").select("event", "position", F.lit("reason").alias("kind"), F.col("reason").alias("text"))
    return reasons.unionByName(rows.where("context is not null").select("event", "position", F.lit("context").alias("kind"), F.col("context").alias("text")))


def pass_fail(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of each case (``case, test, kind``): total and passed tests, and whether all passed; a missing verdict fails."""
    return _judged(expected, verdicts).groupBy("case").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), F.bool_and("ok").alias("resolved"))


def failures(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The failed tests, a row each."""
    return _judged(expected, verdicts).where("not ok").select("case", "test")


def _judged(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    return expected.join(verdicts, ["case", "test"], "left").withColumn("ok", F.coalesce(F.col("verdict") == "passed", F.lit(False)))


def extent(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def grouped_matches(matches: DataFrame) -> DataFrame:
    """Matching lines with the first match and the number of matches of their file.

    A row a line, so that a file with very many stays many rows; ``first`` orders
    the files.
    """
    files = matches.groupBy("path").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    return matches.join(files, "path").select("path", "first", "n", "line", "text")


def produced_files(edits: DataFrame, up_to: int) -> DataFrame:
    """Paths of successful edits (``session_id, turn, seq, ok, paths``) of each turn, at their first place."""
    return edits.where(F.col("ok") & (F.col("seq") <= up_to)).select("session_id", "turn", "seq", F.explode("paths").alias("path")).groupBy("session_id", "turn", "path").agg(F.min("seq").alias("seq"))


def phase_view(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Agents of each run and phase with their state: running, interrupted or how they ended."""
    rows = starts.join(ends.select("run", "seq", "outcome"), ["run", "seq"], "left")
    state = F.coalesce("outcome", F.when(F.col("run_over"), "interrupted").otherwise("running"))
    return rows.withColumn("state", state).groupBy("run", "phase").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("agents"), F.count_if(F.col("state") == "running").alias("running"))
