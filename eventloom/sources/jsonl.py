"""Session logs as JSON lines: a header line, then events or packed runs of them.

Logs end where a writer stopped: what comes after the last end of a turn may be
torn and is dropped, what comes before it must be whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordered import by_session
from ..schema import EVENT, MAX_SAFE_INTEGER

FORMAT_VERSION = 0
LEAST_RUN, MOST_RUN = 3, 10_000
#: What a written line has besides type and payload, or a header besides the id, about.
_LINE_BYTES = 60
_HEADER = "type string, version int, id string, createdAt bigint, cwd string, parentSession string, seedLength bigint, origin string, delegationDepth bigint, agentPreset string"
_LINE = "type string, seq bigint, time bigint, data string, sourceEventSeqs array<bigint>, surfaceOp string, seq0 bigint, time0 bigint, ignorable boolean"


#: Files whose bytes aren't lines: they are read by zstd frames.
PACKED, PACKED_FILES = r"\.zstd?$", "*.{zst,zstd}"
_FRAME, _SKIPPABLE = 0xFD2FB528, range(0x184D2A50, 0x184D2A60)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, number, line`` of every line of plain or ``.zst``, ``.zstd`` files.

    Plain files are read by line, in splits.  A first pass counts each split's lines;
    a line's number is its place in its split after the lines of the splits before,
    so no line leaves the task that reads it.  Packed files are read by frames.
    """
    return _lines(spark, path, False)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``lines`` of files that hold several logs, as of a file for each: a log begins at its header line.

    Of plain files; what a split doesn't know, the header before its first line,
    comes from the counting pass.
    """
    return _lines(spark, path, True)


def _lines(spark: SparkSession, path: str, many: bool) -> DataFrame:
    name = F.col("_metadata.file_path")
    # Only a line that holds the word, or letters by number, is parsed.
    named = F.startswith("value", F.lit("{")) & (F.contains("value", F.lit('"session"')) | F.contains("value", F.lit("\\u")))
    head = F.when(named, F.get_json_object("value", "$.type") == "session") if many else F.lit(False)
    plain = spark.read.text(path).where(~name.rlike(PACKED)).select(name.alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.coalesce(head, F.lit(False)).alias("_head"), F.col("value").alias("line"))
    # A row a split, which the driver knows one by one as it is.
    counted = plain.groupBy("path", "_split").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_head"), F.col("_row"))).alias("last")).orderBy("path", "_split").collect()
    bases, before, start, file = [], 0, 0, None
    for r in counted:
        before, start = (before, start) if r["path"] == file else (0, 0)
        file = r["path"]
        bases.append((file, r["_split"], before - r["_first"], start))
        if r["last"] is not None:
            start = r["last"] - r["_first"] + before
        before += r["n"]
    based = F.broadcast(spark.createDataFrame(bases, "path string, _split bigint, _base bigint, _start bigint"))
    numbered = plain.join(based, ["path", "_split"]).withColumn("number", F.col("_row") + F.col("_base"))
    if many:
        numbered = _begun(numbered)
        numbered = numbered.select(F.concat_ws("#", "path", F.col("_start").cast("string")).alias("path"), (F.col("number") - F.col("_start")).alias("number"), "line")
    return numbered.select("path", "number", "line").unionByName(_packed_lines(spark, path)).where("line <> ''")


def _begun(numbered: DataFrame) -> DataFrame:
    """``_start`` of each line: the number of the last header up to it, in its split or before."""
    kept = ["path", "_split", "number", "_head", "_start", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, splits, numbers, heads, known = (batch.column(k) for k in range(5))
            path, split = paths.dictionary_encode().indices.to_numpy(), splits.to_numpy()
            edges = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (split[1:] != split[:-1]), True])
            # A split's lines come in order: the last header is the greatest number so far.
            starts = np.where(heads.to_numpy(zero_copy_only=False).astype(bool), numbers.to_numpy(), -1)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = (paths[a].as_py(), int(split[a]))
                starts[a] = max(starts[a], start if key == last else known[a].as_py())
                starts[a:b] = np.maximum.accumulate(starts[a:b])
                last, start = key, int(starts[b - 1])
            yield batch.set_column(4, "_start", pa.array(starts, pa.int64()))

    return numbered.select(kept).mapInArrow(run, numbered.select(kept).schema)


def _frames(data: bytes) -> Iterator[tuple[int, int]]:
    """Where each whole zstd frame begins and ends, by frame and block headers; ends early where the data is cut off."""
    at = 0
    while at + 8 <= len(data):
        begin, magic = at, int.from_bytes(data[at : at + 4], "little")
        if magic in _SKIPPABLE:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                return
            continue
        if magic != _FRAME:
            return
        flags = data[at + 4]
        single = flags >> 5 & 1
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if at + 3 > len(data):
                return
            block = int.from_bytes(data[at : at + 3], "little")
            last = bool(block & 1)
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 if flags >> 2 & 1 else 0
        if at > len(data):
            return
        yield begin, at


def zstd_frames(spark: SparkSession, path: str) -> DataFrame:
    """``path, frame, content, torn`` of the packed files under ``path``.

    No other file is opened.  The task that reads a file finds its frames without unpacking them; they are
    dealt out and unpacked one by one.  What is left after the last whole frame
    makes one row without content that is ``torn``.  A file of more than 2 GB, packed,
    can't be read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, number, end = data.as_buffer().to_pybytes(), 0, 0
                for number, (begin, end) in enumerate(_frames(data), 1):  # noqa: B007
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number - 1], pa.int64()), pa.array([data[begin:end]], pa.binary())], names=["path", "frame", "data"])
                rest = data[end:]
                if rest and int.from_bytes(rest[:4], "little") not in _SKIPPABLE:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([None], pa.binary())], names=["path", "frame", "data"])

    def unpack_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for k, data in enumerate(batch.column(2)):
                text = None if data.as_py() is None else zstandard.ZstdDecompressor().decompressobj().decompress(data.as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([text], pa.binary()), pa.array([text is None])], names=["path", "frame", "content", "torn"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", PACKED_FILES).load(path).where(F.col("path").rlike(PACKED)).select("path", "content")
    frames = files.mapInArrow(cut, "path string, frame bigint, data binary").repartition("path", "frame")
    return frames.mapInArrow(unpack_one, "path string, frame bigint, content binary, torn boolean")


def _packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of packed files: a line that frames cut is joined from its pieces, which have one number."""
    frames = zstd_frames(spark, path).where("not torn").withColumn("pieces", F.split(F.decode("content", "ISO-8859-1"), "\n"))
    frames = frames.select("path", "frame", "pieces", (F.size("pieces") - 1).alias("n"))
    before = Window.partitionBy("path").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    bases = frames.select("path", "frame", "n").withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    opened = frames.join(bases, ["path", "frame"]).select("path", "frame", "n", "_base", F.posexplode("pieces").alias("k", "piece"))
    rows = opened.select("path", "frame", (F.col("_base") + F.col("k")).alias("number"), ((F.col("k") == 0) | (F.col("k") == F.col("n"))).alias("edge"), "piece")
    joined = rows.where("edge").groupBy("path", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "piece"))), lambda x: x["piece"]), "").alias("piece"))
    whole = rows.where("not edge").select("path", "number", "piece").unionByName(joined)
    # Bytes stood for characters one by one, so that a character cut in two is whole again here.
    return whole.select("path", "number", F.decode(F.encode("piece", "ISO-8859-1"), "UTF-8").alias("line"))


def headers(lines: DataFrame) -> DataFrame:
    """The session of each file; a foreign version or a header out of range raises an error."""
    row = F.from_json("line", _HEADER)
    first = lines.where("number = 0").select("path", row.alias("h"))
    good = (F.col("h.type") == "session") & (F.col("h.version") == FORMAT_VERSION) & F.col("h.id").isNotNull() & F.col("h.createdAt").between(0, MAX_SAFE_INTEGER) & (F.coalesce("h.delegationDepth", F.lit(0)) >= 0)
    checked = F.when(good, F.col("h")).otherwise(F.raise_error(F.concat(F.lit("not a session log of this version: "), "path")))
    return first.select("path", checked.alias("h")).select(
        "path", "h.id", F.col("h.createdAt").alias("created_at"), "h.cwd", F.col("h.parentSession").alias("parent_session"), F.col("h.seedLength").alias("seed_length"), "h.origin", F.col("h.delegationDepth").alias("delegation_depth"), F.col("h.agentPreset").alias("agent_preset")
    )


def events(lines: DataFrame, strict: bool = True) -> DataFrame:
    """The events of each file, runs unpacked, torn tails dropped.

    ``strict``: a bad line or a hole before the last ``turn/end`` raises an
    error; otherwise such a log keeps what comes before it.
    """
    # One pass: lines of one event and runs of them go through the same steps.
    parsed = lines.where("number > 0").select("path", "number", F.from_json("line", _LINE).alias("e"), F.get_json_object("line", "$.data").alias("data"))
    single = F.col("e.seq").isNotNull() & F.col("e.type").isNotNull()
    packed = F.col("e.seq0").isNotNull() & F.col("e.time0").isNotNull()
    run = packed & ~single
    rows = parsed.select("path", "number", (single | packed).alias("good"), F.col("e.seq").alias("_seq"), F.col("e.type").alias("type"), F.col("e.time").alias("_time"), "data", F.when(~run, F.col("e.sourceEventSeqs")).alias("source_event_seqs"), F.when(~run, F.col("e.surfaceOp")).alias("_op"), F.when(run, F.col("e.seq0")).alias("seq0"), F.when(run, F.col("e.time0")).alias("time0"))
    both = _unpacked(rows).withColumns({"seq": F.when(F.col("seq0").isNull(), F.col("_seq")).otherwise(F.col("seq")), "time": F.when(F.col("seq0").isNull(), F.col("_time")).otherwise(F.col("time"))}).drop("_seq", "_time", "seq0", "time0")
    kept = cut_tail(both, strict)
    op = F.when(F.col("_op") == "append", F.struct(F.lit("append").alias("op"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))).otherwise(F.from_json("_op", "op string, start bigint, end bigint"))
    return kept.select("path", "seq", "type", "time", "data", "source_event_seqs", op.alias("surface_op"))


def cut_tail(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of each path up to the first that is bad or out of turn."""
    order = Window.partitionBy("path").orderBy("number", "seq")
    due = F.row_number().over(order) - 1
    marked = rows.withColumn("_due", due).withColumn("_bad", ~F.col("good") | ~F.col("seq").eqNullSafe(due))
    whole = Window.partitionBy("path")
    ended = marked.withColumn("hole", F.min(F.when(F.col("_bad"), F.col("_due"))).over(whole)).withColumn("committed", F.max(F.when(F.col("type") == "turn/end", F.col("_due"))).over(whole))
    hole = F.col("hole")
    if strict:
        torn = F.coalesce(F.col("hole") < F.col("committed"), F.lit(False))
        hole = F.when(torn, F.raise_error(F.concat(F.lit("a hole in the committed part of "), "path")).cast("int")).otherwise(hole)
    return ended.where(hole.isNull() | (F.col("_due") < hole)).drop("_due", "_bad", "hole", "committed", "good")


def pack(chunks: DataFrame, keys: tuple[str, ...] = ("turn", "step", "index", "kind"), text: str = "text") -> DataFrame:
    """Runs of delta chunks (``session_id, seq, time``) as one row each.

    A run is consecutive rows that agree in ``keys``; fewer than ``LEAST_RUN``
    stay single rows, and a run is cut after ``MOST_RUN``.  Columns: ``session_id``, keys, ``seq0, time0, dt, texts,
    packed``; ``dt`` has a gap for each row after the first.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    broken = F.lag("seq").over(order).isNull() | (F.col("seq") != F.lag("seq").over(order) + 1)
    for k in keys:
        broken = broken | ~F.col(k).eqNullSafe(F.lag(k).over(order))
    rows = chunks.withColumn("_new", broken.cast("int")).withColumn("_gap", F.col("time") - F.lag("time").over(order))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A run's rows are numbered without holes; a long one is cut by number.
    rows = rows.withColumn("_run", F.struct("_run", F.floor((F.col("seq") - F.min("seq").over(Window.partitionBy("session_id", "_run"))) / MOST_RUN).alias("_part")))
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id", "_run"))
    rows = rows.withColumn("packed", size >= LEAST_RUN).withColumn("_run", F.struct("_run", F.when(size < LEAST_RUN, F.col("seq"))))
    grouped = rows.groupBy("session_id", *keys, "_run", "packed").agg(F.min("seq").alias("seq0"), F.min_by("time", "seq").alias("time0"), F.array_sort(F.collect_list(F.struct("seq", "_gap", F.col(text).alias("text")))).alias("all"))
    return grouped.select("session_id", *keys, "seq0", "time0", F.slice(F.col("all._gap"), 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("dt"), F.col("all.text").alias("texts"), "packed")


def unpack_arrays(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`pack`: one row for each text, times from the gaps."""
    time = F.aggregate(F.slice("dt", 1, F.col("_k")), F.col("time0"), lambda t, d: t + d)
    opened = rows.select("*", F.posexplode("texts").alias("_k", "text"))
    return opened.select(*(c for c in rows.columns if c not in ("seq0", "time0", "dt", "texts", "packed")), (F.col("seq0") + F.col("_k")).alias("seq"), time.alias("time"), "text")


def unpack(rows: DataFrame) -> DataFrame:
    """Packed lines (``path, number, type, seq0, time0, data``) as events.

    A run whose arrays don't fit together raises an error.
    """
    return _unpacked(rows).where("seq0 is not null").select("path", "number", "seq", "type", "time", "data")


def _unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seq, time`` and ``data`` of each event of a run; a row without ``seq0`` stays as it is, its ``seq`` and ``time`` null."""
    run = F.col("seq0").isNotNull()
    rows = rows.withColumn("d", F.from_json(F.when(run, F.col("data")), "turn bigint, step bigint, index bigint, dt array<bigint>, texts array<string>, args array<string>, id string, name string"))
    parts = F.coalesce("d.texts", "d.args")
    fits = (F.size(parts) == F.size("d.dt") + 1) & F.col("seq0").between(0, MAX_SAFE_INTEGER)
    opened = rows.select("*", F.posexplode_outer(F.when(run, F.when(fits, parts).otherwise(F.raise_error("a packed run doesn't fit together")))).alias("_k", "text"))
    time = F.aggregate(F.slice("d.dt", 1, F.col("_k")), F.col("time0"), lambda t, d: t + d)
    delta = F.to_json(F.struct("d.turn", "d.step", "d.index", "d.id", "d.name", "text"))
    return opened.withColumns({"seq": F.col("seq0") + F.col("_k"), "time": F.when(run, time), "data": F.when(run, delta).otherwise(F.col("data"))}).drop("d", "_k", "text")


def write(sessions: DataFrame, log: DataFrame, path: str, file_bytes: int = 256 << 20) -> None:
    """Each session's header line and event lines, in order, in one file with other sessions.

    A file holds the logs of as many sessions as make about ``file_bytes``, one after
    another, so the number of files follows the data; :func:`log_lines` tells them
    apart again.  A log is in one file, so a long one makes a long file.  Sessions
    are dealt out by hash, so the log is made once; before, its types and payloads
    are measured for the number of files.
    """
    head = sessions.select(F.col("id").alias("session_id"), F.lit(-1).cast("bigint").alias("seq"), F.to_json(F.struct(F.lit("session").alias("type"), F.lit(FORMAT_VERSION).alias("version"), "id", F.col("created_at").alias("createdAt"))).alias("value"))
    body = log.select("session_id", "seq", F.to_json(F.struct("type", "seq", "time", F.parse_json("data").alias("data"))).alias("value"))
    size = F.octet_length("type") + F.coalesce(F.octet_length("data"), F.lit(0)) + _LINE_BYTES
    total = (log.agg(F.sum(size)).first()[0] or 0) + (sessions.agg(F.sum(F.octet_length(F.col("id").cast("string")) + _LINE_BYTES)).first()[0] or 0)
    files = max(1, -(-total // file_bytes))
    head.unionByName(body).repartition(files, "session_id").sortWithinPartitions("session_id", "seq").select("value").write.text(path)


def repair(log: DataFrame) -> DataFrame:
    """The log with what a crash left open closed: tool results, the step, the turn.

    New rows take the last row's time and the next numbers.  ``data`` must be
    JSON with ``turn``, ``step`` and ``callId`` where they apply.
    """

    def run(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        turn = step = None
        calls: dict[str, None] = {}
        for batch in batches:
            yield batch
            for kind, data in zip(batch.column("type").to_pylist(), batch.column("data").to_pylist(), strict=True):
                d = json.loads(data) if data else {}
                if kind == "turn/start":
                    turn, step, calls = d.get("turn"), None, {}
                elif kind == "step/start":
                    step = d.get("step")
                elif kind == "tool/call":
                    calls[d.get("callId")] = None
                elif kind == "tool/result":
                    calls.pop(d.get("callId"), None)
                elif kind == "step/end":
                    step = None
                elif kind == "turn/end":
                    turn, step, calls = None, None, {}
        closers = [("tool/result", {"turn": turn, "step": step, "callId": c, "interrupted": True}) for c in calls] if turn is not None else []
        if step is not None:
            closers.append(("step/end", {"turn": turn, "step": step, "interrupted": True}))
        if turn is not None:
            closers.append(("turn/end", {"turn": turn, "reason": "interrupted"}))
        last = batch.slice(batch.num_rows - 1).to_pylist()[0]
        extra = [{"session_id": name, "seq": last["seq"] + 1 + k, "type": kind, "time": last["time"], "data": json.dumps(d)} for k, (kind, d) in enumerate(closers)]
        if extra:
            yield pa.RecordBatch.from_pylist(extra, batch.schema)

    columns = T.StructType([f for f in EVENT.fields if f.name in ("session_id", "seq", "type", "time", "data")])
    return by_session(log.select(*columns.names), run, columns)


def project_folder(cwd: Column) -> Column:
    """The folder of a session's project; sessions without one share ``_no-cwd``."""
    from ..functions.pandas_text import column, path_segment

    return F.coalesce(column(path_segment, "string")(cwd), F.lit("_no-cwd"))
