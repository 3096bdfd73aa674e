"""Chat formatting: every participant's view of a dialogue of several.

A dialogue is rendered once for each participant, who speaks as the assistant;
the others are named users.  What the assistant says is marked as the target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM_ROLES = ("system",)
#: Characters of rendered text after which a new part begins.
PART_CHARS = 32768
#: Turns whose lengths are summed as one before the sums are added up.
BLOCK_TURNS = 256
END = "<|end|>\n"


#: What a role in a header may not hold, and what stands for it.
_IN_ROLES = (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D"))


def escaped(text: Column) -> Column:
    """A text in which no mark can begin: ``<|`` becomes ``<\\|``, and one that looks like that a backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The text that :func:`escaped` got."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def role_name(role: Column) -> Column:
    """A role as it stands in a header, without bars and line breaks; percent signs tell which were there."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), _IN_ROLES, role)


def role_of_name(name: Column) -> Column:
    """The role that :func:`role_name` got."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(_IN_ROLES), name)


def rotate(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = SYSTEM_ROLES) -> DataFrame:
    """One row for each message of each participant's rendering.

    Columns: ``conv_id, speaker, turn, message, char_start, target_start,
    target_end``.  A message is ``<|assistant|>\\n`` for the speaker's own turns,
    ``<|user:NAME|>\\n`` for others, ``<|system|>\\n`` for roles in
    ``system_roles``, then the text and ``<|end|>\\n``.  ``char_start`` is its
    place in the whole rendering; the target, in characters of the message, is
    the text and end mark of an own turn, and empty otherwise.

    Messages go by turn, then role, then text; repeated rows are messages each.
    A null text is empty, a null role is the participant "unknown", a null turn
    comes first, and rows with a null conversation are left out.  A dialogue of
    system messages alone has no participant and no rendering.  Other columns
    are ignored.

    Texts are :func:`escaped` and roles in headers written by :func:`role_name`, so
    that neither can end a message or begin another speaker's; both can be turned
    back.

    Lengths are summed in two steps, within blocks of turns and over blocks, so
    a long conversation is not sorted by one task; messages of one turn, or
    without a turn, are one block.  A very long text is a message of its own
    length.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(escaped(F.col(text_col).cast("string")), F.lit("")).alias("text")
    ).where(F.col("conv_id").isNotNull())
    is_system = F.col("role").isin(*system_roles)
    speakers = turns.where(~is_system).select("conv_id", F.col("role").alias("speaker")).distinct()
    own = F.col("role") == F.col("speaker")
    head = F.when(is_system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), role_name(F.col("role")), F.lit("|>\n")))
    block = F.coalesce(F.floor(F.col("turn").cast("double") / BLOCK_TURNS), F.lit(-1)).alias("block")
    rows = turns.join(speakers, "conv_id").select("conv_id", "speaker", "turn", "role", "text", block, F.concat(head, "text", F.lit(END)).alias("message"), F.when(own & ~is_system, F.length(head)).alias("target_start"))
    key = ["conv_id", "speaker"]
    sums = rows.groupBy(*key, "block").agg(F.sum(F.length("message")).alias("chars"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, "block", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.length("message")).over(before), F.lit(0))
    n = F.length("message").cast("bigint")
    return rows.join(bases, [*key, "block"]).select(*key, "turn", "message", start.alias("char_start"), F.coalesce(F.col("target_start").cast("bigint"), n).alias("target_start"), n.alias("target_end"))


def render(conversations: DataFrame, *, part_chars: int = PART_CHARS, **names) -> DataFrame:
    """The renderings as text, one row for each participant and part.

    Columns: ``conv_id, speaker, part, n_messages, text, targets``.  Parts are
    whole messages: a message belongs to the part in which it starts, so a part
    has at most ``part_chars`` characters and one message more.  ``targets`` are
    the spans ``start, end`` of ``text`` that the speaker is to learn.
    """
    rows = rotate(conversations, **names)
    part = F.floor(F.col("char_start") / part_chars).alias("part")
    pieces = F.array_sort(F.collect_list(F.struct("char_start", "message", "target_start", "target_end")))
    grouped = rows.groupBy("conv_id", "speaker", part).agg(F.count(F.lit(1)).alias("n_messages"), pieces.alias("pieces"))
    base = F.col("pieces")[0]["char_start"]
    own = F.filter("pieces", lambda p: p["target_start"] < p["target_end"])
    targets = F.transform(own, lambda p: F.struct((p["char_start"] - base + p["target_start"]).alias("start"), (p["char_start"] - base + p["target_end"]).alias("end")))
    return grouped.select("conv_id", "speaker", "part", "n_messages", F.array_join(F.col("pieces")["message"], "").alias("text"), targets.alias("targets"))
