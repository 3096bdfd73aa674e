"""Full-text search: one literal phrase over search documents.

A phrase matches consecutive tokens, whatever their case and diacritics; it
never matches inside a word.  Rank: spans of the phrase, most first, then the
shorter text, the later time, the session and the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pandas_text import span_count
from ..functions.text import collapse
from .filters import MAX_PREDICATES, EventFilter, FilterError
from .metrics import best_per_group


def normal_phrase(phrase: str, most: int = 1000) -> str:
    if "\0" in phrase:
        raise FilterError("the text holds NUL")
    phrase = " ".join(phrase.split())
    if not phrase or len(phrase) > most:
        raise FilterError(f"the text must have 1 to {most} characters")
    return phrase


def matches(documents: DataFrame, phrase: str, where: EventFilter = EventFilter()) -> DataFrame:
    """Documents with the phrase, with ``spans`` and ``length``.

    The filters and a plain test for the phrase's longest ASCII word run before
    the tokens are looked at, so few texts reach Python.
    """
    if where.predicates() > MAX_PREDICATES:
        raise FilterError(f"at most {MAX_PREDICATES} predicates")
    phrase = normal_phrase(phrase)
    rows = documents.where(where.column())
    plain = [w for w in phrase.lower().split() if w.isascii() and w.isalnum()]
    if plain:
        # Diacritics inside a word would hide it from this test: such texts go on.
        word = max(plain, key=len)
        rows = rows.where(F.contains(F.lower("text"), F.lit(word)) | F.col("text").rlike(r"[^\x00-\x7F]"))
    return rows.withColumn("spans", span_count(F.col("text"), phrase)).where("spans > 0").withColumn("length", F.length("text"))


def rank(order: str = "session_id") -> list[Column]:
    return [-F.col("spans"), F.col("length"), -F.col("time"), F.col(order), F.col("seq")]


def best_sessions(documents: DataFrame, phrase: str, where: EventFilter = EventFilter()) -> DataFrame:
    """The strongest row of each session, strongest sessions first."""
    best = best_per_group(matches(documents, phrase, where), "session_id", *rank())
    return best.orderBy(F.desc("spans"), "length", F.desc("time"), "session_id", "seq")


def literal_matches(documents: DataFrame, where: EventFilter) -> DataFrame:
    """Documents that pass the filters, whose text clause is a substring."""
    return documents.where(where.column()).withColumn("text", collapse(F.col("text")))
