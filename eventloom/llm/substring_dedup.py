"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import Windows, first_holders, flat, over, pairs_in, repeated
from ._text import covered

WIDTH = 50


def _candidates(windows: Windows, grams: pa.Array) -> np.ndarray:
    """Windows whose anchor another document has."""
    doc, key = flat(grams)
    return windows.windows_on(windows.on(doc, key.to_numpy(zero_copy_only=False)))


def window_rows(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    """``doc, window, check`` for the candidate windows of ``docs`` (``doc, text, grams``), each once a document."""

    def make(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
        which = _candidates(windows, batch.column("grams"))
        key, doc = windows.window_keys(which), windows.doc_of[windows.starts[which]]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(doc)]
        check = windows.window_checks(which[order[new]])
        return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc[new])), pa.array(key[new]), pa.array(check)], names=["doc", "window", "check"])

    return over(docs, width, f"doc {id_type}, window bigint, check bigint", make)


def repeats(windows: Windows, grams: pa.Array, firsts: pa.Array) -> np.ndarray:
    """Words in candidate windows that the document isn't the first to hold."""
    which = _candidates(windows, grams)
    doc, key = flat(firsts)
    own = pairs_in(windows.doc_of[windows.starts[which]], windows.window_keys(which), doc, key.to_numpy(zero_copy_only=False))
    return covered(windows.starts[which[~own]], windows.width, len(windows.words))


def prepared(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame, str, tuple[str, ...]]:
    """``doc, text`` and the kept columns, of rows with an id and of rows without; the result's schema; what is kept."""
    taken = {id_col.lower(), *RESULT_NAMES}
    keep = tuple(c for c in dict.fromkeys(keep) if c.lower() not in taken)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)))
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    return rows.where("doc is not null"), rows.where("doc is null"), kept + RESULT, keep


def result(batch: pa.RecordBatch, windows: Windows, removed: np.ndarray, id_col: str, keep: tuple[str, ...]) -> pa.RecordBatch:
    kept = [batch.column(f"_{k}") for k in range(len(keep))]
    return pa.RecordBatch.from_arrays([batch.column("doc"), *kept, *windows.without(removed)], names=[id_col, *keep, *RESULT_NAMES])


RESULT_NAMES = ("n_words", "n_removed", "removed", "kept_text")
RESULT = "n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Each document without the words it repeats from documents with smaller ids.

    Columns: ``id_col``, those of ``keep``, ``n_words, n_removed, removed, kept_text``.  Words are runs
    of characters other than space and \\t to \\r, unchanged.  A word goes if any
    window of ``width`` words that covers it also starts in a document with a
    smaller id; ``removed`` are the maximal intervals ``[start, end)`` of such
    words, ``kept_text`` the others joined by a space.

    Of every window the 26-word gram with the smallest Rabin-Karp hash, its
    anchor, is compared first; the windows whose anchor another document has are
    hashed whole and counted, since no other window can have a copy.  The
    count is a minimum of ids by hash, with partial results before the shuffle,
    and only a window's first holder is told.  Texts are dealt out by id once.
    Windows are told apart by two hashes, each modulo two primes and of other
    hashes of the words.

    Null texts have no words.  Rows with a null id neither lose words nor take
    them from others.  Rows that share an id don't take words from each other.
    Columns that aren't in ``keep`` are ignored; of kept ones with a name of the
    result, the result's replace them.  A very long text is one row of one task,
    some forty bytes of memory a word.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts, loose, schema, keep = prepared(docs, id_col, text_col, keep)
    # Dealt out with all that the last step needs, so one shuffle serves both steps.
    with_grams = texts.repartition("doc").join(repeated(texts, width, id_type), "doc", "left")
    firsts = first_holders(window_rows(with_grams, width, id_type))

    def make(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
        return result(batch, windows, repeats(windows, batch.column("grams"), batch.column("firsts")), id_col, keep)

    rows = with_grams.join(firsts, "doc", "left")
    none = loose.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("grams", "firsts")})
    return over(rows, width, schema, make).unionByName(over(none, width, schema, make))
