"""Array views of text columns, shared by the operators of this subpackage.

Every helper works on one Arrow record batch inside a task: Spark decides how
rows are partitioned, these functions only avoid a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Word bytes for ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: Bytes of one record batch between the JVM and Python; Spark's default of 64 MB,
#: twice over in each of them and for each core, is most of a small executor.
BATCH_BYTES = 16 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Make this session's record batches no larger than ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with about ``max_bytes`` of text, and at least one row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        texts = batch.column(i).fill_null("")
        if batch.column(i).null_count:
            batch = batch.set_column(i, batch.schema.field(i), texts)
        if not batch.num_rows:
            continue
        ends = buffers(texts)[1][1:]
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values in a row, and ``len + 1`` offsets into them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, values = texts.buffers()
    n = len(texts)
    if places is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`buffers`, without a copy of the bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """The words of every document of a batch.

    ``starts`` and ``ends`` are byte positions, ``docs`` has the first word of
    each document and, last, the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.data, self.offsets = data, offsets
        self.mask = mask = word_bytes[data]
        filled = offsets[:-1] < offsets[1:]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        start, stop = mask.copy(), mask.copy()
        start[1:] &= ~mask[:-1]
        start[first] = mask[first]
        stop[:-1] &= ~mask[1:]
        stop[last] = mask[last]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.docs = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts())

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes one after another, and their offsets."""
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return self.data[self.mask], offsets

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Exact ids within this batch, and the distinct words they stand for."""
        coded = binaries(*self.packed()).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hashes that are the same in every task; those of another ``salt`` are independent."""
        return text_hashes(self.data[self.mask], np.r_[0, np.cumsum(self.ends - self.starts)], salt)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Families of window hashes: ``WIDE`` and ``CHECK`` tell windows apart, ``GRAMS`` orders and names grams.
GRAMS, WIDE, CHECK = range(3)
#: Two primes below 2**31 for each family, and a base for each prime.
_PRIMES = ((2147483647, 2147483629), (2147483587, 2147483579), (2147483563, 2147483549))
_rng = np.random.default_rng(20240607)
_BASES = _rng.integers(1 << 20, 1 << 30, (3, 2)).tolist()
_BYTES = _rng.integers(0, 1 << 64, (2, 64 * 256), np.uint64)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def text_hashes(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the bytes between each two offsets: the sum of a random number for each place and byte."""
    size = np.diff(offsets)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    each = _BYTES[salt][((place & 63) << 8) | data]
    far = np.flatnonzero(place > 63)
    if len(far):
        each[far] = mix(each[far] ^ mix((place[far] >> 6).astype(np.uint64)))
    total = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64))


def sequence_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the sequence of values between each two offsets, of any length."""
    size = np.diff(offsets)
    place = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)).astype(np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ mix(place + np.uint64(1))), out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base**i`` modulo ``prime`` for i < n."""
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        size, have = 1 << max(12, int(n - 1).bit_length()), np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        _POWERS[base, prime] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Rabin-Karp hashes of ``values[start:end]``: polynomials modulo two primes, from prefix sums."""
    n, parts = len(values), []
    for prime, base in zip(_PRIMES[family], _BASES[family], strict=True):
        p = np.uint64(prime)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values % p * powers(base, prime, n) % p, out=total[1:])
        # Sums stay below 2**31 * n; the inverse powers bring every span to the first place.
        parts.append((total[ends] - total[starts]) % p * powers(pow(base, -1, prime), prime, n + 1)[starts] % p)
    return mix((parts[0] << np.uint64(31) | parts[1]) ^ mix((ends - starts).astype(np.uint64)))


def window_hashes(values: np.ndarray, width: int, family: int = GRAMS) -> np.ndarray:
    """Rabin-Karp hashes of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(values, starts, starts + width, family)


def window_starts(docs: np.ndarray, width: int) -> np.ndarray:
    """Word positions at which ``width`` words of one document start."""
    n = int(docs[-1])
    inside = np.zeros(n + 1, np.int32)
    last = np.maximum(docs[1:] - width + 1, docs[:-1])
    np.add.at(inside, docs[:-1], 1)
    np.add.at(inside, last, -1)
    return np.flatnonzero(np.cumsum(inside[:n]) > 0)


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any ``[start, start + width)``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of all spans, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sums(flags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` between each two offsets of ``docs``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[docs])


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def spans_of(mask: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each document.

    Returns starts and ends relative to their document and, for each document,
    offsets into them.
    """
    n = len(mask)
    first = np.zeros(n + 1, bool)
    first[docs] = True
    start, stop = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | first[1:n]
    stop[:-1] &= ~mask[1:] | first[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    at = np.searchsorted(a, docs)
    base = np.repeat(docs[:-1], np.diff(at))
    return a - base, b - base, at
