"""Words and rolling hashes over the UTF-8 bytes of a whole Arrow text column.

Both word patterns only ever split on ASCII characters, so bytes can be classified one by one: every byte of
a multi-byte character is a word byte. Hashes are polynomials modulo 2**64 over random byte values, taken from
prefix sums, then mixed; a hash depends on the words alone, never on their place in the batch.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on text whose A-Z are lower-cased
SPACED = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1_000_000
BATCH_ROWS = 1000

_b = np.arange(256)
_ALNUM_LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
_ALNUM_MASK = ((_b >= 48) & (_b <= 57)) | ((_ALNUM_LOWER >= 97) & (_ALNUM_LOWER <= 122)) | (_b >= 128)
_SPACED_MASK = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size, b = 1 << max(n - 1, 1 << 16).bit_length(), int(_BASES[base])
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = both[0], both[1]
        if size <= 1 << 21:  # what a usual slice needs; the powers for a very long text are not kept
            _powers[base] = have
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=p[1:])
    return p


def rolling(values: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """Hash of ``n`` consecutive values from each place where so many are left."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    p = _prefix(values, base)
    return mix((p[n:] - p[:-n]) * _power(base, len(values))[1][: len(values) - n + 1])


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds; an empty span is 0 before mixing."""
    p = _prefix(values, base)
    inverse = _power(base, len(values) + 1)[1]
    return mix((p[end] - p[start]) * inverse[start])


@dataclass
class Words:
    """Words of consecutive rows: byte bounds, hashes, and ``first[i]:first[i+1]`` as the words of row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def starts_of(self, n: int) -> np.ndarray:
        """Words from which ``n`` words of the same row are left."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return np.flatnonzero(left >= n)


def split_words(data: np.ndarray, offsets: np.ndarray, alnum: bool, hashed: bool = True) -> Words:
    """Words of the rows data[offsets[i]:offsets[i+1]]; ``alnum``: lower-cased letters and digits, else runs without white space."""
    if alnum:
        data = _ALNUM_LOWER[data]
    inside = (_ALNUM_MASK if alnum else _SPACED_MASK)[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]  # a word never spans two rows
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    h = None
    if hashed:
        h = spans(_BYTES[data], start, end)
    return Words(data, start, end, np.searchsorted(start, offsets), h)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of about ``most`` bytes (one row at least): first row, end row, bytes, offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bounded_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Let Python get at most ``rows`` rows at a time, unless the session says otherwise: a batch of the usual size holds
    tens of megabytes of text, in the JVM's direct memory and again in the worker, and neither is given back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(rows))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column).fill_null(0)))]).astype(np.int64)
