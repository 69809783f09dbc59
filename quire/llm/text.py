"""Small helpers shared by the operators: Arrow slices, and words of a batch of texts as numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. All helpers work on the UTF-8 bytes of an
Arrow column, so a batch costs a few vector passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_SEED = np.random.Generator(np.random.Philox(20240229))
BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES[WHITE] = 0
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (the well-known xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit + 2 * np.cumsum(sizes > limit) - (sizes > limit)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and the n + 1 offsets into them. Null is empty."""
    array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if not len(array) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(data: np.ndarray, size: int, white: np.ndarray = WHITE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end behind white space, so that no word is cut."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + size)
        while end < n and not white[data[end - 1]]:
            step = np.flatnonzero(white[data[end : end + 4096]])
            end = end + int(step[0]) + 1 if len(step) else min(n, end + 4096)
        yield start, end
        start = end


def words(
    data: np.ndarray, offsets: np.ndarray, hashes: bool = True, fold: bool = False, white: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(start, end, text number, 64-bit hash) of every word; ``fold`` hashes A-Z as a-z, ``white`` marks the bytes between words."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    codes = FOLDED_CODES if fold else BYTE_CODES
    if white is not WHITE:
        codes = np.where(white, np.uint64(0), codes)
    starts, ends, found = [], [], []
    for a, b in _windows(data, SLICE_BYTES, white):
        part = data[a:b]
        ink = ~white[part]
        before, after = np.ones(b - a, bool), np.ones(b - a, bool)
        before[1:], after[:-1] = ~ink[:-1], ~ink[1:]
        s = np.flatnonzero(ink & (before | first[a:b]))
        e = np.flatnonzero(ink & (after | first[a + 1 : b + 1])) + 1
        starts.append(s + a)
        ends.append(e + a)
        if hashes and len(s):
            inside = np.arange(s[0], b - a) - np.repeat(s, np.diff(np.append(s, b - a)))
            h = np.add.reduceat(codes[part[s[0] :]] * POWERS[inside & 4095], s - s[0])
            found.append(mix(h + (e - s).astype(np.uint64)))
    none = np.zeros(0, np.int64)
    s, e = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(s, offsets)))
    return s, e, text, np.concatenate([np.zeros(0, np.uint64), *found]) if hashes else None


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` neighbouring word hashes."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + hashes[k : k + size])
    return out


def per_text(weights: np.ndarray | None, text: np.ndarray, n: int) -> np.ndarray:
    """Sum (or count) of values by text number."""
    return np.bincount(text, weights, n) if weights is not None else np.bincount(text, minlength=n)


def row(df: DataFrame, columns) -> Column:
    """The given columns of ``df`` as one struct, so that they cannot clash with an operator's own names."""
    return F.struct(*[df[f"`{c}`"] for c in columns])


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
