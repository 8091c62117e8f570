"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word separators: space and the ASCII controls 9 to 13. A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multiplier of the word hash, its inverse modulo 2**64, and the constants of the final mix.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_powers: list[np.ndarray] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _MIX[0]
        x = x ^ (x >> np.uint64(33))
        x = x * _MIX[1]
        return x ^ (x >> np.uint64(33))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x ^ mix(np.array([salt + 1], np.uint64)))


def uniform(x: np.ndarray) -> np.ndarray:
    """The upper 53 bits as a number in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Entries of the tables of powers that a worker keeps; longer ones are made for one text and freed.
_KEPT = 1 << 19


def _powers_of(n: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return [np.cumprod(up), np.cumprod(down)]


def _power_tables(n: int) -> list[np.ndarray]:
    if n > _KEPT:
        return _powers_of(n)
    if not _powers:
        _powers[:] = _powers_of(_KEPT)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(column) else 0
    last = int(offsets[-1]) if len(column) else 0
    return whole[first:last], offsets.astype(np.int64) - first


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about `most` bytes each; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word, in order, without a Python loop. Words don't cross texts."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] = solid[edge]
    end[edge - 1] = solid[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a difference of prefix sums of a polynomial in its bytes."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `width` words; a shorter text with words is one shingle."""
    count = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    with np.errstate(over="ignore"):
        h = hashes.copy()
        odd = np.uint64(_BASE)
        m = max(len(h) - width + 1, 0)
        run = np.zeros(m, np.uint64)
        for k in range(width):
            run = run * odd + h[k : k + m]
        inside = text[:m] == text[width - 1 : width - 1 + m] if m else np.zeros(0, bool)
        long_h, long_t = mix(run[inside]), text[:m][inside]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short) == 0:
            return long_h, long_t
        first = np.searchsorted(text, short)
        short_h = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            short_h[has] = short_h[has] * odd + h[first[has] + k]
        all_h = np.concatenate([long_h, mix(short_h + np.uint64(1))])
        all_t = np.concatenate([long_t, short])
    order = np.argsort(all_t, kind="stable")
    return all_h[order], all_t[order]
