"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts of a batch lie one behind the other in one byte array. A word's hash is a
polynomial of its bytes, taken from one running sum over the whole array, so
nothing is done per word or per text in Python. Two different words, or two
different shingles, share a hash with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on together: some 20 MB of arrays.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


def byte_values(separators: bytes, lower: bool) -> np.ndarray:
    """The number of each byte value; 0 for those that part words."""
    values = numbers(256, 17)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


#: Words are what lies between blanks, ASCII letters folded.
BLANK_PARTED = byte_values(b"\x20\t\n\x0b\x0c\r", lower=True)
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM_PARTED = byte_values(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)

_powers = np.ones(1, dtype=U)
_inverses = np.ones(1, dtype=U)


def _to_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE + 1)
        _powers = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, _BASE, dtype=U)])
        _inverses = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, _INVERSE, dtype=U)])
    return _powers, _inverses


def pieces(
    texts: pa.Array, prepare: Callable[[pa.Array], pa.Array] = lambda part: part
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and row offsets of about PIECE bytes each; nulls are empty.

    ``prepare`` turns the rows of a piece, without nulls, into the texts that are wanted. Only a piece is copied
    at a time, not the whole batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + PIECE, side="right")), start + 1)
        part = prepare(pc.fill_null(texts.slice(start, end - start), "").cast(pa.large_string()))
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        held = part.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
        yield start, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, in order, and the offsets of each row's words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    v = values[data]
    inside = v != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]  # a row's end parts words, too
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverses = _to_power(n)
    v *= powers[:n]
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum(v, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words, row by row, and the rows' offsets.

    A row of fewer words has one shingle, all of its words; one without words none.
    """
    total, counts = len(words), np.diff(bounds)
    if total == 0:
        return words, np.zeros(len(bounds), dtype=np.int64)
    factors = numbers(n, 29)
    left = np.repeat(bounds[1:], counts) - np.arange(total)  # words up to the row's end
    out = words * factors[0]
    for k in range(1, n):
        out[:-k] += np.where(left[:-k] > k, words[k:], U(0)) * factors[k]
    size = np.minimum(left, n)
    out = mixed(out + size.astype(U) * U(0xA0761D6478BD642F))
    firsts = np.zeros(total, dtype=bool)
    firsts[bounds[:-1][counts > 0]] = True
    keep = (left >= n) | (firsts & (np.repeat(counts, counts) < n))
    return out[keep], np.r_[0, np.cumsum(keep)][bounds]
