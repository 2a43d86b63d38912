"""Reading and writing numbers and text in binary values.

Only built-in functions, so no row leaves the JVM. Positions are counted from 0
and may be any BIGINT: a position that cannot be one in a binary value gives
NULL or no bytes, never an error.
"""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """Compute ``value`` once and use it as ``name`` in ``body``.

    A lambda variable is read by reference. A column of the row would be copied
    out of the row at every mention, which matters for whole image files.
    (``element_at`` looks at its type once; ``[0]`` would for every row, through
    all of ``body``.)
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def chain(steps: list[tuple[str, str]], result: str) -> str:
    """``result`` after named steps, each of which may use those before it.

    As one expression and not as projections on top of each other, because every
    projection copies all of the row, image bytes included. Spark's analyzer
    takes lambdas up to some 16 levels deep: keep chains well below that.
    """
    for name, value in reversed(steps):
        result = let(value, name, result)
    return result


def cut(data: str, start: str, size: str | int) -> str:
    """``size`` bytes from ``start`` on; fewer where the data ends."""
    return f"substring({data}, try_cast({start} + 1 AS INT), try_cast({size} AS INT))"


def unsigned(raw: str) -> str:
    """Big-endian bytes (at most 4) as a BIGINT; NULL for no bytes."""
    return f"CAST(conv(hex({raw}), 16, 10) AS BIGINT)"


def signed(plain: str, bits: int) -> str:
    """An unsigned number of ``bits`` bits read as a signed one."""
    return f"({plain} - shiftright({plain}, {bits - 1}) * {1 << bits})"


def reversed_bytes(raw: str) -> str:
    """The bytes back to front. ISO-8859-1 has one character for every byte."""
    return f"encode(reverse(decode({raw}, 'ISO-8859-1')), 'ISO-8859-1')"


def big_endian(raw: str, little: str) -> str:
    """Turn bytes around where the block is little-endian (and back again)."""
    return f"IF({little}, {reversed_bytes(raw)}, {raw})"


def number(data: str, start: str, size: int, little: str) -> str:
    """The unsigned number of ``size`` bytes at ``start``; NULL if it is cut off."""
    raw = big_endian(cut(data, start, size), little)
    return f"CASE WHEN {start} + {size} <= length({data}) THEN {unsigned(raw)} END"


def number_bytes(value: str, size: int, little: str) -> str:
    """The last ``size`` bytes of a whole number in the block's byte order."""
    return big_endian(f"unhex(right(lpad(hex({value}), 16, '0'), {2 * size}))", little)


def zeros(size: str) -> str:
    return f"unhex(repeat('00', CAST({size} AS INT)))"


def count_up(n: str) -> str:
    """0 to n - 1. (A sequence from 0 to -1 would count down.)"""
    return f"IF({n} > 0, sequence(0, {n} - 1), array())"
