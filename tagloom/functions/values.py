"""Tag values as text, and text back as bytes or typed columns.

The text of a value: ASCII as it is, without the closing zero bytes (read as
UTF-8, or as ISO-8859-1 where it is not valid UTF-8); UNDEFINED as hex digits; numbers in decimal, separated by spaces; a rational as ``n/d``,
which keeps the pair (a quotient would lose it, and d may be 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.bytes import (
    big_endian,
    count_up,
    cut,
    let,
    reversed_bytes,
    signed,
    unsigned,
)
from tagloom.functions.directories import width

# Fixed values of the TIFF file format: type codes, and the range of each whole
# number type by its code (a rational is two LONG or two SLONG numbers).
BYTE, ASCII, SHORT, LONG, RATIONAL, SBYTE, UNDEFINED = 1, 2, 3, 4, 5, 6, 7
SSHORT, SLONG, SRATIONAL, FLOAT, DOUBLE, IFD = 8, 9, 10, 11, 12, 13
LOWEST = (
    "NULL, 0L, NULL, 0L, 0L, 0L, -128L, NULL, -32768L, -2147483648L, -2147483648L,"
    " NULL, NULL, 0L"
)
HIGHEST = (
    "NULL, 255L, NULL, 65535L, 4294967295L, 4294967295L, 127L, NULL, 32767L, 2147483647L,"
    " 2147483647L, NULL, NULL, 4294967295L"
)

_WHOLE = "^-?[0-9]+$"
_FRACTION = "^-?[0-9]+/-?[0-9]+$"


def value_text(raw: str, type_code: str, count: str, little: str) -> str:
    """The bytes of a value as text; NULL for NULL bytes."""
    letters = f"coalesce(try_validate_utf8(CAST({raw} AS STRING)), decode({raw}, 'ISO-8859-1'))"
    plain = f"trim(TRAILING decode(X'00', 'UTF-8') FROM {letters})"
    return f"""CASE WHEN {raw} IS NULL THEN NULL
        WHEN {type_code} = {ASCII} THEN {plain}
        WHEN {type_code} = {UNDEFINED} THEN hex({raw})
        WHEN {count} = 0 THEN ''
        ELSE {_numbers(raw, type_code, count, little)} END"""


def _numbers(raw: str, type_code: str, count: str, little: str) -> str:
    """Elements joined by spaces. A little-endian value is turned around as a
    whole, so every element reads big-endian and the last one comes first."""
    place = f"IF({little}, {count} - 1 - i, i) * {width(type_code)}"
    element = _element("data", place, type_code, little)
    return let(
        big_endian(raw, little),
        "data",
        f"array_join(transform({count_up(count)}, i -> {element}), ' ')",
    )


def _element(data: str, start: str, type_code: str, little: str) -> str:
    def whole(size: int, bits: int | None = None, at: str = start) -> str:
        plain = unsigned(cut(data, at, size))
        return signed(plain, bits) if bits else plain

    def fraction(bits: int | None) -> str:
        # Turned around, a rational has its denominator first.
        top = whole(4, bits, f"{start} + IF({little}, 4, 0)")
        bottom = whole(4, bits, f"{start} + IF({little}, 0, 4)")
        return f"concat({top}, '/', {bottom})"

    return f"""CASE {type_code}
        WHEN {BYTE} THEN CAST({whole(1)} AS STRING)
        WHEN {SBYTE} THEN CAST({whole(1, 8)} AS STRING)
        WHEN {SHORT} THEN CAST({whole(2)} AS STRING)
        WHEN {SSHORT} THEN CAST({whole(2, 16)} AS STRING)
        WHEN {LONG} THEN CAST({whole(4)} AS STRING)
        WHEN {IFD} THEN CAST({whole(4)} AS STRING)
        WHEN {SLONG} THEN CAST({whole(4, 32)} AS STRING)
        WHEN {RATIONAL} THEN {fraction(None)}
        WHEN {SRATIONAL} THEN {fraction(32)}
        WHEN {FLOAT} THEN {let(whole(4), 'w', _float('w'))}
        WHEN {DOUBLE} THEN
            {let(f"struct({whole(4)} AS high, {whole(4, None, f'{start} + 4')} AS low)", 'w',
                 _double('w.high', 'w.low'))}
        END"""


def _float(bits: str) -> str:
    size = _real(f"(shiftright({bits}, 23) & 255)", f"({bits} & {(1 << 23) - 1}) / {1 << 23}D", 127)
    return f"CAST(CAST(IF({bits} >= {1 << 31}, -1D, 1D) * {size} AS FLOAT) AS STRING)"


def _double(high: str, low: str) -> str:
    fraction = f"(({high} & {(1 << 20) - 1}) * {1 << 32} + {low}) / {1 << 52}D"
    size = _real(f"(shiftright({high}, 20) & 2047)", fraction, 1023)
    return f"CAST(IF({high} >= {1 << 31}, -1D, 1D) * {size} AS STRING)"


def _real(power: str, fraction: str, bias: int) -> str:
    """The size of a floating-point number from its fields (IEEE 754)."""
    return f"""CASE
        WHEN {power} = {2 * bias + 1} THEN CAST(IF({fraction} > 0, 'NaN', 'Infinity') AS DOUBLE)
        WHEN {power} = 0 THEN {fraction} * pow(2D, {1 - bias})
        ELSE (1 + {fraction}) * pow(2D, {power} - {bias}) END"""


def value_bytes(value: str, type_code: str, little: str) -> str:
    """The bytes of a value given as text; NULL if the text does not suit the type."""
    fits = (
        f"coalesce(n BETWEEN get(array({LOWEST}), {type_code})"
        f" AND get(array({HIGHEST}), {type_code}), FALSE)"
    )
    digits = f"IF({type_code} IN ({RATIONAL}, {SRATIONAL}), 8, 2 * {width(type_code)})"
    texts = f"transform(numbers, n -> right(lpad(hex(n), 16, '0'), {digits}))"
    backward = reversed_bytes(f"unhex(array_join(reverse({texts}), ''))")
    packed = let(
        f"transform(split({value}, '[ /]'), t -> try_cast(t AS BIGINT))",
        "numbers",
        f"CASE WHEN forall(numbers, n -> {fits})"
        f" THEN IF({little}, {backward}, unhex(array_join({texts}, ''))) END",
    )
    element = f"IF({type_code} IN ({RATIONAL}, {SRATIONAL}), '{_FRACTION}', '{_WHOLE}')"
    return f"""CASE
        WHEN {type_code} = {ASCII} THEN concat(encode({value}, 'UTF-8'), X'00')
        WHEN {type_code} = {UNDEFINED} THEN CASE WHEN length({value}) % 2 = 0 THEN unhex({value}) END
        WHEN {type_code} IN ({FLOAT}, {DOUBLE}) THEN NULL
        WHEN forall(split({value}, ' '), e -> e RLIKE {element}) THEN {packed} END"""


def fitted(value: str, type_code: str) -> str:
    """What a value given as text is once it has been written and read again: a
    struct of its element count and its text; NULL if it does not suit the type."""
    count = f"CAST(length(raw) DIV {width(type_code)} AS BIGINT)"
    read = value_text("raw", type_code, "n", "FALSE")
    told = let(count, "n", f"struct(n AS count, {read} AS value)")
    return let(value_bytes(value, type_code, "FALSE"), "raw", f"CASE WHEN raw IS NOT NULL THEN {told} END")


def as_numbers(value: Column) -> Column:
    """ARRAY<BIGINT> of a whole-number value."""
    return F.transform(F.split(value, " "), lambda n: n.try_cast("bigint"))


def as_rationals(value: Column) -> Column:
    """ARRAY<STRUCT<num, den>> of a rational value."""
    return F.transform(
        F.split(value, " "),
        lambda t: F.struct(
            F.get(F.split(t, "/"), F.lit(0)).try_cast("bigint").alias("num"),
            F.get(F.split(t, "/"), F.lit(1)).try_cast("bigint").alias("den"),
        ),
    )


def as_timestamp(value: Column) -> Column:
    """A date value, which names no time zone; NULL for an all-zero date."""
    iso = F.regexp_replace(value, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    return iso.try_cast("timestamp_ntz")


def as_degrees(value: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as one number, negative for S and W."""
    parts = F.transform(
        as_rationals(value), lambda r: F.try_divide(r["num"].cast("double"), r["den"])
    )
    size = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60 + F.get(parts, F.lit(2)) / 3600
    return F.when(ref.isin("S", "W"), -size).otherwise(size)
