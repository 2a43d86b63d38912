"""Tag directories inside an Exif block.

A block starts with its byte order and the position of its first directory. A
directory is a 2-byte count, 12 bytes per entry (tag 2, type 2, count 4, value
or position 4) and the position of the next directory. Values of at most 4
bytes lie in the entry itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from tagloom.functions.bytes import big_endian, chain, count_up, cut, let, number

# Fixed values of the TIFF and Exif file formats.
# Bytes per element, by type code: 1 BYTE, 2 ASCII, 3 SHORT, 4 LONG, 5 RATIONAL,
# 6 SBYTE, 7 UNDEFINED, 8 SSHORT, 9 SLONG, 10 SRATIONAL, 11 FLOAT, 12 DOUBLE, 13 IFD.
WIDTHS = "NULL, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4"
LITTLE = "4949"
BIG = "4D4D"
# Entries that hold the position of another directory, by directory.
POINTERS = [
    ("ifd0", 0x8769, "exif"),
    ("ifd0", 0x8825, "gps"),
    ("exif", 0xA005, "interop"),
]
IFDS = ["ifd0", "exif", "gps", "interop", "ifd1"]


def width(type_code: str) -> str:
    return f"get(array({WIDTHS}), {type_code})"


def layout(block: str) -> str:
    """The layout of a block: its byte order ``little`` (NULL if unreadable) and
    its directories ``dirs``, an array of (ifd, pos, n, entries).

    The set is fixed by the format: the main directory, the thumbnail's after
    it, and those the pointer entries name. Hence no recursion, and a pointer
    that leads back to its own directory does no harm.
    """
    mark = "hex(substring(b, 1, 2))"
    little = f"CASE {mark} WHEN '{LITTLE}' THEN TRUE WHEN '{BIG}' THEN FALSE END"
    main = number("b", "IF(little IS NULL, NULL, 4L)", 4, "little")
    after_main = number("b", "(ifd0.pos + 2 + ifd0.n * 12)", 4, "little")
    steps = [
        ("b", block),
        ("little", little),
        ("ifd0", _directory(main)),
        ("exif", _target("ifd0", "exif")),
        ("interop", _target("exif", "interop")),
    ]
    places = {
        "ifd0": "ifd0",
        "exif": "exif",
        "gps": _target("ifd0", "gps"),
        "interop": "interop",
        "ifd1": _directory(after_main),
    }
    found = ", ".join(f"struct('{ifd}' AS ifd, {d} AS d)" for ifd, d in places.items())
    dirs = f"""transform(filter(array({found}), x -> x.d IS NOT NULL),
        x -> struct(x.ifd AS ifd, x.d.pos AS pos, x.d.n AS n, x.d.entries AS entries))"""
    return chain(steps, f"struct(little, {dirs} AS dirs)")


def slots(tags: Iterable[int] | None = None) -> str:
    """One struct per entry of all ``dirs``, or per entry with one of ``tags``.

    ``entry`` is where the entry starts, ``pos`` and ``size`` where the value
    lies; ``size`` is NULL for a type code that the format does not know.
    """
    head = f"""struct(d.ifd AS ifd, {_tag('e')} AS tag, {_type('e')} AS type,
        {_count('e')} AS count, d.pos + 2 + k * 12 AS entry, {_field('e')} AS field)"""
    if tags is not None:
        # Compared as hex text, before any number is read.
        listed = ", ".join(f"'{tag:04X}'" for tag in sorted(set(tags)))
        head = f"IF(IF(little, right(e, 4), left(e, 4)) IN ({listed}), {head}, NULL)"
    heads = f"flatten(transform(dirs, d -> transform(d.entries, (e, k) -> {head})))"
    if tags is not None:
        heads = f"filter({heads}, h -> h IS NOT NULL)"
    size = f"h.count * {width('h.type')}"
    slot = f"""struct(h.ifd AS ifd, h.tag AS tag, h.type AS type, h.count AS count,
        h.entry AS entry, IF({size} <= 4, h.entry + 8, h.field) AS pos, {size} AS size)"""
    return f"transform({heads}, h -> {slot})"


def _directory(position: str) -> str:
    """The directory at a position in the block ``b``, as (pos, n, entries); NULL
    unless it lies wholly inside the block.

    The entries are hex text, each turned around as a whole if little-endian:
    then every number in it reads big-endian, but the last number comes first.
    """
    all_entries = big_endian(cut("b", "d.pos + 2", "d.n * 12"), "little")
    one = "hex(substring(r, IF(little, d.n - 1 - k, k) * 12 + 1, 12))"
    entries = let(all_entries, "r", f"transform({count_up('d.n')}, k -> {one})")
    n = f"CAST({number('b', 'p.pos', 2, 'little')} AS INT)"
    inside = "d.pos > 0 AND d.pos + 2 + d.n * 12 <= length(b)"
    return chain(
        [("p", f"struct({position} AS pos)"), ("d", f"struct(p.pos AS pos, {n} AS n)")],
        f"CASE WHEN {inside} THEN struct(d.pos AS pos, d.n AS n, {entries} AS entries) END",
    )


def _from_hex(digits: str, kind: str) -> str:
    return f"CAST(conv({digits}, 16, 10) AS {kind})"


def _tag(e: str) -> str:
    return _from_hex(f"IF(little, right({e}, 4), left({e}, 4))", "INT")


def _type(e: str) -> str:
    return _from_hex(f"IF(little, substring({e}, 17, 4), substring({e}, 5, 4))", "INT")


def _count(e: str) -> str:
    return _from_hex(f"substring({e}, 9, 8)", "BIGINT")


def _field(e: str) -> str:
    return _from_hex(f"IF(little, left({e}, 8), right({e}, 8))", "BIGINT")


def _target(source: str, name: str) -> str:
    """The directory that the first entry of its pointer tag leads to. Such an
    entry is one LONG or IFD number, so the position is in the entry itself."""
    tag = next(t for ifd, t, target in POINTERS if (ifd, target) == (source, name))
    big = f"startswith(e, '{tag:04X}') AND substring(e, 5, 4) IN ('0004', '000D')"
    small = f"endswith(e, '{tag:04X}') AND substring(e, 17, 4) IN ('0004', '000D')"
    one = f"substring(e, 9, 8) = '00000001' AND IF(little, {small}, {big})"
    first = f"get(filter({source}.entries, e -> {one}), 0)"
    return _directory(let(first, "f", _field("f")))
