"""Walking the marker segments of a JPEG file.

A segment is FF, a marker byte, and a big-endian length that counts itself. The
walk goes from segment to segment, so the marker text inside some other segment
is never taken for an Exif segment.
"""

from __future__ import annotations

from tagloom.functions.bytes import cut, let

# Fixed values of the JPEG and Exif file formats, as hex text.
START_OF_IMAGE = "FFD8"
FILL = "FFFF"
STOPS = ("FFD9", "FFDA")  # end of image, start of scan
BARE = (  # markers without a length
    "FF01", "FFD0", "FFD1", "FFD2", "FFD3", "FFD4", "FFD5", "FFD6", "FFD7", "FFD8",
)
APP1 = "FFE1"
EXIF = "457869660000"  # "Exif" and two zero bytes
EXIF_HEADER = 10  # marker, length and the six bytes above

_STATE = "STRUCT<pos: BIGINT, at: BIGINT, exif: ARRAY<STRUCT<start: BIGINT, size: BIGINT>>>"


def _walk(content: str, only_first: bool = False) -> str:
    """The walk's last state: where it stopped (``at``, NULL for no JPEG file), and the start
    and size of the Exif segments, all or the first, in file order.

    Nearly all files end their header within a few segments, so the first 64
    steps have a loop of their own. What is left over goes through one that has
    a step for every byte: no file is given up on.
    """
    begin = (
        f"CASE WHEN hex(substring({content}, 1, 2)) = '{START_OF_IMAGE}' THEN 2L END AS pos,"
        " CAST(NULL AS BIGINT) AS at, array() AS exif"
    )
    step = f"(s, i) -> IF(s.pos IS NULL, s, {_advance(content, 's', only_first)})"

    def walk(state: str, side: str) -> str:
        """Up to side * side steps; a round of them costs nothing once at the end."""
        one_round = f"IF(o.pos IS NULL, o, aggregate(sequence(1, {side}), o, {step}))"
        return f"aggregate(sequence(1, {side}), {state}, (o, j) -> {one_round})"

    side = f"CAST(ceil(sqrt(length({content}))) AS INT)"
    rest = f"IF(w.pos IS NULL, w, {walk('w', side)})"
    return let(walk(f"CAST(struct({begin}) AS {_STATE})", "8"), "w", rest)


def exif_segments(content: str, only_first: bool = False) -> str:
    """Start and size of the Exif segments, all or the first, in file order."""
    return _walk(content, only_first) + ".exif"


def header_and_rest(content: str) -> str:
    """A struct of the bytes before the first scan and of all that follow them. What is no
    JPEG file has an empty header; one that is cut off is a header as a whole."""
    size = f"coalesce({_walk('c')}.at, 0L)"
    parts = f"struct({cut('c', '0', 'n')} AS header, {cut('c', 'n', 'length(c)')} AS picture)"
    return let(content, "c", let(size, "n", parts))


def _advance(content: str, state: str, only_first: bool) -> str:
    marker = "left(h, 4)"
    size = "CAST(conv(substring(h, 5, 4), 16, 10) AS BIGINT)"
    is_exif = f"({marker} = '{APP1}' AND substring(h, 9, 12) = '{EXIF}' AND {size} >= 8)"
    after = f"""CASE
        WHEN length(h) < 8 OR NOT startswith(h, 'FF') OR {marker} IN {STOPS} THEN NULL
        WHEN {marker} = '{FILL}' THEN {state}.pos + 1
        WHEN {marker} IN {BARE} THEN {state}.pos + 2
        {f"WHEN {is_exif} THEN NULL" if only_first else ""}
        WHEN {size} >= 2 THEN {state}.pos + 2 + {size} END"""
    found = f"array(struct({state}.pos AS start, {size} + 2 AS size))"
    exif = f"IF({is_exif}, concat({state}.exif, {found}), {state}.exif)"
    return let(
        f"hex({cut(content, f'{state}.pos', EXIF_HEADER)})",
        "h",
        f"CAST(struct({after} AS pos, {state}.pos AS at, {exif} AS exif) AS {_STATE})",
    )


def first_exif(content: str) -> str:
    """Where the first Exif segment starts, and the block behind its header."""
    block = cut("c", f"s.start + {EXIF_HEADER}", f"s.size - {EXIF_HEADER}")
    return let(
        content,
        "c",
        f"try_element_at(transform({exif_segments('c', only_first=True)},"
        f" s -> struct(s.start AS start, {block} AS block)), 1)",
    )


def without_exif(content: str) -> str:
    """The bytes before, between and behind the Exif segments."""
    piece = cut("c", "acc.pos", "t.start - acc.pos")
    # The picture itself lies behind the last segment: it is copied once.
    kept = f"""aggregate(found, struct(0L AS pos, X'' AS head),
        (acc, t) -> struct(t.start + t.size AS pos, concat(acc.head, {piece}) AS head),
        acc -> concat(acc.head, {cut('c', 'acc.pos', 'length(c)')}))"""
    return let(
        content, "c", let(exif_segments("c"), "found", f"IF(size(found) > 0, {kept}, c)")
    )
