"""Writing edited values into an image without moving anything.

An Exif block keeps its length: a shorter value is padded with zeros in its old
slot, and a removed entry closes up its directory, which ends in zeros then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagloom.functions.bytes import chain, count_up, cut, let, number_bytes, zeros
from tagloom.functions.directories import IFDS, POINTERS, layout, slots, width
from tagloom.functions.segments import EXIF_HEADER, first_exif
from tagloom.functions.values import value_bytes

# Reasons for not doing an edit.
NO_BLOCK = "no Exif block"
NO_TAG = "no such tag"
IS_POINTER = "points to a directory"
OUTSIDE = "slot outside the block"
SHARED = "bytes shared with another entry"
BAD_VALUE = "value does not suit the type"
TOO_LONG = "longer than its slot"

_REJECTED = "ARRAY<STRUCT<ifd: STRING, tag: INT, reason: STRING>>"


def addressable(ifd: str, tag: str) -> str:
    """SQL: whether a file can hold a tag of this number and directory."""
    names = ", ".join(f"'{name}'" for name in IFDS)
    return f"({tag} BETWEEN 0 AND 65535 AND {ifd} IN ({names}))"


def is_pointer(ifd: str, tag: str) -> str:
    """SQL: whether the tag holds the position of a directory."""
    return "(" + " OR ".join(f"({ifd} = '{name}' AND {tag} = {n})" for name, n, _ in POINTERS) + ")"


def with_patches(images: DataFrame) -> DataFrame:
    """item_id, content, rejected from item_id, content, edits.

    ``edits`` is an array of (ifd, tag, value) with at most one per tag, NULL
    for an image that is not edited: its bytes are not even looked at.
    """
    exif = f"CASE WHEN edits IS NOT NULL THEN {first_exif('content')} END"
    parts = chain(
        [
            ("layout", layout("exif.block")),
            ("little", "layout.little"),
            ("dirs", "layout.dirs"),
            ("slots", slots()),
            ("claims", _claims()),
        ],
        f"struct(little, dirs, slots, {_crowded_dirs()} AS crowded_dirs, {_crowded()} AS crowded)",
    )
    steps = [
        ("block", "exif.block"),
        ("wanted", _by_key()),
        ("plans", _paired()),
        ("plans", _with_reason()),
        ("accepted", _accepted()),
        ("patched", f"CASE WHEN size(accepted) > 0 THEN {_written()} END"),
        ("losing", _losing()),
    ]
    patched = f"CASE WHEN patched IS NOT NULL THEN {_closed_up()} END"
    done = chain(steps, f"struct({patched} AS block, {_rejected()} AS rejected)")
    after = f"CAST(exif.start AS INT) + {EXIF_HEADER + 1}"
    content = f"IF(done.block IS NULL, content, overlay(content PLACING done.block FROM {after}))"
    rejected = f"coalesce(done.rejected, CAST(array() AS {_REJECTED}))"
    result = f"struct({content} AS content, {rejected} AS rejected)"
    # One row in, one row out. Spark pushes no filter through a generator: one
    # on ``rejected`` would otherwise repeat all of the above below it.
    return (
        images.selectExpr("item_id", "content", "edits", f"{exif} AS exif")
        .selectExpr("*", f"CASE WHEN exif IS NOT NULL THEN {parts} END AS parts")
        .selectExpr("*", f"CASE WHEN edits IS NOT NULL THEN {done} END AS done")
        .selectExpr("item_id", f"inline_outer(array({result}))")
    )


def _key(x: str) -> str:
    """One number for a directory and tag; NULL for a tag that no file can hold."""
    names = ", ".join(f"'{ifd}'" for ifd in IFDS)
    return f"(array_position(array({names}), {x}.ifd) * 65536 + {x}.tag)"


def _by_key() -> str:
    """The edits by key: a file has many entries and may have many edits."""
    valid = "filter(edits, e -> e.ifd IS NOT NULL)"
    return let(valid, "v", f"map_from_arrays(transform(v, e -> {_key('e')}), v)")


def _claims() -> str:
    """The bytes that the header, the directories and the values lie on, in order. Only the
    main directory needs the position behind its entries; some writers save it
    in the others."""
    return """array_sort(concat(
        array(struct(0L AS start, 8L AS end)),
        transform(dirs, d -> struct(d.pos AS start,
                                    d.pos + IF(d.ifd = 'ifd0', 6, 2) + d.n * 12 AS end)),
        transform(filter(slots, s -> s.size > 4),
                  s -> struct(s.pos AS start, s.pos + s.size AS end))))"""


def _crowded_dirs() -> str:
    """For each directory whether anything else lies on it: on the entries, and on the
    4-byte position behind them, too, which closing up a directory moves."""

    def crowded(behind: int) -> str:
        others = f"c.start < d.pos + d.n * 12 + {behind} AND c.end > d.pos"
        return f"size(filter(claims, c -> {others})) > 1"

    return f"transform(dirs, d -> struct(d.ifd AS ifd, {crowded(2)} AS entries, {crowded(6)} AS all))"


def _crowded() -> str:
    """Where the values start that share a byte with another claim. In order of their starts, a claim
    meets an earlier one if it starts before the furthest end so far, and a later
    one if the next starts before its own end."""
    meets = """c.start < acc.far OR coalesce(get(claims, size(acc.found) + 1).start < c.end, FALSE)"""
    found = f"concat(acc.found, array(IF({meets}, c.start, NULL)))"
    walked = f"""aggregate(claims, struct(-1L AS far, CAST(array() AS ARRAY<BIGINT>) AS found),
        (acc, c) -> struct(greatest(acc.far, c.end) AS far, {found} AS found), acc -> acc.found)"""
    return f"array_distinct(filter({walked}, x -> x IS NOT NULL))"


def _paired() -> str:
    """The slots that have an edit, each with its edit and the bytes that this writes."""
    pairs = f"transform(parts.slots, s -> struct(s, try_element_at(wanted, {_key('s')}) AS e))"
    both = f"""struct(q.s.ifd AS ifd, q.s.tag AS tag, q.s.type AS type, q.s.entry AS entry,
        q.s.pos AS pos, q.s.size AS size, q.e.value IS NULL AS removes,
        {value_bytes('q.e.value', 'q.s.type', 'parts.little')} AS data)"""
    return f"transform(filter({pairs}, q -> q.e IS NOT NULL), q -> {both})"


def _with_reason() -> str:
    shared = """exists(parts.crowded_dirs, d -> d.ifd = p.ifd AND IF(p.removes, d.all, d.entries))
        OR (p.size > 4 AND array_contains(parts.crowded, p.pos))"""
    reason = f"""CASE WHEN {is_pointer('p.ifd', 'p.tag')} THEN '{IS_POINTER}'
        WHEN p.size IS NULL OR p.pos + p.size > length(block) THEN '{OUTSIDE}'
        WHEN {shared} THEN '{SHARED}'
        WHEN p.removes THEN NULL
        WHEN p.data IS NULL THEN '{BAD_VALUE}'
        WHEN length(p.data) > greatest(p.size, 4) THEN '{TOO_LONG}' END"""
    return f"""transform(plans, p -> struct({_key('p')} AS key, p.ifd AS ifd, p.entry AS entry,
        p.pos AS pos, p.size AS size, p.removes AS removes, p.data AS data,
        CAST(length(p.data) DIV {width('p.type')} AS BIGINT) AS count, {reason} AS reason))"""


def _accepted() -> str:
    """The plans of edits that can be done in every entry they are for."""
    spoilt = "array_distinct(transform(filter(plans, p -> p.reason IS NOT NULL), p -> p.key))"
    return let(spoilt, "refused", "filter(plans, p -> NOT array_contains(refused, p.key))")


def _put(block: str, data: str, start: str) -> str:
    return f"overlay({block} PLACING {data} FROM CAST({start} + 1 AS INT))"


def _written() -> str:
    """The block with new counts and values; what a shorter value leaves over
    becomes zeros."""
    data = "coalesce(p.data, X'')"

    def padded(size: str) -> str:
        return f"concat({data}, {zeros(f'{size} - length({data})')})"

    inline = f"length({data}) <= 4"
    slot = f"IF({inline}, {zeros('p.size')}, {padded('p.size')})"
    field = f"IF({inline}, {padded('4')}, {cut('b', 'p.entry + 8', 4)})"
    entry = f"concat({number_bytes('p.count', 4, 'parts.little')}, {field})"
    clean = f"IF(p.size > 4, {_put('b', slot, 'p.pos')}, b)"
    one = f"IF(p.removes, {clean}, {_put(clean, entry, 'p.entry + 4')})"
    return f"aggregate(accepted, block, (b, p) -> {one})"


def _losing() -> str:
    """The directories that lose entries, with the places of those they keep."""
    places = f"transform({count_up('d.n')}, k -> d.pos + 2 + k * 12)"
    own = "filter(accepted, p -> p.removes AND p.ifd = d.ifd)"
    kept = f"array_except({places}, {own}.entry)"
    return f"""filter(transform(parts.dirs, d -> struct(d.pos AS pos, d.n AS n, {kept} AS kept)),
        d -> size(d.kept) < d.n)"""


def _closed_up() -> str:
    """The patched block with those directories closed up."""
    entries = f"unhex(array_join(transform(d.kept, e -> hex({cut('b', 'e', 12)})), ''))"
    whole = f"""concat({number_bytes('size(d.kept)', 2, 'parts.little')}, {entries},
        {cut('b', '(d.pos + 2 + d.n * 12)', 4)}, {zeros('(d.n - size(d.kept)) * 12')})"""
    return f"aggregate(losing, patched, (b, d) -> {_put('b', whole, 'd.pos')})"


def _rejected() -> str:
    """The edits that were not done, each with its reason; of several reasons the last by letter."""
    told = "array_sort(transform(plans, p -> struct(p.key AS key, coalesce(p.reason, '') AS reason)))"
    last = "filter(told, (r, i) -> coalesce(get(told, i + 1).key <> r.key, TRUE))"
    reasons = let(told, "told", f"map_from_entries({last})")
    reason = f"""CASE WHEN parts.little IS NULL THEN '{NO_BLOCK}'
        ELSE coalesce(try_element_at(reasons, {_key('e')}), '{NO_TAG}') END"""
    judged = f"transform(edits, e -> struct(e.ifd AS ifd, e.tag AS tag, {reason} AS reason))"
    return let(reasons, "reasons", f"CAST(filter({judged}, r -> r.reason <> '') AS {_REJECTED})")
