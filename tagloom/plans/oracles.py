"""The same results in plain SQL, from the columns the images were made of."""

from __future__ import annotations

from tagloom.plans.collection import (
    BEFORE, END, EXIF_AT, GPS_AT, INTEROP_AT, SCAN,
)

_TAKEN = (
    "replace(CAST(DATE '2020-01-01' + CAST(n_chars % 3650 AS INTEGER) AS VARCHAR), '-', ':')"
    " || ' 12:00:00'"
)
_SOUTH = "CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE 'N' END"
_LATITUDE = (
    "(n_chars % 90) || '/1 ' || (n_chars % 60) || '/1 ' || (n_chars % 6000) || '/100'"
)

# ifd, tag, type, count, value
_TAGS = [
    ("ifd0", 271, 2, "strlen(source) + 1", "source"),
    ("ifd0", 274, 3, "1", "n_chars % 8 + 1"),
    ("ifd0", 282, 5, "1", "n_chars || '/72'"),
    ("ifd0", 315, 2, "strlen(lang) + 1", "lang"),
    ("ifd0", 34665, 4, "1", f"{EXIF_AT}"),
    ("ifd0", 34853, 4, "1", f"{GPS_AT}"),
    ("exif", 36867, 2, "20", _TAKEN),
    ("exif", 37121, 7, "4", "'01020300'"),
    ("exif", 37380, 10, "1", "-(n_chars % 7) || '/3'"),
    ("exif", 37500, 7, "16", "upper(md5(text))"),
    ("exif", 40962, 4, "1", "n_chars"),
    ("exif", 40965, 4, "1", f"{INTEROP_AT}"),
    ("exif", 42016, 2, "33", "md5(text)"),
    ("gps", 0, 1, "4", "'2 3 0 0'"),
    ("gps", 1, 2, "2", _SOUTH),
    ("gps", 2, 5, "3", _LATITUDE),
    ("interop", 1, 2, "4", "'R98'"),
    ("ifd1", 259, 3, "1", "6"),
]

TAGS = "\nUNION ALL ".join(
    f"SELECT doc_id AS item_id, '{ifd}' AS ifd, {tag} AS tag, {code} AS type,"
    f" CAST({count} AS BIGINT) AS count, CAST({value} AS VARCHAR) AS value FROM documents"
    for ifd, tag, code, count, value in _TAGS
)

_SHOWN = f"""
SELECT doc_id AS item_id, source AS Make, CAST(n_chars % 8 + 1 AS VARCHAR) AS Orientation,
       n_chars || '/72' AS XResolution, lang AS Artist, CAST(NULL AS VARCHAR) AS Copyright,
       {_TAKEN} AS DateTimeOriginal, -(n_chars % 7) || '/3' AS ExposureBiasValue,
       CAST(n_chars AS VARCHAR) AS PixelXDimension, md5(text) AS ImageUniqueID,
       {_SOUTH} AS GPSLatitudeRef, {_LATITUDE} AS GPSLatitude, '6' AS ifd1_259
FROM documents
"""

_EDITS = """
SELECT doc_id AS item_id, 'ifd0' AS ifd, 271 AS tag, 1 AS seq,
       'a draft that is longer than any slot' AS new_value FROM labels
UNION ALL SELECT doc_id, 'ifd0', 271, 2, CASE WHEN quality = 1 THEN 'lab' ELSE 'raw' END FROM labels
UNION ALL SELECT doc_id, 'ifd0', 315, 7, 'me' FROM labels
UNION ALL SELECT doc_id, 'ifd0', 315, 7, CASE WHEN toxic = 1 THEN NULL ELSE 'us' END FROM labels
UNION ALL SELECT doc_id, 'ifd0', 274, 3, '1' FROM labels
UNION ALL SELECT doc_id, 'ifd0', 274, 3, CAST(doc_id % 8 + 1 AS VARCHAR) FROM labels
UNION ALL SELECT doc_id, 'ifd0', 274, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 4 END,
       CASE WHEN doc_id % 3 = 0 THEN '0' || (doc_id % 8 + 1) ELSE 'six' END FROM labels
UNION ALL SELECT doc_id, 'exif', 37500, 1,
       CASE WHEN quality = 1 THEN 'a1b2c3d4e5f6' ELSE 'abc' END FROM labels
UNION ALL SELECT doc_id, 'ifd0', 34665, 1, CASE WHEN toxic = 1 THEN NULL ELSE '8' END FROM labels
UNION ALL SELECT doc_id, 'exif', 42016, 1,
       CASE WHEN quality = 1 THEN 'doc-' || doc_id ELSE repeat('x', 40) END FROM labels
UNION ALL SELECT doc_id, 'ifd0', 33432, 1, CASE WHEN toxic = 1 THEN NULL ELSE 'public' END FROM labels
"""

_LAST = """
SELECT item_id, ifd, tag, new_value FROM (
    SELECT *, row_number() OVER (
        PARTITION BY item_id, ifd, tag
        ORDER BY seq DESC, (new_value IS NULL) DESC, new_value DESC) AS place
    FROM edits) WHERE place = 1
"""

# Of the edited tags 274 is a SHORT number and 37500 is UNDEFINED; the others are text.
_JUDGED = """
SELECT *,
       CASE WHEN tag = 274 THEN 1 WHEN tag = 37500 THEN length(new_value) // 2
            ELSE strlen(new_value) + 1 END AS new_count,
       CASE WHEN tag = 274 THEN CAST(try_cast(new_value AS BIGINT) AS VARCHAR)
            WHEN tag = 37500 THEN upper(new_value) ELSE new_value END AS fitted,
       CASE WHEN tag IN (34665, 34853, 40965) THEN 'points to a directory'
            WHEN tag = 274 AND NOT (regexp_full_match(new_value, '-?[0-9]+')
                 AND try_cast(new_value AS BIGINT) BETWEEN 0 AND 65535)
            THEN 'value does not suit the type'
            WHEN tag = 37500 AND NOT regexp_full_match(new_value, '([0-9A-Fa-f]{2})*')
            THEN 'value does not suit the type' END AS reason
FROM last
"""

_EDITED = """
SELECT item_id, ifd, tag, coalesce(t.type, 2) AS type,
       CASE WHEN l.item_id IS NULL THEN t.count ELSE CAST(new_count AS BIGINT) END AS count,
       CASE WHEN l.item_id IS NULL THEN t.value ELSE fitted END AS value
FROM tags t {join} JOIN {edits} l USING (item_id, ifd, tag)
WHERE l.item_id IS NULL OR new_value IS NOT NULL
"""

_FITS = "reason IS NULL AND tag <> 33432 AND coalesce(strlen(new_value), 0) < 40"

_ARTWORK = f"unhex('{BEFORE}') || unhex('{SCAN}') || encode(text) || unhex('{END}')"
# Marker, length and header of the Exif segment, and the block up to the main
# directory's variable values; those of more than four bytes lie behind.
_EXIF_SIZE = (
    "10 + 277 + 2 + 6 * 12 + 4 + 8"
    " + CASE WHEN strlen(source) > 3 THEN strlen(source) + 1 ELSE 0 END"
    " + CASE WHEN strlen(lang) > 3 THEN strlen(lang) + 1 ELSE 0 END"
)

ORACLES: dict[str, str] = {
    "decode_tags": TAGS,
    "decode_some_tags": f"""
        WITH tags AS ({TAGS})
        SELECT * FROM tags
        WHERE (ifd, tag) IN (('ifd0', 271), ('gps', 2), ('interop', 1))""",
    "view_tags": _SHOWN,
    "view_images": _SHOWN,
    "view_typed": f"""
        SELECT doc_id AS item_id, CAST(n_chars % 8 + 1 AS INTEGER) AS orientation,
               CAST(n_chars AS BIGINT) AS x_num, CAST(72 AS BIGINT) AS x_den,
               strptime({_TAKEN}, '%Y:%m:%d %H:%M:%S') AS taken,
               (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END)
               * (CAST(n_chars % 90 AS DOUBLE) + CAST(n_chars % 60 AS DOUBLE) / 60
                  + CAST(n_chars % 6000 AS DOUBLE) / 100 / 3600) AS latitude
        FROM documents""",
    "last_edits": f"WITH edits AS ({_EDITS}) {_LAST}",
    "apply_edits": f"""
        WITH tags AS ({TAGS}), edits AS ({_EDITS}), last AS ({_LAST}), judged AS ({_JUDGED}),
             done AS (SELECT * FROM judged WHERE reason IS NULL)
        {_EDITED.format(join="FULL OUTER", edits="done")}""",
    "refused_edits": f"""
        WITH edits AS ({_EDITS}), last AS ({_LAST}), judged AS ({_JUDGED})
        SELECT item_id, ifd, tag, reason FROM judged WHERE reason IS NOT NULL""",
    "strip_metadata": f"""
        SELECT doc_id AS item_id, CAST(octet_length({_ARTWORK}) AS BIGINT) AS size,
               md5({_ARTWORK}) AS digest FROM documents""",
    "patch_tags": f"""
        WITH tags AS ({TAGS}), edits AS ({_EDITS}), last AS ({_LAST}), judged AS ({_JUDGED}),
             done AS (SELECT * FROM judged WHERE {_FITS})
        {_EDITED.format(join="LEFT", edits="done")}""",
    "patch_rejected": f"""
        WITH edits AS ({_EDITS}), last AS ({_LAST}), judged AS ({_JUDGED})
        SELECT item_id, ifd, tag,
               CASE WHEN tag = 33432 THEN 'no such tag'
                    ELSE coalesce(reason, 'longer than its slot') END AS reason
        FROM judged WHERE NOT ({_FITS})
          AND item_id IN (SELECT doc_id FROM documents)""",
    "patch_picture": f"""
        SELECT doc_id AS item_id,
               CAST(octet_length({_ARTWORK}) + {_EXIF_SIZE} AS BIGINT) AS size,
               md5({_ARTWORK}) AS digest FROM documents""",
    "compare_manifests": f"""
        WITH files AS (
            SELECT doc_id AS item_id, CAST(octet_length({_ARTWORK}) + {_EXIF_SIZE} AS BIGINT) AS length FROM documents
        ), labelled AS (
            SELECT item_id, length, quality, toxic FROM files JOIN labels ON doc_id = item_id
        )
        SELECT item_id, 'new' AS change, length FROM files WHERE item_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL
        SELECT item_id, CASE WHEN quality = 1 AND toxic <> 1 THEN 'same' ELSE 'changed' END, length FROM labelled
        UNION ALL
        SELECT -1 - item_id, 'removed', CASE WHEN quality = 1 THEN length ELSE length + 1 END
        FROM labelled WHERE toxic = 1""",
}
for _name, _same in [
    ("decode_headers", "decode_tags"), ("strip_headers", "strip_metadata"), ("patch_headers", "patch_picture"),
]:
    ORACLES[_name] = ORACLES[_same]
