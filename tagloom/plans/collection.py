"""A collection of images and edits that Spark derives from the given tables.

No given table holds images. ``documents`` becomes one JPEG file per row: the
text is the picture data, the other columns are the tags. Even documents are
little-endian, odd ones big-endian. ``labels`` becomes edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.bytes import number_bytes

# The files around the Exif block, as hex text. A comment segment holds the Exif
# marker text twice, once half a byte off: a search would be fooled, a walk is not.
BEFORE = "FFD8" + "FFFE0010" + "457869660000" + "04578696600000" + "00"
SCAN = "FFDA0008010100003F00"
END = "FFD9"
EXIF_TEXT = "457869660000"

# Where the directories start that do not depend on the row's data.
EXIF_AT, GPS_AT, INTEROP_AT, IFD1_AT, IFD0_AT = 8, 175, 241, 259, 277


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, content: one image per document."""
    block = f"IF(doc_id % 2 = 0, {_block(True)}, {_block(False)}) AS block"
    size = number_bytes("length(block) + 8", 2, "FALSE")
    content = f"""concat(X'{BEFORE}', X'FFE1', {size}, X'{EXIF_TEXT}', block,
        X'{SCAN}', encode(text, 'UTF-8'), X'{END}') AS content"""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("*", "md5(encode(text, 'UTF-8')) AS digest")
        .selectExpr("doc_id AS item_id", "text", block)
        .selectExpr("item_id", content)
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, tag, seq, value: eleven edits per labelled document."""
    rows = ", ".join(
        f"struct({tag} AS tag, CAST({seq} AS BIGINT) AS seq, {value} AS value)"
        for tag, seq, value in [
            # Make: the later edit wins; three letters always fit.
            (271, 1, "'a draft that is longer than any slot'"),
            (271, 2, "IF(quality = 1, 'lab', 'raw')"),
            # Artist: on equal seq a removal wins over a value.
            (315, 7, "'me'"),
            (315, 7, "IF(toxic = 1, NULL, 'us')"),
            # Orientation: on equal seq the larger value wins.
            (274, 3, "'1'"),
            (274, 3, "CAST(doc_id % 8 + 1 AS STRING)"),
            # A padded number, or none at all; for a third of the images out of date.
            (274, "IF(doc_id % 3 = 2, 0, 4)", "IF(doc_id % 3 = 0, concat('0', doc_id % 8 + 1), 'six')"),
            # Hex digits in lower case, or an odd number of them.
            (37500, 1, "IF(quality = 1, 'a1b2c3d4e5f6', 'abc')"),
            # A tag that points to a directory.
            (34665, 1, "IF(toxic = 1, NULL, '8')"),
            # A tag of another directory; shorter than before, or far too long.
            (42016, 1, "IF(quality = 1, concat('doc-', doc_id), repeat('x', 40))"),
            # A tag that no image has.
            (33432, 1, "IF(toxic = 1, NULL, 'public')"),
        ]
    )
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS item_id", f"inline(array({rows}))"
    )


def _block(little: bool) -> str:
    """SQL for the Exif block of a document: each directory, then its values."""
    order = "TRUE" if little else "FALSE"

    def num(value: str | int, size: int) -> str:
        if isinstance(value, int):
            return f"X'{value.to_bytes(size, 'little' if little else 'big').hex()}'"
        return number_bytes(f"CAST({value} AS BIGINT)", size, order)

    def text(value: str) -> str:
        return f"encode({value}, 'UTF-8'), X'00'"

    def pair(top: str | int, bottom: int) -> str:
        return f"{num(top, 4)}, {num(bottom, 4)}"

    def directory(start: int, entries: list[tuple], after: int = 0) -> str:
        """``entries``: (tag, type, count, data, size); a size may be an expression."""
        place: int | str = start + 2 + 12 * len(entries) + 4
        heads, values = [], []
        for tag, code, count, data, size in entries:
            if isinstance(size, int):
                short = size <= 4
                field = f"{data}, X'{'00' * (4 - size)}'" if short else num(place, 4)
                value, room = ("X''", 0) if short else (data, size)
            else:
                padding = f"unhex(repeat('00', 4 - {size}))"
                field = f"IF({size} <= 4, concat({data}, {padding}), {num(place, 4)})"
                value = f"IF({size} <= 4, X'', concat({data}))"
                room = f"IF({size} <= 4, 0, {size})"
            heads.append(f"{num(tag, 2)}, {num(code, 2)}, {num(count, 4)}, {field}")
            values.append(value)
            both_known = isinstance(place, int) and isinstance(room, int)
            place = place + room if both_known else f"{place} + {room}"
        return ", ".join([num(len(entries), 2), *heads, num(after, 4), *values])

    day = "CAST(date_add(DATE'2020-01-01', CAST(n_chars % 3650 AS INT)) AS STRING)"
    taken = f"concat(replace({day}, '-', ':'), ' 12:00:00')"
    latitude = [pair("n_chars % 90", 1), pair("n_chars % 60", 1), pair("n_chars % 6000", 100)]
    source, lang = "(octet_length(source) + 1)", "(octet_length(lang) + 1)"
    exif = [
        (36867, 2, 20, text(taken), 20),
        (37121, 7, 4, "X'01020300'", 4),
        (37380, 10, 1, pair("-(n_chars % 7)", 3), 8),
        (37500, 7, 16, "unhex(digest)", 16),
        (40962, 4, 1, num("n_chars", 4), 4),
        (40965, 4, 1, num(INTEROP_AT, 4), 4),
        (42016, 2, 33, text("digest"), 33),
    ]
    gps = [
        (0, 1, 4, "X'02030000'", 4),
        (1, 2, 2, text("IF(doc_id % 3 = 0, 'S', 'N')"), 2),
        (2, 5, 3, ", ".join(latitude), 24),
    ]
    interop = [(1, 2, 4, text("'R98'"), 4)]
    ifd1 = [(259, 3, 1, num(6, 2), 2)]
    ifd0 = [
        (271, 2, source, text("source"), source),
        (274, 3, 1, num("n_chars % 8 + 1", 2), 2),
        (282, 5, 1, pair("n_chars", 72), 8),
        (315, 2, lang, text("lang"), lang),
        (34665, 4, 1, num(EXIF_AT, 4), 4),
        (34853, 4, 1, num(GPS_AT, 4), 4),
    ]
    parts = [
        f"X'{'49492A00' if little else '4D4D002A'}'",
        num(IFD0_AT, 4),
        directory(EXIF_AT, exif),
        directory(GPS_AT, gps),
        directory(INTEROP_AT, interop),
        directory(IFD1_AT, ifd1),
        directory(IFD0_AT, ifd0, after=IFD1_AT),
    ]
    return f"concat({', '.join(parts)})"
