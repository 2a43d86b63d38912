"""Editing: a table of edits against tags or image bytes.

An edit is a row (item_id, tag, seq, value) and, if it should not go to the
directory the standard has for the tag, ifd. The edit with the highest seq
wins; on equal seq a removal (NULL value) wins, then the larger value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.names import home_directory, standard_type
from tagloom.functions.patch import (
    BAD_VALUE,
    IS_POINTER,
    NO_TAG,
    addressable,
    is_pointer,
    with_patches,
)
from tagloom.functions.segments import without_exif
from tagloom.functions.values import fitted
from tagloom.sources.stored import store

KEY = ["item_id", "ifd", "tag"]

# Winning edits that take up no more than this are broadcast.
BROADCAST_BYTES = 64 << 20


def last_edits(edits: DataFrame) -> DataFrame:
    """The winning edit per image, directory and tag.

    ``max`` combines on the map side, so a tag that was edited a billion times
    reaches the shuffle as one row per task. An edit that names no image or no
    tag addresses nothing and is left out.
    """
    home = home_directory("tag")
    ifd = f"coalesce(ifd, {home})" if "ifd" in edits.columns else home
    return (
        edits.where("item_id IS NOT NULL AND tag IS NOT NULL")
        .withColumn("ifd", F.expr(ifd))
        .groupBy(*KEY)
        .agg(F.expr("max(struct(seq, value IS NULL AS removes, value)) AS last"))
        .selectExpr(*KEY, "last.value AS new_value")
    )


def measured_bytes(rows: DataFrame) -> int:
    """What rows take up in memory, counted: their texts, and a fixed part each."""
    texts = [f"coalesce(octet_length({n}), 0)" for n, kind in rows.dtypes if kind == "string"]
    fixed = 64 + 16 * len(rows.columns)
    size = F.expr(f"sum({fixed} + {' + '.join(texts) or '0'})").alias("size")
    return rows.agg(size).first()["size"] or 0


def _reason(type_code: str) -> str:
    """SQL: why an edit of a tag of this type is refused; NULL if it is not."""
    return f"""CASE WHEN NOT {addressable('ifd', 'tag')} THEN '{NO_TAG}'
        WHEN {is_pointer('ifd', 'tag')} THEN '{IS_POINTER}'
        WHEN new_value IS NOT NULL AND {fitted('new_value', type_code)} IS NULL
        THEN '{BAD_VALUE}' END"""


def _with_edits(tags: DataFrame, edits: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The tags, and the edits of missing tags, each with its edit and why it is refused.

    Columns: those of a tag; present, edited, new_value, reason. An edit is
    judged by all rows of its tag: it is done in every one of them or in none.
    The winning edits are stored and counted first. If they fit into
    ``broadcast_bytes`` the tags do not move, and the reading that finds the types of
    the edited tags needs four columns only. If not, tags and edits go through one
    exchange by key; what a key needs to know is then found in one sorted pass.
    No key is hot: a directory has some 5,400 entries at most.
    """
    last = store(last_edits(edits))
    standard = standard_type("ifd", "tag")
    if measured_bytes(last) > broadcast_bytes:
        whole = tags.select(*KEY, "type", "count", "value").selectExpr(
            "*", "TRUE AS present", "FALSE AS edited", "CAST(NULL AS STRING) AS new_value"
        )
        alone = last.selectExpr(
            *KEY, f"{standard} AS type", "CAST(NULL AS BIGINT) AS count",
            "CAST(NULL AS STRING) AS value", "FALSE AS present", "TRUE AS edited", "new_value",
        )
        of_key = Window.partitionBy(*KEY)
        both = (
            whole.unionByName(alone)
            .withColumn("edited", F.max("edited").over(of_key))
            .withColumn("new_value", F.max("new_value").over(of_key))
            .withColumn("known", F.max("present").over(of_key))
            .where("present OR NOT known")
        )
        judged = both.withColumn("reason", F.expr(f"CASE WHEN edited THEN {_reason('type')} END"))
        return judged.withColumn("reason", F.max("reason").over(of_key)).drop("known")

    # No more keys than winning edits, so what bounds those bounds these.
    types = (
        tags.select(*KEY, "type")
        .join(last.select(*KEY).hint("broadcast"), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.collect_set("type").alias("types"))
    )
    judged = store(
        last.join(types.hint("broadcast"), KEY, "left")
        .selectExpr("*", f"coalesce(types, array({standard})) AS codes")
        .selectExpr(
            *KEY,
            "new_value",
            "types IS NOT NULL AS known",
            "codes[0] AS code",
            f"array_max(transform(codes, code -> {_reason('code')})) AS reason",
        )
    )
    beside = judged.selectExpr(*KEY, "TRUE AS edited", "new_value", "reason").hint("broadcast")
    present = tags.join(beside, KEY, "left").selectExpr(
        *KEY, "type", "count", "value", "TRUE AS present", "coalesce(edited, FALSE) AS edited",
        "new_value", "reason",
    )
    missing = judged.where("NOT known").selectExpr(
        *KEY, "code AS type", "CAST(NULL AS BIGINT) AS count", "CAST(NULL AS STRING) AS value",
        "FALSE AS present", "TRUE AS edited", "new_value", "reason",
    )
    return present.unionByName(missing)


def apply_edits(
    tags: DataFrame, edits: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Set or remove tags; editing a missing tag adds it.

    A value is stored as it would be read from a file that it had been written to:
    ``08`` as ``8``, hex digits as capitals. What ``patch_tags`` refuses as no value of the tag's type is
    refused here, too (a float can be removed but not set), and so are edits of tags that
    point to directories; ``refused_edits`` lists them. Pass stored tags
    (``store``), not ones that are decoded anew each time they are read.
    """
    done = "edited AND reason IS NULL"
    return (
        _with_edits(tags, edits, broadcast_bytes)
        .where(f"IF({done}, new_value IS NOT NULL, present)")
        .selectExpr("*", f"CASE WHEN {done} THEN {fitted('new_value', 'type')} END AS fitted")
        .selectExpr(
            *KEY,
            "type",
            "IF(fitted IS NULL, count, fitted.count) AS count",
            "IF(fitted IS NULL, value, fitted.value) AS value",
        )
    )


def refused_edits(
    tags: DataFrame, edits: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """item_id, ifd, tag, reason of the winning edits that ``apply_edits`` does not do."""
    judged = _with_edits(tags, edits, broadcast_bytes).where("reason IS NOT NULL")
    return judged.select(*KEY, "reason").distinct()


def strip_metadata(images: DataFrame) -> DataFrame:
    """Cut every Exif segment out of the bytes; no other byte changes.

    Row by row, without a shuffle.
    """
    return images.withColumn("content", F.expr(without_exif("content")))


def patch_tags(
    images: DataFrame, edits: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Write edits into the image bytes where they fit: item_id, content, rejected.

    A value must be no longer than its old slot, so no offset moves. What cannot
    be done in place is listed in ``rejected`` with the reason.

    Images are the heavy side and stay on the streamed side of one left join.
    The winning edits are stored and counted first: if they fit into
    ``broadcast_bytes`` they are broadcast and no image moves. If not, they are
    hashed per partition, so image bytes are never sorted; with the images in a table bucketed by
    item_id (``save_images``), again only the edits move.

    Edits are gathered per image after ``last_edits``, so an image holds at most
    one per directory and 16-bit tag number; numbers beyond that range cannot be
    in a file and are reported together, once per image.
    """
    last = store(last_edits(edits))
    small = measured_bytes(last) <= broadcast_bytes
    # Winning edits differ in their key, but for those that no file can hold: these
    # become equal here, and the set keeps one of them.
    valid = addressable("ifd", "tag")
    per_item = (
        last.selectExpr(
            "item_id",
            f"""struct(IF({valid}, ifd, NULL) AS ifd, IF({valid}, tag, NULL) AS tag,
                IF({valid}, new_value, NULL) AS value) AS edit""",
        )
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_set("edit")).alias("edits"))
    )
    beside = per_item.hint("broadcast" if small else "shuffle_hash")
    return with_patches(images.select("item_id", "content").join(beside, "item_id", "left"))
