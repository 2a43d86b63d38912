"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.values import as_degrees, as_numbers, as_rationals, as_timestamp
from tagloom.operators.edit import (
    apply_edits,
    last_edits,
    patch_tags,
    refused_edits,
    strip_metadata,
)
from tagloom.operators.headers import headers, join_images, split_images
from tagloom.operators.view import decode_tags, view_images, view_tags
from tagloom.plans.collection import edits, images, table
from tagloom.sources.manifest import compare_manifests, manifest
from tagloom.sources.stored import store

SHOWN = [
    "Make",
    "Orientation",
    "XResolution",
    "Artist",
    "Copyright",
    "DateTimeOriginal",
    "ExposureBiasValue",
    "PixelXDimension",
    "ImageUniqueID",
    "GPSLatitudeRef",
    "GPSLatitude",
    ("ifd1", 259),
]


def decode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_tags(images(spark, sf_dir))


def decode_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_tags(images(spark, sf_dir), ["Make", "GPSLatitude", ("interop", 1)])


def view_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_tags(decode_tags(images(spark, sf_dir)), SHOWN)


def view_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_images(images(spark, sf_dir), SHOWN)


def view_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown tags as numbers, dates and degrees instead of text."""
    resolution = F.get(as_rationals(F.col("XResolution")), F.lit(0))
    return view_images(images(spark, sf_dir), SHOWN).select(
        "item_id",
        F.get(as_numbers(F.col("Orientation")), F.lit(0)).cast("int").alias("orientation"),
        resolution["num"].alias("x_num"),
        resolution["den"].alias("x_den"),
        as_timestamp(F.col("DateTimeOriginal")).alias("taken"),
        as_degrees(F.col("GPSLatitude"), F.col("GPSLatitudeRef")).alias("latitude"),
    )


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_edits(edits(spark, sf_dir))


def edit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = store(decode_tags(images(spark, sf_dir)))
    return apply_edits(tags, edits(spark, sf_dir))


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits that a table of tags refuses."""
    tags = store(decode_tags(images(spark, sf_dir)))
    return refused_edits(tags, edits(spark, sf_dir))


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each file, byte for byte."""
    return strip_metadata(images(spark, sf_dir)).select(
        "item_id",
        F.length("content").cast("bigint").alias("size"),
        F.md5("content").alias("digest"),
    )


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of the patched files."""
    return decode_tags(patch_tags(images(spark, sf_dir), edits(spark, sf_dir)))


def patch_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits that could not be done in place."""
    return patch_tags(images(spark, sf_dir), edits(spark, sf_dir)).select(
        "item_id", F.inline("rejected")
    )


def patch_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched files keep their size, and every byte once the tags are cut out."""
    done = patch_tags(images(spark, sf_dir), edits(spark, sf_dir))
    sized = done.select("item_id", "content", F.length("content").cast("bigint").alias("size"))
    return strip_metadata(sized).select("item_id", "size", F.md5("content").alias("digest"))


def decode_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags, out of the headers alone."""
    return decode_tags(headers(store(split_images(images(spark, sf_dir)))))


def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together again from stripped headers and the pictures."""
    split = store(split_images(images(spark, sf_dir)))
    return join_images(strip_metadata(headers(split)), split).select(
        "item_id", F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest")
    )


def patch_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together again from patched headers, as ``patch_picture`` shows them."""
    split = store(split_images(images(spark, sf_dir)))
    done = patch_tags(headers(split), edits(spark, sf_dir)).select("item_id", "content")
    sized = join_images(done, split).select(
        "item_id", "content", F.length("content").cast("bigint").alias("size")
    )
    return strip_metadata(sized).select("item_id", "size", F.md5("content").alias("digest"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images as files of today, against a manifest of before that ``labels`` tell of.

    Documents without a label are new. Of those with one, files of good quality are as they were, others had another length, and
    toxic ones another time; and each toxic document had a second file, which is gone.
    """
    files = images(spark, sf_dir).selectExpr(
        "item_id", "CAST(length(content) AS BIGINT) AS length", "timestamp_seconds(length(content)) AS modificationTime"
    )
    kept = files.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id"), "item_id").selectExpr(
        "item_id",
        "IF(quality = 1, length, length + 1) AS length",
        "IF(toxic = 1, timestamp_seconds(0), modificationTime) AS modificationTime",
        "toxic",
    )
    gone = kept.where("toxic = 1").selectExpr("-1 - item_id AS item_id", "length", "modificationTime")
    before = kept.drop("toxic").unionByName(gone)
    return compare_manifests(manifest(files), before).select("item_id", "change", "length")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "decode_tags": decode_all,
    "decode_some_tags": decode_some,
    "view_tags": view_stored,
    "view_images": view_direct,
    "view_typed": view_typed,
    "last_edits": last,
    "apply_edits": edit_table,
    "refused_edits": refused,
    "strip_metadata": strip,
    "patch_tags": patch,
    "patch_rejected": patch_rejected,
    "patch_picture": patch_picture,
    "decode_headers": decode_headers,
    "strip_headers": strip_headers,
    "patch_headers": patch_headers,
    "compare_manifests": changes,
}
