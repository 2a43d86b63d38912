"""What has changed in a folder of images since it was last scanned.

A manifest holds a row of path, length and modification time for each file. It is made by a scan that opens no
file, stored by whoever scans, and compared with the next one; only files that are new or changed are
then read and decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW, CHANGED, REMOVED, SAME = "new", "changed", "removed", "same"
_STATE = ["modificationTime", "length"]


def manifest(images: DataFrame) -> DataFrame:
    """item_id, length, modificationTime of ``scan_images``, without reading a file's content."""
    return images.select("item_id", "length", "modificationTime")


def compare_manifests(now: DataFrame, before: DataFrame) -> DataFrame:
    """item_id, change, length, modificationTime of every file in either manifest.

    ``change`` is ``new``, ``changed`` (another length or time), ``removed`` or ``same``; of removed
    files length and time are those of before. A file that has become empty counts as removed, since
    Spark passes over empty files. Of an item_id that repeats in a manifest the row with the latest time counts, then
    the one with the greatest length; null ids are one item.

    One shuffle of both manifests by item_id, rows of one id combined before it.
    """
    held = F.struct(*_STATE)
    none = F.lit(None).cast("struct<modificationTime: timestamp, length: bigint>")
    both = now.select("item_id", held.alias("now"), none.alias("before")).unionByName(
        before.select("item_id", none.alias("now"), held.alias("before"))
    )
    change = (
        F.when(F.col("before").isNull(), NEW)
        .when(F.col("now").isNull(), REMOVED)
        .when(F.col("now") == F.col("before"), SAME)
        .otherwise(CHANGED)
    )
    found = both.groupBy("item_id").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    last = F.coalesce("now", "before")
    return found.select(
        "item_id", change.alias("change"), last["length"].alias("length"), last["modificationTime"].alias("modificationTime")
    )


def read_changed(spark: SparkSession, changes: DataFrame, files_per_read: int = 100_000) -> Iterator[DataFrame]:
    """The new and changed files of ``changes``, as rows of ``scan_images``, in parts.

    Spark reads files by a list of paths that the driver holds; it never holds more than ``files_per_read``
    of them, which come in the order of their times. Other files are not opened. A file that has gone since it was listed fails its
    part, unless ``spark.sql.files.ignoreMissingFiles`` is set; nothing to read gives no part.
    """
    wanted = changes.where(F.col("change").isin(NEW, CHANGED) & F.col("item_id").isNotNull())
    part: list[str] = []
    for row in wanted.orderBy("modificationTime", "item_id").select("item_id").toLocalIterator():
        part.append(row["item_id"])
        if len(part) == files_per_read:
            yield _read(spark, part)
            part = []
    if part:
        yield _read(spark, part)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).withColumnRenamed("path", "item_id")
