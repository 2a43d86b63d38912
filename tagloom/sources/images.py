"""Image files as rows, and image rows in tables.

Spark reads binary files but does not write them, so edited images are stored
as a Parquet column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(
    spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True
) -> DataFrame:
    """One row per file: item_id (the path), modificationTime, length, content.

    Spark passes over empty files. ``content`` is only read if the query uses it, and filters on length or
    modificationTime skip files before they are opened. Without ``recursive``,
    directories named ``key=value`` are partitions that filters prune.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumnRenamed("path", "item_id")


def write_images(images: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store images as Parquet: many small files become few large ones.

    Image bytes do not compress and do not repeat, so neither compression nor a
    dictionary is tried on them. Row groups are checked against their size every
    few rows, because a row may be many megabytes.
    """
    _writer(images, mode).parquet(path)


def save_images(
    images: DataFrame, table: str, buckets: int, mode: str = "errorifexists"
) -> None:
    """Store images in a table bucketed by item_id, one file per bucket.

    One shuffle of the images, paid once: joins on item_id, such as the one in
    ``patch_tags``, then leave the images where they are. Choose ``buckets`` so
    that a bucket's share of the edits fits into memory (a bucket of images may be many
    gigabytes: it is streamed), no fewer than ``spark.sql.shuffle.partitions``, below which Spark prefers to
    shuffle again, and no more than ``spark.sql.sources.bucketing.maxBuckets`` (100,000).
    """
    placed = images.repartition(buckets, F.col("item_id"))
    _writer(placed, mode).bucketBy(buckets, "item_id").saveAsTable(table)


def _writer(images: DataFrame, mode: str):
    return (
        images.write.mode(mode)
        .format("parquet")
        .option("compression", "none")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size.row.check.min", "4")
        .option("parquet.page.size.row.check.min", "4")
    )
