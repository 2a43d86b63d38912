"""Headers apart from pictures.

A picture has megabytes, what comes before its first scan some kilobytes. Stored in a column of
their own, headers are all that viewing, stripping and patching read, and all that moves
in a join with many edits; the pictures stay where they are until files are put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.segments import header_and_rest


def split_images(images: DataFrame) -> DataFrame:
    """item_id, header, picture: the bytes before the first scan, however many, and the rest.

    Row by row, without a shuffle. What is no JPEG file has an empty header; of one
    that breaks off before a scan all is header; a NULL content gives NULLs.
    """
    return images.selectExpr("item_id", f"{header_and_rest('content')} AS parts").selectExpr(
        "item_id", "parts.header AS header", "parts.picture AS picture"
    )


def headers(split: DataFrame) -> DataFrame:
    """item_id, content of the headers: images for the viewer and the editors."""
    return split.select("item_id", F.col("header").alias("content"))


def join_images(headers: DataFrame, split: DataFrame) -> DataFrame:
    """item_id, content: headers (item_id, content), edited or not, before the pictures of ``split``.

    The one step that moves pictures, unless ``split`` is bucketed by item_id. Ids
    are to be unique; a file whose header or picture is missing is left out (see ``left_out``).
    """
    pictures = split.select("item_id", "picture")
    return pictures.join(headers, "item_id").select(
        "item_id", F.concat("content", "picture").alias("content")
    )


def left_out(headers: DataFrame, split: DataFrame) -> DataFrame:
    """item_id, n_headers, n_pictures of the ids that ``join_images`` does not turn into one file.

    Ids without a header or without a picture are left out by it; ids that repeat on a side come out as often as
    they can be paired; null ids are never joined. No picture is read: one shuffle of ids, counted before it.
    """
    sides = headers.select("item_id", F.lit(1).alias("h"), F.lit(0).alias("p")).unionByName(
        split.select("item_id", F.lit(0).alias("h"), F.lit(1).alias("p"))
    )
    counts = sides.groupBy("item_id").agg(F.sum("h").alias("n_headers"), F.sum("p").alias("n_pictures"))
    return counts.where("item_id IS NULL OR n_headers <> 1 OR n_pictures <> 1")
