"""The viewer over a folder that keeps growing.

Decoding needs no state, so the batch operators run on a stream as they are.
The checkpoint holds the list of files done: each run reads only new ones, and
a run that was lost goes on where it stopped. Each run lists the folder, and the
driver holds the names of the files done: let a collection arrive in folders by
period, and stream one folder at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.view import Names, decode_tags

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_images(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    files_per_batch: int = 100_000,
    max_file_age: str = "36500d",
) -> DataFrame:
    """The rows of ``scan_images`` as a stream.

    Spark passes over files that are older than the newest one seen by more than
    ``max_file_age``, and forgets them. Copied pictures keep their old times, so
    by default, a hundred years, nothing is passed over.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", max_file_age)
    )
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumnRenamed("path", "item_id")


def append_tags(
    images: DataFrame, path: str, checkpoint: str, names: Names | None = None
) -> StreamingQuery:
    """Decode all images not seen so far and append their tags as Parquet."""
    return (
        decode_tags(images, names)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
