"""Rows that are computed once and read many times."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

#: What this session has stored, by application.
_stored: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines see: ``spark.checkpoint.dir``, or where that is not
    set a part of the warehouse, where the session's tables lie."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/tagloom_stored"
        if found.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
            warnings.warn(
                f"spark.checkpoint.dir is not set, and {found} looks like a folder of one machine: "
                "set it to one that all machines see",
                stacklevel=3,
            )
    return found.rstrip("/")


def store(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write rows as a table in a shared folder and read them back.

    For rows that are small beside what they are made of: tags are a thousandth
    of their images, winning edits a part of all edits. It saves doing the work
    again for every further reading, or when an executor is lost, and every reading
    sees the same rows, also where their source would give others the next time.

    ``folder`` is ``shared_folder`` if it is not given. The tables stay until ``clear``, or until the folder is emptied
    after the job.
    """
    spark = rows.sparkSession
    path = f"{folder or shared_folder(spark)}/tagloom-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that ``store`` has written for this application; returns how many there were.

    For the end of a job, or between two: a DataFrame that still reads one of them fails afterwards.
    """
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
