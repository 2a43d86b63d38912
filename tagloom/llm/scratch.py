"""Rows kept between two steps of an operator, and joins chosen by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources.stored import store

#: Bytes of rows that may be sent to every executor.
BROADCAST_BYTES = 48 << 20

_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _size(value: F.Column, kind: T.DataType) -> F.Column:
    """Bytes of a value, some 16 of its row's overhead aside."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda s, x: s + _size(x, kind.elementType)), F.lit(0)) + 16
        return F.coalesce(F.size(value), F.lit(0)) * _FIXED.get(type(kind.elementType), 8) + 16
    if isinstance(kind, T.StructType):
        return sum((_size(value[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def row_bytes(rows: DataFrame) -> F.Column:
    """Bytes of a row, as it lies in memory."""
    return sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema), F.lit(16)).cast("bigint")


def measured(rows: DataFrame) -> int:
    """Bytes of all rows."""
    return rows.agg(F.sum(row_bytes(rows))).first()[0] or 0


def beside(stored: DataFrame, most: int | None = None) -> DataFrame:
    """Stored rows as the smaller side of a join.

    They are broadcast if they are measured to be at most ``most`` bytes (BROADCAST_BYTES unless told otherwise);
    beyond that the join shuffles both sides, and AQE splits hot keys.
    """
    return F.broadcast(stored) if measured(stored) <= (BROADCAST_BYTES if most is None else most) else stored.hint("merge")


def least_hashes(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Of distinct ``rows`` (``by``, id, hash) the ``most`` with the least hashes for each value of ``by``.

    Counts tell below which hash twice as many are to be expected; only those are
    ranked, so no task ranks more than some 2 * ``most`` rows, however many there are. ``by`` is a
    column of few values: the driver gets their counts.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    if not sizes:
        return rows
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * most / n))))[F.col(by)]
    low = rows.where(F.pmod("hash", F.lit(1 << 31)) < share * float(1 << 31)).distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod("hash", F.lit(1 << 31)), "hash", "id"))
    return low.withColumn("place", place).where(F.col("place") <= most).drop("place")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is among ``ids``; null ids stay.

    While the ids can be broadcast no row moves; beyond that rows are shuffled once, with all of their columns.
    """
    (gone,) = unused(docs, "gone")
    lost = beside(store(ids.select(F.col(id_col).alias(gone)).distinct()))
    return docs.join(lost, F.col(id_col) == F.col(gone), "left_anti")


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``rows`` has not, in whatever case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
