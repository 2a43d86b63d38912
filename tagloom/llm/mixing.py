"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a hash of its id and text. For each source, sizes are summed by the
leading BITS bits of the hash; the running sum over these buckets shows the one in which
the source's budget ends. Only this bucket is refined by the next BITS bits, and so
on, LEVELS times. The result is one threshold a source: documents below it are
taken, so a larger budget takes a superset of a smaller one, nothing is sorted, and every
rerun agrees. No document is counted outside the map-side sums, so a source
that holds most rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.scratch import beside, store, unused

BITS = 12
LEVELS = 4
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3

#: Fixed: words are what lies between these characters.
_BLANKS = r"[\x20\x09-\x0D]+"


def words(text_col: str) -> F.Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _BLANKS)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - edges).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """``source`` with its place (from 0) in code point order, null last.

    Sources are dealt by range, numbered within each range, and moved on by the
    number of sources in the ranges before.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = store(
        sources.repartitionByRange(*order).select("source", F.spark_partition_id().alias("part"))
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(before), "part").selectExpr("source", "place + before AS place")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources share the sum of all sizes by weight. A target stops at ``most`` times
    its source's size; the excess is shared among the others by weight until no
    target is above. With sources in order of ``size / weight`` those that stop come first, so prefix sums
    tell for each source at what rate the others share if all before it stop; the first one that this rate leaves below its
    stop settles it. Sources are dealt by range and the ranges' sums moved on, in a fixed number of jobs.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    shares = _with_place(sizes).select("source", "source_size", weight.cast("double").alias("weight"))
    shares = shares.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("stop") / F.col("weight")
    dealt = store(shares.withColumn("ratio", ratio).repartitionByRange("ratio").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("stop").alias("stops"), F.sum("weight").alias("weights"), F.sum("source_size").alias("sizes"))
    everything = Window.partitionBy()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "part",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("stops", "weights")),
        F.sum("weights").over(everything).alias("all_weights"),
        F.sum("sizes").over(everything).alias("total"),
    )  # a row for each range
    inside = Window.partitionBy("part").orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    up_to = [F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"{c}_before") for c in ("stop", "weight")]
    placed = dealt.select("part", "ratio", *up_to).join(F.broadcast(before), "part")
    rates = placed.selectExpr(
        "ratio", "try_divide(total - stops - stop_before, all_weights - weights - weight_before) AS rate"
    ).where("rate < ratio")
    rate = rates.agg(F.min(F.struct("ratio", "rate")).alias("first")).first()["first"]
    target = F.col("stop") if rate is None else F.least(F.lit(rate["rate"]) * F.col("weight"), F.col("stop"))
    return dealt.select("source", "source_size", target.alias("target"))


def _with_place(sizes: DataFrame) -> DataFrame:
    places = ranked(sizes.select("source")).withColumnRenamed("source", "placed")
    return sizes.join(places, F.col("source").eqNullSafe(F.col("placed"))).drop("placed")


def _place(id_col: str, text_col: str) -> F.Column:
    """A row's place: 64 bits of two hash rounds, so that it follows no hash that dealt rows before.

    Rows without an id are told apart by where they stand in the table, all others by id and text.
    """
    text = F.xxhash64(F.col(text_col).cast("string"))
    own = F.coalesce(F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string"))), F.lit(0))
    row = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return F.xxhash64(F.xxhash64(own, text, row), F.lit("place"))


def thresholds(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """of, source_size, target, times, below for each source of rows (source, size, place).

    A document is taken ``times`` times, and once more if the leading bits of its place are
    less than ``below``. A source has one row, a null source too.
    """
    sizes = store(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = store(targets(sizes, weights, most).withColumnRenamed("source", "of"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = store(
        goal.select(
            "of",
            (F.col("target") - whole * F.col("source_size")).alias("rest"),
            F.lit(0).cast("bigint").alias("prefix"),  # the bits settled so far
        )
    )
    here = F.col("source").eqNullSafe(F.col("of"))
    for level in range(1, LEVELS + 1):
        bucket = F.shiftrightunsigned("place", 64 - BITS * level)
        inside = rows.join(beside(state), here).where(F.shiftrightunsigned(bucket, BITS) == F.col("prefix"))
        sums = inside.groupBy("of", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("of", "rest").orderBy("bucket"))
        # The first bucket that ends beyond the budget holds the boundary.
        left = (F.col("rest") - F.col("up_to") + F.col("n")).alias("rest")
        edge = sums.withColumn("up_to", up_to).where("up_to > rest").groupBy("of")
        edge = edge.agg(F.min(F.struct("bucket", left)).alias("edge"))
        state = store(edge.selectExpr("of", "edge.rest AS rest", "edge.bucket AS prefix"))
    # What is left in the last bucket is taken if that comes nearer to the target.
    tail = (
        rows.join(beside(state), here)
        .where(_leading("place") == F.col("prefix"))
        .groupBy("of", "rest", "prefix")
        .agg(F.sum("size").alias("n"))
    )
    below = F.when(F.col("rest") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    edges = tail.select(F.col("of").alias("at"), below.alias("below"))
    return store(
        goal.join(edges, F.col("of").eqNullSafe(F.col("at")), "left").select(
            "of", "source_size", "target", whole.cast("bigint").alias("times"), F.coalesce("below", F.lit(0)).alias("below")
        )
    )


def _leading(place: str) -> F.Column:
    return F.shiftrightunsigned(place, 64 - BITS * LEVELS)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return store(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            words(text_col).alias("size"),
            _place(id_col, text_col).alias("place"),
        )
    )


_TIMES = "times + IF(shiftrightunsigned(place, {shift}) < below, 1, 0)".format(shift=64 - BITS * LEVELS)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """<id>, size, source_size, target, taken for every row of ``docs``.

    ``taken`` is the number of words that the mix takes of the document: its size
    times the number of times it is repeated, 0 if it is left out. A target of k
    sizes and a part takes every document k times and those below the threshold
    once more.

    A null text has size 0; a null source is a source of its own, the last. Rows
    that repeat id and text share a place and so are taken alike, rows that repeat only the id are not. Rows with a null id are placed one by
    one, by where they stand in the table: runs over the same files agree. A source without words has target 0. An empty table gives an
    empty result. Other columns are not read. A text of any length is one document, taken whole or not at all.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    plan = thresholds(rows, weights, most)
    return rows.join(beside(plan), F.col("source").eqNullSafe(F.col("of"))).selectExpr(
        f"id AS `{id_col}`", "size", "source_size", "target", f"size * ({_TIMES}) AS taken"
    )


def take(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_REPEATS,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, and in ``times`` how often (it replaces a column of that name).

    Texts stay where they are; only the thresholds, one row a source, are sent to them.
    """
    of, size, target, whole, below, place = unused(docs, "of", "source_size", "target", "whole", "below", "place")
    plan = thresholds(_rows(docs, id_col, text_col, source_col), weights, most).toDF(of, size, target, whole, below)
    here = F.col(source_col).cast("string").eqNullSafe(plan[of])
    # The place is found before the join, while rows stand as they do in the table.
    placed = docs.withColumn(place, _place(id_col, text_col)).join(beside(plan), here)
    extra = F.shiftrightunsigned(place, 64 - BITS * LEVELS) < F.col(below)
    times = F.col(whole) + F.when(extra, 1).otherwise(0)
    return placed.withColumn("times", times).drop(place, *plan.columns).where("times > 0")
