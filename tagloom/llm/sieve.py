"""Bloom filters of bounded size: what can be passed over is passed over where it lies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import BROADCAST_BYTES, measured
from tagloom.llm.words import U

#: Bits of a filter for each hash, most of them (32 MB), and bits that a hash sets.
EACH, MOST, PROBES = 64, 1 << 28, 6


def sieve(hashes: DataFrame, n: int) -> np.ndarray:
    """Filter of a column ``h`` of about n different 64-bit hashes, as 64-bit words.

    Hash h sets the bits low half + k * high half, for PROBES values of k. Bits are set in Spark; the driver gets the words
    that hold any, 32 MB at most. Beyond MOST / EACH hashes the filter is fuller and lets more rows pass; it never loses one.
    """
    bits = 1 << min(max(10, math.ceil(math.log2(max(1, n) * EACH))), MOST.bit_length() - 1)
    low, high = "(h & 4294967295L)", "(shiftrightunsigned(h, 32) | 1L)"
    probes = f"transform(sequence(0, {PROBES - 1}), k -> ({low} + k * {high}) & {bits - 1}L)"
    places = hashes.select(F.explode(F.expr(probes)).alias("bit")).selectExpr(
        "shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS bits"
    )
    found = places.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=U)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def passing(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes pass: all that are in the filter, and some that are not."""
    at = np.arange(len(h))
    for k in range(PROBES):
        if not len(at):
            break
        low, high = h[at] & U(0xFFFFFFFF), (h[at] >> U(32)) | U(1)
        bit = (low + U(k) * high) & U(64 * len(words) - 1)
        at = at[(words[bit >> U(6)] >> (bit & U(63))) & U(1) == 1]
    return at


def read_among(texts: DataFrame, wanted: DataFrame, read: Callable, schema: str, most: int | None = None) -> DataFrame:
    """What ``read``, a mapInArrow function of (id, text), makes of the texts whose id is in ``wanted`` (id, distinct, stored).

    No text moves. Ids of up to ``most`` bytes (BROADCAST_BYTES) are broadcast; beyond that a filter of theirs goes to the
    texts, and what was read of the few others that pass is dropped by a join with the ids. ``schema`` has an ``id``.
    """
    if measured(wanted) <= (BROADCAST_BYTES if most is None else most):
        return texts.join(F.broadcast(wanted), "id", "left_semi").select("id", "text").mapInArrow(read, schema)
    words = sieve(wanted.select(F.xxhash64("id").alias("h")), wanted.count())

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = passing(words, batch.column(2).to_numpy().view(U))
                if len(at):
                    yield batch.select(["id", "text"]).take(pa.array(at))

        yield from read(some())

    rows = texts.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(among, schema)
    return rows.join(wanted.hint("merge"), "id", "left_semi")
