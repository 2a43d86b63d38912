"""Near-duplicate documents by min-max hashing.

The sets are those of five-word shingles; two documents are linked if the
sets' similarity is at least 75 %. Under each of PERMUTATIONS hash functions
both the least and the largest value are kept, so half as many functions give a
signature of a length, and each of its values agrees for two sets with a
probability equal to their similarity. Bands of four values, two minima and two
maxima of four different functions, make the candidates.

Steps, each a Spark job over tables:

1. One pass over the texts: set size, set fingerprint and band keys. Documents with equal sets are one class from here on.
2. In each band bucket every class is paired with the bucket's first one, and
   the pair is confirmed on the full sets. A family of copies costs one pair a
   member, however large it is.
3. Components of the links, by alternating star steps.
4. Buckets in which several components are left: pairs between different
   components, looked at in blocks of bounded size, of which those that hold one component are not paired. For these classes alone longer signatures
   are made, which decide what is worth confirming (ESTIMATE lies more than four
   standard errors below 75 %); the full sets decide. A pair is looked at in the first bucket that
   it shares, and in no other. Then the components are final: of two classes that
   share a bucket, either the similarity is known or they are in one component anyway.

A pair of similarity s shares a bucket with probability 1 - (1 - s**4)**BANDS:
at 75 % all but 5 in a million. A bucket has no upper size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.scratch import BROADCAST_BYTES, beside, row_bytes, store, unused, without
from tagloom.llm.sieve import read_among
from tagloom.llm.words import BLANK_PARTED, U, mixed, numbers, pieces, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 64
BANDS = 32
#: Hash functions of the longer signatures, of whose values one byte each is kept.
LONG = 512
#: Share of equal bytes from which a pair is confirmed on full sets.
ESTIMATE = 0.69
#: Classes that are compared with one another at a time.
BLOCK = 512


def _unique(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, ascending, and their offsets."""
    sets = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else shingles), np.r_[0, np.cumsum(sizes)]


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in pieces(texts):
        words, bounds = word_hashes(data, offsets, BLANK_PARTED)
        yield a, b, *_unique(*shingle_hashes(words, bounds, SHINGLE))


def min_max(shingles: np.ndarray, starts: np.ndarray, functions: int = PERMUTATIONS, seed: int = 101) -> np.ndarray:
    """Minima, then maxima, of each hash function: a row for each set."""
    out = np.empty((len(starts), 2 * functions), dtype=U)
    step = 1 << 15  # sets of some 32,000 shingles together stay in the cache
    ends = np.r_[starts[1:], len(shingles)]
    factors, shifts = numbers(functions, seed), numbers(functions, seed + 1)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        part, local = shingles[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        held = np.empty_like(part)
        for k in range(functions):
            np.multiply(part, factors[k], out=held)
            held += shifts[k]
            out[i:j, k] = np.minimum.reduceat(held, local)
            out[i:j, functions + k] = np.maximum.reduceat(held, local)
        i = j
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each band; values of one band come from four hash functions."""
    keys = np.empty((len(signatures), BANDS), dtype=U)
    mins, maxs = signatures[:, :PERMUTATIONS], signatures[:, PERMUTATIONS:]
    for t in range(BANDS):
        a, b = 2 * t, 2 * t + 1
        c, d = (a + 37) % PERMUTATIONS, (a + 38) % PERMUTATIONS
        key = mixed(mins[:, a] + U(t))
        for values in (mins[:, b], maxs[:, c], maxs[:, d]):
            key = mixed(key * U(0x9E3779B97F4A7C15) + values)
        keys[:, t] = key
    return keys


def _list(rows: np.ndarray) -> pa.Array:
    """A row of int64 lists for each row of a matrix."""
    flat = pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, shingles, bounds in _sets(batch.column(1)):
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            one, two = np.zeros(b - a, dtype=U), np.zeros(b - a, dtype=U)
            keys = np.zeros((b - a, BANDS), dtype=U)
            if len(some):
                starts = bounds[some]
                one[some] = np.add.reduceat(mixed(shingles + U(1)), starts)
                two[some] = np.add.reduceat(mixed(shingles ^ U(0x5851F42D4C957F2D)), starts)
                keys[some] = band_keys(min_max(shingles, starts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    _list(keys),
                ],
                names=["id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, shingles, bounds in _sets(batch.column(1)):
            some = np.flatnonzero(np.diff(bounds))
            low = np.zeros((b - a, 2 * LONG), dtype=np.uint8)
            keys = np.zeros((b - a, BANDS), dtype=U)
            if len(some):
                low[some] = (mixed(min_max(shingles, bounds[some], LONG, 401)) >> U(56)).astype(np.uint8)
                keys[some] = band_keys(min_max(shingles, bounds[some]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(bounds)),
                    pa.array([r.tobytes() for r in low], type=pa.binary()),
                    pa.array([r.tobytes() for r in keys], type=pa.binary()),
                ],
                names=["id", "n_shingles", "signature", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, shingles, bounds in _sets(batch.column(1)):
            lists = pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), lists], names=["id", "shingles"]
            )


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_a, set_b, bands of every row, in one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        _describe,
        f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>",
    )


def confirmed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs a, b (with set sizes na, nb) those that are similar enough.

    Only texts that are in a pair are read as sets; a set goes through one
    shuffle for each pair's side.
    """
    kind = texts.schema["id"].dataType.simpleString()
    fits = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    pairs = store(pairs.where(fits).select("a", "b").distinct())
    wanted = store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = store(read_among(texts, wanted, _full_sets, f"id {kind}, shingles array<bigint>"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = "size(array_intersect(sa, sb))"
    return store(
        pairs.join(left, "a")
        .join(right, "b")
        .where(f"100 * {shared} >= {PERCENT} * (size(sa) + size(sb) - {shared})")
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """id, component of every id in links (a, b): the smallest id that is reachable.

    Alternating star steps: every neighbour that is larger, then every one that
    is smaller, is hung below the least neighbour, until nothing changes. The
    number of rounds grows with the logarithm of the longest chain. While all links are few enough to be broadcast, so are the
    least neighbours, and no node's links meet in one task; beyond that AQE splits the hot ones.
    """

    def told(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(row_bytes(edges))).first())

    def least_of(links: DataFrame, size: int) -> DataFrame:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        return F.broadcast(least) if size <= BROADCAST_BYTES else least

    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = told(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        near = both.join(least_of(both, 2 * before[2]), "a").withColumn("m", F.least("a", "m"))
        large = near.where("b > a AND b > m").selectExpr("b AS a", "m AS b").distinct()
        least = least_of(large, 2 * before[2])
        small = large.join(least, "a").selectExpr("IF(b > m, b, a) AS a", "m AS b")
        edges = store(small.union(least.selectExpr("a", "m AS b")).where("a > b").distinct())
        after = told(edges)
        if after == before:
            break
        before = after
    return edges.selectExpr("a AS id", "b AS component")


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A row of numbers for each binary value; all values have one length."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return np.ascontiguousarray(data).view(kind).reshape(len(whole), -1)


def _pairs_of_group(group: pa.Table) -> pa.RecordBatch | None:
    """Pairs worth confirming of the rows of one bucket that lie in one pair of blocks."""
    labels = group["label"].to_numpy()
    if (labels == labels[0]).all():
        return None
    key = np.int64(group["key"][0].as_py()).view(U)
    apart = group["x"][0].as_py() != group["y"][0].as_py()
    blocks, sizes = group["block"].to_numpy(), group["n_shingles"].to_numpy()
    bands, bytes_ = _matrix(group["bands"], U), _matrix(group["signature"], np.uint8)
    here = (bands == key).argmax(axis=1)
    left, right = [], []
    for i in range(len(labels) - 1):
        rest = slice(i + 1, None)
        lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        fit = (labels[rest] != labels[i]) & (100 * lo >= PERCENT * hi)
        if apart:
            fit &= blocks[rest] != blocks[i]
        at = np.flatnonzero(fit) + i + 1
        if len(at):
            at = at[(bands[at] == bands[i]).argmax(axis=1) == here[i]]  # the first bucket they share
            at = at[(bytes_[at] == bytes_[i]).mean(axis=1) >= ESTIMATE]
            left.append(np.full(len(at), i))
            right.append(at)
    if not left or not sum(map(len, left)):
        return None
    a, b = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
    ids, n = group["id"].combine_chunks(), group["n_shingles"].combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(a), ids.take(b), n.take(a), n.take(b)], names=["a", "b", "na", "nb"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs worth confirming, of rows sorted by bucket and pair of blocks."""
    held: list[pa.RecordBatch] = []  # of the group that is not yet complete
    of = None

    def told() -> Iterator[pa.RecordBatch]:
        if held and (found := _pairs_of_group(pa.Table.from_batches(held))) is not None:
            yield found
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        starts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1), len(group)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if of != tuple(group[a]):
                yield from told()
                of = tuple(group[a])
            held.append(batch.slice(a, b - a))
    yield from told()


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, label) with their ``block``, and the pairs x, y of a key's blocks that hold two labels, by key and each ``block`` of the pair.

    A label of BLOCK rows or more in a bucket has blocks of its own, dealt by a hash of the id; smaller labels share blocks, dealt by
    a hash of the label. So counts are all that is needed, no bucket is sorted or numbered, and blocks of one label are never
    paired with one another: a family of n with one outsider makes some 2 * n rows.
    """
    sizes = store(rows.groupBy("key", "label").agg(F.count("*").alias("n")))
    large = store(sizes.where(F.col("n") >= BLOCK).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    small = store(
        sizes.where(F.col("n") < BLOCK).groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("shared"))
    )
    placed = rows.join(beside(large), ["key", "label"], "left").join(beside(small), "key", "left")
    own = F.when(F.col("parts").isNotNull(), F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint"))))
    mixed_ = F.pmod(F.xxhash64(F.lit("block"), "label"), F.col("shared")).cast("bigint")
    numbered = store(placed.withColumn("block", F.coalesce(own, mixed_)).drop("parts", "shared"))

    def numbers_of(table: DataFrame, count: str) -> DataFrame:
        return table.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))

    owned = numbers_of(large, "parts").select("key", "label", F.xxhash64("label", F.col("part").cast("bigint")).alias("block"))
    shared = numbers_of(small, "shared").select("key", F.col("part").cast("bigint").alias("block"))
    left, right = (t.withColumnRenamed("block", c) for t, c in ((shared, "x"), (shared, "y")))
    both = [
        left.join(right, "key").where("x <= y").select("key", "x", "y"),
        left.join(owned.select("key", F.col("block").alias("y")), "key").select("key", "x", "y"),
        owned.selectExpr("key", "label AS one", "block AS x")
        .join(owned.selectExpr("key", "label AS two", "block AS y"), "key")
        .where("one < two")
        .select("key", "x", "y"),
    ]
    pairs = store(both[0].unionByName(both[1]).unionByName(both[2]))
    each = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    return numbered, each


def _left_over(texts: DataFrame, buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a, b, na, nb between components that still share a bucket of three or more."""
    kind = texts.schema["id"].dataType.simpleString()
    labelled = store(
        buckets.join(labels, "id", "left").selectExpr("key", "id", "coalesce(component, id) AS label")
    )
    open_ = store(
        labelled.groupBy("key")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi AND n > 2")
        .select("key")
    )
    rows = store(labelled.join(beside(open_), "key"))
    numbered, pairs = _blocks(rows)
    wanted = store(numbered.select("id").distinct())
    schema = f"id {kind}, n_shingles bigint, signature binary, bands binary"
    signatures = store(read_among(texts, wanted, _long_signatures, schema))
    spread = (
        numbered.join(pairs, ["key", "block"])
        .join(signatures, "id")
        .select("key", "x", "y", "block", "id", "label", "n_shingles", "signature", "bands")
    )
    return (
        spread.repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y", "id")
        .mapInArrow(_block_pairs, f"a {kind}, b {kind}, na bigint, nb bigint")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, n_shingles, component_id, kept for every row of ``docs``.

    Words are what lies between blanks, with A-Z folded. A null or blank text has
    no shingle and is linked with nothing, itself excepted. Rows that repeat an id
    are one node: each gets its own n_shingles and their common component. A null
    id is linked with nothing: component_id is null and kept is true. An empty table gives
    an empty result. A text of any length is read whole. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    told = store(describe(texts, "id", "text"))
    real = told.where("id IS NOT NULL AND n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    first = store(real.groupBy(*key).agg(F.min("id").alias("first")))
    same = real.join(first, key).where("id <> first").selectExpr("first AS a", "id AS b")
    classes = real.join(first.select("first").distinct(), F.col("id") == F.col("first"), "left_semi")
    # A row that repeats an id has a set of its own, so an id may stand for several.
    exploded = classes.select(F.explode("bands").alias("key"), "id", "n_shingles")
    pivots = exploded.groupBy("key").agg(
        F.min(F.struct("id", "n_shingles")).alias("pivot"), F.count("*").alias("n")
    )
    buckets = store(
        exploded.join(pivots.where("n > 1"), "key").select("key", "id", "n_shingles", "pivot")
    )
    stars = buckets.where("id <> pivot.id").selectExpr(
        "pivot.id AS a", "id AS b", "pivot.n_shingles AS na", "n_shingles AS nb"
    )
    one = confirmed(texts, stars)
    labels = store(components(one))
    two = confirmed(texts, _left_over(texts, buckets.select("key", "id").distinct(), labels))
    labels = store(components(same.union(one).union(two)))
    return told.join(labels, "id", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id; all columns stay.

    Where ids are null or repeat, rows are told apart by id and a hash of the text, so each is judged by its own
    text; null ids come last. Rows that repeat both go or stay together. Null and blank texts stay. An empty table gives an
    empty result; columns may have any name.
    """
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").count()
    if ids.where("id IS NULL OR count > 1").isEmpty():
        return without(docs, near_duplicates(docs, id_col, text_col).where("NOT kept"), id_col)
    (row,) = unused(docs, "row_key")
    own = F.lpad(F.hex(F.xxhash64(F.col(text_col).cast("string"))), 16, "0")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        # In the order of ids: 16 hex digits of the number with its sign turned, or else a letter.
        number = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        number = F.concat(F.lit("0"), F.col(id_col).cast("string"), F.lit("\0"))
    keyed = docs.withColumn(row, F.concat(F.coalesce(number, F.lit("null")), own))
    return without(keyed, near_duplicates(keyed, row, text_col).where("NOT kept"), row).drop(row)
