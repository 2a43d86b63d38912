"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors of one label and length are linked if their cosine is at least COSINE. Links mean a distance of at most
``sqrt(2 - 2 * COSINE)`` between unit vectors, and a random projection shrinks it by the root of the dimension, so
linked vectors seldom lie on two sides of a split; those near a split go to both sides (spill).

Steps, each a Spark job over tables:

1. Equal vectors of a label become one class with a weight, and each class gets a sketch: its unit vector in signed
   bytes, their scale, and the length of what rounding has cost.
2. Trees are fitted, a label a task, on a sample of at most about SAMPLE classes of each label that is too large for one leaf.
   Splits are taken of random directions, where few vectors lie near. A tree's node is
   split until it is expected to hold no more than LEAF classes, or no direction parts it any more.
3. Every class goes to its leaves in TREES trees. Leaves that turn out larger than expected are cut into blocks, and every pair of
   blocks is one group. Nothing is capped.
4. Sketches of a group are multiplied. The rounding errors bound each cosine: most pairs are certain. A pair counts in
   the first leaf that it shares, which follows from the two sketches alone. A group tells how many links
   each member has and to which member of the group it is connected, so a family of n costs n rows a group, not n * n.
5. Groups with uncertain pairs are looked at again with the whole vectors of just those members, in double precision.
6. Components of what is connected.

With isotropic vectors a split parts 1.3 % of the pairs just at 0.93 and spills 20 % of the rows: after 2, 6 and 12
splits, five trees miss one such pair in 100 million, 500,000 and 20,000.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.neardup import components
from tagloom.llm.scratch import beside, store

COSINE = 0.93
TREES = 5
#: Classes in a leaf, and in a block of a larger one.
LEAF = 2048
#: Classes of a label that its trees are fitted on (expected number).
SAMPLE = 1 << 16
#: Leaves of all labels together, of one tree each, if nothing spilled; spilling makes at most SPREAD times as many. It bounds what is
#: broadcast to some 50 MB. Beyond LEAF times as many classes, leaves are larger and cut into blocks.
MOST_LEAVES = 1 << 16
SPREAD = 4
#: Rows this near to a split go to both sides; in standard deviations of isotropic unit vectors.
SPILL = 0.25
#: Directions of a tree, and how many are tried at a node.
DIRECTIONS = 24
TRIES = 3
#: Least number of sampled rows on a side, and most that a side may keep of its node.
FEWEST = 8
KEEPS = 0.85
#: Pairs that are worked on together.
PAIRS = 1 << 16
#: Slack for rounding in single precision.
SLACK = 1e-5


def directions(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered random directions as columns, and what makes projections of unit vectors standard."""
    drawn = np.rint(np.random.default_rng(1000 + d).standard_normal((d, TREES * DIRECTIONS)) * 64)
    drawn[0, ~drawn.any(axis=0)] = 1
    return drawn, math.sqrt(d) / np.linalg.norm(drawn, axis=0)


def projections(sketch: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard projections: sums of whole numbers, so they are equal wherever they are computed."""
    drawn, standard = directions(sketch.shape[1])
    return (sketch.astype(np.float64) @ drawn) * standard * scale[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def sketches(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signed bytes, scale and error of each vector's unit vector."""
    unit = scaled(vectors)
    unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


class Trees:
    """The trees of one label: nodes in arrays; a node without a direction is a leaf."""

    def __init__(self, p: np.ndarray, expected: int, leaf: int) -> None:
        """Of sampled projections that stand for ``expected`` rows."""
        self._emptied()
        for tree in range(TREES):
            self.roots.append(len(self.direction))
            self._grow(p, tree * DIRECTIONS, (tree + 1) * DIRECTIONS, expected / max(1, len(p)), leaf)
            if self.direction[self.roots[-1]] < 0:  # its one leaf holds all rows: no other tree is needed
                self._emptied()
                self.roots.append(self._leaf())
                break
        for name, kind in (("direction", np.int16), ("threshold", np.float64), ("below", np.int32), ("above", np.int32), ("roots", np.int64)):
            setattr(self, name, np.asarray(getattr(self, name), dtype=kind))

    def _emptied(self) -> None:
        self.direction: list[int] = []
        self.threshold: list[float] = []
        self.below: list[int] = []
        self.above: list[int] = []
        self.roots: list[int] = []

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Trees:
        made = cls.__new__(cls)
        made.__dict__.update(arrays)
        return made

    def _leaf(self) -> int:
        for values, v in ((self.direction, -1), (self.threshold, 0.0), (self.below, -1), (self.above, -1)):
            values.append(v)
        return len(self.direction) - 1

    def _grow(self, p: np.ndarray, first: int, last: int, each: float, leaf: int) -> None:
        """Splits nodes, the largest first, while they are too large and there are not too many leaves."""
        most = SPREAD * math.ceil(len(p) * each / leaf)
        open_ = [(-len(p), self._leaf(), np.arange(len(p)), first)]
        leaves = 1
        while open_ and leaves < most:
            _, node, rows, first = heapq.heappop(open_)
            if len(rows) * each <= leaf or len(rows) < 2 * FEWEST:
                continue
            tried = [(*_split(p[rows, k]), k) for k in range(first, min(first + TRIES, last))]
            if not tried or min(tried)[0] > KEEPS * len(rows):
                continue
            _, at, k = min(tried)
            self.direction[node], self.threshold[node] = k, at
            self.below[node], self.above[node] = self._leaf(), self._leaf()
            for child, inside in ((self.below[node], p[rows, k] <= at + SPILL), (self.above[node], p[rows, k] > at - SPILL)):
                heapq.heappush(open_, (-int(inside.sum()), child, rows[inside], k + 1))
            leaves += 1

    def leaves(self, tree: int, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the pair and node of every leaf that rows a and b share in a tree."""
        pair, node = np.arange(len(a)), np.full(len(a), self.roots[tree])
        pairs, nodes = [], []
        while len(pair):
            k = self.direction[node].astype(np.int64)
            end = k < 0
            pairs.append(pair[end])
            nodes.append(node[end])
            pair, node, k = pair[~end], node[~end], k[~end]
            at, x, y = self.threshold[node], p[a[pair], k], p[b[pair], k]
            left = np.maximum(x, y) <= at + SPILL
            right = np.minimum(x, y) > at - SPILL
            pair, node = np.r_[pair[left], pair[right]], np.r_[self.below[node[left]], self.above[node[right]]]
        return np.concatenate(pairs or [pair]), np.concatenate(nodes or [node]).astype(np.int64)

    def first_shared(self, leaf: int, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows a, b, all of them in this leaf, share none before it."""
        tree = int(np.searchsorted(self.roots, leaf, side="right")) - 1
        alive = np.arange(len(a))
        for t in range(tree):
            gone = np.zeros(len(alive), dtype=bool)
            gone[self.leaves(t, p, a[alive], b[alive])[0]] = True
            alive = alive[~gone]
        if len(alive):
            pair, node = self.leaves(tree, p, a[alive], b[alive])
            first = np.full(len(alive), np.iinfo(np.int64).max)
            np.minimum.at(first, pair, node)
            alive = alive[first == leaf]
        return alive


def _split(p: np.ndarray) -> tuple[float, float]:
    """The size of the larger side at the best threshold among middle quantiles, and that threshold."""
    order = np.sort(p)
    at = np.quantile(order, np.linspace(0.35, 0.65, 13))
    below = np.searchsorted(order, at + SPILL, side="right")
    above = len(order) - np.searchsorted(order, at - SPILL, side="right")
    best = int(np.argmin(below + above + np.abs(below - above)))
    return float(max(below[best], above[best])), float(at[best])


def _rows(column: pa.Array, d: int, kind: type) -> np.ndarray:
    """A row for each list of d numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)


def _bytes(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(-1, d)


def _by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(lengths):
        yield int(d), np.flatnonzero(lengths == d)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a ``vector`` and its length ``d`` get their sketch."""
    for batch in batches:
        for d, at in _by_length(batch.column("d").to_numpy()):
            part = batch.take(pa.array(at))
            q, scale, error = sketches(_rows(part.column("vector"), d, np.float64))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([r.tobytes() for r in q], type=pa.binary()), pa.array(scale), pa.array(error)],
                names=[*part.schema.names, "q", "scale", "error"],
            )


def _fitted(leaf: int) -> Callable[[pa.Table], pa.Table]:
    def fit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("c")
        q = _bytes(group["q"], group["d"][0].as_py())
        trees = Trees(projections(q, group["scale"].to_numpy()), group["n"][0].as_py(), leaf)
        return group.slice(0, 1).select(["label", "d"]).append_column("trees", pa.array([pickle.dumps(vars(trees))], type=pa.binary()))

    return fit


Forest = dict[tuple, Trees]


def _routed(forest: Forest, carried: list[str]) -> Callable:
    """A mapInArrow function: a row for each leaf that a sketched row goes to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = defaultdict(list)
            for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), strict=True)):
                groups[key].append(k)
            rows, leaves = [], []
            for key, at in groups.items():
                at, trees = np.array(at), forest.get(key)
                if trees is None:
                    rows.append(at)
                    leaves.append(np.zeros(len(at), dtype=np.int64))
                    continue
                part = batch.take(pa.array(at))
                p = projections(_bytes(part.column("q"), key[1]), part.column("scale").to_numpy())
                every = np.arange(len(at))
                for tree in range(len(trees.roots)):
                    pair, node = trees.leaves(tree, p, every, every)
                    rows.append(at[pair])
                    leaves.append(node)
            if rows:
                taken = batch.select(carried).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(leaves))], names=[*carried, "leaf"])

    return route


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the least one that links a, b reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(q: np.ndarray, scale: np.ndarray, error: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """Pairs i, j of left and right rows that may be linked, and whether they are for certain."""
    unit = q.astype(np.float32) * scale[:, None].astype(np.float32)
    slack = max(SLACK, q.shape[1] * float(np.finfo(np.float32).eps))
    largest = float(error.max(initial=0.0))
    loosest = np.float32(COSINE - largest * (2 + largest) - 2 * slack)
    other = unit[right].T
    step = max(1, (4 << 20) // max(1, len(right)))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        cosine = unit[rows] @ other
        i, j = np.nonzero(cosine >= loosest)
        if left is right:
            i, j = i[j > i + k], j[j > i + k]
        # Only the few pairs that are left have bounds of their own.
        found = cosine[i, j].astype(np.float64)
        bound = error[rows[i]] + error[right[j]] * (1 + error[rows[i]]) + slack
        near = found >= COSINE - bound
        yield rows[i[near]], right[j[near]], (found >= COSINE + bound)[near]


def _exact(vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the cosine of each pair is large enough, in double precision."""
    size = np.sqrt((vectors * vectors).sum(axis=1))
    dot = np.empty(len(i))
    for k in range(0, len(i), PAIRS):
        part = slice(k, k + PAIRS)
        dot[part] = (vectors[i[part]] * vectors[j[part]]).sum(axis=1)
    return dot / (size[i] * size[j]) >= COSINE


_FOUND = "label {label}, d int, leaf bigint, x int, y int, block int, c bigint, n bigint, root bigint, unsure boolean"


def _compared(forest: Forest, whole: bool) -> Callable[[pa.Table], pa.Table]:
    """Links of one group: those that sketches make certain, or of the others those that ``whole`` vectors confirm."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n = len(group)
        first = {c: group[c][0].as_py() for c in ("label", "d", "leaf", "x", "y")}
        d, block = first["d"], group["block"].to_numpy()
        q, scale, error = _bytes(group["q"], d), group["scale"].to_numpy(), group["error"].to_numpy()
        every = np.arange(n)
        sides = (every, every) if first["x"] == first["y"] else (every[block == first["x"]], every[block == first["y"]])
        trees = forest.get((first["label"], d))
        p = projections(q, scale) if trees is not None and len(trees.direction) > 1 else None
        vectors = scaled(_rows(group["vector"].chunk(0), d, np.float64)) if whole else None
        weight = group["w"].to_numpy().astype(np.float64)
        links, unsure = np.zeros(n), np.zeros(n, dtype=bool)
        root = every
        for i, j, certain in _near(q, scale, error, *sides):
            if whole:
                i, j = i[~certain], j[~certain]
                near = _exact(vectors, i, j)
                i, j = i[near], j[near]
                certain = np.ones(len(i), dtype=bool)
            if p is not None and len(i):
                here = trees.first_shared(first["leaf"], p, i, j)
                i, j, certain = i[here], j[here], certain[here]
            unsure[i[~certain]] = unsure[j[~certain]] = True
            i, j = i[certain], j[certain]
            links += np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
            told = np.flatnonzero(root != every)
            root = connected(n, np.r_[i, told], np.r_[j, root[told]])
        some = np.flatnonzero((links > 0) | unsure)
        c = group["c"].to_numpy()
        out = group.select(["label", "d", "leaf", "x", "y", "block"]).take(pa.array(some))
        for name, values in (("c", c), ("n", links.astype(np.int64)), ("root", c[root]), ("unsure", unsure)):
            out = out.append_column(name, pa.array(values[some]))
        return out

    return compare


def _forest(sketched: DataFrame) -> tuple[Forest, int]:
    """Trees of every label that is too large for one leaf, and the size of a leaf."""
    sizes = store(sketched.groupBy("label", "d").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    leaf = max(LEAF, math.ceil(total / MOST_LEAVES))
    large = sizes.where(F.col("n") > leaf)
    chance = f"pmod(xxhash64(c, 'sample'), {1 << 31}) < {SAMPLE}D / n * {1 << 31}"
    sampled = sketched.select("label", "d", "c", "q", "scale").join(beside(store(large)), ["label", "d"]).where(chance)
    kind = sketched.schema["label"].dataType.simpleString()
    fitted = sampled.groupBy("label", "d").applyInArrow(_fitted(leaf), f"label {kind}, d int, trees binary")
    # 18 bytes for each of at most 2 * SPREAD * TREES * MOST_LEAVES nodes.
    return {(r["label"], r["d"]): Trees.of(pickle.loads(r["trees"])) for r in fitted.collect()}, leaf


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """<id>, n_links, component_id, kept for every row of ``rows``.

    Vectors that are null, empty, zero or hold null or non-finite entries, and rows with a null label or id, are linked with
    nothing: n_links is 0, component_id the own id, kept true. Vectors of different lengths are not compared. Rows that
    repeat an id are vectors of their own, each of them counted as a link of the others. component_id is the smallest id that links reach, itself
    included. An empty table gives an empty result. Other columns are not read. Equal vectors are told by two 64-bit hashes of
    label and vector.
    """
    entry = "v IS NOT NULL AND NOT isnan(v) AND abs(CAST(v AS DOUBLE)) < CAST('Infinity' AS DOUBLE)"
    good = f"size(vector) > 0 AND forall(vector, v -> {entry}) AND exists(vector, v -> v <> 0)"
    every = rows.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    ).withColumns({"a": F.xxhash64("label", "vector"), "b": F.xxhash64(F.lit("again"), "vector", "label")})
    usable = F.coalesce(F.expr(f"id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND {good}"), F.lit(False))
    classes = (
        every.where(usable)
        .groupBy("a", "b")
        .agg(F.min("id").alias("first"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("c", F.monotonically_increasing_id())
        .withColumn("d", F.size("vector"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    sketched = store(classes.mapInArrow(_sketch, f"{schema}, q binary, scale double, error double"))
    forest, leaf = _forest(sketched)

    label = sketched.schema["label"].dataType.simpleString()
    compared = [("label", label), ("d", "int"), ("c", "bigint"), ("w", "bigint"), ("q", "binary"), ("scale", "double"), ("error", "double")]

    def routed(columns: list[tuple[str, str]]) -> DataFrame:
        names = [c for c, _ in columns]
        kinds = ", ".join(f"{c} {k}" for c, k in columns)
        needed = list(dict.fromkeys([*names, "q", "scale"]))
        return sketched.select(needed).mapInArrow(_routed(forest, names), f"{kinds}, leaf bigint")

    counts = routed(compared[:3]).groupBy("label", "d", "leaf").agg(F.count("*").alias("n"))
    blocks = store(counts.where(F.col("n") > 1.5 * leaf).withColumn("blocks", F.ceil(F.col("n") / LEAF).cast("int")).drop("n"))
    spread = (
        routed(compared)
        .join(beside(blocks), ["label", "d", "leaf"], "left")
        .withColumn("block", F.coalesce(F.expr("CAST(pmod(xxhash64(c), blocks) AS INT)"), F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
        .drop("blocks", "other")
    )
    group = ["label", "d", "leaf", "x", "y"]
    schema = _FOUND.format(label=label)
    certain = store(spread.groupBy(*group).applyInArrow(_compared(forest, False), schema))
    again = certain.where("unsure").select(*group, "block", "c").join(sketched.select("c", "w", "q", "scale", "error", "vector"), "c")
    confirmed = store(again.groupBy(*group).applyInArrow(_compared(forest, True), schema))

    found = certain.union(confirmed)
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    reached = store(components(found.where("c <> root").selectExpr("c AS a", "root AS b").distinct()))
    joined = store(
        sketched.select("a", "b", "c", "first", "w")
        .join(links, "c", "left")
        .where("n > 0 OR w > 1")
        .join(reached.withColumnRenamed("id", "c"), "c", "left")
        .selectExpr("a", "b", "first", "w - 1 + coalesce(n, 0) AS n_links", "coalesce(component, c) AS component")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    told = store(joined.join(least, "component").select("a", "b", "n_links", "component_id", F.lit(True).alias("linked")))
    out = every.select("id", "a", "b", usable.alias("linked")).join(beside(told), ["a", "b", "linked"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
