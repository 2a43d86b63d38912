"""Periodic runs of words: maximal stretches that repeat a period.

A run of period q is a stretch of at least max(LEAST, REPEATS * q) words in which words q apart are identical,
that no neighbouring word extends, and that has no smaller period.

Method, for all documents of a piece of text at once:

1. Words become numbers; documents lie one behind the other, with a separator of its own between each two, so that
   nothing matches across.
2. Harmonic grid: words q apart agree on a stretch of at least ``step(q)`` positions, so one of the positions 0,
   step, 2 * step ... lies in it. For every period these few positions are looked at, n / (3 * q) for period q,
   n * log n in all. Where the words agree, the stretch is extended to both sides by two longest common extensions (LCE).
3. LCE of any two positions: suffixes are sorted only where the position modulo 13 lies in a difference cover. Of
   any two positions the same number of words (12 at most) leads to two that are sorted. Those words are compared; the rest is
   the least of a range of neighbours' common prefixes, by a sparse table. The same on the reversed words goes to the left.
4. A stretch that also shows up under a multiple of its period keeps the least one. (A stretch of
   four periods q whose least period r is smaller has r as a divisor of q, and the same ends.)

No shuffle: a document's runs depend on its own words alone, and all of them lie in its row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of words of a run, and least number of periods.
LEAST = 6
REPEATS = 4
#: Every difference modulo 13 is that of two of these.
MODULUS = 13
COVER = (0, 1, 3, 9)
#: Bytes of text that are worked on together; a longer text is worked on alone.
PIECE = 1 << 20
#: Positions of the grid that are looked at together.
GRID = 1 << 20

_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
#: Words from positions of two remainders to two that are in the cover.
_AHEAD = np.array(
    [[next(d for d in range(MODULUS) if {(a + d) % MODULUS, (b + d) % MODULUS} <= set(COVER)) for b in range(MODULUS)]
     for a in range(MODULUS)]
)


def step(period: np.ndarray) -> np.ndarray:
    """Positions on which words that far apart agree, at least, in a run."""
    return np.maximum(LEAST, REPEATS * period) - period


class Extensions:
    """Longest common extensions to the right of pairs of positions in ``words``.

    Whatever two positions are asked for, the words from them must differ before the end of the array.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.n = n = len(words)
        top = int(words.max(initial=0)) + 1
        self.words = np.r_[words, top + np.arange(2 * MODULUS)].astype(np.int64)
        grid = np.arange(0, n, MODULUS)[:, None] + np.array(COVER)
        at = grid[grid < n].ravel()  # ascending: the cover is
        order, rank = self._first_blocks(at, top + 2 * MODULUS)
        levels = [(MODULUS, rank)]
        span = MODULUS
        while True:
            finer = self._refined(at, order, rank, span)
            if finer is None:
                break
            order, rank = finer
            span *= 2
            levels.append((span, rank))
        self.rank = rank
        self.least = self._table(self._neighbours(at[order], levels))

    def _index(self, position: np.ndarray) -> np.ndarray:
        """Where a position of the cover stands among all of them."""
        return position // MODULUS * len(COVER) + _SLOT[position % MODULUS]

    def _first_blocks(self, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The sampled suffixes in order of their first MODULUS words, and each one's rank in it."""
        packed = max(1, 62 // max(1, int(top).bit_length()))  # words in one 64-bit number
        keys = []
        for k in range(0, MODULUS, packed):
            key = np.zeros(len(at), dtype=np.int64)
            for j in range(k, min(k + packed, MODULUS)):
                key = key * top + self.words[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), dtype=bool)
        if len(at) > 1:
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        return order, self._ranks(order, new)

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        """For each suffix the place of the first one that is equal so far."""
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = first
        return rank

    def _refined(self, at, order, rank, span):
        """Order and ranks by twice as many words; None if all suffixes are told apart already."""
        first = rank[order]
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return None
        some = order[places]
        later = at[some] + span
        key = np.full(len(some), -1, dtype=np.int64)
        inside = later < self.n
        key[inside] = rank[self._index(later[inside])]
        sort = np.lexsort((key, first[places]))
        order = order.copy()
        order[places] = some[sort]
        new = np.ones(len(order), dtype=bool)
        group, key = first[places][sort], key[sort]
        new[places[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        return order, self._ranks(order, new)

    def _neighbours(self, at: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common words of each two neighbours in the order of suffixes."""
        a, b = at[:-1].copy(), at[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for span, rank in reversed(levels):
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[rank[self._index(a[inside])] == rank[self._index(b[inside])]]
            for x in (a, b, common):
                x[same] += span
        return common + self._direct(a, b, np.full(len(a), MODULUS))

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from positions a and b on, ``most`` at the most, compared one by one."""
        equal = np.zeros(len(a), dtype=np.int64)
        alive = np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            alive = alive[self.words[a[alive] + k] == self.words[b[alive] + k]]
            equal[alive] = k + 1
            alive = alive[most[alive] > k + 1]
            if not len(alive):
                break
        return equal

    @staticmethod
    def _table(common: np.ndarray) -> list[np.ndarray]:
        """Sparse table: least values of all ranges whose length is a power of two."""
        table = [common]
        while 2 << (len(table) - 1) <= len(common):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from each pair of different positions a, b on."""
        ahead = _AHEAD[a % MODULUS, b % MODULUS]
        out = self._direct(a, b, ahead)
        far = np.flatnonzero(out == ahead)
        if len(far):
            x = self.rank[self._index(a[far] + ahead[far])]
            y = self.rank[self._index(b[far] + ahead[far])]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for k in np.unique(level):
                here = level == k
                row = self.least[k]
                out[far[here]] += np.minimum(row[lo[here]], row[hi[here] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, period and position of every point of the grid, in parts."""
    periods = np.where(sizes >= LEAST, sizes // REPEATS, 0)
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    start = 0
    while start < total:
        pair = np.arange(start, min(total, start + GRID))
        doc = np.searchsorted(ends, pair, side="right")
        period = pair - (ends[doc] - periods[doc]) + 1
        points = (sizes[doc] - period - 1) // step(period) + 1
        held = max(1, int(np.searchsorted(np.cumsum(points), GRID, side="right")))
        doc, period, points = doc[:held], period[:held], points[:held]
        within = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        period = np.repeat(period, points)
        yield np.repeat(doc, points), period, within * step(period)
        start += held


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of all runs of lists of word numbers, in this order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    top = max((int(t.max(initial=0)) for t in texts), default=0) + 1
    base = np.cumsum(np.r_[1, sizes + 1])[:-1]  # of each document's first word
    line = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    line[np.r_[0, base + sizes]] = top + np.arange(len(texts) + 1)
    for start, t in zip(base, texts, strict=True):
        line[start : start + len(t)] = t
    seeds = []
    for doc, period, position in _grid(sizes):
        at = base[doc] + position
        same = np.flatnonzero(line[at] == line[at + period])
        seeds.append((doc[same], period[same], at[same]))
    if not sum(len(d) for d, _, _ in seeds):
        return (np.zeros(0, dtype=np.int64),) * 4
    doc, period, at = (np.concatenate(x) for x in zip(*seeds, strict=True))
    # Only one of the two structures is held at a time.
    right = Extensions(line).common(at, at + period)
    n = len(line)
    left = Extensions(line[::-1]).common(n - at, n - at - period)
    found = np.flatnonzero(left + right >= step(period))
    doc, period, start, length = doc[found], period[found], at[found] - left[found], (left + right + period)[found]
    sort = np.lexsort((period, length, start))
    doc, period, start, length = (x[sort] for x in (doc, period, start, length))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, period, start, length = (x[new] for x in (doc, period, start, length))
    start = start - base[doc]
    sort = np.lexsort((period, start, doc))
    return doc[sort], start[sort], length[sort], period[sort]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and last row + 1 of about PIECE bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + PIECE, side="right")), start + 1)
        yield start, end
        start = end


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for a, b in _parts(batch.column(1)):
            # bytes.split parts words at the six blanks and nowhere else.
            words = [(t or b"").split() for t in batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()]
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            doc, start, length, period = runs_of([np.array([number[w] for w in t], dtype=np.int64) for t in words])
            bounds = np.searchsorted(doc, np.arange(b - a + 1))
            kept = []
            for t, lo, hi in zip(words, bounds[:-1], bounds[1:], strict=True):
                if hi > lo:
                    inside = np.zeros(len(t) + 1, dtype=np.int64)
                    np.add.at(inside, (start + period)[lo:hi], 1)
                    np.add.at(inside, (start + length)[lo:hi], -1)
                    t = [w for w, k in zip(t, np.cumsum(inside[:-1]), strict=True) if not k]
                kept.append(b" ".join(t))
            rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(struct))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(t) for t in words], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows),
                    pa.array(kept, type=pa.binary()).cast(pa.string()),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, n_words, runs, collapsed of every row of ``docs``, in one pass without a shuffle.

    ``runs`` is an array of (start, length, period), by start, then period; starts count words from 0. ``collapsed``
    holds the words that no run has after its first period, joined by one space. Words lie between the blanks
    of ASCII; their case counts.

    Null and blank texts have no words, no runs and an empty ``collapsed``. A text of any length is worked on whole: of n words some 60 * n
    bytes are held, and n * log n positions are looked at in parts. Rows that repeat, and null ids, are treated as any
    other row. An empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_find, schema).withColumnRenamed("id", id_col)


def longest_repetition(runs: F.Column) -> F.Column:
    """The run with the greatest length / period, compared exactly; on a tie the first. Null without runs."""

    def better(best: F.Column, run: F.Column) -> F.Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, better)
