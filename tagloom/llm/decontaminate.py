"""Benchmark passages in training documents, found by spaced-seed hashing.

A seed is a fixed mask over neighbouring tokens; positions that the mask leaves
out may differ. The seeds of all items and of all documents are joined by their hashes. Around a hit the item is laid beside the
document and compared token by token; a passage is a run of the two in which enough tokens, and at
least half of them, are equal, so substituted words do not hide it.

Texts are told apart by two 64-bit hashes, not by ids, so every row is judged by its own text and copies are
looked at once. Steps, each a Spark job over tables:

1. Seeds of the items. Seeds whose lists of items and positions are the same but for a shift are one class: a passage
   of forty tokens that only one item has makes some 140 seeds and one class, a prompt that
   many items share a dozen seeds and one class.
2. One pass over the documents: their seeds that pass a Bloom filter of the items' seeds (see ``sieve``; a fuller filter lets more
   rows into the next join and loses none). Joined with the classes, they give text, class and shift.
3. Classes of at most HOT items are joined with their items: text, item and shift. Only texts that have such a row are
   read again, as token hashes, and only the part that lies beside an item goes on to be compared.
4. Larger classes (shared prompts) would make a row for each of their items and each text. Instead, blocks of items are laid
   beside blocks of texts as matrices: all of them are compared, and nothing but passages comes out. Both sides are
   salted, so no group is larger than two blocks, however many texts and items share a prompt.

No item, seed or text goes through the driver, except the bits of the filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import beside, store, without
from tagloom.llm.sieve import passing, sieve
from tagloom.llm.words import ALNUM_PARTED, U, mixed, numbers, pieces, word_hashes

#: Every run of nine tokens with one substitution, and longer ones in which every
#: second, third or fourth token is substituted, agree under one of these. None has more gaps
#: than tokens, as no passage has.
MASKS = ("11111", "111011", "1101101", "101010101")
#: A passage is a run of the overlap with so many equal tokens, or with COVER of a shorter item, in
#: which no more tokens differ than are equal.
TOKENS = 12
COVER = 0.8
#: What a differing token costs, in equal ones.
COST = 1
#: Bytes of token hashes that are compared at a time.
BLOCK_BYTES = 4 << 20
#: Items of a class up to which they are joined row by row.
HOT = 64
#: Items and texts of a block in the comparison of larger classes.
ITEMS, TEXTS = 2048, 4096
_PASSAGE = "a bigint, b bigint, i bigint, doc_start bigint, item_start bigint, length bigint, matched bigint"


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, token hashes and row bounds; case is folded."""
    for a, b, data, offsets in pieces(texts, pc.utf8_lower):
        yield a, b, *word_hashes(data, offsets, ALNUM_PARTED)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash of each position at which the whole mask fits."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, dtype=U)
    factors = numbers(len(mask), 307)
    out = np.full(n, int(mask, 2), dtype=U)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * factors[k]
    return mixed(out)


def needed(length: int) -> int:
    """Equal tokens that make an overlap with an item of this length a passage."""
    return min(TOKENS, max(5, math.ceil(COVER * length)))


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and number of equal tokens of the run with most of them, at least half being equal."""
    score = np.cumsum(np.r_[0, np.where(equal, 1, -COST)])
    # The longest run with a score of at least 0 has the most: any other could be extended to its length.
    starts = np.searchsorted(-np.minimum.accumulate(score), -score, side="left")
    end = int(np.argmax(np.arange(len(score)) - starts))
    start = int(starts[end])
    at = np.flatnonzero(equal[start:end])
    if not len(at):
        return 0, 0, 0
    return start + int(at[0]), start + int(at[-1]) + 1, len(at)


def _hashes(text: str) -> tuple[F.Column, F.Column]:
    """What stands for a text."""
    whole = F.col(text).cast("string")
    return F.xxhash64(whole), F.xxhash64(F.lit("text"), whole)


def _keys(text: str) -> list[F.Column]:
    return [h.alias(name) for h, name in zip(_hashes(text), "ab", strict=True)]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, tokens of rows a, b, text."""
    for batch in batches:
        for start, end, words, bounds in tokens(batch.column(2)):
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(words, bounds)], names=["a", "b", "tokens"])


def _placed(words: np.ndarray, bounds: np.ndarray, passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """Row, hash and position of every seed that passes, mask by mask."""
    for mask in MASKS:
        own = seeds(words, mask)
        at = passes(own)
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = at + len(mask) <= bounds[row + 1]
        at, row = at[inside], row[inside]
        yield row, own[at], at - bounds[row]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, i, position of the seeds of rows i, tokens."""
    for batch in batches:
        column = batch.column(1)
        words = column.flatten().to_numpy(zero_copy_only=False).view(U)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
        for row, h, at in _placed(words, bounds, lambda own: np.arange(len(own))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at)], names=["h", "i", "position"]
            )


def _hits(bloom: np.ndarray) -> Callable:
    """A mapInArrow function: a, b, h, position of the seeds of rows a, b, text that pass the filter."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, words, bounds in tokens(batch.column(2)):
                for row, h, at in _placed(words, bounds, lambda own: passing(bloom, own)):
                    if len(row):
                        rows = pa.array(start + row)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h.view(np.int64)), pa.array(at)],
                            names=["a", "b", "h", "position"],
                        )

    return find


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 7
    names = [c.split(" ")[0] for c in _PASSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of rows a, b, i, doc_first, item_first, length, x, y: tokens of a text and of an item side by side."""
    for batch in batches:
        keys = [batch.column(k).to_pylist() for k in range(3)]
        doc, first, size = (batch.column(k).to_numpy() for k in range(3, 6))
        x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (6, 7))
        equal = x == y
        ends = np.cumsum(pc.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False))
        total = np.r_[0, np.cumsum(equal)][ends]
        total[1:] -= total[:-1].copy()
        found = []
        for k in np.flatnonzero(total >= np.array([needed(n) for n in size])):
            start, end, matched = best_run(equal[ends[k - 1] if k else 0 : ends[k]])
            if matched >= needed(int(size[k])):
                found.append((*(c[k] for c in keys), int(doc[k]) + start, int(first[k]) + start, end - start, matched))
        if found:
            yield _rows_of(found)


def _laid_beside(texts: pa.Table, items: pa.Table) -> pa.Table:
    """Passages of a block of texts (a, b, shift, first, size, window) and one of items (i, off, tokens) of one class.

    An item's token k lies beside the text's token shift + k - off; ``window`` holds the text's tokens from ``first`` on, of ``size``.
    """
    found = []
    items, texts = items.combine_chunks(), texts.combine_chunks()
    lists = [np.asarray(t, dtype=np.int64) for t in items["tokens"].to_pylist()]
    off, ids = items["off"].to_numpy(), items["i"].to_pylist()
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    rows = list(zip(*(texts[c].to_pylist() for c in ("a", "b", "shift", "first", "size")), texts["window"].to_pylist(), strict=True))
    while order:
        # Items of like length, as many as BLOCK_BYTES hold.
        before = after = 0
        part: list[int] = []
        while order:
            k = order[0]
            wider = max(before, int(off[k])), max(after, len(lists[k]) - int(off[k]))
            if part and (len(part) + 1) * sum(wider) * 8 > BLOCK_BYTES:
                break
            before, after = wider
            part.append(order.pop(0))
        matrix = np.zeros((len(part), before + after), dtype=np.int64)
        held = np.zeros(matrix.shape, dtype=bool)
        for r, k in enumerate(part):
            at = before - int(off[k])
            matrix[r, at : at + len(lists[k])] = lists[k]
            held[r, at : at + len(lists[k])] = True
        enough = np.array([needed(len(lists[k])) for k in part])
        for a, b, shift, first, size, window in rows:
            # The text's tokens from shift - before on.
            start = shift - before
            lo, hi = max(start, first), min(start + before + after, first + len(window))
            if hi <= lo:
                continue
            columns = slice(lo - start, hi - start)
            equal = (matrix[:, columns] == np.asarray(window[lo - first : hi - first], dtype=np.int64)) & held[:, columns]
            for r in np.flatnonzero(equal.sum(axis=1) >= enough):
                k = part[r]
                moved = shift - int(off[k])  # of the item in the text
                from_, to = max(0, -moved), min(len(lists[k]), size - moved)
                run = equal[r, from_ + moved - lo : to + moved - lo]
                begin, end, matched = best_run(run)
                if matched >= enough[r]:
                    found.append((a, b, ids[k], from_ + begin + moved, from_ + begin, end - begin, matched))
    return pa.Table.from_batches([_rows_of(found)])


def _classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (h, class g, least position c), and items of classes (g, i, off, n): n items in g, i with g at c + off."""
    seeds_ = store(items.select("i", "tokens").mapInArrow(_item_seeds, "h bigint, i bigint, position bigint"))
    least = seeds_.groupBy("h").agg(F.min("position").alias("c"))
    moved = store(seeds_.join(least, "h").selectExpr("h", "c", "i", "position - c AS off"))
    alike = store(
        moved.groupBy("h", "c").agg(
            F.expr("bit_xor(xxhash64(i, off))").alias("x"), F.expr("bit_xor(xxhash64('again', i, off))").alias("y"), F.count("*").alias("n")
        )
    )
    same = ["x", "y", "n"]
    first = store(alike.groupBy(*same).agg(F.min("h").alias("g")))
    classes = store(alike.join(first, same).select("h", "c", "g"))
    members = moved.join(first.select(F.col("g").alias("h"), "n"), "h").selectExpr("h AS g", "i", "off", "n")
    return classes, store(members)


def _found(texts: DataFrame, items: DataFrame) -> DataFrame:
    """a, b, i, doc_start, item_start, length, matched of every passage of items (i, tokens) in texts (a, b, text)."""
    spark = texts.sparkSession
    classes, members = _classes(items)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], _PASSAGE)
    hits = texts.mapInArrow(_hits(sieve(classes, n)), "a bigint, b bigint, h bigint, position bigint")
    aligned = store(hits.join(beside(classes), "h").selectExpr("a", "b", "g", "position - c AS shift").distinct())
    sides = store(items.selectExpr("i", "tokens AS item", "CAST(size(tokens) AS BIGINT) AS n_item"))

    # Texts that have a hit, once each, as tokens.
    some = store(aligned.select("a", "b").distinct())
    read = texts.join(beside(some), ["a", "b"], "left_semi").mapInArrow(_tokenised, "a bigint, b bigint, tokens array<bigint>")
    held = store(read.groupBy("a", "b").agg(F.first("tokens").alias("tokens")).withColumn("n_doc", F.size("tokens").cast("bigint")))

    few = members.where(F.col("n") <= HOT).drop("n")
    pairs = aligned.join(beside(few), "g").selectExpr("a", "b", "i", "shift - off AS shift").distinct()
    first, last = "greatest(0L, -shift)", "least(n_item, n_doc - shift)"
    cut = f"CAST({first} + 1 AS INT), CAST({last} - ({first}) AS INT)"
    beside_ = pairs.join(beside(sides), "i").join(held, ["a", "b"]).where(f"{last} > {first}")
    beside_ = beside_.selectExpr(
        "a", "b", "i", f"{first} + shift AS doc_first", f"{first} AS item_first", "n_item AS length",
        f"slice(tokens, CAST({first} + shift + 1 AS INT), CAST({last} - ({first}) AS INT)) AS x", f"slice(item, {cut}) AS y",
    )
    found = beside_.mapInArrow(_compared, _PASSAGE)

    many = members.where(F.col("n") > HOT).join(sides, "i")
    reach = store(
        many.groupBy("g").agg(F.max("off").alias("before"), F.max(F.col("n_item") - F.col("off")).alias("after"), F.max("n").alias("n"))
    )
    if not reach.isEmpty():
        found = found.unionByName(_crowded(aligned, many, reach, held))
    return store(found.distinct())


def _crowded(aligned: DataFrame, many: DataFrame, reach: DataFrame, held: DataFrame) -> DataFrame:
    """Passages of items of large classes, block by block."""
    hot = aligned.join(beside(reach), "g")
    texts = hot.groupBy("g").agg(F.count("*").alias("texts"))
    parts = store(
        reach.join(texts, "g").selectExpr("g", f"CAST(ceil(n / {ITEMS}) AS INT) AS ni", f"CAST(ceil(texts / {TEXTS}) AS INT) AS nt")
    )
    first = "greatest(0L, shift - before)"
    left = (
        hot.join(beside(parts), "g")
        .join(held, ["a", "b"])
        .where(f"shift + after > 0 AND shift - before < n_doc")
        .selectExpr(
            "g", "a", "b", "shift", f"{first} AS first", "n_doc AS size", "ni", "CAST(pmod(xxhash64(a, b, shift), nt) AS INT) AS t",
            f"slice(tokens, CAST({first} + 1 AS INT), CAST(shift + after - ({first}) AS INT)) AS window",
        )
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
        .drop("ni")
    )
    right = (
        many.join(beside(parts), "g")
        .selectExpr("g", "i", "off", "item AS tokens", "nt", "CAST(pmod(xxhash64(i, off), ni) AS INT) AS k")
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
        .drop("nt")
    )
    group = ["g", "k", "t"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_laid_beside, _PASSAGE)


def _items(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (a, b, i, tokens), one for each text of five tokens or more; and their ids (item_id, a, b)."""
    rows = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    texts = rows.select(*_keys("text"), "text").dropDuplicates(["a", "b"])
    least = min(mask.count("1") for mask in MASKS)
    read = texts.mapInArrow(_tokenised, "a bigint, b bigint, tokens array<bigint>").where(F.size("tokens") >= least)
    return store(read.withColumn("i", F.monotonically_increasing_id())), store(rows.select("item_id", *_keys("text")))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").select(*_keys("text"), "text")


def passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """<id>, item_id, doc_start, item_start, length, matched of every benchmark passage.

    Positions and lengths count tokens: runs of letters and digits, case folded. Null and empty texts
    have none. Items of fewer than five tokens fit no mask and match nothing. A passage
    that stands twice in a document, or in two items, is listed each time; rows that repeat an id
    each list theirs. Without documents or items the result is empty. A text of any length is read whole.
    """
    items, ids = _items(benchmark, item_id_col, item_text_col)
    found = _found(_texts(docs, text_col), items)
    named = store(found.join(items.select("i", F.col("a").alias("of_a"), F.col("b").alias("of_b")), "i").join(
        ids.selectExpr("item_id", "a AS of_a", "b AS of_b"), ["of_a", "of_b"]
    ).select("a", "b", "item_id", "doc_start", "item_start", "length", "matched"))
    rows = docs.select(F.col(id_col).alias("row_id"), *_keys(text_col))
    return store(
        rows.join(beside(named), ["a", "b"]).select(
            F.col("row_id").alias(id_col), "item_id", "doc_start", "item_start", "length", "matched"
        )
    )


def _summed(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(
        F.count("*").alias("n_passages"),
        F.max("matched").alias("matched"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
    )


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, contaminated, n_passages, matched (equal tokens of the longest), item_ids of every row, by id.

    Rows that share an id are judged together. A null id is never joined to a passage: its row is judged clean, and ``decontaminated`` keeps it.
    ``judge_rows`` judges every row by its own text. An empty table of documents gives an empty result, one of items calls every row clean.
    """
    found = passages(docs.select(F.col(id_col).alias("judged"), F.col(text_col).alias("read")), benchmark, "judged", "read")
    per_doc = store(_summed(found, "judged"))
    rows = docs.select(F.col(id_col).alias("row"))
    return rows.join(beside(per_doc), F.col("row") == F.col("judged"), "left").select(
        F.col("row").alias(id_col), F.col("judged").isNotNull().alias("contaminated"), *_verdict()
    )


def _verdict() -> list[F.Column]:
    return [
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.col("item_ids"),
    ]


def judge_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, contaminated, n_passages, matched, item_ids of every row, each judged by its own text.

    As ``judge``, but null and repeated ids do not matter. An empty table gives an empty result; a null or empty text
    is clean; a column of the table may have any name.
    """
    texts = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("read"))
    items, ids = _items(benchmark, "item_id", "text")
    found = _found(_texts(texts, "read"), items)
    named = found.join(items.select("i", F.col("a").alias("of_a"), F.col("b").alias("of_b")), "i").join(
        ids.selectExpr("item_id", "a AS of_a", "b AS of_b"), ["of_a", "of_b"]
    )
    told = store(_summed(named, "a", "b"))
    rows = texts.select("row", *_keys("read")).join(beside(told), ["a", "b"], "left")
    return rows.select(F.col("row").alias(id_col), F.col("n_passages").isNotNull().alias("contaminated"), *_verdict())


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns stay.

    Rows that share an id go together, and null ids stay; ``clean_rows`` judges each row by itself.
    """
    return without(docs, passages(docs, benchmark, id_col, text_col), id_col)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark passage; all columns stay.

    Null and repeated ids do not matter. An empty table gives an empty result.
    """
    items, _ = _items(benchmark, "item_id", "text")
    found = store(_found(_texts(docs, text_col), items).select(F.col("a").alias("a_"), F.col("b").alias("b_")).distinct())
    a, b = _hashes(text_col)
    return docs.join(beside(found), (a == found["a_"]) & (b == found["b_"]), "left_anti")
