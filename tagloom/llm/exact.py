"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal if they are identical once blanks are deleted. Built from SQL
expressions alone.

1. One pass over the texts makes a narrow row for each: its length without blanks and
   the hash of its first PREFIX code points.
2. Rows whose length is unique fall out; of the others, those whose length and prefix
   hash are unique. Both are counts that combine before the shuffle.
3. Texts whose length and prefix hash are left over are read in full and hashed with SHA-256; groups
   are formed by that digest and the length.

Texts are read where they lie, at any size: lengths and hashes left over are broadcast, or beyond BROADCAST_BYTES a bitmap of
theirs (see ``_read``); what comes of it is narrow. Where the digest of every row is wanted, it is made once and
feeds the groups. Only ``drop_duplicates`` moves texts, when the rows to be dropped are too many to be broadcast.
A hot group is one key of joins whose other side has one row a key, so AQE can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import BROADCAST_BYTES, beside, measured, store, unused

PREFIX = 64
#: Groups, with their digests some WIDTH bytes each, that may be sent to every executor.
WIDE_ROWS = 250_000
WIDTH = 200
#: Words of 64 bits of the bitmap: some 40 MB where it is joined.
WORDS = 1 << 20
#: Fixed: the characters that are deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text_col: str) -> F.Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")


def digest(text_col: str) -> F.Column:
    """SHA-256 of the normalised text, in lowercase hex."""
    return F.sha2(normalised(text_col), 256)


def _chars(text_col: str) -> F.Column:
    return F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, length, prefix of every row."""
    text = normalised(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix"),
    )


_KEY = ["length", "prefix"]


def _shared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """length, prefix that two rows or more have."""
    rows = store(_located(docs, id_col, text_col).select("length", "prefix"))
    lengths = store(rows.groupBy("length").count().where("count > 1").select("length"))
    same_length = rows.join(beside(lengths), "length", "left_semi")
    return store(same_length.groupBy(*_KEY).count().where("count > 1").select(*_KEY))


def _bitmap(keys: DataFrame) -> DataFrame:
    """word, bits: a bit for each of ``keys`` (length, prefix), in at most WORDS words."""
    slot = F.pmod(F.xxhash64(*_KEY), F.lit(64 * WORDS))
    bits = keys.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), (slot % 64).cast("int").alias("at"))
    return store(bits.groupBy("word").agg(F.expr("bit_or(shiftleft(one, at))").alias("bits")))


def _read(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_sha256, length, prefix, chars, raw of the rows whose length and prefix are among ``keys``, read in full.

    No text moves. Keys that are too many to be broadcast are folded into a bitmap of bounded size, which lets their texts pass, and some
    others: these are hashed for nothing and fall out of the join of narrow rows that follows. A bitmap that is full lets all texts pass.
    """
    rows = _located(docs, id_col, text_col)
    few = measured(keys) <= BROADCAST_BYTES
    if few:
        some = rows.join(F.broadcast(keys), _KEY, "left_semi")
    else:
        slot = F.pmod(F.xxhash64(*_KEY), F.lit(64 * WORDS))
        placed = rows.withColumns({"word": F.shiftright(slot, 6), "at": (slot % 64).cast("int")})
        some = placed.join(F.broadcast(_bitmap(keys)), "word").where("shiftright(bits, at) & 1 = 1")
    read = some.select(
        "id", digest("text").alias("text_sha256"), *_KEY, _chars("text").alias("chars"), F.xxhash64(F.col("text").cast("string")).alias("raw")
    )
    return store(read if few else read.join(keys.hint("merge"), _KEY, "left_semi"))


def _survivors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What is read of the rows that share length and prefix with another."""
    return _read(docs, _shared(docs, id_col, text_col), id_col, text_col)


def _groups(survivors: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("chars")).alias("n"), F.col("id").isNull().alias("none"), "id"))
    return store(
        survivors.groupBy("text_sha256", "length")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .where("group_size > 1")
        .selectExpr("text_sha256", "best.id AS keep_id", "-best.n AS keep_chars", "group_size")
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_sha256, keep_id, keep_chars, group_size of each group of two rows or more.

    Of a group, the row with the most code points stays, then the one with the smallest
    id; a null id comes after all others.
    """
    return _groups(_survivors(docs, id_col, text_col))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null and blank texts are equal to one another and so form one group. Ties
    on length go to the smallest id. Rows that repeat both id and text are
    kept or dropped alike (``drop_duplicates`` keeps one of them). An empty table
    gives an empty result. A text of any length is read whole. Other columns are not read.

    The digest is wanted for every row, so every text is hashed, once and where it lies; groups are only looked for
    among rows that share length and prefix. No text is in an exchange, whatever the size.
    """
    keys = _shared(docs, id_col, text_col)
    rows = store(
        _located(docs, id_col, text_col).select("id", *_KEY, digest("text").alias("text_sha256"), _chars("text").alias("chars"))
    )
    groups = _groups(rows.join(beside(keys), _KEY, "left_semi"))
    in_group = F.col("group_size").isNotNull()
    return rows.join(beside(groups, WIDE_ROWS * WIDTH), "text_sha256", "left").select(
        F.col("id").alias(id_col),
        F.when(in_group, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(in_group, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
        .otherwise(True)
        .alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows are told apart by id and the hash of the text as it stands, so an id that repeats
    with another text is judged by its own text. Where both repeat, the largest
    row by its other columns stays.
    """
    survivors = _survivors(docs, id_col, text_col)
    members = store(survivors.join(beside(_groups(survivors), WIDE_ROWS * WIDTH), "text_sha256"))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    keyed = members.select("id", "raw", stays.alias("stays"))
    lost = store(keyed.where("NOT stays").select("id", "raw").distinct())
    twice = store(keyed.where("stays").groupBy("id", "raw").count().where("count > 1").select("id", "raw"))

    of, own = unused(docs, "id_", "raw_")

    def among(rows: DataFrame) -> F.Column:
        return F.col(id_col).eqNullSafe(rows[of]) & (F.xxhash64(F.col(text_col).cast("string")) == rows[own])

    lost, twice = lost.toDF(of, own), twice.toDF(of, own)
    left = docs.join(beside(lost), among(lost), "left_anti")
    if twice.isEmpty():
        return left
    row = F.max(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    one = left.join(beside(twice), among(twice), "left_semi").groupBy(id_col, text_col).agg(row.alias("row"))
    return left.join(beside(twice), among(twice), "left_anti").unionByName(one.select("row.*"))
