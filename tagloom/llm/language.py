"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each slot is a bitmask with a bit for each
language, so the filters lie bit-sliced in one table. Looking up an n-gram under
HASHES hash functions and AND-ing the slots gives all languages that contain
it at once. For each text the bits are counted by language, the counts are corrected for the
false positives that each language's fill makes likely, and the largest share wins.

N-grams are runs of GRAM bytes of the lower-cased text, digits and punctuation
read as blanks. An n-gram belongs to a language if it is common there and not much
commoner elsewhere. The filters are fitted on a bounded sample of labelled rows (SAMPLE a
language, those with the least hashes); every text is then read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import least_hashes, store
from tagloom.llm.words import U, mixed, pieces

UNKNOWN = "und"
GRAM = 4
#: Labelled rows a language that the filters are fitted on.
SAMPLE = 400
#: Share of a language's sampled texts that an n-gram must be in.
COMMON = 0.02
#: Least share of its rate in any other language.
NEAR = 0.5
SLOT_BITS = 18
HASHES = 2

_BLANK = 32


def _byte_classes() -> np.ndarray:
    """ASCII letters and all non-ASCII bytes as they are, all else a blank."""
    table = np.arange(256, dtype=np.uint32)
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = _BLANK
    return table


CLASSES = _byte_classes()


def grams(data: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte, packed in 32 bits; 0 inside runs of blanks."""
    c = CLASSES[data]
    n = max(0, len(c) - GRAM + 1)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(GRAM):
        out |= c[k : k + n] << np.uint32(8 * k)
    blank = c == _BLANK
    out[(blank[:n] & blank[1 : n + 1])[:n]] = 0
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of the lower-cased texts, each text with a blank on either side."""
    blank, nothing = (pa.scalar(x, type=pa.large_string()) for x in (" ", ""))
    yield from pieces(column, lambda part: pc.binary_join_element_wise(blank, pc.utf8_lower(part), blank, nothing))


def _within(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n n-grams lie within one text."""
    ok = np.ones(n, dtype=bool)
    for k in range(1, GRAM):
        cut = offsets[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """language, n-gram of each text, once a text."""
    for batch in batches:
        for a, _, data, offsets in _texts(batch.column(1)):
            all_ = grams(data)
            for k, (start, end) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = np.unique(all_[start : max(start, end - GRAM + 1)])
                own = own[own != 0]
                language = batch.column(0)[a + k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(own), type=pa.string()), pa.array(own.astype(np.int64))],
                    names=["lang", "gram"],
                )


class Filters:
    """The bit-sliced filters: slots x 64-bit words of language bits."""

    def __init__(self, languages: list[str], members: dict[str, np.ndarray]) -> None:
        self.languages = languages
        words = max(1, -(-len(languages) // 64))
        self.slots = np.zeros((1 << SLOT_BITS, words), dtype=U)
        for bit, language in enumerate(languages):
            for at in self._at(members[language].astype(np.uint32)):
                np.bitwise_or.at(self.slots[:, bit // 64], at, U(1) << U(bit % 64))
        fill = np.array([self._has(self.slots[:, b // 64], b).mean() for b in range(len(languages))])
        self.false = fill**HASHES

    @staticmethod
    def _has(words: np.ndarray, bit: int) -> np.ndarray:
        return ((words >> U(bit % 64)) & U(1)).astype(bool)

    @staticmethod
    def _at(own: np.ndarray) -> list[np.ndarray]:
        h = mixed(own.astype(U) * U(0x9E3779B97F4A7C15))
        return [(h >> U(64 - SLOT_BITS * (k + 1))) & U((1 << SLOT_BITS) - 1) for k in range(HASHES)]

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, the corrected share of its n-grams that each language contains."""
        own = grams(data)
        counted = (own != 0) & _within(offsets, len(own))
        first, *rest = self._at(own)
        masks = self.slots[first]
        for at in rest:
            masks &= self.slots[at]
        bounds = np.minimum(offsets, len(own))

        def per_text(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(flags)][bounds])

        total = np.maximum(per_text(counted), 1)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for bit in range(len(self.languages)):
            share = per_text(self._has(masks[:, bit // 64], bit) & counted) / total
            out[:, bit] = np.maximum(0, (share - self.false[bit]) / (1 - self.false[bit]))
        return out


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Filters:
    """Filters from a sample of ``labelled``; languages are its non-null labels.

    Null and empty texts teach nothing; rows that repeat id, text and label count once. An empty table gives filters without a language.

    The driver gets the common n-grams of the sample only.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    own_hash = F.xxhash64(F.col("id").cast("string"), "text")
    ids = store(least_hashes(rows.select("lang", "id", own_hash.alias("hash")), "lang", SAMPLE))
    # At most SAMPLE rows a language.
    chosen = rows.join(
        F.broadcast(ids.toDF("l", "i", "h")),
        (F.col("lang") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")) & (own_hash == F.col("h")),
        "left_semi",
    )
    counts = chosen.select("lang", "text").mapInArrow(_count_grams, "lang string, gram bigint").groupBy("lang", "gram").count()
    sizes = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}
    most = store(counts)
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)) if sizes else None
    if size is None:
        return Filters([], {})
    rated = store(most.withColumn("rate", F.col("count") / size[F.col("lang")]).where(f"count > 1 AND rate >= {COMMON}"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    table = rated.join(top, "gram").where(f"rate >= {NEAR} * top").select("lang", "gram").toArrow()
    members = {lang: np.zeros(0, dtype=np.int64) for lang in sizes}
    for lang in members:
        own = table.filter(pc.equal(table["lang"], lang))["gram"]
        members[lang] = np.sort(own.to_numpy())
    return Filters(sorted(members, key=lambda x: x.encode()), members)


def _labeller(filters: Filters) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*filters.languages, UNKNOWN], dtype=object)
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _texts(batch.column(1)):
                shares = filters.shares(data, offsets)
                if filters.languages:
                    best = np.where(letters[a:b], shares.argmax(axis=1), len(filters.languages))
                    top = np.where(letters[a:b], shares.max(axis=1), 0.0)
                    total = shares.sum(axis=1)
                    score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
                else:
                    best, top, score = np.zeros(b - a, dtype=int), np.zeros(b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(names[best], type=pa.string()),
                        pa.array(np.where(top > 0, score, 0.0)),
                        pa.array(top),
                    ],
                    names=["id", "lang_pred", "score", "coverage"],
                )

    return label


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, lang_pred, score, coverage of every row of ``docs``, without a shuffle.

    ``coverage`` is the corrected share of the text's n-grams that the language contains,
    ``score`` that share among those of all languages. A text that is null or has no letter gets
    "und" with 0; on a tie the language that comes first by code point wins. Without any
    language learned every row gets "und". Ids pass through as they are, null and repeated ones, too. An empty table gives an
    empty result; a text of any length is read whole. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
        .mapInArrow(_labeller(filters), f"id {kind}, lang_pred string, score double, coverage double")
        .withColumnRenamed("id", id_col)
    )


def known(docs: DataFrame, filters: Filters, coverage: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text is in no language, or covered by less; all columns stay.

    Each row is judged by itself in one pass: null and repeated ids do not matter. Only texts go to Python, and only verdicts
    come back. An empty table gives an empty result.
    """
    label = _labeller(filters)

    @F.arrow_udf("boolean")
    def stays(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            told = [pa.array([], type=pa.bool_())]
            for judged in label(iter([pa.RecordBatch.from_arrays([texts, texts], names=["id", "text"])])):
                told.append(pc.and_(pc.not_equal(judged.column(1), UNKNOWN), pc.greater_equal(judged.column(3), coverage)))
            yield pa.concat_arrays(told)

    return docs.where(stays(F.col(text_col).cast("string")))
