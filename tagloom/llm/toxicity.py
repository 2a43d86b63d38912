"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, invisible characters, and
digits or signs that stand for letters inside a word. The lexicon holds words, and beginnings of words, that are
commoner in toxic rows than in others; a term's weight is the logarithm of that ratio, less CAUTION
standard errors, so that a few chance rows make no term.
Exception phrases, a term together with a neighbouring word, lift the match inside them. Matched weights, as a
sum and for each hundred words, go into a logistic score.

The lexicon and the logistic are fitted on a bounded sample of labelled rows: SAMPLE rows of either label, those
with the least hashes, half for the terms and half for the logistic. All terms that pass the bounds of support and weight are in the lexicon, but for
those that a shorter beginning of the same weight or more stands for, which can never decide. Every text is then read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.scratch import least_hashes, store

#: Labelled rows of either label that are learnt from.
SAMPLE = 6000
#: Toxic rows that must hold a term; least weight.
SUPPORT = 4
WEIGHT = 1.5
CAUTION = 1.5
#: Least length of a term, and lengths of beginnings.
SHORTEST = 3
STEMS = (5, 6, 7)
#: Clean rows, and none that is toxic, that make a term with a neighbour an exception.
EXCEPTIONS = 3
THRESHOLD = 0.7

#: Fixed: letters of other scripts by the Latin letters they look like, in order.
HOMOGLYPHS = {
    "a": "аɑα",
    "b": "ƅ",
    "c": "сϲ",
    "d": "ԁ",
    "e": "еҽ",
    "g": "ɡ",
    "h": "һ",
    "i": "іıι",
    "j": "ј",
    "k": "κк",
    "l": "ӏⅼ",
    "m": "м",
    "n": "ո",
    "o": "оοօ",
    "p": "рρ",
    "q": "ԛ",
    "r": "г",
    "s": "ѕ",
    "t": "т",
    "u": "υս",
    "v": "ѵν",
    "w": "ԝ",
    "x": "х",
    "y": "уγ",
    "z": "ᴢ",
}
#: Fixed: what digits and signs stand for inside a word.
LEET = str.maketrans("013457@$!|", "oieastasil")

_FOREIGN = str.maketrans(
    {look: plain for plain, looks in HOMOGLYPHS.items() for look in looks}
    | {0xFF41 + k: chr(97 + k) for k in range(26)}  # full-width letters
    | {0xFF10 + k: chr(48 + k) for k in range(10)}
    | dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])  # invisible
)
_HAS_FOREIGN = re.compile(f"[{''.join(map(chr, _FOREIGN))}]")
_HAS_LEET = re.compile(r"[^\W\d_][0-9@$!|][^\W_]|(?<!\w)[0-9@$][^\W\d_]|[^\W\d_][0-9]")
_LEET_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!|][^\W_]+)*")
_WORD = re.compile(r"[^\W\d_]+")


def _plain(m: re.Match) -> str:
    word = m[0]
    letters = sum(c.isalpha() for c in word)
    return word.translate(LEET) if 3 * letters >= len(word) > letters else word


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    text = text.lower()
    if not text.isascii() and _HAS_FOREIGN.search(text):
        text = text.translate(_FOREIGN)
    if _HAS_LEET.search(text):
        text = _LEET_WORD.sub(_plain, text)
    return text


def word_before(text: str, start: int) -> str:
    """The word that only blanks part from what begins at ``start``, whatever its length; else empty."""
    end = start
    while end and text[end - 1] in " \t":
        end -= 1
    first = end
    while end < start and first and text[first - 1].isalnum() and not text[first - 1].isdecimal():
        first -= 1
    return text[first:end]


def _candidates(text: str) -> set[str]:
    """Words, beginnings (``stem*``) and neighbours (``word word``) of a folded text."""
    words = [w for w in _WORD.findall(text) if len(w) >= SHORTEST]
    out = set(words)
    out.update(w[:n] + "*" for w in set(words) if len(w) > STEMS[0] for n in STEMS if len(w) > n)
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(_candidates(fold(text)))
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, type=pa.string()),
                pa.array([toxic[t] for t in terms], type=pa.int64()),
                pa.array([clean[t] for t in terms], type=pa.int64()),
            ],
            names=["term", "toxic", "clean"],
        )


class Lexicon:
    """Weights of words and beginnings, and exception phrases of two words."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()) -> None:
        self.weights, self.exceptions = weights, exceptions
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def _built(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            made = ahocorasick.Automaton()
            by_text: dict[str, list[tuple[bool, float]]] = defaultdict(list)
            for term, weight in self.weights.items():
                by_text[term.rstrip("*")].append((term.endswith("*"), weight))
            for text, terms in by_text.items():
                made.add_word(text, (len(text), terms))
            if by_text:
                made.make_automaton()
            self.automaton = made
        return self.automaton

    def matches(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start and end of each word of the folded text that a term matches, and the largest weight."""
        found = self._built()
        if not len(found):
            return
        best: dict[int, float] = {}
        for last, (length, terms) in found.iter(text):
            start = last + 1 - length
            if start and text[start - 1].isalpha():
                continue
            inside = last + 1 < len(text) and text[last + 1].isalpha()
            weight = max((w for begins, w in terms if begins or not inside), default=0.0)
            if weight > best.get(start, 0.0):
                best[start] = weight
        for start in sorted(best):
            yield start, _WORD.match(text, start).end(), best[start]

    def phrases(self, text: str, start: int, end: int) -> list[str]:
        """A matched word together with the word before, and with the one after."""
        word, out = text[start:end], []
        if first := word_before(text, start):
            out.append(f"{first} {word}")
        if m := re.compile(r"[ \t]+([^\W\d_]+)").match(text, end):
            out.append(f"{word} {m[1]}")
        return out

    def features(self, text: str) -> tuple[float, float]:
        """Logarithms of the matched weight, and of that for each hundred words."""
        folded = fold(text)
        total = sum(
            weight
            for start, end, weight in self.matches(folded)
            if not self.exceptions or self.exceptions.isdisjoint(self.phrases(folded, start, end))
        )
        words = text.count(" ") + text.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / words)


def _phrase_counter(lexicon: Lexicon) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                found = {p for a, b, _ in lexicon.matches(folded) for p in lexicon.phrases(folded, a, b)}
                (toxic if label else clean).update(found)
            terms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, type=pa.string()),
                    pa.array([toxic[t] for t in terms], type=pa.int64()),
                    pa.array([clean[t] for t in terms], type=pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )

    return count


def _featurer(lexicon: Lexicon) -> Callable:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([b[0] for b in both], type=pa.float64()),
                    pa.array([b[1] for b in both], type=pa.float64()),
                ],
                names=["label", "x", "y"],
            )

    return features


class Model:
    """A lexicon with its logistic: bias and the two features' factors."""

    def __init__(self, lexicon: Lexicon, factors: tuple[float, float, float]) -> None:
        self.lexicon, self.factors = lexicon, factors

    def score(self, text: str) -> float:
        x, y = self.lexicon.features(text)
        z = self.factors[0] + self.factors[1] * x + self.factors[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Factors by Newton's method, with a penalty on all but the bias."""
    x = np.c_[np.ones(len(rows)), rows]
    factors, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ factors, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - penalty @ factors
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        factors = factors + step
        if np.abs(step).max() < 1e-8:
            break
    return factors


def _needed(terms: DataFrame) -> DataFrame:
    """Terms (term, weight) without those that a shorter beginning of the same weight or more stands for."""
    plain = F.rtrim(F.col("term"), F.lit("*"))
    beginnings = F.array(*(F.when(F.length(plain) > n, F.concat(F.substring(plain, 1, n), F.lit("*"))) for n in STEMS))
    longer = terms.withColumn("stem", F.explode(F.array_compact(beginnings)))
    stems = terms.select(F.col("term").alias("stem"), F.col("weight").alias("stem_weight"))
    spare = longer.join(stems, "stem").where("stem_weight >= weight").select("term").distinct()
    return terms.join(spare, "term", "left_anti")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts of ``docs`` that ``labels`` marks; null labels and texts teach nothing.

    Labels of ids that ``docs`` lacks teach nothing either and take no place in the sample. Rows that repeat an id or a text
    count once. Empty tables give a model that calls nothing toxic.

    Only ids and labels are ranked; texts are read for the chosen ids alone. The driver gets the lexicon, whose size the
    sample bounds (each term stands in SUPPORT sampled rows or more), and two numbers for each sampled row.
    """
    there = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("there"))
    marks = labels.where(F.col(label_col).isNotNull()).join(there, F.col(id_col) == F.col("there"), "left_semi")
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    marks = marks.select("label", "id", F.xxhash64(F.col("id").cast("string")).alias("hash"))
    chosen = store(least_hashes(marks, "label", SAMPLE).select("id", "label"))
    sample = store(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")  # at most SAMPLE rows of either label
        .where("text IS NOT NULL")
        .dropDuplicates(["text"])
        .withColumn("part", F.pmod(F.xxhash64(F.xxhash64(F.col("id").cast("string"))), F.lit(2)))
        .select("text", "label", "part")
    )
    for_terms, for_score = (sample.where(F.col("part") == k).select("text", "label") for k in (0, 1))
    sizes = {r[0]: r[1] for r in for_terms.groupBy("label").count().collect()}
    schema = "term string, toxic bigint, clean bigint"
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / (sizes.get(1, 0) + 1.0)) - F.log(clean / (sizes.get(0, 0) + 1.0))
    certain = odds - CAUTION * F.sqrt(1 / toxic + 1 / clean)
    terms = _needed(store(
        for_terms.mapInArrow(_count_terms, schema)
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", certain)
        .where((F.col("toxic") >= SUPPORT) & (F.col("weight") >= WEIGHT))
        .select("term", "weight")
    ))
    lexicon = Lexicon({r["term"]: r["weight"] for r in terms.collect()})
    lifted = (
        for_terms.mapInArrow(_phrase_counter(lexicon), schema)
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("clean") >= EXCEPTIONS) & (F.col("toxic") == 0))
        .select("term")
        .collect()
    )
    lexicon = Lexicon(lexicon.weights, {r["term"] for r in lifted})
    rows = for_score.mapInArrow(_featurer(lexicon), "label int, x double, y double").toArrow()
    label = rows["label"].to_numpy()
    if not len(label) or label.min() == label.max():
        return Model(lexicon, (-1.0, 1.0, 1.0))
    share = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean())
    factors = logistic(np.c_[rows["x"].to_numpy(), rows["y"].to_numpy()], label, share)
    return Model(lexicon, tuple(map(float, factors)))


def _scorer(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, type=pa.float64())], names=["id", "score"]
            )

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, score, predicted of every row of ``docs``, without a shuffle.

    ``score`` is near 1 for toxic texts; ``predicted`` is 1 from THRESHOLD on. Null and empty texts get
    the score of a text without any match. Ids pass through, repeated and null ones, too. An empty table gives an empty result; a
    text of any length is read whole. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
        .mapInArrow(_scorer(model), f"id {kind}, score double")
        .select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
