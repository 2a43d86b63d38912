import os
import random
from pathlib import Path

import pytest

from tagloom.llm import toxicity
from tagloom.llm.queries import QUERIES
from tests.llm import helpers

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("You 1D10T", "you idiot"),
        ("m0r0n, $tupid l053r!", "moron, stupid loser!"),
        ("іdіоt ｌｏｓｅｒ lo​ser", "idiot loser loser"),
        ("in 2001 24be64439e 4785380592391139", "in 2001 24be64439e 4785380592391139"),
        ("stup!d clown!! moron$$$", "stupid clown!! moron$$$"),
        ("Été à l'école, größe", "été à l'école, größe"),
        ("", ""),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def brute_matches(weights, text):
    """Every word with the largest weight of the terms that fit it, one by one."""
    out = []
    for m in toxicity._WORD.finditer(text):
        fits = [
            w for t, w in weights.items()
            if m[0] == t or (t.endswith("*") and m[0].startswith(t[:-1]))
        ]
        if fits:
            out.append((m.start(), m.end(), max(fits)))
    return out


def test_matches_are_those_of_every_term():
    rng = random.Random(3)
    parts = ["ab", "abc", "ca", "bca", "é", "x"]
    for _ in range(300):
        terms = {"".join(rng.choices(parts, k=rng.randint(1, 3))) + rng.choice(["", "", "*"]): rng.uniform(0.1, 9) for _ in range(8)}
        lexicon = toxicity.Lexicon(terms)
        text = "".join(rng.choices([*parts, " ", ", ", "-", "7"], k=40))
        assert list(lexicon.matches(text)) == brute_matches(terms, text)


def test_exceptions_lift_a_match():
    lexicon = toxicity.Lexicon({"trash": 5.0}, {"trash can"})
    assert lexicon.features("the trash can") == (0.0, 0.0)
    assert lexicon.features("the trash man, trash can")[0] > 0


def collection(rng, n):
    vocab, bad = helpers.vocabulary(300), ["fooble", "quaxor", "zindle"]
    vocab = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in vocab]
    docs, labels = [], []
    for i in range(n):
        w = helpers.sentence(rng, rng.randint(5, 80), vocab).split(" ")
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_a_model_tells_what_it_was_not_shown(spark):
    docs, labels = collection(random.Random(5), 900)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(helpers.docs(spark, docs), marks.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(helpers.docs(spark, docs), model).collect()}
    held = [(i, y) for i, _, y in labels if i % 3 == 1]
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    hidden = [(1, "Some words and a F00BLE, qu4x0r"), (2, "some words and nothing")]
    bad, good = (r.predicted for r in toxicity.score(helpers.docs(spark, hidden), model).orderBy("doc_id").collect())
    assert (bad, good) == (1, 0)


def test_odd_rows_and_empty_tables(spark):
    docs, labels = collection(random.Random(6), 60)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    frame = helpers.docs(spark, [*docs, (None, "x"), (61, None), (61, None), (62, ""), (63, "w " * 60_000)])
    model = toxicity.fit(frame, marks)
    got = toxicity.score(frame, model).collect()
    assert len(got) == 65 and len({r.score for r in got if r.doc_id in (61, 62)}) == 1
    nothing = toxicity.fit(helpers.docs(spark, []), marks)
    assert all(r.predicted == 0 for r in toxicity.score(frame, nothing).collect())
    assert toxicity.score(helpers.docs(spark, []), model).collect() == []


@pytest.mark.skipif(not FOLDER.with_name("sf0.01").is_dir(), reason="no tables")
def test_held_out_documents(spark):
    folder = FOLDER.with_name("sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op5_toxicity"](spark, str(folder)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_exceptions_of_any_length_lift_a_match():
    for n in (3, 30, 45, 4000):
        lexicon = toxicity.Lexicon({"trash": 5.0}, {f"{'q' * n} trash", f"trash {'q' * n}"})
        assert lexicon.features(f"x {'q' * n} trash") == (0.0, 0.0)
        assert lexicon.features(f"trash {'q' * n} x") == (0.0, 0.0)
        assert lexicon.features(f"{'q' * (n + 1)} trash")[0] > 0


def test_the_word_before_is_that_of_an_expression():
    import re

    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices("ab é1²_ \t\n-", k=rng.randint(0, 9))) + "z"
        m = re.search(r"([^\W\d_]+)[ \t]+\Z", text[:-1])
        assert toxicity.word_before(text, len(text) - 1) == (m[1] if m else "")


def test_terms_that_a_beginning_stands_for_decide_nothing(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("ab", k=rng.randint(3, 9))) for _ in range(150)]
    terms = {}
    for w in words:
        terms[w] = round(rng.uniform(1, 3), 1)
        for n in toxicity.STEMS:
            if len(w) > n:
                terms[w[:n] + "*"] = round(rng.uniform(1, 3), 1)
    kept = {r.term: r.weight for r in toxicity._needed(spark.createDataFrame(list(terms.items()), "term string, weight double")).collect()}
    assert len(kept) < 0.9 * len(terms) and kept.items() <= terms.items()
    whole, pruned = toxicity.Lexicon(terms), toxicity.Lexicon(kept)
    for _ in range(300):
        text = " ".join(rng.choices(words, k=5)) + "".join(rng.choices("ab ", k=30))
        assert list(whole.matches(text)) == list(pruned.matches(text))


def test_a_fit_is_that_of_counting(spark):
    """Terms, exceptions and factors as plain counting gives them; labels of unknown ids take no place."""
    import math
    from collections import Counter

    import numpy as np

    rng = random.Random(8)
    docs, labels = collection(rng, 500)
    docs = [(i, t.replace("fooble", "fooble badge") if k % 9 == 0 else t) for k, (i, t) in enumerate(docs)]
    docs += [(1000 + k, f"the quaxor lamp {k} stands here") for k in range(12)]
    labels += [(1000 + k, 1, 0) for k in range(12)] + [(5000 + k, 1, k % 2) for k in range(900)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(helpers.docs(spark, docs), marks)

    part = {r.id: r.p for r in spark.range(1100).selectExpr("id", "pmod(xxhash64(xxhash64(CAST(id AS STRING))), 2) AS p").collect()}
    toxic = {i: y for i, _, y in labels}
    texts = {i: toxicity.fold(t) for i, t in docs}
    halves = [[i for i in texts if part[i] == k] for k in (0, 1)]
    counts = {0: Counter(), 1: Counter()}
    for i in halves[0]:
        counts[toxic[i]].update(toxicity._candidates(texts[i]))
    sizes = Counter(toxic[i] for i in halves[0])
    weights = {}
    for term in counts[1]:
        t, c = counts[1][term] + 0.5, counts[0][term] + 0.5
        w = math.log(t / (sizes[1] + 1)) - math.log(c / (sizes[0] + 1)) - toxicity.CAUTION * math.sqrt(1 / t + 1 / c)
        if counts[1][term] >= toxicity.SUPPORT and w >= toxicity.WEIGHT:
            weights[term] = w
    assert model.lexicon.weights.items() <= {t: pytest.approx(w) for t, w in weights.items()}.items() or all(
        model.lexicon.weights[t] == pytest.approx(weights[t]) for t in model.lexicon.weights
    )
    for term in weights.keys() - model.lexicon.weights.keys():
        assert any(term[:n] + "*" in weights and weights[term[:n] + "*"] >= weights[term] - 1e-9 for n in toxicity.STEMS)
    phrases = {0: Counter(), 1: Counter()}
    for i in halves[0]:
        words = texts[i].split()
        hits = [k for k, w in enumerate(words) if brute_matches(weights, w)]
        phrases[toxic[i]].update({f"{words[a]} {words[a + 1]}" for k in hits for a in (k - 1, k) if 0 <= a < len(words) - 1 and words[a].isalpha() and words[a + 1].isalpha()})
    assert model.lexicon.exceptions == {p for p, n in phrases[0].items() if n >= toxicity.EXCEPTIONS and not phrases[1][p]}
    rows = np.array([model.lexicon.features(dict(docs)[i]) for i in halves[1]])
    y = np.array([toxic[i] for i in halves[1]])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    x = np.c_[np.ones(len(rows)), rows]
    p = 1 / (1 + np.exp(-x @ np.array(model.factors)))
    slope = x.T @ (weight * (y - p)) - np.array([1e-3, 1, 1]) * model.factors  # none at the best factors
    assert np.abs(slope).max() < 1e-5
    got = {r.doc_id: r.score for r in toxicity.score(helpers.docs(spark, docs), model).collect()}
    for i, t in docs:
        words = t.count(" ") + t.count("\n") + 1
        total = sum(w for a, b, w in brute_matches(weights, texts[i]) if model.lexicon.exceptions.isdisjoint(model.lexicon.phrases(texts[i], a, b)))
        z = model.factors[0] + model.factors[1] * math.log1p(total) + model.factors[2] * math.log1p(100 * total / words)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
