import os
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import language
from tagloom.llm.queries import QUERIES
from tests.llm import helpers

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def two_languages(rng, n):
    parts = {"aa": ["ta", "ki", "mo", "nu"], "bb": ["ße", "lü", "grö", "sch"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 40)))
        rows.append((i, text.upper() if i % 5 == 0 else text, lang))
    return rows


def test_languages_are_told_apart(spark):
    rows = two_languages(random.Random(1), 300)
    filters = language.fit(helpers.docs(spark, rows[:200]), "doc_id", "text", "lang")
    assert filters.languages == ["aa", "bb"]
    got = {r.doc_id: r for r in language.identify(helpers.docs(spark, rows), filters).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(0.5 < r.score <= 1 for r in got.values())


def test_a_look_up_gives_all_languages_of_an_ngram():
    members = {f"l{k:02d}": np.arange(1000 * k, 1000 * k + 1500, dtype=np.int64) + 7 for k in range(70)}
    filters = language.Filters(sorted(members), members)  # more languages than a word has bits
    for k in (0, 1, 63, 64, 69):
        at = filters._at((members[f"l{k:02d}"]).astype(np.uint32))
        bit = filters._has((filters.slots[at[0]] & filters.slots[at[1]])[:, k // 64], k)
        assert bit.all()  # no false negative
    strange = np.arange(10**6, 10**6 + 20000, dtype=np.uint32)
    at = filters._at(strange)
    hit = filters._has((filters.slots[at[0]] & filters.slots[at[1]])[:, 0], 3).mean()
    assert hit == pytest.approx(filters.false[3], abs=0.003)


def test_ngrams_do_not_run_into_the_next_text():
    texts = ["abcd", "", "x1y", "ÄÖ"]
    (_, _, data, offsets), = language._texts(pa.array(texts, type=pa.string()))
    own = language.grams(data)
    ok = (own != 0) & language._within(offsets, len(own))
    got = [sorted(x.to_bytes(4, "little") for x in map(int, own[a:b][ok[a:b]])) for a, b in zip(offsets[:-1], np.minimum(offsets[1:], len(own)), strict=True)]
    assert got[0] == [b" abc", b"abcd", b"bcd "]
    assert got[1] == [] and got[2] == [b" x y", b"x y "]
    assert got[3] == sorted([" ä".encode() + "ö".encode()[:1], "äö".encode(), "ä".encode()[1:] + "ö ".encode()])


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 3!", "bb"), (None, "taki", None), (None, "taki", None), (4, "taki", None)]
    train = helpers.docs(spark, two_languages(random.Random(2), 100))
    filters = language.fit(train, "doc_id", "text", "lang")
    got = language.identify(helpers.docs(spark, rows), filters).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=repr) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (None, "aa"), (4, "aa")], key=repr
    )
    assert [r.score for r in got if r.lang_pred == "und"] == [0.0] * 3
    nothing = language.fit(helpers.docs(spark, []), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(helpers.docs(spark, rows), nothing).collect()} == {"und"}
    assert language.identify(helpers.docs(spark, []), filters).collect() == []


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables")
def test_held_out_documents(spark):
    got = QUERIES["op3_language_id"](spark, str(FOLDER))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def plain_grams(text):
    """The n-grams of a text, one after the other: four bytes, not both of the first two blanks."""
    data = bytearray(f" {text.lower()} ".encode())
    for k, b in enumerate(data):
        if b < 128 and not chr(b).isalpha():
            data[k] = 32
    out = [bytes(data[k : k + 4]) for k in range(len(data) - 3)]
    return [g for g in out if g[:2] != b"  "]


def plain_slots(gram):
    """Where the filter looks an n-gram up, with whole numbers of any size."""
    m = (1 << 64) - 1
    x = int.from_bytes(gram, "little") * 0x9E3779B97F4A7C15 & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    x ^= x >> 31
    return x >> 46, x >> 28 & (1 << 18) - 1


def test_shares_and_decisions_are_those_of_plain_sets(spark):
    rng = random.Random(6)
    parts = {"aa": ["ta", "ki", "mo", "nu"], "bb": ["ße", "lü", "ta", "mo"], "cc": ["ki", "ße", "sch", "nu"]}

    def text(lang):
        words = ["".join(rng.choices(parts[lang] if rng.random() < 0.8 else parts["aa"], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 25))]
        return rng.choice([" ", ", ", "  7 "]).join(words)

    train = [(i, text(lang), lang) for i in range(150) for lang in [rng.choice(sorted(parts))]]
    filters = language.fit(helpers.docs(spark, train), "doc_id", "text", "lang")

    rows = {lang: [set(plain_grams(t)) for _, t, x in train if x == lang] for lang in parts}
    rate = {}
    for lang, sets in rows.items():
        for g in set().union(*sets):
            n = sum(g in s for s in sets)
            if n > 1 and n / len(sets) >= 0.02:
                rate[g, lang] = n / len(sets)
    top = {}
    for (g, _), r in rate.items():
        top[g] = max(r, top.get(g, 0))
    members = {lang: {g for (g, x), r in rate.items() if x == lang and r >= 0.5 * top[g]} for lang in sorted(parts)}
    slots = {lang: {at for g in own for at in plain_slots(g)} for lang, own in members.items()}
    assert all(len(own) > 20 for own in members.values())
    false = {lang: (len(s) / (1 << 18)) ** 2 for lang, s in slots.items()}

    texts = [(1000 + i, text(rng.choice(sorted(parts)))) for i in range(200)] + [(1, "xyzq"), (2, "9"), (3, "ta"), (4, "Ta Ki")]
    got = {r.doc_id: r for r in language.identify(helpers.docs(spark, texts), filters).collect()}
    for i, t in texts:
        own = plain_grams(t)
        shares = {}
        for lang in sorted(parts):
            found = sum(all(at in slots[lang] for at in plain_slots(g)) for g in own) / max(1, len(own))
            shares[lang] = max(0.0, (found - false[lang]) / (1 - false[lang]))
        best = max(sorted(parts), key=lambda x: shares[x])
        letters = any(c.isalpha() for c in t)
        assert got[i].lang_pred == (best if letters else "und")
        assert got[i].coverage == pytest.approx(shares[best] if letters else 0.0)
        assert got[i].score == pytest.approx(shares[best] / sum(shares.values()) if letters and shares[best] else 0.0)
    assert len({r.lang_pred for r in got.values()}) == 4


def test_known_rows_keep_their_columns_and_order_of_ids(spark):
    filters = language.fit(helpers.docs(spark, two_languages(random.Random(2), 100)), "doc_id", "text", "lang")
    rows = [(None, "taki mo"), (1, "taki mo nu"), (1, "12"), (2, None), (3, "qqqq xxxx"), (4, "grö schlü " * 30_000)]
    df = helpers.docs(spark, rows)
    left = language.known(df, filters, 0.15)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([rows[0], rows[1], rows[5]], key=repr)
    assert language.known(df.limit(0), filters, 0.15).collect() == []
    assert language.known(df.withColumnRenamed("text", "stays"), filters, 0.15, "stays").count() == 3
