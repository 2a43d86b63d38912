import random

import numpy as np
import pytest

from tagloom.llm import neardup
from tests.llm import helpers


def found(spark, rows, **columns):
    done = neardup.near_duplicates(helpers.docs(spark, rows), **columns)
    assert done.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return done.collect()


def test_components_are_those_of_all_pairs(spark):
    rows = helpers.corpus(random.Random(5))
    want = helpers.near_components(rows)
    got = found(spark, rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(helpers.shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(rows) - 50  # there is something to link


def test_a_family_in_one_bucket_and_small_blocks(spark, monkeypatch):
    """Members differ from the first, yet are linked with one another; blocks are forced to be many."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng, vocab = random.Random(8), helpers.vocabulary(900)
    rows, base = [], helpers.sentence(rng, 100, vocab).split(" ")
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(100), i % 6):
            w[k] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(60)]  # exact copies
    got = {r.doc_id: r.component_id for r in found(spark, rows)}
    assert got == helpers.near_components(rows)


def test_nulls_repeated_rows_and_an_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (3, None), (3, ""), (4, None)]
    rows += [(5, "x y z"), (6, "p q"), (6, "x y z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found(spark, rows)), key=repr)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    want += [(3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (6, 1, 5, False)]
    assert got == sorted(want, key=repr)
    assert found(spark, []) == []


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, "z " + long), (3, " ".join(f"w{i}" for i in range(150_000)))]
    assert {r.doc_id: r.component_id for r in found(spark, rows)} == {1: 1, 2: 1, 3: 3}


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "q r s"), ("a", "q r s"), ("c", None)], "name string, body string")
    got = neardup.near_duplicates(df, "name", "body").collect()
    assert {r.name: r.component_id for r in got} == {"a": "a", "b": "a", "c": "c"}


def test_values_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = np.concatenate([x[:3000], x[1000:]])  # a half in common
    values = neardup.min_max(sets, np.array([0, 3000]))
    assert (values[0] == values[1]).mean() == pytest.approx(0.5, abs=0.12)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_of_links(spark, shape):
    rng = random.Random(2)
    n = 200
    edges = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(n, i) for i in range(n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(150)],
    }[shape]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {i: root(i) for i in parent if root(i) != i}
    assert {r.id: r.component for r in got} == want


def blocks_of(spark, monkeypatch, labels, block=8):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = spark.createDataFrame([(7, i, label) for i, label in enumerate(labels)], "key bigint, id bigint, label bigint")
    numbered, pairs = neardup._blocks(rows)
    block_of = {r.id: r.block for r in numbered.collect()}
    return block_of, {(r.x, r.y) for r in pairs.collect()}, numbered.join(pairs, ["key", "block"]).count()


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs_of_two_labels_meet_once(spark, monkeypatch, seed):
    rng = random.Random(seed)
    labels = [rng.choice([1, 1, 2, 2, *range(3, 40)]) for _ in range(150)]
    block, pairs, _ = blocks_of(spark, monkeypatch, labels)
    for a, x in enumerate(labels):
        for b in range(a + 1, len(labels)):
            meet = ((block[a], block[b]) in pairs) + (block[a] != block[b] and (block[b], block[a]) in pairs)
            assert meet == 1 if x != labels[b] else meet <= 1


def test_a_family_with_an_outsider_costs_rows_in_proportion(spark, monkeypatch):
    made = []
    for n in (400, 1600):
        block, pairs, rows = blocks_of(spark, monkeypatch, [1] * n + [2])
        made.append(rows)
        assert rows <= 2 * n + 2 and len(pairs) <= n / 8 + 2
    assert made[1] < 4.5 * made[0]


def test_no_bucket_is_sorted_or_numbered(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "key bigint, id bigint, label bigint")
    numbered, pairs = neardup._blocks(rows)
    from tests.helpers import plan

    assert "Window" not in plan(numbered) + plan(pairs)


def test_links_that_no_first_of_a_bucket_shows(spark, monkeypatch):
    """Two linked texts all of whose buckets begin with others that are almost similar enough to both."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, vocab = random.Random(9), helpers.vocabulary(2000)
    base = helpers.sentence(rng, 100, vocab).split(" ")

    def changed(at):
        return " ".join(rng.choice(vocab) if k in at else w for k, w in enumerate(base))

    rows = [(i, changed(set(rng.sample(range(5, 95, 6), 3)))) for i in range(150)]
    rows += [(900, " ".join(base)), (901, changed({20, 60})), (902, changed({2}))]
    want = helpers.near_components(rows)
    assert want[901] == 900 and want[0] == 0  # the many are not linked with them
    stars = []
    whole = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda texts, pairs: stars.append(whole(texts, pairs)) or stars[-1])
    assert {r.doc_id: r.component_id for r in found(spark, rows)} == want
    first, second = ({tuple(sorted(r)) for r in s.collect()} for s in stars)
    assert (900, 901) in second - first


def test_rows_with_null_and_repeated_ids_and_columns_of_any_name(spark):
    vocab = helpers.vocabulary(99)
    rng = random.Random(3)
    text = [helpers.sentence(rng, 40, vocab) for _ in range(3)]
    near = [f"{t} w1" for t in text]
    rows = [(None, text[0]), (None, near[0]), (-5, text[1]), (3, near[1]), (3, text[2]), (7, near[2]), (8, None), (8, None)]
    df = helpers.docs(spark, rows).withColumnsRenamed({"kept": "row_key", "id": "gone", "doc_id": "N"})
    left = neardup.drop_near_duplicates(df, "N")
    assert left.columns == df.columns and {r.row_key for r in left.collect()} == {None} and {r.gone for r in left.collect()} == {"x"}
    got = [(r.N, r.text) for r in left.collect()]
    assert len(got) == 5 and {(-5, text[1]), (3, text[2]), (8, None)} <= set(got)
    assert len({(None, text[0]), (None, near[0])} & set(got)) == 1
    names = helpers.docs(spark, rows).selectExpr("CAST(doc_id AS STRING) AS name", "text")
    assert neardup.drop_near_duplicates(names, "name").count() == 5
    unique = helpers.docs(spark, [(1, text[0]), (2, near[0]), (3, None)])
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(unique).collect()) == [1, 3]
    assert neardup.drop_near_duplicates(df.limit(0), "N").collect() == []
