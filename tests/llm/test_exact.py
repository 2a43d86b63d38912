import hashlib
import random

from tagloom.llm import exact
from tests.llm import helpers


def brute(rows):
    groups = {}
    for i, text in rows:
        plain = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(plain, []).append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        plain = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        n, _, keep = min(groups[plain], key=lambda g: (g[0], g[1], g[2] or 0))
        kept = i == keep and len(text or "") == -n
        out.append((i, keep, len(groups[plain]), kept, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_are_those_of_a_dictionary(spark):
    rng = random.Random(4)
    rows = [(i, t if rng.random() < 0.7 else f" {t} " if t else t) for i, t in helpers.corpus(rng)]
    same = "a" * exact.PREFIX  # equal in length and prefix, yet different
    rows += [(1000, same + "b"), (1001, same + "c"), (1002, same + "b "), (1003, f"{same}\tb "), (1004, "x" * 100_000)]
    done = exact.exact_duplicates(helpers.docs(spark, rows))
    assert done.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in done.collect()), key=repr) == brute(rows)


def test_nulls_ties_repeated_rows_and_an_empty_table(spark):
    rows = [(3, "a"), (2, "a"), (2, "a"), (2, "b"), (None, "a "), (None, "c"), (7, None), (6, ""), (5, " ")]
    done = exact.exact_duplicates(helpers.docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in done), key=repr) == brute(rows)
    assert exact.exact_duplicates(helpers.docs(spark, [])).collect() == []
    assert exact.drop_duplicates(helpers.docs(spark, [])).collect() == []


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a"), (2, "a"), (2, "a"), (2, "b"), (None, "a "), (None, "c"), (7, None), (6, ""), (5, " "), (2, "a b")]
    df = helpers.docs(spark, rows)
    done = exact.drop_duplicates(df)
    assert done.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in done.collect()), key=repr)
    assert got == sorted([(None, "a "), (2, "b"), (None, "c"), (5, " "), (2, "a b")], key=repr)
    repeated = exact.drop_duplicates(helpers.docs(spark, [(2, "a"), (2, "a"), (2, "b")])).collect()
    assert sorted((r.doc_id, r.text) for r in repeated) == [(2, "a"), (2, "b")]


def test_no_python_and_no_text_in_an_exchange(spark, tmp_path):
    from tests.helpers import plan

    path = str(tmp_path / "docs")
    helpers.docs(spark, [(i, f"text {i % 7}") for i in range(50)]).write.parquet(path)
    text = plan(exact.drop_duplicates(spark.read.parquet(path)))
    assert "Python" not in text and "Arrow" not in text.replace("ArrowEval", "Arrow")
    assert ") Exchange" not in text  # ids are broadcast, documents stay where they are


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tagloom.llm.exact.WIDE_ROWS", 0)
    monkeypatch.setattr("tagloom.llm.scratch.beside.__defaults__", (0,))
    rows = [(i, f"text {i % 7}") for i in range(50)]
    assert sorted((tuple(r) for r in exact.exact_duplicates(helpers.docs(spark, rows)).collect()), key=repr) == brute(rows)
    assert sorted(r.doc_id for r in exact.drop_duplicates(helpers.docs(spark, rows)).collect()) == list(range(7))


def exchanges(df):
    from tests.helpers import plan

    return [part for part in plan(df).split("\n\n") if ") Exchange" in part.split("\n")[0]]


def test_no_text_in_an_exchange_at_any_size(spark, tmp_path, monkeypatch):
    """Beyond the broadcast a bitmap is tested where the texts lie; only narrow rows are joined."""
    seen = []
    whole = exact.store
    monkeypatch.setattr(exact, "store", lambda rows, *a: seen.append(exchanges(rows)) or whole(rows, *a))
    rng = random.Random(9)
    rows = [(i, t) for i, t in helpers.corpus(rng, 60)] + [(500 + k, f"unlike {k}") for k in range(40)]
    path = str(tmp_path / "docs")
    helpers.docs(spark, rows).write.parquet(path)
    docs = spark.read.parquet(path)
    for words in (exact.WORDS, 1):  # and a bitmap so small that it lets all texts pass
        monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(exact, "WIDE_ROWS", 0)
        monkeypatch.setattr("tagloom.llm.scratch.beside.__defaults__", (0,))
        monkeypatch.setattr(exact, "WORDS", words)
        done = exact.exact_duplicates(docs)
        assert sorted((tuple(r) for r in done.collect()), key=repr) == brute(rows)
        groups = exact.duplicate_groups(docs)
        assert {(r.keep_id, r.group_size) for r in groups.collect()} == {r[1:3] for r in brute(rows) if r[2] > 1}
        seen.append(exchanges(done))
    assert sum(map(len, seen)) > 5
    assert not any("text#" in part or "text," in part.replace("text_sha256", "") for parts in seen for part in parts)


def test_columns_of_any_name_stay(spark):
    rows = [(3, "a"), (2, "a"), (2, "a"), (4, "b")]
    df = helpers.docs(spark, rows).selectExpr("doc_id AS id_", "text AS raw_", "1 AS id", "2 AS raw", "3 AS stays")
    done = exact.drop_duplicates(df, "id_", "raw_")
    assert done.columns == df.columns and sorted(tuple(r)[:2] for r in done.collect()) == [(2, "a"), (4, "b")]
