import random
import re

import corpus_pipeline as pipeline
from tagloom.llm import decontaminate
from tests.llm import helpers
from tests.llm.test_decontaminate import ITEM, brute
from tests.llm.test_exact import brute as equal_groups
from tests.llm.test_mixing import brute_targets

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder):
    rng = random.Random(12)
    near = [(i, t) for i, t in helpers.corpus(rng, 60)]
    vocab = helpers.vocabulary(3000)
    items = [(k, helpers.sentence(rng, 20, vocab)) for k in range(5)]
    near += [(500 + k, f"{helpers.sentence(rng, 30, vocab)} {items[k % 5][1]}") for k in range(10)]
    near += [(600, "123 456"), (601, "§§ %%"), (602, None), (603, "")]
    # Words of letters only, in two made-up languages.
    aa = str.maketrans("0123456789wcd", "abcdefghijklm")
    rows = []
    for i, text in near:
        source = rng.choice(["x", "y", None])
        spelt = None if text is None else re.sub(r"(?i)[wcd]\d+", lambda m: m[0].lower().translate(aa), text)
        rows.append((i, spelt if i != 600 else text, "aa", source, 0))
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    items = [(k, re.sub(r"w\d+", lambda m: m[0].translate(aa), t)) for k, t in items]
    spark.createDataFrame(items, ITEM).write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.store(stage(spark, docs, folder))
        kept[name] = [r.asDict() for r in docs.collect()]
        assert docs.columns[: len(columns)] == columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}

    # Documents with letters are all in the one language that there is.
    spoken = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert ids["language_id"] == spoken - {i for i in spoken if texts[i].lower() in ("é é",)} or ids["language_id"] <= spoken
    assert len(ids["language_id"]) > 0.9 * len(spoken)

    before = [(i, texts[i]) for i in sorted(ids["language_id"])]
    assert ids["exact_dedup"] == {r[0] for r in equal_groups(before) if r[3]}

    before = [(i, texts[i]) for i in sorted(ids["exact_dedup"])]
    want = helpers.near_components(before)
    assert ids["near_dedup"] == {i for i in want if want[i] == i}

    before = [(i, texts[i]) for i in sorted(ids["near_dedup"])]
    assert ids["decontamination"] == {i for i, _ in before} - {d for d, _ in brute(before, items)}
    assert len(ids["decontamination"]) < len(before)

    sources = {r[0]: r[3] for r in rows}
    sizes = {}
    for i in ids["decontamination"]:
        sizes[sources[i]] = sizes.get(sources[i], 0) + len(texts[i].split())
    taken = dict.fromkeys(sizes, 0)
    for r in kept["source_mix"]:
        assert 1 <= r["times"] <= 3 and r["doc_id"] in ids["decontamination"]
        taken[r["source"]] += r["times"] * len(r["text"].split())
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 125

    again = pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.times) for r in again.collect()) == sorted((r["doc_id"], r["times"]) for r in kept["source_mix"])


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_benchmark_judge_names_the_stage():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "source_mix"]
    assert decontaminate.TOKENS > decontaminate.COST


def test_rows_with_null_and_shared_ids_are_judged_by_their_own_text(spark, tmp_path):
    rng = random.Random(3)
    letters = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    passage = helpers.sentence(rng, 20, letters)
    text = [helpers.sentence(rng, 40, letters) for _ in range(3)]
    near = [f"{t} {letters[0]}" for t in text]
    spark.createDataFrame([(1, passage)], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        frame = spark.createDataFrame([(*r, "aa", "x", 0) for r in rows], DOCUMENT)
        out = dict(pipeline.STAGES)[stage](spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    known = [(i, helpers.sentence(rng, 40, letters)) for i in range(8)]
    assert left("language_id", [*known, (None, text[0]), (None, "12 34"), (1, "56 78")]) == sorted([*known, (None, text[0])], key=repr)
    rows = [(None, text[0]), (None, near[0]), (-5, text[1]), (3, near[1]), (None, near[1] + " x"), (3, text[2]), (7, near[2]), (8, None)]
    got = left("near_dedup", rows)
    assert len(got) == 4 and {(-5, text[1]), (3, text[2]), (8, None)} <= set(got)
    assert len({(None, text[0]), (None, near[0])} & set(got)) == 1
    rows = [(None, text[0]), (None, f"x {passage}"), (5, passage), (5, text[1]), (6, None)]
    assert left("decontamination", rows) == sorted([(None, text[0]), (5, text[1]), (6, None)], key=repr)


def test_extra_columns_of_any_name_pass_all_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    names = ["row_key", "gone", "of", "target", "below", "place", "whole", "a", "b", "a_", "b_", "id_", "raw_", "stays", "TIMES_"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    for _, stage in pipeline.STAGES:
        columns = docs.columns
        docs = pipeline.store(stage(spark, docs, str(tmp_path)))
        assert docs.columns[: len(columns)] == columns
    left = docs.select(*names).distinct().collect()
    assert [tuple(r) for r in left] == [tuple(range(len(names)))]
