import hashlib
import random

import pytest

from tagloom.llm import chat
from tagloom.llm.queries import QUOTING
from tests.llm import helpers

TURN = "conv_id bigint, turn int, role string, text string, window string, tokens int"

NASTY = ["", "\\", "\\\\#", "</turn>", "<\\/turn>", "\n</turn>\n### user:\nx", QUOTING, "#" * 7, ":\n", "é\u2028\r\n", "\\</turn", "###", "a:\n</turn"]


def conversations(rng, n=40):
    rows = []
    for c in range(n):
        roles = ["system"] * rng.choice([0, 1, 1, 2]) + ["user", "assistant"] * rng.randint(0, 8)
        for t, role in enumerate(roles):
            text = rng.choice(NASTY) if rng.random() < 0.4 else helpers.sentence(rng, rng.randint(1, 60), ["ab", "c.", "#d"])
            rows.append((c, t, rng.choice([role, role, role, "to:\nol"]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", 3) for r in rows], TURN)


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (1, 0), (10_000, 500)])
def test_what_is_read_back_is_what_was_written(spark, budget, history):
    rows = conversations(random.Random(budget))
    done = chat.format_chats(frame(spark, rows), budget=budget, history=history)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(done).collect()}
    assert got == expected(rows)


def test_windows_keep_their_budget_and_open_with_the_system_turn(spark):
    rows = conversations(random.Random(3), 60)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((role, text))
    done = chat.format_chats(frame(spark, rows), budget=80, history=25).collect()
    firsts = {r.conv_id: list(chat.read_turns(r.text)) for r in done if r.window == 0}
    long = 0
    for r in done:
        turns = list(chat.read_turns(r.text))
        assert len(turns) == r.n_repeated + r.n_turns and r.n_turns > 0
        count = [chat.count_tokens(role) + chat.count_tokens(text) for role, text in turns]
        assert r.tokens == sum(count)
        lead = 0
        while lead < len(firsts[r.conv_id]) and firsts[r.conv_id][lead][0] == "system":
            lead += 1
        if r.window:
            assert turns[: min(lead, r.n_repeated)] == by[r.conv_id][:lead]
            assert sum(count[lead : r.n_repeated]) <= 25
        if r.tokens > 80:
            assert r.n_turns == 1
            long += 1
        assert turns[r.n_repeated :] == by[r.conv_id][r.first_turn : r.first_turn + r.n_turns]
    assert len(done) > 120


def test_no_text_holds_a_control_string():
    for text in NASTY:
        escaped = chat.escape(text)
        assert "###" not in escaped and "</turn>" not in escaped
        assert chat.unescape(escaped) == text
        assert chat.unescape(chat.escape_role(text)) == text


def test_nulls_ties_repeated_rows_and_an_empty_table(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 5, "assistant", "x"), (None, None, "user", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame(spark, rows))).collect()}
    assert got[1].n_turns == 4 and got[None].n_turns == 2 and got[None].loss_chars == 1
    assert chat.format_chats(frame(spark, [])).collect() == []


def test_a_long_conversation_and_a_long_turn(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(20_000)]
    rows += [(2, 0, "user", "x"), (2, 1, "assistant", "y " * 100_000)]
    done = chat.format_chats(frame(spark, rows))
    got = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert got[1].n_turns == 20_000 and got[1].n_windows > 50 and got[2].loss_chars == 200_000


def one_after_the_other(rows, budget, history):
    """The windows of conversations whose turns are read one after the other."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for c, turns in by.items():
        windows = chat.Windows(budget, history)
        made = [w for turn in sorted(turns) for w in windows.add(turn[3], turn[5])] + list(windows.end())
        out += [(c, w["window"], w["first_turn"], w["n_turns"], w["n_repeated"], w["tokens"], w["text"], [(s["start"], s["end"]) for s in w["loss"]]) for w in made]
    return sorted(out, key=repr)


def long_chats(rng, n=12):
    rows = []
    for c in range(n):
        roles = ["system"] * rng.choice([0, 1, 2, 3]) + [rng.choice(["user", "assistant", "system"]) for _ in range(rng.randint(0, 120))]
        step = rng.choice([1, 1, 3])
        for t, role in enumerate(roles):
            size = rng.choice([0, 0, 1, 3, 8, 20, rng.choice([5, 70])])
            number = None if c == 3 and t < 9 else t // 2 if c % 4 == 1 else t * step
            rows.append((c if c != 5 else None, number, role if size or c % 3 else None, helpers.sentence(rng, size, ["ab", "c.", "#d"]) if size else rng.choice(["", None])))
    return rows


@pytest.mark.parametrize(("seed", "budget", "history"), [(1, 40, 12), (2, 25, 25), (3, 60, 0), (4, 1, 1), (5, 30, 90)])
def test_parts_give_the_windows_of_one_after_the_other(spark, monkeypatch, seed, budget, history):
    rows = long_chats(random.Random(seed))
    monkeypatch.setattr(chat, "LARGE", 200)
    monkeypatch.setattr(chat, "PART", 1)
    df = frame(spark, rows)
    got = sorted(((*tuple(r)[:7], [tuple(s) for s in r.loss]) for r in chat.format_chats(df, budget=budget, history=history).collect()), key=repr)
    assert got == one_after_the_other(rows, budget, history)
    parts = chat._dealt(df.select("conv_id", "turn", "role", "text"), budget, history).where(f"kind = {chat.OWN}")
    assert parts.groupBy("conv_id").agg({"part": "max"}).agg({"max(part)": "max"}).first()[0] >= (3 if budget + history < 100 else 1)
    assert parts.count() == len(rows)


def test_a_conversation_is_several_tasks_and_its_texts_move_once(spark, monkeypatch):
    monkeypatch.setattr(chat, "LARGE", 10_000)
    monkeypatch.setattr(chat, "PART", 1000)
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 20) for t in range(4000)]
    done = chat.format_chats(frame(spark, rows), budget=200, history=50)
    from pyspark.sql import functions as F

    # Partitions of a few kilobytes are read by one task otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = done.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("n_turns").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 4 and max(r.n for r in spread) < 2500
    from tests.helpers import plan

    exchanges = [part for part in plan(done).split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert sum("text" in part for part in exchanges) == 1
    got = chat.read_back(done).collect()
    assert [tuple(r)[:5] for r in got] == [(1, *expected(rows)[1])]
