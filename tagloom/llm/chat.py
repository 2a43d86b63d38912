"""Chats as training samples: budgeted windows of whole turns.

Prefix sums of turn tokens choose spans of turns that fit a budget. A conversation that
does not fit into one window goes on in the next, which starts with the
system turns and repeats a limited history. Each assistant text is a target once:
what a window repeats is masked.

A conversation's turns are read one after the other, sorted by Spark, and only the open window
is held. A conversation of more than LARGE bytes is cut into parts that begin with a window, and each part is a task's stream of
its own. Where its windows begin follows from narrow rows (position, tokens), without its texts:

1. Turns are dealt by range and summed within each range; the ranges' sums, a row each, give every turn the sum of
   all tokens before it.
2. These sums deal the turns into chunks, which overlap by a budget and a history. Where a window that begins at a turn ends follows
   from binary searches in the sums of its chunk, so a chunk tells for every turn a window may enter it with
   which turn the first window beyond the chunk begins with, and how many windows lie between.
3. A walk from chunk to chunk, over those few turns, gives each part its first turn, its window's number and its history.

Texts are shuffled once, to the part that they belong to; history and system turns also go to the parts that repeat them.

Template. A turn is ``### <role>:``, a line feed, the text, a line feed, ``</turn>`` and a line
feed. Inside roles and texts every backslash and every ``#`` gets a backslash before it, and
``</turn>`` becomes ``<\\/turn>``; so no text holds a control string, and deleting
the backslash before any character gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.scratch import beside, store

#: Tokens of a window, of the history that it may repeat of those.
BUDGET = 1024
HISTORY = 256
SYSTEM, TARGET = "system", "assistant"
#: Bytes of text from which a conversation is cut into parts, tokens of a part, and most parts of a conversation.
LARGE = 32 << 20
PART, PARTS = 200_000, 1000

_OPEN, _COLON, _CLOSE = "### ", ":\n", "\n</turn>\n"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

WINDOW = (
    "conv_id {kind}, window bigint, first_turn bigint, n_turns bigint, n_repeated bigint, "
    "tokens bigint, text string, loss array<struct<start: bigint, end: bigint>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    """A role ends with the first colon before a line feed, so its own line feeds get a backslash."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def count_tokens(text: str) -> int:
    """Words and single punctuation marks: a stand-in that any other counter can replace."""
    return sum(1 for _ in _TOKEN.finditer(text))


def write_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[dict]]:
    """The text of a window of (role, text, target) and the spans of its targets."""
    parts, spans, at = [], [], 0
    for role, text, target in turns:
        head, body = f"{_OPEN}{escape_role(role)}{_COLON}", escape(text)
        parts += [head, body, _CLOSE]
        at += len(head)
        if target:
            spans.append({"start": at, "end": at + len(body)})
        at += len(body) + len(_CLOSE)
    return "".join(parts), spans


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """role, text of each turn of a window."""
    at = 0
    while at < len(text):
        colon = text.index(_COLON, at)
        close = text.index(_CLOSE, colon + len(_COLON))
        yield unescape(text[at + len(_OPEN) : colon]), unescape(text[colon + len(_COLON) : close])
        at = close + len(_CLOSE)


class Windows:
    """Windows of one conversation, made as its turns come."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: list[tuple[str, str, int]] = []  # leading system turns
        self.open: list[tuple[str, str, int, bool]] = []  # role, text, tokens, repeated
        self.tokens = self.first = self.seen = self.number = 0
        self.leading = True

    def _close(self) -> dict:
        fresh = [t for t in self.open if not t[3]]
        text, loss = write_turns([(r, t, r == TARGET and not old) for r, t, _, old in self.open])
        out = {
            "window": self.number,
            "first_turn": self.first,
            "n_turns": len(fresh),
            "n_repeated": len(self.open) - len(fresh),
            "tokens": self.tokens,
            "text": text,
            "loss": loss,
        }
        self.number += 1
        self.first = self.seen
        return out

    def _reopen(self, coming: int) -> None:
        """Start a window with the system turns and as much history as fits before a turn of ``coming`` tokens."""
        tail, spent = [], 0
        room = min(self.history, self.budget - coming - sum(n for _, _, n in self.system))
        lead = len(self.system)
        # The system turns stand at the front of every window; history is what follows them.
        for role, text, n, _ in reversed(self.open[lead:]):
            if spent + n > room:
                break
            tail.append((role, text, n, True))
            spent += n
        self.open = [(r, t, n, True) for r, t, n in self.system] + tail[::-1]
        self.tokens = spent + sum(n for _, _, n in self.system)

    def add(self, role: str, text: str) -> Iterator[dict]:
        n = count_tokens(text) + count_tokens(role)
        if self.open and any(not t[3] for t in self.open) and self.tokens + n > self.budget:
            yield self._close()
            self._reopen(n)
            self.leading = False
        if self.leading and role == SYSTEM and len(self.system) == len(self.open):
            self.system.append((role, text, n))
        else:
            self.leading = False
        self.open.append((role, text, n, False))
        self.tokens += n
        self.seen += 1

    def resume(self, system: list[tuple[str, str]], history: list[tuple[str, str]], number: int, first: int) -> None:
        """Go on where window ``number`` begins with turn ``first``, after these system turns and this history."""
        counted = [(r, t, count_tokens(t) + count_tokens(r)) for r, t in (*system, *history)]
        self.system = counted[: len(system)]
        self.open = [(*turn, True) for turn in counted]
        self.tokens = sum(n for _, _, n in counted)
        self.number, self.first, self.seen, self.leading = number, first, first, False

    def end(self) -> Iterator[dict]:
        if any(not t[3] for t in self.open):
            yield self._close()


#: What becomes of a row in a part: system turns and history come before its own turns.
LED, REPEATED, OWN = 0, 1, 2


def _former(budget: int, history: int):
    """Windows of rows conv_id, part, kind, role, text, begin, sorted; ``begin`` tells how a part goes on."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, conv, windows, schema = None, None, None, None
        before: dict[int, list] = {LED: [], REPEATED: []}

        def told(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, **r} for r in rows], schema=schema)

        for batch in batches:
            schema = schema or pa.schema(
                [
                    ("conv_id", batch.schema.field(0).type),
                    *((n, pa.int64()) for n in ("window", "first_turn", "n_turns", "n_repeated", "tokens")),
                    ("text", pa.string()),
                    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]
            )
            for key, part, kind, role, text, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, part):
                    if windows and (rows := list(windows.end())):
                        yield told(rows)
                    at, conv, windows = (key, part), key, None
                    before = {LED: [], REPEATED: []}
                if kind != OWN:
                    before[kind].append((role or "", text or ""))
                    continue
                if windows is None:
                    windows = Windows(budget, history)
                    if begin is not None:
                        # Turns that share a number with these come along; the order tells which are meant.
                        repeated = before[REPEATED][len(before[REPEATED]) - begin["n_history"] :]
                        windows.resume(before[LED][: begin["n_system"]], repeated, begin["window"], begin["first"])
                if rows := list(windows.add(role or "", text or "")):
                    yield told(rows)
        if windows and (rows := list(windows.end())):
            yield told(rows)

    return form


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv_id, turn, role, tie, text with the tokens of role and text instead of the text."""
    for batch in batches:
        n = [count_tokens(t or "") + count_tokens(r or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, type=pa.int64())], names=["conv_id", "turn", "role", "tie", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn, system, n, range, k, p of sorted rows: within a range and conversation, place and tokens before."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    conv, k, p = object(), 0, 0
    for batch in batches:
        places, sums = [], []
        for key, n in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if key != conv:
                conv, k, p = key, 0, 0
            places.append(k)
            sums.append(p)
            k, p = k + 1, p + n
        system = pa.array([r == SYSTEM for r in batch.column(2).to_pylist()], type=pa.bool_())
        columns = [batch.column(0), batch.column(1), system, batch.column(4), pa.array([number] * batch.num_rows, type=pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(places, type=pa.int64()), pa.array(sums, type=pa.int64())],
            names=["conv_id", "turn", "system", "n", "range", "k", "p"],
        )


def window_ends(p: np.ndarray, n: np.ndarray, lead: int, system: int, opening: bool, budget: int, history: int) -> tuple[np.ndarray, np.ndarray]:
    """For each turn the first one after a window that begins with it, and the first one of that window's history.

    ``p`` are the tokens before each turn and ``n`` its own; ``lead`` turns in front are system turns of
    ``system`` tokens. If ``opening``, the first turn is the conversation's.
    """
    here = np.arange(len(p))
    room = np.minimum(history, budget - n - system)
    since = np.where(room < 0, here, np.minimum(here, np.searchsorted(p, p - room, side="left")))
    since = np.minimum(here, np.maximum(since, lead))
    held = system + p - p[since]
    if opening:
        since[0], held[0] = 0, 0
    ends = np.searchsorted(p + n, p + budget - held, side="right")
    return np.maximum(ends, here + 1), since


def _exits(budget: int, history: int):
    """For each turn that a window may enter a chunk with: the first window beyond the chunk, and how many lie between."""

    def find(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("at")
        first = {c: group[c][0].as_py() for c in ("chunk", "size", "lead", "tokens")}
        at, p, n = (group[c].to_numpy() for c in ("at", "p", "n"))
        turn = group["turn"].to_pylist()
        chunk, size = first["chunk"], first["size"]
        own = np.flatnonzero(p // size == chunk)
        out = group.slice(0, 0).select(["conv_id"])
        names = ["chunk", "at", "exit", "exit_chunk", "windows", "turn", "tied", "n_history", "since"]
        rows: list[tuple] = []
        if len(own):
            lead = min(max(0, first["lead"] - int(at[0])), len(p))
            ends, since = window_ends(p, n, lead, first["tokens"], at[0] == 0, budget, history)
            last = int(own[-1])
            exits, count = ends.copy(), np.ones(len(p), dtype=np.int64)
            for f in range(last, int(own[0]) - 1, -1):
                if ends[f] <= last:
                    exits[f], count[f] = exits[ends[f]], count[ends[f]] + 1
            for f in own[(p[own] - chunk * size <= budget) | (own == own[0])]:
                e = int(exits[f])
                beyond = int(p[e - 1] + n[e - 1]) // size
                rows.append(
                    (chunk, int(at[f]), int(at[0]) + e, beyond if beyond != chunk else -1, int(count[f]), turn[f],
                     bool(f) and turn[f - 1] == turn[f], int(f - since[f]), turn[since[f]] if since[f] < f else None)
                )
        out = group.slice(0, 1).select(["conv_id"]).take(pa.array([0] * len(rows), type=pa.int64()))
        kind = group.schema.field("turn").type
        types = [pa.int64()] * 5 + [kind, pa.bool_(), pa.int64(), kind]
        for k, (name, t) in enumerate(zip(names, types, strict=True)):
            out = out.append_column(name, pa.array([r[k] for r in rows], type=t))
        return out

    return find


def _walked(group: pa.Table) -> pa.Table:
    """The windows that a conversation's parts begin with, from chunk to chunk."""
    group = group.combine_chunks()
    place = {key: k for k, key in enumerate(zip(group["chunk"].to_pylist(), group["at"].to_pylist(), strict=True))}
    exits, beyond, counts, tied, turn = (group[c].to_pylist() for c in ("exit", "exit_chunk", "windows", "tied", "turn"))
    taken, numbers, window = [], [], 0
    k = place[0, 0]
    while k is not None:
        if window and not tied[k] and turn[k] is not None:  # a part cannot begin among turns of one number
            taken.append(k)
            numbers.append(window)
        window += counts[k]
        k = place.get((beyond[k], exits[k]))
    out = group.select(["conv_id", "turn", "since", "n_history"]).take(pa.array(taken, type=pa.int64()))
    first = pa.array([group["at"][k].as_py() for k in taken], type=pa.int64())
    return out.append_column("window", pa.array(numbers, type=pa.int64())).append_column("first", first)


def cuts(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, cuts, n_system, last_system of the conversations of ``turns`` (conv_id, turn, role, text) that have several parts.

    ``cuts`` is an array of (turn, since, n_history, window, first), by turn: the part's first turn, the first number of its
    history, how many turns that is, and its first window's and turn's place in the conversation.
    """
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    repeated = store(turns.groupBy("conv_id", "turn").count().where("count > 1").selectExpr("conv_id AS c_", "turn AS t_"))
    same = F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("turn").eqNullSafe(F.col("t_")) & F.col("is_")
    # Texts only come along where they decide the order of turns of one number.
    tied = turns.join(beside(repeated.withColumn("is_", F.lit(True))), same, "left")
    rows = tied.select("conv_id", "turn", "role", F.when(F.col("is_"), F.col("text")).alias("tie"), "text")
    counted = rows.mapInArrow(_counted, f"conv_id {conv}, turn {turn}, role string, tie string, n bigint")
    ranged = store(
        counted.repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn", "role", "tie")
        .mapInArrow(_summed, f"conv_id {conv}, turn {turn}, system boolean, n bigint, range int, k bigint, p bigint")
    )
    ranges = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(
        ranges.select(
            F.col("conv_id").alias("c_"),
            F.col("range").alias("r_"),
            *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("turns", "tokens")),
        )
    )
    here = F.col("conv_id").eqNullSafe(F.col("c_"))
    placed = store(
        ranged.join(beside(offsets), here & (F.col("range") == F.col("r_"))).selectExpr(
            "conv_id", "turn", "system", "n", "k + turns_before AS at", "p + tokens_before AS p"
        )
    )
    whole = placed.groupBy("conv_id").agg(
        F.sum("n").alias("all"), F.coalesce(F.min(F.when(~F.col("system"), F.col("at"))), F.count("*")).alias("other")
    )
    whole = store(whole.selectExpr("conv_id AS c_", "all", "other"))
    leads = placed.join(beside(whole), here).where(f"system AND at < other AND (at = 0 OR p + n <= {budget})")
    leads = leads.groupBy("c_").agg(F.count("*").alias("lead"), F.sum("n").alias("tokens"), F.max("turn").alias("last_system"))
    least = max(PART, 4 * (budget + history))
    facts = store(
        whole.join(leads.withColumnRenamed("c_", "l_"), F.col("c_").eqNullSafe(F.col("l_")), "left").selectExpr(
            "c_", f"greatest({least}L, CAST(ceil(all / {PARTS}) AS BIGINT)) AS size",
            "coalesce(lead, 0L) AS lead", "coalesce(tokens, 0L) AS tokens", "last_system",
        )
    )
    chunks = f"""array_distinct(filter(array(
        p DIV size, IF(p % size <= {budget}, p DIV size - 1, NULL), IF(size - p % size <= {history}, p DIV size + 1, NULL), (p + n) DIV size
    ), c -> c >= 0))"""
    dealt = placed.join(beside(facts), here).withColumn("chunk", F.explode(F.expr(chunks)))
    exits = dealt.select("conv_id", "chunk", "size", "lead", "tokens", "at", "p", "n", "turn").groupBy("conv_id", "chunk").applyInArrow(
        _exits(budget, history),
        f"conv_id {conv}, chunk bigint, at bigint, exit bigint, exit_chunk bigint, windows bigint, turn {turn}, "
        f"tied boolean, n_history bigint, since {turn}",
    )
    found = exits.groupBy("conv_id").applyInArrow(
        _walked, f"conv_id {conv}, turn {turn}, since {turn}, n_history bigint, window bigint, first bigint"
    )
    cut = F.struct("turn", "since", "n_history", "window", "first")
    gathered = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))  # PARTS of them at most
    return store(
        gathered.join(facts, here).select("conv_id", "cuts", F.col("lead").alias("n_system"), "last_system")
    )


def _dealt(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, part, kind, role, text, turn, begin: every turn in its part, and in those that repeat it."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0))
    large = store(turns.groupBy("conv_id").agg(F.sum(bytes_.cast("bigint")).alias("size")).where(F.col("size") > LARGE).selectExpr("conv_id AS c_", "true AS is_"))
    none = F.lit(None).cast("struct<n_system:bigint,n_history:bigint,window:bigint,first:bigint>")
    if large.isEmpty():
        return turns.select("conv_id", F.lit(0).alias("part"), F.lit(OWN).alias("kind"), "role", "text", "turn", none.alias("begin"))
    some = turns.join(beside(large), F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("is_"), "left_semi")
    parts = cuts(some, budget, history).withColumnRenamed("conv_id", "c_")
    own = "size(filter(cuts, c -> turn IS NOT NULL AND c.turn <= turn))"
    history_of = """transform(
        filter(transform(cuts, (c, k) -> struct(k + 1 AS part, c.turn AS turn, c.since AS since, c.n_history AS n)), c -> c.n > 0
            AND (turn IS NULL OR turn < c.turn) AND (c.since IS NULL OR (turn IS NOT NULL AND c.since <= turn))),
        c -> struct(c.part AS part, {} AS kind))""".format(REPEATED)
    leads = f"""IF(n_system > 0 AND size(cuts) > 0 AND (turn IS NULL OR turn <= last_system),
        transform(sequence(1, size(cuts)), k -> struct(k AS part, {LED} AS kind)), array())"""
    places = f"concat(array(struct({own} AS part, {OWN} AS kind)), {history_of}, {leads})"
    placed = turns.join(beside(parts), F.col("conv_id").eqNullSafe(F.col("c_")), "left").withColumn(
        "place", F.explode(F.expr(f"IF(cuts IS NULL, array(struct(0 AS part, {OWN} AS kind)), {places})"))
    )
    begin = """IF(place.part = 0, NULL, struct(n_system, cuts[place.part - 1].n_history AS n_history,
        cuts[place.part - 1].window AS window, cuts[place.part - 1].first AS first))"""
    return placed.select("conv_id", "place.part", "place.kind", "role", "text", "turn", F.expr(begin).alias("begin"))


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """conv_id, window, first_turn, n_turns, n_repeated, tokens, text, loss: a row for each window.

    ``n_turns`` counts the turns that are new in the window, ``n_repeated`` those before them, which
    are masked. ``loss`` lists the code point spans of the window's targets. The system turns that
    open a conversation's first window open all of its windows. A turn that is longer than
    the budget is not cut: it gets a window of its own beside the system turns, above the budget.

    Null texts and roles are empty. Rows with a null id are one conversation. Turns that share a
    number are ordered by role, then text; repeated rows stay. An empty table gives no window.
    Other columns are not read. Rows come out ordered by conversation and window within a partition.

    A conversation of any size is spread over tasks (see the module); only turns that share one number, or have none, stay in one
    part.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    sorted_ = (
        _dealt(rows, budget, history)
        .repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "kind", "turn", "role", "text")
        .select("conv_id", "part", "kind", "role", "text", "begin")
    )
    return sorted_.mapInArrow(_former(budget, history), WINDOW.format(kind=kind))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None
    schema = None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [
                {
                    "conv_id": state["conv"],
                    "n_turns": state["turns"],
                    "turns_sha256": state["all"].hexdigest(),
                    "loss_chars": state["chars"],
                    "loss_sha256": state["loss"].hexdigest(),
                    "formatted_chars": state["formatted"],
                    "n_windows": state["windows"],
                }
            ],
            schema=schema,
        )

    for batch in batches:
        schema = schema or pa.schema(
            [
                ("conv_id", batch.schema.field(0).type),
                ("n_turns", pa.int64()),
                ("turns_sha256", pa.string()),
                ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()),
                ("formatted_chars", pa.int64()),
                ("n_windows", pa.int64()),
            ]
        )
        for row in batch.select(["conv_id", "n_repeated", "text", "loss"]).to_pylist():
            if state is None or row["conv_id"] != state["conv"]:
                if state:
                    yield told()
                state = {"conv": row["conv_id"], "turns": 0, "chars": 0, "formatted": 0, "windows": 0}
                state |= {"all": hashlib.sha256(), "loss": hashlib.sha256()}
            for k, (role, text) in enumerate(read_turns(row["text"])):
                if k >= row["n_repeated"]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(row["text"][span["start"] : span["end"]])
                state["chars"] += len(text)
                state["loss"].update(text.encode())
            state["formatted"] += len(row["text"])
            state["windows"] += 1
    if state:
        yield told()


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Each conversation as it stands in its windows: turns that a window repeats are passed over,
    texts are unescaped, and what lies under the loss mask is hashed in order. ``windows`` may be
    stored and read again: they are sorted here.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    return (
        windows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
        .mapInArrow(
            _read_back,
            f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
            "loss_sha256 string, formatted_chars bigint, n_windows bigint",
        )
    )
