"""Chat formatting: the cheapest repair of a conversation's roles, and the repaired conversation as text.

A legal conversation is an optional system message, then user and assistant in turn, from user to assistant. Dynamic
programming over that automaton chooses for each message whether it stays, is merged into the message before it, gets
another role, or is preceded by an empty message. A run of messages acts on the automaton as a matrix of least costs, so
very long conversations are cut into parts that are solved apart and joined.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, small_batches

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 2, 3, 5
NEVER = 1 << 40


def _between() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """The empty messages that make `to` legal after `at`; None where one message can't do it."""
    out = {}
    for at in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            ways = [()] if to in LEGAL[at] else [(x,) for x in LEGAL[at] if to in LEGAL[x]]
            out[at, to] = ways[0] if ways else None
    return out


BETWEEN = _between()
#: What is missing at the end.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _moves() -> dict[int, list[list[tuple[int, bool]]]]:
    """For each role of a message (0: unknown or null): cost and whether it merges, from state to state."""
    out = {}
    for role in range(4):
        table = [[(NEVER, False)] * 4 for _ in range(4)]
        for at in range(4):
            for to in (SYSTEM, USER, ASSISTANT):
                relabel = RELABEL if to != role else 0
                if BETWEEN[at, to] is not None:
                    table[at][to] = (relabel + INSERT * len(BETWEEN[at, to]), False)
                if at == to and relabel + MERGE < table[at][to][0]:
                    table[at][to] = (relabel + MERGE, True)
        out[role] = table
    return out


MOVES = _moves()


def role_of(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def costs(roles: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Least cost of each end state from an entry state, and the state before each, message by message."""
    now, back = [0 if s == entry else NEVER for s in range(4)], []
    for role in roles:
        table = MOVES[role]
        best = [min(range(4), key=lambda at, to=to: now[at] + table[at][to][0]) for to in range(4)]
        now = [min(NEVER, now[at] + table[at][to][0]) for to, at in enumerate(best)]
        back.append(best)
    return now, back


def states(roles: list[int], entry: int, final: int) -> list[int]:
    """The states after each message of a cheapest repair that leads from entry to final."""
    _, back = costs(roles, entry)
    out = [final]
    for best in reversed(back[1:]):
        out.append(best[out[-1]])
    return out[::-1] if roles else []


def final_state(now: list[int]) -> int:
    return min(range(4), key=lambda s: now[s] + INSERT * len(CLOSING[s]))


def escaped(text: str) -> str:
    """A text in which no mark begins: every `<|`, and what is already written so, gets a backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(roles: list[int], texts: list[str | None], entry: int, final: int, last: bool) -> tuple[str, int, int, int, int, int]:
    """Text of a part, its messages, cost, and numbers of merges, relabels and insertions. Parts, one after the other, are
    the whole: a message is closed when the next one begins, or at the end of the last part. Marks within a text are escaped, so
    no text can open or close a message."""
    out, at, n, cost, merged, relabelled, inserted = [], entry, 0, 0, 0, 0, 0

    def message(role: int, text: str) -> None:
        nonlocal n, at
        out.append(("<|end|>\n" if at != START else "") + f"<|{ROLES[role - 1]}|>\n{text}")
        n, at = n + 1, role

    for role, text, to in zip(roles, texts, states(roles, entry, final)):
        price, merges = MOVES[role][at][to]
        cost += price
        relabelled += to != role
        if merges:
            merged += 1
            out.append("\n\n" + escaped(text or ""))
        else:
            for empty in BETWEEN[at, to]:
                inserted += 1
                message(empty, "")
            message(to, escaped(text or ""))
    if last:
        for empty in CLOSING[at]:
            inserted, cost = inserted + 1, cost + INSERT
            message(empty, "")
        out.append("<|end|>\n" if at != START else "")
    return "".join(out), n, cost, merged, relabelled, inserted


OUT = "conv_id bigint, part int, n_turns bigint, n_messages bigint, cost bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, rendered string"
CHUNK = "conv_id bigint, part bigint, roles array<int>, texts array<string>, matrix array<bigint>"


def _rows(out: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _groups(batches, most: int | None):
    """(conv_id, roles, texts) of sorted rows, conversation by conversation, in pieces of at most `most` messages."""
    key, roles, texts = None, [], []
    for batch in batches:
        for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
            if roles and (conv != key or len(roles) == most):
                yield key, roles, texts
                roles, texts = [], []
            key = conv
            roles.append(role_of(role))
            texts.append(text)
    if roles:
        yield key, roles, texts


def _whole(batches, most: int | None = None):
    schema, out, size = _arrow(OUT), [], 0
    for conv, roles, texts in _groups(batches, most):
        final = final_state(costs(roles, START)[0])
        text, *numbers = render(roles, texts, START, final, True)
        out.append((conv, 0, len(roles), *numbers, text))
        size += len(text)
        if len(out) >= 1000 or size > 4 << 20:
            yield _rows(out, schema)
            out, size = [], 0
    if out:
        yield _rows(out, schema)


def _in_parts(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Repairs of conversations of any length: pieces of at most `most` messages of each range of rows."""

    def cut(batches):
        schema = _arrow(CHUNK)
        for number, (conv, roles, texts) in enumerate(_groups(batches, most)):
            yield _rows([(conv, number, roles, texts, [c for entry in range(4) for c in costs(roles, entry)[0]])], schema)

    dealt = durable(rows.withColumn("tie", F.monotonically_increasing_id()))
    ranged = dealt.repartitionByRange("conv_id", *order, "tie").sortWithinPartitions("conv_id", *order, "tie")
    chunks = ranged.select("conv_id", "role", "text").mapInArrow(cut, CHUNK)
    chunks = durable(chunks.withColumn("part", F.shiftleft(F.spark_partition_id().cast("bigint"), 32) + F.col("part")))

    def join(key, table):
        parts = sorted(zip(table["part"].to_pylist(), table["matrix"].to_pylist()))
        now, trail = [0 if s == START else NEVER for s in range(4)], []
        for _, m in parts:
            best = [min(range(4), key=lambda at, to=to: now[at] + m[4 * at + to]) for to in range(4)]
            now = [min(NEVER, now[at] + m[4 * at + to]) for to, at in enumerate(best)]
            trail.append(best)
        ends = [final_state(now)]
        for best in reversed(trail):
            ends.append(best[ends[-1]])
        ends = ends[::-1]
        n = len(parts)
        return pa.table({"conv_id": table["conv_id"], "part": [p for p, _ in parts], "number": pa.array(range(n), pa.int32()), "entry": pa.array(ends[:-1], pa.int32()), "final": pa.array(ends[1:], pa.int32()), "last": [k == n - 1 for k in range(n)]})

    solved = chunks.select("conv_id", "part", "matrix").groupBy("conv_id").applyInArrow(join, "conv_id bigint, part bigint, number int, entry int, final int, last boolean")
    solved = solved.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")

    def write(batches):
        schema = _arrow(OUT)
        for batch in batches:
            for r in batch.to_pylist():
                text, *numbers = render(r["roles"], r["texts"], r["entry"], r["final"], r["last"])
                yield _rows([(r["conv_id"], r["number"], len(r["roles"]), *numbers, text)], schema)

    both = chunks.join(solved, chunks["conv_id"].eqNullSafe(solved["c"]) & (chunks["part"] == solved["p"]))
    return both.select("conv_id", "number", "roles", "texts", "entry", "final", "last").mapInArrow(write, OUT)


def _joined(parts: DataFrame) -> DataFrame:
    """One row for each conversation: numbers add up over its parts, and their texts in order are the whole."""
    numbers = [c for c in parts.columns if c not in ("conv_id", "part", "rendered")]
    texts = F.array_sort(F.collect_list(F.struct("part", "rendered")))
    rows = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in numbers), texts.alias("texts"))
    return rows.select("conv_id", *numbers, F.array_join(F.transform("texts", lambda x: x["rendered"]), "").alias("rendered"))


def format_chats(turns: DataFrame, most: int = 2000) -> DataFrame:
    """Repaired conversations, one row each: conv_id, n_turns, n_messages, cost, n_merged, n_relabelled, n_inserted, rendered.

    turns: conv_id, turn, role, text; other columns are ignored. Messages are ordered by turn (null first); equal turns by
    role, then by hash of the text. Roles other than system, user and assistant, and null, have to be relabelled; null
    texts are empty; a message without a conv_id is a conversation of its own; repeated rows are messages of their own. Among
    repairs of equal cost the one through earlier states is taken. An empty table gives no rows.

    Conversations of more than `most` messages are dealt by range of their order and repaired in pieces of at most `most`
    messages, of which only a cost matrix meets those of the conversation; the pieces' texts are then joined. So `most` bounds
    what a task repairs and changes no result; a rendered conversation has to fit into a row.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").withColumn("th", F.xxhash64("text"))
    order = ["turn", "role", "th"]
    alone = rows.where("conv_id is null").select("conv_id", "role", "text").mapInArrow(lambda batches: _whole(batches, 1), OUT)
    rows = rows.where("conv_id is not null")
    long = durable(rows.groupBy("conv_id").count().where(F.col("count") > most).select("conv_id"))
    some = not long.isEmpty()
    usual = rows.join(long, "conv_id", "left_anti") if some else rows
    out = usual.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "role", "text").mapInArrow(_whole, OUT).unionByName(alone).drop("part")
    return out.unionByName(_joined(_in_parts(rows.join(long, "conv_id", "left_semi"), order, most))) if some else out
