"""Chat formatting by minimum-cost role repair.

A conversation is legal when it is an optional system turn, then user and assistant turns in
alternation from user on. A turn of any other place or role is repaired by one of three edits: it is
merged into the turn before it, which has its role (cost ``MERGE``); it takes another role
(``RELABEL``, more where system is involved); or an empty turn is inserted before it (``INSERT``).
Dynamic programming over the automaton's states (start, system, user, assistant) finds the cheapest
edits; ties prefer to keep, then to merge, relabel and insert. The repaired turns are rendered, each
under its role's header; text that looks like the start of a header is escaped (``escape``), so that
headers are told from text.

Costs along a run of turns form a matrix from entry state to exit state, and matrices of successive
runs combine; so conversations are cut every ``RUN`` turn numbers, each run's matrix is made from its
roles alone, the runs' states are chosen from the matrices, and each run is then repaired between its
two states. A conversation of any length is therefore no task of its own. ``repair_roles`` gives a row
for each turn and each inserted one; ``render_sequences`` puts them together, a row for each run: by
(conv_id, part) these make up the conversation, which for fewer than ``RUN`` turns is one row.

Defined results: rows without conv_id or turn are left out and equal rows count once; turns of one
number go by role, then text; an unknown or null role costs ``RELABEL`` to become any role and
merges with nothing, and different ones are different turns; a null text is empty; texts are of any
length; a conversation of a system turn alone gets an empty user turn; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE, RELABEL, SYSTEM_RELABEL, INSERT = 1, 2, 3, 3
RUN = 4096
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that each state's next turn may lead to; the state is the last turn's role.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT)
NEVER = 10**9
TURN = "conv_id long, turn long, step int, role string, edit string, cost int, rendered string"
SEQUENCE = "conv_id long, part int, turns long, edits long, cost long, rendered string"
STATES = "conv_id long, run long, part int, enter int, leave int, last boolean"
Edit = tuple[str, int, int]  # what, the state after it, its cost


def place(role: int, state: int) -> Edit:
    """A turn of a role (0 unknown) that becomes one of the state's role."""
    if role == state:
        return ("keep", state, 0)
    return ("relabel", state, SYSTEM_RELABEL if SYSTEM in (role, state) else RELABEL)


def moves(role: int, state: int) -> list[tuple[list[Edit], int]]:
    """Every way to take a turn of a role from a state: edits, the last one the turn's own, and their cost."""
    out: list[tuple[list[Edit], int]] = [([edit := place(role, s)], edit[2]) for s in NEXT[state]]
    if role == state and role:
        out.append(([("merge", state, MERGE)], MERGE))
    for s in NEXT[state]:  # one empty turn is enough to reach any legal state
        out += [([("insert", s, INSERT), edit := place(role, t)], INSERT + edit[2]) for t in NEXT[s]]
    return sorted(out, key=lambda m: m[1])


MOVES = {(role, state): moves(role, state) for role in range(4) for state in range(4)}


def solve(roles: list[int], start: int) -> tuple[list[int], list[list[tuple[int, list[Edit]] | None]]]:
    """From one entry state: the cost of each exit state, and for each turn how each state was reached."""
    cost, steps = [NEVER] * 4, []
    cost[start] = 0
    for role in roles:
        after, came = [NEVER] * 4, [None] * 4
        for state in range(4):
            if cost[state] < NEVER:
                for edits, price in MOVES[role, state]:
                    to = edits[-1][1]
                    if cost[state] + price < after[to]:
                        after[to], came[to] = cost[state] + price, (state, edits)
        cost = after
        steps.append(came)
    return cost, steps


def finish(cost: list[int]) -> tuple[int, int, list[Edit]]:
    """The exit state, its cost, and the edits after the last turn."""
    ways = [(cost[s], s, []) for s in FINAL] + [(cost[s] + INSERT, s, [("insert", t, INSERT)]) for s in (START, SYSTEM) for t in NEXT[s] if t in FINAL]
    best = min(ways, key=lambda w: (w[0], w[1]))
    return best[1], best[0], best[2]


def repair(roles: list[int], start: int, end: int) -> list[list[Edit]]:
    """The edits of each turn on the cheapest way from one state to another."""
    _, steps = solve(roles, start)
    out, state = [], end
    for came in reversed(steps):
        state, edits = came[state]
        out.append(edits)
    return out[::-1]


def escape(text: str) -> str:
    """Text in which nothing looks like a header; replacing the other way round gives the text back."""
    return text.replace("<|", "<||")


def render(role: str, text: str, edit: str) -> str:
    """A turn under its role's header; a merged one goes on below the turn before."""
    return f"{escape(text)}\n" if edit == "merge" else f"<|{role}|>\n{escape(text)}\n"


def runs(rows: Iterator[dict]) -> Iterator[tuple[tuple, list[dict]]]:
    """Successive rows of one run of one conversation."""
    for key, found in groupby(rows, key=lambda r: (r["conv_id"], r["run"])):
        yield key, list(found)


def role_number(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def by_run(turns: DataFrame, *order: str) -> DataFrame:
    """Turns dealt by run, in order within each."""
    return turns.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", *order)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def repair_roles(conversations: DataFrame) -> DataFrame:
    """Repaired turns: conv_id, turn, step, role, edit, cost, rendered."""
    return _repaired(conversations, TURN, lambda conv, part, turns: [(conv, *t) for t in turns])


def render_sequences(conversations: DataFrame) -> DataFrame:
    """The repaired conversations as text: conv_id, part (from 0, in order), turns, edits, cost, rendered."""

    def put_together(conv: int, part: int, turns: list[tuple]) -> list[tuple]:
        edits = [t[3] for t in turns]
        return [(conv, part, len(edits) - edits.count("merge"), len(edits) - edits.count("keep"), sum(t[4] for t in turns), "".join(t[5] for t in turns))]

    return _repaired(conversations, SEQUENCE, put_together)


def _repaired(conversations: DataFrame, schema: str, rows_of: Callable[[int, int, list[tuple]], list[tuple]]) -> DataFrame:
    """What ``rows_of`` makes of each run's conversation, part and repaired turns (turn, step, role, edit, cost, rendered)."""
    role = F.lower(F.trim(F.col("role").cast("string")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)).cast("int")
    given = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).dropna(subset=["conv_id", "turn"]).distinct()
    turns = given.select("conv_id", "turn", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("run", F.floor(F.col("turn") / RUN).cast("long"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(c, r, [solve([x["rank"] for x in rows], s)[0] for s in range(4)]) for (c, r), rows in runs(each_row(batches))]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([np.ravel(f[2]).tolist() for f in found], pa.list_(pa.int32()))], ["conv_id", "run", "matrix"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, came = [0, NEVER, NEVER, NEVER], []
                for part in parts:
                    m = np.array(part["matrix"]).reshape(4, 4)
                    total = np.minimum(np.array(cost)[:, None] + m, NEVER)
                    came.append(total.argmin(0))
                    cost = total.min(0).tolist()
                end, _, _ = finish(cost)
                for number in reversed(range(len(parts))):
                    enter = int(came[number][end])
                    out.append((conv, parts[number]["run"], number, enter, end, number == len(parts) - 1))
                    end = enter
            yield batch_of(out, STATES)

    # the cost of a run hangs on its roles alone, so texts stay behind
    costs = by_run(turns.select("conv_id", "run", "turn", "rank"), "turn", "rank").mapInArrow(matrices, "conv_id long, run long, matrix array<int>")
    states = costs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "matrix"))).alias("parts")).mapInArrow(choose, STATES)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, _), rows in runs(each_row(batches)):
            enter, leave, last = rows[0]["enter"], rows[0]["leave"], rows[0]["last"]
            ways = repair([r["rank"] for r in rows], enter, leave)
            if last and leave not in FINAL:
                rows, ways = [*rows, {"turn": rows[-1]["turn"], "text": "", "part": rows[0]["part"]}], [*ways, [("insert", USER, INSERT)]]
            step, turn, made = 0, None, []
            for row, edits in zip(rows, ways, strict=True):
                step, turn = (step if row["turn"] == turn else 0), row["turn"]
                for what, state, cost in edits:
                    name = ROLES[state - 1]
                    made.append((turn, step, name, what, cost, render(name, "" if what == "insert" else row["text"], what)))
                    step += 1
            out += rows_of(conv, rows[0]["part"], made)
            if len(out) >= 5000:
                yield batch_of(out, schema)
                out = []
        yield batch_of(out, schema)

    dealt = turns.select("conv_id", "run", "turn", "rank", "text").repartition("conv_id", "run")
    return dealt.join(states, ["conv_id", "run"]).sortWithinPartitions("conv_id", "run", "turn", "rank", "text").mapInArrow(repaired, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema written as for Spark."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))
