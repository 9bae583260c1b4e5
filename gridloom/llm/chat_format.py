"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

A legal conversation is: at most one system turn first, then user and assistant in
turn, beginning with the user. Every turn of the input is used; for each, the
cheapest of these is chosen so that the whole conversation is legal at the least cost:

    keep      the turn stands as it is, at no cost
    merge     its text joins the turn before it, which has the same role
    relabel   it gets another role
    insert    an empty turn of the missing role goes in front of it

The dynamic programme runs over the automaton's states (nothing yet, after system,
after user, after assistant). Its step for one turn is a small table of costs from
state to state, and tables of successive turns combine like matrices. So a
conversation need not sit in one task: turns are sorted and dealt out in ranges,
every range is reduced to one table per conversation that it cuts, the driver
walks over those few tables from range to range, and each range then chooses its own
actions between the states it was given.

Defined results
    null role, unknown role  no role fits as it is: the turn is relabelled
    null text                an empty text
    null turn                before all numbered turns
    null conv_id             such rows form one conversation
    ties                     of equal total cost: the cheaper last step, then the earlier state; of equal turns: by role and text
    repeated rows            each is a turn of its own
    empty table              an empty result with the same schema
    very long text           carried as it is, never joined into one string
    clashing column names    only the four named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import stored

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Cost of each repair; keeping costs nothing.
COSTS = {"merge": 2, "relabel": 3, "insert": 4}
#: Which role may follow which state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDLESS = 1 << 60

#: How a message is written; a fixed format.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"

REPAIRED = "conv_id long, place long, turn long, role string, action string, inserted string, rendered string"


def steps(role: int | None) -> list[tuple[int, int, int, str, int | None]]:
    """(from, to, cost, action, inserted role) for one turn, cheapest first and in the order of the actions."""
    found = []
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            change = 0 if to == role else COSTS["relabel"]
            name = "keep" if to == role else "relabel"
            if to in LEGAL[state]:
                found.append((state, to, change, name, None))
            elif state == to:
                found.append((state, to, COSTS["merge"] + change, "merge", None))
            else:
                between = [m for m in LEGAL[state] if to in LEGAL[m]]
                if between:
                    found.append((state, to, COSTS["insert"] + change, "insert" if to == role else "relabel+insert", between[-1]))
    return found


_STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}


def table_of(role: int | None) -> list[list[int]]:
    """Least cost from each state to each state over one turn."""
    made = [[ENDLESS] * 4 for _ in range(4)]
    for a, b, cost, _, _ in _STEPS[role]:
        made[a][b] = min(made[a][b], cost)
    return made


_TABLES = {role: table_of(role) for role in _STEPS}


def after(costs: list[int], role: int | None) -> list[int]:
    """Least cost of every state after one more turn."""
    table = _TABLES[role]
    return [min(min(costs[a] + table[a][b] for a in range(4)), ENDLESS) for b in range(4)]


def choices(roles: list[int | None], begin: int, end: int | None) -> list[tuple[int, str, int | None]]:
    """(role, action, inserted role) per turn, from a given state to a given or else the cheapest last one."""
    costs = [[0 if s == begin else ENDLESS for s in range(4)]]
    for role in roles:
        costs.append(after(costs[-1], role))
    state = end if end is not None else min(range(4), key=lambda s: costs[-1][s])
    chosen = []
    for at in range(len(roles) - 1, -1, -1):
        a, _, _, action, between = min(
            (s for s in _STEPS[roles[at]] if s[1] == state and costs[at][s[0]] + s[2] == costs[at + 1][state]), key=lambda s: (s[2], s[0]))
        chosen.append((state, action, between))
        state = a
    return chosen[::-1]


def _role(value: str | None) -> int | None:
    return ROLES.get(value.strip().lower()) if value else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of one conversation in a sorted range: (conv_id, [(turn, role, text, range, place)])."""
    key, run, begun = None, [], False
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != key:
                yield key, run
                run = []
            key, begun = conv, True
            run.append(tuple(row))
    if begun:
        yield key, run


def repaired(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in the order of (conv_id, place): its role after repair, the action, what goes in front, and its rendering.

    Renderings of a conversation, in order of place, make up its text: the turn
    that does not merge closes the one before it, and the last turn closes itself.
    """
    named = df.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.col(f"`{role}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # Equal rows may be very many; a hash of their place in the input lets a range end between them.
    spread = named.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    placed = ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place"))
    turns = stored(placed, "turns")
    sorted_turns = turns.repartition("range").sortWithinPartitions("range", "place")
    bounds = _bounds(sorted_turns)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "turn", "role", "action", "inserted", "rendered"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        for key, run in _split(_runs(batches)):
            begin, end, last = bounds.get((run[0][3], key), (START, None, True))
            chosen = choices([_role(r[1]) for r in run], begin, end)
            rows, state_before = [], begin
            for at, ((number, _, words, _, place), (state, action, between)) in enumerate(zip(run, chosen)):
                lead = "" if state_before == START or action == "merge" else CLOSE
                lead += "" if between is None else OPEN.format(role=NAMES[between]) + CLOSE
                shown = lead + ("\n" if action == "merge" else OPEN.format(role=NAMES[state])) + words
                shown += CLOSE if last and at == len(run) - 1 else ""
                state_before = state
                rows.append((key, place, number, NAMES[state], action, NAMES.get(between), shown))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return sorted_turns.select("conv_id", "turn", "role", "text", "range", "place").mapInArrow(repair, REPAIRED)


def _split(runs: Iterator[tuple]) -> Iterator[tuple]:
    """Runs cut where their range changes: one task may read several ranges."""
    for key, run in runs:
        start = 0
        for at in range(1, len(run) + 1):
            if at == len(run) or run[at][3] != run[start][3]:
                yield key, run[start:at]
                start = at


def _bounds(turns: DataFrame) -> dict[tuple[int, int | None], tuple[int, int, bool]]:
    """(range, conv_id) -> (state before, state after, whether it is the last range), for conversations cut by ranges.

    A range has at most two of them, its first and its last, so the driver sees a
    few numbers per range.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, run in _split(_runs(batches)):
            states = [[0 if a == b else ENDLESS for b in range(4)] for a in range(4)]
            for r in run:
                states = [after(s, _role(r[1])) for s in states]
            rows.append((key, run[0][3], [c for s in states for c in s]))
        if rows:
            last = {r[1]: at for at, r in enumerate(rows)}
            ends = [r for at, r in enumerate(rows) if at == last[r[1]] or at == 0 or rows[at - 1][1] != r[1]]
            columns = list(zip(*ends))
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))],
                names=["conv_id", "range", "costs"])

    ends = turns.select("conv_id", "turn", "role", "text", "range", "place").mapInArrow(reduce, "conv_id long, range int, costs array<long>")
    by_conv: dict[int | None, list] = {}
    for r in ends.distinct().collect():  # at most two rows per range
        by_conv.setdefault(r["conv_id"], []).append((r["range"], r["costs"]))
    bounds = {}
    for key, parts in by_conv.items():
        parts.sort()
        if len(parts) < 2:
            continue
        costs = [[0 if s == START else ENDLESS for s in range(4)]]
        for _, table in parts:
            costs.append([min(min(costs[-1][a] + table[4 * a + b] for a in range(4)), ENDLESS) for b in range(4)])
        state = min(range(4), key=lambda s: costs[-1][s])
        for at in range(len(parts) - 1, -1, -1):
            number, table = parts[at]
            begin = min((a for a in range(4) if costs[at][a] + table[4 * a + state] == costs[at + 1][state]), default=START)
            bounds[number, key] = (begin, state, at == len(parts) - 1)
            state = begin
    return bounds
