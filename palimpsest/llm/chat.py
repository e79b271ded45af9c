"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and
assistant turns in turn, ending with an assistant's. Each turn may keep its
role, be relabelled, be merged into the message before it, or follow an empty
inserted message; every choice costs, and dynamic programming over the
automaton of legal turns finds the cheapest repair, ties to the choice listed
first. Costs of a stretch of turns are a matrix over the automaton's states,
and matrices of consecutive stretches combine by (min, +). Turns are dealt
over the cluster in order, so that one conversation may span partitions: of
each partition only the matrices of its first and its last conversation are
gathered, which fixes the states at its edges; each task then repairs its own
stretches.

Turns are ordered by (turn, role, text), so repeated rows and equal turn
numbers have a defined order; null turns come first. Text that looks like a
control token is escaped, so no turn can forge another. Rows with a null conv_id
are one conversation. A null text is empty; a null or unknown role may become
any at the least relabelling cost. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, after a system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN, INSERT = 2, 3, 5, 1, 4
FAR = 10**15
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def escaped(text: str) -> str:
    """``text`` with every <| written as <||, so that it holds no control token; ``unescaped`` undoes it."""
    return text.replace("<|", "<||")


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")



def relabel_cost(role: str, to: int) -> int:
    name = ROLES[to - 1]
    if role == name:
        return 0
    if role not in ROLES:
        return RELABEL_UNKNOWN
    return RELABEL_SYSTEM if "system" in (role, name) else RELABEL


def choices(role: str) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """[from][to]: the cheapest choice for a turn of ``role``: cost, action and the states of inserted messages."""
    table = [[(FAR, "", ())] * 4 for _ in range(4)]

    def offer(a: int, b: int, cost: int, action: str, inserted: tuple[int, ...] = ()) -> None:
        if cost < table[a][b][0]:
            table[a][b] = (cost, action, inserted)

    for a in range(4):
        for b in NEXT[a]:
            cost = relabel_cost(role, b)
            offer(a, b, cost, "keep" if cost == 0 else "relabel")
        if a != START:
            offer(a, a, MERGE + relabel_cost(role, a), "merge")
        for between in NEXT[a]:
            for b in NEXT[between]:
                offer(a, b, INSERT + relabel_cost(role, b), "insert", (between,))
    return table


TABLES = {role: choices(role) for role in (*ROLES, "")}
MATRICES = {role: np.array([[c[0] for c in row] for row in t], np.int64) for role, t in TABLES.items()}
#: Cost and inserted messages of ending in each state; a conversation has at least one turn.
ENDS = ((FAR, ()), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0, ()))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of a stretch followed by another."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def repair(roles: list[str], entry: int, leave: int | None) -> list[tuple[int, str, tuple[int, ...]]]:
    """State, action and inserted states of each turn, from state ``entry`` to ``leave``, or to the cheapest end if None."""
    costs = [FAR] * 4
    costs[entry] = 0
    back: list[list[int]] = []
    for role in roles:
        table = TABLES[role]
        best, came = [], []
        for b in range(4):
            total, a = min((costs[a] + table[a][b][0], a) for a in range(4))
            best.append(min(total, FAR))
            came.append(a)
        costs = best
        back.append(came)
    state = leave if leave is not None else min(range(4), key=lambda s: (costs[s] + ENDS[s][0], s))
    out = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        _, action, inserted = TABLES[role][came[state]][state]
        out.append((state, action, inserted))
        state = came[state]
    return out[::-1]


def _stretches(rows: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The partition's rows, sorted, by conversation."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            row["known"] = row["role"] if row["role"] in ROLES else ""
            if held and held[-1]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


EDGES = "pid int, last boolean, conv_id long, n long, costs array<long>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of the partition's first and last conversation."""
    first = last = None
    pid = matrix = None
    for stretch in _stretches(batches):
        pid = stretch[0]["pid"]
        matrix = MATRICES[stretch[0]["known"]]
        for row in stretch[1:]:
            matrix = combine(matrix, MATRICES[row["known"]])
        last = {"pid": pid, "last": True, "conv_id": stretch[0]["conv_id"], "n": len(stretch), "costs": matrix.ravel().tolist()}
        first = first or last | {"last": False}
    schema = pa.schema([("pid", pa.int32()), ("last", pa.bool_()), ("conv_id", pa.int64()), ("n", pa.int64()), ("costs", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_pylist([x for x in (first, last) if x], schema)


def edge_states(edges: list) -> dict[tuple[int, int | None], tuple[int, int | None, int]]:
    """Of each conversation that spans partitions, in each: entry state, state to leave in (None at its end), turns before."""
    pieces: dict[int | None, dict[int, tuple[np.ndarray, int]]] = {}
    for e in edges:
        pieces.setdefault(e["conv_id"], {})[e["pid"]] = (np.array(e["costs"], np.int64).reshape(4, 4), e["n"])
    out = {}
    for conv, own in pieces.items():
        pids = sorted(own)
        if len(pids) < 2:
            continue
        costs = [np.array([0, FAR, FAR, FAR], np.int64)]
        for p in pids:
            costs.append(np.minimum((costs[-1][:, None] + own[p][0]).min(axis=0), FAR))
        state = min(range(4), key=lambda s: (int(costs[-1][s]) + ENDS[s][0], s))
        before = sum(n for _, n in own.values())
        leave: int | None = None
        for k in range(len(pids) - 1, -1, -1):
            through = costs[k] + own[pids[k]][0][:, state]
            entry = int(through.argmin())
            before -= own[pids[k]][1]
            out[pids[k], conv] = (entry, leave, before)
            state = leave = entry
    return out


FORMATTED = "conv_id long, position long, turn long, role string, action string, inserted string, rendered string"


def _format(edges):
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "action", "inserted", "rendered"))])

    def empty(states: tuple[int, ...]) -> str:
        return "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = edges.value, []
        for stretch in _stretches(batches):
            conv = stretch[0]["conv_id"]
            entry, leave, before = known.get((stretch[0]["pid"], conv), (START, None, 0))
            steps = repair([r["known"] for r in stretch], entry, leave)
            for k, (row, (state, action, inserted)) in enumerate(zip(stretch, steps, strict=True)):
                role, text = ROLES[state - 1], escaped(row["text"] or "")
                begun = before + k > 0
                rendered = "\n" + text if action == "merge" else (CLOSE if begun else "") + empty(inserted) + OPEN.format(role) + text
                names = [ROLES[s - 1] for s in inserted]
                if leave is None and k + 1 == len(stretch):
                    rendered += CLOSE + empty(ENDS[state][1])
                    names += ["+" + ROLES[s - 1] for s in ENDS[state][1]]
                out.append({"conv_id": conv, "position": before + k, "turn": row["turn"], "role": role, "action": action, "inserted": ",".join(names), "rendered": rendered})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def format_chats(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each turn: its place, repaired role, what was done, roles inserted before it (after it: +), and its rendering.

    A conversation's rendering is that of its turns in order of ``position``
    (see ``rendered``); texts are ``escaped`` in it.
    At most two matrices of each partition are gathered.
    """
    spark = conversations.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    split = F.monotonically_increasing_id()  # of rows that are equal in all four, whose order is of no account
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.col("text").cast("string").alias("text"))
    dealt = stored(rows.repartitionByRange(partitions, *order, split).withColumn("pid", F.spark_partition_id()), "turns")
    of_partition = dealt.repartitionById(partitions, F.col("pid")).sortWithinPartitions(*order)
    edges = of_partition.select("pid", "conv_id", "role").mapInArrow(_edges, EDGES).collect()
    known = spark.sparkContext.broadcast(edge_states(edges))
    return of_partition.mapInArrow(_format(known), FORMATTED)


def rendered(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns and the whole rendering of each conversation, from the rows of ``format_chats``.

    A rendering is one row: it is for conversations that fit in one, and
    others stay as rows of their turns.
    """
    turns = formatted.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("position", "rendered"))).alias("turns"))
    return turns.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("rendering"))
