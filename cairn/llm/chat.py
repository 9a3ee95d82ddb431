"""Chat formatting by minimum-cost role repair over an automaton of legal turns.

States are the roles of the last turn written. A source turn is written under its role or relabelled, joined to
the turn before when that has the same role, or preceded by an empty turn that makes it legal. Costs add
along the turns, so a stretch of turns is a matrix of least costs from state to state and stretches
combine by (min, +) products: a conversation that spans partitions is repaired piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch

#: States: nothing written yet, then the role of the last turn.
STATES = ("", "system", "user", "assistant")
ROLES = STATES[1:]
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next roles.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1.0, 1.5, 2.0
INF = 1e18


def link(state: int, role: int) -> tuple[float, str, list[int]]:
    """Least cost of writing role after state, how, and the empty turns put before it."""
    if role in LEGAL[state]:
        return 0.0, "keep", []
    best = (MERGE, "merge", []) if state == role else (INF, "", [])
    for between in LEGAL[state]:
        if role in LEGAL[between] and best[0] > INSERT:
            best = (INSERT, "insert", [between])
    return best


_LINK = [[link(s, r) for r in range(1, 4)] for s in range(4)]


def steps(role: str | None) -> np.ndarray:
    """4 x 4 least costs of writing a turn of this role, from state to state; an unknown role can take any."""
    out = np.full((4, 4), INF)
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            cost = _LINK[s][r - 1][0] + (0.0 if STATES[r] == role else RELABEL)
            out[s, r] = min(out[s, r], cost)
    return np.minimum(out, INF)


_STEPS = {r: steps(r) for r in (*ROLES, None)}


def _step(role) -> np.ndarray:
    return _STEPS.get(role, _STEPS[None])


#: Cost of ending after each state: a conversation ends with the assistant, if need be with an empty turn.
END = np.array([0.0, INF, INSERT, 0.0])
END[SYSTEM] = 2 * INSERT


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def repair(roles: list[str | None], enter: int = START, leave: int | None = None) -> tuple[float, list[int]]:
    """Least cost and the state after each turn, from enter to leave (None: to the cheapest end). Ties: the earlier state."""
    costs, back = np.full(4, INF), []
    costs[enter] = 0.0
    for r in roles:
        table = costs[:, None] + _step(r)
        back.append(table.argmin(axis=0))
        costs = np.minimum(table.min(axis=0), INF)
    last = int((costs + END).argmin()) if leave is None else leave
    total, path = float(costs[last] + (END[last] if leave is None else 0)), []
    for table in reversed(back):
        path.append(last)
        last = int(table[last])
    return total, path[::-1]


def canonical(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    return r if r in ROLES else {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}.get(r)


_OUT = "conv_id {0}, piece long, action string, role string, source_role string, text string, rendered string, cost double"


def _rows(t: pa.Table) -> list[dict]:
    rows = t.select(["turn", "role", "text"]).to_pylist()
    return sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "", r["text"] is not None, r["text"] or ""))


def _matrix(t: pa.Table) -> pa.Table:
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in _rows(t):
        m = plus(m, _step(canonical(r["role"])))
    return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "part": t.column("part").slice(0, 1), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})


def _render(t: pa.Table) -> pa.Table:
    rows = _rows(t)
    enter, leave = t.column("enter")[0].as_py(), t.column("leave")[0].as_py()
    part = t.column("part")[0].as_py()
    roles = [canonical(r["role"]) for r in rows]
    _, path = repair(roles, enter, leave)
    out, state = [], enter

    def write(action, role, source, text, cost):
        head = "" if state == START else "<|end|>\n"
        shown = "\n" + text if action == "merge" else f"{head}<|{STATES[role]}|>\n{text}"
        out.append({"piece": (part << 33) + len(out), "action": action, "role": STATES[role], "source_role": source, "text": text, "rendered": shown, "cost": cost})

    for r, known, role in zip(rows, roles, path, strict=True):
        cost, how, between = _LINK[state][role - 1]
        for e in between:
            write("insert", e, None, "", INSERT)
            state = e
        moved = RELABEL if STATES[role] != known else 0.0
        write("merge" if how == "merge" else "relabel" if moved else "keep", role, r["role"], r["text"] or "", moved + (cost if how == "merge" else 0.0))
        state = role
    if leave is None:
        for e in {USER: [ASSISTANT], SYSTEM: [USER, ASSISTANT]}.get(state, []):
            write("insert", e, None, "", INSERT)
            state = e
        if out:
            out[-1]["rendered"] += "<|end|>\n"
    fields = [("piece", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("source_role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("cost", pa.float64())]
    table = pa.Table.from_pylist(out, schema=pa.schema(fields))
    conv = t.column("conv_id")[0].as_py()
    return table.add_column(0, "conv_id", pa.array([conv] * len(out), t.schema.field("conv_id").type))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Pieces of repaired conversations (conv_id, turn, role, text, ...), ordered by (conv_id, piece).

    action: keep, relabel, merge (continues the turn before) or insert (an empty turn). Joining rendered in order gives the chat text.
    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. A null or unknown role
    can take any label at the cost of a relabelling; common other names of roles are known. Null text is empty. Rows with a
    null conv_id are one conversation. An empty table gives an empty result; extra columns are ignored, whatever their names. Texts of any
    length and conversations of any number of turns are repaired whole.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    src = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    #: range partitions bound the turns a task gathers, however long a conversation is
    parts = scratch.cut(src.repartitionByRange("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id().cast("long")))
    span = parts.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    many = parts.join(F.broadcast(span.select(F.col("conv_id").alias("c"))), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")  # at most one for each partition border
    matrices = many.groupBy("conv_id", "part").applyInArrow(_matrix, f"conv_id {kind}, part long, m array<double>").collect()
    plan: dict = {}
    for r in sorted(matrices, key=lambda r: r.part):
        plan.setdefault(r.conv_id, []).append((r.part, np.array(r.m).reshape(4, 4)))
    rows = []
    for conv, stretch in plan.items():
        costs, seen = [np.where(np.arange(4) == START, 0.0, INF)], []
        for _, m in stretch:
            table = costs[-1][:, None] + m
            seen.append(table.argmin(axis=0))
            costs.append(np.minimum(table.min(axis=0), INF))
        state = int((costs[-1] + END).argmin())
        last = None
        for (part, _), back in zip(reversed(stretch), reversed(seen), strict=True):
            before = int(back[state])
            rows.append((conv, part, before, last if last is None else state))
            state, last = before, before
    borders = conversations.sparkSession.createDataFrame(rows, f"c {kind}, p long, enter int, leave int")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    full = parts.join(F.broadcast(borders), on, "left").select("conv_id", "part", "turn", "role", "text", F.coalesce("enter", F.lit(START)).alias("enter"), "leave")
    return full.groupBy("conv_id", "part").applyInArrow(_render, _OUT.format(kind))
