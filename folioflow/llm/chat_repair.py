"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, at its start, and then user
and assistant turns in alternation, beginning with the user and ending with the
assistant.  Each given turn is emitted as a role that may follow, merged into
the turn before it, or emitted after one inserted empty turn; another role than
its own is a relabel.  Costs: ``MERGE``, ``INSERT``, ``RELABEL``; what is missing
at the end is inserted.  Dynamic programming over the automaton's states finds
the cheapest repair.  Among equals the one counts whose states, read from the end,
come first in the order of ROLES; between the same two states emitting goes before
merging, and merging before inserting.

A turn's choices are a matrix between states, of costs and of the rank of each way
among those to the same state, read from the end.  Such matrices combine
associatively, ties included, so the repair does not depend on where a conversation
is cut.  Rows are range-partitioned by conversation and turn, each task reduces its
stretches of a conversation, of ``STRETCH`` turns at most, to one matrix each, the
matrices of a conversation are chained, and then each stretch is traced back on its
own between known states.  So no conversation, however long, is gathered into a task.

The result has one row for each given turn: its place ``pos`` in the conversation,
what becomes of it, and the text that it adds to the rendered conversation; joined
in the order of ``pos`` they are the rendering.

Defined edge cases: a null or unknown role may become any role, as a relabel; a
null text is empty; turns are in the order of turn, role and text, nulls first,
so ties and repeated rows have a fixed order; a null conversation id is one
conversation; markers within a text are broken up; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import materialize

MERGE, INSERT, RELABEL = 2, 3, 4
ROLES = ("system", "user", "assistant")
#: States: 0 before any turn, else 1 + the role of the last turn.
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Turns to insert at the end, by state.
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}
_NEVER = 1 << 40
#: Turns of a conversation that are traced together.
STRETCH = 4096
#: How a step was made: (cost, order among equals, merged, inserted role or 0).
_steps: dict[int, dict[tuple[int, int], tuple[int, int, bool, int]]] = {}


def steps(role: int) -> dict[tuple[int, int], tuple[int, int, bool, int]]:
    """Return the best step between each two states for a turn of ``role`` (a state, 0: unknown)."""
    if role not in _steps:
        best: dict[tuple[int, int], tuple[int, int, bool, int]] = {}

        def offer(s: int, t: int, step: tuple[int, int, bool, int]) -> None:
            if (s, t) not in best or step[:2] < best[s, t][:2]:
                best[s, t] = step

        for s in range(4):
            for t in FOLLOWS[s]:
                offer(s, t, (RELABEL * (t != role), 0, False, 0))
            if s:
                offer(s, s, (MERGE + RELABEL * (s != role), 1, True, 0))
            for x in FOLLOWS[s]:
                for t in FOLLOWS[x]:
                    offer(s, t, (INSERT + RELABEL * (t != role), 2, False, x))
        _steps[role] = best
    return _steps[role]


def _matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), _NEVER, np.int64)
    for (s, t), step in steps(role).items():
        m[s, t] = step[0]
    return m


_MATRICES = [_matrix(r) for r in range(4)]
#: Costs and ranks of the ways between two states, each 4 x 4 in rows; a rank is among the ways to the same state.
Ways = tuple[tuple[int, ...], tuple[int, ...]]


def turn_ways(role: int) -> Ways:
    """The ways of one turn; the rank is the state before it."""
    return tuple(_MATRICES[role].ravel().tolist()), tuple(s for s in range(4) for _ in range(4))


def compose(first: Ways, second: Ways) -> Ways:
    """The ways through two stretches: cheapest, among equals the first one read from the end."""
    (a, ra), (b, rb) = first, second
    costs, ranks = [0] * 16, [0] * 16
    for t in range(4):
        order = []
        for s in range(4):
            cost, _, u = min((a[4 * s + u] + b[4 * u + t], rb[4 * u + t], u) for u in range(4))
            costs[4 * s + t] = min(cost, _NEVER)
            order.append((cost >= _NEVER, rb[4 * u + t], ra[4 * s + u], s))
        for rank, (*_, s) in enumerate(sorted(order)):
            ranks[4 * s + t] = rank
    return tuple(costs), tuple(ranks)


#: Ways without their least cost, and what a turn of a role makes of them: a few thousand entries at most.
_after: dict[tuple[Ways, int], tuple[Ways, int]] = {}


def extend(ways: Ways, role: int) -> tuple[Ways, int]:
    """Return the ways after one more turn, less their least cost, and that cost."""
    if (ways, role) not in _after:
        costs, ranks = compose(ways, turn_ways(role))
        least = min(costs)
        _after[ways, role] = (tuple(c if c >= _NEVER else c - least for c in costs), ranks), least
    return _after[ways, role]


def chained(stretches: list[Ways]) -> list[int]:
    """Return the states at the ends of the stretches of a whole conversation."""
    costs = [[0, _NEVER, _NEVER, _NEVER]]
    for a, _ in stretches:
        costs.append([min(_NEVER, *(costs[-1][s] + a[4 * s + t] for s in range(4))) for t in range(4)])
    states = [min((1, 2, 3), key=lambda s: (costs[-1][s] + INSERT * len(CLOSING[s]), s))]
    for c, (a, r) in zip(costs[-2::-1], stretches[::-1]):
        t = states[-1]
        states.append(min(range(4), key=lambda s: (c[s] + a[4 * s + t], r[4 * s + t])))
    return states[::-1]


def role_state(role: str | None) -> int:
    """The state of a role's name, 0 if it is null or unknown."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def trace(roles: list[int], start: int, end: int) -> list[int]:
    """Return the state after each turn on the cheapest way from ``start`` to ``end``."""
    cost = np.full(4, _NEVER, np.int64)
    cost[start] = 0
    back = []
    for role in roles:
        both = cost[:, None] + _MATRICES[role]
        back.append(both.argmin(axis=0))
        cost = np.minimum(both.min(axis=0), _NEVER)
    out = [end]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _plain(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def _open(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


END = "<|end|>\n"


def render(before: int, after: int, role: int, text: str | None, last: bool) -> tuple[str, str | None, str]:
    """Return (action, inserted role, text added) of a turn between two states."""
    _, _, merged, inserted = steps(role)[before, after]
    closing = (END + "".join(_open(x) + END for x in CLOSING[after])) if last else ""
    action = ("merge" if merged else "emit") + ("" if after == role else "_relabel")
    if merged:
        return action, None, "\n" + _plain(text) + closing
    out = END if before else ""
    if inserted:
        out += _open(inserted) + END
    return action, ROLES[inserted - 1] if inserted else None, out + _open(after) + _plain(text) + closing


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Return (conv_id, turn, pos, role, action, inserted, new_role, rendered), a row for each turn; order by pos."""
    rows = turns.select(F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the turns of each stretch; its last row carries its ways.

        A batch's last row is held back, as the next one may end the stretch.
        """
        held: pa.RecordBatch | None = None
        key, pos, number, started = None, 0, 0, False
        ways, cost = turn_ways(0), 0

        def flat() -> list[int]:
            return [*(min(c + cost, _NEVER) for c in ways[0]), *ways[1]]

        for batch in batches:
            if not batch.num_rows:
                continue
            convs, roles, parts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "part"))
            positions, numbers, matrices = [], [], [None] * batch.num_rows
            tail = None
            for i, (conv, role) in enumerate(zip(convs, roles)):
                if not started or conv != key or pos + 1 == stretch:
                    if started:
                        if i:
                            matrices[i - 1] = flat()
                        else:
                            tail = flat()
                        number += 1
                    key, started, pos = conv, True, 0
                    ways, cost = turn_ways(role_state(role)), 0
                else:
                    ways, more = extend(ways, role_state(role))
                    pos, cost = pos + 1, cost + more
                positions.append(pos)
                numbers.append((parts[i] << 32) + number)
            if held is not None:
                yield _with_matrix(held, tail)
            kept = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            body = pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), pa.array(positions, pa.int64()), pa.array(matrices, pa.list_(pa.int64()))], names=["conv_id", "turn", "role", "text", "part", "pos", "matrix"])
            if body.num_rows > 1:
                yield body.slice(0, body.num_rows - 1)
            held = body.slice(body.num_rows - 1)
        if held is not None:
            yield _with_matrix(held, flat())

    numbered = materialize(dealt.mapInArrow(reduce, "conv_id string, turn long, role string, text string, part long, pos long, matrix array<long>"), "turns")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Give each stretch of a conversation its place and the states at both of its ends."""
        open_rows: list[dict] = []

        def settle() -> pa.RecordBatch:
            states = chained([(tuple(r["matrix"][:16]), tuple(r["matrix"][16:])) for r in open_rows])
            before = np.cumsum([0, *(r["pos"] + 1 for r in open_rows[:-1])]).tolist()
            return pa.RecordBatch.from_pydict(
                {"conv": [r["conv_id"] for r in open_rows], "p": [r["part"] for r in open_rows], "before": before, "enter": states[:-1], "leave": states[1:], "final": [k == len(open_rows) - 1 for k in range(len(open_rows))]},
                schema=pa.schema([("conv", pa.string()), ("p", pa.int64()), ("before", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("final", pa.bool_())]),
            )

        for batch in batches:
            for row in batch.to_pylist():
                if open_rows and open_rows[0]["conv_id"] != row["conv_id"]:
                    yield settle()
                    open_rows = []
                open_rows.append(row)
        if open_rows:
            yield settle()

    ends = numbered.where("matrix IS NOT NULL").select("conv_id", "part", "pos", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ends = ends.mapInArrow(chain, "conv string, p long, before long, enter int, leave int, final boolean")
    joined = numbered.drop("matrix").join(ends, numbered["conv_id"].eqNullSafe(ends["conv"]) & (numbered["part"] == ends["p"])).drop("conv", "p")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["conv_id"], held[0]["part"]) != (row["conv_id"], row["part"]):
                    yield _traced(held)
                    held = []
                held.append(row)
        if held:
            yield _traced(held)

    # The join may have been a broadcast, which keeps the order of files: deal the stretches again.
    return joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(finish, ", ".join(f"{k} {v}" for k, v, _ in _RESULT))


def _with_matrix(row: pa.RecordBatch, matrix: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([matrix], pa.list_(pa.int64()))], names=row.schema.names)


_RESULT = (
    ("conv_id", "string", pa.string()), ("turn", "long", pa.int64()), ("pos", "long", pa.int64()), ("role", "string", pa.string()),
    ("action", "string", pa.string()), ("inserted", "string", pa.string()), ("new_role", "string", pa.string()), ("rendered", "string", pa.string()),
)


def _traced(rows: list[dict]) -> pa.RecordBatch:
    roles = [role_state(r["role"]) for r in rows]
    states = [rows[0]["enter"], *trace(roles, rows[0]["enter"], rows[0]["leave"])]
    out = [render(states[i], states[i + 1], roles[i], r["text"], r["final"] and i == len(rows) - 1) for i, r in enumerate(rows)]
    place = [r["before"] + r["pos"] for r in rows]
    values = [[r["conv_id"] for r in rows], [r["turn"] for r in rows], place, [r["role"] for r in rows], [o[0] for o in out], [o[1] for o in out], [ROLES[s - 1] for s in states[1:]], [o[2] for o in out]]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, _, kind) in zip(values, _RESULT)], names=[k for k, _, _ in _RESULT])
