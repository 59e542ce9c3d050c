"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by one or more (user, assistant) pairs.
Each turn of the input is kept, relabelled, or merged into the turn before it, and empty turns are
inserted where the automaton asks for them; dynamic programming over the automaton's four states
finds the cheapest repair. The repaired turns are rendered one by one.

A turn's effect on the state costs is a 4 x 4 matrix in (min, +) algebra, so a conversation that
spans several Spark partitions is solved in two passes, like a prefix sum: the rows are dealt by
range of (conversation, turn), each partition reports the product of its first and last
conversation's matrices (two rows a partition, whatever the data), and each then repairs its own
stretch between the states that the combination fixes. No conversation has to fit in one task.

Between equally cheap repairs, that one wins whose last turn has the role that comes first in the
order system, user, assistant; among these the one whose last turn but one has; and so on. For that
the matrices also carry, for every last state, the order of the first states by their best runs in
that sense, so the repair is one and the same however the rows are partitioned.

Defined results: a null text counts as empty; a null or unknown role can become any role at a lower
cost; null turn numbers come first; turns of equal number are ordered by role, then text, and stay
separate turns; rows that repeat all four are turns each and may lie in different partitions; rows
with a null conversation id form one conversation, apart from that of a text "None"; texts of any
length are read whole; control tokens in a text are escaped by a backslash, so that no text opens or
closes a turn; an empty table gives no rows. Ids and turns may have any type that sorts. Other
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.llm.common import narrow
from sievewright.session import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0  #: role code of a null or unknown role; the others have their state's number
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns to insert between a state and a label that should come next."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state, nexts in FOLLOWS.items():
        for label in nexts:
            found[state, label] = ()
    for state in FOLLOWS:
        for middle in FOLLOWS[state]:
            for label in FOLLOWS[middle]:
                found.setdefault((state, label), (middle,))
    return found


BRIDGES = _bridges()


def steps(role: int) -> list[tuple[float, int, int, str, tuple[int, ...]]]:
    """All ways to take one turn: (cost, state before, label and state after, action, inserted)."""
    found = []
    for label in (SYSTEM, USER, ASSISTANT):
        price = 0.0 if role == label else RELABEL_UNKNOWN if role == UNKNOWN else RELABEL
        action = "keep" if role == label else "relabel"
        for state in range(4):
            if (state, label) in BRIDGES:
                between = BRIDGES[state, label]
                found.append((price + INSERT * len(between), state, label, action, between))
            if state == label:
                found.append((price + MERGE, state, label, "merge" if action == "keep" else "relabel_merge", ()))
    return found


def _tables() -> tuple[np.ndarray, dict[tuple[int, int, int], tuple[str, tuple[int, ...]]]]:
    costs, how = np.full((4, 4, 4), np.inf), {}
    for role in range(4):
        for cost, before, after, action, between in steps(role):
            if cost < costs[role, before, after]:
                costs[role, before, after] = cost
                how[role, before, after] = action, between
    return costs, how


COSTS, HOW = _tables()
#: What closing a conversation in a state costs: a user turn needs an empty answer.
CLOSING = np.array([0.0, 2 * INSERT, INSERT, 0.0])
_ENDS: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def order_of(keys: np.ndarray) -> np.ndarray:
    """Places of the entries of each column, from 0."""
    return keys.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")


Stretch = tuple[np.ndarray, np.ndarray]  #: costs, and for each last state the order of first states


def product(roles: list[int]) -> Stretch:
    """(min, +) product of the turns' matrices: cheapest cost from any state to any other."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    order = np.tile(np.arange(4)[:, None], (1, 4))
    for role in roles:
        options = total[:, :, None] + COSTS[role][None, :, :]
        via = options.argmin(axis=1)  # of equal costs, the least state before the turn
        total = options.min(axis=1)
        order = order_of(4 * via + order[np.arange(4)[:, None], via])
    return total, order


def entry(costs: np.ndarray, stretch: Stretch, last: int) -> int:
    """The state before a stretch on the best run to its last state."""
    total = costs + stretch[0][:, last]
    best = np.flatnonzero(total == total.min())
    return int(best[stretch[1][best, last].argmin()])


def repair(roles: list[int], enter: np.ndarray, leave: int | None) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], float, int]:
    """The cheapest run through ``roles`` from the state costs ``enter``: for each turn (state
    before, label, action, inserted before it), its cost, and the last state. ``leave`` fixes that
    state; None closes the conversation."""
    costs, back = enter.astype(float), []
    for role in roles:
        options = costs[:, None] + COSTS[role]
        back.append(options.argmin(axis=0))
        costs = options.min(axis=0)
    last = int((costs + CLOSING).argmin()) if leave is None else leave
    total, state, path = float(costs[last]), last, []
    for role, came in zip(reversed(roles), reversed(back)):
        before = int(came[state])
        action, between = HOW[role, before, state]
        path.append((before, state, action, between))
        state = before
    return path[::-1], total, last


_CONTROL = re.compile(r"<(\\*\|im_(?:start|end)\|>)")


def escaped(text: str | None) -> str:
    """The text with a backslash (one more, where there are some) in each control token."""
    return _CONTROL.sub(r"<\\\1", text or "")


def _render(role: int, text: str | None, opens: bool) -> str:
    return (f"<|im_end|>\n<|im_start|>{ROLES[role - 1]}\n" if opens else "\n") + escaped(text)


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN is a name too


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows with one conversation id, in order."""
    name, rows, begun = None, [], False
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
            if begun and not _same(conv, name):
                yield name, rows
                rows = []
            name, begun = conv, True
            rows.append((turn, role, text))
    if begun:
        yield name, rows


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per turn of the repaired conversations, in pieces that follow each other by (conv_id,
    part, pos): turn (null for inserted turns), role, action, new_role, and fragment, its rendering.
    Joined in order, a conversation's fragments are its rendered form."""
    given = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    code = F.lit(UNKNOWN)
    for k, role in enumerate(ROLES, 1):
        code = F.when(F.lower("role") == role, k).otherwise(code)
    # Rows that repeat all else differ in their salt, so that they need not lie in one partition.
    dealt = given.select("conv_id", "turn", code.alias("code"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("salt")).repartitionByRange(*([partitions] if partitions else []), "conv_id", "turn", "code", "text", "salt")
    dealt = cut(dealt.sortWithinPartitions("conv_id", "turn", "code", "text", "salt").drop("salt"))
    conv_kind, turn_kind = (dealt.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    types = [to_arrow_type(dealt.schema[c].dataType) for c in ("conv_id", "turn")]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n = None, None, 0
        for name, rows in _runs(batches):
            last = (name, [r[1] for r in rows])
            first = first or last
            n += 1
        if first is not None:
            ends = [(first, 0)] if n == 1 else [(first, 0), (last, 1)]
            products = [product(e[1]) for e, _ in ends]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()] * len(ends), pa.int32()), "side": pa.array([s for _, s in ends], pa.int32()),
                "conv_id": pa.array([e[0] for e, _ in ends], types[0]), "m": pa.array([m.ravel().tolist() for m, _ in products], pa.list_(pa.float64())), "o": pa.array([o.ravel().tolist() for _, o in products], pa.list_(pa.int64())), "only": pa.array([n == 1] * len(ends), pa.bool_()),
            })

    found = dealt.mapInArrow(edges, f"part int, side int, conv_id {conv_kind}, m array<double>, o array<long>, only boolean").orderBy("part", "side").collect()
    plan = turns.sparkSession.sparkContext.broadcast(_plan([(r["part"], r["side"], r["conv_id"], (np.array(r["m"]).reshape(4, 4), np.array(r["o"]).reshape(4, 4)), r["only"]) for r in found]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fixed = plan.value.get(part, {})
        fresh = np.array([0.0, np.inf, np.inf, np.inf])
        out: list[tuple] = []
        before = None
        for k, (name, rows) in enumerate(_runs(batches)):
            if before is not None:
                out += _written(part, before, fresh if before[2] else None, fixed, last=False)
            before = (name, rows, k > 0)
            if len(out) > 20_000:
                yield _batch(out, *types)
                out = []
        if before is not None:
            out += _written(part, before, fresh if before[2] else None, fixed, last=True)
        if out:
            yield _batch(out, *types)

    schema = f"conv_id {conv_kind}, part int, pos long, turn {turn_kind}, role string, action string, new_role string, fragment string"
    return dealt.mapInArrow(solve, schema)


def _plan(found: list[tuple[int, int, object, Stretch, bool]]) -> dict[int, dict[str, tuple[np.ndarray, int | None]]]:
    """For the first and last conversation of each partition: entry costs and exit state (None: the
    conversation ends there), from the products of the stretches that one conversation has."""
    out: dict[int, dict[str, tuple[np.ndarray, int | None]]] = {}
    chain: list[tuple[int, int, Stretch]] = []
    fresh = np.array([0.0, np.inf, np.inf, np.inf])

    def close() -> None:
        entries, costs = [], fresh
        for _, _, m in chain:
            entries.append(costs)
            costs = (costs[:, None] + m[0]).min(axis=0)
        leave = None
        for (part, side, m), enter in zip(reversed(chain), reversed(entries)):
            state = int((costs + CLOSING).argmin()) if leave is None else leave
            came = entry(enter, m, state)
            fixed = np.full(4, np.inf)
            fixed[came] = 0.0
            out.setdefault(part, {})["first" if side == 0 else "last"] = fixed, (None if leave is None else leave)
            leave = came

    name = None
    for part, side, conv, m, _ in found:
        if chain and not _same(conv, name):
            close()
            chain = []
        name = conv
        chain.append((part, side, m))
    if chain:
        close()
    return out


def _written(part: int, run: tuple, fresh: np.ndarray | None, fixed: dict, last: bool) -> list[tuple]:
    name, rows, later = run
    enter, leave = fixed.get("first", (fresh, None)) if not later else fixed.get("last", (fresh, None)) if last else (fresh, None)
    path, _, end = repair([r[1] for r in rows], enter, leave)
    out, pos = [], 0
    opened = path[0][0] != START
    for (turn, role, text), (before, label, action, between) in zip(rows, path):
        for new in between:
            out.append((name, part, pos, None, None, "insert", ROLES[new - 1], _render(new, "", True) if opened else _render(new, "", True)[len("<|im_end|>\n"):]))
            opened, pos = True, pos + 1
        piece = _render(label, text, not action.endswith("merge"))
        out.append((name, part, pos, turn, ROLES[role - 1] if role else None, action, ROLES[label - 1], piece if opened or action.endswith("merge") else piece[len("<|im_end|>\n"):]))
        opened, pos = True, pos + 1
    if leave is None:
        for new in _ENDS[end]:
            out.append((name, part, pos, None, None, "insert", ROLES[new - 1], _render(new, "", True)))
            pos += 1
        out[-1] = (*out[-1][:-1], out[-1][-1] + "<|im_end|>\n")
    return out


def _batch(rows: list[tuple], conv_type: pa.DataType, turn_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, pa.int32(), pa.int64(), turn_type, *[pa.string()] * 4]
    names = ["conv_id", "part", "pos", "turn", "role", "action", "new_role", "fragment"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
