"""Chat formatting by minimum-cost role repair.

Legal conversations start with system or user, go on from system to user, then alternate between user and
assistant, and end with assistant. Repairs keep a turn's role or relabel it, merge a turn into the one before, or
insert empty turns; each turn is a small matrix of costs from automaton state to state, and the cheapest path
through a conversation's matrices is its repair. Matrices multiply (min, +) in any grouping, so a
conversation of any length is cut into segments: one pass makes a matrix a segment, a second chains the
segments of a conversation, and a third works out each segment's own path between its two end states.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant"}
START = 0  # states: the start, then the role of the last turn
RELABEL, UNKNOWN, MERGE, INSERT = 3.0, 1.0, 1.0, 2.0
SEGMENT = 1024
FRESH, MERGED = 0, 1
#: (from state, to role): the ways there as (cost, merged, inserted roles), cheapest first.
WAYS: dict[tuple[int, int], list[tuple[float, int, tuple[int, ...]]]] = {
    (0, 1): [(0.0, FRESH, ())], (0, 2): [(0.0, FRESH, ())], (0, 3): [(INSERT, FRESH, (2,))],
    (1, 1): [(MERGE, MERGED, ())], (1, 2): [(0.0, FRESH, ())], (1, 3): [(INSERT, FRESH, (2,))],
    (2, 2): [(MERGE, MERGED, ()), (INSERT, FRESH, (3,))], (2, 3): [(0.0, FRESH, ())],
    (3, 2): [(0.0, FRESH, ())], (3, 3): [(MERGE, MERGED, ()), (INSERT, FRESH, (2,))],
}
#: What is inserted after the last turn, by its state.
ENDS = {0: (), 1: (2, 3), 2: (3,), 3: ()}
END_COST = np.array([0.0, 2 * INSERT, INSERT, 0.0])


def role_number(role: str | None) -> int:
    """1 to 3 for a known role, 0 for any other."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def turn_matrix(role: int) -> np.ndarray:
    """Costs from the state before a turn to the state after it."""
    m = np.full((4, 4), np.inf)
    for (s, t), ways in WAYS.items():
        m[s, t] = ways[0][0] + (0.0 if role == t else RELABEL if role else UNKNOWN)
    return m


TURNS = [turn_matrix(r) for r in range(4)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product; a may be a vector."""
    return (a[..., :, None] + b).min(-2)


def path(roles: list[int], entry: int, leave: int) -> list[int]:
    """The states after each turn of the cheapest way from entry to leave; of equals the smaller states, from the end."""
    costs = [np.where(np.arange(4) == entry, 0.0, np.inf)]
    for r in roles:
        costs.append(product(costs[-1], TURNS[r]))
    states = [leave]
    for i in range(len(roles) - 1, 0, -1):
        states.append(int((costs[i] + TURNS[roles[i]][:, states[-1]]).argmin()))
    return states[::-1]


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted turns with segment and place; the last row of a segment carries its matrix."""
    task = TaskContext.get().partitionId() << 36
    conv, segment, place, matrix, held = None, task - 1, 0, None, []

    def flush() -> pa.RecordBatch:
        flags = [None] * (len(held) - 1) + [matrix.ravel().tolist()]
        columns = [*zip(*held, strict=True), flags]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if matrix is None or row[0] != conv or place == SEGMENT:
                if held:
                    yield flush()
                conv, segment, place = row[0], segment + 1, 0
            turn = TURNS[role_number(row[2])]
            matrix = turn if place == 0 else product(matrix, turn)
            held.append((*row, segment, place))
            place += 1
    if held:
        yield flush()


def _chains(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, segment, turns, matrix), sorted, to (segment, entry, leave, before, is_last, cost)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out = []
    for _, own in groupby(rows(), key=lambda r: r[0]):
        own = list(own)
        matrices = [np.array(r[3]).reshape(4, 4) for r in own]
        costs = [np.array([0.0, np.inf, np.inf, np.inf])]
        for m in matrices:
            costs.append(product(costs[-1], m))
        total = costs[-1] + END_COST
        state, ends = int(total.argmin()), []
        for i in range(len(own) - 1, -1, -1):
            entry = int((costs[i] + matrices[i][:, state]).argmin())
            ends.append((entry, state))
            state = entry
        before = 0
        for i, (r, (entry, leave)) in enumerate(zip(own, ends[::-1], strict=True)):
            out.append((r[1], entry, leave, before, i == len(own) - 1, float(total.min())))
            before += r[2]
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _opened(role: int, text: str) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n{text}"


CLOSED = "<|im_end|>\n"


def repair(rows: list[tuple], entry: int, leave: int, first: bool, last: bool) -> Iterator[tuple[str, str, int, str]]:
    """(role, action, empty turns inserted before, fragment) for each (role, text) of a segment."""
    roles = [role_number(r) for r, _ in rows]
    state = entry
    for i, (to, (_, text), role) in enumerate(zip(path(roles, entry, leave), rows, roles, strict=True)):
        _, merged, inserted = WAYS[state, to][0]
        text = text or ""
        opening = i == 0 and first
        fragment = "" if merged or opening else CLOSED
        fragment += "".join(_opened(r, "") + CLOSED for r in inserted) + ("\n" + text if merged else _opened(to, text))
        if last and i == len(rows) - 1:
            fragment += CLOSED + "".join(_opened(r, "") + CLOSED for r in ENDS[to])
        action = ("keep" if role == to else "relabel") + ("+merge" if merged else "")
        yield ROLES[to - 1], action, len(inserted), fragment
        state = to


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, place), with the segment's ends, to repaired turns."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, own in groupby(rows(), key=lambda r: r[0]):
        own = list(own)
        _, _, _, _, _, _, entry, leave, before, is_last, cost = own[0]
        done = repair([(r[4], r[5]) for r in own], entry, leave, before == 0, is_last)
        out = [(r[2], r[3], before + r[1], r[4], role, action, inserted, cost, fragment) for r, (role, action, inserted, fragment) in zip(own, done, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, position, role, repaired_role, action, inserted, cost, fragment.

    A conversation's turns are in order of turn (nulls last), role and text; its fragments strung together by position are
    the rendered, legal conversation, and cost is the cost of its repair. action is keep or relabel, with +merge where the
    text goes on in the turn before; inserted counts empty turns put before it. Unknown and null roles are relabelled
    cheaply, null texts are empty, rows that repeat are turns of their own, null conv_ids make one conversation, an empty
    table gives no rows, other columns are not read.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    base = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    segment_schema = pa.schema([*base, ("segment", pa.int64()), ("place", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    cut = materialize(ranged.mapInArrow(lambda it: _segments(it, segment_schema), "conv_id long, turn long, role string, text string, segment long, place long, matrix array<double>"), "chat-segments")

    ends = pa.schema([("segment", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("before", pa.int64()), ("is_last", pa.bool_()), ("cost", pa.float64())])
    chain = cut.where("matrix IS NOT NULL").select("conv_id", "segment", (F.col("place") + 1).alias("turns"), "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chain = materialize(chain.mapInArrow(lambda it: _chains(it, ends), "segment long, entry int, leave int, before long, is_last boolean, cost double"), "chat-chains")

    joined = cut.drop("matrix").join(chain, "segment").select("segment", "place", "conv_id", "turn", "role", "text", "entry", "leave", "before", "is_last", "cost")
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("repaired_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("cost", pa.float64()), ("fragment", pa.string())])
    dealt = joined.repartition("segment").sortWithinPartitions("segment", "place")
    return dealt.mapInArrow(lambda it: _repaired(it, out), "conv_id long, turn long, position long, role string, repaired_role string, action string, inserted int, cost double, fragment string")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))
