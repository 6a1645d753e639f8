"""Minimum-cost repair of the roles of a conversation, and its rendering.

Legal conversations: an optional system turn, then user and assistant turns in alternation with tool turns after assistant
ones, ending with the assistant. Each turn is kept, merged with the turn before it, given another role, or preceded by
inserted empty turns; dynamic programming over the automaton of legal turns finds a repair of least cost.

Turns are dealt to tasks by ranges of (conversation, turn) in their order, and a range is cut into segments of at most ``SEGMENT`` turns
of one conversation, so that a conversation of any length, or a turn number of any number of rows, takes several tasks. A
segment's costs from each state to each state are a small matrix; the matrices of a conversation, in order, give the states between
segments; then each segment is repaired on its own. No task holds more than a segment's turns, or all matrices of a conversation.

The rendered conversation is the pieces of its turns in the order of ``begin``, the place of each in it; so it is defined by rows
without bringing a conversation together, and ``rendered`` does that for those short enough.

Turns are ordered by number (null last), role and a hash of the text. Defined results: a null text counts as empty; a role that isn't
known (or null) has to be relabelled, at a lower cost; rows with null conversation id form one conversation; repeated rows are
turns each; other columns are not looked at; an empty table gives no rows. Control marks within a text are broken up by a blank.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import NULL_ID, bounded_broadcast, cut, key, prepare_workers, task

ROLES = ("system", "user", "assistant", "tool")
#: Of each state (the role of the last turn, or the start) the roles that may follow.
FOLLOWS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
STATES = tuple(FOLLOWS)
FINAL = "assistant"
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 2, 3, 1, 4
SEGMENT = 2000
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_NEVER = 1 << 40


@functools.cache
def inserts(state: str, to: str) -> tuple[str, ...] | None:
    """The fewest empty turns after which a turn of role ``to`` may follow ``state`` (the first in order of roles)."""
    paths, seen = [(state, ())], {state}
    while paths:
        deeper = []
        for at, roles in paths:
            if to in FOLLOWS[at]:
                return roles
            for r in FOLLOWS[at]:
                if r not in seen:
                    seen.add(r)
                    deeper.append((r, (*roles, r)))
        paths = deeper
    return None


@functools.cache
def moves(role: str | None) -> dict[tuple[str, str], tuple[int, str, tuple[str, ...]]]:
    """For a turn of ``role``: (state before, state after) -> (cost, action, empty turns inserted before it)."""
    out: dict[tuple[str, str], tuple[int, str, tuple[str, ...]]] = {}
    for before in STATES:
        for to in ROLES:
            named = 0 if to == role else NAME_UNKNOWN if role not in ROLES else RELABEL
            label = "keep" if to == role else "relabel"
            options = []
            empty = inserts(before, to)
            if empty is not None:
                options.append((named + INSERT * len(empty), label + ("+insert" if empty else ""), empty))
            if before == to:
                options.append((named + MERGE, "merge" if to == role else "relabel+merge", ()))
            if options:
                out[before, to] = min(options, key=lambda o: (o[0], len(o[2]), o[1]))
    return out


def costs(roles: list[str | None]) -> list[list[int]]:
    """Least costs from each state to each state over a segment."""
    rows = []
    for entry in STATES:
        now = {entry: 0}
        for role in roles:
            now = _step(now, role)[0]
        rows.append([min(now.get(s, _NEVER), _NEVER) for s in STATES])
    return rows


def _step(now: dict[str, int], role: str | None) -> tuple[dict[str, int], dict[str, str]]:
    new: dict[str, int] = {}
    back: dict[str, str] = {}
    for (a, b), (cost, _, _) in moves(role).items():
        if a in now and (b not in new or now[a] + cost < new[b]):
            new[b], back[b] = now[a] + cost, a
    return new, back


def repair(roles: list[str | None], entry: str = "start", exit_state: str | None = None) -> list[tuple[str, str, int, tuple[str, ...]]]:
    """For each turn (role, action, cost, empty turns before it); the states at both ends are given, or the last is the one
    from which the conversation ends at least cost."""
    now, backs = {entry: 0}, []
    for role in roles:
        now, back = _step(now, role)
        backs.append(back)
    state = exit_state if exit_state is not None else min(now, key=lambda s: (now[s] + ending(s)[0], STATES.index(s)))
    out = []
    for role, back in zip(reversed(roles), reversed(backs), strict=True):
        before = back[state]
        cost, action, empty = moves(role)[before, state]
        out.append((state, action, cost, empty))
        state = before
    return out[::-1]


def ending(state: str) -> tuple[int, tuple[str, ...]]:
    """Cost and empty turns that bring a conversation in ``state`` to its legal end."""
    if state == FINAL:
        return 0, ()
    empty = (*inserts(state, FINAL), FINAL)
    return INSERT * len(empty), empty


def between(matrices: list[list[list[int]]]) -> list[tuple[str, str]]:
    """(state before, state after) of each segment on a repair of least cost."""
    best, backs = {0: 0}, []
    for m in matrices:
        new: dict[int, tuple[int, int]] = {}
        for a, held in best.items():
            for b, cost in enumerate(m[a]):
                if cost < _NEVER and (b not in new or held + cost < new[b][0]):
                    new[b] = (held + cost, a)
        backs.append({b: a for b, (_, a) in new.items()})
        best = {b: c for b, (c, _) in new.items()}
    state = min(best, key=lambda s: (best[s] + ending(STATES[s])[0], s))
    out = []
    for back in reversed(backs):
        out.append((STATES[back[state]], STATES[state]))
        state = back[state]
    return out[::-1]


def piece(text: str | None, role: str, action: str, empty: tuple[str, ...], first: bool) -> str:
    """What a turn adds to the rendered conversation; the pieces in order, and ``END``, make it up."""
    plain = (text or "").replace("<|im_", "<| im_")
    if "merge" in action:
        return "\n" + plain
    opened = "".join(f"{BEGIN}{r}\n{END}" for r in empty)
    return ("" if first else END) + opened + f"{BEGIN}{role}\n{plain}"


def _cut(segment: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted range with the number of their segment and their place in it."""
    from pyspark import TaskContext

    number, at, conv = (TaskContext.get().partitionId() << 32) - 1, 0, ()
    for batch in batches:
        numbers, places = [], []
        for c in batch.column(0).to_pylist():
            if c != conv or at == segment:
                conv, number, at = c, number + 1, 0
            numbers.append(number)
            places.append(at)
            at += 1
        yield batch.append_column("segment", pa.array(numbers, pa.int64())).append_column("at", pa.array(places, pa.int64()))


def _runs(batches: Iterator[pa.RecordBatch], key: int, *columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows (those columns) of each run of equal values of two columns from ``key`` on."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[key : key + 2] != now:
                if held:
                    yield now, held
                held, now = [], row[key : key + 2]
            held.append(tuple(row[i] for i in columns))
    if held:
        yield now, held


@task
def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, segment), rows in _runs(batches, 0, 2):
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([segment], pa.int64()), pa.array([costs([r[0] for r in rows])], pa.list_(pa.list_(pa.int64())))], names=["conv", "segment", "matrix"])


@task
def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for c, parts in zip(conv, lists, strict=True):
            found = between([p["matrix"] for p in parts])
            rows += [(c, p["segment"], a, b, i == 0, i == len(parts) - 1) for i, (p, (a, b)) in enumerate(zip(parts, found, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv", "segment", "entry", "exit", "opens", "closes"])


_OUT = pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("piece", pa.string()), ("offset", pa.int64()), ("chars", pa.int64())])


@task
def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    for (conv, segment), rows in _runs(batches, 0, *range(2, 11)):
        entry, exit_state, opens, closes = rows[0][5:9]
        fixed = repair([r[2] for r in rows], entry, exit_state)
        offset = 0
        for i, ((at, turn, _, role_in, text, *_), (role, action, cost, empty)) in enumerate(zip(rows, fixed, strict=True)):
            added = piece(text, role, action, empty, opens and i == 0)
            if closes and i == len(rows) - 1:
                more, close = ending(role)
                action, cost = action + ("+close" if close else ""), cost + more
                added += END + "".join(f"{BEGIN}{x}\n{END}" for x in close)
            out.append((conv, segment, at, turn, role_in, role, action, cost, added, offset, len(added)))
            offset += len(added)
            held += len(added)
            if len(out) >= 1000 or held > 1_000_000:
                yield made()
                out.clear()
                held = 0
    if out:
        yield made()


#: Rows that a range of turns has, about.
RANGE_ROWS = 100_000


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, ranges: int | None = None) -> DataFrame:
    """A row per turn: ``conv_id, segment, at`` (its place in the segment), ``turn, role_in`` (as given), ``role, action, cost, piece`` (what
    it adds to the rendered conversation, with empty turns inserted before it and, on the last turn, at the end) and ``begin`` (the
    place of the piece in it, in characters)."""
    prepare_workers(turns.sparkSession)
    given, text = F.col(role_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(key(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.trim(given)).alias("role"), given.alias("role_in"), text.alias("text"))
    if ranges is None:
        ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("row")
    shape = "conv long, turn long, role string, role_in string, text string, segment long, at long"
    dealt = cut(dealt.mapInArrow(lambda it: _cut(segment, it), shape), "turns")
    by = ["conv", "segment"]
    parts = dealt.select(*by, "role", "at").repartition(*by).sortWithinPartitions(*by, "at")
    matrices = parts.mapInArrow(_matrices, "conv long, segment long, matrix array<array<long>>")
    # a small matrix for each segment of a conversation
    listed = matrices.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", "matrix"))).alias("parts"))
    ends = cut(listed.mapInArrow(_ends, "conv long, segment long, entry string, exit string, opens boolean, closes boolean"), "segments")
    both = dealt.join(ends, by).select(*by, "at", "turn", "role", "role_in", "text", "entry", "exit", "opens", "closes")
    both = both.repartition(*by).sortWithinPartitions(*by, "at")
    out = both.mapInArrow(_repaired, "conv long, segment long, at long, turn long, role_in string, role string, action string, cost long, piece string, offset long, chars long")
    out = cut(out, "repaired")
    sizes = out.groupBy(*by).agg(F.sum("chars").alias("n"))
    own = Window.partitionBy("conv").orderBy("segment")
    before = cut(sizes.select(*by, (F.sum("n").over(own) - F.col("n")).alias("base")), "places")
    out = out.join(bounded_broadcast(before), by)
    return out.select(F.when(F.col("conv") != F.lit(NULL_ID), F.col("conv")).alias("conv_id"), "segment", "at", "turn", "role_in", "role", "action", "cost", "piece", (F.col("base") + F.col("offset")).alias("begin"))


def rendered(repaired: DataFrame) -> DataFrame:
    """(conv_id, text) of whole conversations, for those short enough for one row each."""
    pieces = repaired.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "piece"))).alias("p"))
    return pieces.select("conv_id", F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("text"))
