"""Conversation structure repair: the cheapest edits that bring the roles of a conversation into order.

A conversation is read by an automaton of four states (nothing yet, after system, after user, after assistant). Every row is
kept, given the role that fits, or deleted; rows are inserted before it where needed. What a row, or a run of rows, can do is a table: the
least cost from state to state, and in which order the audits of equal cost stand. Tables of consecutive runs join to one.

The edits are found by divide and conquer after Hirschberg: the cost vector from the left and the one from the right meet in the middle,
the crossing state with the least total is taken, and both halves go on alone, so memory is linear in the rows. Audits of two
crossing states never start with one another, as each ends in a row's letter, and equal audits lead to one state: so their order
decides between crossings of equal cost, and the vector from the left carries it along as ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import materialise
from wayfold.llm.manifest import group_key

#: Rows and bytes of text of a chunk of a long conversation, and bytes of chunks that a task sends on at once.
CHUNK_ROWS, CHUNK_BYTES, SENT_BYTES = 1024, 1 << 20, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that an inserted or reroled message leads to, and its role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: From which states a message of this initial may be kept, and the state after it.
KEPT = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
FAR = 1 << 60
_BLANK = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: What a row is to the automaton: an initial (3: none that may be kept), 4 more if truncated; 8 must go; 9 ends the conversation.
GONE, END = 8, 9

Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


def _moves(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and letters of the best way from state to state over one row, insertions before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(p: int, q: int, cost: int, letters: str) -> None:
        best[p, q] = min(best.get((p, q), (FAR, "")), (cost, letters))

    initial, extra = "sua-"[kind % 4], TRUNCATED if 4 <= kind < GONE else 0
    for p in STATES:
        at = p
        for n in range(3):
            cost, letters = n * INSERT, "I" * n
            if kind == END:
                if at in (START, ASSISTANT):
                    offer(p, START, cost, letters)
            else:
                offer(p, at, cost + DELETE, letters + "D")
                if kind != GONE:
                    offer(p, FOLLOWS[at], cost + REROLE + extra, letters + "R")
                    if initial in KEPT and at in KEPT[initial][0]:
                        offer(p, KEPT[initial][1], cost + KEEP + extra, letters + "K")
            at = FOLLOWS[at]
    return best


MOVES = [_moves(kind) for kind in range(END + 1)]


def _table(moves: dict[tuple[int, int], tuple[int, str]]) -> Table:
    costs = tuple(tuple(moves.get((p, q), (FAR, ""))[0] for q in STATES) for p in STATES)
    ranks = []
    for p in STATES:
        order = sorted(moves[p, q][1] for q in STATES if (p, q) in moves)
        ranks.append(tuple(order.index(moves[p, q][1]) if (p, q) in moves else 0 for q in STATES))
    return costs, tuple(ranks)


TABLES = [_table(m) for m in MOVES]


def onward(costs: list[int], ranks: list[int], table: Table) -> tuple[list[int], list[int]]:
    """The cost vector and the order of audits after one more run: among equal costs the least audit so far, then the run's own order."""
    more, order = table
    best: list[tuple[int, int, int]] = []
    for q in STATES:
        best.append(min((costs[p] + more[p][q], ranks[p], order[p][q]) for p in STATES))
    audits = sorted({b[1:] for b in best if b[0] < FAR})
    return [min(b[0], FAR) for b in best], [audits.index(b[1:]) if b[0] < FAR else 0 for b in best]


def back(costs: list[int], table: Table) -> list[int]:
    """The cost vector to the end, one run earlier."""
    return [min(FAR, *(table[0][p][q] + costs[q] for q in STATES)) for p in STATES]


def at_state(state: int) -> tuple[list[int], list[int]]:
    return [0 if p == state else FAR for p in STATES], [0] * 4


def joined(tables: list[Table]) -> Table:
    """The table of consecutive runs as one."""
    costs, ranks = [], []
    for p in STATES:
        cost, rank = at_state(p)
        for table in tables:
            cost, rank = onward(cost, rank, table)
        costs.append(tuple(cost))
        ranks.append(tuple(rank))
    return tuple(costs), tuple(ranks)


def crossings(tables: list[Table], first: int, last: int) -> list[int]:
    """States before, between and after the runs on the way of least cost, and of these with the least audit."""
    states = [first, *[START] * (len(tables) - 1), last]
    halves = [(0, len(tables))]
    while halves:
        low, high = halves.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        costs, ranks = at_state(states[low])
        for i in range(low, middle):
            costs, ranks = onward(costs, ranks, tables[i])
        rest, _ = at_state(states[high])
        for i in range(high - 1, middle - 1, -1):
            rest = back(rest, tables[i])
        states[middle] = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
        halves += [(low, middle), (middle, high)]
    return states


@lru_cache(maxsize=1 << 14)
def _solved(kinds: bytes, first: int, last: int) -> tuple[int, ...]:
    return tuple(crossings([TABLES[k] for k in kinds], first, last))


def solve(kinds: bytes, first: int, last: int) -> tuple[int, ...]:
    """Crossing states of a run of rows; those of short runs are remembered."""
    return _solved(kinds, first, last) if len(kinds) <= 32 else tuple(crossings([TABLES[k] for k in kinds], first, last))


def fault(role: str, text: str, again: bool) -> str:
    body = text.rstrip(_BLANK)
    if not body:
        return "blank"
    if again:
        return "duplicate"
    return "" if body[-1] in ".!?" else "truncated"


def kind_of(role: str, trouble: str) -> int:
    if trouble in ("blank", "duplicate"):
        return GONE
    return "sua".find(role[:1] or "-") % 4 + (4 if trouble == "truncated" else 0)


def faults(roles: list[str], texts: list[str], first: set[int] | None) -> list[str]:
    """First fault of each row; `first`: places of the rows whose role and text were not seen before (None: look here)."""
    if first is None:
        seen: set[tuple[str, str]] = set()
        first = set()
        for i, message in enumerate(zip(roles, texts)):
            if message not in seen:
                seen.add(message)
                first.add(i)
    return [fault(role, text, i not in first) for i, (role, text) in enumerate(zip(roles, texts))]


def edited(kinds: bytes, states: tuple[int, ...], roles: list[str], texts: list[str]) -> tuple[int, str, list[dict[str, str]]]:
    """Cost, audit and messages of a run whose crossing states are known; a closing END has no message of its own."""
    cost, audit, out = 0, [], []
    for i, kind in enumerate(kinds):
        at = states[i]
        price, letters = MOVES[kind][at, states[i + 1]]
        cost += price
        audit.append(letters)
        for letter in letters:
            if letter in "IR":
                at = FOLLOWS[at]
                out.append({"role": ROLES[at], "text": "" if letter == "I" else texts[i]})
            elif letter == "K":
                out.append({"role": roles[i], "text": texts[i]})
    return cost, "".join(audit), out


MESSAGE = "struct<role: string, text: string>"
#: A repaired chunk: what was found, the edits, and what its neighbours need to know of its ends.
FOUND = (
    f"grp string, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<{MESSAGE}>, "
    "turns long, low long, high long, first string, last string"
)
_FOUND_NAMES = (
    "grp", "part", "seq", "whole", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "turns", "low", "high", "first", "last",
)
_COUNTED = ("blank", "duplicate", "truncated", "illegal", "cost")
_REPORT_NAMES = ("gaps", *_COUNTED, "audit", "repaired_sha256")
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def chunks(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None, chunk_rows: int) -> DataFrame:
    """`(grp, conv_id, part, seq, whole, turns, roles, texts)`: conversations in order, in chunks of bounded size. Rows are dealt by
    ranges of (conversation, turn), so a conversation of any length is spread over tasks; a task streams its sorted rows. `whole`:
    the chunk is all of its conversation, known where neither another chunk nor another task may hold a part of it."""
    copies = F.col(copies_col).cast("int") if copies_col else F.lit(1)
    kind = rows.schema[conv_col].dataType
    own = rows.select(
        group_key(F.col(conv_col)).alias("grp"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), copies.alias("copies"),
    ).withColumns({"tie": F.md5("text"), "read": F.monotonically_increasing_id()})
    keys = ["grp", "turn", "role", "tie", "read"]
    placed = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie", "read")
    schema = T.StructType.fromDDL("grp string, part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>")
    schema = T.StructType([schema[0], T.StructField("conv_id", kind), *schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, opened, weight = TaskContext.get().partitionId(), 0, False, 0
        grp = conv = None
        turns, roles, texts = [], [], []
        ready: list[list] = [[] for _ in range(8)]
        types = [pa.string(), conv_type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

        def close(whole: bool) -> None:
            for column, value in zip(ready, (grp, conv, part, seq, whole, turns, roles, texts)):
                column.append(value)

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ready, types)], schema.names)
            for column in ready:
                column.clear()
            return out

        edge, size = True, 0  # the first conversation of a task may have begun in another one
        for batch in batches:
            for g, c, turn, role, text, n in zip(*(batch.column(x).to_pylist() for x in ("grp", "conv_id", "turn", "role", "text", "copies"))):
                if opened and (g != grp or len(turns) >= chunk_rows or weight >= CHUNK_BYTES):
                    more = g == grp
                    close(not (edge or more))
                    edge, seq, size, weight = more, seq + 1, size + weight, 0
                    turns, roles, texts = [], [], []
                    if size >= SENT_BYTES or len(ready[0]) >= 4096:
                        yield sent()
                        size = 0
                opened, grp, conv = True, g, c
                for _ in range(n):
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    weight += len(text) + 16
        if opened:
            close(False)  # and its last one may go on in another
            yield sent()

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(kind)
    return materialise(placed.mapInArrow(run, schema))


def _reported(batch: pa.RecordBatch, spans: list[tuple[int, int] | None], firsts: list[set[int] | None], ends: list[bool]) -> pa.RecordBatch:
    """Repairs the chunks of a batch between the given states; `ends`: the conversation ends with the chunk."""
    out: list[list] = [[] for _ in range(16)]
    columns = (batch.column(c).to_pylist() for c in ("grp", "part", "seq", "whole", "turns", "roles", "texts"))
    for i, (grp, part, seq, whole, turns, roles, texts) in enumerate(zip(*columns)):
        trouble = faults(roles, texts, firsts[i])
        kinds = bytes(map(kind_of, roles, trouble)) + (bytes([END]) if ends[i] else b"")
        cost, audit, repaired = edited(kinds, solve(kinds, *spans[i]) if kinds else (), roles, texts)
        initials = [r[:1] for r in roles]
        known = [t for t in turns if t is not None]
        row = (
            grp, part, seq, whole, *(trouble.count(t) for t in ("blank", "duplicate", "truncated")),
            sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), cost, audit, repaired, len(set(known)),
            min(known, default=None), max(known, default=None), initials[0] if roles else None, initials[-1] if roles else None,
        )
        for column, value in zip(out, row):
            column.append(value)
    long, text = pa.int64(), pa.string()
    types = [text, pa.int32(), pa.int32(), pa.bool_(), long, long, long, long, long, text, _MESSAGES, long, long, long, text, text]
    arrays = [batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(out, types)]]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", *_FOUND_NAMES])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n = part.num_rows
            yield _reported(part, [(START, START)] * n, [None] * n, [True] * n)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of each chunk: `(grp, part, seq, costs, ranks)`, 16 numbers each."""
    for batch in batches:
        costs, ranks = [], []
        for roles, texts, first in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "firsts"))):
            trouble = faults(roles, texts, set(first or ()))
            cost, rank = joined([TABLES[k] for k in map(kind_of, roles, trouble)])
            costs.append([x for row in cost for x in row])
            ranks.append([x for row in rank for x in row])
        columns = [*(batch.column(c) for c in ("grp", "part", "seq")), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["grp", "part", "seq", "costs", "ranks"])


def _states(group: pd.DataFrame) -> pd.DataFrame:
    """States before and after each chunk of one conversation, from one small table per chunk."""
    group = group.sort_values(["part", "seq"], ignore_index=True)
    square = lambda flat: tuple(tuple(int(x) for x in flat[i: i + 4]) for i in range(0, 16, 4))
    tables = [(square(c), square(r)) for c, r in zip(group["costs"], group["ranks"])]
    states = crossings([*tables, TABLES[END]], START, START)
    return group[["grp", "part", "seq"]].assign(before=states[:-2], after=states[1:-1], ends=group.index == len(group) - 1)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            before, after, ends = (part.column(c)[0].as_py() for c in ("before", "after", "ends"))
            yield _reported(part, [(before, START if ends else after)], [set(part.column("firsts")[0].as_py() or ())], [ends])


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Repaired chunks of conversations, written: `(conv_id, grp, part, seq, whole, blank, duplicate, truncated, illegal, cost, audit,
    repaired array<struct<role, text>>, turns, low, high, first, last)`, in the order of `part`, `seq` within `grp`. Nearly all
    conversations are one chunk (`whole`); a longer one is cut, and its chunks are repaired apart once the states between them are
    known from their tables. `messages` has the repaired rows, `report` one row per conversation.

    Rows of a conversation are taken by turn, nulls first; those of one turn by role and then the MD5 of the text. Null roles
    and texts are one space. A row with a blank text or with the role and text of an earlier one must be deleted; a kept row whose text
    does not end in `.`, `!` or `?` costs extra. Roles that begin neither with s, u nor a cannot be kept, empty ones
    neither. Rows without a conversation are one conversation. `copies_col`: how often a row stands there; 0 only names its conversation.
    Repeated rows are duplicates. Extra columns are ignored; an empty table has no conversations."""
    cut = chunks(rows, conv_col, turn_col, role_col, text_col, copies_col, chunk_rows)
    schema = T.StructType([cut.schema["conv_id"], *T.StructType.fromDDL(FOUND).fields])
    done = cut.where("whole").mapInArrow(_whole, schema)
    open_ = cut.where("not whole")
    messages = open_.select("grp", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m"))
    key = F.sha2(F.concat_ws(":", F.length("m.roles").cast("string"), "m.roles", "m.texts"), 256)
    first = messages.groupBy("grp", key.alias("key")).agg(F.min(F.struct("part", "seq", "place")).alias("at"))
    firsts = first.groupBy("grp", "at.part", "at.seq").agg(F.collect_list("at.place").alias("firsts"))  # at most a chunk's rows
    held = materialise(open_.join(firsts, ["grp", "part", "seq"], "left"))
    tables = held.select("grp", "part", "seq", "roles", "texts", "firsts").mapInArrow(_summary, "grp string, part int, seq int, costs array<long>, ranks array<long>")
    states = tables.groupBy("grp").applyInPandas(_states, "grp string, part int, seq int, before int, after int, ends boolean")
    rest = held.join(states, ["grp", "part", "seq"]).mapInArrow(_between, schema)
    return materialise(done.unionByName(rest))


def messages(repaired: DataFrame) -> DataFrame:
    """`(conv_id, part, seq, place, role, text)`: the repaired rows; part, seq and place give their order."""
    return repaired.select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "m")).select("conv_id", "part", "seq", "place", "m.role", "m.text")


def report(repaired: DataFrame) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` per conversation. Digests of cut
    conversations are made by streaming their chunks in order, so no conversation is held at once; their audit, as
    long as the conversation, is the one exception."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("grp", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "turns", "low", "high", "first", "last")
        state: dict | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                convs, ready = [], []
                for conv, row in zip(piece.column("conv_id"), zip(*(piece.column(c).to_pylist() for c in names))):
                    chunk = dict(zip(names, row))
                    if state is None or chunk["grp"] != state["grp"]:
                        if state is not None:
                            convs.append(state["conv"])
                            ready.append(_closed(state))
                        state = _opened(chunk["grp"], conv)
                    _added(state, chunk)
                if ready:
                    yield _rows_of(convs, ready, conv_type)
        if state is not None:
            yield _rows_of([state["conv"]], [_closed(state)], conv_type)

    from pyspark.sql.pandas.types import to_arrow_type

    conv = repaired.schema["conv_id"]
    conv_type = to_arrow_type(conv.dataType)
    schema = T.StructType([conv, *T.StructType.fromDDL(", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in _REPORT_NAMES)).fields])
    cut = repaired.where("not whole").repartition("grp").sortWithinPartitions("grp", "part", "seq")
    return repaired.where("whole").mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))


def _opened(grp: str, conv: pa.Scalar) -> dict:
    return {"grp": grp, "conv": conv, "audit": [], "sha": hashlib.sha256(), "begun": False, "last": None, "turns": 0, "low": None, "high": None} | dict.fromkeys(_COUNTED, 0)


def _added(state: dict, chunk: dict) -> None:
    """The next chunk of a conversation. Its rows follow by turn, so only its first turn can have occurred before."""
    for name in _COUNTED:
        state[name] += chunk[name]
    state["audit"].append(chunk["audit"])
    if chunk["first"] is not None:
        state["illegal"] += state["last"] is not None and state["last"] + chunk["first"] not in _LEGAL
        state["last"] = chunk["last"]
    if chunk["low"] is not None:
        state["turns"] += chunk["turns"] - (state["high"] == chunk["low"])
        state["low"] = chunk["low"] if state["low"] is None else state["low"]
        state["high"] = chunk["high"]
    for message in chunk["repaired"]:
        state["sha"].update(f"{'\n' if state['begun'] else ''}{message['role']}:{message['text']}".encode())
        state["begun"] = True


def _closed(state: dict) -> tuple:
    gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
    return (gaps, *(state[c] for c in _COUNTED), "".join(state["audit"]), state["sha"].hexdigest())


def _rows_of(convs: list[pa.Scalar], rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([c.as_py() for c in convs], conv_type), *(pa.array(c) for c in zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *_REPORT_NAMES])
