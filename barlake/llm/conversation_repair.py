"""Repair of conversations by iterative-deepening A* over edits.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Edits in ASCII order: D drops
a row (4, required for blank and duplicate rows), I inserts an empty row of user or assistant (3),
K keeps a row, R gives it the role user or assistant (3); a truncated row that stays costs 3 more. The
cheapest edits are taken, of equally cheap ones the least in ASCII.

Search. States are the rows used so far and the roles' automaton (nothing yet, after s, after u,
after a). Depth first in ASCII order under a bound on the cost; the bound is raised to the least cost
that it cut off, until a path is accepted, which then is the cheapest and the least. Estimates come
from an automaton that takes s and a for one state; a state that failed keeps what it learned, the
least cost beyond its bound, so it is only entered again with more to spend.

Long conversations. Rows without their texts are sorted over all tasks by conversation and place and
cut into segments of at most SEGMENT rows. A segment that is a whole conversation, away from the ends
of its task, is searched at once. Every other one gives the cost of its cheapest path between each
two states, with the rank of the path among equally cheap ones; the chain of a conversation's
segments takes the best states between them (about 200 bytes for SEGMENT rows), and the segments are
searched again between those. Inserted rows belong to the segment of the row they precede. At last
texts and edits meet sorted by conversation, in a stream that holds one segment's edits.

Rows. A null role, text, conversation or turn reads as one space where text is needed; a null
conversation is one of its own. Rows are ordered by turn (nulls first), role, the first 64 characters
of the text and a SHA-256 of both; rows equal in all are repeats, the later ones duplicates. Roles are
compared by their first 32 characters first, for order only. Other columns are left out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import cut, shuffle_parts

#: Rows of a segment at most.
SEGMENT = 4_096
#: Searched patterns that a task remembers, by all their rows; when full it starts anew.
REMEMBERED_ROWS = 1 << 20
# Fixed values of the task: white space, ends of sentences, costs.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,), "s": (NOTHING,)}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FINAL = (NOTHING, ASSISTANT)
NEVER = 1 << 60
#: A row as one byte: "-" must go; s, u, a, x (another role), in capitals if truncated.
GONE = "-"


def _moves() -> dict[str, list[tuple]]:
    """Per kind of row and state: (edit, cost, next state, rows used), in ASCII order of the edits."""
    inserts = {s: [("I", INSERT, STATE[r], 0) for r in "ua" if s in AFTER[r]] for s in range(4)}
    moves = {GONE: [[("D", DELETE, s, 1), *inserts[s]] for s in range(4)], "": [inserts[s] for s in range(4)]}
    for kind in "suaxSUAX":
        role, stays = kind.lower(), TRUNCATED if kind.isupper() else 0
        moves[kind] = []
        for s in range(4):
            own = [("D", DELETE, s, 1), *inserts[s]]
            if role in AFTER and s in AFTER[role]:
                own.append(("K", stays, STATE[role], 1))
            own += [("R", REROLE + stays, STATE[r], 1) for r in "ua" if s in AFTER[r] and r != role]
            moves[kind].append(own)
    return moves


MOVES = _moves()


def _estimates(kinds: str, accepted: tuple[int, ...], open_end: bool) -> list[int]:
    """A lower bound of the cost from each (row, state), by the automaton in which s and a are one state."""
    merged = {NOTHING: 0, SYSTEM: 1, ASSISTANT: 1, USER: 2}
    value = [NEVER] * 3
    for s in accepted:
        value[merged[s]] = 0
    members = [(NOTHING,), (SYSTEM, ASSISTANT), (USER,)]

    def with_inserts(value: list[int]) -> list[int]:
        after_u = min(value[2], INSERT + value[1])
        after_a = min(value[1], INSERT + after_u)
        return [min(value[0], INSERT + after_u), after_a, after_u]

    value = with_inserts(value) if open_end else value
    found = [value]
    for kind in reversed(kinds):
        value = with_inserts([min((cost + value[merged[t]] for s in own for _, cost, t, used in MOVES[kind][s] if used),
                                  default=NEVER) for own in members])
        found.append(value)
    return [v[merged[s]] for v in reversed(found) for s in range(4)]


def search(kinds: str, start: int = NOTHING, accepted: tuple[int, ...] = FINAL, open_end: bool = True) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest path from `start` over all rows to an accepted state, the least
    in ASCII of equally cheap ones; None if there is none. Without `open_end` it ends with a row."""
    n, least = len(kinds), _estimates(kinds, accepted, open_end)
    # one kept row and inserts lead to any state that can be reached, whatever else is dropped
    most = DELETE * n + 3 * INSERT + TRUNCATED
    while least[start] <= most:
        bound, path = least[start], []
        stack = [[0, start, bound, 0, NEVER]]  # row, state, left to spend, next move, least cost cut off
        while stack:
            frame = stack[-1]
            row, state, left, turn, _ = frame
            if row == n and state in accepted:
                return bound - left, "".join(path)
            moves = MOVES[kinds[row]][state] if row < n else MOVES[""][state] if open_end else []
            if turn < len(moves):
                edit, cost, after, used = moves[turn]
                frame[3] += 1
                need = cost + least[4 * (row + used) + after]
                if need > left:
                    frame[4] = min(frame[4], need)
                else:
                    path.append(edit)
                    stack.append([row + used, after, left - cost, 0, NEVER])
                continue
            least[4 * row + state] = max(least[4 * row + state], frame[4])  # it failed with `left`
            stack.pop()
            if stack:
                path.pop()
                above = stack[-1]
                edit, cost, after, used = (MOVES[kinds[above[0]]] if above[0] < n else MOVES[""])[above[1]][above[3] - 1]
                above[4] = min(above[4], cost + least[4 * (above[0] + used) + after])
    return None


class Remembered:
    """Results of searches, for patterns that come again."""

    def __init__(self):
        self.known, self.rows = OrderedDict(), 0

    def __call__(self, kinds: str, *rest) -> tuple[int, str] | None:
        key = (kinds, *rest)
        if key not in self.known:
            if self.rows > REMEMBERED_ROWS:
                self.known, self.rows = OrderedDict(), 0
            self.known[key], self.rows = search(kinds, *rest), self.rows + len(kinds) + 8
        return self.known[key]


# ---------------------------------------------------------------- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the planned damage; a dropped row stays as one without role."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(harm == 0, None).when(harm == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(harm == 0, None).when(harm == 1, "").when(harm == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the columns of their order, which `_ORDER` names."""
    both = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"had_turn": F.col("turn").isNotNull(), "role_start": F.left("role", F.lit(32)),
                             "text_start": F.left("text", F.lit(64)), "digest": F.unhex(F.sha2(both.cast("binary"), 256))})


_ORDER = ["had_turn", "turn", "role_start", "text_start", "digest"]


def _kind() -> Column:
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return (F.when(F.col("role").isNull(), "").when(core == "", GONE)
            .when(F.right(core, F.lit(1)).isin(list(ENDS)), kind).otherwise(F.upper(kind)))


def _kinds(rows: DataFrame) -> DataFrame:
    """One row for equal rows: conv_id, order, kind, how many, and whether an earlier turn has the same.

    Kind is "" for a conversation's dropped rows, which only say that there is a conversation.
    """
    slim = (_placed(rows).select("conv_id", *_ORDER, _kind().alias("kind"))
            .groupBy("conv_id", "digest", "had_turn", "turn")
            .agg(F.count("*").alias("copies"), F.first("kind").alias("kind"), F.first("role_start").alias("role_start"),
                 F.first("text_start").alias("text_start")))
    first = slim.where("kind != ''").groupBy("conv_id", "digest").agg(F.min(F.struct("had_turn", "turn")).alias("first"))
    same = F.col("slim.conv_id").eqNullSafe(F.col("first.conv_id")) & F.col("slim.digest").eqNullSafe(F.col("first.digest"))
    own = F.struct(F.col("slim.had_turn").alias("had_turn"), F.col("slim.turn").alias("turn"))
    return slim.alias("slim").join(first.alias("first"), same, "left").select(
        "slim.*", (~own.eqNullSafe(F.col("first.first"))).alias("again"))


SEGMENTS = ("conv_id long, had_turn boolean, turn long, role_start string, text_start string, digest binary, seq int, "
            "kinds string, cuts boolean, edits string, costs array<long>, ranks array<int>")
_LINKED = ["conv_id", "had_turn", "turn", "role_start", "text_start", "digest", "seq"]


def _paths(kinds: str, find) -> tuple[list[int], list[int]]:
    """Cost of the cheapest path between each two states, and its rank among the paths from one state."""
    costs, ranks = [], []
    for start in range(4):
        found = [find(kinds, start, (end,), False) for end in range(4)]
        order = sorted(p[1] for p in found if p)
        costs += [p[0] if p else NEVER for p in found]
        ranks += [order.index(p[1]) if p else 0 for p in found]
    return costs, ranks


def _segments(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, done, state = Remembered(), [], {"conv": None, "first": True, "begun": False}
        kinds, head, seq = [], None, 0

        def emit(whole: bool) -> None:
            nonlocal kinds, head, seq
            text = "".join(kinds)
            row = dict(zip(_LINKED, (*head, seq)), kinds=text, cuts=not whole, edits=None, costs=None, ranks=None)
            if whole:
                row["edits"] = find(text)[1]
            else:
                row["costs"], row["ranks"] = _paths(text, find)
            done.append(row)
            kinds, head, seq = [], None, seq + 1

        schema = _arrow_schema(SEGMENTS)
        for batch in batches:
            for conv, had, turn, role, text, digest, kind, copies, again in zip(*(
                    batch.column(c).to_pylist() for c in (*_LINKED[:-1], "kind", "copies", "again"))):
                if not state["begun"] or conv != state["conv"]:
                    if state["begun"]:
                        emit(not state["first"] and seq == 0)
                        state["first"] = False
                    state["conv"], state["begun"], seq = conv, True, 0
                if head is None:
                    head = (conv, had, turn, role, text, digest)
                for k in range(copies if kind else 0):
                    if len(kinds) == size:
                        emit(False)
                        head = (conv, had, turn, role, text, digest)
                    kinds.append(GONE if again or k else kind)
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if state["begun"]:  # the last conversation may go on in the next task
            emit(False)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    return task


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


CHAINED = "conv_id long, had_turn boolean, turn long, role_start string, text_start string, digest binary, seq int, start int, end int"


def _chain(table: pa.Table) -> pa.Table:
    """The states before and after each segment of one conversation; `end` null for the last."""
    rows = table.to_pylist()
    rows.sort(key=lambda r: [(v is not None, v) for v in (r[c] for c in _LINKED)])
    costs = [r["costs"] for r in rows]
    ahead = [[0 if s in FINAL else INSERT if s == USER else 2 * INSERT for s in range(4)]]  # rows inserted at the end
    for cost in reversed(costs):
        ahead.append([min(cost[4 * s + t] + ahead[-1][t] for t in range(4)) for s in range(4)])
    ahead.reverse()
    state, found = NOTHING, []
    for k, (row, cost) in enumerate(zip(rows, costs)):
        best = min((cost[4 * state + t] + ahead[k + 1][t], row["ranks"][4 * state + t], t) for t in range(4))
        last = k + 1 == len(rows)
        found.append({**{c: row[c] for c in _LINKED}, "start": state, "end": None if last else best[2]})
        state = best[2]
    return pa.Table.from_pylist(found, _arrow_schema(CHAINED))


EDITED = "conv_id long, had_turn boolean, turn long, role_start string, text_start string, digest binary, seq int, kinds string, start int, edits string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, schema = Remembered(), _arrow_schema(EDITED)
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            end = row.pop("end")
            row["edits"] = (find(row["kinds"], row["start"]) if end is None else find(row["kinds"], row["start"], (end,), False))[1]
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in rows], schema)


def _all_edits(rows: DataFrame, segment: int) -> DataFrame:
    """The edits of every segment, by the place of its first row."""
    sort = [F.col(c).asc_nulls_first() for c in _LINKED[:-1]]
    parts = shuffle_parts(rows.sparkSession)
    sorted_rows = _kinds(rows).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    found = cut(sorted_rows.select(*_LINKED[:-1], "kind", "copies", "again").mapInArrow(_segments(segment), SEGMENTS))
    parts_of = found.where("cuts").select(*_LINKED, "costs", "ranks")
    chained = parts_of.groupBy("conv_id").applyInArrow(_chain, CHAINED)
    same = reduce(lambda a, b: a & b, (F.col(f"part.{c}").eqNullSafe(F.col(f"chain.{c}")) for c in _LINKED))
    cut_ones = (found.where("cuts").alias("part").join(chained.alias("chain"), same)
                .select(*[f"part.{c}" for c in (*_LINKED, "kinds")], "chain.start", "chain.end").mapInArrow(_edited, EDITED))
    whole = found.where("not cuts").select(*_LINKED, "kinds", F.lit(NOTHING).alias("start"), "edits")
    return whole.unionByName(cut_ones)


REPAIRED = ("conv_id long, place long, turn long, role_before string, fault string, edit string, cost int, role string, text string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and rows of a conversation, in the order of its rows, as the rows of REPAIRED."""
    schema, done = _arrow_schema(REPAIRED), []
    conv, known, place, pending, state, seen, size = None, False, 0, [], NOTHING, False, 0

    def add(**row) -> None:
        nonlocal place, size
        done.append({"conv_id": conv, "place": place, **row})
        place, size = place + 1, size + len(row.get("text") or "")

    def inserted() -> None:
        nonlocal state
        while pending and pending[-1][0] == "I":
            pending.pop()
            role = "assistant" if state == USER else "user"
            state = STATE[role[0]]
            add(turn=None, role_before=None, fault=None, edit="I", cost=INSERT, role=role, text="")

    def finished() -> None:
        inserted()
        if not place:  # nothing is left of it
            add(turn=None, role_before=None, fault=None, edit=None, cost=0, role=None, text=None)

    for batch in batches:
        for own, turn, role, text, kinds, edits in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "text", "kinds", "edits"))):
            if not known or own != conv:
                if known:
                    finished()
                conv, known, place, pending, state = own, True, 0, [], NOTHING
            if edits is not None:
                marks = iter(kinds)
                pending[:0] = [(e, None if e == "I" else next(marks)) for e in edits][::-1]  # the next one is the last
                continue
            inserted()
            edit, kind = pending.pop()
            blank = not (text or "").strip(SPACE)
            fault = ("blank" if blank else "duplicate") if kind == GONE else "truncated" if kind.isupper() else None
            after, cost = role, (TRUNCATED if kind.isupper() else 0)
            if edit == "D":
                after, cost = None, DELETE
            elif edit == "R":
                after, cost = ("assistant" if state == USER else "user"), cost + REROLE
            if after is not None:
                state = STATE[after[0]]
            add(turn=turn, role_before=role, fault=fault, edit=edit, cost=cost, role=after, text=None if edit == "D" else text)
            if len(done) >= 2_000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
                size = 0
    if known:
        finished()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The edits of all conversations: one row for each, in order of `place`.

    (conv_id, place, turn, role_before, fault, edit, cost, role, text): fault is blank, duplicate,
    truncated or null; role and text are those after the repair, null where the row is dropped. A
    conversation of which nothing is left has one row without edit. `rows` are those of `damaged`, or
    any (conv_id long, turn long, role, text) without nulls in role and text. All rows of a
    conversation come from one task, in order.
    """
    none = F.lit(None)
    edits = _all_edits(rows, segment).select(
        "conv_id", *_ORDER, F.col("seq").alias("seq"), none.cast("string").alias("role"), none.cast("string").alias("text"), "kinds", "edits")
    texts = _placed(rows.where("role is not null")).select(
        "conv_id", *_ORDER, F.lit(1 << 30).alias("seq"), "role", "text", none.cast("string").alias("kinds"),
        none.cast("string").alias("edits"))
    sort = [F.col(c).asc_nulls_first() for c in _LINKED]
    return (edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*sort)
            .select("conv_id", "turn", "role", "text", "kinds", "edits").mapInArrow(_applied, REPAIRED))


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, done = _arrow_schema(REPORT), []
    conv, state = None, None

    def finished() -> None:
        turns = state["turns"]
        gaps = state["high"] - state["low"] + 1 - turns if turns else 0
        done.append({"conv_id": conv, "gaps": gaps, **state["faults"], "illegal": state["illegal"], "cost": state["cost"],
                     "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()})

    for batch in batches:
        for own, place, turn, before, fault, edit, cost, role, text in zip(
                *(batch.column(c).to_pylist() for c in _arrow_schema(REPAIRED).names)):
            if state is None or own != conv:
                if state:
                    finished()
                conv = own
                state = {"faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "illegal": 0, "cost": 0, "audit": [],
                         "hash": sha256(), "turns": 0, "low": None, "high": None, "initial": None, "lines": 0}
            if edit is None:
                continue
            state["audit"].append(edit)
            state["cost"] += cost
            if edit != "I":
                if turn is not None and turn != state["high"]:  # rows come by turn
                    state["turns"] += 1
                    state["low"], state["high"] = turn if state["low"] is None else state["low"], turn
                if fault:
                    state["faults"][fault] += 1
                initial = before[:1]
                if state["initial"] is not None and state["initial"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initial"] = initial
            if role is not None:
                state["hash"].update((("\n" if state["lines"] else "") + f"{role}:{text}").encode())
                state["lines"] += 1
        if len(done) >= 1_000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    if state:
        finished()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation: faults, cost and edits of the repair, and a digest of what it gives."""
    return repaired(damaged(conversations), segment).mapInArrow(_reported, REPORT)
