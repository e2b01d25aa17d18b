"""Repair of the structure of conversations by cheapest edits.

A conversation's rows, by turn, are symbols: the class of the role and the fault of
the row.  Roles must read `(s?(ua)+)?` afterwards.  A symbol is a min-plus matrix over
the four states of that grammar, deletions, new roles and insertions included; equal
neighbours are one run, which is advanced by cached binary powers of its matrix.  From
the costs that remain at each place the choices are unrolled forwards, the least
letter first, so of all cheapest edits those of the least audit text are made.

Rows lie in ranges of (conversation, turn).  A conversation that lies inside a range is
repaired where it lies.  Those at the ends of a range, and very large ones, are
cut into chunks: chunks send their runs, a conversation's runs are solved together, and
each chunk makes its own edits.  No task holds the texts of such a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, batch_of, give_back, saved

# What edits cost, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FAULTS = (None, "blank", "duplicate", "truncated")
ROLES = "sua"  # classes 0 to 2 of a role by its first letter; 3 is any other
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
HELD_ROWS, HELD_BYTES = 16 * CHUNK_ROWS, 8 * CHUNK_BYTES  # of a conversation repaired where it lies

# States: nothing yet, after s, after u, after a.  MADE is where a new or renamed turn leads.
MADE = (2, 2, 3, 2)
NEW_ROLE = ("user", "user", "assistant", "user")
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, class of role) -> state
OVER = 1 << 50
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(OVER, min(a[i][k] + v[k] for k in range(4))) for i in range(4))


def _inserted() -> Matrix:
    cost = [[0 if i == j else OVER for j in range(4)] for i in range(4)]
    for i in range(4):
        at, sum_ = i, 0
        for _ in range(4):
            at, sum_ = MADE[at], sum_ + INSERT
            cost[i][at] = min(cost[i][at], sum_)
    return tuple(map(tuple, cost))


INSERTED = _inserted()
AT_END: Vector = apply(INSERTED, (0, OVER, OVER, 0))


def row_edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row itself: (letter, cost, state after), letters ascending."""
    role, fault = divmod(symbol, 4)
    yield "D", DELETE, state
    if fault in (0, 3):
        more = TRUNCATED if fault == 3 else 0
        if (state, role) in KEPT:
            yield "K", more, KEPT[state, role]
        yield "R", REROLE + more, MADE[state]


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2^k rows of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    cost = [[OVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, c, after in row_edits(symbol, state):
            cost[state][after] = min(cost[state][after], c)
    return times(INSERTED, tuple(map(tuple, cost)))


def advanced(symbol: int, count: int, after: Vector) -> Vector:
    """Costs that remain before a run, from those after it; as differences to the least one,
    of which there are few."""
    k = 0
    while count:
        if count & 1:
            after = _step(symbol, k, after)
        count, k = count >> 1, k + 1
    return after


@lru_cache(1 << 16)
def _step(symbol: int, k: int, after: Vector) -> Vector:
    v = apply(power(symbol, k), after)
    least = min(v)
    return tuple(min(OVER, x - least) for x in v)


@lru_cache(1 << 16)
def choice(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """Letters of a row in a state, insertions before it first, and the state after it."""
    before = apply(power(symbol, 0), after)
    letters = ""
    while True:
        own = {x: s for x, c, s in row_edits(symbol, state) if c + after[s] == before[state]}
        if "D" in own:
            return letters + "D", own["D"]
        if INSERT + before[MADE[state]] == before[state]:
            letters, state = letters + "I", MADE[state]
            continue
        letter = min(own)
        return letters + letter, own[letter]


def unrolled(symbol: int, count: int, state: int, after: Vector) -> Iterator[tuple[str, int]]:
    """`choice` of each row of a run: halves, down to rows whose costs are held at once."""
    if count > 64:
        half = count // 2
        for letters, state in unrolled(symbol, half, state, advanced(symbol, count - half, after)):
            yield letters, state
        yield from unrolled(symbol, count - half, state, after)
        return
    costs = [after]
    for _ in range(count - 1):
        costs.append(_step(symbol, 0, costs[-1]))
    for v in reversed(costs):
        letters, state = choice(symbol, state, v)
        yield letters, state


def solved(runs: list[tuple[int, int]]) -> Iterator[tuple[str, int]]:
    """Per row of a conversation, given as (symbol, count): its letters and the state before
    it.  Insertions at the end come last, with a state and no row."""
    after = [AT_END]
    for symbol, count in reversed(runs):
        after.append(advanced(symbol, count, after[-1]))
    after.pop()
    state = 0
    for symbol, count in runs:
        for letters, following in unrolled(symbol, count, state, after.pop()):
            yield letters, state
            state = following
    letters, last = "", state
    while last not in (0, 3):
        letters, last = letters + "I", MADE[last]
    yield letters, state


def role_class(role: str) -> int:
    return ROLES.find(role[0]) % 4 if role else 3


def text_fault(text: str) -> int:
    end = text.rstrip(BLANKS)
    return 1 if not end else 0 if end[-1] in ENDS else 3


def edits_of(letters: str, state: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(turn, fault, edit, was, role, text) of each edit, from a state on; rows are
    (turn, role, text, fault)."""
    rows = iter(rows)
    for letter in letters:
        if letter == "I":
            yield None, None, "I", None, NEW_ROLE[state], ""
            state = MADE[state]
            continue
        turn, role, words, fault = next(rows)
        yield turn, FAULTS[fault], letter, role, NEW_ROLE[state] if letter == "R" else role, words
        if letter == "R":
            state = MADE[state]
        elif letter == "K":
            state = KEPT[state, role_class(role)]


def repaired(rows: list[tuple]) -> Iterator[tuple]:
    """`edits_of` a whole conversation; rows are (turn, role, text) in order."""
    seen, marked = set(), []
    for turn, role, text in rows:
        fault = text_fault(text)
        if fault != 1:
            key = (role, text)
            if key in seen:
                fault = 2
            seen.add(key)
        marked.append((turn, role, text, fault))
    runs = runs_of([role_class(r) * 4 + f for _, r, _, f in marked])
    return edits_of("".join(letters for letters, _ in solved(runs)), 0, marked)


def runs_of(symbols: list[int]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    return [tuple(r) for r in runs]


SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class Summary:
    """What is told of a conversation, from its edits in order."""

    def __init__(self):
        self.turns = self.illegal = self.cost = 0
        self.first = self.last = self.role = None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.audit: list[str] = []
        self.hash, self.rows = hashlib.sha256(), 0

    def add(self, turn, fault, edit, was, role, text) -> None:
        self.audit.append(edit)
        if edit == "I":
            self.cost += INSERT
        else:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            self.faults[fault] += 1
            kind = role_class(was)
            if self.role is not None and (self.role, kind) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.role = kind
            self.cost += {"D": DELETE, "R": REROLE, "K": 0}[edit]
            if edit == "D":
                return
            self.cost += TRUNCATED if fault == "truncated" else 0
        self.hash.update(f"{chr(10) * (self.rows > 0)}{role}:{text}".encode())
        self.rows += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        counts = [self.faults[f] for f in FAULTS[1:]]
        return (gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


EDITS = "turn long, fault string, edit string, was string, role string, text string"
PLACED = f"conv_id long, part long, chunk long, step long, {EDITS}"


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conv_id, turn), nulls first; null roles and texts are a space."""
    rows = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumns(
        {
            "tie": F.md5(F.concat("role", F.lit(":"), "text").cast("binary")),
            # equal rows may lie in several ranges
            "row_": F.monotonically_increasing_id(),
        }
    )
    order = ["conv_id", "turn", "tie", "role", "row_"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row_")


def _in_place(rows: DataFrame, digests: bool) -> DataFrame:
    """One pass over the ranges.  Conversations inside a range are done: one row with the summary,
    or their edits.  The rows of all others follow as they are, with `edge` and no edit."""
    schema = f"edge boolean, {PLACED}, tie string, {SUMMARY}"
    arrow = arrow_schema(schema)
    blank = (None,) * len(SUMMARY.split(","))

    def run(batches):
        from pyspark import TaskContext

        give_back()
        part, chunk, first = TaskContext.get().partitionId(), 0, True
        conv, held, size, cut = None, [], 0, False
        out: list[tuple] = []

        def moved(limit: int = 0) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if len(out) > limit:
                yield batch_of(arrow, out)
                out = []

        def sent():
            """The held rows as they are, as chunks."""
            nonlocal held, size, chunk
            own, bytes_ = 0, 0
            for step, (turn, role, text, tie) in enumerate(held):
                if own == CHUNK_ROWS or bytes_ > CHUNK_BYTES:
                    chunk, own, bytes_ = chunk + 1, 0, 0
                out.append((True, conv, part, chunk, step, turn, None, None, None, role, text, tie, *blank))
                own, bytes_ = own + 1, bytes_ + len(text)
            held, size, chunk = [], 0, chunk + 1

        def closed(edge: bool):
            nonlocal held, size, chunk
            if edge:
                sent()
                return
            found = repaired([r[:3] for r in held])
            if digests:
                told = Summary()
                for e in found:
                    told.add(*e)
                out.append((False, conv, *[None] * 10, *told.row()))
            else:
                out.extend((False, conv, part, chunk, i, *e, None, *blank) for i, e in enumerate(found))
            held, size, chunk = [], 0, chunk + 1

        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "tie")
            for conv_id, *row in zip(*[batch.column(n).to_pylist() for n in names]):
                if conv_id != conv and (held or cut):
                    closed(first or cut)
                    first = cut = False
                    yield from moved(1024)
                conv = conv_id
                held.append(row)
                size += len(row[2])
                if len(held) >= HELD_ROWS or size > HELD_BYTES:
                    cut = True
                    sent()
                    yield from moved()
        if held:
            closed(True)
        yield from moved()

    return saved(_sorted_rows(rows).mapInArrow(run, schema), "conversations")


def _across(edge: DataFrame) -> DataFrame:
    """Edits of the conversations that lie in several ranges or chunks, from their rows."""
    place = F.struct("part", "chunk", "step")
    again = (
        edge.groupBy("conv_id", "tie", "role")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c_"), F.col("tie").alias("t_"), F.col("role").alias("r_"), "first")
    )
    same = edge["conv_id"].eqNullSafe(again["c_"]) & (edge["tie"] == again["t_"]) & (edge["role"] == again["r_"])
    later = F.coalesce(place != F.col("first"), F.lit(False))
    rows = saved(
        edge.join(again, same, "left").select(
            "conv_id", "part", "chunk", "step", "turn", "role", "text", later.alias("later")
        ),
        "conversations",
    )
    marked = arrow_schema("conv_id long, part long, chunk long, runs binary")

    def fault_of(text: str, later: bool) -> int:
        fault = text_fault(text)
        return 2 if later and fault != 1 else fault

    def symbols(table):
        table = table.sort_by("step")
        columns = [table.column(n).to_pylist() for n in ("role", "text", "later")]
        runs = runs_of([role_class(r) * 4 + fault_of(t, x) for r, t, x in zip(*columns)])
        head = [table.column(n)[0].as_py() for n in ("conv_id", "part", "chunk")]
        return pa.Table.from_batches([batch_of(marked, [(*head, np.array(runs, dtype="<i8").tobytes())])])

    runs = rows.groupBy("part", "chunk").applyInArrow(symbols, "conv_id long, part long, chunk long, runs binary")
    told = "part long, chunk long, letters string, state long"
    told_arrow = arrow_schema(told)

    def solve(table):
        table = table.sort_by([("part", "ascending"), ("chunk", "ascending")])
        own = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in table.column("runs").to_pylist()]
        steps = solved([tuple(r) for r in np.concatenate(own).tolist()])
        out = []
        for k, one in enumerate(own):
            n = int(one[:, 1].sum()) + (k == len(own) - 1)
            letters, state = next(steps)
            letters += "".join(next(steps)[0] for _ in range(n - 1))
            head = [table.column(c)[k].as_py() for c in ("part", "chunk")]
            out.append((*head, letters, state))
        return pa.Table.from_batches([batch_of(told_arrow, out)])

    letters = runs.groupBy("conv_id").applyInArrow(solve, told)
    placed = arrow_schema(PLACED)

    def edit(left, right):
        left = left.sort_by("step")
        conv, part, chunk = (left.column(n)[0].as_py() for n in ("conv_id", "part", "chunk"))
        columns = zip(*[left.column(n).to_pylist() for n in ("turn", "role", "text", "later")])
        own = [(turn, role, text, fault_of(text, later)) for turn, role, text, later in columns]
        steps = [right.column(n)[0].as_py() for n in ("letters", "state")]
        out = [(conv, part, chunk, i, *e) for i, e in enumerate(edits_of(*steps, own))]
        return pa.Table.from_batches([batch_of(placed, out)])

    return rows.groupBy("part", "chunk").cogroup(letters.groupBy("part", "chunk")).applyInArrow(edit, PLACED)


def repair(rows: DataFrame) -> DataFrame:
    """Edits of conversations, one row each: `edit` is K (kept), R (new role), D (deleted) or I
    (inserted), with the row's turn, fault, old role (`was`), role and text.  Within a
    conversation they are in order of part, chunk and step; the repaired conversation is its
    edits other than D.

    Needs conv_id, turn, role, text; other columns are not read.  Rows are taken by turn, null
    first, and those of one turn by the md5 of `role:text`.  A null role or text is one space,
    an empty role like an unknown one; a null conv_id is a conversation like others.  An
    empty table has no edits.
    """
    table = _in_place(rows, digests=False)
    columns = [c.split()[0] for c in PLACED.split(", ")]
    across = _across(table.where("edge").drop("fault", "edit", "was"))
    return table.where("NOT edge").select(*columns).unionByName(across)


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: gaps in its turns, faults, illegal neighbours, cost,
    audit (letters of the edits) and the SHA-256 of the repaired lines `role:text`.

    The hash reads a conversation's lines one after another, so those of one that is cut into
    chunks stream through one task, which holds its audit and nothing else of it.
    """
    table = _in_place(rows, digests=True)
    schema = f"conv_id long, {SUMMARY}"
    arrow = arrow_schema(schema)

    def run(batches):
        give_back()
        conv, told = None, None
        for batch in batches:
            for conv_id, *edit in zip(*[c.to_pylist() for c in batch.columns]):
                if told is None or conv_id != conv:
                    if told:
                        yield batch_of(arrow, [(conv, *told.row())])
                    conv, told = conv_id, Summary()
                told.add(*edit)
        if told:
            yield batch_of(arrow, [(conv, *told.row())])

    across = _across(table.where("edge").drop("fault", "edit", "was"))
    ordered = across.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "step")
    names = [c.split()[0] for c in EDITS.split(", ")]
    done = ordered.select("conv_id", *names).mapInArrow(run, schema)
    return table.where("NOT edge").select(*done.columns).unionByName(done)


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by crc32(`conv_id:turn`) % 20, nulls being one space: 0 drops a row, 1 empties its
    text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes the role user."""

    def text_of(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text, role = text_of("text"), text_of("role")
    return (
        rows.select(
            "conv_id",
            "turn",
            F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(code == 1, F.lit(""))
            .when(code == 2, F.translate(text, "".join(ENDS), ""))
            .otherwise(text)
            .alias("text"),
            F.explode(
                F.when(code == 0, F.array().cast("array<int>"))
                .when(code == 3, F.array(F.lit(0), F.lit(1)))
                .otherwise(F.array(F.lit(0)))
            ).alias("copy"),
        )
        .drop("copy")
    )


def of_every(ids: DataFrame, told: DataFrame) -> DataFrame:
    """The summary of each conv_id of a table; one without rows has nothing to repair."""
    none = dict(zip([c.split()[0] for c in SUMMARY.split(", ")], Summary().row()))
    known = told.withColumnRenamed("conv_id", "known")
    ids = ids.select(F.col("conv_id").cast("long")).distinct()
    return ids.join(known, ids["conv_id"].eqNullSafe(known["known"]), "left").select(
        "conv_id", *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in none.items()]
    )
