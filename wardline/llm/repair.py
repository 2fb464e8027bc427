"""Repair of conversation structure: the cheapest edits that make the roles of a conversation follow ``(s?(ua)+)?``.

The roles form a grammar in Chomsky normal form. A nonterminal is a pair of states (p, r) and derives the spans whose
repair leads from p to r: (p, r) -> (p, q) (q, r), and (p, r) -> the edits of one turn between any number of inserted
turns. A cell of the chart holds, for each nonterminal, the least (cost, audit) of its span. For these nonterminals every
split of a span gives the same cell (costs add, and of equally dear audits of one span none is the beginning of another,
so the least of both sides is the least of the whole). So spans are combined bottom-up by doubling length, and a
conversation of any size is cut over many tasks whose cells are combined last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wardline.llm.shared import hinted, staged, table

#: States by what was put out last: nothing, system, user, assistant; where each role initial leads; where one may end.
STATES = 4
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: Costs of the edits, and of leaving a truncated turn in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
#: Turns of one conversation that a task holds to write them out, in characters; a longer one is written in a second pass.
HELD_CHARS = 8 << 20

Cell = tuple  # STATES * STATES entries (cost, audit) or None
NOTHING: Cell = tuple((0, "") if k % (STATES + 1) == 0 else None for k in range(STATES * STATES))


def _better(a, b):
    return b if a is None or (b is not None and b < a) else a


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: the least over the state between them."""
    out = []
    for p in range(0, STATES * STATES, STATES):
        for r in range(STATES):
            best = None
            for q in range(STATES):
                a, b = left[p + q], right[q * STATES + r]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost < best[0]:
                        best = (cost, a[1] + b[1])
                    elif cost == best[0]:
                        best = min(best, (cost, a[1] + b[1]))
            out.append(best)
    return tuple(out)


_joined_short = lru_cache(maxsize=20_000)(joined)


def _edits(cost: int, letter: str, roles: str) -> dict[tuple[int, int], tuple[int, str]]:
    return {(p, r): (cost, letter) for role in roles for p, r in STEP.get(role, {}).items()}


def _cell(entries: Iterable[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: list = [None] * (STATES * STATES)
    for (p, r), value in entries:
        out[p * STATES + r] = _better(out[p * STATES + r], value)
    return tuple(out)


@lru_cache(maxsize=1)
def closure() -> Cell:
    """Any number of inserted turns: one more at a time until nothing gets better."""
    one = _cell([*_edits(INSERT, "I", "ua").items()])
    cell = NOTHING
    while True:
        more = tuple(_better(a, b) for a, b in zip(cell, joined(cell, one), strict=True))
        if more == cell:
            return cell
        cell = more


@lru_cache(maxsize=1024)
def turn_cell(initial: str, fault: int) -> Cell:
    """The edits of one turn between inserted ones."""
    entries = [((p, p), (DELETE, "D")) for p in range(STATES)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_OFF else 0
        entries += _edits(KEEP + extra, "K", initial).items()
        entries += _edits(REROLE + extra, "R", "ua").items()
    return joined(joined(closure(), _cell(entries)), closure())


def chart(cells: list[Cell]) -> Cell:
    """The cell of a whole row of spans, combined bottom-up by span length."""
    length = 1
    while len(cells) > 1:
        join = _joined_short if length <= 16 else joined
        cells = [join(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
        length *= 2
    return cells[0] if cells else closure()


def repeated(cell: Cell, times: int) -> Cell:
    """The cell of ``times`` equal spans in a row, by squaring."""
    out = closure()
    while times:
        if times & 1:
            out = joined(out, cell)
        cell, times = joined(cell, cell), times >> 1
    return out


def verdict(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) from the start to an end."""
    return min(cell[end] for end in ENDS if cell[end] is not None)


class Writer:
    """Applies an audit to turns as they come."""

    def __init__(self, audit: str):
        self.edits, self.at, self.last = audit, 0, ""

    def _put(self, role: str, text: str) -> tuple[str, str]:
        self.last = role[:1]
        return role, text

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put(self._due(), "")

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        """What comes before a turn and of it and its copies, which follow at once and have no other edit than to go."""
        for _ in range(copies):
            yield from self.inserted()
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                yield self._put(role, text)
            elif edit == "R":
                yield self._put(self._due(), text)


class Digest:
    """sha256 of turns written as ``role:text``, joined by line ends."""

    def __init__(self):
        self.sha, self.any = sha256(), False

    def add(self, turns: Iterable[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True


class Run:
    """The turns of one conversation that lie together in one task, in order: counts, chart and, while few, the turns."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal")

    def __init__(self, conv: object):
        self.conv, self.cells, self.turns, self.held = conv, [], [], 0
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.first_initial = self.last_initial = None
        self.first_turn = self.last_turn = None
        self.n_turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        initial = role[:1]
        if fault:
            self.counts[self.COUNTS[fault - 1]] += 1
        if copies > 1:  # equal rows beside each other: blank ones are blank again, others duplicates
            self.counts["blank" if fault == BLANK else "duplicate"] += copies - 1
            self.counts["illegal"] += copies - 1
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.n_turns = turn, self.n_turns + 1
        self.cells.append(turn_cell(initial, fault))
        if copies > 1:
            self.cells.append(repeated(turn_cell(initial, DUPLICATE), copies - 1))
        if len(self.cells) >= 4096:
            self.cells = [chart(self.cells)]
        self.held += len(text)
        if self.held <= HELD_CHARS:
            self.turns.append((role, text, copies))
        else:
            self.turns = []

    def row(self, part: int, whole: bool) -> dict:
        cell = chart(self.cells)
        out = {"conv_id": self.conv, "part": part, "whole": whole and self.held <= HELD_CHARS, **self.counts}
        out |= {c: getattr(self, c) for c in ("first_initial", "last_initial", "first_turn", "last_turn", "n_turns")}
        if not out["whole"]:
            return out | {"costs": [e and e[0] for e in cell], "audits": [e and e[1] for e in cell]}
        cost, audit = verdict(cell)
        writer, digest = Writer(audit), Digest()
        for role, text, copies in self.turns:
            digest.add(writer.turn(role, text, copies))
        digest.add(writer.inserted())
        return out | {"cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}


LEGAL = ("su", "ua", "au")
RUN = "part int, whole boolean, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, n_turns long, costs array<int>, audits array<string>, cost long, audit string, repaired_sha256 string"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _runs(schema: pa.Schema):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, first, out = TaskContext.get().partitionId(), None, True, []
        for batch in batches:
            for conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
                if run is None or run.conv != conv:
                    if run is not None:
                        out.append(run.row(part, not first))
                        first = False
                    run = Run(conv)
                run.add(*rest)
            if out:
                yield _batch(out, schema)
                out = []
        if run is not None:
            yield _batch([run.row(part, False)], schema)

    return runs


def _settled(schema: pa.Schema):
    """Runs of a conversation that lie in several tasks become one: at most one row a task comes together here."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, runs in zip(batch.column("conv_id").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                total = {c: sum(r[c] for r in runs) for c in Run.COUNTS}
                total["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(runs, runs[1:], strict=False))
                dated = [r for r in runs if r["n_turns"]]
                n_turns = sum(r["n_turns"] for r in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:], strict=False))
                cells = [tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in runs]
                cost, audit = verdict(chart(cells))
                ends = {"first_turn": dated[0]["first_turn"], "last_turn": dated[-1]["last_turn"]} if dated else {}
                out.append({"conv_id": conv, "cost": cost, "audit": audit, "n_turns": n_turns, **total, **ends})
            yield _batch(out, schema)

    return settle


def _written(schema: pa.Schema):
    """Digests of conversations whose rows come in order, each after a row with its audit; nothing is held."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = writer = digest = None

        def done() -> Iterator[pa.RecordBatch]:
            if writer is not None:
                digest.add(writer.inserted())
                yield _batch([{"conv_id": conv, "repaired_sha256": digest.sha.hexdigest()}], schema)

        for batch in batches:
            for conv_, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
                if audit is not None:
                    yield from done()
                    conv, writer, digest = conv_, Writer(audit), Digest()
                else:
                    digest.add(writer.turn(role, text, copies))
        yield from done()

    return write


def prepared(turns: DataFrame) -> DataFrame:
    """Distinct turns with their number of copies and their first fault: conv_id, turn, role, text, copies, fault.

    A blank turn has no other character than spaces and \\t \\n \\v \\f \\r; a duplicate has the role and text of an earlier
    turn of its conversation; a truncated one does not end in a full stop, exclamation or question mark.
    """
    kept = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    name = F.sha2("text", 256)
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # null first
    first = turns.groupBy("conv_id", "role", name.alias("name")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where(F.col("n") > 1).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "name", "first")
    side = hinted(staged(first, "repair-first"))
    met = kept.join(side, kept.conv_id.eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (name == F.col("name")), "left")
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(end == "", BLANK)
        .when(F.coalesce(order > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~end.isin(".", "!", "?"), CUT_OFF)
        .otherwise(NO_FAULT)
    )
    return met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def repaired(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, text, copies: how often the row stands there).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns stand in the order
    (turn, role, text), nulls first; role and text must not be null. Rows with a null conv_id are one conversation. An empty
    table gives no rows.

    Rows are dealt to tasks by sorted ranges of that order, so a conversation of any length is many tasks. Those at the ends
    of a range, and very long ones, are put together from their cells and written in a second pass, which streams them:
    a sha256 has to see its text in order.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = prepared(turns)
    conv = turns.schema["conv_id"].dataType.simpleString()
    head = f"conv_id {conv}, "

    def arrow(ddl: str) -> tuple[str, pa.Schema]:
        return ddl, to_arrow_schema(StructType.fromDDL(ddl))

    ddl, schema = arrow(head + RUN)
    runs = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(schema), ddl), "repair-runs")
    result = [F.col(c) for c in ("conv_id", *Run.COUNTS, "first_turn", "last_turn", "n_turns", "cost", "audit", "repaired_sha256")]
    whole = runs.where("whole").select(*result)
    fields = [c for c in runs.columns if c not in ("conv_id", "part", "whole", "cost", "audit", "repaired_sha256")]
    parts = runs.where("not whole").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *fields))).alias("runs"))
    ddl, schema = arrow(head + "cost long, audit string, n_turns long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long")
    split = staged(parts.mapInArrow(_settled(schema), ddl), "repair-split")
    ids = hinted(split.select(F.col("conv_id").alias("c")))
    again = prepared(turns.join(ids, turns.conv_id.eqNullSafe(F.col("c")), "left_semi"))
    stream = again.select(*order, "copies", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind")).unionByName(
        split.select("conv_id", "audit", F.lit(0).alias("kind")), allowMissingColumns=True
    )
    ddl, schema = arrow(head + "repaired_sha256 string")
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    digests = stream.mapInArrow(_written(schema), ddl).withColumnRenamed("conv_id", "c")
    found = split.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).select(*result)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    return whole.unionByName(found).select("conv_id", gaps, *Run.COUNTS, "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a table of conversations, nulls as one space, some of them spoiled by a hash of their place: dropped,
    emptied, without their ends of sentences, doubled (copies = 2), or given to the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.col("fate")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("fate")).where(fate != 0)
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fixed = repaired(damaged(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    count = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *Run.COUNTS, "cost")]
    nothing = sha256().hexdigest()
    return every.join(fixed, every.conv_id.eqNullSafe(F.col("c")), "left").select(
        "conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
