"""Repair of conversation structure by a retained-subsequence programme.

A repaired conversation has the role initials `(s?(ua)+)?`. Each turn is kept, given the role user or assistant, or deleted, and empty
turns may be inserted; the cheapest edits are chosen. The programme runs over the turns that stay: the cost of ending on a turn in a
role is the least over the turn that stays before it, plus the deletions between them, plus the inserts that the two roles need. The
deletions between two turns are a difference of prefix sums, so for each role a single running minimum (of cost less the sum so far)
stands for all turns before, and a conversation takes linear time. Of equal costs the edits whose initials come first stay: running
minima carry their order among each other, which with the letters added decides the order after the next turn, so no edits are
compared letter by letter.

Rows of a conversation go by turn, null first, then by role and text; a null role or text is one space. A turn's fault is the first of
blank (no character but white space), duplicate (its role and text were seen earlier) and truncated (its last character that is no white space
is none of `.!?`). A running minimum that another beats whatever follows is dropped; once all that are left share their past, its turns
leave. One shuffle brings the rows of a conversation together, sorted outside memory if need be; the workers hold the turns that are not yet
decided, which is a handful where roles are known. A conversation is read by one task, in order, since its text is one sequence.

Defined results: repeated rows are duplicates of the first; rows of a null conv_id are one conversation; a role is known by its first
letter, as written; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.llm.common import BATCH_BYTES, SPACE, replaced, small_batches

RETAG, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
#: Inserts needed between a turn of one role and the next (`-`: none yet, or none after).
GAP = {"-s": "", "-u": "", "-a": "u", "su": "", "sa": "u", "ua": "", "uu": "a", "au": "", "aa": "u", "--": "", "s-": "ua", "u-": "a", "a-": ""}
#: What following the course of the second costs at most more when coming from the first.
DETOUR = {"-s": 0, "-u": 5, "-a": 0, "s-": 10, "su": 5, "sa": 10, "u-": 7, "us": 5, "ua": 5, "a-": 2, "as": 0, "au": 5}
#: Turns held after which what all minima share is looked for; twice as many as were left, if those are more.
OFTEN = 64

DAMAGED = "conv_id {id}, turn long, role string, text string"
TURNS = "conv_id {id}, place long, turn long, edit string, role string, text string, fault string, illegal boolean"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, robbed of their stops, repeated or given the role user, by a digest of their key."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind"))
    return read.where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, replaced(F.col("text"), ".!?")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with fault and illegal: whether its role may not follow the row before. Sorted within partitions."""
    space = F.lit(" ")
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.length(bare) == 0, "blank").when(F.col("seen"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    before = F.lag(F.substring("role", 1, 1)).over(Window.partitionBy("conv_id").orderBy(*_order()))
    judged = read.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault).drop("seen").withColumn("before", before)
    pair = F.concat("before", F.substring("role", 1, 1))
    return judged.withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).drop("before").sortWithinPartitions("conv_id", *_order())


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None
    illegal: bool


class Least(NamedTuple):
    """A running minimum: cost less the deletions so far, its place among the others, and the last turn that stays."""

    cost: int
    rank: int
    node: list | None


class Conversation:
    """Reads turns one by one and gives back (edit, role, turn or none) as soon as they are decided.

    A node is [node before, index, role initial, inserts before it, edit].
    """

    def __init__(self) -> None:
        self.least: dict[str, Least] = {"-": Least(0, 0, None)}
        self.held: list[Turn] = []  # turns from number self.first on
        self.first = 0
        self.next = OFTEN

    def add(self, t: Turn) -> Iterator[tuple[str, str, Turn | None]]:
        n = self.first + len(self.held)
        self.held.append(t)
        if t.fault not in ("blank", "duplicate"):
            self._stay(n, t.role[:1], UNFINISHED if t.fault == "truncated" else 0)
        if len(self.held) >= self.next:
            yield from self._settled()
            self.next = max(OFTEN, 2 * len(self.held))

    def _stay(self, n: int, initial: str, more: int) -> None:
        # what each role may end on: the past goes on with the turn deleted (D), or ends on the turn
        ends: dict[str, list[tuple[int, int, str, list | None]]] = {r: [(x.cost, x.rank, "D", x.node)] for r, x in self.least.items()}
        for role, edit, price in [(initial, "K", 0)] * (initial in ("s", "u", "a")) + [(r, "R", RETAG) for r in ("u", "a") if r != initial]:
            for r, x in self.least.items():
                gap = GAP.get(r + role)
                if gap is not None:  # less the prefix sum of deletions up to this turn, which a turn that stays does not pay
                    cost = x.cost + INSERT * len(gap) + price + more - DELETE
                    ends.setdefault(role, []).append((cost, x.rank, "I" * len(gap) + edit, [x.node, n, role, gap, edit]))
        best = {r: min(e, key=lambda c: c[:3]) for r, e in ends.items()}
        best = {r: c for r, c in best.items() if not any(o[0] + DETOUR[p + r] < c[0] for p, o in best.items() if p != r)}
        ordered = sorted(best, key=lambda r: best[r][1:3])
        self.least = {r: Least(best[r][0], k, best[r][3]) for k, r in enumerate(ordered)}

    def _path(self, node: list | None) -> list[list]:
        path = []
        while node is not None:
            path.append(node)
            node = node[0]
        return path[::-1]

    def _settled(self) -> Iterator[tuple[str, str, Turn | None]]:
        """What all running minima share; they go on from there."""
        paths = [self._path(x.node) for x in self.least.values()]
        shared = 0
        for nodes in zip(*paths, strict=False):
            if any(x is not nodes[0] for x in nodes):
                break
            shared += 1
        if shared:
            path = paths[0][:shared]
            yield from self._edits(path, path[-1][1] + 1)
            for p in paths:
                if len(p) > shared:
                    p[shared][0] = None
            self.least = {r: x._replace(node=x.node if len(p) > shared else None) for (r, x), p in zip(self.least.items(), paths, strict=True)}
        elif not any(paths):  # all deleted so far
            yield from self._edits([], self.first + len(self.held))

    def _edits(self, path: list[list], end: int) -> Iterator[tuple[str, str, Turn | None]]:
        """The edits of the turns held before number end."""
        at = self.first
        for _, n, role, gap, edit in path:
            for t in self.held[at - self.first : n - self.first]:
                yield "D", t.role, t
            for r in gap:
                yield "I", ROLE[r], None
            t = self.held[n - self.first]
            yield edit, t.role if edit == "K" else ROLE[role], t
            at = n + 1
        for t in self.held[at - self.first : end - self.first]:
            yield "D", t.role, t
        del self.held[: end - self.first]
        self.first = end

    def close(self) -> Iterator[tuple[str, str, Turn | None]]:
        """The rest. The programme's last running minimum pays for the inserts that its role still needs."""
        last = min(self.least, key=lambda r: (self.least[r].cost + INSERT * len(GAP[r + "-"]), self.least[r].rank))
        yield from self._edits(self._path(self.least[last].node), self.first + len(self.held))
        for r in GAP[last + "-"]:
            yield "I", ROLE[r], None


def repaired(rows: DataFrame) -> DataFrame:
    """Every row of rows (conv_id, turn, role, text) and every inserted turn, in order within its partition.

    conv_id, place (from 0 within the conversation), turn (null: inserted), edit (K, R, D, I), role and text after the edit, fault and
    illegal of the row. The repaired conversation is what is not D.
    """
    out = TURNS.format(id=rows.schema["conv_id"].dataType.simpleString())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Turn]]:
        for batch in batches:
            yield from zip(batch.column("conv_id").to_pylist(), map(Turn._make, zip(*[batch.column(c).to_pylist() for c in Turn._fields], strict=True)), strict=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, turns in groupby(read(batches), key=lambda x: x[0]):
            c, place = Conversation(), 0
            for _, t in turns:
                for edit, role, one in c.add(t):
                    yield _row(conv_id, place, edit, role, one)
                    place += 1
            for edit, role, one in c.close():
                yield _row(conv_id, place, edit, role, one)
                place += 1

    schema = to_arrow_schema(StructType.fromDDL(out))
    return small_batches(faulty(rows)).mapInArrow(lambda batches: _batches(each(batches), schema), out)


def _row(conv_id: object, place: int, edit: str, role: str, t: Turn | None) -> tuple:
    return (conv_id, place, None, edit, role, "", None, False) if t is None else (conv_id, place, t.turn, edit, role, t.text, t.fault, t.illegal)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SUMMARY = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summarized(turns: DataFrame) -> DataFrame:
    """A row for each conversation of repaired(): counts of faults, cost, the edits' initials, and a digest of its repaired text.

    Reads the turns in the order in which repaired() gives them, one after the other.
    """
    out = SUMMARY.format(id=turns.schema["conv_id"].dataType.simpleString())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "role", "text", "fault", "illegal")], strict=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, rows in groupby(read(batches), key=lambda x: x[0]):
            digest, first, last, distinct, cost, illegal, started = hashlib.sha256(), None, None, 0, 0, 0, False
            faults, audit = {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}, []
            for _, turn, edit, role, text, fault, wrong in rows:
                audit.append(edit)
                faults[fault] += 1
                illegal += wrong
                cost += {"K": 0, "R": RETAG, "D": DELETE, "I": INSERT}[edit] + (UNFINISHED if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    digest.update(("\n" * started + role + ":" + text).encode())
                    started = True
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
            yield conv_id, 0 if first is None else last - first + 1 - distinct, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()

    schema = to_arrow_schema(StructType.fromDDL(out))
    return turns.mapInArrow(lambda batches: _batches(each(batches), schema), out)


def reported(rows: DataFrame, after: DataFrame) -> DataFrame:
    """summarized(repaired(after)) for every conv_id of rows; zeros, no edits and the empty text's digest where nothing is left of it."""
    found = summarized(repaired(after)).withColumnRenamed("conv_id", "found_id")
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    empty = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select("conv_id", *[F.coalesce(c, v.cast("long") if c not in ("audit", "repaired_sha256") else v).alias(c) for c, v in empty.items()])
