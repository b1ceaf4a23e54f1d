"""People from mentions, in order of arrival: by address, by organization and name, by thread and name.

A mention with an address is the person of that address; what the person lacks (name, organization, role) is filled by the first mention
that says it, times go forward only. A mention without one is the only person with an address whose organization is its own and whose name
holds its name or is held by it, or whose aliases together have all of its name's tokens; its name becomes an alias, which later
mentions meet. Else it is the only person without an address of that name in its thread; else it is a new person. More than one match is none.

The fold runs in blocks. Two mentions are in one block only where one can matter to the other: one address, a token of a name within an
organization (any of the address's names with any of its organizations), or a name within a thread, directly or over others. So
a company is cut into those whose names have a word in common. A block streams through one task, sorted; it holds its people.

Defined results: mentions of one time go by their id; a name without a letter or digit matches nothing; a mention without name and
address is `Unknown`; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.functions import text
from quillgraph.operators.resolve import blocks
from quillgraph.tables import written

OUT = "mention string, person string, outcome string, name string, email string, org string, role string, aliases array<string>, threads array<string>, last_inbound timestamp, last_outbound timestamp"
CREATED, UPDATED, REUSED = "created", "updated", "reused"


class Person:
    __slots__ = ("aliases", "email", "id", "inbound", "met", "name", "org", "outbound", "role", "threads", "tokens")

    def __init__(self, id_: str, name: str, tokens: frozenset[str], email: str | None, org: str | None, role: str | None, thread: str | None):
        self.id, self.name, self.tokens, self.email, self.org, self.role = id_, name, tokens, email, org, role
        self.aliases: list[str] = []
        self.met: set[str] = set()  # tokens of all aliases
        self.threads = [thread] if thread is not None else []
        self.inbound: datetime | None = None
        self.outbound: datetime | None = None

    def seen(self, thread: str | None, sender: bool | None, at: datetime) -> bool:
        """Takes the thread and the time; whether that changed anything."""
        new = thread is not None and thread not in self.threads
        if new:
            self.threads.append(thread)
        if sender is True and (self.inbound is None or at > self.inbound):
            self.inbound, new = at, True
        if sender is False and (self.outbound is None or at > self.outbound):
            self.outbound, new = at, True
        return new

    def fits(self, tokens: frozenset[str]) -> bool:
        return bool(tokens) and (bool(self.tokens) and (tokens <= self.tokens or self.tokens <= tokens) or tokens <= self.met)


class People:
    """The people of a block so far."""

    def __init__(self) -> None:
        self.all: list[Person] = []
        self.by_email: dict[str, Person] = {}
        self.by_org: dict[str, list[Person]] = {}  # with an address, by normal organization
        self.by_thread: dict[tuple, list[Person]] = {}  # without one, by thread and normal name

    def _new(self, person: Person) -> Person:
        self.all.append(person)
        return person

    def take(self, mention: str, at: datetime, thread: str | None, email: str | None, name: str | None, org: str | None, role: str | None, sender: bool | None, tokens: list[str], normal: str, normal_org: str) -> tuple[str, str]:
        known = frozenset(tokens)
        if email:
            return self._by_address(mention, at, thread, email, name, org, role, sender, known, normal_org)
        shown = name or "Unknown"
        found = [p for p in self.by_org.get(normal_org, ()) if p.fits(known)] if normal_org else []
        if len(found) == 1:
            changed = found[0].seen(thread, sender, at)
            if shown != found[0].name and shown not in found[0].aliases:
                found[0].aliases.append(shown)
                found[0].met |= known
                changed = True
            return found[0].id, UPDATED if changed else REUSED
        same = self.by_thread.setdefault((thread, normal), [])
        if len(same) == 1 and thread is not None:
            return same[0].id, REUSED
        same.append(self._new(Person(mention, shown, known, None, org, role, thread)))
        return mention, CREATED

    def _by_address(self, mention: str, at: datetime, thread: str | None, email: str, name: str | None, org: str | None, role: str | None, sender: bool | None, known: frozenset[str], normal_org: str) -> tuple[str, str]:
        p = self.by_email.get(email)
        if p is None:
            p = self.by_email[email] = self._new(Person(mention, name or email, known, email, org or None, role or None, thread))
            p.seen(thread, sender, at)
            if p.org:
                self.by_org.setdefault(normal_org, []).append(p)
            return p.id, CREATED
        changed = p.seen(thread, sender, at)
        if not p.org and org:
            p.org, changed = org, True
            self.by_org.setdefault(normal_org, []).append(p)
        if p.name == p.email and name:
            changed = changed or name != p.name
            p.name, p.tokens = name, known
        if not p.role and role:
            p.role, changed = role, True
        return p.id, UPDATED if changed else REUSED


def folded(mentions: DataFrame) -> DataFrame:
    """A row (mention, person, outcome) of every mention, and a row (null mention) of every person as it is in the end; a person's id is its first mention's.

    mentions: mention, at, thread, email, name, org, role, sender (boolean or null).
    """
    string = lambda c: F.col(c).cast("string").alias(c)
    shown = F.coalesce(F.nullif("name", F.lit("")), F.nullif("email", F.lit("")), F.lit("Unknown"))
    rows = mentions.select(string("mention"), F.col("at").cast("timestamp").alias("at"), string("thread"), F.nullif(F.lower(F.trim("email")), F.lit("")).alias("email"), string("name"), string("org"), string("role"), "sender")
    rows = rows.withColumns({"tokens": text.tokens(shown), "normal": text.normalize_text(shown), "normal_org": text.normalize_text(F.coalesce("org", F.lit("")))})
    rows = written(rows, "mentions")
    within = lambda orgs, tokens: F.flatten(F.transform(orgs, lambda o: F.transform(tokens, lambda t: F.concat(F.lit("org "), o, F.lit("\x01"), t))))
    own_org = F.when(F.col("normal_org") != "", F.array("normal_org")).otherwise(F.array().cast("array<string>"))
    loose = rows.where("email is null").select("mention", F.concat(within(own_org, F.col("tokens")), F.when(F.col("thread").isNotNull(), F.array(F.concat(F.lit("thread "), "thread", F.lit("\x01"), "normal"))).otherwise(F.array().cast("array<string>"))).alias("links"))
    each = rows.where("email is not null").select("email", F.nullif("normal_org", F.lit("")).alias("o"), F.explode_outer("tokens").alias("t"))
    named = each.groupBy("email").agg(within(F.collect_set("o"), F.collect_set("t")).alias("links"))
    hubs = named.select(F.concat(F.lit("address "), "email").alias("mention"), F.concat(F.array(F.concat(F.lit("email "), "email")), "links").alias("links"))
    bound = rows.where("email is not null").select("mention", F.array(F.concat(F.lit("email "), "email")).alias("links"))
    placed = blocks(written(loose.unionByName(hubs).unionByName(bound), "links"), "mention", "links")
    columns = ["mention", "at", "thread", "email", "name", "org", "role", "sender", "tokens", "normal", "normal_org"]
    dealt = rows.join(placed, "mention").select("block", *columns).repartition("block").sortWithinPartitions("block", "at", "mention")
    schema = to_arrow_schema(StructType.fromDDL(OUT))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, group in groupby(read(batches), key=lambda r: r[0]):
            people = People()
            for r in group:
                yield (r[1], *people.take(*r[1:]), *[None] * 8)
            for p in people.all:
                yield None, p.id, None, p.name, p.email, p.org, p.role, p.aliases, p.threads, p.inbound, p.outbound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in each_block(batches):
            held.append(row)
            if len(held) == 4096:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return dealt.mapInArrow(run, OUT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def outcomes(found: DataFrame) -> DataFrame:
    """mention, person, outcome of folded()."""
    return found.where("mention is not null").select("mention", "person", "outcome")


def records(found: DataFrame) -> DataFrame:
    """The people of folded() as they are in the end."""
    return found.where("mention is null").drop("mention", "outcome")
