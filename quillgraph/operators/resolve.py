"""Order-dependent resolution: folds over blocks in order of arrival.

A block holds all that can match each other. Threads: mails joined by source threads, or by the replies and participants that mails
without one ask for (their connected components). Facts: thread, subject and predicate. A fold keeps what it created so far, so a
block is one task's work; blocks are as large as the correspondence of people who write to each other, not as the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import timedelta
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import fact_key, normalize_subject, normalize_text, sorted_token_ratio
from quillgraph.operators.graph import components
from quillgraph.tables import written

WINDOW = timedelta(days=14)
SAME, MAYBE, VERIFIED = 90, 60, 80


def blocks(rows: DataFrame, key: str, links: str) -> DataFrame:
    """(key, block) of every row: rows that share a link, directly or over others, have one block, whatever the length of the way."""
    pairs = rows.select(F.concat(F.lit("row "), F.col(key).cast("string")).alias("a"), F.explode(links).alias("link")).select("a", F.concat(F.lit("to "), "link").alias("b"))
    found = components(pairs).where(F.col("id").startswith("row ")).select(F.substring("id", 5, 1 << 30).alias("k"), F.col("component").alias("block"))
    return rows.select(key).join(found, F.col(key).cast("string") == F.col("k"), "left").select(key, F.coalesce("block", F.concat(F.lit("row "), F.col(key).cast("string"))).alias("block"))


def threads(mails: DataFrame) -> DataFrame:
    """message_id, thread_id (the first mail of the thread) and signal of every mail.

    Columns: message_id, source_thread_id, in_reply_to, references, subject, participants, at. The first signal that finds a thread
    decides: source thread (and no other once it is given), reply, references, subject with a shared participant, shared participants
    within 14 days of the thread's last mail (newest thread first; an older mail matches too).

    Only a mail without a source thread asks for replies or participants, so a participant or message ties mails into a block only if
    such a mail names it: mails with source threads fall into blocks of one thread each. A block is folded as its rows come, in order
    of time, by lookups of the thread that a message, a subject with a person, or a person alone leads to; its rows are never held.
    """
    asks = F.coalesce("source_thread_id", F.lit("")) == ""
    tagged = F.array_compact(
        F.concat(
            F.transform(F.coalesce("participants", F.array().cast("array<string>")), lambda p: F.concat(F.lit("p:"), p)),
            F.array(F.concat(F.lit("m:"), "message_id"), F.when(asks, F.concat(F.lit("m:"), "in_reply_to"))),
            F.when(asks & F.col("references").isNotNull(), F.transform("references", lambda r: F.concat(F.lit("m:"), r))).otherwise(F.array().cast("array<string>")),
        )
    )
    rows = mails.withColumn("normal", normalize_subject(F.col("subject")))
    links = written(rows.select("message_id", asks.alias("asks"), F.explode(F.array_distinct(tagged)).alias("link")), "mail-links")
    asked = links.where("asks").select("link").distinct()
    own = rows.where(~asks).select("message_id", F.concat(F.lit("s:"), "source_thread_id").alias("link"))
    tied = own.unionByName(links.select("message_id", "link").join(asked, "link", "left_semi"))
    found = components(tied.select(F.concat(F.lit("row "), "message_id").alias("a"), F.concat(F.lit("to "), "link").alias("b")))
    found = found.where(F.col("id").startswith("row ")).select(F.substring("id", 5, 1 << 30).alias("message_id"), F.col("component").alias("block"))
    placed = rows.join(found, "message_id", "left").withColumn("block", F.coalesce("block", "message_id"))
    ordered = placed.select("block", "message_id", "source_thread_id", "in_reply_to", "references", "normal", "participants", "at").repartition("block").sortWithinPartitions("block", "at", "message_id")
    return ordered.mapInArrow(_fold_threads, "message_id string, thread_id string, signal string")


class Threads:
    """The threads of a block so far. Threads are numbered as they are made; the lookups keep the first, or the newest, of each key."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.subjects: list[str | None] = []
        self.people: list[set[str]] = []
        self.last: list = []
        self.by_source: dict[str, int] = {}
        self.by_message: dict[str, int] = {}
        self.by_subject: dict[tuple[str | None, str], int] = {}
        self.newest: dict[str, tuple] = {}  # person: (last mail, -thread) of the newest thread

    def take(self, message: str, source: str | None, reply: str | None, refs: list[str], normal: str | None, people: list[str], at) -> tuple[str, str]:
        found, signal = None, "new"
        if source:
            found, signal = self.by_source.get(source), "source"
        else:
            known = [self.by_message[r] for r in refs if r in self.by_message]
            same = [self.by_subject[normal, p] for p in people if (normal, p) in self.by_subject]
            near = max((self.newest[p] for p in people if p in self.newest), default=None)
            if reply and reply in self.by_message:
                found, signal = self.by_message[reply], "reply"
            elif known:
                found, signal = min(known), "references"
            elif same:
                found, signal = min(same), "subject"
            elif near is not None and at - near[0] <= WINDOW:
                found, signal = -near[1], "recent"
        if found is None:
            found, signal = len(self.names), "new"
            self.names.append(message)
            self.subjects.append(normal)
            self.people.append(set())
            self.last.append(at)
            if source:
                self.by_source.setdefault(source, found)
        self.by_message[message] = min(self.by_message.get(message, found), found)
        self.last[found] = max(self.last[found], at)
        for p in people:
            self.people[found].add(p)
            key = self.subjects[found], p
            self.by_subject[key] = min(self.by_subject.get(key, found), found)
        for p in self.people[found]:
            self.newest[p] = max(self.newest.get(p, (self.last[found], -found)), (self.last[found], -found))
        return self.names[found], signal


def _fold_threads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, state = None, Threads()
    for batch in batches:
        out = []
        for own, message, source, reply, refs, normal, people, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != block:
                block, state = own, Threads()
            out.append((message, *state.take(message, source, reply, [r for r in refs or [] if r], normal, sorted({p for p in people or [] if p}), at)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["message_id", "thread_id", "signal"])


Verify = Callable[[str, str, str, str], bool]


def facts(mentions: DataFrame, verify: Verify | None = None) -> DataFrame:
    """thread_id, subject_key, predicate, fact_key, current_value, n_mentions, n_changes of the facts of mentions(..., object, seq).

    A mention belongs to the fact of its key; else to the most similar one (the first of several) if their ratio is SAME or more, or if it
    is MAYBE or more and verify(known value, value, subject, predicate) agrees; without verify, VERIFIED or more agrees. Mentions of a
    thread, subject and predicate stream through one task in order; what it holds is the facts, not the mentions.
    """
    key = ["thread_id", "subject_key", "predicate"]
    rows = mentions.select(*(F.col(c).cast("string").alias(c) for c in key), F.col("object").cast("string").alias("object"), "seq", normalize_text(F.col("object")).alias("normal"))
    rows = rows.withColumn("fact_key", fact_key(F.col("normal"))).repartition(*key).sortWithinPartitions(*key, "seq", "object").drop("seq")
    schema = "thread_id string, subject_key string, predicate string, fact_key string, current_value string, n_mentions long, n_changes long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, group in groupby(read(batches), key=lambda r: r[:3]):
            found = Facts(own[1], own[2], verify)
            for *_, value, normal, name in group:
                found.take(value, normal, name)
            columns = list(zip(*((*own, *f) for f in found.rows()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 5 else pa.int64()) for k, c in enumerate(columns)], names=[*key, "fact_key", "current_value", "n_mentions", "n_changes"])

    return rows.mapInArrow(run, schema)


class Facts:
    """The facts of one thread, subject and predicate so far.

    Which may be similar is told by an upper bound of the ratio: a common subsequence is no longer than what the two texts have in common
    of each character. The bound is taken of all facts at once; ratios are then computed from the largest bound down, until no
    bound reaches the best ratio.
    """

    CLASSES = 32

    def __init__(self, subject: str | None, predicate: str | None, verify: Verify | None = None):
        self.subject, self.predicate, self.verify = subject, predicate, verify
        self.keys: dict[str | None, int] = {}
        self.facts: list[list] = []  # key, value, mentions, changes, normal text, its sorted tokens
        self.counts, self.sizes = np.zeros((16, self.CLASSES), np.int32), np.zeros(16, np.int32)

    def _classes(self, tokens: str) -> np.ndarray:
        return np.bincount(np.frombuffer(tokens.encode("utf-32-le", "surrogatepass"), np.uint32) % self.CLASSES, minlength=self.CLASSES).astype(np.int32)

    def _put(self, k: int, normal: str | None) -> None:
        tokens = None if normal is None else " ".join(sorted(normal.split()))
        self.facts[k][4:] = [normal, tokens]
        if k == len(self.sizes):
            self.counts, self.sizes = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.counts[k], self.sizes[k] = (0, -1) if tokens is None else (self._classes(tokens), len(tokens))

    def nearest(self, normal: str | None) -> tuple[int, float]:
        """The fact with the greatest ratio of MAYBE or more, the first of several, and the ratio; -1 if there is none."""
        if normal is None or not self.facts:
            return -1, 0.0
        tokens, n = " ".join(sorted(normal.split())), len(self.facts)
        sizes = self.sizes[:n] + len(tokens)
        with np.errstate(divide="ignore", invalid="ignore"):
            bounds = np.where(sizes > 0, 200.0 * np.minimum(self.counts[:n], self._classes(tokens)).sum(axis=1) / sizes, 100.0)
        bounds[self.sizes[:n] < 0] = 0.0
        best, ratio = -1, 0.0
        at = np.flatnonzero(bounds >= MAYBE - 1e-9)
        for k in at[np.argsort(-bounds[at], kind="stable")].tolist():
            if bounds[k] < ratio - 1e-9:
                break
            found = sorted_token_ratio(self.facts[k][4], normal)
            if found >= MAYBE and (found > ratio or found == ratio and k < best):
                best, ratio = k, found
        return best, ratio

    def take(self, value: str | None, normal: str | None, name: str | None) -> None:
        k = self.keys.get(name, -1)
        if k < 0:
            near, ratio = self.nearest(normal)
            if near >= 0 and (ratio >= SAME or (self.verify(self.facts[near][1], value, self.subject, self.predicate) if self.verify else ratio >= VERIFIED)):
                k = near
        if k < 0:
            self.keys[name] = len(self.facts)
            self.facts.append([name, value, 1, 0, None, None])
            self._put(len(self.facts) - 1, normal)
            return
        fact = self.facts[k]
        fact[2] += 1
        number = lambda x: next(iter(re.findall(r"[0-9]+", x or "")), None)
        if normal != fact[4] and not (fact[0] == "seat_count" and number(fact[4]) == number(normal)):
            fact[1], fact[3] = value, fact[3] + 1
            self._put(k, normal)

    def rows(self) -> Iterator[tuple]:
        return (tuple(f[:4]) for f in self.facts)
