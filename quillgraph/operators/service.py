"""Questions to bounded answers: parse, bind dates and names, dispatch to one retrieval, wrap rows as evidence.

Parsing and binding are small and run on the driver; the answer is one lazy DataFrame, so its filter, order and limit reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import classify, dates, text
from quillgraph.operators import retrieve

OK, EMPTY, AMBIGUOUS, NO_MATCH, UNSUPPORTED = "ok", "empty", "ambiguous", "no_match", "unsupported"
#: Intents that need their entity: an ambiguous or unknown name ends the question.
CONTEXT = {"person_context", "organization_context", "project_context"}


@dataclass(frozen=True)
class Parsed:
    intent: str
    mention: str | None = None
    date_kind: str | None = None
    ownership: str | None = None


@dataclass(frozen=True)
class Source:
    """What an intent reads: rows, their key, date and, if any, the column of their person; summary columns."""

    rows: DataFrame
    kind: str
    key: str
    date: str
    person: str | None = None
    summary: tuple[str, ...] = ()


@dataclass
class Answer:
    status: str
    parsed: Parsed
    rows: DataFrame | None = None
    candidates: list[str] = field(default_factory=list)


def _first(question: str, rules: list[tuple[str, str]]) -> str | None:
    return next((value for pattern, value in rules if re.search(pattern, question, re.I)), None)


def parse(question: str, fallback: Callable[[str], dict] | None = None) -> Parsed:
    """The rules' parse; a fallback is asked only when no rule matches, and an answer that is no known intent is dropped."""
    intent = _first(question, classify.INTENTS) or "unsupported"
    names = (m.strip() for m in re.findall(classify.MENTION.removeprefix("(?i)"), question, re.I))
    mention = next((m for m in names if m and m.split()[0].lower() not in classify.NOT_NAMES), None)
    ownership = _first(question, classify.OWNERSHIP) if intent == "commitments" else None
    if intent == "unsupported" and fallback is not None:
        try:
            found = fallback(question).get("intent")
        except Exception:  # any failure of the callback keeps the rules' parse
            found = None
        intent = found if found in {v for _, v in classify.INTENTS} else intent
    return Parsed(intent, mention, _first(question, classify.DATE_KINDS), ownership)


def resolved(name: str, people: DataFrame, key: str, label: str, most: int = 5) -> list[tuple[str, str]]:
    """Up to `most` (id, name) whose tokens hold the name's tokens or are held by them; exact names come before all others."""
    asked = F.array_distinct(F.array_remove(F.split(text.normalize_text(F.lit(name)), " "), ""))
    rows = people.select(F.col(key).cast("string").alias("id"), F.col(label).alias("name"), text.tokens(F.col(label)).alias("t"))
    hit = rows.where((F.size(asked) > 0) & ((F.size(F.array_except(asked, "t")) == 0) | (F.size(F.array_except("t", asked)) == 0)))
    exact = (text.normalize_text(F.col("name")) == text.normalize_text(F.lit(name))).cast("int")
    found = hit.select("id", "name", exact.alias("e")).orderBy(F.desc("e"), "id").limit(most).collect()
    best = [r for r in found if r.e] or found
    return [(r.id, r.name) for r in best]


def ask(question: str, now: datetime, sources: dict[str, Source], people: DataFrame, key: str, label: str, zone: str = "UTC", limit: int = 50, strict: bool = False) -> Answer:
    """The answer to a question. For list intents an unknown person is passed over, unless strict."""
    parsed = parse(question)
    if parsed.intent not in sources:
        return Answer(UNSUPPORTED, parsed)
    found = resolved(parsed.mention, people, key, label) if parsed.mention else []
    if parsed.mention and len(found) != 1 and (strict or parsed.intent in CONTEXT):
        return Answer(AMBIGUOUS if found else NO_MATCH, parsed, None, [n for _, n in found])
    source = sources[parsed.intent]
    rows = source.rows
    if source.person and len(found) == 1:
        rows = rows.where(F.col(source.person).cast("string") == found[0][0])
    kind = parsed.date_kind or "all_time"
    rows = retrieve.retrieved(rows, F.col(source.date), source.key, kind, dates.date_range(kind, now, zone), limit)
    return Answer(OK, parsed, retrieve.evidence(rows, source.kind, source.key, list(source.summary), source.date))


def wording(status: str, n: int, kind: str) -> str:
    """The plain answer by status and count."""
    words = {AMBIGUOUS: "More than one match; please say which.", NO_MATCH: "No match for that name.", UNSUPPORTED: "That question is not supported."}
    return words.get(status) or (f"{n} {kind} found." if n else f"No {kind} found.")


# Extension points.

PROVIDERS: dict[str, Callable] = {}


def provider(name: str) -> Callable:
    """Register a factory of an analyzer, mail source or calendar sink under a name."""

    def add(f: Callable) -> Callable:
        PROVIDERS[name] = f
        return f

    return add


def made(name: str, *args):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](*args)


def retried(call: Callable[[], dict], valid: Callable[[dict], bool], times: int = 2) -> dict:
    """The first valid output of a call that is made at most so often."""
    for _ in range(times):
        if valid(out := call()):
            return out
    raise ValueError("no valid output")


# Resumable runs and layout checks.


def remaining(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows that the run's ledger(key, status) does not name as done; numeric keys, so that 1000 comes after 999."""
    done = ledger.where("status = 'done'").select(F.col(key))
    return df.join(done, key, "left_anti")


def unique_faults(*specs: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """(table, keys, duplicates) for each key that should be unique: rows past the first of each value; nulls are no values."""
    parts = []
    for name, df, keys in specs:
        rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(rows.agg(F.lit(name).alias("table"), F.lit(",".join(keys)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
