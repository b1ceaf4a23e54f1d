"""Text functions: normal forms, slugs, domains, tokens. All are column expressions, but for those at the end."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words and what they stand for.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
TENS = {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
NUMBERS = [("one hundred", "100"), *((w, str(k)) for k, w in enumerate(NUMBER_WORDS)), *((w, str(n)) for w, n in TENS.items())]

# Attribute patterns over normalized text, in order; the fourth and fifth are ungrouped on purpose.
FACT_KEYS = [
    (r"\b(seats?|users?|licen[sc]es?)\b", "seat_count"),
    (r"\bbudget\b", "budget"),
    (r"\bclose(?:ing)? date\b", "close_date"),
    (r"\bpricing tier|plan tier\b", "pricing_tier"),
    (r"\bcontract length|term length\b", "contract_length"),
]

# Words that do not tell organizations apart.
ORG_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "group", "technologies", "analytics", "solutions", "co"]

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_subject(c: Column) -> Column:
    """Without leading re:, fwd:, fw: (any number, any case), with single spaces."""
    return collapse(F.regexp_replace(F.trim(c), r"(?i)^(\s*(re|fwd|fw)\s*:\s*)+", ""))


def normalize_text(c: Column) -> Column:
    """Trimmed, lower-cased, number words as digits, without punctuation, with single spaces."""
    hundred, *single = NUMBERS
    digits = F.create_map(*[F.lit(x) for pair in single for x in pair])
    parts = F.split(F.regexp_replace(F.lower(F.trim(c)), rf"\b{hundred[0]}\b", hundred[1]), r"\b")  # words and what is between them
    folded = F.array_join(F.transform(parts, lambda w: F.when(F.length(w).between(3, 9), F.coalesce(F.try_element_at(digits, w), w)).otherwise(w)), "")
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", ""))


def slug_of_text(normal: Column) -> Column:
    """Slug of a normalized text."""
    return F.regexp_replace(normal, r"\s+", "_")


def slug_of_name(c: Column) -> Column:
    """ASCII slug with hyphens; `unknown` where nothing is left."""
    slug = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", " "))
    return F.coalesce(F.nullif(F.regexp_replace(slug, " ", "-"), F.lit("")), F.lit("unknown"))


def fact_key(normal: Column) -> Column:
    """The key of a fact by its normalized text: select normalize_text() first, so that it is computed once."""
    out = F.when(normal.rlike(FACT_KEYS[0][0]), FACT_KEYS[0][1])
    for pattern, key in FACT_KEYS[1:]:
        out = out.when(normal.rlike(pattern), key)
    return out.otherwise(slug_of_text(normal))


def leading_number(normal: Column) -> Column:
    """The first run of digits anywhere in a normalized text."""
    return F.regexp_extract(normal, r"(\d+)", 1).try_cast("long")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalize_text(c), " "), ""))


def org_tokens(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.array_except(F.array_remove(F.split(plain, r"\s+"), ""), F.array(*map(F.lit, ORG_SUFFIXES)))


def website_domain(c: Column) -> Column:
    host = F.split_part(F.regexp_replace(c, r"^https?://", ""), F.lit("/"), F.lit(1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def email_domain(c: Column) -> Column:
    """Lower-cased domain; null for a malformed address: a list of addresses, or not exactly one @."""
    ok = ~c.contains(";") & ~c.contains(",") & (F.length(c) - F.length(F.replace(c, F.lit("@"))) == 1)
    return F.when(ok, F.nullif(F.lower(F.trim(F.split_part(c, F.lit("@"), F.lit(2)))), F.lit("")))


def emails_in(c: Column) -> Column:
    """Distinct lower-cased addresses in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), 1), F.lower)))


def domains_in(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(emails_in(c), lambda e: F.split_part(e, F.lit("@"), F.lit(2)))))


def short_nickname(name: Column, other: Column) -> Column:
    """`name` is a single token of at most three letters, and `other` is not that token alone. Both are arrays of distinct tokens."""
    return (F.size(name) == 1) & (F.length(F.get(name, F.lit(0))) <= 3) & ~((F.size(other) == 1) & F.arrays_overlap(name, other))


def envelope(addresses: Column) -> Column:
    """Addresses once each, whatever the case of their letters, as they were first written."""
    low = F.transform(addresses, F.lower)
    return F.filter(addresses, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def meeting_fingerprint(title: Column, start: Column, end: Column) -> Column:
    """What tells one proposed meeting from another: its title and times, in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws("_", title, iso(start), iso(end))


def json_block(c: Column) -> Column:
    """The JSON object that a text, less the code fence around it, starts with; what follows it does not count. Null if there is none."""
    bare = F.trim(c, F.lit(" \t\r\n"))
    bare = F.trim(F.regexp_replace(bare, r"(?is)\A```(?:json)?\s*\n?(.*?)\n?```\z", "$1"), F.lit(" \t\r\n"))
    return F.when(bare.startswith("{"), F.get_json_object(bare, "$"))


def normalize_message(subject: Column, body: Column) -> tuple[Column, Column]:
    """Subject and body of a mail in normal form."""
    return normalize_subject(subject), collapse(F.trim(body, F.lit(" \t\r\n")))


def normalize_address(address: Column) -> Column:
    """struct(name, email) with the email lower-cased."""
    return F.struct(address["name"].alias("name"), F.lower(address["email"]).alias("email"))


@F.pandas_udf(T.StringType())
def project_name(names: pd.Series) -> pd.Series:
    """Accents stripped and joiners (+ & / -) as spaces; normalize_text() goes over the result."""

    def plain(x: str | None) -> str | None:
        if x is None:
            return None
        x = "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))
        return "".join(" " if ch in "+&/-" else ch for ch in x)

    return names.map(plain)


def sorted_token_ratio(a: str | None, b: str | None) -> float:
    """100 * 2 * LCS / (|a| + |b|) over the texts' tokens in sorted order."""
    if a is None or b is None:
        return 0.0
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a and not b:
        return 100.0
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; bit k of `open_` is 0 where a row of the table steps up at a[k]."""
    at: dict[str, int] = {}
    for k, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << k
    full = open_ = (1 << len(a)) - 1
    for ch in b:
        hit = open_ & at.get(ch, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sorted_token_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
