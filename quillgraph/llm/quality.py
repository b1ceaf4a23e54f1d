"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document. The ledger holds the measurements and one long `fail_bits`, in which bit k is set where
rule k fails. A policy is a version, a name and a set of rules; applying it is one bitwise and. Ablations (what each rule removes
alone, and what would return without it) come from the counts of the distinct bit patterns, never from the texts again.

Defined results: a null or empty text has no word, measures 0 and fails the base (n_words < 20). Repeated rows and ids are judged
row by row. Columns other than doc_id and text are ignored. An empty table gives an empty ledger. Windows are found by sorting a
document's own 64-bit window hashes, n log n in its length, whatever the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, SPACE_RE, replaced

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """bit: its place in fail_bits, never reused. fails: a predicate over the measurements."""

    bit: int
    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


RULES = (
    Rule(0, "few_words", lambda: _c("n_words") < 20),
    Rule(1, "repeated_windows", lambda: 100 * _c("n_repeat_words") > 30 * _c("n_words")),
    Rule(2, "symbols", lambda: 100 * _c("n_symbols") > 15 * _c("n_words")),
    Rule(3, "shouting", lambda: 100 * _c("n_upper") > 40 * _c("word_chars")),
    Rule(4, "exclamations", lambda: 100 * _c("n_exclaims") > 25 * _c("n_words")),
    Rule(5, "repeated_lines", lambda: (_c("n_dup_lines") >= 2) & (100 * _c("n_dup_lines") > 50 * _c("n_lines"))),
    Rule(7, "stutter", lambda: 100 * _c("n_stutter") > 30 * _c("n_words")),
    Rule(6, "word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
)


@dataclass(frozen=True)
class Policy:
    version: int
    name: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy(1, "base", ("few_words", "repeated_windows"))
STRICT = Policy(2, "strict", tuple(r.name for r in RULES))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims", "n_stutter")


def joined(h: str, step: int) -> Callable[[Column, Column], Column]:
    """Hash of a window and of the one `step` words on."""
    return lambda x, i: F.xxhash64(x, F.get(F.col(h), i + F.lit(step)))


def measured(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the measurements of every row of docs.

    Each select names its arrays once, so that the optimizer computes them once a row and not again inside a lambda.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(f"k.{c}").alias(f"k_{c}") for c in carried]
    rows = docs.select(F.struct(*carried).alias("k"), text.alias("text")).select(
        *keep,
        F.array_remove(F.split("text", SPACE_RE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(replaced(x, SPACE)) > 0).alias("lines"),
        F.length(replaced(_c("text"), SPACE)).alias("word_chars"),
        (F.length("text") - F.length(replaced(_c("text"), SYMBOLS))).alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).alias("n_upper"),
        (F.length("text") - F.length(replaced(_c("text"), "!"))).alias("n_exclaims"),
    )
    kept = [f"k_{c}" for c in carried]
    plain = ["word_chars", "n_symbols", "n_upper", "n_exclaims"]
    rows = rows.select(
        *kept, *plain,
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    plain += ["n_words", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, *plain, F.size(F.filter("h1", lambda x, i: x == F.get(F.col("h1"), i - 1))).alias("n_stutter"), "h1")
    plain += ["n_stutter"]
    for step in (1, 2, 4):  # h1, h2, h4, h8: hashes of windows of so many words
        h, nxt = f"h{step}", f"h{2 * step}"
        rows = rows.select(*kept, *plain, F.transform(h, joined(h, step)).alias(nxt))
    rows = rows.select(*kept, *plain, F.slice("h8", 1, F.greatest(_c("n_words") - (WINDOW - 1), F.lit(0))).alias("h8"))
    rows = rows.select(
        *kept, *plain,
        F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    again = F.filter("sorted", lambda x, j: x.h.eqNullSafe(F.get(F.col("sorted"), j - 1).h) | x.h.eqNullSafe(F.get(F.col("sorted"), j + 1).h))
    rows = rows.select(*kept, *plain, F.sort_array(F.transform(again, lambda x: x.i)).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("int"), lambda a, b: a + b
    )
    # The zero is not deterministic, which keeps a later filter above this select: pushed below, it would repeat every measurement.
    zero = F.least(F.monotonically_increasing_id(), F.lit(0))
    rows = rows.select(*kept, *plain, (F.coalesce(covered, F.lit(0)) + zero).alias("n_repeat_words"))
    return rows.select(*[F.col(f"k_{c}").alias(c) for c in carried], *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row of docs."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask()).cast("long")) == 0


def applied(rows: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a column <name>_v<version>, true where the row passes, for each policy."""
    return rows.withColumns({f"{p.name}_v{p.version}": passes(p) for p in policies})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    Counts of bit patterns are summed first, so at most 2^rules rows meet in the second step.
    """
    mask = policy.mask()
    seen = rows.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    parts = [F.struct(F.lit(r.name).alias("rule"), total(F.col("bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("n_fail"), total(F.col("bits") == (1 << r.bit)).alias("n_only"), total(F.col("bits").isin(0, 1 << r.bit)).alias("n_kept_without")) for r in RULES if r.name in policy.rules]
    return seen.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def judged(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """doc_id, measurements, fail_bits, base_failed and kept of every row of docs."""
    return ledger(docs).withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})


def accepted(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs, all columns, that pass the base and the policy. The text is measured beside its row, without a join."""
    bits = F.lit(False)
    for r in RULES:
        if r.name in {*BASE.rules, *policy.rules}:
            bits = bits | r.fails()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return measured(row, ("row",)).where(~bits).select("row.*")


#: judged() over `documents` as DuckDB SQL, for the columns of the query.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM base WHERE len(w) >= 8),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 7], ' ')) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaims,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM base LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 15 * n_words OR 100 * n_upper > 40 * word_chars
    OR 100 * n_exclaims > 25 * n_words OR (n_dup_lines >= 2 AND 100 * n_dup_lines > 50 * n_lines) OR 100 * n_stutter > 30 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m"""
