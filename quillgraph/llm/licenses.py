"""Licence scan: licence texts, headers and notices anywhere in a text, by the Dice coefficient of word bigrams, in DataFrame functions only.

A text is lower-cased, `licence` becomes `license`, and its words are its runs of letters and digits. A window is any run of words, so
also within a paragraph or over lines, and of any length. A template of b distinct bigrams is met where a window has a Dice coefficient
of t or more with it, over distinct bigrams; then the window has at most (2 - t) * b / t distinct ones. A window that reaches t has as
much or more, and no fewer bigrams in common, when it grows to the left over neighbours that are the template's; so the places
where a run of the template's bigrams begins are all the starts to try, and one fold from there gives the best end.

Size bounds prune: a window that reaches t has t * b / (2 - t) of the template's bigrams. So it has a word of any set of words that
meets more bigrams than may be missing (`cover`, of long words first): a text without one is left before a bigram is made. Templates
are then tried only on texts that have that many of their bigrams. Two pointers sweep such a text once for each template tried: from
each start as far as the distinct bigrams allow; a start in whose reach are too few of the template's is not folded.

Of windows that overlap, the one with the most bigrams in common stays; then the higher Dice, the first name, the first start. So a
licence's text wins over a notice that it quotes, and two licences that differ in a word are told apart.

Defined results: a null or empty text, or one with fewer than two words, has n_hits 0, null names and best_dice 0; an empty table gives
no row. Repeated rows and ids are scanned row by row; other columns are ignored. All work is done within a row: nothing is shuffled,
joined or collected, so a hot source costs what its rows cost. Texts are scanned whole. A row costs one look at each word; one
that may hold templates, a sort of its bigrams and two steps a word for each template tried, and for each start that has enough of the template's
bigrams within its reach, as many steps as the reach has words.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.html import STOP_WORDS

THRESHOLD = 0.8
#: Templates of up to so many bigrams are looked for together first.
SHORT = 64

# Short notices in common use.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."

# The notices of the line scan, usual headers, and whole licences. A name ends at the slash.
HEADERS = {
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0/header": _GPL.format(2),
    "GPL-3.0/header": _GPL.format(3),
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary/notice": "All rights reserved.",
}


@cache
def texts() -> dict[str, str]:
    """All templates by name: notices, headers and the licences beside this module."""
    whole = {f"{p.stem}/text": p.read_text("utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
    whole["BSD-2-Clause/text"] = re.sub(r"3\. Neither.*?permission\.", "", whole["BSD-3-Clause/text"], flags=re.S)
    return {f"{k.removesuffix('-text')}/{'notice' if not k.endswith('-text') else 'abridged'}": v for k, v in TEMPLATES.items()} | HEADERS | whole


def bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _literal(items: list[str]) -> Column:
    return F.split(F.lit("|".join(items)), r"\|")


def words_of(text: Column) -> Column:
    """Normalised words of a text."""
    return F.array_remove(F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), r"[^\p{L}\p{N}]+"), "")


def least(b: int, t: float) -> int:
    """How many of a template's b bigrams every window has that reaches t."""
    return -int(-(b * t / (2 - t) - 1e-9) // 1)


def cover(pairs: list[str], t: float = THRESHOLD) -> list[str]:
    """Words of which every window has one that reaches t: they meet more of the bigrams than may be missing. Long, rare words first."""
    met: dict[str, set[str]] = {}
    for p in pairs:
        for w in p.split():
            met.setdefault(w, set()).add(p)
    out, covered = [], set()
    for w in sorted(met, key=lambda w: (w in STOP_WORDS, -min(len(w), 8), -len(met[w]), w)):
        if len(covered) > len(pairs) - least(len(pairs), t):
            break
        if met[w] - covered:
            covered |= met[w]
            out.append(w)
    return out


def buckets(pairs: list[str]) -> list[str]:
    """A hash table of bigrams: each bucket's, with `;` before and after each."""
    table = [""] * len(pairs)
    for p in pairs:
        k = zlib.crc32(p.encode()) % len(pairs)
        table[k] = f"{table[k] or ';'}{p};"
    return table


def _neighbours(x: Column, j: Column) -> Column:
    """Place i of a bigram, where the same one is before it (-1: nowhere) and after it (null: nowhere), and its digest."""
    beside = lambda k: F.get(F.col("sorted"), k)
    before = F.when((j > 0) & (beside(j - 1).w == x.w), beside(j - 1).i).otherwise(-1)
    return F.struct(x.i.alias("i"), before.alias("before"), F.when(beside(j + 1).w == x.w, beside(j + 1).i).alias("after"), x.w.alias("w"), F.crc32(x.w.cast("binary")).alias("h"))


def _windows(k: Column, places: Column, t: float) -> Column:
    """The best window of template k (name, b, table) from each start that may reach t."""
    most = F.floor(k.b * ((2 - t) / t) + 1e-9)
    fewest = F.ceil(k.b * (t / (2 - t)) - 1e-9)

    def own(x: Column) -> Column:
        return F.struct(x.i.alias("i"), x.before.alias("before"), x.after.alias("after"), F.contains(F.get(k.table, (x.h % k.b).cast("int")), F.concat(F.lit(";"), x.w, F.lit(";"))).alias("own"))

    def sweep(at: Column) -> Column:
        """(start, end) of the starts with enough bigrams of the template among the first `most` distinct ones from there; end is exclusive."""

        def step(s: Column, _: Column) -> Column:
            there, first = F.get(at, s.hi), F.get(at, s.lo)
            new = there.before < s.lo
            grows = (s.hi < F.size(at)) & (~new | (s.a < most))
            gone = first.after.isNull() | (first.after >= s.hi)
            begins = first.own & ((s.lo == 0) | ~F.get(at, s.lo - 1).own)
            grown = _swept(s.lo, s.hi + 1, s.a + new.cast("int"), s.c + (new & there.own).cast("int"), s.found)
            left = _swept(s.lo + 1, s.hi, s.a - gone.cast("int"), s.c - (gone & first.own).cast("int"), F.when(begins & (s.c >= fewest), F.concat(s.found, F.array(F.struct(s.lo.alias("start"), s.hi.alias("end"))))).otherwise(s.found))
            return F.when(grows, grown).otherwise(left)

        none = F.array().cast("array<struct<start: int, end: int>>")
        zero = _swept(F.lit(0), F.lit(0), F.lit(0), F.lit(0), none)
        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(at)), zero, step, lambda s: s.found)

    def best(at: Column, p: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            a, c = s.a + 1, s.c + x.own.cast("int")
            dice = F.lit(2.0) * c / (a + k.b)
            better = dice > s.dice
            return F.struct(a.alias("a"), c.alias("c"), F.when(better, dice).otherwise(s.dice).alias("dice"), F.when(better, c).otherwise(s.common).alias("common"), F.when(better, x.i).otherwise(s.end).alias("end"))

        zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("common"), p.start.alias("end"))
        new = F.filter(F.slice(at, p.start + 1, p.end - p.start), lambda x: x.before < p.start)
        return F.aggregate(new, zero, step, lambda s: F.struct((-s.common).alias("less"), (-s.dice).alias("far"), k["name"].alias("name"), p.start.alias("start"), s.end.alias("end")))

    # arrays of one, so that what stands in them is made once
    found = F.transform(F.array(F.transform(places, own)), lambda at: F.transform(sweep(at), lambda p: best(at, p)))
    return F.filter(F.flatten(found), lambda h: h.far <= -t + 1e-12)


def _swept(lo: Column, hi: Column, a: Column, c: Column, found: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), a.alias("a"), c.alias("c"), found.alias("found"))


def scanned(docs: DataFrame, known: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_hits (windows that stand), licenses (their distinct names, sorted, joined by a comma), best_license, best_dice, best_words."""
    t = threshold
    sets = {k: p for k, v in sorted((texts() if known is None else known).items()) if (p := bigrams(v))}
    covers = {k: cover(p, t) for k, p in sets.items()}
    short = {k: p for k, p in sets.items() if len(p) <= SHORT}
    none = F.array().cast("array<string>")

    def template(name: str) -> Column:
        return F.struct(F.lit(name.split("/")[0]).alias("name"), F.lit(len(sets[name])).alias("b"), _literal(buckets(sets[name])).alias("table"))

    def enough(found: Column, name: str) -> Column:
        return F.size(found) >= least(len(sets[name]), t)

    rows = docs.select("doc_id", words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect("words", _literal(sorted({w for c in covers.values() for w in c}))).alias("met"))
    made = F.transform(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("words", i), w))
    rows = rows.select("doc_id", "words", "met", F.when(F.size("met") > 0, made).otherwise(none).alias("all"))
    rows = rows.select("*", F.when(F.size("met") > 0, F.array_intersect("all", _literal(list(dict.fromkeys(x for p in short.values() for x in p))))).otherwise(none).alias("few"))
    own = lambda k: F.arrays_overlap("met", _literal(covers[k])) & enough(F.col("few" if k in short else "all"), k)
    tried = [F.when(own(k) & enough(F.array_intersect("few" if k in short else "all", _literal(p)), k), template(k)) for k, p in sets.items()]
    rows = rows.select("doc_id", "words", "all", F.when(F.size("met") > 0, F.array_compact(F.array(*tried))).alias("tried"))
    rows = rows.select("doc_id", "words", "tried", F.when(F.size("tried") > 0, F.sort_array(F.transform("all", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("sorted"))
    rows = rows.select("doc_id", "words", "tried", F.sort_array(F.transform("sorted", _neighbours)).alias("places"))
    rows = rows.select("doc_id", "words", "places", F.transform("tried", lambda k: _windows(k, F.col("places"), t)).alias("found"))

    empty = "array<struct<less: int, far: double, name: string, start: int, end: int>>"
    found = F.coalesce(F.array_sort(F.flatten("found")), F.array().cast(empty))
    rows = rows.select("doc_id", "words", found.alias("hits"))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), lambda s, h: F.when(F.exists(s, lambda x: (x.start <= h.end + 1) & (h.start <= x.end + 1)), s).otherwise(F.concat(s, F.array(h))))
    # The zero is not deterministic, which keeps a later filter above this select: pushed below, it would repeat every window.
    zero = F.monotonically_increasing_id().bitwiseAND(F.lit(0)).cast("int")
    rows = rows.select("doc_id", "words", F.slice(kept, zero + 1, F.size("hits")).alias("hits"))
    top = F.get("hits", F.lit(0))
    return rows.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.when(F.size("hits") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",")).alias("licenses"),
        top["name"].alias("best_license"),
        F.coalesce(-top.far, F.lit(0.0)).alias("best_dice"),
        F.when(F.size("hits") > 0, F.array_join(F.slice("words", F.coalesce(top.start, F.lit(0)) + 1, F.coalesce(top.end - top.start, F.lit(0)) + 2), " ")).alias("best_words"),
    )


def sql(threshold: float = THRESHOLD) -> str:
    """The same scan as DuckDB SQL: all windows that start where a run of a template's bigrams begins, from the texts that have enough of its bigrams."""
    t = threshold
    rows = ", ".join("({}, '{}', '{}')".format(i, k.split("/")[0], v.replace("'", "''")) for i, (k, v) in enumerate(sorted(texts().items())))
    norm = "list_filter(regexp_split_to_array(replace(lower({0}), 'licence', 'license'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE templates AS (SELECT tid, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS q FROM (SELECT tid, name, {norm.format("text")} AS w FROM (VALUES {rows}) v(tid, name, text))),
tp AS (SELECT tid, name, len(q) AS b, floor(len(q) * (2 - {t}::DOUBLE) / {t} + 1e-9)::BIGINT AS longest, unnest(q) AS g FROM templates),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {norm.format("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT rid, pos, w[pos] || ' ' || w[pos + 1] AS g FROM (SELECT rid, w, unnest(range(1, len(w))) AS pos FROM docs)),
occ AS (SELECT *, lag(pos) OVER (PARTITION BY rid, g ORDER BY pos) AS prev FROM places),
cand AS (SELECT rid, tid FROM occ JOIN tp USING (g) WHERE prev IS NULL GROUP BY rid, tid, b HAVING count(*) * (2 - {t}::DOUBLE) >= {t} * b - 1e-9),
own AS (SELECT rid, tid, pos, name, b, longest FROM cand JOIN tp USING (tid) JOIN occ USING (rid, g)),
ends AS (
  SELECT s.rid, s.tid, s.name, s.b, s.longest, s.pos AS s, o.pos AS e, sum(CASE WHEN coalesce(o.prev, 0) < s.pos THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN coalesce(o.prev, 0) < s.pos AND x.pos IS NOT NULL THEN 1 ELSE 0 END) OVER w AS c
  FROM (SELECT * FROM own y WHERE NOT EXISTS (SELECT 1 FROM own z WHERE z.rid = y.rid AND z.tid = y.tid AND z.pos = y.pos - 1)) s JOIN occ o ON o.rid = s.rid AND o.pos >= s.pos LEFT JOIN own x ON x.rid = s.rid AND x.tid = s.tid AND x.pos = o.pos
  WINDOW w AS (PARTITION BY s.rid, s.tid, s.pos ORDER BY o.pos)
),
best AS (SELECT rid, name, s, e, c, 2.0::DOUBLE * c / (a + b) AS dice FROM ends WHERE a <= longest QUALIFY row_number() OVER (PARTITION BY rid, tid, s ORDER BY 2.0::DOUBLE * c / (a + b) DESC, e) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY c DESC, dice DESC, name, s, e) AS k FROM best WHERE dice >= {t}::DOUBLE - 1e-12),
stands(rid, k, kept) AS (
  SELECT rid, 1::BIGINT, [k] FROM hits WHERE k = 1
  UNION ALL SELECT h.rid, h.k, CASE WHEN EXISTS (SELECT 1 FROM hits x WHERE x.rid = h.rid AND list_contains(r.kept, x.k) AND x.s <= h.e + 1 AND h.s <= x.e + 1) THEN r.kept ELSE list_append(r.kept, h.k) END
  FROM stands r JOIN hits h ON h.rid = r.rid AND h.k = r.k + 1
),
found AS (
  SELECT r.rid, any_value(len(r.kept)) AS n_hits, string_agg(DISTINCT h.name, ',' ORDER BY h.name) AS licenses, arg_min(h.name, h.k) AS best_license, arg_min(h.dice, h.k) AS best_dice, arg_min(h.s, h.k) AS s, arg_min(h.e, h.k) AS e
  FROM (SELECT rid, arg_max(kept, k) AS kept FROM stands GROUP BY rid) r JOIN hits h ON h.rid = r.rid AND list_contains(r.kept, h.k) GROUP BY r.rid
)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, licenses, best_license, coalesce(best_dice, 0.0)::DOUBLE AS best_dice, array_to_string(list_slice(w, s, e + 1), ' ') AS best_words
FROM docs LEFT JOIN found USING (rid)"""
