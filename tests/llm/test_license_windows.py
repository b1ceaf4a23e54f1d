"""Licence windows: by hand, and against all runs of words."""

import random

import duckdb
from quillgraph.llm import licenses as lw


def pairs_of(text):
    w = lw.re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def all_windows(pairs, q):
    """(dice, common, start, end) of every run of words, of any length."""
    for i in range(len(pairs)):
        seen = set()
        for j in range(i, len(pairs)):
            seen.add(pairs[j])
            yield 2.0 * len(q & seen) / (len(seen) + len(q)), len(q & seen), i, j


def brute(text, known, t=0.8):
    pairs, hits = pairs_of(text), []
    for name, body in known.items():
        q, best = set(lw.bigrams(body)), {}
        for dice, common, i, j in all_windows(pairs, q):
            if pairs[i] in q and (i == 0 or pairs[i - 1] not in q) and dice > best.get(i, (0,))[0]:
                best[i] = (dice, common, j)
        hits += [(-c, -d, name.split("/")[0], i, j) for i, (d, c, j) in best.items() if d >= t - 1e-12]
    kept = []
    for h in sorted(hits):
        if all(x[3] > h[4] + 1 or h[3] > x[4] + 1 for x in kept):
            kept.append(h)
    return len(kept), ",".join(sorted({h[2] for h in kept})) or None


def test_whole_texts_headers_and_wrapped_notices(spark):
    all_ = lw.texts()
    t = [
        "Copyright (c) 2020 A. Author\n\n" + all_["MIT/text"], "x y\n" + all_["Apache-2.0/text"], all_["BSD-2-Clause/text"], all_["BSD-3-Clause/text"], "/* " + all_["Apache-2.0/header"] + " */", "Released under the\n# MIT License.",
        "We met at noon and this text is licensed under CC\nBY-NC 4.0. It then goes on for a while.", "Some line.\nAll rights reserved.\nMore.", "Licensed to drive. All rights are reserved for members.", None, "", "word",
        "This work is licensed under the GNU General Public License, version 2. And released under the MIT License.",
    ]
    rows = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in lw.scanned(rows).collect()}
    assert [got[i] for i in range(13)] == ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "Proprietary", None, None, None, None, "GPL-2.0,MIT"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(t)))
    want = con.execute(lw.sql())
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in lw.scanned(rows).collect())


def test_covers_are_necessary():
    for name, body in lw.texts().items():
        pairs = lw.bigrams(body)
        words = set(lw.cover(pairs))
        assert sum(not words & set(p.split()) for p in pairs) < lw.least(len(pairs), 0.8), name


def test_windows_equal_all_runs(spark):
    random.seed(3)
    known = {k: v for k, v in lw.texts().items() if len(lw.bigrams(v)) <= 80}
    texts = []
    for k in range(60):
        words = [random.choice("the a of under license released version 2 0 all rights to by cc".split()) for _ in range(random.randrange(30))]
        for body in random.sample(sorted(known.values()), random.randrange(3)):
            w = body.split()
            for _ in range(k % 4):
                at = random.randrange(len(w))
                w[at : at + random.randrange(2)] = [random.choice(("the", "of", "work"))]
            at = random.randrange(len(words) + 1)
            words[at:at] = w
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_hits, r.licenses) for r in lw.scanned(rows, known).collect()}
    want = {i: brute(x, known) for i, x in enumerate(texts)}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 20
    for i, x in enumerate(texts):  # no window of any start or end is lost
        best = max((d for v in known.values() for d, *_ in all_windows(pairs_of(x), set(lw.bigrams(v)))), default=0)
        assert (got[i][0] > 0) == (best >= 0.8 - 1e-12)


def test_repeats_do_not_end_a_window(spark):
    """A window may hold a bigram many times: only distinct ones count."""
    body = lw.texts()["Apache-2.0/header"].split()
    stuttered = " ".join(" ".join([w, body[i + 1], w, body[i + 1]] if i + 1 < len(body) else [w]) for i, w in enumerate(body) if i % 2 == 0)
    filled = " ".join(body[:40]) + " the work the work" * 500 + " " + " ".join(body[40:])
    known = {"Apache-2.0/header": " ".join(body)}
    rows = spark.createDataFrame([(0, stuttered), (1, filled)], "doc_id long, text string")
    got = {r.doc_id: r.best_dice for r in lw.scanned(rows, known).collect()}
    q = set(lw.bigrams(known["Apache-2.0/header"]))
    for i, x in enumerate((stuttered, filled)):
        assert got[i] == next((d for d in [max(d for d, _, s, _ in all_windows(pairs_of(x), q))] if d >= 0.8), 0.0)
    assert got[1] > 0.9


def test_every_template_meets_its_own_text(spark):
    rows = spark.createDataFrame(sorted(lw.texts().items()), "doc_id string, text string")
    got = {r.doc_id: (r.best_license, r.best_dice, r.n_hits) for r in lw.scanned(rows).collect()}
    assert got == {k: (k.split("/")[0], 1.0, 1) for k in lw.texts()}


def test_noisy_whole_licences(spark):
    """Every ninth word is another: Dice stays above 0.8 only while less than a tenth of the bigrams are gone."""
    random.seed(4)
    rows = []
    for k in ("LGPL-3.0/text", "MPL-2.0/text", "Apache-2.0/text"):
        words = lw.texts()[k].split()
        rows.append((k, " ".join(w if random.random() > 0.05 else f"x{random.randrange(10**6)}" for w in words) + " and more"))
    got = {r.doc_id: (r.best_license, r.best_dice) for r in lw.scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k, x in rows:
        q, seen = set(lw.bigrams(lw.texts()[k])), set(pairs_of(x))
        assert got[k][0] == k.split("/")[0] and got[k][1] >= 2 * len(q & seen) / (len(q) + len(seen)) - 1e-12


def test_odd_tables(odd, clashing, empty):
    assert lw.scanned(empty).count() == 0 and lw.scanned(odd).count() == lw.scanned(clashing).count() == 10
    got = {r.doc_id: (r.n_hits, r.licenses, r.best_license, r.best_dice) for r in lw.scanned(clashing).collect()}
    assert set(got.values()) == {(0, None, None, 0.0)}
