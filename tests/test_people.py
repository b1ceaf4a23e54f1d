"""People from mentions against a plain fold over all of them, one after the other, without blocks."""

import datetime as dt
import random

from pyspark.sql import functions as F
from quillgraph.functions import text
from quillgraph.operators import people

SCHEMA = "mention string, at timestamp, thread string, email string, name string, org string, role string, sender boolean"


def plain(rows, tokens, normal):
    """rows in order of arrival -> outcome of each, and all people."""
    known, out = [], {}
    for m, at, thread, email, name, org, role, sender in rows:
        email = (email or "").strip().lower()
        shown = name or email or "Unknown"
        t, now = tokens[shown], at
        if email:
            p = next((p for p in known if p["email"] == email), None)
            if p is None:
                known.append({"id": m, "name": shown, "email": email, "org": org or None, "role": role or None, "aliases": [], "threads": [thread] if thread else [], "in": now if sender is True else None, "out": now if sender is False else None})
                out[m] = (m, "created")
                continue
            before = repr(p)
            touch(p, thread, sender, now)
            p["org"] = p["org"] or org or None
            p["role"] = p["role"] or role or None
            if p["name"] == p["email"] and name:
                p["name"] = name
            out[m] = (p["id"], "reused" if repr(p) == before else "updated")
            continue
        found = []
        if normal[org or ""] and t:
            for p in known:
                own, met = tokens[p["name"]], {x for a in p["aliases"] for x in tokens[a]}
                if p["email"] and normal[p["org"] or ""] == normal[org] and (own and (t <= own or own <= t) or t <= met):
                    found.append(p)
        if len(found) == 1:
            p = found[0]
            before = repr(p)
            touch(p, thread, sender, now)
            if shown != p["name"] and shown not in p["aliases"]:
                p["aliases"].append(shown)
            out[m] = (p["id"], "reused" if repr(p) == before else "updated")
            continue
        same = [p for p in known if thread and not p["email"] and thread in p["threads"] and normal[p["name"]] == normal[shown]]
        if len(same) == 1:
            out[m] = (same[0]["id"], "reused")
            continue
        known.append({"id": m, "name": shown, "email": None, "org": org, "role": role, "aliases": [], "threads": [thread] if thread else [], "in": None, "out": None})
        out[m] = (m, "created")
    return out, known


def touch(p, thread, sender, now):
    if thread and thread not in p["threads"]:
        p["threads"].append(thread)
    for key, is_it in (("in", sender is True), ("out", sender is False)):
        if is_it and (p[key] is None or now > p[key]):
            p[key] = now


def check(spark, rows):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    words = sorted({x for r in rows for x in (r[4], r[5], (r[3] or "").strip().lower(), "Unknown", "") if x is not None})
    of = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.tokens(F.col("w")).alias("t"), text.normalize_text(F.col("w")).alias("n")).collect()
    want, known = plain(rows, {r.w: set(r.t) for r in of}, {r.w: r.n for r in of})
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    found = people.folded(spark.createDataFrame(shuffled, SCHEMA)).cache()
    assert {r.mention: (r.person, r.outcome) for r in people.outcomes(found).collect()} == want
    got = {r.person: (r.name, r.email, r.org, r.role, r.aliases, r.threads, r.last_inbound, r.last_outbound) for r in people.records(found).collect()}
    assert got == {p["id"]: (p["name"], p["email"], p["org"], p["role"], p["aliases"], p["threads"], p["in"], p["out"]) for p in known}
    return want, known


def test_an_alias_that_grows_is_met_later(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("a", at(1), "t1", "Ann@X.example", None, None, None, True), ("b", at(2), "t2", "ann@x.example", "Ann", "Acme", "CTO", None), ("c", at(3), "t3", None, "Ann Lee", "ACME", None, False),
        ("d", at(4), "t4", None, "Lee", "acme", None, None), ("e", at(5), "t4", None, "Lee", "Other", None, None), ("f", at(6), "t4", None, "lee", None, None, None), ("g", at(7), "t5", None, "Lee", None, None, None),
        ("h", at(8), "t6", "other@x.example", "Lee Young", "Acme", None, None), ("i", at(9), "t6", None, "Lee", "Acme", None, None),
    ]
    want, known = check(spark, rows)
    assert want["c"] == ("a", "updated") and want["d"][0] == "a"  # Lee is held by the alias Ann Lee only
    assert want["e"] == ("e", "created") and want["f"] == ("e", "reused") and want["g"] == ("g", "created")
    assert want["i"] == ("i", "created")  # two people could be meant now
    assert known[0]["aliases"] == ["Ann Lee", "Lee"]


def test_folds_equal_the_plain_fold(spark):
    rng = random.Random(6)
    first, last, orgs = ["Ann", "Bo", "Cy", "Dee", "ann"], ["Lee", "Kim", "Roe", "Lee-Kim"], ["Acme", "acme ", "Globex", "", None]
    rows = []
    for k in range(500):
        name = rng.choice([None, "", rng.choice(first), f"{rng.choice(first)} {rng.choice(last)}", rng.choice(last), "!!"])
        email = rng.choice([None, None, "", f"p{rng.randrange(25)}@x.example", f" P{rng.randrange(25)}@X.example"])
        rows.append((f"m{k:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(300)), rng.choice([None, *(f"t{i}" for i in range(12))]), email, name, rng.choice(orgs), rng.choice([None, "", "CTO", "CFO"]), rng.choice([None, True, False])))
    want, known = check(spark, rows)
    assert {o for _, o in want.values()} == {"created", "updated", "reused"} and any(len(p["aliases"]) > 1 for p in known)


def test_a_company_is_cut_by_words_and_empty_tables(spark):
    rows = [(f"m{k}", dt.datetime(2024, 1, 1), f"t{k}", f"p{k}@x.example", f"First{k} Last{k}", "Acme", None, None) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert people.records(people.folded(df)).count() == 40 and people.folded(df.limit(0)).count() == 0
