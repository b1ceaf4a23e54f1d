"""Conversation repair against trying all edits, damage by hand, long undecided conversations, odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from quillgraph.llm import queries, repair

GOOD = re.compile("(s?(ua)+)?")
DATA = "/root/testdata/sf0.001"


def faults_by_hand(turns):
    """(role, text) in order -> fault of each."""
    out, seen = [], set()
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, text) over all edits with at most two inserts in a row."""
    faults = faults_by_hand(turns)
    best = {("", ""): (0, "", ())}  # by the roles so far: all edits of a turn are tried

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for (roles, _), (cost, audit, kept) in list(out.items()):
                for r in "ua":
                    put(out, roles + r, (cost + 5, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[r], ""))))
        return out

    def put(out, roles, value):
        if not any(GOOD.fullmatch(roles + more) for more in ("", "a", "ua")):
            return
        short = ("" if not roles else "s" if roles == "s" else roles[-1], "")
        if short not in out or value[:2] < out[short][:2]:
            out[short] = value

    for (role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for (roles, _), (cost, audit, kept) in inserted(best).items():
            full = {"": "", "s": "s", "u": "u", "a": "ua"}[roles]
            put(after, full, (cost + 2, audit + "D", kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                put(after, full + (role[:1] or "?"), (cost + more, audit + "K", (*kept, (role, text))))
                for r in ("user", "assistant"):
                    if r[0] != role[:1]:
                        put(after, full + r[0], (cost + 1 + more, audit + "R", (*kept, (r, text))))
        best = after
    cost, audit, kept = min(v for (roles, _), v in inserted(best).items() if roles in ("", "a"))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)


def every_edit(turns):
    """The same by plain enumeration of whole edit lists; for few turns."""
    faults, found = faults_by_hand(turns), []
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product("DKua", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)) or any(e in "ua" and e == t[0][:1] for e, t in zip(edits, turns, strict=True)):
            continue
        for ins in itertools.product(gaps, repeat=len(turns) + 1):
            cost, audit, roles = 0, "", ""
            for k, (edit, gap) in enumerate(zip(edits, ins, strict=False)):
                cost, audit, roles = cost + 5 * len(gap), audit + "I" * len(gap), roles + gap
                cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if faults[k] == "truncated" and edit != "D" else 0)
                audit += edit if edit in "DK" else "R"
                roles += "" if edit == "D" else turns[k][0][:1] or " " if edit == "K" else edit
            cost, audit, roles = cost + 5 * len(ins[-1]), audit + "I" * len(ins[-1]), roles + ins[-1]
            if GOOD.fullmatch(roles):
                found.append((cost, audit))
    return min(found)


def plain(turns):
    c = repair.Conversation()
    got = [e for t, f in zip(turns, faults_by_hand(turns), strict=True) for e in c.add(repair.Turn(0, *t, f, False))]
    got += c.close()
    cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] + (5 if t and t.fault == "truncated" and e != "D" else 0) for e, _, t in got)
    return cost, "".join(e for e, _, _ in got), "\n".join(f"{r}:{t.text if t else ''}" for e, r, t in got if e != "D")


def made(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], [" ", "tool"], ["assistant"], ["system"], ["user", "user", " ", "assistant", "system", "", "usher"]])
    texts = rng.choice([[f"Text {k}." for k in range(50)], ["Yes.", "No", " ", "Why?", "Well", "", "So!"], ["cut", "Done.", "off"]])
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_cheapest_edits_against_all_edits():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(25):
            turns = made(rng, n)
            assert plain(turns)[:2] == every_edit(turns) == cheapest(turns)[:2], turns


def test_longer_conversations_against_whole_edit_strings():
    rng = random.Random(8)
    for n in (5, 9, 30, 90, 200, 700):
        for _ in range(30):
            turns = made(rng, n)
            assert plain(turns) == cheapest(turns), turns


def test_what_is_decided_leaves():
    c, most = repair.Conversation(), 0
    for k in range(20_000):
        list(c.add(repair.Turn(k, ("user", "assistant")[k % 2 if k % 37 else 0], f"{k}.", None, False)))
        most = max(most, len(c.held))
    assert most <= 2 * repair.OFTEN


def report_by_hand(rows):
    """conv_id -> the query's row, by the rules one after the other."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv_id] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv_id, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults = faults_by_hand([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, text = cheapest([t[1:] for t in turns])
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv_id] = (conv_id, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_query_against_the_rules(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op13_conversation_repair"](spark, data).collect()
    want = report_by_hand(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.conv_id]


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-2, 30)]), rng.choice([None, "user", "assistant", "system", "tool", ""]), rng.choice([None, "", "ok.", "no", "x " * 40_000 + "!"])) for _ in range(200)]
    rows += [(50 + k, k, "user", f"only {k}.") for k in range(40)]  # some lose their only turn
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "conv_id long, turn long, role string, text string, fault string, edit string")
    want = report_by_hand(rows)
    got = repair.reported(df, repair.damaged(df)).collect()
    assert {r.conv_id: tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.audit == "" and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in got)
    turns = repair.repaired(df).where("conv_id = 1 and edit <> 'D'").orderBy("place").collect()
    assert GOOD.fullmatch("".join(t.role[0] for t in turns))
    assert repair.reported(df.limit(0), repair.damaged(df.limit(0))).count() == 0
