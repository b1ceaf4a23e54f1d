"""Rules checked by hand or against a plain Python version."""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from quillgraph.functions import arrays, classify, dates, text
from quillgraph.operators import graph, joins, maintenance, resolve, retrieve, windows
from quillgraph.sources import export

UTC = ZoneInfo("UTC")


def values(spark, rows, column, name="x string"):
    return [r[0] for r in spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {name}").orderBy("k").select(column).collect()]


def test_subjects_and_texts(spark):
    assert values(spark, ["Re: FW: re : A  b", "report", None, " fwd:x"], text.normalize_subject(F.col("x"))) == ["A b", "report", None, "x"]
    assert values(spark, ["One hundred Seats!", "thirty two", "café: été", ""], text.normalize_text(F.col("x"))) == ["100 seats", "30 2", "café été", ""]
    assert values(spark, ["A & B", "--", None], text.slug_of_name(F.col("x"))) == ["a-b", "unknown", "unknown"]
    assert values(spark, ["Acme Group, Inc.", ""], F.array_join(text.org_tokens(F.col("x")), " ")) == ["acme", ""]
    assert values(spark, ["https://www.a.example/x", "b.example", ""], text.website_domain(F.col("x"))) == ["a.example", "b.example", None]


def test_known_fuzzy_scores(spark):
    pairs = [("pricing request", "proposal request", 64.52), ("demo request", "procurement request", 64.52), ("data migration concerns", "concerns about data migration", 88.46), ("", "", 100.0)]
    for a, b, score in pairs:
        assert round(text.sorted_token_ratio(a, b), 2) == score
    assert values(spark, [(a, b) for a, b, _ in pairs], F.round(text.fuzzy_ratio("x", "y"), 2), "x string, y string") == [s for *_, s in pairs]
    assert values(spark, ["Café-Bar + Ünï", None], text.project_name("x")) == ["Cafe Bar   Uni", None]


def test_questions(spark):
    asked = ["prepare for the meeting with Ann Lee", "context on Bo", "what do I owe Cy today?", "for my meeting with this person", "zzz"]
    assert values(spark, asked, classify.intent(F.col("x"))) == ["meeting_preparation", "person_context", "commitments", "meetings", "unsupported"]
    assert values(spark, asked, classify.mention(F.col("x"))) == ["Ann Lee", "Bo", None, None, None]
    assert values(spark, ["I will meet you", "I'll send it", "can you?"], F.col("x").rlike(classify.MINE)) == [False, True, False]


@pytest.mark.parametrize(
    ("kind", "start", "end"),
    [("today", "2026-12-31", "2027-01-01"), ("this_week", "2026-12-28", "2027-01-04"), ("next_month", "2027-01-01", "2027-02-01"), ("this_month", "2026-12-01", "2027-01-01"), ("last_week", "2026-12-21", "2026-12-28")],
)
def test_ranges_over_the_year_and_zone(kind, start, end):
    zone = ZoneInfo("Asia/Kolkata")
    low, high = dates.date_range(kind, datetime(2026, 12, 30, 20, tzinfo=UTC), "Asia/Kolkata")
    assert (low, high) == tuple(datetime.fromisoformat(x).replace(tzinfo=zone) for x in (start, end))


def test_ranges_need_their_bounds():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    for kind in ("between", "before", "after", "someday"):
        with pytest.raises(ValueError):
            dates.date_range(kind, now)
    assert dates.date_range("recent", now) == (now - timedelta(days=7), now)


def test_in_range_takes_null_dates_for_all_time_only(spark):
    rows = spark.createDataFrame([(1, None), (2, datetime(2026, 1, 1)), (3, datetime(2026, 1, 2))], "k int, at timestamp_ntz")
    day = (datetime(2026, 1, 1, tzinfo=UTC), datetime(2026, 1, 2, tzinfo=UTC))
    found = lambda kind, b: [r.k for r in rows.where(dates.in_range(F.col("at"), kind, b)).orderBy("k").collect()]
    assert found("today", day) == [2] and found("all_time", (None, None)) == [1, 2, 3] and found("latest", (None, None)) == [2, 3]


def test_phrases(spark):
    now = F.lit("2026-06-05 15:30:00").cast("timestamp_ntz")
    got = values(spark, ["June 5th", "June 4", "Feb 30", "tomorrow", "friday", "in 2 hours", "in a week", "next month", None], dates.resolved_phrase(F.col("x"), now))
    at = lambda *x: datetime(*x)
    assert [(r["at"], r["kind"]) for r in got] == [
        (at(2026, 6, 5), "stated"), (at(2027, 6, 4), "stated"), (None, "window"), (at(2026, 6, 6, 15, 30), "inferred"), (at(2026, 6, 12, 15, 30), "inferred"), (at(2026, 6, 5, 17, 30), "inferred"),
        (at(2026, 6, 12, 15, 30), "inferred"), (None, "window"), (None, None),
    ]
    assert values(spark, ["at 3pm", "12am", "at 25", "none", "10:30"], dates.clock(F.col("x"))) == [900, 0, None, None, 630]
    assert values(spark, ["for 2 hours", "for 45 minutes", ""], dates.duration(F.col("x"))) == [120, 45, 30]


def test_merges(spark):
    row = spark.range(1).select(
        arrays.merged_list(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a"))).alias("l"),
        arrays.merged_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))).alias("m"),
        arrays.set_hash(F.array(F.lit("b"), F.lit("a"))).alias("h"),
    ).first()
    assert row.l == ["b", "c"] and row.m == {"b": "2", "c": "3"} and len(row.h) == 16


def test_chain_errors(spark):
    far = [(f"d{k}", f"d{k + 1}") for k in range(11)] + [("d11", None)]
    rows = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("s", "s"), ("m", "gone"), *far]
    df = spark.createDataFrame([(a, b, b is not None or a == "n") for a, b in [*rows, ("n", None)]], "id string, target string, merged boolean")
    got = {r.id: (r.canonical_id, r.hops, r.error) for r in graph.canonical(df, "id", "target", F.col("merged")).collect()}
    assert got["a"] == ("c", 2, None) and got["c"] == ("c", 0, None) and got["x"][2] == "cycle" and got["s"][2] == "self" and got["m"][2] == "missing" and got["n"][2] == "no_target"
    assert got["d2"] == ("d11", 9, None) and got["d1"][2] == "depth" and len(got) == len(rows) + 1


def test_threads_by_signal(spark):
    at = lambda d: datetime(2026, 1, d)
    mails = [
        ("m1", "t1", None, [], "Plan", ["a", "b"], at(1)), ("m2", "t1", None, [], "Other", ["c"], at(2)), ("m3", None, "m1", [], "X", ["z"], at(3)), ("m4", None, None, ["m2"], "Y", ["q"], at(4)),
        ("m5", None, None, [], "Re: Plan", ["b"], at(30)), ("m6", None, None, [], "New", ["b"], at(31)), ("m7", "t9", None, [], "Plan", ["a"], at(5)), ("m8", None, None, [], "Alone", ["k"], at(6)),
    ]
    df = spark.createDataFrame(mails, "message_id string, source_thread_id string, in_reply_to string, references array<string>, subject string, participants array<string>, at timestamp")
    got = {r.message_id: (r.thread_id, r.signal) for r in resolve.threads(df).collect()}
    assert got == {"m1": ("m1", "new"), "m2": ("m1", "source"), "m3": ("m1", "reply"), "m4": ("m1", "references"), "m5": ("m1", "subject"), "m6": ("m1", "recent"), "m7": ("m7", "new"), "m8": ("m8", "new")}


def test_ids_past_999(spark):
    got = {r.id: r.name for r in windows.ids(spark.range(1200), "PER", "name", "id").collect()}
    assert got[0] == "PER-001" and got[998] == "PER-999" and got[1199] == "PER-1200"
    assert windows.ids(spark.range(0), "PER", "name", "id").count() == 0


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert retrieve.among(df, "k", []).count() == 0 and retrieve.matching(df, v="").count() == 2 and retrieve.clamp(0) == 1 and retrieve.clamp(999) == 200
    assert maintenance.without_prefix(df, "a", "v").count() == 1
    with pytest.raises(ValueError):
        maintenance.safe_target("Production_db")
    empty = spark.createDataFrame([], "id int, t array<string>")
    assert joins.token_subsets(empty, empty, "id", "t", "id", "t").count() == 0


def test_export_files(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text('{"label": "x", "messages": [{"id": "1", "threadId": "t", "subject": "s", "sender": "Ann <A@x.example>", "date": "2026-01-01T00:00:00Z", "plaintextBody": "b"}, {"id": "2", "subject": ""}]}')
    raw = export.read_export(spark, str(good))
    assert export.counted(raw).first() == (2, 1)
    row = export.converted(raw).first()
    assert row["from"] == ("Ann", "a@x.example") and row["to"] == [] and row.source_message_id == "1"
    ledger = spark.createDataFrame([], "path string, fingerprint string, all_completed boolean")
    new = export.new_files(spark, str(tmp_path), ledger)
    assert new.count() == 1 and export.new_files(spark, str(tmp_path), new.withColumn("all_completed", F.lit(True))).count() == 0
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        export.read_export(spark, str(tmp_path / "b.json"))
