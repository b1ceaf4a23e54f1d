"""Exactly-once sink, reminders by timers, context as state: replays, restarts, failures, any order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from quillgraph.operators import entities
from quillgraph.streaming import context, ledgered, reminders
from quillgraph.tables import settings

MAIL = "id string, body string, at long"


def folder(spark, path, rows, schema, files):
    """Rows written as so many files, one after the other."""
    for k in range(files):
        part = rows[k::files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return lambda n: spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(path)


def processed(rows):
    return rows.withColumn("error", F.when(F.col("body").contains("bad"), "validation"))


def test_replays_in_other_batches_change_nothing(spark, tmp_path):
    rows = [(f"m{i % 40}", "bad" if i % 40 == 7 else f"body {i % 40}", i) for i in range(100)]  # every message comes two or three times
    stream = folder(spark, str(tmp_path / "in"), rows, MAIL, 6)
    sink = ledgered.Sink(spark, str(tmp_path / "out"), "id", processed, F.col("at"))
    want = sorted(f"m{i}" for i in range(40) if i != 7)
    for checkpoint, n in (("a", 1), ("a", 1), ("b", 4), ("c", 100)):
        assert ledgered.poll(sink, lambda k=n: stream(k), str(tmp_path / checkpoint), cycles=1)[0].fault is None
        assert sorted(r.id for r in sink.completed().collect()) == want
    assert [(r.id, r.error, r.stage) for r in sink.failures().collect()] == [("m7", "validation", "FAILED")]
    assert {r.stage for r in sink.completed().collect()} == {"COMPLETED"}


def test_a_failure_within_a_batch_is_tried_again(spark, tmp_path, monkeypatch):
    rows = [(f"m{i}", f"body {i}", i) for i in range(30)]
    stream = folder(spark, str(tmp_path / "in"), rows, MAIL, 3)
    sink, real, calls = ledgered.Sink(spark, str(tmp_path / "out"), "id", processed), ledgered.put_new, []

    def dying(s, path, text):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed before the commit")
        real(s, path, text)
        if len(calls) == 4:
            raise RuntimeError("killed after the commit")

    monkeypatch.setattr(ledgered, "put_new", dying)
    turns = ledgered.poll(sink, lambda: stream(1), str(tmp_path / "c"), cycles=4, pause=0)
    assert [t.fault is None for t in turns] == [False, False, True, True]
    assert sorted(r.id for r in sink.completed().collect()) == sorted(r[0] for r in rows)


def test_failed_rows_are_tried_when_they_come_again(spark, tmp_path):
    sink = ledgered.Sink(spark, str(tmp_path / "out"), "id", processed)
    sink.put(spark.createDataFrame([("a", "bad", 1), ("b", "fine", 1)], MAIL))
    assert [r.id for r in sink.completed().collect()] == ["b"]
    sink.put(spark.createDataFrame([("a", "good now", 2), ("b", "other", 2)], MAIL))
    assert sorted((r.id, r.body) for r in sink.completed().collect()) == [("a", "good now"), ("b", "fine")] and sink.failures().count() == 0


def test_two_writers_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledgered, "MOST_FOLDERS", 2)
    one, two = (ledgered.Sink(spark, str(tmp_path / "out"), "id", processed) for _ in range(2))
    inner = []

    def slow(rows):
        if not inner:
            inner.append(1)
            two.put(spark.createDataFrame([("x", "two's", 1)], MAIL))  # commits while the other is at work
        return processed(rows)

    one.process = slow
    one.put(spark.createDataFrame([("x", "one's", 1), ("y", "one's", 1)], MAIL))
    for k in range(4):
        one.put(spark.createDataFrame([(f"z{k}", "more", 1), ("y", "again", 1)], MAIL))
    assert sorted((r.id, r.body) for r in one.completed().collect()) == [("x", "two's"), ("y", "one's"), *((f"z{k}", "more") for k in range(4))]
    assert len(one._now()[1]) <= 3


ITEM = "id string, seq long, status string, due_at string, description string"


def run(spark, stream, checkpoint, sink, trigger):
    with settings(spark, reminders.STATE):
        got = []
        query = stream.writeStream.outputMode(sink).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda df, _: got.extend(df.collect())).start()
        assert query.awaitTermination(90)
        return got


@pytest.fixture
def items(spark, tmp_path):
    at = str(tmp_path / "items")

    def put(*rows):
        spark.createDataFrame(list(rows), ITEM).coalesce(1).write.mode("append").parquet(at)

    def drain():
        return sorted(r.id for r in run(spark, reminders.reminded(spark.readStream.schema(ITEM).parquet(at)), str(tmp_path / "check"), "append", reminders.ONE_TURN))

    return put, drain


def test_reminded_once_over_restarts(items):
    put, drain = items
    soon = (dt.datetime.now(dt.UTC) + dt.timedelta(seconds=25)).isoformat()
    put(("late", 1, "open", "2024-01-01T00:00:00Z", "d"), ("no status", 1, None, "2024-01-01T00:00:00Z", None), ("closed", 1, "done", "2024-01-01T00:00:00Z", "d"), ("far", 1, "open", "2999-01-01T00:00:00Z", "d"), ("bad", 1, "open", "some day", "d"), ("none", 1, "open", None, "d"), ("soon", 1, "open", soon, "d"))
    first = drain()
    assert [x for x in first if x != "soon"] == ["late", "no status"]
    put(("late", 2, "open", "2024-02-01T00:00:00Z", "d"), ("far", 2, "open", "2024-01-01T00:00:00Z", "moved"), ("closed", 0, "open", "2024-01-01T00:00:00Z", "older row"))
    second = drain()  # a reminded item stays reminded; one that was moved fires
    assert [x for x in second if x != "soon"] == ["far"]
    import time

    time.sleep(max(0, (dt.datetime.fromisoformat(soon) - dt.datetime.now(dt.UTC)).total_seconds() + 1))
    put(("other", 1, "done", None, None))
    third = drain()
    assert (first + second + third).count("soon") == 1 and [x for x in third if x != "soon"] == []
    put(("other", 2, "done", None, None))
    assert drain() == []


def test_context_state_in_any_order_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(5)}", k, rng.choice(["requirements", "people"]), [f"v{rng.randrange(6)}" for _ in range(rng.randrange(4))], [f"v{rng.randrange(6)}" for _ in range(rng.choice([0, 0, 1, 2]))]) for k in range(120)]
    rows = [(t, k, f, a, r if r else None) for t, k, f, a, r in rows]
    first, later = rows[:40], rows[40:]
    rng.shuffle(later)
    later += later[:15]  # some come again
    frame = lambda x: spark.createDataFrame(x, context.DELTA)
    stream = folder(spark, str(tmp_path / "in"), later, context.DELTA, 4)
    got = run(spark, context.folded(stream(1), frame(first)), str(tmp_path / "check"), "update", {"availableNow": True})
    state = {}
    for r in sorted(got, key=lambda r: r.version):
        state[r.thread, r.field] = list(r.state)
    want = {(r.thread, r.field): list(r.state) for r in entities.folded_context(frame(rows).withColumn("remove", F.coalesce("remove", F.array().cast("array<string>")))).collect()}
    assert state == {k: v for k, v in want.items() if k in state} and {k for k, v in want.items() if v} <= state.keys()
