"""Providers on executors, a client as a stream with offsets, a sink that publishes all or nothing."""

import json
import sys
import uuid
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from quillgraph.operators import provider
from quillgraph.sources import client

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import this module
SCHEMA = pa.schema([("n", pa.int64()), ("label", pa.string())])


def test_retry_is_row_by_row():
    calls = []

    def call(texts):
        calls.append(list(texts))
        if "boom" in texts:
            raise RuntimeError("no answer")
        if len(texts) == 4:
            return [{"n": 1, "label": "x"}] * 3  # one is missing
        return [{"n": len(t), "label": None} if t != "odd" else {"n": "many", "label": "x"} for t in texts]

    ok = lambda n: ({"n": n, "label": None}, None)
    assert provider.analyzed(["a", "boom", "bb"], call, SCHEMA) == [ok(1), ({}, "RuntimeError: no answer"), ok(2)]
    assert calls == [["a", "boom", "bb"], ["a"], ["boom"], ["bb"]]
    assert [x for x, _ in provider.analyzed(["a", "b", "c", "d"], call, SCHEMA)] == [ok(1)[0]] * 4
    out = provider.analyzed(["odd", "a"], call, SCHEMA)
    assert out[1] == ok(1) and out[0][0] == {} and out[0][1].startswith("wrong type")
    assert provider.analyzed(["a"], lambda t: ["text"], SCHEMA)[0][1] == "not a record: str"
    assert provider.analyzed(["a"], lambda t: [{"n": 1}], SCHEMA)[0][1] == "missing: label"
    assert provider.analyzed(["abc"], call, SCHEMA, lambda o: o["n"] < 3)[0][1] == "not valid"
    first = iter([[{"n": 9, "label": "x"}], [{"n": 1, "label": "x"}]])
    assert provider.analyzed(["a"], lambda t: next(first), SCHEMA, lambda o: o["n"] < 3) == [({"n": 1, "label": "x"}, None)]  # the retry


def test_no_row_and_no_batch_is_lost(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 50 == 7, "boom").when(F.col("id") % 50 == 8, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).repartition(5)

    def make():
        def call(texts):
            if "boom" in texts:
                raise RuntimeError("no answer")
            return [{"n": len(t or ""), "label": t} for t in texts]

        return call

    got = {r.id: r for r in provider.provided(rows, "text", make, "n long, label string").collect()}
    assert len(got) == 1000 and {i for i, r in got.items() if r.error} == {i for i in range(1000) if i % 50 == 7}
    assert all(r.n == len(r.text or "") for r in got.values() if not r.error)
    assert provider.provided(rows.limit(0), "text", make, "n long, label string").count() == 0
    with pytest.raises(ValueError, match="there already"):
        provider.provided(rows, "text", make, "id long")


class Box:
    """A mail box as a folder of numbered messages."""

    def __init__(self, root):
        self.root = str(root)

    def put(self, *texts):
        for t in texts:
            (Path(self.root) / f"{self.latest():06d}").write_text(t)

    def latest(self):
        return len([p for p in Path(self.root).iterdir() if p.name.isdigit()])

    def fetch(self, first, end):
        return [(k, (Path(self.root) / f"{k:06d}").read_text()) for k in range(first, end)]

    def done(self, end):
        (Path(self.root) / "done").write_text(str(end))


def test_a_restarted_stream_reads_no_message_twice(spark, tmp_path):
    (tmp_path / "box").mkdir()
    box = Box(tmp_path / "box")
    spark.dataSource.register(client.stream_source("mail_box", box, "id long, text string", page=3))

    def drain():
        got = []
        q = spark.readStream.format("mail_box").load().writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
        assert q.awaitTermination(60)
        return sorted((r.id, r.text) for r in got)

    box.put(*(f"m{i}" for i in range(8)))
    assert drain() == [(i, f"m{i}") for i in range(8)]
    box.put("new", "newer")
    assert drain() == [(8, "new"), (9, "newer")]
    box.put("last")
    assert drain() == [(10, "last")]


class Calendar:
    """Staged rows in files; published ones in one file a batch."""

    def __init__(self, root):
        self.root = str(root)

    def stage(self, rows):
        if any(r[1] == "bad" for r in rows):
            raise RuntimeError("refused")
        at = Path(self.root) / f"staged-{uuid.uuid4().hex}"
        at.write_text(json.dumps(rows))
        return str(at)

    def publish(self, handles, batch):
        rows = [r for h in handles for r in json.loads(Path(h).read_text())]
        (Path(self.root) / f"published-{batch}").write_text(json.dumps(sorted(rows)))
        self.discard(handles)

    def discard(self, handles):
        for h in handles:
            Path(h).unlink(missing_ok=True)


def test_a_write_is_published_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(client.sink("calendar", Calendar(tmp_path)))
    rows = spark.createDataFrame([(i, "fine") for i in range(20)], "id long, title string").repartition(4)
    rows.write.format("calendar").mode("append").save()
    assert json.loads((tmp_path / "published-None").read_text()) == [[i, "fine"] for i in range(20)] and not list(tmp_path.glob("staged-*"))
    (tmp_path / "published-None").unlink()
    with pytest.raises(Exception, match="refused"):
        rows.withColumn("title", F.when(F.col("id") == 11, "bad").otherwise(F.col("title"))).write.format("calendar").mode("append").save()
    assert not list(tmp_path.glob("published-*"))
