"""Questions, providers, notes and streams."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from quillgraph.operators import service
from quillgraph.sources import export, markdown
from quillgraph.streaming import ingest

NOW = datetime(2026, 3, 12, 10, tzinfo=ZoneInfo("UTC"))


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("p1", "Ann Lee"), ("p2", "Ann Kim"), ("p3", "Bo Diaz")], "id string, name string")


@pytest.fixture
def source(spark):
    rows = [("c1", "p1", datetime(2026, 3, 1), "a"), ("c2", "p3", datetime(2026, 3, 20), None), ("c3", "p3", None, "b")]
    df = spark.createDataFrame(rows, "id string, person string, at timestamp_ntz, what string")
    return {k: service.Source(df, "commitment", "id", "at", "person", ("what",)) for k in ("commitments", "person_context")}


def test_answers(people, source):
    ask = lambda q, **k: service.ask(q, NOW, source, people, "id", "name", **k)
    ids = lambda a: [r.record_id for r in a.rows.collect()]
    assert ids(ask("commitments for Bo Diaz")) == ["c3", "c2"]
    assert ids(ask("overdue commitments")) == ["c1"] and ids(ask("upcoming commitments about Bo")) == ["c2"]
    assert ask("context on Ann").status == service.AMBIGUOUS and ask("context on Ann Lee").status == service.OK
    assert ask("context on Zed").status == service.NO_MATCH and ask("what time is it").status == service.UNSUPPORTED
    assert sorted(ids(ask("commitments for Zed"))) == ["c1", "c2", "c3"] and ask("commitments for Zed", strict=True).status == service.NO_MATCH
    summary = {r.record_id: r.summary for r in ask("commitments").rows.collect()}
    assert summary == {"c1": {"what": "a"}, "c2": {}, "c3": {"what": "b"}}


def test_fallback_and_providers():
    assert service.parse("hm", lambda q: {"intent": "meetings"}).intent == "meetings"
    assert service.parse("hm", lambda q: {"intent": "dance"}).intent == "unsupported"
    assert service.parse("hm", lambda q: 1 / 0).intent == "unsupported"
    service.provider("none")(lambda: 7)
    assert service.made("none") == 7
    with pytest.raises(ValueError):
        service.made("other")
    tries = iter([{}, {"ok": 1}])
    assert service.retried(lambda: next(tries), bool) == {"ok": 1}
    with pytest.raises(ValueError):
        service.retried(dict, bool)
    assert service.wording("ok", 0, "meetings") == "No meetings found."


def test_notes(spark, tmp_path):
    edges = spark.createDataFrame([("WORKS_AT", "p1", "o1"), ("WORKS_AT", "p1", "o1"), ("KNOWS", "p1", "p2")], "label string, a string, b string")
    names = spark.createDataFrame([("p1", "Ann"), ("p2", "Bo")], "id string, label string")
    notes = {r.id: r.content for r in markdown.rendered(edges, names).collect()}
    assert notes["p1"] == "# Ann\n## KNOWS\n- [[p2]]\n## WORKS_AT\n- [[o1]]\n" and notes["p2"] == "# Bo\n"
    for k, v in notes.items():
        (tmp_path / f"{k}.md").write_text(v)
    assert sorted(tuple(r) for r in markdown.read_notes(spark, str(tmp_path)).select("id", "kind", "target").collect()) == [("p1", "KNOWS", "p2"), ("p1", "WORKS_AT", "o1")]
    old = spark.createDataFrame([("p1", notes["p1"]), ("p2", "x")], "id string, content string")
    new = spark.createDataFrame([*notes.items(), ("p3", "y")], "id string, content string")
    assert {r.id: r.change for r in markdown.to_write(old, new).collect()} == {"p2": "updated", "p3": "created"}


def test_live_source(spark):
    class Client(export.ClientSource):
        fetch = staticmethod(lambda page: [(f"{page}", "t", "s", "a@x.example", [], [], "2026-01-01", [], "", "body")])

    spark.dataSource.register(Client)
    assert spark.read.format("message_client").option("pages", 3).load().count() == 3


def test_extended_json(spark):
    df = spark.createDataFrame([('{"a": {"$oid": "1"}, "b": {"$date": "2026"}, "c": "x"}',)], "j string")
    assert tuple(df.select(*(export.plain_json("j", c) for c in "abc")).first()) == ("1", "2026", "x")


def test_replayed_stream_and_failures(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    rows.write.parquet(str(folder))
    stream = ingest.deduplicated(ingest.source(spark, str(folder), rows.schema), "k")
    for _ in range(2):
        ingest.run_once(stream, str(tmp_path / "ck"), lambda df, _: df.write.mode("append").parquet(out))
        rows.write.mode("append").parquet(str(folder))  # the same again
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]
    assert [r.stage for r in ingest.split_failures(rows, F.col("v") > 1).orderBy("k").collect()] == ["FAILED", "FAILED", "VALIDATED"]


def test_extended_json_equals_a_recursive_walk(spark):
    import json

    def walk(v):
        if isinstance(v, dict):
            if set(v) in ({"$oid"}, {"$date"}):
                return next(iter(v.values()))
            return {k: walk(x) for k, x in v.items() if k != "_id"}
        return [walk(x) for x in v] if isinstance(v, list) else v

    documents = [
        {"_id": {"$oid": "a"}}, {"_id": 1, "a": 2}, {"a": 2, "_id": "x,}"}, {"a": {"_id": {"k": 1}, "b": [{"$oid": "p"}, {"$date": {"$numberLong": "5"}}]}, "_id": 3, "c": None},
        {"a": 'say {"$oid": "x"} and "_id": 3, ok', "b": "{", "$oid": "kept"}, {"long": "x\\\"" * 20000, "at": {"$date": "y" * 20000}}, {}, [{"$oid": "q"}, {"_id": 1}],
    ]
    rows = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(documents)], "k int, raw string")
    found = {r.k: json.loads(r.plain) for r in rows.select("k", export.plain_document(F.col("raw")).alias("plain")).collect()}
    assert found == {k: walk(x) for k, x in enumerate(documents)}
    assert spark.range(1).select(export.plain_document(F.lit(None).cast("string")).alias("x")).first().x is None
