"""Neighbours over ranges of ids of any type, with many rows of one id."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from quillgraph.llm import fingerprint


@pytest.mark.parametrize("kind", ["string", "long", "date", "binary", "decimal(9,2)", "int"])
@pytest.mark.parametrize("n_ranges", [1, 7])
def test_next_row_of_any_id(spark, kind, n_ranges):
    rng = random.Random(1)
    rows = [(rng.randrange(19000, 19060) if rng.random() < 0.7 else None if rng.random() < 0.1 else 19005, f"text {i} " * rng.randrange(1, 30) + rng.choice(["é", "日本", "", "x"])) for i in range(300)] + [(19001, None), (19001, ""), (19001, "same"), (19001, "same")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    cast = {"date": "date_from_unix_date(doc_id)", "string": "concat('é', doc_id)", "binary": "cast(cast(doc_id as string) as binary)"}.get(kind, f"cast(doc_id as {kind})")
    df = df.withColumn("doc_id", F.expr(f"CASE WHEN doc_id IS NOT NULL THEN {cast} END"))
    order = df.withColumn("text", F.coalesce("text", F.lit(""))).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").collect()
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        k = len(r.text) // 4
        want.append((r.doc_id, len(r.text), hashlib.sha256((r.text[: len(r.text) - k] + after.text[:k]).encode()).hexdigest()))
    got = fingerprint.edited(df, n_ranges)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()))) == sorted(map(repr, want))


def test_rows_of_one_id_are_split(spark):
    df = spark.createDataFrame([(7, f"text {i}") for i in range(4000)], "doc_id long, text string")
    sizes = [r["n"] for r in fingerprint.by_range(df, 8).groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()]
    dealt = fingerprint.by_range(df, 8).withColumn("p", F.spark_partition_id())
    assert dealt.select("p", "range").distinct().count() == dealt.select("p").distinct().count() == 8  # a task has one range
    assert len(sizes) == 8 and max(sizes) < 1500 and sum(sizes) == 4008


def test_ranges_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 10_000)
    df = spark.createDataFrame([(i, "x" * 100) for i in range(1000)], "doc_id long, text string")
    assert fingerprint.by_range(df).select("range").distinct().count() == 10
    monkeypatch.setattr(fingerprint, "MOST_RANGES", 4)
    assert fingerprint.by_range(df).select("range").distinct().count() == 4
