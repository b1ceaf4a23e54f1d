"""Tables of many copies of a name or a group: results against the SQL, and rows in proportion to the tables, not to pairs of copies."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from quillgraph.operators import graph, joins
from quillgraph.plans import QUERIES, SQL
from quillgraph.tables import dealt

N = 600


def steps(node):
    """The steps of a plan that has run."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from steps(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from steps(node.plan())
    else:
        yield node
        for k in range(node.children().size()):
            yield from steps(node.children().apply(k))


def most(df, metric):
    """The greatest value of a metric in the steps of df's plan, which has run."""
    found = [m.get(metric).get().value() for m in (s.metrics() for s in steps(df._jdf.queryExecution().executedPlan())) if m.contains(metric)]
    return max(found, default=0)


def copies(spark, at, nations):
    """Customers, orders, events and suppliers whose keys fall into one mail, thread and few names."""
    i = F.col("id")
    put = lambda n, df: df.write.parquet(f"{at}/{n}.parquet")
    put("customer", spark.range(2 * N).select((i * 300).alias("c_custkey"), (i % nations).cast("int").alias("c_nationkey")))
    put("orders", spark.range(2 * N).select((i * 150 + i % 2 * 5).alias("o_orderkey"), i.alias("o_custkey")))
    put("events", spark.range(N).select((i * 1500 + i % 2).alias("event_id")))
    put("supplier", spark.range(N).select((i * 5).alias("s_suppkey"), (i % nations).cast("int").alias("s_nationkey")))
    put("nation", spark.range(nations).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), i.cast("string")).alias("n_name")))
    return str(at)


def rows_of(df, sql, at):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(map(repr, map(list, found.fetchall())))
    return len(got)


@pytest.mark.parametrize("name, nations", [
    ("fact_attribution", 1),
    ("knowledge_links", 1),
    ("reference_proposals", 1),
    ("people_of_one_mail", 1),
    ("duplicate_people", 150),
    ("people_without_address", 1),
])
def test_copies_of_a_name_are_not_paired(spark, tmp_path, name, nations):
    df = QUERIES[name](spark, at := copies(spark, tmp_path, nations))
    rows_of(df, SQL[name], at)
    assert most(df, "numOutputRows") < 10 * N


def test_an_overlap_is_met_once(spark, tmp_path):
    i = F.col("id")
    spark.range(200 * 12).select(i.alias("event_id"), (i % 200).alias("user_id"), F.lit("purchase").alias("event_type"), F.timestamp_seconds(i / 200 % 10 * 86400).cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["related_people"](spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows) == 200 * 199
    assert most(df, "numOutputRows") <= 200 * 200 and most(df, "shuffleRecordsWritten") < 5000


def test_overlaps_are_made_by_many_tasks(spark, tmp_path):
    i = F.col("id")
    spark.range(400 * 6).select(i.alias("event_id"), F.when(i % 400 > 0, i % 400).alias("user_id"), F.lit("purchase").alias("event_type"), F.when(i % 11 > 0, F.timestamp_seconds(i * 7919 % 13 * 86400)).cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["related_people"](spark, str(tmp_path))
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(con.execute(SQL["related_people"]).fetchall())
    assert len({r.part for r in rows}) > 1


def test_an_overlap_is_met_once_among_many_items(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 2)  # several chunks and blocks
    rng = random.Random(5)
    lists = {k: rng.choices(range(300), [1 + 2000 // (1 + x) for x in range(300)], k=rng.randint(0, 9)) for k in range(120)}
    df = spark.createDataFrame([(str(k), [f"t{x}" for x in v] + [None] * (k % 3 == 0)) for k, v in lists.items()] * 2, "k string, items array<string>")
    found = sorted(map(tuple, joins.overlap_pairs(df, "k", F.col("items")).collect()))
    assert found == sorted((str(a), str(b)) for a in lists for b in lists if a != b and set(lists[a]) & set(lists[b]))
    assert len({x for v in lists.values() for x in v}) > joins.BITS


def test_pairs_of_organizations_are_not_gathered(spark, tmp_path):
    df = QUERIES["org_dup_pairs"](spark, at := copies(spark, tmp_path, 7))
    assert rows_of(df, SQL["org_dup_pairs"], at) > 20 * N and most(df, "shuffleRecordsWritten") < 10 * N


def test_a_thread_is_folded_where_it_was_dealt(spark, tmp_path):
    i = F.col("id")
    spark.range(3000).select((i / 5).cast("long").alias("l_orderkey"), (i % 5).cast("int").alias("l_linenumber"), (i * 13).alias("l_partkey"), i.alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["context_fold"](spark, str(tmp_path))
    assert df.count() == 600 and len(df.collect()) == 600
    kinds = [s.getClass().getSimpleName() for s in steps(df._jdf.queryExecution().executedPlan())]
    assert sum("ShuffleExchange" in k for k in kinds) == 1 and not any("Join" in k for k in kinds)


def test_parts_grow_with_rows(spark):
    assert dealt(spark.range(1000), 1000, "id", rows=100).rdd.getNumPartitions() == 10


def test_pairs_of_a_large_group_are_dealt_over_parts_by_their_number(spark):
    df = graph.co_occurrence(spark.range(3000).select(F.lit(1).alias("g"), "id"), "g", "id")
    assert re.search(r"hashpartitioning\(a#\d+L?, b#\d+L?, 5\)", df._jdf.queryExecution().executedPlan().toString())  # 4,498,500 pairs
