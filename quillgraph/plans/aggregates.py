"""Aggregations and windows over the test tables (AG, WN, ER2-ER4, ER9-ER13, Q23)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import arrays
from quillgraph.operators import joins, maintenance, windows
from quillgraph.plans.registry import query, table


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS pending,
count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS urgent, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')::BIGINT AS recent FROM orders""")
def dashboard_metrics(s, d):
    """AG1: six counts in one scan."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return table(s, d, "orders").agg(F.count(F.lit(1)).alias("total"), n("o_orderstatus = 'O'", "open"), n("o_orderstatus = 'F'", "done"), n("o_orderstatus = 'P'", "pending"), n("o_orderpriority = '1-URGENT'", "urgent"), n("o_orderdate >= timestamp_ntz'1998-01-01'", "recent"))


@query("""SELECT o_orderpriority AS pillar, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY n DESC, pillar""")
def pillar_histogram(s, d):
    """AG2, AG20, AG21."""
    return table(s, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("pillar")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pillar")


@query("""SELECT CASE WHEN v = 'BUILDING' THEN 'known' WHEN v = '' THEN 'empty' WHEN v IS NULL THEN 'null' ELSE 'other' END AS bucket, count(*)::BIGINT AS n FROM (SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN '' WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS v FROM customer) GROUP BY 1""")
def bucket_reconciliation(s, d):
    """AG3."""
    v = F.when(F.col("c_mktsegment") == "MACHINERY", "").when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None)).otherwise(F.col("c_mktsegment"))
    bucket = F.when(F.col("v") == "BUILDING", "known").when(F.col("v") == "", "empty").when(F.col("v").isNull(), "null").otherwise("other")
    return table(s, d, "customer").select(v.alias("v")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_name AS value, count(*)::BIGINT AS n, min(p_partkey)::BIGINT AS first_id FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY 1 HAVING count(*) > 1""")
def duplicate_values(s, d):
    """AG4, DQ18."""
    return maintenance.duplicates(table(s, d, "part"), F.col("p_name"), "p_partkey")


@query("""SELECT p_name, count(DISTINCT nullif(p_brand, 'Brand#1'))::BIGINT AS n_orgs, count(DISTINCT nullif(p_brand, 'Brand#1')) <= 1 AS safe FROM part GROUP BY 1 HAVING count(*) > 1""")
def group_quality(s, d):
    """AG5."""
    n = F.count_distinct(F.nullif("p_brand", F.lit("Brand#1")))
    return table(s, d, "part").groupBy("p_name").agg(n.alias("n_orgs"), (n <= 1).alias("safe"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")


@query("""SELECT n_nationkey, n_name, count(c_custkey)::BIGINT AS members, min(c_custkey)::BIGINT AS first_member FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def org_members(s, d):
    """AG6: counted before the lookup, so one row an organization is joined."""
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("members"), F.min("c_custkey").alias("first_member"))
    return table(s, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "members", "first_member")


@query("""SELECT 'customer' AS collection, count(*)::BIGINT AS total, count(*) FILTER (nullif(c_mktsegment, 'MACHINERY') IS NULL)::BIGINT AS missing FROM customer
UNION ALL SELECT 'events', count(*)::BIGINT, count(*) FILTER (value < 1)::BIGINT FROM events UNION ALL SELECT 'orders', count(*)::BIGINT, count(*) FILTER (o_orderstatus = 'P')::BIGINT FROM orders""")
def coverage_audit(s, d):
    """AG7, DQ6."""
    return maintenance.coverage(("customer", table(s, d, "customer"), F.nullif("c_mktsegment", F.lit("MACHINERY")).isNull()), ("events", table(s, d, "events"), F.col("value") < 1), ("orders", table(s, d, "orders"), F.col("o_orderstatus") == "P"))


@query("""SELECT count(*) FILTER (user_id % 3 = 0)::BIGINT AS person, count(*) FILTER (user_id % 3 = 1)::BIGINT AS org_only, count(*) FILTER (user_id % 3 = 2)::BIGINT AS neither FROM events""")
def provenance_split(s, d):
    """AG8, DQ5."""
    return table(s, d, "events").agg(*(F.count_if(F.col("user_id") % 3 == k).alias(n) for k, n in enumerate(("person", "org_only", "neither"))))


@query("""SELECT arg_max(event_id, ts)::BIGINT AS latest, arg_min(event_id, ts) FILTER (event_type = 'error')::BIGINT AS earliest_unprocessed FROM events""")
def latest_and_earliest_unprocessed(s, d):
    """AG10."""
    return table(s, d, "events").agg(F.max_by("event_id", "ts").alias("latest"), F.expr("min_by(event_id, ts) FILTER (WHERE event_type = 'error')").alias("earliest_unprocessed"))


@query("""SELECT count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r FROM lineitem""")
def stage_counts(s, d):
    """AG12, SNK2."""
    return table(s, d, "lineitem").agg(*(F.count_if(F.col("l_returnflag") == x).alias(x.lower()) for x in "ANR"))


@query("""SELECT sum(n)::BIGINT AS total FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)""")
def list_size_total(s, d):
    """AG13."""
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).agg(F.sum(F.size("parts")).alias("total"))


@query("""SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS participants, max(turn)::BIGINT AS last_turn, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id""")
def thread_upsert(s, d):
    """AG14, ER2."""
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first_seen) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY 1, 2) GROUP BY 1""")
def distinct_in_first_order(s, d):
    """AG15: of each kind the first row first, so that a list holds no more than the kinds."""
    first = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))
    return first.groupBy("user_id").agg(F.array_join(windows.distinct_in_order("event_type", "first_seen"), ",").alias("kinds"))


@query("""SELECT user_id, max(ts) FILTER (event_type = 'click') AS last_inbound, max(ts) FILTER (event_type = 'purchase') AS last_outbound FROM events GROUP BY 1""")
def forward_only_times(s, d):
    """AG16, SS7."""
    last = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    return table(s, d, "events").groupBy("user_id").agg(last("click").alias("last_inbound"), last("purchase").alias("last_outbound"))


@query("""SELECT user_id, arg_min(v, event_id) FILTER (v IS NOT NULL) AS role FROM (SELECT user_id, event_id, nullif(event_type, 'click') AS v FROM events) GROUP BY 1""")
def first_known_value(s, d):
    """AG17, ER4."""
    rows = table(s, d, "events").select("user_id", "event_id", F.nullif("event_type", F.lit("click")).alias("v"))
    return rows.groupBy("user_id").agg(windows.first_known("v", "event_id").alias("role"))


@query("""WITH m AS (SELECT c_custkey AS old, c_custkey - 1 AS new FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 0) SELECT 'orders' AS collection, count(*)::BIGINT AS n FROM orders JOIN m ON o_custkey = old UNION ALL SELECT 'events', count(*)::BIGINT FROM events JOIN m ON user_id = old""")
def merge_impact(s, d):
    """AG18, AG19, DQ9."""
    m = table(s, d, "customer").where("c_custkey % 7 = 0 AND c_custkey > 0").select(F.col("c_custkey").alias("old"))
    count = lambda df, c, n: df.join(m, F.col(c) == F.col("old"), "left_semi").agg(F.lit(n).alias("collection"), F.count(F.lit(1)).alias("n"))
    return count(table(s, d, "orders"), "o_custkey", "orders").unionByName(count(table(s, d, "events"), "user_id", "events"))


@query("""SELECT substr(sha256('[' || string_agg('"' || p || '"', ', ' ORDER BY p) || ']'), 1, 16) AS plan_hash FROM (SELECT 'PER-' || c_custkey || '->' || (c_custkey - 1) AS p FROM customer WHERE c_custkey % 100 = 7)""")
def plan_hash(s, d):
    """AG22, SNK5."""
    pairs = table(s, d, "customer").where("c_custkey % 100 = 7").select(F.concat(F.lit("PER-"), F.col("c_custkey").cast("string"), F.lit("->"), (F.col("c_custkey") - 1).cast("string")).alias("p"))
    return pairs.agg(arrays.set_hash(F.collect_list("p")).alias("plan_hash"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1""")
def latest_snapshot(s, d):
    """WN1."""
    return windows.latest(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS version FROM events""")
def version_numbers(s, d):
    """WN2."""
    return windows.numbered(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "version", "ts", "event_id").select("event_id", F.col("version").cast("long").alias("version"))


@query("""WITH once AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, day, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS sequence FROM once""")
def thread_sequence(s, d):
    """WN3: gap-free over distinct events."""
    rows = table(s, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return windows.sequenced(rows, ["user_id", "event_type", "day"], "user_id", "sequence", "event_id").select("user_id", "event_type", "day", F.col("sequence").cast("long").alias("sequence"))


@query("""SELECT user_id, printf('PER-%03d', row_number() OVER (ORDER BY first_seen, user_id)) AS id FROM (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1)""")
def allocate_ids(s, d):
    """WN4."""
    people = table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"))
    return windows.ids(people, "PER", "id", "first_seen", "user_id").select("user_id", "id")


@query("""SELECT event_id, coalesce(array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM events""")
def preceding_20(s, d):
    """WN5."""
    return table(s, d, "events").select("event_id", F.array_join(windows.preceding("user_id", "event_id", F.col("event_id").cast("string")), ",").alias("before"))


@query("""WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(kinds) OVER (PARTITION BY user_id ORDER BY day), []) AS b FROM v)
SELECT user_id, day, array_to_string(list_sort(list_filter(kinds, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(kinds, x))), ',') AS removed FROM w""")
def context_diff(s, d):
    """WN6, SET4."""
    v = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    w = windows.list_diff(v, "user_id", "kinds", "day")
    return w.select("user_id", "day", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("added", "removed")))


@query("""SELECT s_nationkey, arg_min(s_suppkey, s_suppkey)::BIGINT AS only_one FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1""")
def unique_candidate(s, d):
    """WN8, ER6, ER18, ER19: kept only where there is exactly one candidate."""
    return joins.only_candidate(table(s, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("only_one")), "s_nationkey", "only_one")


@query("""SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY 1""")
def current_and_previous(s, d):
    """WN9."""
    rows = table(s, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("n <= 4")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn"))), lambda x: x.turn.cast("string")), ",").alias("recent"))


@query("""SELECT event_id, value, previous FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS value, lag(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS previous, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1 OR value IS DISTINCT FROM previous""")
def value_history(s, d):
    """WN10, ER20: rows at which the value changed."""
    value = F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("long")
    return windows.changes(table(s, d, "events").select("event_id", "user_id", "event_type", "props"), ["user_id", "event_type"], value, "event_id").select("event_id", "value", "previous")


@query("""SELECT event_id, round(least(0.99::DOUBLE, 0.75::DOUBLE + 0.01::DOUBLE * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)), 2) AS confidence FROM events""")
def confidence(s, d):
    """WN11."""
    return table(s, d, "events").select("event_id", windows.confidence(["user_id", "event_type"], "event_id").alias("confidence"))


@query("""SELECT event_id, min(ts) OVER (PARTITION BY user_id, event_type) AS first_seen, max(ts) OVER (PARTITION BY user_id, event_type) AS last_confirmed FROM events""")
def first_and_last_seen(s, d):
    """WN12: an aggregate and a join, so a busy key is not gathered in a window."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    ends = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_confirmed"))
    return e.join(ends, ["user_id", "event_type"]).select("event_id", "first_seen", "last_confirmed")


@query("""SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS mentions, min(o_orderkey)::BIGINT AS first_id FROM orders GROUP BY 1, 2, 3""")
def commitment_resolution(s, d):
    """ER10-ER12: one commitment for each person, class and day."""
    return table(s, d, "orders").groupBy("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("mentions"), F.min("o_orderkey").alias("first_id"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def follow_up_derivation(s, d):
    """ER13: commitments of the two classes that have no follow-up yet."""
    o = table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")
    return o.join(table(s, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'APPROVED' WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'REJECTED' ELSE o_orderstatus END AS status FROM orders""")
def approval_states(s, d):
    """Q23: fail closed where the record names attendees."""
    status = F.when(F.col("o_orderstatus") == "P", "APPROVED").when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0), "REJECTED").otherwise(F.col("o_orderstatus"))
    return table(s, d, "orders").select("o_orderkey", status.alias("status"))
