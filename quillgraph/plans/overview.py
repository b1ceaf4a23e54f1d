"""Views over several collections, list tools, pages, small sources and provenance (Q8, Q12, Q14, Q18, Q19, GR2, GR3, REC2, AG9, AG23, ST11, SRC3, SRC4, SNK2, SNK10, FN2, AR2, AR8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import arrays, classify, text
from quillgraph.operators import graph, joins, maintenance, retrieve
from quillgraph.plans.registry import query, table
from quillgraph.sources import export
from quillgraph.streaming import ingest


@query("""WITH p AS (SELECT c_custkey AS person, c_nationkey AS org FROM customer), o AS (SELECT o_orderkey AS id, org, o_orderstatus AS status FROM orders JOIN p ON o_custkey = person), e AS (SELECT event_id AS id, org, event_type AS kind FROM events JOIN p ON user_id = person)
SELECT org, category, 'canonical_org_id' AS basis, count(*)::BIGINT AS n, min(id)::BIGINT AS first_id FROM (SELECT org, 'people' AS category, person AS id FROM p UNION ALL SELECT s_nationkey, 'suppliers', s_suppkey FROM supplier UNION ALL SELECT org, 'commitments', id FROM o UNION ALL SELECT org, 'follow_ups', id FROM o WHERE status = 'O'
UNION ALL SELECT org, 'meetings', id FROM e WHERE kind = 'purchase' UNION ALL SELECT org, 'threads', id FROM e WHERE kind = 'click' UNION ALL SELECT org, 'knowledge', id FROM e WHERE kind = 'error' UNION ALL SELECT org, 'reply_drafts', id FROM o WHERE status = 'P' UNION ALL SELECT org, 'calendar_actions', id FROM e WHERE kind = 'view') GROUP BY 1, 2""")
def organization_360(s, d):
    """Q14, Q20, JN10: nine lists of each organization by its canonical id, as one tagged relation."""
    p = table(s, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("org"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("kind")).join(p, "person")
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.col("event_type").alias("kind")).join(p, "person")
    sup = table(s, d, "supplier").select(F.col("s_nationkey").alias("org"), F.col("s_suppkey").alias("id"))
    parts = {"people": p.select("org", F.col("person").alias("id")), "suppliers": sup, "commitments": o, "follow_ups": o.where("kind = 'O'"), "meetings": e.where("kind = 'purchase'"), "threads": e.where("kind = 'click'"), "knowledge": e.where("kind = 'error'"), "reply_drafts": o.where("kind = 'P'"), "calendar_actions": e.where("kind = 'view'")}
    return retrieve.tagged_counts(parts, "org", "id", "canonical_org_id")


@query("""WITH m AS (SELECT event_id, user_id, ts, event_id % 4 AS pillar FROM events WHERE event_type = 'purchase'), c AS (SELECT c_custkey, c_name, c_nationkey % 3 AS dom FROM customer)
SELECT m.event_id, coalesce(c_name, CAST(user_id AS VARCHAR)) AS attendee, CASE WHEN pillar = 0 THEN 'sales' WHEN pillar = 1 THEN 'finance' WHEN c_custkey IS NULL THEN 'unknown' WHEN dom = 0 THEN 'internal' ELSE 'customer' END AS class,
(SELECT count(*) FROM m x WHERE x.user_id = m.user_id AND x.ts < m.ts AND (SELECT count(*) FROM m y WHERE y.user_id = m.user_id AND y.ts < m.ts AND (y.ts, y.event_id) > (x.ts, x.event_id)) < 10)::BIGINT AS n_previous,
(SELECT count(*) FROM orders WHERE o_custkey = user_id AND o_orderstatus = 'O')::BIGINT AS n_open FROM m LEFT JOIN c ON c_custkey = user_id""")
def meeting_brief(s, d):
    """Q8, Q12, TX12: each meeting's attendee, class, up to ten earlier meetings and the attendee's open commitments."""
    m = table(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("event_id") % 4).alias("pillar"))
    before = joins.earlier_ones(m, "user_id", "event_id", "ts").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_previous"))
    open_ = table(s, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n_open"))
    people = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", (F.col("c_nationkey") % 3 == 0).alias("internal"))
    pillar = F.when(F.col("pillar") == 0, "Sales ").when(F.col("pillar") == 1, "finance").when(F.col("pillar") == 2, "Product")
    rows = m.join(people, "user_id", "left").join(before, "event_id", "left").join(open_, "user_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("event_id", F.coalesce("c_name", F.col("user_id").cast("string")).alias("attendee"), classify.meeting_class(pillar, F.col("internal")).alias("class"), number("n_previous"), number("n_open"))


@query("""SELECT * FROM (SELECT 'people' AS list, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 500) UNION ALL SELECT * FROM (SELECT 'projects', CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#1' ORDER BY p_partkey LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'commitments', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50) UNION ALL SELECT * FROM (SELECT 'opportunities', CAST(s_suppkey AS VARCHAR) FROM supplier ORDER BY s_suppkey LIMIT 1)""")
def list_tools(s, d):
    """Q18, Q19, ST4: lists by the arguments that are given, in order of id, the limit clamped to 1 to 500."""
    asks = [("people", "customer", "c_custkey", {"c_nationkey": 3}, 9999), ("projects", "part", "p_partkey", {"p_brand": "Brand#1", "p_type": ""}, 50), ("commitments", "orders", "o_orderkey", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}, 50), ("opportunities", "supplier", "s_suppkey", {}, 0)]
    parts = [retrieve.listed(table(s, d, t), key, limit, **equal).select(F.lit(name).alias("list"), F.col(key).cast("string").alias("id")) for name, t, key, equal, limit in asks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH p AS (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50) SELECT (SELECT count(*) FROM p)::BIGINT AS rows_, (SELECT count(*) FROM p) = 25 AS has_next, (SELECT count(*) FROM p WHERE contains(lower(c_name), '6'))::BIGINT AS shown""")
def page_with_next(s, d):
    """AG23, ST11: a full page promises a next one; a filter on a page sees that page alone."""
    page = retrieve.page(table(s, d, "customer").select("c_custkey", "c_name"), [F.col("c_custkey")], 50, 25)
    return page.agg(F.count(F.lit(1)).alias("rows_"), (F.count(F.lit(1)) == 25).alias("has_next"), F.count_if(retrieve.containing("c_name", "6")).alias("shown"))


@query("""SELECT 'customer' AS collection, count(*)::BIGINT AS n_before, 0::BIGINT AS n FROM customer UNION ALL SELECT 'orders', count(*)::BIGINT, 0::BIGINT FROM orders UNION ALL SELECT 'events', count(*)::BIGINT, 0::BIGINT FROM events""")
def guarded_reset(s, d):
    """SNK10: collections without a row, in test and development alone."""
    count = lambda df, c, t: df.agg(F.count(F.lit(1)).alias(c)).withColumn("collection", F.lit(t))
    rows = [count(table(s, d, t), "n_before", t).join(count(maintenance.reset(table(s, d, t), "test"), "n", t), "collection") for t in ("customer", "orders", "events")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT 'demo-' || k AS id, 'demo-thread' AS thread, CASE WHEN k % 2 = 0 THEN 'ann@lead.example' ELSE 'me@own.example' END AS sender, TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) AS at FROM range(9) t(k)""")
def demo_source(s, d):
    """SRC3, SRC4: the seeded messages of one thread, from memory, taken in through the converter."""
    return export.converted(export.in_memory(s, export.demo_messages(7))).select(F.col("source_message_id").alias("id"), F.col("source_thread_id").alias("thread"), F.col("from.email").alias("sender"), F.col("timestamp").cast("timestamp_ntz").alias("at"))


@query("""SELECT conv_id, turn, 'Plan B' AS subject, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body, 'ann@x.example' AS sender FROM conversations""")
def normalized_mails(s, d):
    """FN2: subject, body and addresses of a mail in normal form."""
    subject, body = text.normalize_message(F.lit("RE: Fwd:  Plan   B"), F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", subject.alias("subject"), body.alias("body"), text.normalize_address(F.struct(F.lit("Ann").alias("name"), F.lit("Ann@X.example").alias("email")))["email"].alias("sender"))


@query("""WITH e AS (SELECT 'REPORTS_TO' AS label, c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey > 0), n AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT a, 1 FROM e WHERE b = 0 UNION ALL SELECT x.a, 2 FROM e x JOIN e y ON x.b = y.a WHERE y.b = 0)
SELECT label, e.a, e.b, least(x.depth, y.depth) + 1 AS hop FROM e JOIN n x ON x.node = e.a JOIN n y ON y.node = e.b""")
def neighbourhood_edges(s, d):
    """REC2, GR5: the edges of two hops around a node, each once, at the hop that first walks it."""
    e = table(s, d, "customer").where("c_custkey > 0").select(F.lit("REPORTS_TO").alias("label"), F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).cast("long").alias("b"))
    nodes = graph.reachable(e, s.createDataFrame([(0,)], "node long"), 2)
    return graph.hop_edges(e, nodes).select("label", "a", "b", F.col("hop").cast("int").alias("hop"))


_KINDS = [
    ("WORKS_AT", "customer", "'c' || c_custkey", "'n' || c_nationkey", "'customer ' || c_custkey"), ("MEMBER_OF_THREAD", "events", "'c' || user_id", "'t' || (event_id % 50)", "'event ' || event_id"), ("OWES", "orders", "'c' || o_custkey", "'o' || o_orderkey", "'order ' || o_orderkey"),
    ("FOLLOWS_UP", "lineitem", "'l' || l_orderkey || '-' || l_linenumber", "'o' || l_orderkey", "'line ' || l_orderkey || '-' || l_linenumber"), ("ATTENDS", "events", "'c' || user_id", "CASE WHEN event_type = 'purchase' THEN 'e' || event_id END", "'event ' || event_id"),
    ("KNOWS_ABOUT", "events", "'c' || user_id", "CASE WHEN event_type = 'error' THEN 'k' || event_id END", "'event ' || event_id"), ("SUPPLIES", "supplier", "'s' || s_suppkey", "'n' || s_nationkey", "'supplier ' || s_suppkey"),
    ("PART_OF", "part", "'p' || p_partkey", "'b' || p_brand", "'part ' || p_partkey"), ("BELONGS_TO", "nation", "'n' || n_nationkey", "'r' || n_regionkey", "'nation ' || n_nationkey"),
]


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, count(*)::BIGINT AS n, min(src) AS first_source, max(src) AS last_source FROM (SELECT a, b, min(src) AS src FROM (SELECT {a} AS a, {b} AS b, {src} AS src FROM {t}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b)" for label, t, a, b, src in _KINDS))
def edge_kinds(s, d):
    """GR2, GR3: nine kinds of direct edges, each distinct edge with the least record that it comes from."""
    parts = [(label, table(s, d, t), F.expr(a), F.expr(b), F.expr(src)) for label, t, a, b, src in _KINDS]
    return graph.sourced_edges(*parts).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))


@query("""SELECT count(*) FILTER (status = 'active')::BIGINT AS active, count(*) FILTER (status = 'merged' AND target IS NOT NULL AND target <> id)::BIGINT AS merged, count(*) FILTER (status = 'merged' AND target IS NULL)::BIGINT AS no_target, count(*) FILTER (status = 'merged' AND target = id)::BIGINT AS self, count(*) FILTER (status NOT IN ('active', 'merged'))::BIGINT AS invalid
FROM (SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'merged' WHEN 1 THEN 'gone' ELSE 'active' END AS status, CASE WHEN c_custkey % 27 = 0 THEN c_custkey WHEN c_custkey % 27 = 9 THEN c_custkey - 1 END AS target FROM customer)""")
def lifecycle_counts(s, d):
    """AG9, DQ1: people by lifecycle, a missing status being active."""
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(k.alias("id"), F.when(k % 9 == 0, "merged").when(k % 9 == 1, "gone").when(k % 2 == 0, "active").alias("status"), F.when(k % 27 == 0, k).when(k % 27 == 9, k - 1).alias("target"))
    return maintenance.lifecycle(rows, "id", "status", "target")


@query("""SELECT stage, count(*)::BIGINT AS n, count(error)::BIGINT AS n_errors FROM (SELECT CASE WHEN value < 5 THEN 'FAILED' WHEN event_type = 'click' THEN 'THREADED' ELSE 'VALIDATED' END AS stage, CASE WHEN value < 5 THEN 'validation' END AS error FROM events) GROUP BY 1""")
def stage_transitions(s, d):
    """SNK2, SS5: rows go to the next stage, a failed one goes nowhere and keeps its error."""
    rows = ingest.split_failures(table(s, d, "events").select("event_id", "event_type", "value"), F.col("value") >= 5)
    moved = ingest.advanced(rows, F.col("event_type") == "click")
    return moved.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"))


@query("""SELECT l_orderkey, string_agg(value || ':' || source, ',' ORDER BY k) AS records FROM (SELECT l_orderkey, value, min(k) AS k, arg_min(source, k) AS source FROM (SELECT l_orderkey, l_returnflag AS value, 'old' AS source, 0 AS k FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT l_orderkey, l_linestatus, 'new', 10 + ascii(l_linestatus) FROM lineitem) GROUP BY 1, 2) WHERE value <> 'R' GROUP BY 1""")
def merge_records(s, d):
    """AR2, AR8: records by value; removed ones go, new values are appended. One flag of an order is a list of one."""
    of = lambda c, source: F.transform(F.array_sort(F.collect_set(c)), lambda x: F.struct(x.alias("value"), F.lit(source).alias("source")))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(of(F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag")), "old").alias("old"), of("l_linestatus", "new").alias("new"))
    merged = arrays.merged_records(F.col("old"), F.col("new"), arrays.as_list(F.lit("R")))
    return rows.select("l_orderkey", F.array_join(F.transform(merged, lambda x: F.concat(x["value"], F.lit(":"), x["source"])), ",").alias("records")).where("records <> ''")


@query("""SELECT conv_id, turn, turn % 3 <> 2 AND turn % 2 = 0 AS warned FROM conversations""")
def missed_commitments(s, d):
    """TX9: commitment language anywhere in a text, here after all that was said, while nothing was extracted."""
    t = F.col("turn")
    body = F.concat("text", F.when(t % 3 == 0, "\nI will send it").when(t % 3 == 1, "\nCould you look?").otherwise("\nThanks"))
    found = F.when(t % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return table(s, d, "conversations").select("conv_id", "turn", classify.missed_commitment(body, found).alias("warned"))
