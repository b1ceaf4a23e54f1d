"""Hard joins, graphs, integrity, merges, sources and sinks over the test tables (JN14-JN24, REC, GR, DQ, SNK, SRC, ER, Q11-Q13, Q21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import graph, joins, maintenance, resolve, retrieve
from quillgraph.plans.registry import query, table
from quillgraph.sources import export


@query("""WITH p AS (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS t FROM part), b AS (SELECT DISTINCT p_brand || ' ' || p_name AS n, string_split(p_brand || ' ' || p_name, ' ') AS t FROM part)
SELECT p.n AS a, b.n AS b FROM p JOIN b ON len(list_filter(p.t, lambda x: NOT list_contains(b.t, x))) = 0 OR len(list_filter(b.t, lambda x: NOT list_contains(p.t, x))) = 0""")
def token_subset_resolution(s, d):
    """JN15, Q11, ER5, ER17: one name's tokens within the other's."""
    part = table(s, d, "part")
    names = part.select(F.col("p_name").alias("n")).distinct().withColumn("t", F.split("n", " "))
    longer = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("m")).distinct().withColumn("u", F.split("m", " "))
    return joins.token_subsets(names, longer, "n", "t", "m", "u")



@query("""SELECT p_name, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, count(*)::BIGINT AS candidates FROM part WHERE p_name IN ('small ring', 'red widget') GROUP BY 1 UNION ALL SELECT 'no such part', 'not_found', 0::BIGINT""")
def reference_resolution(s, d):
    """Q11: RESOLVED, AMBIGUOUS or NOT_FOUND for each name asked for."""
    asked = s.createDataFrame([("small ring",), ("red widget",), ("no such part",)], "p_name string")
    found = table(s, d, "part").join(asked, "p_name", "left_semi").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(found, "p_name", "left").select("p_name", F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), n.cast("long").alias("candidates"))


@query("""SELECT o_orderkey, arg_max(event_id, (ts, event_id))::BIGINT AS event_id FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS at FROM orders) o JOIN events e ON e.user_id = o.o_custkey AND o.at - INTERVAL 14 DAY <= e.ts GROUP BY 1""")
def asof_thread_14d(s, d):
    """JN16: the newest candidate of the participant within 14 days; one-sided."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_orderkey") % 60).cast("int"))).alias("at"))
    e = table(s, d, "events").select("user_id", "event_id", "ts")
    return joins.newest_within(o, e, ["user_id"], "o_orderkey", "at", "event_id", "ts").select("o_orderkey", "event_id")



@query("""SELECT a.event_id, b.event_id AS earlier FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts WHERE a.event_type = 'purchase' AND b.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) <= 10""")
def previous_meetings_10(s, d):
    """JN17, Q12: up to ten strictly earlier meetings of the thread."""
    e = table(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.earlier_ones(e, "user_id", "event_id", "ts").select("event_id", "earlier")


@query("""WITH o AS (SELECT s_suppkey AS id, s_nationkey AS nk, 'site' || (s_suppkey % 40) AS web, 'site' || ((s_suppkey + 3) % 55) AS dom FROM supplier), p AS (SELECT a.id AS a, b.id AS b, 0 AS e FROM o a JOIN o b ON a.nk = b.nk AND a.id < b.id
UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), 1 FROM o a JOIN o b ON a.web = b.dom AND a.id <> b.id) SELECT a, b, CASE min(e) WHEN 0 THEN 'name_match' ELSE 'domain_cross_match' END AS evidence FROM p GROUP BY 1, 2""")
def org_dup_pairs(s, d):
    """JN19, DQ8: two equi-joins instead of one OR condition, no pair in both."""
    k = F.col("s_suppkey")
    o = table(s, d, "supplier").select(k.alias("id"), "s_nationkey", F.concat(F.lit("site"), (k % 40).cast("string")).alias("web"), F.concat(F.lit("site"), ((k + 3) % 55).cast("string")).alias("dom"))
    return joins.evidenced_pairs(o, "id", F.col("s_nationkey"), F.col("web"), F.col("dom"), ("name_match", "domain_cross_match"))


@query("""WITH t AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS tier FROM events) SELECT user_id, event_id, CASE tier WHEN 0 THEN 'canonical' WHEN 1 THEN 'organization' ELSE 'legacy' END AS basis FROM t QUALIFY tier = min(tier) OVER (PARTITION BY user_id)""")
def tiered_context(s, d):
    """JN14, WN7, Q13: only the best non-empty tier of each person."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    tiers = [("canonical", e.where("event_type = 'purchase'")), ("organization", e.where("event_type = 'click'")), ("legacy", e.where("event_type not in ('purchase', 'click')"))]
    return joins.tiered(tiers, "user_id").select("user_id", "event_id", "basis")


@query("""SELECT o_orderkey, coalesce(nullif(o_custkey % 10, 3), c_nationkey)::BIGINT AS org FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def inherited_references(s, d):
    """JN20."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.nullif(F.col("o_custkey") % 10, F.lit(3)).alias("org"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("org"))
    return joins.inherited(o, c, "k", "org").select("o_orderkey", "org")


@query("""SELECT 'events' AS source, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS ref FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)""")
def referential_integrity(s, d):
    """JN21, DQ2, DQ3, DQ13."""
    people = table(s, d, "customer").where("c_custkey % 11 <> 0").select("c_custkey")
    parts = [joins.dangling(table(s, d, t), t, k, F.col(r), people, "c_custkey") for t, k, r in (("events", "event_id", "user_id"), ("orders", "o_orderkey", "o_custkey"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)""")
def references_to_merged(s, d):
    """JN22."""
    merged = table(s, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(merged, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN count(c_custkey) = 0 THEN 'unknown' WHEN bool_and(s_nationkey = c_nationkey) THEN 'internal' ELSE 'external' END AS class FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def internal_meetings(s, d):
    """JN24."""
    o, line = table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "lineitem").select("l_orderkey", "l_suppkey")
    rows = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    same = F.bool_and(F.col("s_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("o_orderkey").agg(F.when(F.count("c_custkey") == 0, "unknown").when(same, "internal").otherwise("external").alias("class"))


_CHAIN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 <> 0 THEN c_custkey - 1 WHEN c_custkey % 7 = 6 AND c_custkey % 4 = 0 THEN c_custkey - 3 WHEN c_custkey % 50 = 1 THEN c_custkey + 1 WHEN c_custkey % 50 = 2 THEN c_custkey - 1 WHEN c_custkey % 97 = 5 THEN -1 WHEN c_custkey % 89 = 4 THEN c_custkey END AS target FROM customer"


@query(f"""WITH RECURSIVE n AS ({_CHAIN}), w(start, cur, hops, path, error) AS (SELECT id, id, 0, [id], NULL::VARCHAR FROM n UNION ALL
SELECT w.start, n.target, w.hops + 1, list_append(path, n.target), CASE WHEN n.target = n.id THEN 'self' WHEN list_contains(path, n.target) THEN 'cycle' WHEN NOT EXISTS (SELECT 1 FROM n z WHERE z.id = n.target) THEN 'missing' END FROM w JOIN n ON n.id = w.cur WHERE n.target IS NOT NULL AND w.error IS NULL AND w.hops < 10)
SELECT start AS id, CASE WHEN error IS NULL THEN CAST(cur AS VARCHAR) END AS canonical_id, (CASE WHEN error IS NULL THEN hops ELSE hops - 1 END)::INT AS hops, error FROM w QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1""")
def canonical_chain(s, d):
    """REC1, AG9, DQ1: chains, cycles, missing targets and self references."""
    c = F.col("c_custkey")
    target = (
        F.when((c % 7 == 0) & (c % 5 != 0), c - 1).when((c % 7 == 6) & (c % 4 == 0), c - 3).when(c % 50 == 1, c + 1).when(c % 50 == 2, c - 1).when(c % 97 == 5, F.lit(-1)).when(c % 89 == 4, c)
    )
    rows = table(s, d, "customer").select(c.alias("id"), target.alias("target"))
    return graph.canonical(rows, "id", "target", F.col("target").isNotNull()).select(F.col("id").cast("long").alias("id"), "canonical_id", "hops", "error")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, depth) AS (SELECT 'p7', 0 UNION SELECT b.b, w.depth + 1 FROM w JOIN b ON b.a = w.node WHERE w.depth < 3) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def bfs_depth3(s, d):
    """REC2, GR5."""
    e = table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return graph.reachable(e, s.createDataFrame([("p7",)], "node string"), 3)



@query("""SELECT a.l_partkey AS a, b.l_partkey AS b, count(*)::BIGINT AS n, min(a.l_orderkey)::BIGINT AS first_source FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""")
def cooccurrence_edges(s, d):
    """JN23, GR1."""
    return graph.co_occurrence(table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("""SELECT DISTINCT 'WORKS_AT' AS label, 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'SUBMITTED_BY', 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'BELONGS_TO', 'n' || n_nationkey, 'r' || n_regionkey FROM nation ORDER BY label, b""")
def direct_edges(s, d):
    """GR2, GR3, ST10."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(s, d, "orders")
    made = graph.edges(("WORKS_AT", table(s, d, "customer"), tag("c", "c_custkey"), tag("n", "c_nationkey")), ("SUBMITTED_BY", o, tag("o", "o_orderkey"), tag("c", "o_custkey")), ("BELONGS_TO", table(s, d, "nation"), tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    return made.orderBy("label", "b")



@query("""SELECT p_partkey, 2 AS tier FROM part WHERE contains(lower(p_name), 'ring')""")
def tiered_search(s, d):
    """GR4: id, then exact name, then substring; the first tier with a row answers."""
    p = table(s, d, "part").select("p_partkey", "p_name")
    return retrieve.first_tier([p.where("p_partkey = -1"), p.where("p_name = 'RING'"), p.where(retrieve.containing("p_name", "Ring"))]).select("p_partkey", "tier")


_MERGE = "(SELECT c_custkey AS old, c_custkey - 1 AS new FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 0)"


def _mapping(s, d):
    return table(s, d, "customer").where("c_custkey % 7 = 0 AND c_custkey > 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("new"))


@query(f"SELECT o_orderkey, coalesce(new, o_custkey)::BIGINT AS o_custkey FROM orders LEFT JOIN {_MERGE} m ON o_custkey = old")
def repoint_merge(s, d):
    """DQ10, DQ11, DQ17: every reference follows the merge."""
    return maintenance.repointed(table(s, d, "orders").select("o_orderkey", "o_custkey"), _mapping(s, d), "o_custkey")


@query(f"SELECT c_custkey, CASE WHEN old IS NULL THEN 'active' ELSE 'merged' END AS status, new::BIGINT AS merged_into FROM customer LEFT JOIN {_MERGE} m ON c_custkey = old")
def retire_merged(s, d):
    """DQ10: the row is retired last."""
    return maintenance.retired(table(s, d, "customer").select("c_custkey"), _mapping(s, d), "c_custkey")


@query("""WITH m AS (SELECT CASE WHEN c_custkey % 30 = 0 THEN c_custkey + 100000 ELSE c_custkey END AS old, CASE WHEN c_custkey % 20 = 0 THEN c_custkey ELSE c_custkey + 10 END AS new FROM customer WHERE c_custkey % 10 = 0)
SELECT DISTINCT old, fault FROM (SELECT old, 'self' AS fault FROM m WHERE old = new UNION ALL SELECT old, 'repeated' FROM m GROUP BY old HAVING count(*) > count(DISTINCT new) UNION ALL SELECT old, 'multi_target' FROM m GROUP BY old HAVING count(DISTINCT new) > 1
UNION ALL SELECT old, 'chained' FROM m WHERE new IN (SELECT old FROM m) AND old <> new UNION ALL SELECT old, 'unknown' FROM m WHERE old NOT IN (SELECT c_custkey FROM customer))""")
def plan_validation(s, d):
    """DQ12."""
    c = F.col("c_custkey")
    m = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.when(c % 30 == 0, c + 100000).otherwise(c).alias("old"), F.when(c % 20 == 0, c).otherwise(c + 10).alias("new"))
    return maintenance.plan_faults(m, table(s, d, "customer"), "c_custkey")



@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'restore' END AS verdict FROM customer""")
def rollback_check(s, d):
    """DQ14: restored only where the row still is what the change left."""
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    after = c.withColumn("c_mktsegment", F.lit("MERGED"))
    now = after.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_name")))
    return maintenance.restorable(c, after, now, "c_custkey")



@query("""SELECT c_custkey, coalesce(n.seg, c_mktsegment) AS seg, coalesce(c.c_acctbal, 0) AS bal FROM customer c FULL OUTER JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS seg FROM customer WHERE c_custkey % 3 = 0) n USING (c_custkey)""")
def keyed_upsert(s, d):
    """SNK1, SNK8, Q21: only what is not null is written."""
    old = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("seg"))
    return maintenance.upserted(old, new, "c_custkey").withColumn("bal", F.coalesce("bal", F.lit(0.0)))


@query("""SELECT count(*) FILTER (c_custkey % 10 = 0)::BIGINT AS created, count(*) FILTER (c_custkey % 10 <> 0 AND c_custkey % 4 = 1)::BIGINT AS updated, count(*) FILTER (c_custkey % 10 <> 0 AND c_custkey % 4 <> 1)::BIGINT AS unchanged, 0::BIGINT AS removed FROM customer""")
def sink_changes(s, d):
    """SNK4: what an incremental sink would write."""
    c = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("content"))
    new = c.withColumn("content", F.when(F.col("c_custkey") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return maintenance.snapshot_changes(c.where("c_custkey % 10 <> 0"), new, "c_custkey", F.col("content"))


@query("""SELECT count(*)::BIGINT AS rows_, count(*) FILTER (p_type IS NOT NULL OR p_size IS NOT NULL)::BIGINT AS had FROM part""")
def field_removal(s, d):
    """SNK6: rows before, and rows that had one of the fields."""
    df = table(s, d, "part")
    _, had = maintenance.dropped(df, "p_type", "p_size")
    return df.agg(F.count(F.lit(1)).alias("rows_"), had.alias("had"))


@query("""SELECT count(*)::BIGINT AS kept FROM part WHERE NOT (starts_with(p_name, 'red') OR starts_with(p_type, 'red'))""")
def prefix_delete(s, d):
    """SNK7."""
    return maintenance.without_prefix(table(s, d, "part"), "red", "p_name", "p_type").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT c_custkey, printf('THR-%03d', row_number() OVER (ORDER BY c_custkey)) AS id FROM customer WHERE c_nationkey = 5""")
def backfill_ids(s, d):
    """SNK9, ER1's numbers."""
    from quillgraph.operators import windows

    return windows.ids(table(s, d, "customer").where("c_nationkey = 5").select("c_custkey"), "THR", "id", "c_custkey")


@query("""SELECT 'm' || conv_id || '-' || turn AS source_message_id, 't' || conv_id AS source_thread_id, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END::INT AS n_to FROM conversations WHERE turn % 7 <> 3""")
def converted_records(s, d):
    """SRC1-SRC4: required fields that are null or empty drop the record; null recipients become an empty list."""
    c = table(s, d, "conversations")
    raw = c.select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("threadId"),
        F.when(F.col("turn") % 7 == 3, "").otherwise("subject").alias("subject"), F.lit("Ann <ann@x.example>").alias("sender"), F.when(F.col("turn") % 3 != 0, F.array(F.lit("bo@y.example"))).alias("toRecipients"),
        F.lit(None).cast("array<string>").alias("ccRecipients"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("text").alias("plaintextBody"),
    )
    return export.converted(raw).select("source_message_id", "source_thread_id", F.size("to").alias("n_to"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (1, 5, 9) OR c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)""")
def historical_scan(s, d):
    """SRC9: named ids, or the newest n."""
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    newest = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    return retrieve.among(c, "c_custkey", [1, 5, 9]).unionByName(newest).select("c_custkey").distinct()


@query()
def thread_resolution(s, d):
    """ER1: each mail's thread by the five signals, in order of time, within the mails that can meet."""
    k, turn = F.col("conv_id"), F.col("turn")
    name = lambda n: F.concat_ws("-", k.cast("string"), (turn - n).cast("string"))
    no_refs = F.array().cast("array<string>")
    mails = table(s, d, "conversations").select(
        name(0).alias("message_id"), F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).alias("source_thread_id"), F.when((k % 4 == 1) & (turn > 0), name(1)).alias("in_reply_to"),
        F.when((k % 4 == 2) & (turn > 1), F.array(name(2), F.lit("lost"))).otherwise(no_refs).alias("references"), F.concat(F.lit("Re: topic "), (k % 5).cast("string")).alias("subject"),
        F.array(F.concat(F.lit("u"), (k % 20).cast("string"), F.lit("@x.example")), F.concat(F.col("role"), (k % 7).cast("string"))).alias("participants"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((turn * 3 + k % 40).cast("int"))).alias("at"),
    )
    return resolve.threads(mails)


@query("""SELECT user_id, event_type, count(*)::BIGINT AS mentions FROM events GROUP BY 1, 2""")
def facts_by_key(s, d):
    """How often each exact key is mentioned."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("mentions"))


@query()
def fact_dedup(s, d):
    """ER14: exact key, then a ratio of 90, then 60 to 90 verified at 80; else a new fact."""
    p = table(s, d, "part").select((F.col("p_partkey") % 50).cast("string").alias("thread_id"), F.lit("customer").alias("subject_key"), F.lit("wants").alias("predicate"), F.col("p_name").alias("object"), F.col("p_partkey").alias("seq"))
    return resolve.facts(p)


@query("""SELECT regexp_replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '^www\\.', '') AS domain, count(*)::BIGINT AS pages, min(page_id)::BIGINT AS first_page FROM pages GROUP BY 1""")
def organization_resolution(s, d):
    """ER3, DQ16: organizations by domain."""
    return table(s, d, "pages").select("page_id", text.website_domain(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
