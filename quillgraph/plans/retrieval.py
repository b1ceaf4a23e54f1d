"""Retrieval, enrichment and set operations over the test tables (FLT, PRJ, ST, SET, JN1-JN13, Q1-Q10, Q16, Q18-Q20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import arrays, dates
from quillgraph.operators import joins, retrieve
from quillgraph.plans.registry import EVENTS_NOW, ORDERS_NOW, query, table

# commitments = orders, people = customers, organizations = nations, follow-ups = line items, meetings = events


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
AND o_orderdate < TIMESTAMP '1998-06-17 10:00:00' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50""")
def retrieve_commitments_overdue(s, d):
    """Q2, FLT1, FLT7, ST1-ST4: what was due before now, of one class and status, latest first, at most 50."""
    rows = retrieve.matching(_orders(s, d), o_orderpriority="1-URGENT", o_orderstatus="O", o_custkey=None)
    return retrieve.retrieved(rows, F.col("o_orderdate"), "o_orderkey", "overdue", dates.date_range("overdue", ORDERS_NOW)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


BOUNDS = {
    "today": ("1998-06-17", "1998-06-18"), "tomorrow": ("1998-06-18", "1998-06-19"), "yesterday": ("1998-06-16", "1998-06-17"),
    "this_week": ("1998-06-15", "1998-06-22"), "next_week": ("1998-06-22", "1998-06-29"), "last_week": ("1998-06-08", "1998-06-15"),
    "this_month": ("1998-06-01", "1998-07-01"), "next_month": ("1998-07-01", "1998-08-01"), "upcoming": ("1998-06-17 10:00:00", None),
    "overdue": (None, "1998-06-17 10:00:00"), "recent": ("1998-06-10 10:00:00", "1998-06-17 10:00:00"), "all_time": (None, None), "latest": (None, None),
    "between": ("1997-01-01", "1997-03-01"), "before": (None, "1996-01-01"), "after": ("2001-01-01", None),
}


def _range(kind):
    low, high = BOUNDS[kind]
    where = " AND ".join(x for x in (f"o_orderdate >= TIMESTAMP '{low}'" if low else "", f"o_orderdate < TIMESTAMP '{high}'" if high else "") if x) or "TRUE"
    down = kind in ("latest", "recent", "overdue")
    sql = f"SELECT o_orderkey, o_orderdate FROM orders WHERE {where} ORDER BY o_orderdate {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, o_orderkey LIMIT {1 if kind == 'latest' else 200}"

    def run(s, d):
        from datetime import datetime
        from zoneinfo import ZoneInfo

        explicit = {"between": ("1997-01-01", "1997-03-01"), "before": (None, "1996-01-01"), "after": ("2001-01-01", None)}.get(kind, (None, None))
        at = [x and datetime.fromisoformat(x).replace(tzinfo=ZoneInfo("UTC")) for x in explicit]
        rows = _orders(s, d).select("o_orderkey", "o_orderdate")
        return retrieve.retrieved(rows, F.col("o_orderdate"), "o_orderkey", kind, dates.date_range(kind, ORDERS_NOW, "UTC", *at), 999)

    query(sql, f"range_{kind}")(run)


for _kind in BOUNDS:
    _range(_kind)


@query("""SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' ORDER BY ts ASC NULLS FIRST, event_id LIMIT 200""")
def retrieve_meetings_this_week(s, d):
    """Q1."""
    rows = retrieve.matching(table(s, d, "events").select("event_id", "ts", "user_id", "event_type"), event_type="purchase").drop("event_type")
    return retrieve.retrieved(rows, F.col("ts"), "event_id", "this_week", dates.date_range("this_week", EVENTS_NOW), 200)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1998-06-17 10:00:00'
ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200""")
def retrieve_follow_ups_overdue(s, d):
    """Q3, FLT9: overdue and active."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus").where(F.col("l_linestatus") == "O").drop("l_linestatus")
    rows = rows.where(dates.in_range(F.col("l_shipdate"), "overdue", dates.date_range("overdue", ORDERS_NOW)))
    return rows.orderBy(F.col("l_shipdate").desc_nulls_last(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(200)


@query("""SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 7 ORDER BY ts DESC NULLS LAST, event_id LIMIT 50""")
def retrieve_knowledge(s, d):
    """Q4, AR9."""
    rows = retrieve.matching(table(s, d, "events"), user_id=7).orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(retrieve.clamp(50))
    return rows.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""SELECT conv_id, turn, substr(text, 1, 150) AS preview FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 20""")
def retrieve_reply_drafts(s, d):
    """Q5, PRJ3."""
    rows = retrieve.matching(table(s, d, "conversations"), role="assistant").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)
    return rows.select("conv_id", "turn", retrieve.preview("text").alias("preview"))


@query("""WITH last AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 1) SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM last)""")
def retrieve_latest_thread(s, d):
    """Q6, AG11: the thread that is latest, then its rows."""
    c = table(s, d, "conversations").select("conv_id", "turn", "role")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m")).orderBy(F.desc("m"), "conv_id").limit(1).select("conv_id")
    return c.join(last, "conv_id", "left_semi")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def email_activity_by_org(s, d):
    """Q7, JN7, FLT4: activity of an organization's people."""
    people = retrieve.matching(table(s, d, "customer").select("c_custkey", "c_nationkey"), c_nationkey=3)
    rows = _orders(s, d).join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 200) WHERE o_orderstatus = 'O'""")
def open_commitments_after_limit(s, d):
    """Q9, ST5: the limit comes before the filter, so rows past 200 are not seen."""
    rows = _orders(s, d).orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(200)
    return rows.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderpriority AS level, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def followups_by_level(s, d):
    """Q10, FLT4."""
    return retrieve.among(_orders(s, d).where("o_orderstatus = 'O'"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).groupBy(F.col("o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')""")
def filter_substring(s, d):
    """FLT6."""
    return table(s, d, "part").where(retrieve.containing("p_name", "RING")).select("p_partkey", "p_name")


@query("""SELECT user_id, count(*)::BIGINT AS n FROM events WHERE list_contains(string_split(event_type || ',all', ','), 'click') GROUP BY 1""")
def filter_array_member(s, d):
    """FLT2."""
    rows = table(s, d, "events").select("user_id", F.split(F.concat("event_type", F.lit(",all")), ",").alias("tags"))
    return rows.where(F.array_contains("tags", "click")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (s.role = 'user')::BIGINT AS n_user, count(*) FILTER (s.role <> 'user')::BIGINT AS n_other FROM (SELECT {'role': role, 'turn': turn} AS s FROM conversations)""")
def filter_nested_path(s, d):
    """FLT3, PRJ2."""
    rows = table(s, d, "conversations").select(F.struct("role", "turn").alias("s"))
    return rows.agg(F.count_if(F.col("s.role") == "user").alias("n_user"), F.count_if(F.col("s.role") != "user").alias("n_other"))


@query("""SELECT count(*) FILTER (v IS NULL)::BIGINT AS n_null, count(*) FILTER (v IS NOT NULL AND v NOT IN ('O','F'))::BIGINT AS n_other FROM (SELECT nullif(o_orderstatus, 'P') AS v FROM orders)""")
def filter_exists(s, d):
    """FLT5."""
    rows = _orders(s, d).select(F.nullif("o_orderstatus", F.lit("P")).alias("v"))
    return rows.agg(F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(~F.col("v").isin("O", "F")).alias("n_other"))


@query("""SELECT count(*)::BIGINT AS n FROM orders WHERE try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) >= TIMESTAMP '1998-01-01'""")
def filter_lenient_dates(s, d):
    """FLT8: what is no date is left out."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _orders(s, d).where(dates.lenient_time(text) >= F.lit("1998-01-01").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*)::BIGINT AS n FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'closed' END, 'active') = 'active'""")
def filter_default_active(s, d):
    """FLT9."""
    rows = _orders(s, d).withColumn("status", F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed"))
    return rows.where(retrieve.active("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*)::BIGINT AS n FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL AND c_acctbal IS NOT NULL""")
def filter_required_fields(s, d):
    """FLT10, FLT11."""
    rows = table(s, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return rows.where(F.col("segment").isNotNull() & F.col("c_acctbal").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment IS DISTINCT FROM s2 THEN 'segment:' || c_mktsegment || '>' || s2 END) AS delta FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'AUTO' ELSE c_mktsegment END AS s2 FROM customer)""")
def field_delta(s, d):
    """PRJ6."""
    rows = table(s, d, "customer").withColumn("s2", F.when(F.col("c_custkey") % 3 == 0, "AUTO").otherwise(F.col("c_mktsegment")))
    delta = arrays.changed_fields({"segment": F.col("c_mktsegment")}, {"segment": F.col("s2")})
    return rows.select("c_custkey", F.array_join(F.transform(F.map_entries(delta), lambda e: F.concat(e.key, F.lit(":"), e["value"].old, F.lit(">"), e["value"].new)), ",").alias("delta"))



@query("""SELECT n_name, n_nationkey, 'canonical_id' AS basis FROM nation""")
def project_priority_columns(s, d):
    """PRJ1, PRJ4, PRJ7."""
    return retrieve.columns_first(table(s, d, "nation").select("n_nationkey", "n_name"), "n_name").withColumn("basis", F.lit("canonical_id"))


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50""")
def page_of_orders(s, d):
    """ST8, SRC10."""
    return retrieve.page(_orders(s, d).select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 50, 25)


@query("""SELECT p.id, c.c_name FROM (SELECT 'FUP-' || c_custkey AS id, c_custkey FROM customer ORDER BY id LIMIT 40) p JOIN customer c USING (c_custkey)""")
def limit_before_enrichment(s, d):
    """ST7, ST9: by the id as text, limited before the lookup."""
    c = table(s, d, "customer").select("c_custkey", "c_name")
    first = c.select(F.concat(F.lit("FUP-"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey").orderBy("id").limit(40)
    return first.join(c, "c_custkey").select("id", "c_name")


@query("""SELECT event_id FROM events ORDER BY coalesce(try_cast(CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP), TIMESTAMP '0001-01-01'), event_id LIMIT 30""")
def chronological_sort(s, d):
    """ST6: bad dates come before all others."""
    text = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    at = F.coalesce(text.try_cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    return table(s, d, "events").orderBy(at, "event_id").limit(30).select("event_id")


@query("""SELECT c.c_custkey, c.c_name, n.n_name AS company FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def people_with_org(s, d):
    """JN1."""
    c, n = table(s, d, "customer"), table(s, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", F.col("n_name").alias("company"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_orderpriority AS what, c.c_name AS person, n.n_name AS company FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey
LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey WHERE l_linestatus = 'O' AND l_returnflag = 'R'""")
def enrich_follow_ups(s, d):
    """JN2, JN9, Q24."""
    line = table(s, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, c, n = _orders(s, d), table(s, d, "customer"), table(s, d, "nation")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderpriority").alias("what"), F.col("c_name").alias("person"), F.col("n_name").alias("company"))


@query("""SELECT e.event_id, coalesce(c.c_name, CAST(e.user_id AS VARCHAR)) AS label FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = e.user_id""")
def label_fallback(s, d):
    """JN3, JN4."""
    some = table(s, d, "customer").where("c_custkey % 2 = 0")
    return joins.labelled(table(s, d, "events").select("event_id", "user_id"), "user_id", some, "c_custkey", "c_name", "label").select("event_id", "label")


@query("""SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY conv_id""")
def meeting_title_first_row(s, d):
    """JN5."""
    return joins.first_by(table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("title")), "conv_id", "title", "turn")


@query("""WITH t AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT p, max(l_orderkey)::BIGINT AS thread FROM (SELECT unnest(parts) AS p, l_orderkey FROM t) GROUP BY p""")
def message_index(s, d):
    """JN6: each message's thread by its list; the last writer wins."""
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return t.select(F.explode("parts").alias("p"), "l_orderkey").groupBy("p").agg(F.max("l_orderkey").alias("thread"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')""")
def not_yet_ingested(s, d):
    """JN8, SRC7."""
    return table(s, d, "customer").select("c_custkey").join(retrieve.matching(_orders(s, d), o_orderpriority="1-URGENT"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT 'people' AS category, count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'suppliers', count(*)::BIGINT FROM supplier WHERE s_nationkey = 4
UNION ALL SELECT 'commitments', count(*)::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4""")
def company_summary(s, d):
    """JN10, Q14, Q20, SET7."""
    people = table(s, d, "customer").where("c_nationkey = 4")
    parts = {"people": people, "suppliers": table(s, d, "supplier").where("s_nationkey = 4"), "commitments": _orders(s, d).join(people, F.col("o_custkey") == F.col("c_custkey"))}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("category"), "n") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM events a JOIN events b ON a.event_type = b.event_type AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.user_id <> b.user_id WHERE a.event_type = 'purchase'""")
def related_people(s, d):
    """JN12."""
    e = table(s, d, "events").where("event_type = 'purchase'").select("user_id", F.array(F.to_date("ts")).alias("threads"))
    return joins.overlap_pairs(e, "user_id", F.col("threads"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def same_org_pairs(s, d):
    """JN13, JN18."""
    return joins.anchored_pairs(table(s, d, "supplier"), "s_suppkey", F.col("s_nationkey"))


@query("""SELECT o.o_orderkey, e.event_id, 'shared_thread' AS basis FROM orders o JOIN events e ON e.user_id = o.o_custkey WHERE o.o_orderpriority = '1-URGENT' AND e.event_type = 'error'""")
def indirect_by_thread(s, d):
    """JN11."""
    o = retrieve.matching(_orders(s, d), o_orderpriority="1-URGENT")
    e = table(s, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return o.join(e, F.col("o_custkey") == F.col("user_id")).select("o_orderkey", "event_id", F.lit("shared_thread").alias("basis"))


@query("""SELECT 'commitment' AS record_type, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS at FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'meeting', CAST(event_id AS VARCHAR), ts FROM events WHERE event_type = 'purchase'""")
def cross_entity_union(s, d):
    """SET1, SET2, AR7: unlike records as one evidence relation."""
    o = _orders(s, d).where("o_orderpriority = '2-HIGH'")
    e = table(s, d, "events").where("event_type = 'purchase'")
    a = retrieve.evidence(o, "commitment", "o_orderkey", ["o_orderstatus"], "o_orderdate", person=F.col("o_custkey"))
    b = retrieve.evidence(e, "meeting", "event_id", ["event_type"], "ts", person=F.col("user_id"))
    return a.unionByName(b).select("record_type", "record_id", "at")



@query("""WITH v AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, ['A', 'R'])), ',') AS both_, array_to_string(list_sort(list_filter(a, lambda x: x NOT IN ('A', 'R'))), ',') AS only_, len(list_distinct(list_concat(a, b)))::BIGINT AS n_any FROM v""")
def array_set_operations(s, d):
    """SET3-SET6."""
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    known = F.array(F.lit("A"), F.lit("R"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return v.select("l_orderkey", join(F.array_intersect("a", known)).alias("both_"), join(F.array_except("a", known)).alias("only_"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))


@query("""SELECT role, count(*)::BIGINT AS n, sum(length(substr(text, 1, 150)))::BIGINT AS shown FROM conversations WHERE contains(lower(text), 'the') GROUP BY role""")
def search_emails(s, d):
    """Q18, FLT6."""
    rows = table(s, d, "conversations").where(retrieve.containing("text", "the"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(retrieve.preview("text"))).alias("shown"))


@query("""SELECT * FROM (SELECT 'commitment' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-17 10:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'meeting', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-18' ORDER BY ts, event_id LIMIT 20)""")
def whats_on_my_table(s, d):
    """Q16."""
    o = retrieve.retrieved(retrieve.matching(_orders(s, d), o_orderstatus="O"), F.col("o_orderdate"), "o_orderkey", "overdue", dates.date_range("overdue", ORDERS_NOW), 20)
    e = retrieve.retrieved(retrieve.matching(table(s, d, "events"), event_type="purchase"), F.col("ts"), "event_id", "today", dates.date_range("today", EVENTS_NOW), 20)
    return o.select(F.lit("commitment").alias("kind"), F.col("o_orderkey").cast("string").alias("id")).unionByName(e.select(F.lit("meeting").alias("kind"), F.col("event_id").cast("string").alias("id")))
