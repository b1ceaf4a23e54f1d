"""Merges executed over every table that refers to the records, as one staged commit (DQ10, DQ11, DQ15, DQ17, SNK5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import staged
from quillgraph.operators.staged import Reference, Store
from quillgraph.plans.registry import query, table
from quillgraph.tables import removed, shared_path, written

PERSON = [
    Reference("threads", ("id",), lists=("person_ids",)), Reference("commitments", ("id",), ("person_id",)), Reference("meetings", ("id",), lists=("person_ids",)), Reference("follow_ups", ("id",), ("person_id",)),
    Reference("projects", ("id",), lists=("person_ids",)), Reference("knowledge_items", ("id",), ("person_id",)), Reference("reply_drafts", ("id",), ("person_id",)), Reference("calendar_actions", ("id", "place"), ("person_id",)),
]
ORGANIZATION = [Reference(t, ("id",), ("org_id",)) for t in "people projects opportunities commitments follow_ups meetings knowledge_items reply_drafts calendar_actions".split()] + [Reference("threads", ("id",), lists=("org_ids",))]


def person_tables(s, d) -> dict[str, DataFrame]:
    """Customers as people; the eight tables that refer to them, from the given tables."""
    long = lambda c: F.expr(f"cast({c} as bigint)")
    orders = table(s, d, "orders").select(long("o_orderkey").alias("id"), long("o_custkey").alias("person_id"), "o_orderstatus")
    of = lambda status: orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
    talks = table(s, d, "conversations").select(long("conv_id").alias("id"), long("turn").alias("place"), long("conv_id").alias("person_id"))
    return {
        "people": table(s, d, "customer").select(long("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("merged_into")),
        "threads": table(s, d, "events").select(long("event_id").alias("id"), F.array(long("user_id"), long("user_id + 1"), long("user_id")).alias("person_ids")),
        "commitments": of("O"), "follow_ups": of("P"), "meetings": of("F").select("id", F.array(F.col("person_id"), F.col("person_id") - 1).alias("person_ids")),
        "projects": table(s, d, "part").select(long("p_partkey").alias("id"), F.array(long("p_partkey % 1000")).alias("person_ids")),
        "knowledge_items": table(s, d, "lineitem").select(long("l_orderkey").alias("id"), long("l_suppkey").alias("person_id")),
        "reply_drafts": table(s, d, "documents").select(long("doc_id").alias("id"), long("doc_id % 500").alias("person_id")),
        "calendar_actions": talks.withColumn("attendees", F.when(F.col("id") % 97 == 5, F.array(F.lit("a@x.example")))),
    }


def person_plan(s, d) -> DataFrame:
    """Every seventh customer is the one before; one in five of these pairs is not approved."""
    c = table(s, d, "customer").where("c_custkey % 7 = 0 AND c_custkey > 0").select(F.col("c_custkey").cast("long").alias("old"), (F.col("c_custkey") - 1).cast("long").alias("new"))
    return c.withColumn("approved", F.col("old") % 5 != 0)


def merge_people(store: Store, plan: DataFrame, run: str) -> tuple[staged.Run, DataFrame]:
    """The run, and the pairs that the calendar gate let through."""
    allowed = staged.gated(staged.approved(plan, store.table("people", 0), "id"), store.table("calendar_actions", 0), "person_id", F.col("attendees"))
    mapping = written(allowed.where("not blocked").select("old", "new"), "mapping")
    return staged.execute(store, run, plan, staged.merge_steps(PERSON, mapping, "people", "id"), staged.stray(PERSON, mapping)), mapping


def references(store: Store, specs: list[Reference]) -> DataFrame:
    """collection, n_rows, n_references and their sum."""
    parts = []
    for r in specs:
        uses = F.concat(*([F.array(*r.scalars)] if r.scalars else []), *r.lists)
        parts.append(store.table(r.table).select(F.lit(r.table).alias("collection"), F.size(uses).alias("n"), F.aggregate(uses, F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))
    return reduce(DataFrame.unionByName, parts).groupBy("collection").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_references"), F.sum("total").alias("total"))


_PEOPLE_SQL = """WITH a AS (SELECT c_custkey AS old, c_custkey - 1 AS new FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 0 AND c_custkey % 5 <> 0), o AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 97 = 5),
m AS (SELECT * FROM a WHERE old NOT IN (SELECT conv_id FROM o) AND new NOT IN (SELECT conv_id FROM o)),
l AS (SELECT 'threads' AS collection, row_number() OVER () AS r, [user_id, user_id + 1, user_id] AS v FROM events UNION ALL SELECT 'meetings', o_orderkey, [o_custkey, o_custkey - 1] FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'projects', p_partkey, [p_partkey % 1000] FROM part),
e AS (SELECT collection, r, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM l), f AS (SELECT collection, r, k, x, m.new, coalesce(m.new, x) AS y, max(m.new IS NOT NULL) OVER (PARTITION BY collection, r) AS hit FROM e LEFT JOIN m ON m.old = x),
g AS (SELECT *, row_number() OVER (PARTITION BY collection, r, y ORDER BY k) AS again FROM f), k AS (SELECT collection, r, y FROM g WHERE NOT hit OR again = 1),
s AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'commitments' ELSE 'follow_ups' END AS collection, o_custkey AS x FROM orders WHERE o_orderstatus IN ('O', 'P') UNION ALL SELECT 'knowledge_items', l_suppkey FROM lineitem UNION ALL SELECT 'reply_drafts', doc_id % 500 FROM documents UNION ALL SELECT 'calendar_actions', conv_id FROM conversations)
SELECT l.collection, l.n::BIGINT AS n_rows, k.n::BIGINT AS n_references, k.total::BIGINT AS total FROM (SELECT collection, count(*) AS n FROM l GROUP BY 1) l JOIN (SELECT collection, count(*) AS n, sum(y) AS total FROM k GROUP BY 1) k USING (collection)
UNION ALL SELECT collection, count(*)::BIGINT, count(*)::BIGINT, sum(coalesce(m.new, x))::BIGINT FROM s LEFT JOIN m ON m.old = x GROUP BY 1
UNION ALL SELECT 'people merged', count(*)::BIGINT, count(*)::BIGINT, sum(new)::BIGINT FROM m"""


@query(_PEOPLE_SQL)
def staged_person_merge(s, d):
    """DQ10, DQ15: an approved plan over the eight tables that name people, calendar gate first, retired last; one manifest at the end."""
    store = Store(s, shared_path(s, "people-store"))
    store.create(**person_tables(s, d))
    merge_people(store, person_plan(s, d), "merge")
    gone = store.table("people").where("status = 'merged'").agg(F.lit("people merged").alias("collection"), F.count(F.lit(1)).alias("n_rows"), F.count("merged_into").alias("n_references"), F.sum("merged_into").alias("total"))
    out = written(references(store, PERSON).unionByName(gone), "merged")
    removed(s, store.root)
    return out


def organization_tables(s, d) -> dict[str, DataFrame]:
    """Suppliers as organizations; the ten tables that refer to them."""
    k = lambda t, key, org, **more: table(s, d, t).select(F.expr(key).cast("long").alias("id"), F.expr(org).cast("long").alias("org_id"), *(F.expr(v).alias(n) for n, v in more.items()))
    site = F.when(F.col("s_suppkey") % 4 > 1, F.concat(F.lit("site"), F.col("s_suppkey").cast("string")))
    return {
        "organizations": table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), site.alias("website"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("merged_into")),
        "people": k("customer", "c_custkey", "c_custkey % 100"), "projects": k("part", "p_partkey", "p_partkey % 90"), "opportunities": k("orders", "o_orderkey", "o_custkey % 80"), "commitments": k("orders", "o_orderkey", "o_orderkey % 70"),
        "follow_ups": k("events", "event_id", "user_id % 60"), "meetings": k("events", "event_id", "event_id % 50"), "reply_drafts": k("documents", "doc_id", "doc_id % 40"), "calendar_actions": k("conversations", "conv_id", "turn"),
        "knowledge_items": k("lineitem", "l_orderkey", "l_suppkey", predicate="CASE WHEN l_linenumber % 2 = 1 THEN 'works_at' ELSE 'likes' END", current_value="concat('org ', l_suppkey)"),
        "threads": table(s, d, "pages").select(F.col("page_id").cast("long").alias("id"), F.array((F.col("page_id") % 30).cast("long"), (F.col("page_id") % 31).cast("long")).alias("org_ids")),
    }


def merge_organizations(store: Store, plan: DataFrame, run: str) -> staged.Run:
    mapping = staged.approved(plan, store.table("organizations", 0), "id")
    steps = staged.merge_steps(ORGANIZATION, mapping, "organizations", "id", {"knowledge_items": staged.works_at(mapping, "organizations", "id", "name")}, staged.absorbing(mapping, "id", "name", "aliases", ["website"]))
    return staged.execute(store, run, plan, steps, staged.stray(ORGANIZATION, mapping))


def organization_plan(s, d) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return table(s, d, "supplier").where("s_suppkey % 4 > 0 and s_suppkey > 4").select(k.alias("old"), (k - k % 4).alias("new"), F.lit(True).alias("approved"))


_ORG_SCALARS = [("people", "customer", "c_custkey % 100"), ("projects", "part", "p_partkey % 90"), ("opportunities", "orders", "o_custkey % 80"), ("commitments", "orders", "o_orderkey % 70"), ("follow_ups", "events", "user_id % 60"), ("meetings", "events", "event_id % 50"), ("reply_drafts", "documents", "doc_id % 40"), ("calendar_actions", "conversations", "turn"), ("knowledge_items", "lineitem", "l_suppkey")]


@query(f"""WITH m AS (SELECT s_suppkey AS old, s_suppkey - s_suppkey % 4 AS new FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey > 4),
s AS ({" UNION ALL ".join(f"SELECT '{c}' AS collection, {x} AS x FROM {t}" for c, t, x in _ORG_SCALARS)}),
l AS (SELECT page_id AS r, unnest([page_id % 30, page_id % 31]) AS x, unnest([1, 2]) AS k FROM pages), f AS (SELECT r, k, coalesce(m.new, x) AS y, max(m.new IS NOT NULL) OVER (PARTITION BY r) AS hit FROM l LEFT JOIN m ON m.old = x),
g AS (SELECT *, row_number() OVER (PARTITION BY r, y ORDER BY k) AS again FROM f), t AS (SELECT y FROM g WHERE NOT hit OR again = 1)
SELECT collection, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_references, sum(coalesce(m.new, x))::BIGINT AS total FROM s LEFT JOIN m ON m.old = x GROUP BY 1
UNION ALL SELECT 'threads', (SELECT count(*) FROM pages)::BIGINT, count(*)::BIGINT, sum(y)::BIGINT FROM t
UNION ALL SELECT 'works_at renamed', count(*)::BIGINT, count(DISTINCT o.s_name)::BIGINT, sum(m.new)::BIGINT FROM lineitem JOIN m ON m.old = l_suppkey JOIN supplier o ON o.s_suppkey = m.new WHERE l_linenumber % 2 = 1
UNION ALL SELECT 'aliases', count(DISTINCT new)::BIGINT, count(*)::BIGINT, sum(new)::BIGINT FROM m
UNION ALL SELECT 'websites', count(*)::BIGINT, count(*)::BIGINT, sum(id)::BIGINT FROM (SELECT DISTINCT new AS id FROM m WHERE old % 4 > 1)""")
def staged_organization_merge(s, d):
    """DQ11: nine tables and one list follow, facts of where people work are renamed, names become aliases, blanks are filled, the merged retire."""
    store = Store(s, shared_path(s, "organization-store"))
    store.create(**organization_tables(s, d))
    merge_organizations(store, organization_plan(s, d), "merge")
    row = lambda df, name, n, total: df.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n_rows"), n.alias("n_references"), F.sum(total).cast("long").alias("total"))
    known = store.table("organizations")
    named = store.table("knowledge_items").where("predicate = 'works_at' and current_value not like 'org %'").join(known.select(F.col("name").alias("current_value"), F.col("id").alias("at")), "current_value")
    stays = known.where("status = 'active' and size(aliases) > 0")
    out = references(store, ORGANIZATION).unionByName(row(named, "works_at renamed", F.count_distinct("current_value"), F.col("at"))).unionByName(row(stays, "aliases", F.sum(F.size("aliases")).cast("long"), F.col("id") * F.size("aliases")))
    out = out.unionByName(row(stays.where("website is not null"), "websites", F.count("website"), F.col("id")))
    out = written(out, "merged")
    removed(s, store.root)
    return out


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'plain' ELSE 'damaged' END AS kind FROM customer)
SELECT damage, CASE WHEN damage IN ('none', 'other order') THEN 'accepted' ELSE 'refused' END AS verdict, (SELECT count(*) FROM p)::BIGINT + CASE damage WHEN 'a row more' THEN 1 WHEN 'a row less' THEN -1 WHEN 'a row twice' THEN 1 ELSE 0 END AS n_rows
FROM (VALUES ('none'), ('other order'), ('a row more'), ('a row less'), ('a row twice'), ('a value changed'), ('two values swapped')) v(damage)""")
def plan_damage(s, d):
    """SNK5: a written plan of all customers is accepted as it is, in any order, and refused after each kind of damage."""
    plan = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("old"), (F.col("c_custkey") - 1).cast("long").alias("new"))
    first = plan.agg(F.min("old")).first()[0]
    swap = F.when(F.col("old") == first, first + 1).when(F.col("old") == first + 1, first).otherwise(F.col("old"))
    damaged = {
        "none": plan, "other order": plan.orderBy(F.desc("new")), "a row more": plan.unionByName(plan.agg((F.max("old") + 1).alias("old"), F.max("old").alias("new"))), "a row less": plan.where(F.col("old") != first),
        "a row twice": plan.unionByName(plan.where(F.col("old") == first)), "a value changed": plan.withColumn("new", F.when(F.col("old") == first, F.lit(None)).otherwise(F.col("new"))), "two values swapped": plan.withColumn("old", swap),
    }
    right = staged.checksum(plan)
    rows = [(name, "accepted" if (found := staged.checksum(df)) == right else "refused", int(found.split("-")[0])) for name, df in damaged.items()]
    return s.createDataFrame(rows, "damage string, verdict string, n_rows long")
