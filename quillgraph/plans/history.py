"""Valid-time intervals and their as-of join (ER20), all reference checks as one join (JN21, DQ3, DQ13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import joins, windows
from quillgraph.plans.registry import query, table

_HELD = """l AS (SELECT client_id, valid_at, arg_max(struct_pack(v := CASE WHEN op = 'D' THEN NULL ELSE city END), struct_pack(s := seq, c := change_id)) AS r FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY 1, 2),
p AS (SELECT client_id, valid_at, r.v AS value, lag(r.v) OVER w AS before, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY client_id ORDER BY valid_at)),
h AS (SELECT client_id, value, valid_at AS valid_from, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at) AS valid_to FROM p WHERE n = 1 OR value IS DISTINCT FROM before),
held AS (SELECT * FROM h WHERE value IS NOT NULL)"""


def _held(s, d) -> DataFrame:
    return windows.intervals(table(s, d, "client_changes"), "client_id", "valid_at", F.col("city"), "seq", "change_id", ended=F.col("op") == "D")


@query(f"WITH {_HELD} SELECT * FROM held")
def city_history(s, d):
    """ER20: from when to when each client was of a city; a repeated, late or equal change starts nothing, a deletion ends it."""
    return _held(s, d)


@query(f"WITH {_HELD} SELECT sale_id, s.client_id, sold_at, value AS city, valid_from FROM sales s JOIN held ON held.client_id = s.client_id AND sold_at >= valid_from AND (valid_to IS NULL OR sold_at < valid_to)")
def city_at_sale(s, d):
    """ER20: who was where on a date: each sale with what held for its client at that time."""
    sales = table(s, d, "sales").select("sale_id", "client_id", "sold_at")
    return windows.valid_when(sales, _held(s, d), "client_id", "sold_at").select("sale_id", "client_id", "sold_at", F.col("value").alias("city"), "valid_from")


_SPECS = {
    ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("events", "user_id", "customer"), ("sales", "client_id", "clients"),
    ("sale_lines", "sale_id", "sales"), ("sale_lines", "item_id", "items"), ("sale_lines", "vendor_id", "vendors"), ("clients", "master_id", "clients"), ("clicks", "client_id", "clients"),
}
_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "clients": "client_id", "sales": "sale_id", "items": "item_id", "vendors": "vendor_id"}
#: Which records count as merged into another.
_MERGED = {"clients": "master_id IS NOT NULL AND master_id <> client_id", "supplier": "s_suppkey % 4 = 3"}


def _spec_sql() -> str:
    known = {t: f"(SELECT {k} AS k, bool_and(coalesce({_MERGED.get(t, 'false')}, false)) AS merged FROM {t} GROUP BY 1)" for t, k in _KEYS.items()}
    parts = [f"SELECT '{c}' AS collection, '{f}' AS field, count(*)::BIGINT AS n_references, count(*) FILTER (k.merged IS NULL)::BIGINT AS dangling, count(*) FILTER (k.merged)::BIGINT AS merged FROM {c} x LEFT JOIN {known[t]} k ON k.k = x.{f} WHERE x.{f} IS NOT NULL" for c, f, t in sorted(_SPECS)]
    lists = f"SELECT 'pairs' AS collection, 'people' AS field, count(*)::BIGINT AS n_references, count(*) FILTER (k.merged IS NULL)::BIGINT AS dangling, 0::BIGINT AS merged FROM (SELECT unnest([user_id, user_id + 1]) AS v FROM events) x LEFT JOIN {known['customer']} k ON k.k = x.v"
    return f"SELECT * FROM ({' UNION ALL '.join([*parts, lists])}) WHERE n_references > 0"


@query(_spec_sql())
def reference_report(s, d):
    """JN21, JN22, DQ2, DQ3, DQ13: references, dangling ones and ones to merged records, of eleven fields and a list, by one join."""
    by: dict[str, dict] = {}
    for c, f, t in sorted(_SPECS):
        by.setdefault(c, {})[f] = (F.col(f), t)
    specs = [(c, table(s, d, c), fields) for c, fields in by.items()]
    specs.append(("pairs", table(s, d, "events"), {"people": (F.array("user_id", F.col("user_id") + 1), "customer")}))
    records = [table(s, d, t).select(F.lit(t).alias("target"), F.col(k).cast("string").alias("ref"), F.coalesce(F.expr(_MERGED.get(t, "false")), F.lit(False)).alias("merged")) for t, k in _KEYS.items()]
    return joins.reference_faults(joins.reference_relation(specs), reduce(DataFrame.unionByName, records))
