"""Questions over the test tables (Q11, Q15-Q17), run ledgers and uniqueness (DQ15, DQ18, DQ19), person 360 (Q13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import joins, provider, service
from quillgraph.plans.registry import ORDERS_NOW, query, table


def _sources(s, d):
    o = table(s, d, "orders")
    return {
        "commitments": service.Source(o, "commitment", "o_orderkey", "o_orderdate", "o_custkey", ("o_orderpriority", "o_orderstatus")),
        "follow_ups": service.Source(o.where("o_orderstatus = 'O'"), "follow_up", "o_orderkey", "o_orderdate", "o_custkey", ("o_orderpriority",)),
        "meetings": service.Source(table(s, d, "events").where("event_type = 'purchase'"), "meeting", "event_id", "ts", "user_id", ("event_type",)),
    }


def _ask(s, d, question):
    return service.ask(question, ORDERS_NOW, _sources(s, d), table(s, d, "customer"), "c_custkey", "c_name").rows.select("record_type", "record_id", "at")


@query("""SELECT 'commitment' AS record_type, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS at FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-17 10:00:00' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50""")
def ask_question_overdue(s, d):
    """Q15, Q17: a list question."""
    return _ask(s, d, "what do I owe that is overdue?")


@query("""SELECT 'commitment' AS record_type, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS at FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey LIMIT 50""")
def ask_question_person(s, d):
    """Q9, Q11, Q17: a question about one person by name."""
    people = table(s, d, "customer").select("c_custkey", F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"))
    return service.ask("commitments for Customer 7", ORDERS_NOW, _sources(s, d), people, "c_custkey", "name").rows.select("record_type", "record_id", "at")


@query("""SELECT 'follow_up' AS record_type, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS at FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-06-22' AND o_orderdate < TIMESTAMP '1998-06-29' ORDER BY o_orderdate ASC NULLS FIRST, o_orderkey LIMIT 50""")
def ask_question_follow_ups(s, d):
    """Q10, Q15."""
    return _ask(s, d, "which follow-ups come next week")


@query("""SELECT c_custkey FROM customer WHERE c_custkey > 999""")
def resume_run(s, d):
    """DQ15: what a run that stopped after key 999 still has to do."""
    c = table(s, d, "customer").select("c_custkey")
    return service.remaining(c, c.where("c_custkey <= 999").withColumn("status", F.lit("done")), "c_custkey")


@query("""SELECT 'customer' AS "table", 'c_custkey' AS keys, (count(*) - count(DISTINCT c_custkey))::BIGINT AS duplicates FROM customer UNION ALL SELECT 'part', 'p_name', (count(*) - count(DISTINCT p_name))::BIGINT FROM part
UNION ALL SELECT 'conversations', 'conv_id,turn', (count(*) - count(DISTINCT (conv_id, turn)))::BIGINT FROM conversations""")
def unique_safety(s, d):
    """DQ18, DQ19: which keys of the manifest are unique today."""
    return service.unique_faults(("customer", table(s, d, "customer"), ["c_custkey"]), ("part", table(s, d, "part"), ["p_name"]), ("conversations", table(s, d, "conversations"), ["conv_id", "turn"]))


@query("""WITH o AS (SELECT o_custkey AS person, 'commitments' AS category, 'canonical_id' AS basis, count(*) AS n, 0 AS tier FROM orders GROUP BY 1), e AS (SELECT user_id, 'meetings', 'canonical_id', count(*), 0 FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, 'meetings', 'legacy_name_match', count(*), 1 FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT person, category, basis, n::BIGINT AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM e) QUALIFY tier = min(tier) OVER (PARTITION BY person, category)""")
def person_360(s, d):
    """Q13: each category from its best tier, in one relation."""
    counted = lambda df, k, c: df.groupBy(F.col(k).alias("person")).agg(F.count(F.lit(1)).alias("n")).withColumn("category", F.lit(c))
    e = table(s, d, "events")
    first = counted(table(s, d, "orders"), "o_custkey", "commitments").unionByName(counted(e.where("event_type = 'purchase'"), "user_id", "meetings"))
    second = counted(e.where("event_type = 'click'"), "user_id", "meetings")
    return joins.tiered([("canonical_id", first), ("legacy_name_match", second)], "person", "category").select("person", "category", "basis", "n")


@query("""SELECT 'context on Customer' AS question, 'organization_context' AS intent, 'unsupported' AS status, 'That question is not supported.' AS answer UNION ALL SELECT 'who is Zed Nobody', 'person_context', 'no_match', 'No match for that name.' UNION ALL SELECT 'meetings tomorrow', 'meetings', 'ok', '1 records found.' UNION ALL SELECT '???', 'unsupported', 'unsupported', 'That question is not supported.'
UNION ALL SELECT 'who is Customer', 'person_context', CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'ok' END, CASE WHEN count(*) > 1 THEN 'More than one match; please say which.' ELSE '1 records found.' END FROM customer""")
def question_status(s, d):
    """Q15: how questions end that cannot be answered with rows."""
    asked = ["context on Customer", "who is Zed Nobody", "meetings tomorrow", "???", "who is Customer"]
    people = table(s, d, "customer").select("c_custkey", F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"))
    sources = _sources(s, d) | {"person_context": service.Source(table(s, d, "orders"), "commitment", "o_orderkey", "o_orderdate", "o_custkey")}
    rows = [(q, a.parsed.intent, a.status, service.wording(a.status, 1, "records")) for q in asked for a in [service.ask(q, ORDERS_NOW, sources, people, "c_custkey", "name")]]
    return s.createDataFrame(rows, "question string, intent string, status string, answer string")


def _word_counter():
    """A provider of the tests: counts words, and answers no batch with a question in it, as a service that fails would."""

    def call(texts):
        if any("?" in t for t in texts):
            raise RuntimeError("questions are not answered")
        return [{"n_words": len(t.split()), "label": "long" if len(t.split()) > 40 else "short"} for t in texts]

    return call


@query("""SELECT conv_id, turn, CASE WHEN NOT contains(text, '?') THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) END::BIGINT AS n_words,
CASE WHEN contains(text, '?') THEN NULL WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 40 THEN 'long' ELSE 'short' END AS label, CASE WHEN contains(text, '?') THEN 'RuntimeError: questions are not answered' END AS error FROM conversations""")
def provider_analysis(s, d):
    """UD1, UD4, UD5: a provider called in batches on the executors; texts that it fails on keep their rows, with the error, after one retry."""
    rows = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return provider.provided(rows, "text", _word_counter, "n_words long, label string").drop("text")
