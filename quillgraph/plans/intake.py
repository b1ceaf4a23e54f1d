"""Write path, person snapshots, folder ledgers, extended JSON, notes and plan files (Q22, ER21, SRC6, SRC8, SRC11, SNK5, SS2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import intake
from quillgraph.plans.registry import query, table
from quillgraph.sources import export, markdown
from quillgraph.tables import shared_path, written

_STEPS = ["ingest", "analysis", "context", "reply", "complete"]


@query("""WITH s AS (SELECT o_orderkey AS mail, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS thread, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'VALIDATED' END AS stage, o_orderkey % 4 AS n, o_orderkey % 6 = 0 AS c, o_orderkey % 9 = 0 AS d FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT o_orderkey AS mail, ['ingest', 'analysis', 'context', 'reply', 'complete'][1 + o_custkey % 5] AS step FROM orders),
o AS (SELECT r.mail, step, s.stage AS was, CASE WHEN step IN ('analysis', 'complete') AND s.mail IS NULL THEN 'no_mail' WHEN s.mail IS NULL THEN 'done' WHEN step IN ('ingest', 'complete') AND s.stage = 'COMPLETED' OR step = 'context' AND c OR step = 'reply' AND d THEN 'already'
WHEN step = 'analysis' AND thread IS NULL THEN 'no_thread' WHEN step = 'complete' AND n = 0 THEN 'no_entities' ELSE 'done' END AS outcome FROM r LEFT JOIN s ON s.mail = r.mail)
SELECT mail, step, outcome, CASE WHEN outcome <> 'done' THEN was ELSE CASE step WHEN 'ingest' THEN 'THREADED' WHEN 'analysis' THEN 'MEETING_PROCESSED' WHEN 'context' THEN 'CONTEXT_BUILT' WHEN 'reply' THEN 'REPLY_PROCESSED' ELSE 'COMPLETED' END END AS stage FROM o""")
def write_path(s, d):
    """Q22: what each step of the write path does to a mail: done, nothing twice, or why it is refused."""
    k, o = F.col("o_orderkey"), table(s, d, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("VALIDATED")
    stored = o.where(k % 7 != 0).select(k.alias("mail"), F.when(k % 5 != 0, F.col("o_custkey")).alias("thread"), stage.alias("stage"), (k % 4).alias("n_entities"), (k % 6 == 0).alias("in_context"), (k % 9 == 0).alias("has_draft"))
    step = F.get(F.array(*map(F.lit, _STEPS)), (F.col("o_custkey") % 5).cast("int"))
    return intake.step_outcomes(o.select(k.alias("mail"), step.alias("step")), stored)


@query("""WITH m AS (SELECT o_custkey AS person, o_orderkey AS mail, o_orderkey % 2 = 0 AS sent, o_orderpriority AS subject, c_nationkey AS org FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT l_orderkey AS mail, l_partkey AS part, l_linenumber AS line, l_linestatus AS value, l_returnflag AS flag, o_custkey AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT person, mail, 0 AS rank, NULL::VARCHAR AS record, 'email_interaction' AS category, CASE WHEN sent THEN 'Sent' ELSE 'Received/referenced in' END || ' email: ' || subject AS summary, 'observed' AS prov FROM m
UNION SELECT person, mail, 1, CAST(org AS VARCHAR), 'organization', n_name, 'observed' FROM m JOIN nation ON n_nationkey = org UNION SELECT person, mail, 2, CAST(part AS VARCHAR), 'project', 'part ' || part, 'observed' FROM l WHERE part % 3 = person % 3
UNION SELECT o_custkey, o_orderkey, 3, CAST(o_orderkey AS VARCHAR), 'commitment', 'status ' || o_orderstatus, 'observed' FROM orders WHERE o_orderstatus <> 'F' UNION SELECT l.person, l.mail, 4, CAST(part AS VARCHAR), 'personal_item', value, 'observed' FROM l JOIN m ON m.mail = l.mail WHERE sent AND flag = 'R'
UNION SELECT person, mail, 5, CAST(line AS VARCHAR), CASE WHEN p IN ('price', 'seats') THEN 'knowledge' ELSE p END, CASE WHEN p IN ('price', 'seats') THEN p || ': ' ELSE '' END || value, CASE WHEN flag = 'N' THEN 'observed' ELSE 'inferred' END FROM (SELECT *, ['role', 'price', 'goal', 'seats'][1 + line % 4] AS p FROM l))
SELECT person, mail, count(*)::BIGINT AS n, string_agg(category || '|' || coalesce(record, '') || '|' || summary || '|' || prov, ';' ORDER BY rank, record, category, summary, prov) AS entries FROM e GROUP BY person, mail""")
def person_snapshots(s, d):
    """ER21: one snapshot of each person and mail, whose records count only for the persons they name."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("mail"), "o_orderstatus", "o_orderpriority")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("mail"), "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag").join(o.select("person", "mail"), "mail")
    mails = o.join(table(s, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("org")), "person").select("person", "mail", (F.col("mail") % 2 == 0).alias("is_sender"), F.col("o_orderpriority").alias("subject"), "org")
    part, line = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    projects = lines.where("l_partkey % 3 = person % 3").select("person", "mail", part.alias("record"), F.concat(F.lit("part "), part).alias("summary"))
    owed = o.where("o_orderstatus <> 'F'").select("person", "mail", F.col("mail").cast("string").alias("record"), F.concat(F.lit("status "), "o_orderstatus").alias("summary"))
    personal = lines.where("l_returnflag = 'R'").select("person", "mail", part.alias("record"), F.col("l_linestatus").alias("summary"))
    predicate = F.get(F.array(*map(F.lit, ["role", "price", "goal", "seats"])), (line % 4).cast("int"))
    facts = lines.select("person", "mail", line.cast("string").alias("record"), predicate.alias("predicate"), F.col("l_linestatus").alias("value"), (F.col("l_returnflag") == "N").alias("stated"))
    orgs = table(s, d, "nation").select(F.col("n_nationkey").alias("org"), F.col("n_name").alias("name"))
    out = intake.snapshot_entries(mails, orgs, [("project", projects), ("commitment", owed)], personal, facts)
    told = F.transform("entries", lambda e: F.concat_ws("|", e.category, F.coalesce(e.record, F.lit("")), e.summary, e.provenance))
    return out.select("person", "mail", F.size("entries").cast("long").alias("n"), F.array_join(told, ";").alias("entries"))


@query("""SELECT run, CAST(r_regionkey AS BIGINT) AS folder FROM region CROSS JOIN (VALUES (1), (2), (3)) v(run) WHERE run = 1 OR r_regionkey = 2 OR run = 3 AND r_regionkey = 1""")
def folder_ledger(s, d):
    """SRC6, SS2: files of a folder are taken once; one that failed in part, or has changed since, is taken again, one without a good message is not."""
    rows = table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("part"))
    at = shared_path(s, "inbox")
    put = lambda df, mode: df.repartition(1, "part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").json(at)
    put(rows, "error")
    ledger, taken = s.createDataFrame([], "path string, fingerprint string, all_completed boolean"), []
    for run in (1, 2, 3):
        if run == 3:
            put(rows.where("part = 1").withColumn("n_name", F.lower("n_name")), "overwrite")
        files = written(export.new_files(s, at, ledger).select("path", "fingerprint"), "files")
        folder = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
        taken.append(files.select(F.lit(run).alias("run"), folder.alias("folder")))
        # of folder 2 a message fails, of folder 4 no message can be read
        failed = files.where(folder != 4).select("path", F.when(folder == 2, 1).otherwise(0).alias("n_failed"))
        ledger = written(export.recorded(ledger, files, failed), "ledger")
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


@query("""SELECT o_orderkey, '{"mail":"' || o_orderkey || '","at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","by":{"person":"' || o_custkey || '","said":"{\\"$oid\\":1}"},"all":["a",{"n":1}]}' AS plain FROM orders""")
def extended_json(s, d):
    """SRC8: wrapped ids and dates as scalars at every depth, `_id` dropped, texts that look like wrappers left alone."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.format_string('{"_id": {"$oid": "x%d"},"mail":{"$oid":"%d"},"at":{"$date":"%s"},"by":{"person":{"$oid":"%d"},"_id":7,"said":"{\\"$oid\\":1}"},"all":[{"$oid":"a"},{"_id":"q\\"}","n":1}]}', k, k, F.date_format("o_orderdate", "yyyy-MM-dd"), c)
    return table(s, d, "orders").select("o_orderkey", export.plain_document(raw).alias("plain"))


@query("""SELECT 'C' || c_custkey AS id, c_name AS label, 'IN_NATION' AS kind, 'N' || c_nationkey AS target FROM customer UNION ALL SELECT DISTINCT 'C' || o_custkey, c_name, 'ORDERED', 'O' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey""")
def note_links(s, d):
    """SRC11, SNK4: notes are written from an edge table, and their sections and links read back."""
    people = table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat(F.lit("N"), "c_nationkey").alias("b"))
    ordered = table(s, d, "orders").select(F.lit("ORDERED").alias("label"), F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("O"), "o_orderkey").alias("b"))
    edges = people.select(F.lit("IN_NATION").alias("label"), F.col("id").alias("a"), "b").unionByName(ordered)
    notes = markdown.rendered(edges, people.select("id", "label"))
    return markdown.links(notes).select("id", "label", "kind", "target")


@query("""SELECT count(*)::BIGINT AS rows_, count(*) FILTER (s_suppkey % 10 <> 3)::BIGINT AS intact, count(*) FILTER (s_suppkey % 10 = 3)::BIGINT AS damaged FROM supplier""")
def plan_file(s, d):
    """SNK5: rows of a plan written with a checksum each, of which every tenth is changed, read back and checked."""
    plan = table(s, d, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name")).alias("step"))
    changed = F.when(F.get_json_object("step", "$.s_suppkey").cast("long") % 10 == 3, F.concat("step", F.lit(" "))).otherwise(F.col("step"))
    back = written(plan.withColumn("checksum", F.sha2("step", 256)).withColumn("step", changed), "plan")
    return back.agg(F.count(F.lit(1)).alias("rows_"), F.count_if(F.sha2("step", 256) == F.col("checksum")).alias("intact"), F.count_if(F.sha2("step", 256) != F.col("checksum")).alias("damaged"))
