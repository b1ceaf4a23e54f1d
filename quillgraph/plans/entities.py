"""Resolution of people, projects, opportunities, meetings and links, and the duplicate, backfill and merge plans (ER5-ER19, DQ4, DQ7, DQ11, DQ16, DQ17, AR4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import entities, maintenance, people
from quillgraph.plans.registry import query, table
from quillgraph.tables import dealt

FIRST, LAST = ["ann", "bo", "cy", "dee", "eve"], ["lee", "kim", "fox", "roe", "day", "may", "orr"]
# people = customers: every second has a last name, every fortieth an address, every eightieth an alias


def _pick_sql(options, k):
    return "[" + ", ".join(f"'{x}'" for x in options) + f"][1 + {k} % {len(options)}]"


def _pick(options, k):
    return F.get(F.array(*map(F.lit, options)), (k % len(options)).cast("int"))


def _name_sql(k):
    return f"{_pick_sql(FIRST, k)} || CASE WHEN {k} % 2 = 0 THEN ' ' || {_pick_sql(LAST, k)} ELSE '' END"


def _name(k):
    return F.when(k % 2 == 0, F.concat_ws(" ", _pick(FIRST, k), _pick(LAST, k))).otherwise(_pick(FIRST, k))


_PEOPLE = f"(SELECT c_custkey AS id, {_name_sql('c_custkey')} AS name, c_nationkey AS org, CASE WHEN c_custkey % 40 = 0 THEN 'P' || c_custkey || '@x.example' END AS email, c_custkey % 50 AS thread, c_custkey % 80 = 0 AS aliased FROM customer)"
#: Names of one or two tokens hold one another if the first tokens agree and no two last tokens differ.
_MATCH = "split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) AND (split_part(a.name, ' ', 2) IN ('', split_part(b.name, ' ', 2)) OR split_part(b.name, ' ', 2) = '')"


def _people(s, d):
    k = F.col("c_custkey")
    aliases = F.when(k % 80 == 0, F.array(F.lit("Max"), F.lit("Maxi Q"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "customer").select(k.alias("id"), _name(k).alias("name"), F.col("c_nationkey").alias("org"), F.when(k % 40 == 0, F.concat(F.lit("P"), k.cast("string"), F.lit("@x.example"))).alias("email"), (k % 50).alias("thread"), aliases.alias("aliases"))


@query(f"""WITH p AS {_PEOPLE}, m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'max' ELSE {_name_sql("s_suppkey")} END AS name, s_nationkey AS org FROM supplier)
SELECT a.id AS mention, min(b.id)::BIGINT AS record FROM m a JOIN p b ON a.org = b.org AND b.email IS NOT NULL AND ({_MATCH} OR b.aliased AND a.name = 'max') GROUP BY 1 HAVING count(DISTINCT b.id) = 1""")
def people_without_address(s, d):
    """ER5: a name and an organization find the one person with an address, by name or alias."""
    k = F.col("s_suppkey")
    mentions = table(s, d, "supplier").select(k.alias("mention"), F.when(k % 3 == 0, "max").otherwise(_name(k)).alias("name"), F.col("s_nationkey").alias("scope"))
    return entities.people_without_address(mentions, _people(s, d).select(F.col("id").alias("record"), "name", F.col("org").alias("scope"), "email", "aliases"))


@query(f"""WITH p AS {_PEOPLE}, m AS (SELECT o_orderkey AS id, {_name_sql("o_orderkey")} AS name, o_orderkey % 300 AS mail FROM orders)
SELECT a.id AS mention, min(b.id)::BIGINT AS record FROM m a JOIN p b ON a.mail = b.id % 300 AND {_MATCH} GROUP BY 1 HAVING count(DISTINCT b.id) = 1""")
def people_of_one_mail(s, d):
    """ER6: a free name among the people already resolved in its mail, if it is exactly one."""
    k = F.col("o_orderkey")
    mentions = table(s, d, "orders").select(k.alias("mention"), _name(k).alias("name"), (k % 300).alias("scope"))
    return entities.only_match(entities.name_bounds(mentions, _people(s, d).select(F.col("id").alias("record"), "name", (F.col("id") % 300).alias("scope"))))


@query(f"""SELECT id, CASE WHEN email IS NOT NULL THEN lower(email) = 'p40@x.example' ELSE name = 'cy fox' END AS is_operator FROM {_PEOPLE}""")
def operator_mentions(s, d):
    """ER7: the operator's own address, or without an address the own name."""
    return _people(s, d).select("id", entities.is_operator(F.col("email"), F.col("name"), " P40@X.example", "Fox Cy").alias("is_operator"))


_PROJECTS = """(WITH m AS (SELECT p_partkey AS id, p_name AS name, nullif(p_brand, 'Brand#1') AS pillar, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 4 END AS entity FROM part),
f AS (SELECT name, pillar, arg_min(entity, id) FILTER (entity IS NOT NULL) AS main FROM m GROUP BY 1, 2),
r AS (SELECT m.id, m.name, m.pillar, coalesce(m.entity, f.main) AS entity FROM m JOIN f ON m.name = f.name AND m.pillar IS NOT DISTINCT FROM f.pillar)
SELECT id, min(id) OVER (PARTITION BY name, pillar, entity) AS project FROM r)"""


def _projects(s, d):
    k = F.col("p_partkey")
    mentions = table(s, d, "part").select(k.alias("mention"), k.alias("at"), text.normalize_text(F.col("p_name")).alias("name"), F.nullif("p_brand", F.lit("Brand#1")).alias("pillar"), F.when(k % 3 > 0, (k % 4).cast("string")).alias("entity"))
    return entities.projects(mentions)


@query(f"SELECT id AS mention, project::BIGINT AS project FROM {_PROJECTS}")
def project_resolution(s, d):
    """ER8: name, pillar and entity, a missing entity being unknown and not different."""
    return _projects(s, d)


@query(f"""SELECT project::BIGINT AS project, min(id)::BIGINT AS opportunity, count(*)::BIGINT AS n_mails, array_to_string(list_sort(list(DISTINCT id % 6)), ',') AS people, arg_min(nullif(id % 4, 0), id) FILTER (id % 4 <> 0)::BIGINT AS org FROM {_PROJECTS} GROUP BY 1""")
def opportunity_resolution(s, d):
    """ER9: one opportunity for each project, its people in union, the first known organization."""
    k = F.col("mention")
    sales = _projects(s, d).select("project", k.alias("mail"), k.alias("at"), (k % 6).alias("person"), F.nullif(k % 4, F.lit(0)).alias("org"))
    out = entities.opportunities(sales)
    return out.select("project", "opportunity", "n_mails", F.array_join(F.transform("people", lambda x: x.cast("string")), ",").alias("people"), "org")


@query("""SELECT user_id AS thread, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) END AS day, arg_min(event_id, (ts, event_id))::BIGINT AS record, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def meeting_resolution(s, d):
    """ER11: one meeting for each thread and date, and one for no date."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("thread"), F.when(F.col("event_id") % 3 > 0, F.to_date("ts")).alias("day"))
    return entities.grouped_records(e, "thread", "day")


@query("""SELECT sender, item, min(turn * 100000 + conv_id)::BIGINT AS record, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, 'u' || (conv_id % 9) || '@x.example' AS sender, CASE turn % 3 WHEN 0 THEN 'buy 2 tickets' WHEN 1 THEN 'call home' ELSE 'pay rent' END AS item FROM conversations) GROUP BY 1, 2""")
def personal_items(s, d):
    """ER12: one item for each sender and normalized description."""
    k, turn = F.col("conv_id"), F.col("turn")
    said = F.when(turn % 3 == 0, F.when(k % 2 == 0, "Buy two tickets!").otherwise(" buy 2 tickets")).when(turn % 3 == 1, "Call home.").otherwise("pay  RENT")
    rows = table(s, d, "conversations").select((turn * 100000 + k).alias("id"), (turn * 100000 + k).alias("at"), F.lower(F.trim(F.concat(F.lit(" U"), (k % 9).cast("string"), F.lit("@x.example")))).alias("sender"), text.normalize_text(said).alias("item"))
    return entities.grouped_records(rows, "sender", "item")


@query(f"""WITH p AS (SELECT id, name, CASE WHEN id % 2 = 0 THEN 'p' || (id % 600 // 2) || '@x.example' END AS email, id % 300 AS mail FROM {_PEOPLE}), f AS (SELECT o_orderkey AS id, {_name_sql("o_orderkey")} AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'p' || (o_orderkey % 300 // 2) || '@x.example' END AS email, o_orderkey % 300 AS mail FROM orders),
e AS (SELECT a.id AS fact, min(b.id) AS person, count(DISTINCT b.id) AS n FROM f a JOIN p b ON a.mail = b.mail AND a.email = b.email GROUP BY 1),
n AS (SELECT a.id AS fact, min(b.id) AS person FROM f a JOIN p b ON a.mail = b.mail AND {_MATCH} WHERE a.id NOT IN (SELECT fact FROM e) GROUP BY 1 HAVING count(DISTINCT b.id) = 1)
SELECT fact, person::BIGINT AS person FROM e WHERE n = 1 UNION ALL SELECT fact, person::BIGINT FROM n""")
def fact_attribution(s, d):
    """ER15: by the address if one person of the mail has it, else by the only matching name, else not at all."""
    k, i = F.col("o_orderkey"), F.col("id")
    address = lambda c: F.concat(F.lit("p"), F.floor(c / 2).cast("string"), F.lit("@x.example"))
    facts = table(s, d, "orders").select(k.alias("fact"), (k % 300).alias("mail"), _name(k).alias("name"), F.when(k % 4 == 0, F.upper(address(k % 300))).alias("email"))
    people = _people(s, d).select((i % 300).alias("mail"), i.alias("person"), "name", F.when(i % 2 == 0, address(i % 600)).alias("email"))
    return entities.attributed(facts, people)


@query(f"""WITH p AS {_PEOPLE}, k AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN {_name_sql("event_id")} WHEN 1 THEN lower('NATION_' || (event_id % 25)) ELSE 'the thread' END AS name, event_id % 500 AS thread FROM events),
o AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation),
m AS (SELECT a.id AS mention, 0 AS tier, 'person' AS kind, CAST(min(b.id) AS VARCHAR) AS record FROM k a JOIN p b ON a.thread = b.id % 500 AND {_MATCH} GROUP BY 1
UNION ALL SELECT a.id, 1, 'organization', CAST(min(b.id) AS VARCHAR) FROM k a JOIN p c ON a.thread = c.id % 500 JOIN o b ON c.org = b.id AND a.name = b.name GROUP BY 1)
SELECT mention, kind, record FROM m QUALIFY tier = min(tier) OVER (PARTITION BY mention)""")
def knowledge_links(s, d):
    """ER17: the first matching person of the thread, else the first matching organization of its people."""
    k, i = F.col("event_id"), F.col("id")
    subject = F.when(k % 3 == 0, _name(k)).when(k % 3 == 1, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).otherwise("the thread")
    items = table(s, d, "events").select(k.alias("mention"), (k % 500).alias("scope"), subject.alias("name"))
    people = _people(s, d).select(i.alias("record"), (i % 500).alias("scope"), "name", i.alias("place"), "org")
    organizations = people.select("scope", "org").distinct().join(table(s, d, "nation"), F.col("org") == F.col("n_nationkey")).select(F.col("org").cast("long").alias("record"), "scope", F.col("n_name").alias("name"), F.col("org").cast("long").alias("place"))
    return entities.linked_knowledge(items, people.drop("org"), organizations)


@query("""SELECT o_orderkey, min(l_partkey)::BIGINT AS project FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey % 5 = o_custkey % 5 GROUP BY 1 HAVING count(DISTINCT l_partkey) = 1""")
def commitment_projects(s, d):
    """ER18: the only project of the commitment's organization in its mail."""
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 5).alias("org"), F.col("l_partkey").alias("record"))
    pairs = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("org")).join(line, ["o_orderkey", "org"]).select(F.col("o_orderkey").alias("mention"), "record")
    return entities.unique_match(pairs).select(F.col("mention").alias("o_orderkey"), F.col("record").alias("project"))


@query("""WITH m AS (SELECT user_id AS mail, event_id AS meeting, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), n AS (SELECT mail, count(DISTINCT meeting) AS n, min(meeting) AS sole FROM m GROUP BY 1), k AS (SELECT mail, day, count(DISTINCT meeting) AS k, min(meeting) AS same FROM m GROUP BY 1, 2)
SELECT action, meeting::BIGINT AS meeting FROM (SELECT event_id AS action, CASE WHEN n = 1 THEN sole WHEN k = 1 THEN same END AS meeting FROM events e JOIN n ON n.mail = e.user_id LEFT JOIN k ON k.mail = e.user_id AND k.day = CAST(e.ts AS DATE) WHERE event_type = 'click') WHERE meeting IS NOT NULL""")
def calendar_links(s, d):
    """ER19: an action's meeting, if its mail has one, or one of that day."""
    e = table(s, d, "events").select("event_id", "event_type", F.col("user_id").alias("mail"), F.to_date("ts").alias("day"))
    return entities.same_day_meeting(e.where("event_type = 'click'").select(F.col("event_id").alias("action"), "mail", "day"), e.where("event_type = 'purchase'").select("mail", F.col("event_id").alias("meeting"), "day"))


@query(f"""WITH p AS {_PEOPLE}, a AS (SELECT * FROM p WHERE email IS NULL), b AS (SELECT * FROM p WHERE email IS NOT NULL),
m AS (SELECT a.id AS source, b.id AS target, a.thread = b.thread AS meets, CASE WHEN a.thread = b.thread THEN 'HIGH' WHEN a.org = b.org THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a JOIN b ON {_MATCH}),
n AS (SELECT source, count(*) AS n, count(*) FILTER (meets) AS m FROM m GROUP BY 1)
SELECT source, target, 'orphan' AS axis, confidence FROM m JOIN n USING (source) WHERE n = 1 OR n.m = 1 AND meets
UNION ALL SELECT y.id, x.id, 'anchor', CASE WHEN x.thread = y.thread THEN 'HIGH' ELSE 'MEDIUM' END FROM b x JOIN b y ON x.name = y.name AND x.org = y.org AND x.id < y.id""")
def duplicate_people(s, d):
    """DQ7: people without an address against those with one, and those with one against each other."""
    return entities.duplicate_people(_people(s, d).withColumn("threads", F.array("thread")))


@query("""WITH d AS (SELECT l_orderkey AS thread, l_linenumber AS seq, l_partkey % 7 AS v, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 5 END AS gone FROM lineitem),
a AS (SELECT thread, seq, v FROM d), r AS (SELECT thread, gone AS v, max(seq) AS gone FROM d WHERE gone IS NOT NULL GROUP BY 1, 2),
k AS (SELECT a.thread, a.v, min(a.seq * 10 + a.v) AS place FROM a LEFT JOIN r ON r.thread = a.thread AND r.v = a.v WHERE r.gone IS NULL OR a.seq >= r.gone GROUP BY 1, 2)
SELECT t.thread, coalesce(string_agg(CAST(k.v AS VARCHAR), ',' ORDER BY k.place), '') AS state FROM (SELECT DISTINCT thread FROM d) t LEFT JOIN k ON k.thread = t.thread GROUP BY 1""")
def context_fold(s, d):
    """AR4, SS6: the list after all additions and removals of a thread. Lines of one number are one delta, in order of value."""
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 7).cast("string").alias("v"), F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_partkey") % 5).cast("string")).alias("g"))
    deltas = dealt(line, line.count(), "thread").groupBy("thread", "seq").agg(F.array_sort(F.collect_list("v")).alias("add"), F.collect_list("g").alias("remove")).withColumn("field", F.lit("requirements"))
    return entities.folded_context(deltas).select("thread", F.array_join("state", ",").alias("state"))


@query("""SELECT count(*) FILTER (n = 0 AND status = 'O')::BIGINT AS unsafe, count(*) FILTER (n > 0)::BIGINT AS with_attendees, count(*)::BIGINT AS total FROM (SELECT o_orderkey, o_orderstatus AS status, o_custkey % 3 AS n FROM orders)""")
def calendar_safety(s, d):
    """DQ4: actions that would write to a calendar without an attendee."""
    who = F.slice(F.array(F.lit("a@x.example"), F.lit("b@x.example")), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    return maintenance.calendar_safety(table(s, d, "orders").select("o_orderstatus", who.alias("attendees")), "attendees", F.col("o_orderstatus") == "O")


@query(f"""WITH p AS (SELECT id, CASE id % 6 WHEN 0 THEN 'a@site' || (id % 13) || '.example' WHEN 1 THEN 'a@x.example; b@y.example' WHEN 2 THEN 'agent@own.example' END AS email FROM {_PEOPLE}), o AS (SELECT n_nationkey AS id, 'site' || n_nationkey || '.example' AS domain FROM nation WHERE n_nationkey % 2 = 0)
SELECT p.id, CASE WHEN email IS NULL THEN 'no_address' WHEN contains(email, ';') THEN 'malformed' WHEN o.id IS NOT NULL THEN 'link' ELSE 'create' END AS action, CASE WHEN NOT contains(email, ';') THEN split_part(email, '@', 2) END AS domain, o.id::BIGINT AS org_id FROM p LEFT JOIN o ON NOT contains(p.email, ';') AND split_part(p.email, '@', 2) = o.domain""")
def organization_backfill(s, d):
    """ER3, DQ16: the dry run of a backfill: link to a known domain's organization, create one, or leave a malformed address."""
    i = F.col("id")
    address = F.when(i % 6 == 0, F.concat(F.lit("a@Site"), (i % 13).cast("string"), F.lit(".example"))).when(i % 6 == 1, "a@x.example; b@y.example").when(i % 6 == 2, "agent@own.example")
    known = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("org_id"), F.concat(F.lit("site"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("domain"))
    return maintenance.organization_backfill(_people(s, d).select("id", address.alias("email")), known, "id", "email")


@query(f"""WITH p AS (SELECT * FROM {_PEOPLE} WHERE email IS NOT NULL), m AS (SELECT o_orderkey AS id, {_name_sql("o_orderkey")} AS name, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS has FROM orders),
n AS (SELECT a.id, count(DISTINCT b.id) AS n, min(b.id) AS target FROM m a JOIN p b ON {_MATCH} WHERE a.has IS NULL GROUP BY 1)
SELECT CASE WHEN has IS NOT NULL THEN 'already_set' WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN n = 1 THEN target END)::BIGINT AS targets FROM m LEFT JOIN n USING (id) GROUP BY 1""")
def reference_proposals(s, d):
    """DQ17, AG21: proposals of canonical references for records that name a person, by status."""
    k, everywhere = F.col("o_orderkey"), F.lit("").alias("scope")
    rows = table(s, d, "orders").select(k.alias("mention"), _name(k).alias("name"), F.when(k % 10 == 0, F.col("o_custkey")).alias("has"))
    bounds = entities.name_bounds(rows.where("has is null").select("mention", everywhere, "name"), _people(s, d).where("email is not null").select(F.col("id").alias("record"), everywhere, "name"))
    found = bounds.groupBy("mention").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    one = F.col("lo") == F.col("hi")
    status = F.when(F.col("has").isNotNull(), "already_set").when(F.col("lo").isNull(), "no_match").when(one, "resolved").otherwise("ambiguous")
    return rows.join(found, "mention", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(one, F.col("lo"))).alias("targets"))


@query("""WITH m AS (SELECT s_suppkey AS old, s_suppkey - s_suppkey % 4 AS new FROM supplier WHERE s_suppkey % 4 > 0), v AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 > 1 THEN 'site' || s_suppkey END AS website FROM supplier),
g AS (SELECT coalesce(new, id) AS id, id AS part, name, website FROM v LEFT JOIN m ON id = old)
SELECT id, arg_min(name, part) AS name, arg_min(website, part) FILTER (website IS NOT NULL) AS website, array_to_string(list_sort(list(name) FILTER (part <> id)), ',') AS aliases, (SELECT count(*) FROM lineitem WHERE coalesce((SELECT new FROM m WHERE old = l_suppkey), l_suppkey) = g.id)::BIGINT AS n_lines FROM g GROUP BY id""")
def organization_merge(s, d):
    """DQ11: canonical records take the blanks and names of those merged into them, and every reference follows."""
    k = F.col("s_suppkey")
    mapping = table(s, d, "supplier").where("s_suppkey % 4 > 0").select(k.alias("old"), (k - k % 4).alias("new"))
    rows = table(s, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 4 > 1, F.concat(F.lit("site"), k.cast("string"))).alias("website"))
    merged = maintenance.absorbed(rows, mapping, "id", "name", ["website"])
    lines = maintenance.repointed(table(s, d, "lineitem").select("l_suppkey"), mapping, "l_suppkey").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return merged.join(lines, "id", "left").select("id", "name", "website", F.array_join("aliases", ",").alias("aliases"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


@query()
def person_fold(s, d):
    """ER4, ER5, AG16, AG17: all mentions in order: by address with backfills, by organization and name with aliases that grow, by thread."""
    k = F.col("c_custkey")
    first, last = (F.array(*map(F.lit, x.split())) for x in ("Ann Bo Cy Dee Eve Flo Gus Hal", "Lee Kim Roe Poe Orr Fox Day Moss Hill Lake Wood"))
    one, two = F.element_at(first, (k % 8 + 1).cast("int")), F.element_at(last, (k % 11 + 1).cast("int"))
    name = F.when(k % 5 == 0, one).when(k % 5 == 1, two).when(k % 5 < 4, F.concat_ws(" ", one, two))
    mentions = table(s, d, "customer").select(
        F.lpad(k.cast("string"), 12, "0").alias("mention"), F.timestamp_seconds(F.lit(1704067200) + k).alias("at"), F.concat(F.lit("t"), (k % 97).cast("string")).alias("thread"), F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 88).cast("string"), F.lit("@x.example"))).alias("email"),
        name.alias("name"), F.when(k % 4 > 0, F.concat(F.lit("Org "), F.col("c_nationkey").cast("string"))).alias("org"), F.when(k % 6 == 0, F.lit("CTO")).alias("role"), F.when(k % 7 < 5, k % 2 == 0).alias("sender"),
    )
    return people.outcomes(people.folded(mentions))
