"""Text, classifier and date functions over the test tables (FN, TX, DT, AR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import arrays, classify, dates, text
from quillgraph.plans.registry import query, table

# SQL building blocks.



def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _normalize(x: str) -> str:
    out = f"lower(trim({x}))"
    for word, digits in text.NUMBERS:
        out = f"regexp_replace({out}, '\\b{word}\\b', '{digits}', 'g')"
    return _collapse(f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")


def _cases(x: str, rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    whens = " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(x, p.replace("'", "''"), v) for p, v in rules)
    return f"CASE {whens} ELSE {otherwise} END"


_PHRASES = ["Re: budget of one hundred seats", "we have twenty users", "the closing date moves", "pricing tier or plan tier", "term length is two years", "forty-two things", "FW: re:  Plan  B"]


def _said(options: list[str], name: str) -> str:
    """Conversations' whole texts, each after one of the options: as a DuckDB relation of conv_id, turn and the text."""
    whens = " ".join("WHEN {} THEN '{}'".format(k, x.replace("'", "''")) for k, x in enumerate(options))
    return f"(SELECT conv_id, turn, CASE (conv_id * 31 + turn) % {len(options)} {whens} END || ' ' || coalesce(text, '') AS {name} FROM conversations)"


def _say(s, d, options: list[str], name: str):
    pick = F.get(F.array(*map(F.lit, options)), ((F.col("conv_id") * 31 + F.col("turn")) % len(options)).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", pick, F.coalesce("text", F.lit(""))).alias(name))


@query(f"SELECT conv_id, turn, {_collapse(r'''regexp_replace(trim(p), '(?i)^(\s*(re|fwd|fw)\s*:\s*)+', '')''')} AS subject FROM {_said(_PHRASES, 'p')}")
def normalize_subjects(s, d):
    """FN1, FN2."""
    return _say(s, d, _PHRASES, "p").select("conv_id", "turn", text.normalize_subject(F.col("p")).alias("subject"))



@query(f"SELECT doc_id, sha256({_normalize('text')}) AS digest FROM documents")
def normalize_text_docs(s, d):
    """FN3 over whole texts."""
    return table(s, d, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))


@query(f"SELECT conv_id, turn, regexp_replace({_normalize('p')}, '\\s+', '_', 'g') AS slug, {_cases(_normalize('p'), text.FACT_KEYS, 'regexp_replace(' + _normalize('p') + ', ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS fact_key, try_cast(nullif(regexp_extract({_normalize('p')}, '(\\d+)', 1), '') AS BIGINT) AS number FROM {_said(_PHRASES, 'p')}")
def fact_keys(s, d):
    """FN4, FN6, FN7."""
    p = F.col("n")
    rows = _say(s, d, _PHRASES, "p").select("conv_id", "turn", text.normalize_text(F.col("p")).alias("n"))
    return rows.select("conv_id", "turn", text.slug_of_text(p).alias("slug"), text.fact_key(p).alias("fact_key"), text.leading_number(p).alias("number"))



@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' & ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM part""")
def slugify_names(s, d):
    """FN5."""
    return table(s, d, "part").select("p_partkey", text.slug_of_name(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


@query()
def project_names(s, d):
    """FN8 over whole texts: accents need Unicode tables that SQL lacks."""
    rows = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("name"))
    return rows.select("conv_id", "turn", text.normalize_text(text.project_name("name")).alias("project"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> ''))), ',') AS tokens, array_to_string(list_sort(list_filter(string_split(lower(p_name) || ' group', ' '), lambda x: x NOT IN ('inc','llc','ltd','corp','corporation','group','technologies','analytics','solutions','co'))), ',') AS org FROM part""")
def name_tokens(s, d):
    """FN9, FN10."""
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return table(s, d, "part").select("p_partkey", join(text.tokens(F.col("p_name"))).alias("tokens"), join(text.org_tokens(F.concat("p_name", F.lit(" Group")))).alias("org"))


@query("""SELECT page_id, nullif(regexp_replace(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '^www\\.', ''), '') AS domain FROM pages""")
def website_domains(s, d):
    """FN11."""
    return table(s, d, "pages").select("page_id", text.website_domain(F.col("url")).alias("domain"))


@query(r"""SELECT doc_id, array_to_string(e, ',') AS emails, array_to_string(list_sort(list_distinct(list_transform(e, lambda x: split_part(x, '@', 2)))), ',') AS domains FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS e FROM documents) WHERE len(e) > 0""")
def extract_emails(s, d):
    """FN13, FN14."""
    rows = table(s, d, "documents").select("doc_id", text.emails_in(F.col("text")).alias("e"), text.domains_in(F.col("text")).alias("dm")).where(F.size("e") > 0)
    return rows.select("doc_id", F.array_join("e", ",").alias("emails"), F.array_join("dm", ",").alias("domains"))


@query("""SELECT c_custkey, CASE WHEN contains(a, ';') OR contains(a, ',') OR length(a) - length(replace(a, '@', '')) <> 1 THEN NULL ELSE nullif(lower(trim(split_part(a, '@', 2))), '') END AS domain FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a@X.example' WHEN 1 THEN 'a@x.example; b@y.example' WHEN 2 THEN 'a@@x' ELSE 'nobody' END AS a FROM customer)""")
def email_domains(s, d):
    """FN12."""
    k = F.col("c_custkey") % 4
    a = F.when(k == 0, "a@X.example").when(k == 1, "a@x.example; b@y.example").when(k == 2, "a@@x").otherwise("nobody")
    return table(s, d, "customer").select("c_custkey", a.alias("a")).select("c_custkey", text.email_domain(F.col("a")).alias("domain"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '') AS v FROM conversations),
a AS (SELECT conv_id, turn, list_transform(list_concat(v[1:4], list_transform(v[2:5], lambda x: upper(x))), lambda x: x || '@x.example') AS v FROM w)
SELECT conv_id, turn, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), ',') AS envelope, coalesce(v[1], '') || '_2024-01-01T0' || turn % 9 || ':00:00_2024-01-01T0' || turn % 9 || ':30:00' AS fingerprint FROM a""")
def envelope_distinct(s, d):
    """FN15, FN16: addresses made of a text's words, each once whatever its letters' case, as first written; the fingerprint of a meeting."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    rows = table(s, d, "conversations").select("conv_id", "turn", words.alias("v"))
    rows = rows.select("conv_id", "turn", F.transform(F.concat(F.slice("v", 1, 4), F.transform(F.slice("v", 2, 4), F.upper)), lambda x: F.concat(x, F.lit("@x.example"))).alias("v"))
    at = lambda minute: F.to_timestamp_ntz(F.format_string(f"2024-01-01 %02d:{minute}:00", (F.col("turn") % 9).cast("int")))
    mark = text.meeting_fingerprint(F.coalesce(F.get("v", F.lit(0)), F.lit("")), at("00"), at("30"))
    return rows.select("conv_id", "turn", F.array_join(text.envelope(F.col("v")), ",").alias("envelope"), mark.alias("fingerprint"))


@query()
def fuzzy_names(s, d):
    """FN17 over the names that share a token: the Indel ratio of sorted tokens."""
    names = table(s, d, "part").select(F.col("p_name").alias("a")).distinct()
    rows = names.select("a", F.explode(F.split("a", " ")).alias("t"))
    pairs = rows.join(rows.withColumnRenamed("a", "b"), "t").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(text.fuzzy_ratio("a", "b"), 2).alias("ratio"))


@query("""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 IN (0, 1, 2) THEN '{"k":' || conv_id || ',"s":' || CAST(to_json('a } ' || text) AS VARCHAR) || '}' END AS block FROM conversations""")
def json_blocks(s, d):
    """FN18: whole texts in an object that is fenced, bare or followed by other text; a list or prose first is no object."""
    one = F.to_json(F.struct(F.col("conv_id").alias("k"), F.concat(F.lit("a } "), "text").alias("s")))
    case = (F.col("conv_id") + F.col("turn")) % 5
    body = F.when(case == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```\n"))).when(case == 1, F.concat(one, F.lit("\nand {\"k\": 0}"))).when(case == 2, one).when(case == 3, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("Sure: "), one))
    return table(s, d, "conversations").select("conv_id", "turn", text.json_block(body).alias("block"))


@query("""SELECT event_id, printf('- [%s] %s: %s', event_type, CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d')) AS line, CASE WHEN value > 50 THEN 'ok' WHEN value > 10 THEN 'empty' ELSE 'error' END AS answer FROM events""")
def evidence_lines(s, d):
    """FN20, FN21."""
    line = F.format_string("- [%s] %s: %s", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return table(s, d, "events").select("event_id", line.alias("line"), F.when(F.col("value") > 50, "ok").when(F.col("value") > 10, "empty").otherwise("error").alias("answer"))


_QUESTIONS = [
    "Prepare me for my meeting with Ann Lee", "any recent emails from Bo", "what changed with the deal this month", "what do I owe Cy today?", "who is waiting on me",
    "follow-ups that need a nudge next week", "context on the company Acme", "context on Dee", "show the project Atlas", "latest thread", "reply drafts", "what do we know",
    "meetings tomorrow", "customer list", "contact details", "nonsense", "overdue commitments about Eve",
]

_INTENT_SQL = _cases("q", classify.INTENTS, "'unsupported'")


@query(f"SELECT conv_id, turn, {_INTENT_SQL} AS intent, {_cases('q', classify.DATE_KINDS)} AS date_kind, CASE WHEN {_INTENT_SQL} = 'commitments' THEN {_cases('q', classify.OWNERSHIP)} END AS ownership FROM {_said(_QUESTIONS, 'q')}")
def intent_classify(s, d):
    """TX1-TX3, Q15, Q17: the parse of a question."""
    q = F.col("q")
    return _say(s, d, _QUESTIONS, "q").select("conv_id", "turn", classify.intent(q).alias("intent"), classify.date_kind(q).alias("date_kind"), classify.ownership(q).alias("ownership"))



@query()
def mentions(s, d):
    """TX4: the pattern looks ahead, which the SQL engine's cannot."""
    return _say(s, d, _QUESTIONS, "q").select("conv_id", "turn", classify.mention(F.col("q")).alias("mention"))


_BODIES = [
    "We use Salesforce; pricing is slow and manual. Can you send a demo?", "I will meet you tomorrow at 3pm for 45 minutes", "As discussed, during our call we saw HubSpot", "We need 50 seats and 20 users, security review first",
    "I'll follow up on Friday at 10:30", "Maybe we chat sometime soon", "Our sync is on Monday", "procurement asks for a proposal in 2 weeks", "call on tuesday at 14:00 for 2 hours", "see you June 5th", "nothing here",
]
_B_SQL = "CASE ((conv_id + turn) % 11) " + " ".join("WHEN {} THEN '{}'".format(k, b.replace("'", "''")) for k, b in enumerate(_BODIES)) + " END"


def _bodies(s, d):
    """Whole texts, every fourth as it is and the others with a body after them, each with a time of its own."""
    k = F.col("conv_id") + F.col("turn")
    pick = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.get(F.array(*map(F.lit, _BODIES)), (k % 11).cast("int"))))
    now = F.make_timestamp_ntz(F.lit(1996), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval((k % 1000).cast("int"), (F.col("turn") % 24).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.concat("text", pick).alias("b"), now.alias("now"))


_SIGNALS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(b, '(?i){p}') THEN '{v}' END" for p, v in classify.SIGNALS) + "], lambda x: x IS NOT NULL)"
_WORDS_SQL = lambda words: "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda x: contains(lower(b), lower(x)))"
_PAST_SQL = classify.PAST_MEETING.replace("'", "''")


@query(f"""SELECT conv_id, turn, array_to_string({_WORDS_SQL(classify.COMPETITORS)}, ',') AS competitors, array_to_string({_WORDS_SQL(classify.PAINS)}, ',') AS pains, array_to_string({_SIGNALS_SQL}, ',') AS signals,
array_to_string(list_transform(regexp_extract_all(b, '(?i)\\b(\\d+)\\s*(seats?|users?|licen[sc]es?)\\b', 1), lambda x: x || ' seats'), ',') AS requirements,
CASE WHEN contains(lower(b), 'meet') OR contains(lower(b), 'call') THEN 'meeting_request' WHEN len({_SIGNALS_SQL}) > 0 THEN 'buying_signal' ELSE 'evaluation' END AS intent,
(length(regexp_replace(b, '(?i)\\b(?:i will|i''ll|we will)\\b', '@@', 'g')) <> length(b) AND NOT regexp_matches(b, '(?i)\\b(?:i will|i''ll|we will)\\b\\s+meet\\b')) AS mine, regexp_matches(b, '{classify.OWED_TO_ME}') AS owed_to_me,
regexp_matches(b, '{classify.MEETING}') AND NOT regexp_matches(b, '{_PAST_SQL}') AS meeting, CASE WHEN len({_SIGNALS_SQL}) > 0 THEN '1. Needs reply: ASAP' ELSE '1. Read only' END AS label
FROM {_said(_BODIES, 'b')}""")
def body_analysis(s, d):
    """TX6-TX8, UD1: the deterministic analyzer."""
    a = _say(s, d, _BODIES, "b").select("conv_id", "turn", classify.analysis(F.col("b")).alias("a"))
    join = lambda c, n: F.array_join(F.col(c), ",").alias(n)
    return a.select("conv_id", "turn", join("a.competitors", "competitors"), join("a.pain_points", "pains"), join("a.buying_signals", "signals"), join("a.requirements", "requirements"), "a.intent", "a.mine", "a.owed_to_me", "a.meeting", F.col("a.label_applied").alias("label"))



@query("""SELECT conv_id, turn, contains(text, '?') OR turn % 5 = 0 AS needs_reply FROM conversations""")
def needs_reply(s, d):
    """TX9, TX10."""
    signals = F.when(F.col("turn") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "conversations").select("conv_id", "turn", classify.needs_reply(F.col("text"), signals).alias("needs_reply"))


@query(f"""SELECT conv_id, turn, nullif(regexp_extract(b, '(?i)\\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b', 1), '') AS day, CASE WHEN NOT regexp_matches(b, '{classify.SCHEDULE}') THEN CASE WHEN regexp_matches(b, '{classify.VAGUE.replace("'", "''")}') THEN 'date and time' END
WHEN NOT regexp_matches(b, '(?i)\\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow)\\b') THEN 'date' WHEN try_cast(nullif(regexp_extract(b, '(?i)\\b(\\d{{1,2}})(?::(\\d{{2}}))?\\s*(am|pm)?\\b', 1), '') AS INT) IS NULL THEN 'time' END AS asks FROM {_said(_BODIES, 'b')}""")
def meeting_clarification(s, d):
    """TX11: which part of a meeting must be asked for."""
    b = F.col("b")
    asks = F.when(~b.rlike(classify.SCHEDULE), F.when(b.rlike(classify.VAGUE), "date and time")).when(~(b.rlike(dates.WEEKDAY) | b.rlike(dates.TOMORROW)), "date").when(dates.clock(b).isNull(), "time")
    return _say(s, d, _BODIES, "b").select("conv_id", "turn", F.nullif(F.regexp_extract(b, dates.WEEKDAY, 1), F.lit("")).alias("day"), asks.alias("asks"))



_AT, _FOR = r"'(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b'", r"'(?i)\bfor\s+(\d+)\s*(minutes?|mins?|hours?|hrs?)\b'"
_INT = "try_cast(nullif(regexp_extract(b, {}, {}), '') AS INT)".format


@query(f"""SELECT conv_id, turn, CASE WHEN hour <= 23 AND minute <= 59 THEN hour * 60 + minute END AS start_minute, CASE WHEN n IS NULL THEN 30 WHEN unit LIKE 'h%' THEN n * 60 ELSE n END AS minutes
FROM (SELECT conv_id, turn, CASE WHEN half = 'pm' AND h <> 12 THEN h + 12 WHEN half = 'am' AND h = 12 THEN 0 ELSE h END AS hour, minute, n, unit
FROM (SELECT conv_id, turn, {_INT(_AT, 1)} AS h, coalesce({_INT(_AT, 2)}, 0) AS minute, lower(regexp_extract(b, {_AT}, 3)) AS half, {_INT(_FOR, 1)} AS n, lower(regexp_extract(b, {_FOR}, 2)) AS unit FROM {_said(_BODIES, 'b')}))""")
def meeting_times(s, d):
    """DT6: start and length of a proposed meeting, in minutes."""
    return _say(s, d, _BODIES, "b").select("conv_id", "turn", dates.clock(F.col("b")).alias("start_minute"), dates.duration(F.col("b")).alias("minutes"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'sales' WHEN c_nationkey % 3 = 0 THEN 'unknown' WHEN c_nationkey % 3 = 1 THEN 'internal' ELSE 'customer' END AS class, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' WHEN c_custkey % 4 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM customer""")
def class_and_confidence(s, d):
    """TX12, TX15."""
    pillar = F.when(F.col("c_custkey") % 5 == 0, " Sales").when(F.col("c_custkey") % 5 == 1, "Hiring")
    internal = F.when(F.col("c_nationkey") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("c_nationkey") % 3 == 1)
    shared = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "customer").select("c_custkey", classify.meeting_class(pillar, internal).alias("class"), classify.confidence(shared, F.col("c_custkey") % 4 == 1).alias("confidence"))


@query("""WITH d AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ash' WHEN 1 THEN 'ash allen' WHEN 2 THEN 'ashley' ELSE 'bo lee' END AS name, c_nationkey % 5 AS org, c_custkey % 6 = 0 AS conflict FROM customer),
c AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'ash' WHEN 1 THEN 'ash allen' WHEN 2 THEN 'ashley' ELSE 'bo lee' END AS canonical, n_regionkey AS org FROM nation),
n AS (SELECT id, name, org, conflict, count(*) AS targets, min(canonical) AS canonical FROM d JOIN c USING (org) WHERE split_part(name, ' ', 1) = split_part(canonical, ' ', 1) GROUP BY 1, 2, 3, 4)
SELECT id, CASE WHEN targets > 1 THEN 'AMBIGUOUS' WHEN conflict THEN 'CONFLICT' WHEN name = 'ash' AND canonical <> 'ash' THEN 'MANUAL' ELSE 'SAFE' END AS class FROM n""")
def candidate_classes(s, d):
    """TX13, TX14: duplicates against canonical people of one organization by first name."""
    k = F.col("c_custkey")
    name = lambda x: F.when(x % 4 == 0, "ash").when(x % 4 == 1, "ash allen").when(x % 4 == 2, "ashley").otherwise("bo lee")
    one = table(s, d, "customer").select(k.alias("id"), F.split(name(k), " ").alias("a"), (F.col("c_nationkey") % 5).alias("org"), (k % 6 == 0).alias("conflict"))
    two = table(s, d, "nation").select(F.split(name(F.col("n_nationkey")), " ").alias("b"), F.col("n_regionkey").alias("org"))
    pairs = one.withColumn("first", F.get("a", F.lit(0))).join(two.withColumn("first", F.get("b", F.lit(0))), ["org", "first"])
    g = pairs.groupBy("id", "a", "conflict").agg(F.count(F.lit(1)).alias("targets"), F.min("b").alias("b"))
    return g.select("id", classify.candidate_class(F.col("targets"), F.col("conflict"), text.short_nickname(F.col("a"), F.col("b")), F.lit(True)).alias("class"))


_PHRASE = "coalesce(" + ", ".join(f"nullif(regexp_extract(b, '{p}', 0), '')" for p in dates.PHRASES) + ")"


@query(f"SELECT conv_id, turn, {_PHRASE} AS phrase FROM {_said(_BODIES, 'b')}")
def date_phrases(s, d):
    """DT2."""
    return _say(s, d, _BODIES, "b").select("conv_id", "turn", dates.date_phrase(F.col("b")).alias("phrase"))



@query(f"""WITH p AS (SELECT conv_id, turn, now, {_PHRASE} AS phrase FROM (SELECT conv_id, turn, TIMESTAMP '1996-01-01' + to_days(CAST((conv_id + turn) % 1000 AS INTEGER)) + to_hours(CAST(turn % 24 AS INTEGER)) AS now, text || CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE ' ' || {_B_SQL} END AS b FROM conversations)),
w AS (SELECT *, CASE lower(phrase) WHEN 'monday' THEN 1 WHEN 'tuesday' THEN 2 WHEN 'friday' THEN 5 END AS dow FROM p)
SELECT conv_id, turn, CASE WHEN phrase = 'June 5th' THEN CASE WHEN make_date(year(now), 6, 5) < CAST(now AS DATE) THEN make_date(year(now) + 1, 6, 5) ELSE make_date(year(now), 6, 5) END::TIMESTAMP
WHEN phrase = 'tomorrow' THEN now + INTERVAL 1 DAY WHEN dow IS NOT NULL THEN now + to_days(CAST(CASE WHEN (dow - isodow(now) + 7) % 7 = 0 THEN 7 ELSE (dow - isodow(now) + 7) % 7 END AS INTEGER)) WHEN phrase = 'in 2 weeks' THEN now + INTERVAL 14 DAY END AS at,
CASE WHEN phrase IS NULL THEN NULL WHEN phrase = 'June 5th' THEN 'stated' WHEN phrase = 'sometime' THEN 'window' ELSE 'inferred' END AS kind FROM w""")
def date_phrase_resolution(s, d):
    """DT3."""
    rows = _bodies(s, d).select("conv_id", "turn", "now", dates.date_phrase(F.col("b")).alias("phrase")).select("conv_id", "turn", dates.resolved_phrase(F.col("phrase"), F.col("now")).alias("r"))
    return rows.select("conv_id", "turn", "r.at", "r.kind")



_BUSINESS = "(SELECT x FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY))::TIMESTAMP AS x) WHERE isodow(x) < 6 ORDER BY x LIMIT 1 OFFSET {})"


@query(f"SELECT o_orderkey, {_BUSINESS.format(1)} AS two, {_BUSINESS.format(2)} AS three FROM orders")
def business_days(s, d):
    """DT4."""
    at = F.col("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", dates.business_days_after(at, 2).alias("two"), dates.business_days_after(at, 3).alias("three"))



@query(f"""SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN NULL WHEN o_custkey % 3 = 0 THEN 'internal' WHEN o_orderstatus = 'P' THEN 'client_open_window' ELSE 'client_fixed_date' END AS audience,
CASE WHEN o_orderpriority <> '1-URGENT' THEN NULL WHEN o_custkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY WHEN o_orderstatus = 'P' THEN NULL ELSE {_BUSINESS.format(1)} END AS earliest FROM orders""")
def follow_up_timing(s, d):
    """DT5."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "owed_to_me").otherwise("mine")
    date_type = F.when(F.col("o_orderstatus") == "P", "window").otherwise("stated")
    rows = table(s, d, "orders")
    return rows.select("o_orderkey", dates.follow_up_timing(kind, date_type, F.col("o_orderdate"), F.col("o_custkey") % 3 == 0).alias("t")).select("o_orderkey", "t.audience", "t.earliest")



@query("""SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-06-17 10:00:00' AND o_orderstatus = 'O' THEN 'reminded' ELSE o_orderstatus END AS status, least(CAST(substr(o_orderpriority, 1, 1) AS INT) + 1, 4) AS next_level FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) <= 4""")
def reminders_and_escalation(s, d):
    """DT7-DT9, SS8."""
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    due = (F.col("o_orderdate") <= F.lit("1998-06-17 10:00:00").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")
    return table(s, d, "orders").where(level <= 4).select("o_orderkey", F.when(due, "reminded").otherwise(F.col("o_orderstatus")).alias("status"), dates.escalated(level).alias("next_level"))


@query("""WITH v AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS e, list_sort(list(DISTINCT l_linestatus)) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(list_filter(e, lambda x: x <> 'N'), list_filter(a, lambda x: NOT list_contains(list_filter(e, lambda y: y <> 'N'), x))), ',') AS merged, e[1] AS first_one FROM v""")
def merge_lists(s, d):
    """AR1, AR6, SNK3."""
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("e"), F.array_sort(F.collect_set("l_linestatus")).alias("a"))
    return v.select("l_orderkey", F.array_join(arrays.merged_list(F.col("e"), F.col("a"), F.array(F.lit("N"))), ",").alias("merged"), arrays.first_or_null(F.col("e")).alias("first_one"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'a=1' END, 'b=' || c_nationkey, 'c=3') AS merged FROM customer""")
def merge_maps(s, d):
    """AR2, AR3: the new entries over the old, a null deletes."""
    s.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 2 == 1, "1"), F.lit("b"), F.col("c_nationkey").cast("string"), F.lit("c"), F.lit("3"))
    m = arrays.merged_map(old, new)
    return table(s, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e["value"]))), ",").alias("merged"))


@query("""WITH v AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_transform(a, lambda x: CASE WHEN x = 7 THEN 8 ELSE x END))), ',') AS repointed FROM v WHERE list_contains(a, 7)""")
def repoint_lists(s, d):
    """AR5, AR8."""
    v = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a")).where(F.array_contains("a", 7))
    return v.select("l_orderkey", F.array_join(F.transform(F.array_sort(arrays.repointed(F.col("a"), F.lit(7), F.lit(8))), lambda x: x.cast("string")), ",").alias("repointed"))
