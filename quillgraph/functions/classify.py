"""Rule-based classifiers over text columns; in each list the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question patterns and intents, in order.
INTENTS = [
    (r"\bprepare\b.*\bmeeting\b|\bmeeting prep", "meeting_preparation"),
    (r"\bemail activity\b|\brecent emails?\b|\blatest emails?\b|\bemails? (?:with|from|about)\b", "email_activity"),
    (r"\bwhat (?:changed|happened)\b.*\b(with|to)\b|\bsales activity\b|\bactivity\b", "cross_entity_activity"),
    (r"\bwaiting on\b|\bowes? me\b|\bowed to me\b|\bcommitments?\b|\bcommit(?:ted)\b|\bwhat did .* ask me\b|\bwhat do i owe\b|\bi owe\b", "commitments"),
    (r"\bfollow[\s-]?ups?\b|\bneeds? follow", "follow_ups"),
    (r"\bcontext on\b.*\b(company|organization|customer)\b|\bcompany context\b", "organization_context"),
    (r"\bcontext on\b|\bwho is\b|\bperson context\b", "person_context"),
    (r"\bproject\b", "project_context"),
    (r"\bthread\b", "thread_context"),
    (r"\brespond to\b|\breply draft|\bdrafts?\b", "reply_drafts"),
    (r"\bknowledge\b|\bwhat do (?:we|I) know\b", "knowledge"),
    (r"\bmeetings?\b", "meetings"),
    (r"\bcompany\b|\borganization\b|\bcustomer\b", "organization_context"),
    (r"\bperson\b|\bcontact\b", "person_context"),
]

# Date words and range kinds, in order.
DATE_KINDS = [
    (r"\btoday\b", "today"),
    (r"\btomorrow\b", "tomorrow"),
    (r"\byesterday\b", "yesterday"),
    (r"\bnext week\b", "next_week"),
    (r"\blast week\b", "last_week"),
    (r"\bthis week\b", "this_week"),
    (r"\bnext month\b", "next_month"),
    (r"\bthis month\b", "this_month"),
    (r"\bupcoming\b|\bcoming up\b", "upcoming"),
    (r"\boverdue\b", "overdue"),
    (r"\brecent(?:ly)?\b", "recent"),
    (r"\blatest\b|\blast\b", "latest"),
]

# Who owes whom, asked of commitments only.
OWNERSHIP = [
    (r"\bwaiting on\b|\bowes? me\b|\bowed to me\b", "other_person_owes"),
    (r"\bwhat do i owe\b|\bi owe\b|\bmy commitments?\b|\bcommitments? did i make\b|\bi committed\b", "user_owes"),
]

# The pillars that name a class of meeting.
PILLARS = ["sales", "finance"]

# The deterministic analyzer's words.
COMPETITORS = ["Salesforce", "HubSpot", "Microsoft", "Zoho"]
PAINS = ["pricing", "manual", "slow", "integration", "clunky", "expensive"]
SIGNALS = [
    (r"\bpricing\b", "pricing request"),
    (r"\bdemo\b", "demo request"),
    (r"\bproposal\b", "proposal request"),
    (r"\bsecurity review\b", "security review"),
    (r"\bprocurement\b", "procurement request"),
]
SEATS = r"(?i)\b(\d+)\s*(seats?|users?|licen[sc]es?)\b"
MINE = r"(?i)\b(?:i will|i'll|we will)\b(?!\s+meet\b)"
OWED_TO_ME = r"(?i)\bcould you\b|\bcan you\b"
MEETING = r"(?i)\b(meet|meeting|meetings|call|sync|catch up)\b"
PAST_MEETING = (
    r"(?i)\b(?:during|after|following)\s+(?:our|the|that|this)\s+(?:meeting|meetings|call|sync|catch up)\b"
    r"|\b(?:yesterday|today|last\s+\w+)'?s\s+(?:meeting|meetings|call|sync)\b|\bwe\s+discussed\s+in\b|\bas\s+discussed\b"
)

# Language of a proposed meeting, and of a vague one.
SCHEDULE = r"(?i)\b(meet|call|sync|discussion|chat)\b"
VAGUE = r"(?i)\b(maybe|sometime|soon|at some point|let'?s connect)\b"

# A name after a preposition, and words that start no name.
MENTION = r"(?i)\b(?:with|for|about|on|who(?:'s| is))\s+((?!this\b)[A-Za-z][\w' .-]*?)(?=\s*[?.!]|\s+(?:today|tomorrow|yesterday|this|next|last|with|for|about|on)\b|$)"
NOT_NAMES = ["my", "the", "a", "an", "our", "your", "their", "his", "her"]


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.when(c.rlike(f"(?i){rules[0][0]}"), rules[0][1])
    for pattern, value in rules[1:]:
        out = out.when(c.rlike(f"(?i){pattern}"), value)
    return out.otherwise(F.lit(otherwise))


def intent(c: Column) -> Column:
    return first_match(c, INTENTS, "unsupported")


def date_kind(c: Column) -> Column:
    return first_match(c, DATE_KINDS)


def ownership(c: Column) -> Column:
    return F.when(intent(c) == "commitments", first_match(c, OWNERSHIP))


def mention(c: Column) -> Column:
    """The first name after a preposition that does not start with a determiner."""
    found = F.transform(F.regexp_extract_all(c, F.lit(MENTION), 1), F.trim)
    return F.get(F.filter(found, lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit(" "), F.lit(1))).isin(NOT_NAMES)), F.lit(0))


def contained(c: Column, words: list[str]) -> Column:
    """Those of the words that the text contains, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), F.lower(w)))


def signals(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c.rlike(f"(?i){p}"), F.lit(label)) for p, label in SIGNALS)))


def requirements(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(SEATS), 1), lambda n: F.concat(n, F.lit(" seats")))


def meeting_proposed(c: Column) -> Column:
    return c.rlike(MEETING) & ~c.rlike(PAST_MEETING)


def analysis(c: Column) -> Column:
    """What the deterministic analyzer finds in a body."""
    found = signals(c)
    return F.struct(
        F.substring(c, 1, 200).alias("summary"),
        F.when(F.lower(c).contains("meet") | F.lower(c).contains("call"), "meeting_request").when(F.size(found) > 0, "buying_signal").otherwise("evaluation").alias("intent"),
        contained(c, COMPETITORS).alias("competitors"),
        contained(c, PAINS).alias("pain_points"),
        found.alias("buying_signals"),
        requirements(c).alias("requirements"),
        c.rlike(MINE).alias("mine"),
        c.rlike(OWED_TO_ME).alias("owed_to_me"),
        meeting_proposed(c).alias("meeting"),
        F.when(F.size(found) > 0, "1. Needs reply: ASAP").otherwise("1. Read only").alias("label_applied"),
    )


def needs_reply(body: Column, *lists: Column) -> Column:
    """A question mark in the body, or something in any list."""
    out = body.contains("?")
    for x in lists:
        out = out | (F.coalesce(F.size(x), F.lit(0)) > 0)
    return out


def missed_commitment(body: Column, commitments: Column) -> Column:
    """Commitment language in the body while none was extracted."""
    return (body.rlike(MINE) | body.rlike(OWED_TO_ME)) & (F.coalesce(F.size(commitments), F.lit(0)) <= 0)


def candidate_class(n_targets: Column, conflicting: Column, nickname: Column, sure: Column) -> Column:
    """AMBIGUOUS before CONFLICT before MANUAL before SAFE."""
    return F.when(n_targets > 1, "AMBIGUOUS").when(conflicting, "CONFLICT").when(nickname | ~sure, "MANUAL").otherwise("SAFE")


def confidence(shared_threads: Column, same_org: Column) -> Column:
    return F.when(F.size(shared_threads) > 0, "HIGH").when(same_org, "MEDIUM").otherwise("LOW")


def meeting_class(pillar: Column, all_internal: Column) -> Column:
    """Sales or finance where the pillar says so, else what the attendees' domains say (null: no attendee or own domain known)."""
    known = F.lower(F.trim(pillar))
    return F.when(known.isin(PILLARS), known).when(all_internal.isNull(), "unknown").when(all_internal, "internal").otherwise("customer")
