"""Resolution of people, projects, opportunities, meetings, personal items and links between records.

Names are compared as token sets within a scope (an organization, a mail, a thread): scope and token make one key, so that a pair is
only met within its scope, at a set's rarest token. Who asks for the one match or the first never needs the pairs: rows of one name are one
class, and the least and the greatest record of the classes that a name meets tell. What the reference does mail by mail in order of arrival is written here as
aggregates over (order, value), wherever the outcome depends on first and last values alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import classify, text
from quillgraph.operators import joins


def scoped(scope: Column, tokens: Column) -> Column:
    """Tokens that are equal only within their scope; none without a scope."""
    return F.when(scope.isNotNull(), F.transform(tokens, lambda t: F.concat(scope.cast("string"), F.lit("\x01"), t))).otherwise(F.array().cast("array<string>"))


def name_matches(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """(mention, record) of mentions(mention, scope, name) and records(record, scope, name) whose names hold one another within a scope."""
    left = mentions.select("mention", scoped(F.col("scope"), text.tokens(F.col("name"))).alias("t"))
    right = records.select("record", scoped(F.col("scope"), text.tokens(F.col("name"))).alias("u"))
    return joins.token_subsets(left, right, "mention", "t", "record", "u").select(F.col("a").alias("mention"), F.col("b").alias("record"))


def _bounds(mentions: DataFrame, known: DataFrame, inward: bool = False) -> DataFrame:
    """(mention, lo, hi) of mentions(mention, scope, name) over the sets of known(bt, lo, hi) that their names meet; none without one."""
    known = known.where(F.size("bt") > 0).groupBy("bt").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = mentions.select("scope", "name").distinct().withColumn("at", F.array_sort(F.array_distinct(scoped(F.col("scope"), text.tokens(F.col("name"))))))
    met = joins.set_pairs(asked, known, inward).join(known, "bt").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_name = asked.join(met, "at").select("scope", "name", "lo", "hi")
    return mentions.select("mention", "scope", "name").join(by_name, ["scope", "name"]).select("mention", "lo", "hi")


def name_bounds(mentions: DataFrame, records: DataFrame, value: Column | None = None) -> DataFrame:
    """(mention, lo, hi): the least and the greatest record, or value of a record, of name_matches(), without its pairs.

    A mention has a row for each of its rows that has a match.
    """
    value = F.col("record") if value is None else value
    known = records.groupBy("scope", "name").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return _bounds(mentions, known.select(F.array_sort(scoped(F.col("scope"), text.tokens(F.col("name")))).alias("bt"), "lo", "hi"))


def alias_bounds(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """(mention, lo, hi): the least and the greatest of the records whose aliases together hold all tokens of the mention's name, within a scope."""
    known = records.groupBy("scope", "aliases").agg(F.min("record").alias("lo"), F.max("record").alias("hi"))
    words = F.flatten(F.transform(F.array_compact("aliases"), text.tokens))
    return _bounds(mentions, known.select(F.array_sort(F.array_distinct(scoped(F.col("scope"), words))).alias("bt"), "lo", "hi"), inward=True)


def unique_match(pairs: DataFrame) -> DataFrame:
    """The record of each mention that has exactly one; the others are never guessed."""
    return joins.only_candidate(pairs, "mention", "record")


def only_match(bounds: DataFrame) -> DataFrame:
    """(mention, record) of each mention whose least and greatest record are one; the others are never guessed."""
    return bounds.groupBy("mention").agg(F.min("lo").alias("record"), F.max("hi").alias("hi")).where("record = hi").drop("hi")


def people_without_address(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """(mention, record): the one person with an address whose organization is the mention's and whose name or aliases match it."""
    known = people.where("email is not null")
    return only_match(name_bounds(mentions, known).unionByName(alias_bounds(mentions, known)))


def is_operator(email: Column, name: Column, own_email: str, own_name: str) -> Column:
    """Whether a mention is the operator: the own address, or without an address the own name's tokens."""
    own = text.tokens(F.lit(own_name))
    mine = F.array_sort(text.tokens(name)) == F.array_sort(own)
    has = F.coalesce(F.trim(email), F.lit("")) != ""
    return F.when(has, F.lower(F.trim(email)) == own_email.strip().lower()).otherwise(F.coalesce(mine, F.lit(False)))


def projects(mentions: DataFrame) -> DataFrame:
    """mention, project (its first mention) of mentions(mention, at, name, pillar, entity); name and entity are normal forms.

    A name and pillar is one project for each entity; a mention without one belongs to the first project of its name and pillar, and
    that project takes the first entity that is said of it. So the first known entity and no entity are one project.
    """
    key = ["name", "pillar"]
    order = F.struct("at", "mention")
    first = mentions.groupBy(*key).agg(F.min_by("entity", F.when(F.col("entity").isNotNull(), order)).alias("main"))
    rows = mentions.join(first.select(F.col("name").alias("n"), F.col("pillar").alias("p"), "main"), F.col("name").eqNullSafe(F.col("n")) & F.col("pillar").eqNullSafe(F.col("p")))
    rows = rows.withColumn("entity", F.coalesce("entity", "main"))
    heads = rows.groupBy(*key, "entity").agg(F.min_by("mention", order).alias("project"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*key, "entity")]
    return rows.alias("r").join(heads.alias("h"), same[0] & same[1] & same[2]).select("r.mention", "h.project")


def opportunities(sales: DataFrame) -> DataFrame:
    """project, opportunity (first mail), n_mails, people (sorted), org (first known) of sales(project, mail, at, person, org): one a project."""
    order = F.struct("at", "mail")
    return sales.groupBy("project").agg(
        F.min_by("mail", order).alias("opportunity"), F.count_distinct("mail").alias("n_mails"), F.array_sort(F.collect_set("person")).alias("people"), F.min_by("org", F.when(F.col("org").isNotNull(), order)).alias("org")
    )


def grouped_records(rows: DataFrame, *key: str) -> DataFrame:
    """key, record (the first id), n of rows(id, at, *key): one record a key, in which a null equals a null."""
    return rows.groupBy(*key).agg(F.min_by("id", F.struct("at", "id")).alias("record"), F.count(F.lit(1)).alias("n"))


def attributed(facts: DataFrame, people: DataFrame) -> DataFrame:
    """(fact, person): facts(fact, mail, email, name) to the people(mail, person, email, name) of their mail.

    An address that one person of the mail has decides; one that several have decides against; else the only name match.
    """
    known = people.select("mail", "person", F.lower("email").alias("address")).groupBy("mail", "address").agg(F.min("person").alias("lo"), F.max("person").alias("hi"))
    by_address = facts.where("email is not null").select("fact", "mail", F.lower(F.trim("email")).alias("address")).join(known, ["mail", "address"])
    counted = by_address.groupBy("fact").agg(F.min("lo").alias("person"), F.max("hi").alias("hi"))
    rest = facts.join(counted.select("fact"), "fact", "left_anti")
    named = only_match(name_bounds(rest.select(F.col("fact").alias("mention"), F.col("mail").alias("scope"), "name"), people.select(F.col("person").alias("record"), F.col("mail").alias("scope"), "name")))
    return counted.where("person = hi").select("fact", "person").unionByName(named.select(F.col("mention").alias("fact"), F.col("record").alias("person")))


def linked_knowledge(items: DataFrame, people: DataFrame, organizations: DataFrame) -> DataFrame:
    """(mention, kind, record): each item's first matching person of its scope, else the first matching organization.

    items(mention, scope, name); people and organizations(record, scope, name, place).
    """
    parts = []
    for tier, (kind, records) in enumerate((("person", people), ("organization", organizations))):
        found = name_bounds(items, records, F.struct("place", "record")).groupBy("mention").agg(F.min("lo").alias("lo"))
        parts.append(found.select("mention", F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.col("lo.record").cast("string").alias("record")).alias("r")))
    return parts[0].unionByName(parts[1]).groupBy("mention").agg(F.min("r").alias("r")).select("mention", "r.kind", "r.record")


def same_day_meeting(actions: DataFrame, meetings: DataFrame) -> DataFrame:
    """(action, meeting) of actions(action, mail, day) and meetings(mail, meeting, day): the mail's only meeting, or its only one of that day."""
    of_mail = meetings.groupBy("mail").agg(F.count_distinct("meeting").alias("n"), F.min("meeting").alias("only"))
    of_day = meetings.groupBy("mail", "day").agg(F.count_distinct("meeting").alias("k"), F.min("meeting").alias("same"))
    rows = actions.join(of_mail, "mail").join(of_day, ["mail", "day"], "left")
    return rows.select("action", F.when(F.col("n") == 1, F.col("only")).when(F.col("k") == 1, F.col("same")).alias("meeting")).where("meeting is not null")


def duplicate_people(people: DataFrame) -> DataFrame:
    """(source, target, axis, confidence) of people(id, name, org, email, threads) that may be one person; only proposals.

    orphan: a person without an address and the one person with an address whose name matches; among several, the only one that shares
    a thread. anchor: two people with addresses, one name and one organization; the later id is the source.
    """
    rows = people.select("id", "name", text.normalize_text(F.col("name")).alias("normal"), F.nullif(text.normalize_text(F.coalesce(F.col("org").cast("string"), F.lit(""))), F.lit("")).alias("org"), "email", F.array_compact(F.coalesce("threads", F.array())).alias("threads"))
    anchors, orphans = rows.where("email is not null"), rows.where("email is null")
    named = lambda d, k, scope: d.select(F.col("id").alias(k), scope.alias("scope"), "name")
    bounds = lambda scope: name_bounds(named(orphans, "mention", scope), named(anchors, "record", scope)).groupBy("mention").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_, met = bounds(F.lit("")), bounds(F.explode("threads")).where("lo = hi").select("mention", F.col("lo").alias("met"))
    chosen = all_.join(met, "mention", "left").select("mention", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("met")).alias("record")).where("record is not null")
    side = lambda d, k, p: d.select(F.col("id").alias(k), F.col("org").alias(f"{p}_org"), F.col("threads").alias(f"{p}_threads"))
    known = chosen.join(side(orphans, "mention", "a"), "mention").join(side(anchors, "record", "b"), "record")
    sure = classify.confidence(F.array_intersect("a_threads", "b_threads"), F.coalesce(F.col("a_org") == F.col("b_org"), F.lit(False)))
    orphan = known.select(F.col("mention").alias("source"), F.col("record").alias("target"), F.lit("orphan").alias("axis"), sure.alias("confidence"))
    same = joins.anchored_pairs(anchors.where("org is not null"), "id", F.col("normal"), F.col("org"), carried="threads")
    anchor = same.select(F.col("b").alias("source"), F.col("a").alias("target"), F.lit("anchor").alias("axis"), F.when(F.arrays_overlap("a_threads", "b_threads"), "HIGH").otherwise("MEDIUM").alias("confidence"))
    return orphan.unionByName(anchor)


def folded_context(deltas: DataFrame) -> DataFrame:
    """thread, field, state: the list after all deltas(thread, seq, field, add, remove) of a thread and field.

    A delta takes its removals out, then appends what is not there yet. So a value stays if its last addition is not before its last
    removal, and its place is that of its first addition since then. Additions and removals are one relation, so there is no join, and
    deltas that are dealt by thread already are not shuffled again.
    """
    said = lambda c, pos: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v, i: F.struct(v.alias("value"), pos(i).alias("pos")))
    each = F.concat(said("add", lambda i: i), said("remove", lambda i: F.lit(None).cast("int")))
    rows = deltas.select("thread", "field", "seq", F.explode_outer(each).alias("r")).select("thread", "field", "seq", F.col("r").isNotNull().alias("said"), "r.*")
    removal = F.when(F.col("said") & F.col("pos").isNull() & F.col("value").isNotNull(), F.col("seq"))
    rows = rows.withColumn("gone", F.max(removal).over(Window.partitionBy("thread", "field", "value")))
    stays = F.col("pos").isNotNull() & (F.col("gone").isNull() | (F.col("seq") >= F.col("gone")))
    places = rows.groupBy("thread", "field", "value").agg(F.min(F.when(stays, F.struct("seq", "pos"))).alias("place"))
    kept = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))
    return places.groupBy("thread", "field").agg(F.transform(F.array_sort(kept), lambda x: x["value"]).alias("state"))
