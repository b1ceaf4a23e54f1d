"""What a mail leaves behind: outcomes of the write path's steps, and each person's snapshot entries.

Both are joins on the mail's id and an aggregate of one mail's few rows; nothing is folded in order of arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Predicates that are a category of their own in a snapshot; any other is "knowledge".
PERSON_FACTS = ["role", "responsibility", "preference", "goal", "interest", "concern", "pain_point", "objection", "buying_signal", "other"]
# The stage that a step leaves a mail in.
STAGE_OF = {"ingest": "THREADED", "analysis": "MEETING_PROCESSED", "context": "CONTEXT_BUILT", "reply": "REPLY_PROCESSED", "complete": "COMPLETED"}


def step_outcomes(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """mail, step, outcome, stage of requests(mail, step) against stored(mail, thread, stage, n_entities, in_context, has_draft), one row a mail.

    Outcomes: done, already (nothing is written twice), no_mail, no_thread, no_entities; only `done` moves the stage.
    """
    rows = requests.join(stored.withColumn("_there", F.lit(True)), "mail", "left")
    step, there = F.col("step"), F.col("_there").isNotNull()
    again = (
        F.when(step.isin("ingest", "complete"), F.col("stage") == "COMPLETED")
        .when(step == "context", F.col("in_context"))
        .when(step == "reply", F.col("has_draft"))
        .otherwise(False)
    )
    outcome = (
        F.when(step.isin("analysis", "complete") & ~there, "no_mail")
        .when(F.coalesce(again, F.lit(False)), "already")
        .when((step == "analysis") & F.col("thread").isNull(), "no_thread")
        .when((step == "complete") & (F.coalesce("n_entities", F.lit(0)) == 0), "no_entities")
        .otherwise("done")
    )
    stages = F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair])
    told = rows.withColumn("outcome", outcome)
    return told.select("mail", "step", "outcome", F.when(F.col("outcome") == "done", F.try_element_at(stages, step)).otherwise(F.col("stage")).alias("stage"))


def _entry(rank: int, category: Column | str, record: Column, summary: Column, provenance: Column | str = "observed") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rank).alias("rank"), record.cast("string").alias("record"), lit(category).alias("category"), summary.alias("summary"), lit(provenance).alias("provenance"))


def snapshot_entries(mails: DataFrame, organizations: DataFrame, referenced: list[tuple[str, DataFrame]], personal: DataFrame, facts: DataFrame) -> DataFrame:
    """person, mail, entries: one snapshot of each person and mail, its entries by category and record.

    mails(person, mail, is_sender, subject, org), organizations(org, name). referenced: (category, (person, mail, record, summary)), in order
    of category; a record counts only for the persons it names. personal(person, mail, record, summary) counts for senders alone.
    facts(person, mail, record, predicate, value, stated) come last. A retried mail gives the same row.
    """
    key = ["person", "mail"]
    seen = mails.select(*key, _entry(0, "email_interaction", F.lit(None), F.concat(F.when(F.col("is_sender"), "Sent").otherwise("Received/referenced in"), F.lit(" email: "), "subject")).alias("e"))
    at = mails.select(*key, "org").join(organizations, "org").select(*key, _entry(1, "organization", F.col("org"), F.col("name")).alias("e"))
    parts = [mails.select(*key).join(d, key).select(*key, _entry(2 + k, name, F.col("record"), F.col("summary")).alias("e")) for k, (name, d) in enumerate(referenced)]
    last = 2 + len(referenced)
    own = mails.where("is_sender").select(*key).join(personal, key).select(*key, _entry(last, "personal_item", F.col("record"), F.col("summary")).alias("e"))
    known = F.col("predicate").isin(PERSON_FACTS)
    category = F.when(known, F.col("predicate")).otherwise("knowledge")
    summary = F.when(known, F.col("value")).otherwise(F.concat("predicate", F.lit(": "), "value"))
    learnt = mails.select(*key).join(facts, key).select(*key, _entry(last + 1, category, F.col("record"), summary, F.when(F.col("stated"), "observed").otherwise("inferred")).alias("e"))
    rows = reduce(DataFrame.unionByName, [seen, at, *parts, own, learnt])
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("e")).alias("entries"))
