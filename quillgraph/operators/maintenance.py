"""Keyed upserts, merges of records, snapshots and their rollback, uniqueness and coverage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old with the non-null values of new's row of the same key, and new's other rows."""
    right = new.select(key, *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    out = old.join(right, key, "full_outer")
    return out.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, content: Column) -> DataFrame:
    """created, updated, unchanged, removed: how many keys of each, by the content's digest."""
    of = lambda d, n: d.select(key, F.sha2(content, 256).alias(n))
    both = of(old, "a").join(of(new, "b"), key, "full_outer")
    count = lambda c: F.count_if(c).alias
    return both.agg(
        count(F.col("a").isNull())("created"),
        count(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))("updated"),
        count(F.col("a") == F.col("b"))("unchanged"),
        count(F.col("b").isNull())("removed"),
    )


def repointed(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """References in the columns, from mapping(old, new); all others stay. One equi-join a column."""
    for c in columns:
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        df = df.join(m, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return df


def retired(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Rows with lifecycle columns status and merged_into: merged where the mapping names the row."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("merged_into"))
    return df.join(m, F.col(key) == F.col("_old"), "left").withColumn("status", F.when(F.col("_old").isNotNull(), "merged").otherwise("active")).drop("_old")


def plan_faults(mapping: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(old, fault) of a merge plan: self, repeated, multi_target, chained, unknown."""
    m = mapping.select("old", "new")
    ids = known.select(F.col(key).alias("old")).distinct()
    per = m.groupBy("old").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new").alias("targets"))
    parts = [
        m.where("old = new").select("old", F.lit("self").alias("fault")),
        per.where("n > targets").select("old", F.lit("repeated").alias("fault")),
        per.where("targets > 1").select("old", F.lit("multi_target").alias("fault")),
        m.join(m.select(F.col("old").alias("new")).distinct(), "new", "left_semi").where("old <> new").select("old", F.lit("chained").alias("fault")),
        m.join(ids, "old", "left_anti").select("old", F.lit("unknown").alias("fault")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def restorable(before: DataFrame, after: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, verdict): restore where the row now is what the change left, conflict where something else came, missing where it went."""
    pack = lambda d, n: d.select(key, F.struct(*sorted(c for c in d.columns if c != key)).alias(n))
    rows = pack(before, "before").join(pack(after, "after"), key).join(pack(now, "now"), key, "left")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("now").eqNullSafe(F.col("after")), "restore").otherwise("conflict")
    return rows.select(key, verdict.alias("verdict"))


def duplicates(df: DataFrame, value: Column, key: str) -> DataFrame:
    """(value, n, least) of values on more than one row; nulls and empty strings are no values."""
    return df.select(value.alias("value"), F.col(key)).where("value is not null and value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def coverage(*parts: tuple[str, DataFrame, Column]) -> DataFrame:
    """(collection, total, missing): rows of each table and those where the condition says that a reference is missing."""
    return reduce(DataFrame.unionByName, (d.agg(F.lit(n).alias("collection"), F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("missing")) for n, d, missing in parts))


def dropped(df: DataFrame, *columns: str) -> tuple[DataFrame, Column]:
    """The table without the columns, and the check of how many rows had a value in any of them."""
    return df.drop(*columns), F.count_if(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns)))


def without_prefix(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """Rows of which no column starts with the prefix; a null starts with nothing."""
    hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).startswith(prefix), F.lit(False)) for c in columns))
    return df.where(~hit)


def safe_target(name: str) -> str:
    """The name, unless it speaks of production: then the write is refused."""
    if "production" in name.lower():
        raise ValueError(f"refusing to write to {name}")
    return name


def absorbed(df: DataFrame, mapping: DataFrame, key: str, name: str, fill: list[str]) -> DataFrame:
    """Canonical rows after a merge: their own name, blanks of `fill` taken from the merged rows in order of key, aliases of these.

    Names of merged rows become aliases, sorted, but for the canonical name itself.
    """
    rows = repointed(df.select(key, name, *fill).withColumn("_part", F.col(key)), mapping, key)
    own = F.when(F.col("_part") == F.col(key), 0).otherwise(1)  # the canonical row's values come first
    order = F.struct(own, F.col("_part"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    out = rows.groupBy(key).agg(F.min_by(name, order).alias(name), *(first(c).alias(c) for c in fill), F.collect_set(F.when(own == 1, F.col(name))).alias("_names"))
    return out.withColumn("aliases", F.array_sort(F.array_remove("_names", F.col(name)))).drop("_names")


def calendar_safety(df: DataFrame, attendees: str, pending: Column) -> DataFrame:
    """unsafe (pending without an attendee), with_attendees, total."""
    n = F.coalesce(F.size(attendees), F.lit(0))
    return df.agg(F.count_if((n == 0) & pending).alias("unsafe"), F.count_if(n > 0).alias("with_attendees"), F.count(F.lit(1)).alias("total"))


def organization_backfill(people: DataFrame, known: DataFrame, key: str, email: str) -> DataFrame:
    """key, action, domain, org_id of every person, from known(org_id, domain): link, create, malformed or no_address."""
    rows = people.select(key, email, text.email_domain(F.col(email)).alias("domain"))
    action = F.when(F.col(email).isNull(), "no_address").when(F.col("domain").isNull(), "malformed").when(F.col("org_id").isNull(), "create").otherwise("link")
    return rows.join(known, "domain", "left").select(key, action.alias("action"), "domain", "org_id")


def reset(df: DataFrame, environment: str) -> DataFrame:
    """The table without a row; refused outside test and development."""
    if environment not in ("test", "development"):
        raise ValueError(f"refusing to reset in {environment}")
    return df.limit(0)


def lifecycle(df: DataFrame, key: str, status: str, target: str) -> DataFrame:
    """active, merged, no_target, self and invalid rows; a missing status is active."""
    now, to = F.coalesce(status, F.lit("active")), F.col(target)
    merged = now == "merged"
    return df.agg(
        F.count_if(now == "active").alias("active"), F.count_if(merged & to.isNotNull() & (to != F.col(key))).alias("merged"), F.count_if(merged & to.isNull()).alias("no_target"), F.count_if(merged & (to == F.col(key))).alias("self"), F.count_if(~now.isin("active", "merged")).alias("invalid")
    )
