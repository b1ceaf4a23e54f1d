"""Changes of many tables that become visible together: staged writes, a run ledger, one manifest.

A store is a folder. Its manifest, the one with the highest number, names the folder of each table. A run writes the tables that it
changes beside the old ones, step by step, and notes each step when it is written; at the end one new manifest makes all of them
visible at once. A run that was killed anywhere is started again under its id: it passes over the steps that are noted, writes the one
that was cut off anew, and ends in the same tables. A plan is told by a checksum of its rows in any order; a run goes on only
with the plan that it was started with. Two runs from one manifest can't both end: the second finds its number taken.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import maintenance
from quillgraph.tables import get_text, listed, put_new

Read = Callable[[str], DataFrame]


class Refused(ValueError):
    """A plan that may not be applied, or a run that may not go on."""


def checksum(plan: DataFrame) -> str:
    """Of the rows in any order: their number, and sums and exclusive ors of two row digests. An added, missing, repeated or changed row shows."""
    columns = [F.coalesce(F.to_json(F.struct(c), {"ignoreNullFields": "false"}), F.lit("")) for c in sorted(plan.columns)]
    a, b = F.xxhash64(*columns), F.xxhash64(F.lit("plan"), *columns)
    r = plan.select(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sum"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y")).first()
    return f"{r['n']}-{r['sum'] or 0}-{(r['x'] or 0) & (1 << 64) - 1:016x}{(r['y'] or 0) & (1 << 64) - 1:016x}"


class Store:
    """Tables under one folder; every manifest stays readable."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The number of the newest manifest; -1 before the first."""
        names = listed(self.spark, f"{self.root}/manifests")
        return int(names[-1].removesuffix(".json")) if names else -1

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(get_text(self.spark, f"{self.root}/manifests/{version:010d}.json")) if version >= 0 else {"tables": {}, "run": None}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][name])

    def publish(self, tables: dict[str, str], run: str, base: int) -> int:
        """The manifest after base, with these tables in place of base's; refused if another came first."""
        text = json.dumps({"tables": {**self.manifest(base)["tables"], **tables}, "run": run}, sort_keys=True)
        try:
            put_new(self.spark, f"{self.root}/manifests/{base + 1:010d}.json", text)
        except FileExistsError:
            if self.manifest(base + 1)["run"] != run:  # else it was killed between this and its last note
                raise Refused(f"manifest {base + 1} is another run's") from None
        return base + 1

    def create(self, **tables: DataFrame) -> int:
        """First tables, under a run of their own."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/data/{name}/first")
        return self.publish({n: f"{self.root}/data/{n}/first" for n in tables}, "first", self.version())


@dataclass(frozen=True)
class Step:
    """Writes one table anew, from read(table): the run's own version of a table where an earlier step wrote it, else the store's."""

    name: str
    table: str
    build: Callable[[Read], DataFrame]


@dataclass
class Run:
    """What the ledger has of a run."""

    start: dict
    steps: dict[str, dict] = field(default_factory=dict)
    done: dict | None = None


def ledger(store: Store, run: str) -> Run | None:
    """The run's notes, or None if it never started."""
    at = f"{store.root}/runs/{run}"
    notes = {n: json.loads(get_text(store.spark, f"{at}/{n}")) for n in listed(store.spark, at)}
    if "start.json" not in notes:
        return None
    return Run(notes["start.json"], {n.removeprefix("step-").removesuffix(".json"): v for n, v in notes.items() if n.startswith("step-")}, notes.get("done.json"))


def execute(store: Store, run: str, plan: DataFrame, steps: list[Step], check: Callable[[Read], list[str]] | None = None) -> Run:
    """All steps of the run that are not noted yet, then check (what it names is a fault, and nothing becomes visible), then the manifest."""
    total, at = checksum(plan), f"{store.root}/runs/{run}"
    found = ledger(store, run)
    if found is None:
        put_new(store.spark, f"{at}/start.json", json.dumps({"plan": total, "base": store.version(), "steps": [s.name for s in steps]}))
        found = ledger(store, run)
    if found.start["plan"] != total or found.start["steps"] != [s.name for s in steps]:
        raise Refused(f"run {run} was started with another plan")
    if found.done:
        return found
    base = found.start["base"]
    staged = {v["table"]: v["path"] for _, v in sorted(found.steps.items(), key=lambda x: found.start["steps"].index(x[0]))}

    def read(name: str) -> DataFrame:
        return store.spark.read.parquet(staged[name]) if name in staged else store.table(name, base)

    for k, step in enumerate(steps):
        if step.name in found.steps:
            continue
        path = f"{store.root}/data/{step.table}/{run}-{k}"
        step.build(read).write.mode("overwrite").parquet(path)
        staged[step.table] = path
        put_new(store.spark, f"{at}/step-{step.name}.json", json.dumps({"table": step.table, "path": path}))
    if faults := check(read) if check else []:
        raise Refused(f"run {run}: {', '.join(faults)}")
    version = store.publish(staged, run, base)
    put_new(store.spark, f"{at}/done.json", json.dumps({"version": version, "tables": staged}))
    return ledger(store, run)


def undo(store: Store, run: str) -> int:
    """A new manifest with the tables as they were before the run; refused if one of them has changed since."""
    found = ledger(store, run)
    if not found or not found.done:
        raise Refused(f"run {run} has not ended")
    now, before, version = store.manifest()["tables"], store.manifest(found.start["base"])["tables"], store.version()
    if changed := sorted(t for t, p in found.done["tables"].items() if now.get(t) != p):
        raise Refused(f"changed since: {', '.join(changed)}")
    return store.publish({t: before[t] for t in found.done["tables"]}, f"undo {run}", version)


@dataclass(frozen=True)
class Reference:
    """Columns of a table that name records; lists hold several. key tells its rows apart."""

    table: str
    key: tuple[str, ...]
    scalars: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()


def approved(plan: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(old, new) of a plan (old, new, approved): its approved rows, once. Refused if none is, or if they are faulty."""
    rows = plan.where("approved").select("old", "new")
    if rows.isEmpty():
        raise Refused("no row of the plan is approved")
    faults = maintenance.plan_faults(rows, known, key).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).orderBy("fault").collect()
    if faults:
        raise Refused("the plan has faults: " + ", ".join(f"{r['fault']} {r['n']}" for r in faults))
    return rows


def gated(mapping: DataFrame, actions: DataFrame, person: str, attendees: Column) -> DataFrame:
    """mapping with blocked: whether an action of either record has attendees, so that nothing of it may be applied."""
    outward = actions.where(F.coalesce(F.size(attendees), F.lit(0)) > 0).select(F.col(person).alias("_who")).distinct()
    sides = mapping.select("old", F.explode(F.array("old", "new")).alias("_who")).join(outward, "_who", "left_semi").select("old").distinct()
    return mapping.join(sides.withColumn("blocked", F.lit(True)), "old", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def repointed_list(df: DataFrame, mapping: DataFrame, key: tuple[str, ...], column: str) -> DataFrame:
    """Every entry of the list follows the mapping; an entry that was there already stays in its first place. Other rows are not touched."""
    m = mapping.select(F.col("old").alias("_value"), F.col("new").alias("_new"))
    entries = df.select(*key, F.posexplode(column).alias("_at", "_value")).join(m, "_value", "left")
    order = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_new", "_value").alias("v"))))
    lists = entries.groupBy(*key).agg(F.array_distinct(F.transform(order, lambda x: x["v"])).alias("_list"), F.max(F.col("_new").isNotNull()).alias("_hit")).where("_hit")
    return df.join(lists.drop("_hit"), list(key), "left").withColumn(column, F.coalesce("_list", column)).select(*df.columns)


def merge_steps(references: list[Reference], mapping: DataFrame, records: str, key: str, rewrite: dict[str, Callable[[DataFrame, Read], DataFrame]] | None = None, canonical: Callable[[DataFrame], DataFrame] | None = None) -> list[Step]:
    """A step for each table that refers to the records, then the records themselves: `canonical` changes those that stay, the merged are retired last.

    rewrite: what a table needs besides, given its rows before its references follow.
    """

    def follows(r: Reference) -> Step:
        def build(read: Read) -> DataFrame:
            rows = read(r.table)
            columns = rows.columns
            if rewrite and r.table in rewrite:
                rows = rewrite[r.table](rows, read)
            rows = maintenance.repointed(rows, mapping, *r.scalars) if r.scalars else rows
            return reduce(lambda df, c: repointed_list(df, mapping, r.key, c), r.lists, rows).select(*columns)

        return Step(r.table, r.table, build)

    def retire(read: Read) -> DataFrame:
        rows = read(records)
        merged = (canonical(rows) if canonical else rows).join(mapping.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
        gone = F.col("_new").isNotNull()
        return merged.withColumns({"status": F.when(gone, "merged").otherwise(F.col("status")), "merged_into": F.when(gone, F.col("_new")).otherwise(F.col("merged_into"))}).select(*rows.columns)

    return [*map(follows, references), Step(records, records, retire)]


def works_at(mapping: DataFrame, organizations: str, key: str, name: str) -> Callable[[DataFrame, Read], DataFrame]:
    """The rewrite of facts that say where someone works: the value becomes the name of the organization that stays."""

    def build(facts: DataFrame, read: Read) -> DataFrame:
        to = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_to")).join(read(organizations).select(F.col(key).alias("_to"), F.col(name).alias("_name")), "_to")
        rows = facts.join(to, F.col("org_id") == F.col("_old"), "left")
        return rows.withColumn("current_value", F.when((F.col("predicate") == "works_at") & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("current_value"))).select(*facts.columns)

    return build


def absorbing(mapping: DataFrame, key: str, name: str, aliases: str, fill: list[str]) -> Callable[[DataFrame], DataFrame]:
    """What a record that stays takes from those merged into it, in order of key: their aliases and names after its own, and blanks of `fill`."""

    def build(rows: DataFrame) -> DataFrame:
        m = mapping.select(F.col("old").alias(key), F.col("new").alias("_to"))
        given = F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array(name))
        blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
        parts = rows.join(m, key).groupBy("_to").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), given.alias("g")))), lambda x: x["g"])).alias("_given"),
            *(F.min_by(c, F.when(~blank(c), F.col(key))).alias(f"_{c}") for c in fill),
        )
        out = rows.join(parts, F.col(key) == F.col("_to"), "left")
        taken = F.array_distinct(F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.col("_given")))
        return out.withColumns({aliases: F.when(F.col("_given").isNotNull(), taken).otherwise(F.col(aliases)), **{c: F.when(blank(c) & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in fill}}).select(*rows.columns)

    return build


def stray(references: list[Reference], mapping: DataFrame) -> Callable[[Read], list[str]]:
    """The check of a merge: tables that still refer to a merged record."""

    def check(read: Read) -> list[str]:
        gone = mapping.select(F.col("old").alias("v"))
        whole = lambda r: F.concat(*([F.array(*r.scalars)] if r.scalars else []), *(F.coalesce(c, F.array()) for c in r.lists))
        uses = [read(r.table).select(F.lit(r.table).alias("table"), F.explode(whole(r)).alias("v")) for r in references]
        return [r["table"] for r in reduce(DataFrame.unionByName, uses).join(gone, "v", "left_semi").select("table").distinct().orderBy("table").collect()]

    return check
