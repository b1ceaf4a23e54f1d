"""Versions, sequences, histories and running confidence, each over one ordered key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.tables import written


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key, by partial aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def numbered(df: DataFrame, key: str, out: str, *order: str) -> DataFrame:
    """Gap-free numbers from 1 within each key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def sequenced(df: DataFrame, event: list[str], key: str, out: str, *order: str) -> DataFrame:
    """numbered() over the first row of each distinct event, so that a replay changes nothing."""
    once = df.groupBy(*event).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return numbered(once, key, out, *order)


def places(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """Global places 0, 1, ... in order: ranges of the order are written and counted, then each row adds its place to its range's start.

    No window over the whole table: only one count a range comes to the driver. The ranges are written once, so that they are the same
    when they are counted and when they are read.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    ranged = written(ranged, "places")
    sizes = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if not starts:
        return df.withColumn(out, F.lit(None).cast("long"))
    at = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("_p"))
    return ranged.withColumn(out, at + F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_k")


def ids(df: DataFrame, prefix: str, out: str, *order: str) -> DataFrame:
    """Global ids PREFIX-001, ... in order."""
    return places(df, "_place", *order).withColumn(out, F.format_string(f"{prefix}-%03d", F.col("_place") + 1)).drop("_place")


def preceding(key: str, order: str, value: Column, n: int = 20) -> Column:
    """The n values before each row within its key, oldest first."""
    return F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1))


def changes(df: DataFrame, key: list[str], value: Column, *order: str) -> DataFrame:
    """Rows whose value differs from the row before in their key, with the value before (null at the first)."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumns({"value": value, "previous": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return rows.where((F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("previous"))).drop("_n")


def confidence(key: list[str], *order: str) -> Column:
    """0.75 and 0.01 more for each confirmation, at most 0.99."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return F.round(F.least(F.lit(0.99), F.lit(0.75) + F.lit(0.01) * (n - 1)), 2)


def list_diff(df: DataFrame, key: str, items: str, *order: str) -> DataFrame:
    """added and removed items against the version before."""
    before = F.coalesce(F.lag(items).over(Window.partitionBy(key).orderBy(*order)), F.array().cast(df.schema[items].dataType))
    return df.withColumn("_b", before).withColumns({"added": F.array_except(items, "_b"), "removed": F.array_except("_b", items)}).drop("_b")


def first_known(value: str, order: str) -> Column:
    """The earliest value that is not null: later ones never overwrite it."""
    return F.expr(f"min_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)")


def distinct_in_order(value: str, order: str) -> Column:
    """Distinct values in the order of their first row."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]))


def intervals(changes: DataFrame, key: str, at: str, value: Column, *order: str, ended: Column | None = None) -> DataFrame:
    """(key, value, valid_from, valid_to) from changes of value at times: valid_to is the next change's time, null where it still holds.

    Of the changes of one key and time the last in `order` counts; changes without a key or time are left out. A change to the same value
    starts nothing; `ended` ends what held. Times of one key are brought together first, so a busy key costs what its times cost.
    """
    now = F.when(~F.coalesce(ended, F.lit(False)), value) if ended is not None else value
    last = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.col(at).alias("valid_from")).agg(F.max_by(F.struct(now.alias("value")), F.struct(*order)).alias("r"))
    w = Window.partitionBy(key).orderBy("valid_from")
    rows = last.select(key, "valid_from", F.col("r.value").alias("value")).withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("value").over(w))
    starts = rows.where((F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("_before")))
    return starts.withColumn("valid_to", F.lead("valid_from").over(w)).where("value is not null").select(key, "value", "valid_from", "valid_to")


def valid_when(rows: DataFrame, held: DataFrame, key: str, at: str) -> DataFrame:
    """rows with value, valid_from and valid_to of the interval of their key that holds at their time; rows without one are left out.

    Intervals are listed by the days that they touch, up to the last day of the rows, and key and day make the join: a busy key's rows
    meet the few intervals of their day, and Spark can split them.
    """
    last = rows.agg(F.max(F.to_date(at)).alias("d")).first()["d"]
    if last is None:
        return rows.join(held, key).limit(0)
    until = F.least(F.to_date(F.coalesce("valid_to", F.lit(last))), F.lit(last))
    days = held.where(F.to_date("valid_from") <= F.lit(last)).withColumn("_day", F.explode(F.sequence(F.to_date("valid_from"), F.greatest(until, F.to_date("valid_from")))))
    joined = rows.withColumn("_day", F.to_date(at)).join(days, [key, "_day"])
    return joined.where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))).drop("_day")
