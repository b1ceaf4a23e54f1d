"""Bounded retrieval: equality filters, half-open date ranges, stable order, clamped limits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.dates import in_range

QUERY_CAP, TOOL_CAP = 200, 500


def clamp(limit: int, cap: int = QUERY_CAP) -> int:
    return max(1, min(limit, cap))


def matching(df: DataFrame, **equal: Any) -> DataFrame:
    """Rows equal to every argument that is given; None and "" are not asked for."""
    asked = [F.col(k) == v for k, v in equal.items() if v is not None and v != ""]
    return df.where(reduce(lambda a, b: a & b, asked)) if asked else df


def among(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """Rows whose column is one of the values; no row for no value."""
    values = list(values)
    return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))


def containing(column: str, text: str) -> Column:
    """Literal substring, whatever its case."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def active(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("active")) == "active"


def latest_first(kind: str) -> bool:
    return kind in ("latest", "recent", "overdue")


def retrieved(df: DataFrame, date: Column, key: str, kind: str, bounds: tuple[datetime | None, datetime | None], limit: int = 50, descending: bool | None = None, cap: int = QUERY_CAP) -> DataFrame:
    """Rows in the range, by date (missing dates last when descending, first otherwise), then by key; `latest` is the first alone."""
    down = latest_first(kind) if descending is None else descending
    order = date.desc_nulls_last() if down else date.asc_nulls_first()
    n = 1 if kind == "latest" else clamp(limit, cap)
    return df.where(in_range(date, kind, bounds)).orderBy(order, F.col(key).asc()).limit(n)


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """A page; the last key of the order must be unique."""
    return df.orderBy(*order).offset(skip).limit(limit)


def preview(column: str, n: int = 150) -> Column:
    return F.substring(F.col(column), 1, n)


def columns_first(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *(c for c in df.columns if c not in first))


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """The rows of the first tier that has any, tagged by `tier`. Every tier is scanned once."""
    whole = reduce(DataFrame.unionByName, (t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers)))
    least = whole.agg(F.min("tier").alias("tier"))
    return whole.join(F.broadcast(least), "tier")  # one row


def evidence(df: DataFrame, kind: str, key: str, summary: list[str], date: str, **ids: Column) -> DataFrame:
    """One record a row: kind, id, date, ids and the summary fields that are present."""
    fields = F.map_filter(F.create_map(*[x for c in summary for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    return df.select(F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("record_id"), F.col(date).alias("at"), fields.alias("summary"), *(c.alias(n) for n, c in ids.items()))


def listed(df: DataFrame, key: str, limit: int = 50, **equal: Any) -> DataFrame:
    """A list tool: rows equal to the arguments that are given, in order of key, the limit clamped to the tools' cap."""
    return matching(df, **equal).orderBy(key).limit(clamp(limit, TOOL_CAP))


def tagged_counts(parts: dict[str, DataFrame], by: str, key: str, basis: str) -> DataFrame:
    """by, category, basis, n, first_id over the parts' rows; each part is counted before the union."""
    counted = [d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).select(by, F.lit(name).alias("category"), F.lit(basis).alias("basis"), "n", "first_id") for name, d in parts.items()]
    return reduce(DataFrame.unionByName, counted)
