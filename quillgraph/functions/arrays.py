"""Merges of lists, records and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_list(existing: Column, added: Column, removed: Column) -> Column:
    """Existing without what is removed, then what is new, in order, each once."""
    empty = F.array().cast("array<string>")
    have, add, drop = (F.coalesce(x, empty) for x in (existing, added, removed))
    return F.array_distinct(F.concat(F.array_except(have, drop), add))


def merged_records(existing: Column, added: Column, removed_values: Column, key: str = "value") -> Column:
    """Records by their value: removed ones go, those with a new value are appended."""
    kept = F.filter(existing, lambda x: ~F.array_contains(F.coalesce(removed_values, F.array().cast("array<string>")), x[key]))
    return F.concat(kept, F.filter(added, lambda x: ~F.exists(kept, lambda y: y[key] == x[key])))


def merged_map(old: Column, new: Column) -> Column:
    """The new entries over the old; a null value deletes its key. Needs the LAST_WIN map policy of session()."""
    return F.map_filter(F.map_concat(old, new), lambda _, v: v.isNotNull())


def repointed(c: Column, old: Column, new: Column) -> Column:
    """The list with old replaced by new, each id once."""
    return F.array_distinct(F.transform(c, lambda x: F.when(x == old, new).otherwise(x)))


def first_or_null(c: Column) -> Column:
    return F.get(c, F.lit(0))


def as_list(c: Column) -> Column:
    """A scalar reference as a list; null as the empty one."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def changed_fields(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """map field -> struct(old, new) of the fields whose value changed, nulls compared as values."""
    rows = [F.struct(F.lit(k).alias("field"), F.struct(old[k].cast("string").alias("old"), new[k].cast("string").alias("new")).alias("values")) for k in new]
    return F.map_from_entries(F.filter(F.array(*rows), lambda x: ~x["values"].old.eqNullSafe(x["values"].new)))


def set_hash(c: Column) -> Column:
    """16 hex digits of the SHA-256 of the sorted strings as a JSON list."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")), 256), 1, 16)
