"""A store of Markdown notes as an edge table, and the incremental sink that writes it.

A note is one file: `# label`, then sections `## KIND` with lines `- [[id]] text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label, kind, target, text): one row a link; the id is the file's name. A note without a link has none."""
    return links(spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("id"), F.col("value").alias("content")))


def links(notes: DataFrame) -> DataFrame:
    """(id, label, kind, target, text) of notes(id, content)."""
    label = F.regexp_extract("content", r"(?m)^# (.*)$", 1)
    parts = notes.select("id", label.alias("label"), F.posexplode(F.split("content", r"(?m)^## ")).alias("n", "part")).where("n > 0")
    kind = F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))
    lines = parts.select("id", "label", kind.alias("kind"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^- \[\[([^\]]+)\]\].*$"), 0)).alias("line"))
    return lines.select("id", "label", "kind", F.regexp_extract("line", r"\[\[([^\]]+)\]\]", 1).alias("target"), F.trim(F.regexp_extract("line", r"\]\](.*)$", 1)).alias("text"))


def rendered(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id, content): the note of each id of names(id, label) from edges(label, a, b), kinds and targets in order."""
    lines = edges.groupBy(F.col("a").alias("id"), F.col("label").alias("kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("b")), lambda b: F.concat(F.lit("- [["), b, F.lit("]]\n"))), "").alias("lines"))
    body = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "lines"))), lambda x: F.concat(F.lit("## "), x.kind, F.lit("\n"), x.lines)), "").alias("body"))
    return names.join(body, "id", "left").select("id", F.concat(F.lit("# "), "label", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("content"))


def to_write(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, content, change) of notes whose bytes differ from old(id, content): created or updated."""
    before = old.select("id", F.sha2("content", 256).alias("was"))
    change: Column = F.when(F.col("was").isNull(), "created").when(F.col("was") != F.sha2("content", 256), "updated")
    return new.join(before, "id", "left").withColumn("change", change).where("change is not null").drop("was")
