"""The corpus pipeline: language ID, quality rules, near-dedup, packing.

Each stage gets what the stage before it kept, written as Parquet and read again. The last gives one row for each piece of a packed
sequence, with its token ids. Nulls, ties, repeated rows and other columns are treated as each stage's module says; an empty table
gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import langid, neardup, packing, quality
from quillgraph.llm.common import table, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", lambda spark, docs, sf_dir: langid.accepted(docs)),
    ("quality_rules", lambda spark, docs, sf_dir: quality.accepted(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: neardup.deduplicated(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.packed(docs)),
]

#: Language profiles, sketches and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
