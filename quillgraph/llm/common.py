"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.tables import shared_path, written

__all__ = ["BATCH_BYTES", "SPACE", "SPACE_RE", "crc_of_id", "replaced", "shared_path", "small_batches", "table", "written"]

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def replaced(c: Column, letters: str) -> Column:
    """c without the given characters."""
    return F.translate(c, letters, "")


#: Bytes of an Arrow batch on its way to Python: with the default of 64 MB, batches of long texts fill the workers.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Arrow batches of at most BATCH_BYTES (or a single row) from now on, unless it already sends smaller ones."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df
