"""Micro-batches of messages: idempotent ingest, row-level failure isolation, stages, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The stages of a record, in order; FAILED stands outside the order.
STAGES = ["RECEIVED", "VALIDATED", "THREADED", "ANALYZED", "CONTEXT_BUILT", "KNOWLEDGE_PROCESSED", "ENTITIES_PROCESSED", "REPLY_PROCESSED", "MEETING_PROCESSED", "COMPLETED"]
FAILED = "FAILED"


def source(spark: SparkSession, folder: str, schema, files_a_batch: int = 50) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    """Each key once over the life of the query, whatever is replayed."""
    return stream.dropDuplicates([key])


def split_failures(df: DataFrame, valid) -> DataFrame:
    """Columns stage and error: a bad row fails alone."""
    return df.withColumns({"stage": F.when(valid, STAGES[1]).otherwise(FAILED), "error": F.when(~valid, "validation")})


def run_once(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there, batch by batch; a batch is committed after process returns, so a failed one comes again."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(process).start()
    query.awaitTermination()


def put_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Write a batch under its number, in place of what an earlier try or replay left there."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def thread_state(stream: DataFrame, key: str, time: str) -> DataFrame:
    """(key, n, last_at): messages of each thread so far and the latest time, which never goes back. Late rows are counted too."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, pd.Timestamp.min.value // 1000)
        for rows in frames:
            n += len(rows)
            last = max(last, int(rows["micros"].max()))
        state.update((n, last))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "last_micros": [last]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    out = rows.groupBy("key").applyInPandasWithState(update, "key string, n long, last_micros long", "n long, last long", "update", GroupStateTimeout.NoTimeout)
    return out.select("key", "n", F.timestamp_micros("last_micros").alias("last_at"))


def advanced(df: DataFrame, ready) -> DataFrame:
    """Rows that are ready go to the next stage; FAILED and the last stage go nowhere."""
    after = F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGES[1:], strict=False) for x in pair])
    return df.withColumn("stage", F.when(ready, F.coalesce(F.try_element_at(after, F.col("stage")), F.col("stage"))).otherwise(F.col("stage")))
