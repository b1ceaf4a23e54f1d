"""An exactly-once sink keyed by message, and the poll loop that feeds it.

What a batch completes is written beside what is there and becomes visible with its ids by one commit file; a batch first drops the ids
that are completed already. So it does not matter how rows are cut into batches, how often a batch comes again or whether it
died before or after its commit: each message is completed once. Rows that fail are kept as failures, not as completed; they are
tried again whenever they come again. The ids are dealt into BUCKETS folders, and a small batch reads only the folders of its own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.streaming.ingest import FAILED, STAGES
from quillgraph.tables import get_text, listed, put_new, written

BUCKETS = 64
#: A commit file names all folders; after so many commits they are written together into one.
MOST_FOLDERS = 32
COMPLETED = STAGES[-1]


class Sink:
    """Messages by key under a folder. process: rows with a column `error`, null where the row went well; extra columns are kept."""

    def __init__(self, spark: SparkSession, root: str, key: str, process: Callable[[DataFrame], DataFrame], first: Column | None = None):
        self.spark, self.root, self.key, self.process = spark, root.rstrip("/"), key, process
        self.first = first  # which of a batch's rows of one key counts; any, where they are equal

    def _commits(self) -> list[str]:
        return listed(self.spark, f"{self.root}/commits")

    def _now(self) -> tuple[int, list[str]]:
        """The number of the last commit and its folders."""
        names = self._commits()
        return (int(names[-1].removesuffix(".json")), json.loads(get_text(self.spark, f"{self.root}/commits/{names[-1]}"))["folders"]) if names else (-1, [])

    def _read(self, what: str, folders: list[str], schema: StructType | str | None = None) -> DataFrame | None:
        if not folders:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reduce(DataFrame.unionByName, (reader.option("basePath", f"{self.root}/{what}/{f}").parquet(f"{self.root}/{what}/{f}") for f in folders))

    def completed(self) -> DataFrame | None:
        """All completed rows; None before the first commit."""
        return self._read("rows", self._now()[1])

    def failures(self) -> DataFrame | None:
        """Failed rows that no later try has completed, one row a key and error."""
        _, folders = self._now()
        failed, ids = self._read("failed", folders), self._read("ids", folders)
        return None if failed is None else failed.join(ids.select(self.key), self.key, "left_anti").dropDuplicates([self.key, "error"])

    def put(self, rows: DataFrame, batch: int = -1) -> None:
        """Complete what is new in the rows. Another writer's commit in between makes it look again."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        one = rows.groupBy(self.key).agg((F.min_by if self.first is not None else lambda c, _: F.any_value(c))(F.struct(*rows.columns), self.first).alias("r")).select("r.*")
        one = written(one, "batch")  # the stream's rows are read once
        while True:
            number, folders = self._now()
            ids, fresh = self._read("ids", folders), one
            if ids is not None:
                own = [r[0] for r in one.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
                fresh = one.join(ids.where(F.col("bucket").isin(own)).select(self.key), self.key, "left_anti")
            name = uuid.uuid4().hex
            done = written(self.process(fresh).withColumn("stage", F.when(F.col("error").isNull(), COMPLETED).otherwise(FAILED)), "processed")
            good = done.where(F.col("error").isNull())
            good.drop("error").write.parquet(f"{self.root}/rows/{name}")
            good.select(self.key, bucket.alias("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/ids/{name}") if not good.isEmpty() else good.select(self.key, bucket.alias("bucket")).write.parquet(f"{self.root}/ids/{name}")
            done.where(F.col("error").isNotNull()).write.parquet(f"{self.root}/failed/{name}")
            after = self._compacted([*folders, name]) if len(folders) >= MOST_FOLDERS else [*folders, name]
            try:
                put_new(self.spark, f"{self.root}/commits/{number + 1:010d}.json", json.dumps({"folders": after, "batch": batch}))
                return
            except FileExistsError:
                continue

    def _compacted(self, folders: list[str]) -> list[str]:
        name = uuid.uuid4().hex
        self._read("rows", folders).write.parquet(f"{self.root}/rows/{name}")
        self._read("ids", folders).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/ids/{name}")
        self._read("failed", folders).write.parquet(f"{self.root}/failed/{name}")
        return [name]


@dataclass
class Cycle:
    """What one turn of the poll loop did: the last commit's number, or the fault that ended it."""

    commit: int
    fault: str | None = None


def poll(sink: Sink, stream: Callable[[], DataFrame], checkpoint: str, cycles: int | None = None, pause: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> list[Cycle]:
    """Drain the stream into the sink, again and again (cycles None: for ever), one turn after the other.

    A turn that fails is noted and the next goes on from the checkpoint; nothing of it is lost or doubled.
    """
    out: list[Cycle] = []
    while cycles is None or len(out) < cycles:
        fault = None
        try:
            query = stream().writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink.put).start()
            query.awaitTermination()
        except Exception as e:  # whatever ended the turn: the next one tries again
            fault = str(e).splitlines()[0][:300]
        out.append(Cycle(sink._now()[0], fault))
        if cycles is None:
            del out[:-1]
        if cycles is None or len(out) < cycles:
            sleep(pause)
    return out
