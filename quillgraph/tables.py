"""Tables written to the folder that driver and executors share, which cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the session's checkpoint folder. Only a local session without one gets its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again. A lost executor repeats its own tasks, not what came before."""
    spark = df.sparkSession
    df.write.parquet(path := shared_path(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n: int, *by: str, rows: int = 500_000) -> DataFrame:
    """df of n rows, dealt by key over partitions of about so many rows, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)), *by)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, *paths: str) -> None:
    """Folders that nothing reads any more; one that is not there is passed over."""
    for path in paths:
        files, at = _files(spark, path)
        files.delete(at, True)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """A folder under another name at once: a reader finds all of it or nothing."""
    files, at = _files(spark, old)
    _, to = _files(spark, new)
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{old} can't be renamed to {new}")


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; those before come back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file under a name that must be free: it is written beside it and renamed, so that it is there whole or not at all."""
    files, at = _files(spark, path)
    files.mkdirs(at.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(beside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(beside, False)
        raise FileExistsError(path) if "AlreadyExists" in str(e) else e


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; files that are still being written are left out."""
    files, at = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if not s.getPath().getName().endswith(".part")) if files.exists(at) else []
