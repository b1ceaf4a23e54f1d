"""Message exports as DataFrames, folder ledgers, and a live source behind Spark's data source interface."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MESSAGE = "id string, threadId string, subject string, sender string, toRecipients array<string>, ccRecipients array<string>, date string, labelIds array<string>, snippet string, plaintextBody string"
REQUIRED = ["id", "threadId", "subject", "sender", "date", "plaintextBody"]


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The messages of export files. A file whose top level has no `messages` list is an error."""
    whole = spark.read.text(path, wholetext=True)
    bad = whole.where(F.get_json_object("value", "$.messages").isNull() | ~F.trim(F.get_json_object("value", "$.messages")).startswith("["))
    if not bad.isEmpty():
        raise ValueError("an export must be an object with a list `messages`")
    return spark.read.schema(f"messages array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MESSAGE.split(', '))}>>").option("multiLine", True).json(path).select(F.inline("messages"))


def converted(raw: DataFrame) -> DataFrame:
    """Canonical records. A record with a null or empty required field is dropped; null recipients become an empty list."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull() & (F.col(c) != "")
    people = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(F.nullif(F.trim(F.regexp_extract(x, r"^([^<]*)<", 1)), F.lit("")).alias("name"), F.lower(F.coalesce(F.nullif(F.regexp_extract(x, r"<([^>]+)>", 1), F.lit("")), x)).alias("email"))), F.array().cast("array<struct<name: string, email: string>>"))
    return raw.where(ok).select(
        F.col("id").alias("source_message_id"), F.col("threadId").alias("source_thread_id"), people(F.array("sender"))[0].alias("from"), people("toRecipients").alias("to"), people("ccRecipients").alias("cc"),
        "subject", F.col("plaintextBody").alias("body"), F.col("date").try_cast("timestamp").alias("timestamp"),
    )


def counted(raw: DataFrame) -> DataFrame:
    """total and malformed records of an export."""
    bad = F.lit(False)
    for c in REQUIRED:
        bad = bad | F.col(c).isNull() | (F.col(c) == "")
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("malformed"))


def plain_json(column: str, field: str) -> Column:
    """A field of extended JSON as a scalar: `{"$oid": x}` and `{"$date": x}` give x."""
    at = lambda tail: F.get_json_object(column, f"$.{field}{tail}")
    return F.coalesce(at("['$oid']"), at("['$date']"), at(""))


_VALUE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|\{[^{}]*\}|[^,{}\[\]\s]+)'


def plain_document(document: Column) -> Column:
    """Extended JSON as plain JSON: `{"$oid": x}` and `{"$date": x}` are x at every depth, and `_id` is dropped.

    Quotes within a JSON string are escaped, so neither pattern begins inside of one. An `_id` is a scalar, wrapped or a flat object.
    """
    bare = F.regexp_replace(document, r'\{\s*"\$(?:oid|date)"\s*:\s*' + _VALUE + r"\s*\}", "$1")
    first = F.regexp_replace(bare, r'\{\s*"_id"\s*:\s*' + _VALUE + r"\s*,?\s*", "{")
    return F.regexp_replace(first, r'\s*,\s*"_id"\s*:\s*' + _VALUE + r"(?=\s*[,}])", "")


def recorded(ledger: DataFrame, files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger(path, fingerprint, all_completed) after files(path, fingerprint) were taken, from outcomes(path, n_failed) by message or file.

    A file without any outcome has no message that can be read: it is done, since it would never give more.
    """
    failed = outcomes.groupBy("path").agg(F.sum("n_failed").alias("n"))
    rows = files.join(failed, "path", "left").select("path", "fingerprint", (F.coalesce("n", F.lit(0)) == 0).alias("all_completed"))
    return ledger.join(files.select("path"), "path", "left_anti").select("path", "fingerprint", "all_completed").unionByName(rows)


def new_files(spark: SparkSession, folder: str, ledger: DataFrame) -> DataFrame:
    """(path, fingerprint) of files to take: not in ledger(path, fingerprint, all_completed), changed, or not completed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.sha2("content", 256).alias("fingerprint"))
    done = ledger.where("all_completed").select("path", "fingerprint")
    return files.join(done, ["path", "fingerprint"], "left_anti").orderBy("path")


class ClientSource(DataSource):
    """A live source: option `pages` is how many pages there are; `fetch` gives a page's rows as tuples of the MESSAGE columns."""

    fetch: Callable[[int], list[tuple]] | None = None

    @classmethod
    def name(cls) -> str:
        return "message_client"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> DataSourceReader:
        if type(self).fetch is None:
            raise ValueError("no client is set")
        return _ClientReader(int(self.options.get("pages", 1)), type(self).fetch)


class _ClientReader(DataSourceReader):
    def __init__(self, pages: int, fetch: Callable[[int], list[tuple]]):
        self.pages, self.fetch = pages, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)


def in_memory(spark: SparkSession, payloads: list[dict], limit: int | None = None) -> DataFrame:
    """Given messages as a raw table; fields that a message lacks are null."""
    names = [x.split(" ")[0] for x in MESSAGE.split(", ")]
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in payloads[:limit]], MESSAGE)


def demo_messages(seed: int, n: int = 9) -> list[dict]:
    """n messages of one thread between a lead and the operator, a day apart; the seed chooses their wording alone."""
    rng, subjects, asks = random.Random(seed), ["Pilot", "Pricing", "Rollout"], ["Could you send a proposal?", "We need 50 seats.", "Let's meet on Monday at 10:30."]
    subject = rng.choice(subjects)
    return [
        {
            "id": f"demo-{k}", "threadId": "demo-thread", "subject": subject if k == 0 else f"Re: {subject}", "sender": "Ann <ann@lead.example>" if k % 2 == 0 else "me@own.example",
            "toRecipients": ["me@own.example" if k % 2 == 0 else "ann@lead.example"], "date": (datetime(2024, 1, 1) + timedelta(days=k)).isoformat() + "Z", "plaintextBody": rng.choice(asks),
        }
        for k in range(n)
    ]
