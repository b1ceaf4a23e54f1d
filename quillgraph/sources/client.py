"""A live client as a stream with offsets, and a sink that publishes all of a write or nothing.

The mail client has `latest()`, how many messages it has had, and `fetch(first, end)`, their rows; `done(end)`, if it has one, hears what
was processed. An offset is a number of messages, so a stream that is started again goes on where its checkpoint ends, whatever was fetched before.

The calendar client has `stage(rows)`, which puts rows where nobody sees them and gives a handle, `publish(handles, batch)` and `discard(handles)`.
Each task stages its own; only when all have ended are the handles published, once a batch. A write that fails discards what was staged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceStreamReader):
    def __init__(self, client: Any, page: int, most: int | None):
        self.client, self.page, self.most, self.seen = client, page, most, None

    def initialOffset(self) -> dict:
        return {"messages": 0}

    def latestOffset(self) -> dict:
        now = self.client.latest()
        if self.most is not None:  # a batch takes so many at most
            self.seen = min(now, (self.seen or 0) + self.most)
            return {"messages": self.seen}
        return {"messages": now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["messages"], end["messages"]
        self.seen = b
        return [_Range(k, min(k + self.page, b)) for k in range(a, b, self.page)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.client.fetch(partition.first, partition.end)

    def commit(self, end: dict) -> None:
        if hasattr(self.client, "done"):
            self.client.done(end["messages"])


def stream_source(label: str, client: Any, ddl: str, page: int = 100, most: int | None = None) -> type[DataSource]:
    """A source of that name for spark.dataSource.register, which reads the client's messages page by page."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ddl

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(client, page, most)

    return Source


@dataclass
class _Staged(WriterCommitMessage):
    handle: Any


class _Writer(DataSourceWriter):
    def __init__(self, client: Any):
        self.client = client

    def write(self, iterator: Iterator) -> _Staged:
        return _Staged(self.client.stage([tuple(r) for r in iterator]))

    def commit(self, messages: list[_Staged | None]) -> None:
        self.client.publish([m.handle for m in messages if m], None)

    def abort(self, messages: list[_Staged | None]) -> None:
        self.client.discard([m.handle for m in messages if m])


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, client: Any):
        self.client = client

    def write(self, iterator: Iterator) -> _Staged:
        return _Staged(self.client.stage([tuple(r) for r in iterator]))

    def commit(self, messages: list[_Staged | None], batchId: int) -> None:
        self.client.publish([m.handle for m in messages if m], batchId)

    def abort(self, messages: list[_Staged | None], batchId: int) -> None:
        self.client.discard([m.handle for m in messages if m])


def sink(label: str, client: Any) -> type[DataSource]:
    """A sink of that name for batch writes and streams."""

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(client)

        def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
            return _StreamWriter(client)

    return Sink
