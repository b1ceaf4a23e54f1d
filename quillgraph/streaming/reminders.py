"""Reminders by timers: each open item is reminded of once, when it is due, over all restarts.

An item's state is its due time and status; its timer stands at the due time. Later rows of an item move the timer or, where it is no
longer open, remove it. When the timer fires, the item becomes reminded, and a reminded item is never reminded of again. State and
timers are in the checkpoint, so a stream that is stopped before an item is due fires it after its restart, and one that has fired does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in RocksDB only.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The trigger of one turn. A query with timers always has another batch to run, so `availableNow` would not end.
ONE_TURN = {"once": True}
OPEN, REMINDED = "open", "reminded"


class Reminders(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "due long, seq long, status string, description string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = now = self.item.get()
        if before is None or before[2] != REMINDED:  # a reminded item stays as it is
            for r in rows:
                if now is None or r.seq >= now[1]:  # else an older row than what is known
                    now = (r.due, r.seq, r.status, r.description)
        if now != before:
            self.item.update(now)
            old, new = self._due(before), self._due(now)
            if old is not None and old != new:
                self.handle.deleteTimer(old)
            if new is not None and old != new:
                self.handle.registerTimer(new)
        return iter(())

    @staticmethod
    def _due(item: tuple | None) -> int | None:
        """Where an item's only timer stands: each call of the state store is a turn between processes, so the timers are not listed."""
        return item[0] if item is not None and item[2] == OPEN else None

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due, seq, status, description = self.item.get()
        if status == OPEN:
            self.item.update((due, seq, REMINDED, description))
            yield Row(id=key[0], description=description, due=due)

    def close(self) -> None:
        pass


def reminded(items: DataFrame) -> DataFrame:
    """id, description, due_at of each item of the stream items(id, seq, status, due_at, description) when it is due.

    A missing status is open; an item without a due time, or with one that can't be read as a time, is never due.
    """
    due = F.unix_millis(F.col("due_at").try_cast("timestamp"))
    rows = items.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.coalesce("status", F.lit(OPEN)).alias("status"), due.alias("due"), F.coalesce("description", F.lit("")).alias("description"))
    out = rows.groupBy("id").transformWithState(Reminders(), "id string, description string, due long", "append", "processingTime")
    return out.select("id", "description", F.timestamp_millis("due").alias("due_at"))
