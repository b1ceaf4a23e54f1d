"""Context of threads as state of a stream: lists that additions and removals fold into, in whatever order the deltas arrive.

Of each value of a field the state has the number of its last removal and the places of its additions since then. The list is the values
that were added since, in the order of their first such place; that is what folding the deltas one after the other gives. A delta that
comes again changes nothing. The state may start from a batch table of deltas that were folded before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "thread string, version long, field string, state array<string>"
DELTA = "thread string, seq long, field string, add array<string>, remove array<string>"


class Context(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "field string, value string", "gone long, places array<struct<seq: long, pos: int>>")
        self.version = handle.getValueState("version", "n long")

    def _fold(self, rows: Iterator[pd.DataFrame]) -> None:
        touched: dict[tuple[str, str], tuple[int | None, set[tuple[int, int]]]] = {}

        def known(k: tuple[str, str]) -> tuple[int | None, set[tuple[int, int]]]:
            if k not in touched:
                gone, places = self.values.getValue(k) if self.values.containsKey(k) else (None, [])
                touched[k] = (gone, {(p[0], p[1]) for p in places})
            return touched[k]

        for frame in rows:
            for r in frame.itertuples(index=False):
                for value in r.remove if r.remove is not None else ():
                    gone, places = known((r.field, value))
                    touched[r.field, value] = (int(r.seq) if gone is None else max(gone, int(r.seq)), places)
                for pos, value in enumerate(r.add if r.add is not None else ()):
                    known((r.field, value))[1].add((int(r.seq), pos))
        for k, (gone, places) in touched.items():
            self.values.updateValue(k, (gone, sorted(p for p in places if gone is None or p[0] >= gone)))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._fold(iter([initialState]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._fold(rows)
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        lists: dict[str, list[tuple[tuple[int, int], str]]] = {}
        for (field, value), (_, places) in self.values.iterator():
            if places:
                lists.setdefault(field, []).append((min((p[0], p[1]) for p in places), value))
            else:
                lists.setdefault(field, [])
        yield pd.DataFrame({"thread": [key[0]] * len(lists), "version": [n] * len(lists), "field": list(lists), "state": [[v for _, v in sorted(x)] for x in lists.values()]})

    def close(self) -> None:
        pass


def _deltas(df: DataFrame) -> DataFrame:
    strings = lambda c: F.col(c).cast("array<string>").alias(c)
    return df.select(F.col("thread").cast("string").alias("thread"), F.col("seq").cast("long").alias("seq"), "field", strings("add"), strings("remove"))


def folded(deltas: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """thread, version, field, state after each batch of the stream deltas(thread, seq, field, add, remove), for the threads it touched.

    initial: deltas that count as folded before the first batch. version: batches that touched the thread.
    """
    start = None if initial is None else _deltas(initial).groupBy("thread")
    return _deltas(deltas).groupBy("thread").transformWithStateInPandas(Context(), OUT, "update", "none", start)
