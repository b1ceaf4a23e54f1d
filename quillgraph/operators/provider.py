"""Providers called where the rows are: in batches on the executors, with one retry, an error column, and no row lost.

A provider takes a list of texts and gives a list of outputs. A batch whose call fails, and rows whose output is not valid, are tried
once more, row by row, so that one row can't fail another; what fails again keeps its row, with null outputs and the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Analyze = Callable[[list[str | None]], list[dict]]


def _fault(output: object, schema: pa.Schema, valid: Callable[[dict], bool] | None) -> str | None:
    """Why an output can't be taken; None if it can."""
    if not isinstance(output, dict):
        return f"not a record: {type(output).__name__}"
    if missing := [f.name for f in schema if f.name not in output]:
        return "missing: " + ", ".join(missing)
    try:
        for f in schema:
            pa.array([output[f.name]], f.type)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
        return f"wrong type: {str(e).splitlines()[0]}"
    return None if valid is None or valid(output) else "not valid"


def analyzed(texts: list[str | None], call: Analyze, schema: pa.Schema, valid: Callable[[dict], bool] | None = None) -> list[tuple[dict, str | None]]:
    """(output, error) of each text, after one retry."""

    def tried(some: list[str | None]) -> list[tuple[dict, str | None]]:
        try:
            out = call(some)
            if len(out) != len(some):
                raise ValueError(f"{len(out)} outputs for {len(some)} texts")
        except Exception as e:  # the provider's own; each row says so
            return [({}, f"{type(e).__name__}: {e}")] * len(some)
        return [(o, None) if (f := _fault(o, schema, valid)) is None else ({}, f) for o in out]

    found = tried(texts)
    return [tried([t])[0] if error else (output, None) for t, (output, error) in zip(texts, found, strict=True)]


def provided(rows: DataFrame, column: str, make: Callable[[], Analyze], outputs: str, valid: Callable[[dict], bool] | None = None, size: int = 64) -> DataFrame:
    """rows with the provider's output columns and `error`. make() is called once a task; outputs: DDL of what it gives; size: texts a call."""
    schema = to_arrow_schema(StructType.fromDDL(outputs))
    if clash := {*schema.names, "error"} & set(rows.columns):
        raise ValueError(f"columns there already: {', '.join(sorted(clash))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                found = analyzed(part.column(column).to_pylist(), call, schema, valid)
                added = [pa.array([o.get(f.name) for o, _ in found], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([*part.columns, *added, pa.array([e for _, e in found], pa.string())], names=[*part.schema.names, *schema.names, "error"])

    out = StructType([*rows.schema.fields, *StructType.fromDDL(outputs).fields]).add("error", "string")
    return rows.mapInArrow(run, out)
