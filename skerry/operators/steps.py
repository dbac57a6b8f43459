"""Custom row steps with an error policy. A step is a Python function of one row (a dict) that gives a row or fails; batches
of rows go through Arrow."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def apply_step(rows: DataFrame, step: Callable[[dict], dict | None], schema: str | T.StructType, on_error: str = "skip") -> DataFrame:
    """The rows that step makes; None drops a row. Nulls reach the step as None, whole numbers as int. A failed row is dropped (skip), fails the job (raise), or is kept (collect):
    then all rows have the columns `error` (null if fine) and `item`, the failed row as JSON."""
    if on_error not in ("skip", "raise", "collect"):
        raise ValueError(on_error)
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema))
    fields = [f.name for f in out]
    if on_error == "collect":
        out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out] + [T.StructField("error", T.StringType()), T.StructField("item", T.StringType())])
        rows = rows.withColumn("_item", F.to_json(F.struct(*rows.columns)))

    kinds = to_arrow_schema(out)

    def run(parts):
        for part in parts:
            made = []
            for row in part.to_pylist():
                item = row.pop("_item", None)
                try:
                    new = step(row)
                    if new is not None:
                        made.append({**new, "error": None, "item": None})
                except Exception as failure:  # noqa: BLE001
                    if on_error == "raise":
                        raise
                    if on_error == "collect":
                        made.append({**dict.fromkeys(fields), "error": f"{type(failure).__name__}: {failure}", "item": item})
            yield pa.RecordBatch.from_pylist(made, kinds)

    return rows.mapInArrow(run, out)


def map_reduce(rows: DataFrame, mapper: Callable[[dict], dict | None], schema: str, keys: list[str], reducers: dict, on_error: str = "skip") -> DataFrame:
    """Mapped rows, reduced by key with column aggregates (name: column); without keys to one row."""
    mapped = apply_step(rows, mapper, schema, on_error)
    return mapped.groupBy(*keys).agg(*[c.alias(n) for n, c in reducers.items()])
