"""Stored tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join with at most so many bytes, as counted, is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share (spark.checkpoint.dir). Where Spark runs on one machine, as in tests, and the
    setting is absent: under the warehouse; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(schema: T.StructType) -> Column:
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in schema if not isinstance(f.dataType, fixed)]
    return sum(wide, F.lit(48 + 8 * len(schema)).cast("long"))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return (df.agg(F.sum(_bytes(df.schema))).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted bytes allow it."""
    return F.broadcast(df) if is_small(df, limit) else df
