"""Shared plumbing of the training-data operators: tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join with at most so many bytes, as counted, is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes in a broadcast besides its values.
ROW_BYTES = 48


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where the setting is absent: an own one if Spark runs on this
    machine only, as in tests, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def unused(columns: list[str], *names: str) -> list[str]:
    """names, all with so many underscores before them that none is (in any case) among the columns."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in a broadcast: 8 for each number, the length of texts, arrays by their text form."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(f.name))) for f in schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))]
    fixed = F.lit(ROW_BYTES + 8 * len(schema)).cast("long")
    return sum((F.coalesce(w, F.lit(0)) for w in wide), fixed)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast when its counted bytes allow it. df should be a stored table, so that counting is cheap."""
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return (df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0) <= limit


def text_crc(column: str | Column) -> Column:
    """crc32 of a value written as text; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit("")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
