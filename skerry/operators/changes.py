"""Snapshots and changes, and tables of repositories and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_hash(files: DataFrame, text_col: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def detect_changes(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(path, change_type): added and deleted by path, modified by hash."""
    o, n = old.select(key, F.col("hash").alias("_o")), new.select(key, F.col("hash").alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "modified")
    return o.join(n, key, "full").select(key, kind.alias("change_type")).where("change_type is not null")


def needs_reindex(files: DataFrame, state: DataFrame, key: str = "path") -> DataFrame:
    """files with needs_reindex: absent from the state or of another hash."""
    return files.join(state.select(key, F.col("hash").alias("_o")), key, "left").withColumn("needs_reindex", ~F.col("hash").eqNullSafe(F.col("_o"))).drop("_o")


def snapshot(files: DataFrame) -> DataFrame:
    """files (path, content, mtime, size): (path, hash, mtime, size); mtime in seconds since 1970."""
    return with_hash(files).select("path", "hash", F.unix_timestamp("mtime").alias("mtime"), "size")


def incremental_scan(files: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The changes since the state (all added without one), and the new state."""
    new = snapshot(files)
    old = new.limit(0) if state is None else state
    return detect_changes(old, new), new


def add_rows(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows of unknown ids, and the rejected rows: those without an id, of a known id, and repeats of a
    new one (of equal ids the least row by its fields as JSON stays)."""
    known = table.select(key).distinct()
    fresh = new.where(F.col(key).isNotNull()).join(known, key, "left_anti")
    order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*new.columns)))
    ranked = fresh.withColumn("_n", F.row_number().over(order))
    rejected = new.where(F.col(key).isNull()).unionByName(new.join(known, key, "left_semi")).unionByName(ranked.where("_n > 1").drop("_n").select(*new.columns))
    return table.unionByName(ranked.where("_n = 1").drop("_n").select(*new.columns), allowMissingColumns=True), rejected


def update_rows(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Non-null fields of the updates win; of several updates of one id the greatest values. Unknown ids: see unknown_updates."""
    fields = [c for c in updates.columns if c != key]
    renamed = updates.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"_u_{c}") for c in fields])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def unknown_updates(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The updates that no row of the table takes: of unknown ids, or of none."""
    return updates.join(table.select(key).distinct(), key, "left_anti")


def remove_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def counts_by(table: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for each column, and the total: one pass by grouping sets."""
    sets = table.groupingSets([[], *[[F.col(c)] for c in columns]], *[F.col(c) for c in columns])
    rows = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    top = (1 << len(columns)) - 1
    field = F.when(F.col("_g") == top, "total")
    for i, c in enumerate(columns):
        field = F.when(F.col("_g") == top - (1 << (len(columns) - 1 - i)), c).otherwise(field)
    return rows.select(field.alias("field"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")


def merge_computed(contexts: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Maps `fields` merged by id: new values win, unknown ids are created."""
    c = computed.select(key, F.col("fields").alias("_new"))
    both = contexts.join(c, key, "full")
    return both.select(key, F.when(F.col("fields").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter("fields", lambda k, v: ~F.array_contains(F.map_keys("_new"), k)), "_new")).alias("fields"))


def commit_activity(commits: DataFrame, today, days: int = 30) -> DataFrame:
    """commits (repo, sha, message, ts): the last commit of each repo and how many are newer than so many days."""
    newest = F.max_by(F.struct(F.substring("sha", 1, 8).alias("sha"), "message", "ts"), F.struct("ts", "sha")).alias("l")
    out = commits.groupBy("repo").agg(newest, F.count_if(F.col("ts") >= F.date_sub(today, days)).alias("commits_30d"))
    return out.select("repo", "l.sha", "l.message", "l.ts", "commits_30d")
