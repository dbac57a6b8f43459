"""Tables of repositories (id, name, path, language, type, status, remote_url, tags, created_at, updated_at) and of
relationships (type, from, to, auto_detected, details)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes

REPO = "id string, name string, path string, language string, type string, status string, remote_url string, tags array<string>, created_at timestamp, updated_at timestamp"
RELATION = "type string, from string, to string, auto_detected boolean, details map<string,string>"
#: Types of relationships.
RELATION_TYPES = ("depends_on", "port_of", "evolved_from", "related_to", "forked_from", "supersedes", "alternative_to", "contains")


def read_repos(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The registry from Parquet, or from JSON if the path ends so; missing status, name and tags get their defaults."""
    rows = spark.read.schema(REPO).json(path) if path.endswith(".json") else spark.read.schema(REPO).parquet(path)
    rows = with_defaults(rows)
    return rows if limit is None else rows.limit(limit)


def read_relations(spark: SparkSession, path: str, type_: str | None = None) -> DataFrame:
    rows = spark.read.schema(RELATION).json(path) if path.endswith(".json") else spark.read.schema(RELATION).parquet(path)
    return rows if type_ is None else rows.where(F.col("type") == type_)


def with_defaults(repos: DataFrame) -> DataFrame:
    return repos.withColumns({"status": F.coalesce("status", F.lit("active")), "name": F.coalesce("name", "id"), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def filtered(repos: DataFrame, **fields: str | None) -> DataFrame:
    """Rows equal in all given fields; None asks nothing."""
    for name, value in fields.items():
        repos = repos if value is None else repos.where(F.col(name) == value)
    return repos


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """For each asked id its row, and found."""
    return ids.select(key).distinct().join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def relations_of(relations: DataFrame, ids: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, type, from, to) of relationships at either end of each id; one between an id and itself comes once."""
    rows = relations if types is None else relations.where(F.col("type").isin(*types))
    ends = rows.select(F.explode(F.array_distinct(F.array("from", "to"))).alias("id"), "type", "from", "to")
    return ends.join(ids.select("id").distinct(), "id", "left_semi")


def add_relations(relations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the new rows of known types, and the rejected rows."""
    fine = F.coalesce(F.col("type").isin(*RELATION_TYPES), F.lit(False)) & F.col("from").isNotNull() & F.col("to").isNotNull()
    return relations.unionByName(new.where(fine), allowMissingColumns=True), new.where(~fine)


def remove_relations(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without all rows of the pairs (from, to)."""
    return relations.join(pairs.select("from", "to").distinct(), ["from", "to"], "left_anti").select(*relations.columns)


def by_language(repos: DataFrame) -> DataFrame:
    """(language, n, names): repositories of each language, by name."""
    return with_defaults(repos).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def stale(repos: DataFrame) -> DataFrame:
    """(id, name, status) of stale and blocked repositories."""
    return with_defaults(repos).where("status in ('stale', 'blocked')").select("id", "name", "status")


def sync(repos: DataFrame, commits: DataFrame, deps: DataFrame, contexts: DataFrame, today: Column, **wanted: str | None) -> tuple[DataFrame, DataFrame]:
    """Computed fields of the wanted repositories merged into contexts (id, fields map), and one row synced, failed, total.

    Fields: last_commit and commit_count_30d from commits (repo, sha, message, ts), runtime and dev from deps (repo, dep, scope).
    A repository without commits counts as failed; total is that of all repositories.
    """
    chosen = filtered(repos, **wanted).select("id")
    activity = changes.commit_activity(commits, today).withColumnRenamed("repo", "id")
    names = lambda scope: F.array_join(F.array_sort(F.collect_set(F.when(F.col("scope") == scope, F.col("dep")))), ",")
    listed = deps.groupBy(F.col("repo").alias("id")).agg(names("runtime").alias("runtime"), names("dev").alias("dev"))
    rows = chosen.join(activity, "id", "left").join(listed, "id", "left")
    entry = lambda n, c: F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")))
    fields = F.map_from_entries(F.array_compact(F.array(entry("last_commit", F.col("sha")), entry("commit_count_30d", F.col("commits_30d")), entry("runtime", F.col("runtime")), entry("dev", F.col("dev")))))
    fine = rows.where("sha is not null")
    merged = changes.merge_computed(contexts, fine.select("id", fields.alias("fields")), "id")
    counts = rows.agg(F.count_if(F.col("sha").isNotNull()).alias("synced"), F.count_if(F.col("sha").isNull()).alias("failed"))
    return merged, counts.crossJoin(repos.agg(F.count("*").alias("total")))
