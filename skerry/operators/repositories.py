"""Dependencies between repositories: repo_deps (repo, dep, version, scope runtime or dev)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate


def repo_graph(repos: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo or external) and edges (depends_on, dev_depends_on)."""
    names = repos.select(F.col("repo").alias("id")).distinct()
    outside = deps.select(F.col("dep").alias("id")).distinct().join(names, "id", "left_anti")
    nodes = names.withColumn("type", F.lit("repo")).unionByName(outside.withColumn("type", F.lit("external")))
    kind = F.when(F.col("scope") == "dev", "dev_depends_on").otherwise("depends_on")
    return nodes, deps.select(F.col("repo").alias("source"), F.col("dep").alias("target"), kind.alias("type"))


def shared_dependencies(deps: DataFrame) -> DataFrame:
    """(dep, used_by, n): runtime dependencies that are listed at least twice."""
    runtime = deps.where("scope = 'runtime'")
    often = runtime.groupBy("dep").agg(F.count("*").alias("_l")).where("_l >= 2").select("dep")
    g = runtime.join(often, "dep", "left_semi").select("dep", "repo").distinct().groupBy("dep").agg(F.array_sort(F.collect_list("repo")).alias("used_by"))
    return g.select("dep", "used_by", F.size("used_by").alias("n"))


def dependency_users(deps: DataFrame) -> DataFrame:
    """(dep, repo): the users of dependencies that are listed at least twice, as rows; for dependencies that nearly all repositories use."""
    runtime = deps.where("scope = 'runtime'")
    often = runtime.groupBy("dep").agg(F.count("*").alias("_l")).where("_l >= 2").select("dep")
    return runtime.join(often, "dep", "left_semi").select("dep", "repo").distinct()


def dependency_versions(deps: DataFrame) -> DataFrame:
    return deps.where("scope = 'runtime' and version is not null").groupBy("dep").agg(F.array_sort(F.collect_list(F.struct("repo", "version"))).alias("versions"))


def version_conflicts(deps: DataFrame) -> DataFrame:
    """(dep, majors, listings, severity): dependencies with two listings or more and several major versions."""
    major = F.coalesce(F.regexp_extract("version", r"(\d+)", 1).try_cast("int"), F.lit(0))
    g = deps.where("scope = 'runtime' and version is not null").groupBy("dep").agg(F.array_sort(F.collect_set(major)).alias("majors"), F.count("*").alias("listings"))
    return g.where("listings >= 2 and size(majors) > 1").withColumn("severity", F.lit("major"))


def impact(nodes: DataFrame, edges: DataFrame, depth: int = 100, include_self: bool = False) -> DataFrame:
    """(repo, direct, transitive, risk) for every repo: how many depend on it at once, and by further steps."""
    repos = nodes.where("type = 'repo'").select("id")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    near = iterate.reach(back, repos, depth)
    if not include_self:
        near = near.where("start <> node")
    sums = near.groupBy("start").agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"))
    total = repos.agg(F.count("*").alias("_t"))
    out = repos.join(sums, F.col("id") == F.col("start"), "left").crossJoin(F.broadcast(total)).fillna(0, ["direct", "transitive"])
    share = (F.col("direct") + F.col("transitive")) / F.col("_t")
    risk = F.when(share >= 0.5, "critical").when(share >= 0.3, "high").when(share >= 0.1, "medium").otherwise("low")
    return out.select(F.col("id").alias("repo"), "direct", "transitive", risk.alias("risk"))


def all_dependents(edges: DataFrame, repos: DataFrame, depth: int = 100) -> DataFrame:
    """(repo, dependent, distance): all that depend on each of repos (id) by any number of steps, itself left out."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return iterate.reach(back, repos, depth).where("start <> node").select(F.col("start").alias("repo"), F.col("node").alias("dependent"), "distance")


def repo_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(first, length, path): cycles among repositories, the first one repeated at the end; a repository that depends on itself counts."""
    repos = nodes.where("type = 'repo'").select("id")
    inner = edges.join(repos.withColumnRenamed("id", "source"), "source", "left_semi").join(repos.withColumnRenamed("id", "target"), "target", "left_semi")
    return iterate.cycles(inner, closed=True, loops=True)


def related(relations: DataFrame, ids: DataFrame, dependents: bool = False) -> DataFrame:
    """relations (type, from, to): (id, other) by one step of depends_on, backwards for dependents."""
    a, b = ("to", "from") if dependents else ("from", "to")
    return relations.where("type = 'depends_on'").join(ids.select("id").distinct(), F.col(a) == F.col("id")).select("id", F.col(b).alias("other"))


def upgrade_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, level): dependencies first; repos on or behind cycles are left out."""
    repos = nodes.where("type = 'repo'").select("id")
    inner = edges.join(repos.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    return iterate.depths(inner, repos).join(repos, "id", "left_semi").where("depth is not null").select(F.col("id").alias("repo"), F.col("depth").alias("level"))


def dependency_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, cyclic): the longest chain of dependencies; null and cyclic where a cycle is reached."""
    return iterate.depths(edges, nodes).withColumn("cyclic", F.col("depth").isNull())


def roots_and_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, kind): leaf depends on nothing; root depends on something and nothing on it."""
    repos = nodes.where("type = 'repo'").select(F.col("id").alias("repo"))
    out, into = edges.select(F.col("source").alias("repo")).distinct(), edges.select(F.col("target").alias("repo")).distinct()
    leaf = repos.join(out, "repo", "left_anti").withColumn("kind", F.lit("leaf"))
    return leaf.unionByName(repos.join(out, "repo", "left_semi").join(into, "repo", "left_anti").withColumn("kind", F.lit("root")))


def most_depended_on(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.groupBy(F.col("target").alias("dep")).agg(F.countDistinct("source").alias("dependents")).orderBy(F.desc("dependents"), "dep").limit(limit)
