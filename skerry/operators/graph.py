"""Property graphs: nodes (id, type, name) and edges (source, target, type), a multigraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import iterate
from .common import small_side, stored

IMPORTS = ("imports", "uses", "alias")


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace those of the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are appended; repeats are kept."""
    return edges.unionByName(new)


def of_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given ids."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def nodes_of_type(nodes: DataFrame, type_: str) -> DataFrame:
    return nodes.where(F.col("type") == type_)


def outgoing(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges from the given ids, repeats kept."""
    return edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(*edges.columns)


def incoming(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges to the given ids, repeats kept."""
    return edges.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 1, incoming: bool = False) -> DataFrame:
    """(start, node, distance): dependencies, or dependents, of any edge type within so many edges."""
    return iterate.reach(edges.select(F.col("target").alias("source"), F.col("source").alias("target")) if incoming else edges, starts, depth)


def function_cycles(edges: DataFrame, limit: int | None = 100) -> DataFrame:
    """(first, length, path): cycles of calls, shortest first; the limit is the report's length (None: all)."""
    found = iterate.cycles(of_type(edges, "calls"))
    return found if limit is None else found.orderBy("length", "path").limit(limit)


def top_importers(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(id, imports): the modules with most imports."""
    counts = of_type(edges, *IMPORTS).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("imports"))
    return counts.join(nodes.where("type = 'module'").select("id"), "id", "left_semi").orderBy(F.desc("imports"), "id").limit(limit)


def internal_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, dependencies, n): the modules that each module imports."""
    modules = nodes.where("type = 'module'").select("id")
    inner = of_type(edges, *IMPORTS).join(modules.withColumnRenamed("id", "source"), "source", "left_semi").join(modules.withColumnRenamed("id", "target"), "target", "left_semi")
    g = inner.select("source", "target").distinct().groupBy(F.col("source").alias("module"))
    return g.agg(F.array_sort(F.collect_list("target")).alias("dependencies"), F.count("*").cast("int").alias("n"))


def external_usage(nodes: DataFrame, edges: DataFrame, rules: DataFrame, limit: int | None = 10) -> DataFrame:
    """(id, importers, category): external nodes by how many import them; rules (prefix, category, rank): the first rule whose
    prefix starts the id, else `other`. Rules are a short list and size-checked."""
    outside = nodes.where("type = 'external'").select("id")
    used = of_type(edges, *IMPORTS).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("importers")).join(outside, "id", "left_semi")
    met = used.join(small_side(rules), F.col("id").startswith(F.col("prefix")), "left").groupBy("id", "importers").agg(F.min_by("category", "rank").alias("category"))
    out = met.withColumn("category", F.coalesce("category", F.lit("other")))
    return out if limit is None else out.orderBy(F.desc("importers"), "id").limit(limit)


def neighbours(edges: DataFrame, ids: DataFrame, types: tuple[str, ...] = ("calls",), incoming: bool = False) -> DataFrame:
    """(id, neighbour): callees, or callers if incoming; repeats kept. With IMPORTS: imports_of and imported_by."""
    a, b = ("target", "source") if incoming else ("source", "target")
    return of_type(edges, *types).join(ids.select(F.col("id")), F.col(a) == F.col("id")).select("id", F.col(b).alias("neighbour"))


def functions_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, function): targets of defines that are functions."""
    f = nodes.where("type = 'function'").select(F.col("id").alias("target"))
    return of_type(edges, "defines").join(f, "target", "left_semi").select(F.col("source").alias("module"), F.col("target").alias("function"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): counts by type, and in all (type null)."""
    both = nodes.select(F.lit("node").alias("kind"), "type").unionByName(edges.select(F.lit("edge").alias("kind"), "type"))
    return both.rollup("kind", "type").agg(F.count("*").alias("n")).where("kind is not null")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nothing calls."""
    return nodes.where("type = 'function'").join(of_type(edges, "calls").select(F.col("target").alias("id")), "id", "left_anti").select("id")


def leaf_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that call nothing."""
    return nodes.where("type = 'function'").join(of_type(edges, "calls").select(F.col("source").alias("id")), "id", "left_anti").select("id")


def degrees(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(id, callers, callees): repeats counted."""
    e = of_type(edges, *types)
    ends = e.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select("source", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def hot_paths(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The functions with most calls in and out."""
    d = degrees(nodes.where("type = 'function'"), edges).withColumn("connectivity", F.col("callers") + F.col("callees"))
    return d.orderBy(F.desc("connectivity"), "id").limit(limit)


def module_cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, functions, internal_calls, external_dependencies, cohesion)."""
    own = functions_of(nodes, edges)
    size = own.groupBy("module").agg(F.countDistinct("function").alias("functions"))
    calls = of_type(edges, "calls").join(own.select(F.col("module"), F.col("function").alias("source")), "source")
    calls = calls.join(own.select(F.col("module").alias("to"), F.col("function").alias("target")), "target", "left")
    inner = F.coalesce(F.col("module") == F.col("to"), F.lit(False))
    sums = calls.groupBy("module").agg(F.count_if(inner).alias("internal_calls"), F.countDistinct(F.when(~inner, F.col("target"))).alias("external_dependencies"))
    out = size.join(sums, "module", "left").fillna(0, ["internal_calls", "external_dependencies"])
    return out.withColumn("cohesion", F.when(F.col("functions") > 1, F.col("internal_calls") / F.col("functions")).otherwise(0.0))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, afferent, efferent, instability) over import edges; 0.5 for isolated modules."""
    d = degrees(nodes, edges, IMPORTS).select("id", F.col("callers").alias("afferent"), F.col("callees").alias("efferent"))
    total = F.col("afferent") + F.col("efferent")
    return d.withColumn("instability", F.when(total > 0, F.col("efferent") / total).otherwise(0.5))


def coupling_summary(coupled: DataFrame) -> DataFrame:
    """One row: modules, afferent and efferent sums, mean instability."""
    return coupled.agg(F.count("*").alias("modules"), F.sum("afferent").alias("afferent"), F.sum("efferent").alias("efferent"), F.avg("instability").alias("mean_instability"))


def coupling_report(coupled: DataFrame, few: int = 5, many: int = 10) -> DataFrame:
    """(kind, rank, id): the most stable (with importers) and unstable (with imports) modules, and those with most coupling."""

    def ranked(rows: DataFrame, kind: str, n: int, by: Column) -> DataFrame:
        best = rows.select("id", by.alias("_by")).orderBy("_by", "id").limit(n)
        return best.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy("_by", "id")).alias("rank"), "id")

    stable = ranked(coupled.where("afferent > 0"), "stable", few, F.col("instability"))
    loose = ranked(coupled.where("efferent > 0"), "unstable", few, -F.col("instability"))
    return stable.unionByName(loose).unionByName(ranked(coupled, "coupled", many, -(F.col("afferent") + F.col("efferent"))))


def dependency_issues(coupled: DataFrame, most: int = 10) -> DataFrame:
    """(id, issue): many_imports (more than so many) and isolated (no imports and no importers)."""
    issue = F.when(F.col("efferent") > most, "many_imports").when((F.col("efferent") == 0) & (F.col("afferent") == 0), "isolated")
    return coupled.select("id", issue.alias("issue")).where("issue is not null")


def transitive_callees(edges: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """Nodes within max_depth + 1 calls of each start."""
    return iterate.reach(of_type(edges, "calls"), starts, max_depth + 1)


def transitive_callers(edges: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """Nodes from which each start is within max_depth - 1 calls."""
    back = of_type(edges, "calls").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return iterate.reach(back, starts, max_depth - 1)


def enclosing(symbols: DataFrame, marks: DataFrame, key: str = "path", line: str = "line", name: str = "name", inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """Backward as-of join: symbols with `parent`, the last mark before their line (or at it) in the same file; of marks on one
    line the one with the greatest name. Symbols without a file or line, or with no mark before, have none.

    Both sides are laid out in ranges of file and line (by default as many as shuffle partitions), and each range starts with the
    last mark of the ranges before it, so a file that holds most rows is many tasks.
    """
    spark = symbols.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in symbols.columns])
    s = symbols.select(F.col(key).alias("_k"), F.col(line).alias("_at"), F.lit(1 if inclusive else 0).alias("_s"), F.lit(None).cast(marks.schema[name].dataType).alias("_m"), row.alias("_row"))
    m = marks.where(F.col(key).isNotNull() & F.col(line).isNotNull() & F.col(name).isNotNull())
    m = m.select(F.col(key).alias("_k"), F.col(line).alias("_at"), F.lit(0 if inclusive else 1).alias("_s"), F.col(name).alias("_m"), F.lit(None).cast(s.schema["_row"].dataType).alias("_row"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = m.unionByName(s).repartitionByRange(ranges, "_k", "_at", "_s").withColumn("_part", F.spark_partition_id())
    both = stored(both, "asof")  # the ranges must not change when a task is run again
    ends = both.groupBy("_k", "_part").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct("_at", "_s", "_m"))).alias("_m"))
    before = F.last("_m", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_k", "_part", before.alias("_c")).where("_c is not null")  # at most one file a range goes on from the range before
    w = Window.partitionBy("_k", "_part").orderBy("_at", "_s", "_m").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_m", ignorenulls=True).over(w)).where("_row is not null")
    found = found.join(small_side(stored(carried, "asof-ends")), ["_k", "_part"], "left")
    return found.select("_row.*", F.coalesce("_own", "_c").alias("parent"))


def functions_over(nodes: DataFrame, edges: DataFrame, limit: int = 10, score: Column | None = None) -> DataFrame:
    """Functions of high complexity: 2 * callers + callees over the limit."""
    d = degrees(nodes.where("type = 'function'"), edges)
    return d.withColumn("complexity", score if score is not None else 2 * F.col("callers") + F.col("callees")).where(F.col("complexity") > limit)


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points that look like neither tests nor callbacks."""
    names = nodes.select("id", "name")
    return entry_points(nodes, edges).join(names, "id").where(~F.col("name").rlike("^(test|handle_|init|__)") & ~F.col("id").contains("Test")).select("id")
