"""Refactoring reports over a property graph of functions, modules and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, iterate


def low_cohesion(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """(module, functions, cohesion): modules of more than two functions with a cohesion under 0.3, the lowest first."""
    return graph.module_cohesion(nodes, edges).where("functions > 2 and cohesion < 0.3").select("module", "functions", "cohesion").orderBy("cohesion", "module").limit(limit)


def complex_functions(nodes: DataFrame, edges: DataFrame, least: int = 10, limit: int = 10) -> DataFrame:
    """(id, complexity): functions with 2 * callers + callees over `least`, the most complex first."""
    return graph.functions_over(nodes, edges, least).select("id", "complexity").orderBy(F.desc("complexity"), "id").limit(limit)


def god_functions(nodes: DataFrame, edges: DataFrame, least: int = 15, limit: int = 10) -> DataFrame:
    """(id, connectivity): of the most called and calling functions those over `least`."""
    return graph.hot_paths(nodes, edges, limit).where(F.col("connectivity") > least).select("id", "connectivity")


def opportunities(nodes: DataFrame, edges: DataFrame, limit: int = 10, groups: int = 5) -> DataFrame:
    """(kind, n, priority): how many findings each report has (cycles: strongly connected groups, the largest `groups`),
    and in all (kind total) with a priority: high for cycles or god functions, medium for many complex functions or loose
    modules, else low."""
    rings = iterate.strong_components(graph.of_type(edges, "calls")).groupBy("component").count().orderBy(F.desc("count"), "component").limit(groups)
    dead = graph.dead_code(nodes, edges).orderBy("id").limit(limit)
    kinds = {"high_complexity": complex_functions(nodes, edges, limit=limit), "low_cohesion": low_cohesion(nodes, edges, limit), "dead_code": dead, "cycles": rings, "god_functions": god_functions(nodes, edges, limit=limit)}
    rows = None
    for kind, found in kinds.items():
        own = found.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        rows = own if rows is None else rows.unionByName(own)
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    priority = F.when((n("cycles") > 0) | (n("god_functions") > 0), "high").when((n("high_complexity") > 5) | (n("low_cohesion") > 3), "medium").otherwise("low")
    total = rows.agg(F.lit("total").alias("kind"), F.sum("n").alias("n"), priority.alias("priority"))
    return rows.withColumn("priority", F.lit(None).cast("string")).unionByName(total)


def module_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, functions, internal_calls, external_dependencies, cohesion, imports, complex, suggestions) of every module that
    defines functions; complex: its functions of a complexity over 10, by id."""
    stats = graph.module_cohesion(nodes, edges)
    own = graph.functions_of(nodes, edges).distinct()
    high = graph.functions_over(nodes, edges).select(F.col("id").alias("function"))
    complex_ = own.join(high, "function").groupBy("module").agg(F.array_sort(F.collect_list("function")).alias("complex"))
    imports = graph.of_type(edges, *graph.IMPORTS).groupBy(F.col("source").alias("module")).agg(F.count("*").alias("imports"))
    rows = stats.join(complex_, "module", "left").join(imports, "module", "left").withColumn("imports", F.coalesce("imports", F.lit(0)))
    text = F.transform("complex", lambda x: x.cast("string"))
    said = F.array_compact(F.array(
        F.when(F.col("external_dependencies") > 10, F.concat(F.lit("Many external dependencies ("), F.col("external_dependencies").cast("string"), F.lit(") - consider dependency injection"))),
        F.when(F.size("complex") > 0, F.concat(F.lit("Consider simplifying: "), F.array_join(text, ", "))),
        F.when((F.col("cohesion") < 0.2) & (F.col("functions") > 3), F.concat(F.lit("Consider splitting module - low internal cohesion ("), F.round("cohesion", 2).cast("string"), F.lit(")"))),
    ))
    return rows.withColumns({"complex": F.coalesce("complex", F.array().cast(rows.schema["complex"].dataType)), "suggestions": said})


def change_impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    """(id, callers, callees, entries, risk) for each of starts (id): functions affected by a change; entries: entry points
    among the callers; risk high for more than 3 of these or more than 10 callers, medium for more than 5 callers."""
    up = graph.transitive_callers(edges, starts, depth)
    entries = graph.entry_points(nodes, edges).select(F.col("id").alias("node"), F.lit(1).alias("_e"))
    above = up.where("start <> node").join(entries, "node", "left").groupBy("start").agg(F.count("*").alias("callers"), F.count("_e").alias("entries"))
    below = graph.transitive_callees(edges, starts, depth).where("start <> node").groupBy("start").agg(F.count("*").alias("callees"))
    rows = starts.select("id").distinct().join(above.withColumnRenamed("start", "id"), "id", "left").join(below.withColumnRenamed("start", "id"), "id", "left").fillna(0, ["callers", "callees", "entries"])
    risk = F.when((F.col("entries") > 3) | (F.col("callers") > 10), "high").when(F.col("callers") > 5, "medium").otherwise("low")
    return rows.select("id", "callers", "callees", "entries", risk.alias("risk"))


def refactoring_order(edges: DataFrame, targets: DataFrame, depth: int = 20) -> DataFrame:
    """targets (plan, id): (plan, id, within, place): functions that reach fewer other targets of their plan come first; ties by id."""
    reached = graph.transitive_callees(edges, targets.select("id").distinct(), depth).where("start <> node").select(F.col("start").alias("id"), "node")
    inner = targets.join(reached, "id").join(targets.select("plan", F.col("id").alias("node")), ["plan", "node"]).groupBy("plan", "id").agg(F.countDistinct("node").alias("within"))
    rows = targets.distinct().join(inner, ["plan", "id"], "left").withColumn("within", F.coalesce("within", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy("within", "id")))


def refactoring_plan(edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """(plan, step, id, affected_callers, risk, high_risk_count): steps in refactoring order; risk high over 5 callers."""
    up = graph.transitive_callers(edges, targets.select("id").distinct(), depth).where("start <> node").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("affected_callers"))
    rows = refactoring_order(edges, targets).join(up, "id", "left").withColumn("affected_callers", F.coalesce("affected_callers", F.lit(0)))
    rows = rows.withColumn("risk", F.when(F.col("affected_callers") > 5, "high").otherwise("low"))
    many = rows.groupBy("plan").agg(F.count_if(F.col("risk") == "high").alias("high_risk_count"))
    return rows.join(many, "plan").select("plan", F.col("place").alias("step"), "id", "affected_callers", "risk", "high_risk_count")


def function_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees, depth, cyclic, complexity, entry, leaf, warnings) of every function: complexity is
    2 * callers + callees + depth, 10 for the depth where a cycle is reached."""
    functions = nodes.where("type = 'function'")
    d = graph.degrees(functions, edges)
    rows = d.join(iterate.depths(graph.of_type(edges, "calls"), functions), "id", "left").withColumn("cyclic", F.col("depth").isNull())
    said = F.array_compact(F.array(
        F.when(F.col("cyclic"), F.lit("Involved in recursive cycle - potential infinite loop risk")),
        F.when(F.col("callees") > 10, F.concat(F.lit("High fan-out: "), F.col("callees").cast("string"), F.lit(" callees - function may be doing too much"))),
        F.when(F.col("callers") > 10, F.concat(F.lit("High fan-in: "), F.col("callers").cast("string"), F.lit(" callers - changes may have wide impact"))),
    ))
    return rows.select("id", "callers", "callees", "depth", "cyclic", (2 * F.col("callers") + F.col("callees") + F.coalesce("depth", F.lit(10))).alias("complexity"), (F.col("callers") == 0).alias("entry"), (F.col("callees") == 0).alias("leaf"), said.alias("warnings"))


def code_paths(edges: DataFrame, starts: DataFrame, transitive: bool = False, depth: int = 5) -> DataFrame:
    """(id, callers, callees, in_cycle) for each of starts (id): distinct callers and callees, at one step or within the depth."""
    calls = graph.of_type(edges, "calls")
    if transitive:
        up, down = graph.transitive_callers(edges, starts, depth), graph.transitive_callees(edges, starts, depth)
    else:
        up = graph.neighbours(edges, starts, incoming=True).select(F.col("id").alias("start"), F.col("neighbour").alias("node"))
        down = graph.neighbours(edges, starts).select(F.col("id").alias("start"), F.col("neighbour").alias("node"))
    count = lambda df, name: df.where("start <> node").groupBy(F.col("start").alias("id")).agg(F.countDistinct("node").alias(name))
    rings = iterate.strong_components(calls).select("id", F.lit(True).alias("in_cycle"))
    out = starts.select("id").distinct().join(count(up, "callers"), "id", "left").join(count(down, "callees"), "id", "left").join(rings, "id", "left")
    return out.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
