"""Queries on graphs, repositories, reviews, contexts, metrics, streams and row steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import changes, classify, graph, metrics, portfolio, refactor, repositories, steps
from skerry.operators.common import shared_path
from skerry.sources import tree
from skerry.streaming import metrics as stream

from .base import ALL_CALLS_SQL, CALLS_SQL, FILES_SQL, IMPORTS_SQL, REPOS_SQL, calls, imports, joined, query, relations, repos, source_files, table

WITH, REC = "WITH ", "WITH RECURSIVE "

# Calls and refactoring

_ALL_CALLS = CALLS_SQL + ", e AS (SELECT DISTINCT source, target FROM calls)"


def _reach(name: str, depth: int, back: bool = False) -> str:
    a, b = ("target", "source") if back else ("source", "target")
    return f"""{name}_r AS (SELECT id AS start, id AS node, 0 AS d FROM f UNION SELECT start, {b}, d + 1 FROM {name}_r JOIN e ON {a} = node WHERE d < {depth}),
{name} AS (SELECT DISTINCT start, node FROM {name}_r WHERE start <> node)"""


def _near(edges):
    """Calls within a block only."""
    return edges.where("type <> 'calls' or abs(try_cast(source as long) - try_cast(target as long)) < 5")


@query(WITH + CALLS_SQL + """, b AS (SELECT DISTINCT id - id % 5 AS z FROM f WHERE (id // 5) % 2 = 0) SELECT z::VARCHAR AS first, 4 AS length, concat_ws('>', z, z + 2, z + 3, z + 4) AS path FROM b
UNION ALL SELECT z::VARCHAR, 5, concat_ws('>', z, z + 1, z + 2, z + 3, z + 4) FROM b""")
def call_cycles(spark, d):
    out = graph.function_cycles(_near(calls(spark, d)[1]), None)
    key = lambda p: F.transform(F.array_sort(F.transform(p, lambda x: x.cast("long"))), lambda x: x.cast("string"))
    return out.select(key("path")[0].alias("first"), "length", F.array_join(key("path"), ">").alias("path"))


_DEGREES = _ALL_CALLS + """, deg AS (SELECT id, (SELECT count(*) FROM calls WHERE target = id) AS callers, (SELECT count(*) FROM calls WHERE source = id) AS callees FROM f)"""
_COHESION = _DEGREES + """, mod AS (SELECT module, count(DISTINCT own.id) AS functions FROM own GROUP BY 1), inner_ AS (SELECT a.module, count(*) FILTER (WHERE b.module = a.module) AS internal_calls, count(DISTINCT CASE WHEN b.module <> a.module THEN target END) AS external_dependencies FROM calls JOIN own a ON a.id = source JOIN own b ON b.id = target GROUP BY 1),
coh AS (SELECT module, functions, coalesce(internal_calls, 0) AS internal_calls, coalesce(external_dependencies, 0) AS external_dependencies, coalesce(internal_calls, 0) / functions AS cohesion FROM mod LEFT JOIN inner_ USING (module))"""


@query(WITH + _COHESION + " SELECT module, functions, internal_calls, external_dependencies, round(cohesion, 6) AS cohesion FROM coh")
def module_cohesion(spark, d):
    return graph.module_cohesion(*calls(spark, d)).withColumn("cohesion", F.round("cohesion", 6))


@query(WITH + _COHESION + """, high AS (SELECT module, string_agg(own.id::VARCHAR, ',' ORDER BY own.id::VARCHAR) AS complex FROM own JOIN deg USING (id) WHERE 2 * callers + callees > 10 GROUP BY 1)
SELECT module, functions, internal_calls, external_dependencies, round(cohesion, 6) AS cohesion, 0 AS imports, coalesce(complex, '') AS complex, CASE WHEN complex IS NOT NULL THEN 'Consider simplifying: ' || replace(complex, ',', ', ') ELSE '' END AS suggestions FROM coh LEFT JOIN high USING (module)""")
def module_analysis(spark, d):
    out = refactor.module_analysis(*calls(spark, d))
    return out.withColumns({"cohesion": F.round("cohesion", 6), "complex": joined("complex"), "suggestions": joined("suggestions", "; ")})


# Every part's functions among ten modules by the key modulo 10 ("spread"), so that calls leave their module.

_SPREAD = CALLS_SQL.replace("calls AS (", "calls AS (SELECT * FROM (").replace("AND id + 10 < n),", "AND id + 10 < n) WHERE abs(source - target) < 5),") + """, spread AS (SELECT 'x' || (id % 7) AS module, id FROM f), mod AS (SELECT module, count(*) AS functions FROM spread GROUP BY 1), i AS (SELECT a.module, count(*) AS n FROM calls JOIN spread a ON a.id = source JOIN spread b ON b.id = target WHERE a.module = b.module GROUP BY 1)"""


def _spread(spark, d):
    nodes, edges = calls(spark, d)
    f = nodes.where("type = 'function'")
    defines = f.select(F.concat(F.lit("x"), (F.col("id").try_cast("long") % 7).cast("string")).alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"))
    return f, _near(edges).where("type = 'calls'").unionByName(defines)


@query(WITH + _SPREAD + " SELECT module, functions, round(coalesce(n, 0) / functions, 6) AS cohesion FROM mod LEFT JOIN i USING (module) WHERE functions > 2 AND coalesce(n, 0) / functions < 0.3 ORDER BY coalesce(n, 0) / functions, module LIMIT 10")
def low_cohesion(spark, d):
    return refactor.low_cohesion(*_spread(spark, d)).withColumn("cohesion", F.round("cohesion", 6))


@query(WITH + _DEGREES + " SELECT id::VARCHAR AS id, 2 * callers + callees AS complexity FROM deg WHERE 2 * callers + callees > 5 ORDER BY complexity DESC, id::VARCHAR LIMIT 10")
def complex_functions(spark, d):
    return refactor.complex_functions(*calls(spark, d), least=5)


@query(WITH + _DEGREES + ", hot AS (SELECT id::VARCHAR AS id, callers + callees AS connectivity FROM deg ORDER BY 2 DESC, 1 LIMIT 10) SELECT * FROM hot WHERE connectivity > 2")
def god_functions(spark, d):
    return refactor.god_functions(*calls(spark, d), least=2)


@query(WITH + _SPREAD + """, deg AS (SELECT id, (SELECT count(*) FROM calls WHERE target = id) AS callers, (SELECT count(*) FROM calls WHERE source = id) AS callees FROM f), k AS (
SELECT 'high_complexity' AS kind, least(10, count(*)) AS n FROM deg WHERE 2 * callers + callees > 10 UNION ALL SELECT 'low_cohesion', (SELECT count(*) FROM mod LEFT JOIN i USING (module) WHERE functions > 2 AND coalesce(n, 0) / functions < 0.3)
UNION ALL SELECT 'dead_code', (SELECT least(10, count(*)) FROM f WHERE id NOT IN (SELECT target FROM calls)) UNION ALL SELECT 'cycles', (SELECT least(5, count(DISTINCT id // 5)) FROM f WHERE (id // 5) % 2 = 0)
UNION ALL SELECT 'god_functions', (SELECT count(*) FROM (SELECT callers + callees AS c FROM deg ORDER BY 1 DESC LIMIT 10) WHERE c > 15))
SELECT kind, n, NULL AS priority FROM k UNION ALL SELECT 'total', sum(n)::BIGINT, 'high' FROM k""")
def refactoring_opportunities(spark, d):
    return refactor.opportunities(*_spread(spark, d))


@query(REC + _ALL_CALLS + "," + _reach("up", 9, True) + "," + _reach("down", 11) + """, ent AS (SELECT id FROM f WHERE id NOT IN (SELECT target FROM calls)),
a AS (SELECT start, count(*) AS callers, count(*) FILTER (WHERE node IN (SELECT id FROM ent)) AS entries FROM up GROUP BY 1), b AS (SELECT start, count(*) AS callees FROM down GROUP BY 1),
j AS (SELECT id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(entries, 0) AS entries FROM f LEFT JOIN a ON a.start = id LEFT JOIN b ON b.start = id)
SELECT id::VARCHAR AS id, callers, callees, entries, CASE WHEN entries > 3 OR callers > 10 THEN 'high' WHEN callers > 5 THEN 'medium' ELSE 'low' END AS risk FROM j""")
def change_impact(spark, d):
    nodes, edges = calls(spark, d)
    return refactor.change_impact(nodes, edges, nodes.where("type = 'function'"))


_PLAN = """t AS (SELECT 'plan' || (id // 20) AS plan, id FROM f WHERE id % 3 <> 1), w AS (SELECT t.plan, t.id, count(DISTINCT o.id) AS within FROM t LEFT JOIN down ON down.start = t.id LEFT JOIN t o ON o.plan = t.plan AND o.id = down.node GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY within, id::VARCHAR) AS place FROM w)"""


def _targets(spark, d):
    k = F.col("id").try_cast("long")
    return calls(spark, d)[0].where("type = 'function'").where(k % 3 != 1).select(F.concat(F.lit("plan"), F.expr("cast(try_cast(id as long) div 20 as string)")).alias("plan"), "id")


@query(REC + _ALL_CALLS + "," + _reach("down", 21) + "," + _reach("up", 4, True) + "," + _PLAN + """, c AS (SELECT start, count(*) AS n FROM up GROUP BY 1), s AS (SELECT plan, place::INT AS step, id, coalesce(n, 0) AS affected_callers FROM placed LEFT JOIN c ON start = id)
SELECT plan, step, id::VARCHAR AS id, affected_callers, CASE WHEN affected_callers > 5 THEN 'high' ELSE 'low' END AS risk, count(*) FILTER (WHERE affected_callers > 5) OVER (PARTITION BY plan) AS high_risk_count FROM s""")
def refactoring_plan(spark, d):
    return refactor.refactoring_plan(calls(spark, d)[1], _targets(spark, d))


@query(WITH + _DEGREES + """ SELECT id::VARCHAR AS id, callers, callees, callers = 0 AS entry, callees = 0 AS leaf FROM deg""")
def function_roles(spark, d):
    return refactor.function_analysis(*calls(spark, d)).select("id", "callers", "callees", "entry", "leaf")


@query(REC + CALLS_SQL + """, tree AS (SELECT source, target FROM calls WHERE target > source), x AS (SELECT id, id AS node, 0 AS depth FROM f UNION SELECT id, target, depth + 1 FROM x JOIN (SELECT source, target FROM tree WHERE target - source < 5) ON source = node),
deg AS (SELECT id, (SELECT count(*) FROM tree WHERE target = id AND target - source < 5) AS callers, (SELECT count(*) FROM tree WHERE source = id AND target - source < 5) AS callees FROM f), dep AS (SELECT id, max(depth)::INT AS depth FROM x GROUP BY 1)
SELECT id::VARCHAR AS id, callers, callees, depth, false AS cyclic, 2 * callers + callees + depth AS complexity, callers = 0 AS entry, callees = 0 AS leaf FROM deg JOIN dep USING (id)""")
def function_analysis(spark, d):
    nodes, edges = calls(spark, d)
    near = edges.where("type = 'calls'").where("try_cast(target as long) - try_cast(source as long) between 1 and 4")
    return refactor.function_analysis(nodes, near).drop("warnings")


_NEAR_CALLS = _ALL_CALLS + " WHERE abs(source - target) < 5"


def _ends(sql: str) -> str:
    """The CTE e closes after the condition."""
    return sql.replace("FROM calls) WHERE abs(source - target) < 5", "FROM calls WHERE abs(source - target) < 5)")


@query(WITH + _ends(_NEAR_CALLS) + """ SELECT id::VARCHAR AS id, (SELECT count(*) FROM e WHERE target = id) AS callers, (SELECT count(*) FROM e WHERE source = id) AS callees, (id // 5) % 2 = 0 AS in_cycle FROM f""")
def code_paths(spark, d):
    nodes, edges = calls(spark, d)
    return refactor.code_paths(_near(edges), nodes.where("type = 'function'"))


@query(REC + _ends(_NEAR_CALLS) + "," + _reach("up", 4, True) + "," + _reach("down", 6) + """ SELECT id::VARCHAR AS id, (SELECT count(*) FROM up WHERE start = id) AS callers, (SELECT count(*) FROM down WHERE start = id) AS callees, (id // 5) % 2 = 0 AS in_cycle FROM f""")
def code_paths_transitive(spark, d):
    nodes, edges = calls(spark, d)
    return refactor.code_paths(_near(edges), nodes.where("type = 'function'"), transitive=True)


@query(WITH + CALLS_SQL + " SELECT source::VARCHAR AS source, target::VARCHAR AS target, 'out' AS way FROM calls WHERE source % 10 = 0 UNION ALL SELECT source::VARCHAR, target::VARCHAR, 'in' FROM calls WHERE target % 10 = 0")
def edges_of_nodes(spark, d):
    nodes, edges = calls(spark, d)
    asked, only = nodes.where("type = 'function' and try_cast(id as long) % 10 = 0"), graph.of_type(edges, "calls")
    return graph.outgoing(only, asked).select("source", "target", F.lit("out").alias("way")).unionByName(graph.incoming(only, asked).select("source", "target", F.lit("in").alias("way")))


@query(WITH + CALLS_SQL + " SELECT source::VARCHAR AS id, target::VARCHAR AS neighbour, 'callee' AS kind FROM calls UNION ALL SELECT target::VARCHAR, source::VARCHAR, 'caller' FROM calls UNION ALL SELECT module, id::VARCHAR, 'function' FROM own")
def neighbours(spark, d):
    nodes, edges = calls(spark, d)
    f = graph.nodes_of_type(nodes, "function")
    out = graph.neighbours(edges, f).withColumn("kind", F.lit("callee")).unionByName(graph.neighbours(edges, f, incoming=True).withColumn("kind", F.lit("caller")))
    return out.unionByName(graph.functions_of(nodes, edges).select(F.col("module").alias("id"), F.col("function").alias("neighbour"), F.lit("function").alias("kind")))


@query(REC + CALLS_SQL + ", r AS (SELECT id AS start, id AS node, 0 AS d FROM f WHERE id % 5 = 0 UNION SELECT start, target, d + 1 FROM r JOIN calls ON source = node WHERE d < 2) SELECT start::VARCHAR AS start, node::VARCHAR AS node, min(d)::INT AS distance FROM r GROUP BY ALL HAVING min(d) > 0")
def neighbourhood(spark, d):
    nodes, edges = calls(spark, d)
    return graph.neighbourhood(graph.of_type(edges, "calls"), nodes.where("type = 'function' and try_cast(id as long) % 5 = 0"), 2)


@query(WITH + CALLS_SQL + " SELECT id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN 'new' ELSE id::VARCHAR END AS name FROM f")
def node_upsert(spark, d):
    nodes = graph.nodes_of_type(calls(spark, d)[0], "function")
    return graph.upsert_nodes(nodes, nodes.where("try_cast(id as long) % 2 = 0").withColumn("name", F.lit("new"))).select("id", "name")


# Imports and coupling

_COUPLED = IMPORTS_SQL + """, cpl AS (SELECT id, (SELECT count(*) FROM imports WHERE target = id) AS afferent, (SELECT count(*) FROM imports WHERE source = id) AS efferent FROM mods), ins AS (SELECT *, CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent) ELSE 0.5 END AS instability FROM cpl)"""


def _coupled(spark, d):
    nodes, edges = imports(spark, d)
    return graph.coupling(nodes.where("type = 'module'"), edges)


@query(WITH + IMPORTS_SQL + " SELECT source AS id, count(*) AS imports FROM imports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_importers(spark, d):
    return graph.top_importers(*imports(spark, d))


@query(WITH + IMPORTS_SQL + " SELECT source AS module, string_agg(DISTINCT target, ',' ORDER BY target) AS dependencies, count(DISTINCT target)::INT AS n FROM imports WHERE target LIKE 's%' GROUP BY 1")
def internal_dependencies(spark, d):
    return graph.internal_dependencies(*imports(spark, d)).withColumn("dependencies", joined("dependencies"))


@query(WITH + IMPORTS_SQL + " SELECT target AS id, count(DISTINCT source) AS importers, CASE WHEN target LIKE 'ext0%' THEN 'core' WHEN target LIKE 'ext1%' OR target LIKE 'ext2%' THEN 'library' ELSE 'other' END AS category FROM imports WHERE target LIKE 'ext%' GROUP BY 1")
def external_usage(spark, d):
    rules = spark.createDataFrame([("ext0", "core", 1), ("ext1", "library", 2), ("ext2", "library", 3)], "prefix string, category string, rank int")
    return graph.external_usage(*imports(spark, d), rules)


@query(WITH + _COUPLED + " SELECT count(*) AS modules, sum(afferent)::BIGINT AS afferent, sum(efferent)::BIGINT AS efferent, round(avg(instability), 6) AS mean_instability FROM ins")
def coupling_summary(spark, d):
    return graph.coupling_summary(_coupled(spark, d)).withColumn("mean_instability", F.round("mean_instability", 6))


@query(WITH + _COUPLED + """ (SELECT 'stable' AS kind, row_number() OVER (ORDER BY instability, id)::INT AS rank, id FROM ins WHERE afferent > 0 QUALIFY rank <= 5) UNION ALL (SELECT 'unstable', row_number() OVER (ORDER BY instability DESC, id)::INT AS rank, id FROM ins WHERE efferent > 0 QUALIFY rank <= 5)
UNION ALL (SELECT 'coupled', row_number() OVER (ORDER BY afferent + efferent DESC, id)::INT AS rank, id FROM ins QUALIFY rank <= 10)""")
def coupling_report(spark, d):
    return graph.coupling_report(_coupled(spark, d))


@query(WITH + _COUPLED + " SELECT id, CASE WHEN efferent > 10 THEN 'many_imports' ELSE 'isolated' END AS issue FROM ins WHERE efferent > 10 OR efferent = 0 AND afferent = 0")
def dependency_issues(spark, d):
    return graph.dependency_issues(_coupled(spark, d))


# Repositories

def _repo_graph(spark, d):
    nodes, edges = imports(spark, d)
    deps = edges.select(F.col("source").alias("repo"), F.col("target").alias("dep"), F.when(F.col("target").endswith("3"), "dev").otherwise("runtime").alias("scope"), F.concat(F.lit("~> 1."), F.length("source").cast("string")).alias("version"))
    return nodes.where("type = 'module'").select(F.col("id").alias("repo")), deps


@query(WITH + IMPORTS_SQL + " SELECT id, 'repo' AS type FROM mods UNION ALL SELECT DISTINCT target, 'external' FROM imports WHERE target LIKE 'ext%'")
def repo_graph_nodes(spark, d):
    return repositories.repo_graph(*_repo_graph(spark, d))[0]


@query(WITH + IMPORTS_SQL + " SELECT source, target, CASE WHEN target LIKE '%3' THEN 'dev_depends_on' ELSE 'depends_on' END AS type FROM imports")
def repo_graph_edges(spark, d):
    return repositories.repo_graph(*_repo_graph(spark, d))[1]


@query(WITH + IMPORTS_SQL + ", l AS (SELECT target, source FROM imports WHERE target NOT LIKE '%3'), o AS (SELECT target FROM l GROUP BY 1 HAVING count(*) >= 2) SELECT DISTINCT target AS dep, source AS repo FROM l JOIN o USING (target)")
def dependency_users(spark, d):
    return repositories.dependency_users(_repo_graph(spark, d)[1])


@query(WITH + IMPORTS_SQL + " SELECT target AS dep, string_agg(source || ' ~> 1.' || length(source), ',' ORDER BY source, length(source)) AS versions FROM imports WHERE target NOT LIKE '%3' GROUP BY 1")
def dependency_versions(spark, d):
    out = repositories.dependency_versions(_repo_graph(spark, d)[1])
    return out.select("dep", F.array_join(F.transform("versions", lambda v: F.concat(v["repo"], F.lit(" "), v["version"])), ",").alias("versions"))


@query(REC + IMPORTS_SQL + ", i AS (SELECT DISTINCT source, target FROM imports), r AS (SELECT id AS repo, id AS node, 0 AS d FROM mods WHERE k % 10 = 0 UNION SELECT repo, source, d + 1 FROM r JOIN i ON target = node WHERE d < 3) SELECT repo, node AS dependent, min(d)::INT AS distance FROM r WHERE repo <> node GROUP BY ALL")
def all_dependents(spark, d):
    nodes, edges = imports(spark, d)
    return repositories.all_dependents(edges, nodes.where("type = 'module' and try_cast(substring(id, 2) as long) % 10 = 0"), 3)


@query(WITH + IMPORTS_SQL + """, o AS (SELECT DISTINCT source AS id FROM imports), i AS (SELECT DISTINCT target AS id FROM imports) SELECT id AS repo, 'leaf' AS kind FROM mods WHERE id NOT IN (FROM o) UNION ALL SELECT id, 'root' FROM mods WHERE id IN (FROM o) AND id NOT IN (FROM i)""")
def roots_and_leaves(spark, d):
    nodes, edges = imports(spark, d)
    return repositories.roots_and_leaves(nodes.withColumn("type", F.when(F.col("type") == "module", "repo").otherwise("external")), edges)


@query(WITH + CALLS_SQL + ", b AS (SELECT DISTINCT id - id % 5 AS z FROM f WHERE (id // 5) % 2 = 0) SELECT 4 AS length, (4 * z + 9)::VARCHAR AS total FROM b UNION ALL SELECT 5, (5 * z + 10)::VARCHAR FROM b UNION ALL SELECT 1, '10'")
def repo_cycles(spark, d):
    nodes, edges = calls(spark, d)
    ring = _near(edges).where("type = 'calls'").drop("type").unionByName(spark.createDataFrame([("10", "10")], "source string, target string"))
    out = repositories.repo_cycles(nodes.where("type = 'function'").withColumn("type", F.lit("repo")), ring)
    total = F.aggregate(F.slice("path", F.lit(1), F.col("length")), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return out.where(F.get("path", F.lit(0)) == F.element_at("path", -1)).select("length", total.cast("string").alias("total"))


@query(REC + ALL_CALLS_SQL + """, r AS (SELECT source AS id, target AS node FROM e UNION SELECT id, target FROM r JOIN e ON source = node),
bad AS (SELECT DISTINCT id FROM r WHERE node IN (SELECT id FROM r WHERE id = node)),
x AS (SELECT p_partkey AS id, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey NOT IN (FROM bad) UNION SELECT id, target, depth + 1 FROM x JOIN e ON source = node)
SELECT k::VARCHAR AS id, depth, depth IS NULL AS cyclic FROM (SELECT DISTINCT p_partkey AS k FROM part) LEFT JOIN (SELECT id, max(depth)::INT AS depth FROM x GROUP BY 1) ON id = k""")
def dependency_depth(spark, d):
    """Of all parts, by all calls."""
    nodes, edges = calls(spark, d, whole=True)
    return repositories.dependency_depth(nodes.where("type = 'function'"), edges.where("type = 'calls'")).select("id", "depth", "cyclic")


# Portfolio tables

@query(WITH + REPOS_SQL + " SELECT id, coalesce(name, id) AS name, coalesce(status, 'active') AS status, language, 0 AS tags FROM repos WHERE type = 'library' AND language = 'elixir'")
def filtered_repos(spark, d):
    out = portfolio.filtered(portfolio.with_defaults(repos(spark, d)), type="library", language="elixir", status=None)
    return out.select("id", "name", "status", "language", F.size("tags").alias("tags"))


@query(WITH + REPOS_SQL + " SELECT 'r' || (k * 2) AS id, r.path, r.id IS NOT NULL AS found FROM (SELECT k FROM repos) a LEFT JOIN (SELECT id, path FROM repos) r ON r.id = 'r' || (k * 2)")
def repo_lookup(spark, d):
    ids = table(spark, d, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") * 2).cast("string")).alias("id"))
    return portfolio.lookup(repos(spark, d), ids).select("id", "path", "found")


@query(WITH + REPOS_SQL + """ SELECT DISTINCT id, k, type, "from", "to" FROM (SELECT "from" AS id, "from" AS k, type, "from", "to" FROM relations UNION ALL SELECT "to", "from", type, "from", "to" FROM relations) WHERE type = 'port_of' AND id IN (SELECT id FROM repos WHERE k % 2 = 0)""")
def repo_relations(spark, d):
    ids = repos(spark, d).where("cast(substring(id, 2) as long) % 2 = 0")
    return portfolio.relations_of(relations(spark, d), ids, ("port_of",)).select("id", F.col("from").alias("k"), "type", "from", "to")


@query(WITH + REPOS_SQL + """ SELECT 'kept' AS kind, type, "from", "to" FROM relations WHERE type <> 'likes' AND NOT ("from" = 'r' || ((substr("from", 2)::INT // 4) * 4)) UNION ALL SELECT 'rejected', type, "from", "to" FROM relations WHERE type = 'likes'""")
def relation_changes(spark, d):
    rows = relations(spark, d)
    added, rejected = portfolio.add_relations(rows.limit(0), rows)
    left = portfolio.remove_relations(added, rows.where("cast(substring(from, 2) as int) % 4 = 0"))
    return left.select(F.lit("kept").alias("kind"), "type", "from", "to").unionByName(rejected.select(F.lit("rejected").alias("kind"), "type", "from", "to"))


@query(WITH + REPOS_SQL + """ SELECT "from" AS id, "to" AS other, 'dependency' AS kind FROM relations WHERE type = 'depends_on' UNION ALL SELECT "to", "from", 'dependent' FROM relations WHERE type = 'depends_on' AND "to" IN (SELECT id FROM repos)""")
def direct_relations(spark, d):
    ids, rows = repos(spark, d).select("id"), relations(spark, d)
    return repositories.related(rows, ids).withColumn("kind", F.lit("dependency")).unionByName(repositories.related(rows, ids, True).withColumn("kind", F.lit("dependent")))


@query(WITH + REPOS_SQL + " SELECT coalesce(language, 'unknown') AS language, count(*) AS n, string_agg(coalesce(name, id), ',' ORDER BY coalesce(name, id)) AS names FROM repos GROUP BY 1")
def repos_by_language(spark, d):
    return portfolio.by_language(repos(spark, d)).withColumn("names", joined("names"))


@query(WITH + REPOS_SQL + " SELECT id, coalesce(name, id) AS name, status FROM repos WHERE status IN ('stale', 'blocked')")
def stale_repos(spark, d):
    return portfolio.stale(repos(spark, d))


@query(WITH + REPOS_SQL + """, c AS (SELECT 'r' || (user_id % 50) AS id, substr(arg_max(sha256(event_id::VARCHAR), (ts, sha256(event_id::VARCHAR))), 1, 8) AS sha, count(*) FILTER (WHERE ts >= DATE '2024-01-05' - 2) AS n FROM events GROUP BY 1),
w AS (SELECT repos.id, sha, n FROM repos LEFT JOIN c USING (id) WHERE type = 'library') SELECT id, sha AS last_commit, n::VARCHAR AS commits, 'old' AS kept FROM w WHERE sha IS NOT NULL""")
def synced_contexts(spark, d):
    merged, _ = _sync(spark, d)
    return merged.where("map_contains_key(fields, 'last_commit')").select("id", F.col("fields")["last_commit"].alias("last_commit"), F.col("fields")["commits"].alias("commits"), F.col("fields")["note"].alias("kept"))


@query(WITH + REPOS_SQL + ", w AS (SELECT id IN (SELECT 'r' || (user_id % 50) FROM events) AS has FROM repos WHERE type = 'library') SELECT count(*) FILTER (WHERE has) AS synced, count(*) FILTER (WHERE NOT has) AS failed, (SELECT count(*) FROM repos) AS total FROM w")
def sync_summary(spark, d):
    return _sync(spark, d)[1]


def _sync(spark, d):
    e = table(spark, d, "events")
    commits = e.select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("repo"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.lit("m").alias("message"), "ts")
    deps = relations(spark, d).select(F.col("from").alias("repo"), F.col("to").alias("dep"), F.lit("runtime").alias("scope"))
    contexts = repos(spark, d).select("id", F.create_map(F.lit("note"), F.lit("old"), F.lit("last_commit_before"), F.lit("x")).alias("fields"))
    activity = changes.commit_activity(commits, F.lit("2024-01-05").cast("date"), 2)
    merged, counts = portfolio.sync(repos(spark, d), commits, deps, contexts, F.lit("2024-01-05").cast("date"), type="library")
    more = activity.select(F.col("repo").alias("id"), F.create_map(F.lit("commits"), F.col("commits_30d").cast("string")).alias("fields"))
    return changes.merge_computed(merged, more.join(merged.select("id"), "id", "left_semi"), "id"), counts


@query("""WITH t AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0), n AS (SELECT s_suppkey % 7 * 20 AS id, s_name AS name FROM supplier), fresh AS (SELECT id, min(name) AS name FROM n WHERE id NOT IN (SELECT id FROM t) GROUP BY 1)
SELECT 'table' AS kind, id, name FROM t UNION ALL SELECT 'table', id, name FROM fresh UNION ALL (SELECT 'rejected', id, name FROM n EXCEPT ALL SELECT 'rejected', id, name FROM fresh)""")
def added_rows(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    both, rejected = changes.add_rows(s.where("id % 3 = 0"), s.select((F.col("id") % 7 * 20).alias("id"), "name"), "id")
    return both.select(F.lit("table").alias("kind"), "id", "name").unionByName(rejected.select(F.lit("rejected").alias("kind"), "id", "name"))


@query("SELECT s_suppkey * 2 AS s_suppkey, s_name FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def rejected_updates(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return changes.unknown_updates(s, s.select((F.col("s_suppkey") * 2).alias("s_suppkey"), "s_name"), "s_suppkey")


@query("SELECT 'f' || p_partkey AS path, 'added' AS change_type, sha256(p_name) AS hash, p_size::BIGINT AS size FROM part WHERE p_partkey % 10 > 4 UNION ALL SELECT 'f' || p_partkey, 'modified', sha256(p_name), p_size::BIGINT FROM part WHERE p_partkey % 10 = 2 UNION ALL SELECT 'f' || p_partkey, NULL, sha256(p_name), p_size::BIGINT FROM part WHERE p_partkey % 10 < 5 AND p_partkey % 10 <> 2")
def incremental_scan(spark, d):
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"), F.col("p_size").cast("long").alias("size"), "p_partkey")
    old = changes.snapshot(files.where("p_partkey % 10 < 5").withColumn("content", F.when(F.col("p_partkey") % 10 == 2, "old").otherwise(F.col("content"))))
    changed, state = changes.incremental_scan(files, old)
    return state.join(changed, "path", "left").select("path", "change_type", "hash", "size")


# Reviews: a diff for each part

_DIFFS = """d AS (SELECT p_partkey AS k, 'diff --git a/lib/m' || p_partkey || '.ex b/lib/m' || p_partkey || '.ex' || chr(10) || '--- a/lib/m' || p_partkey || '.ex' || chr(10) || '+++ b/lib/m' || p_partkey || '.ex' || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN '+  password = "x1"' ELSE '+  x = 1' END || chr(10) || '+def run(x) do' || chr(10)
|| CASE WHEN p_partkey % 7 = 0 THEN '+  # TODO fix security' ELSE '+  ok' END || chr(10) || '-old' || chr(10) || '+' || chr(10) || CASE WHEN p_partkey % 6 = 0 THEN '+' || repeat('y', 130) ELSE ' same' END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'diff --git a/test/t_test.exs b/test/t_test.exs' || chr(10) || '+ok' ELSE '' END
|| CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'diff --git a/lib/n.py b/lib/n.py' || chr(10) || '+if case cond with fn for receive ' || chr(10) || '+if case cond with fn for receive ' ELSE '' END AS diff FROM part)"""


def _diffs(spark, d):
    k = F.col("p_partkey")
    name, nl = F.concat(F.lit("lib/m"), k.cast("string"), F.lit(".ex")), "\n"
    text = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit(nl), F.when(k % 5 == 0, '+  password = "x1"').otherwise("+  x = 1"), F.lit("\n+def run(x) do\n"),
        F.when(k % 7 == 0, "+  # TODO fix security").otherwise("+  ok"), F.lit("\n-old\n+\n"), F.when(k % 6 == 0, "+" + "y" * 130).otherwise(" same"),
        F.when(k % 3 == 0, "\ndiff --git a/test/t_test.exs b/test/t_test.exs\n+ok").otherwise(""), F.when(k % 4 == 0, "\ndiff --git a/lib/n.py b/lib/n.py\n" + "+if case cond with fn for receive \n" * 2).otherwise(""),
    )
    return table(spark, d, "part").select(k.alias("diff_id"), F.regexp_replace(text, r"\n$", "").alias("diff"))


_FILES = """fl AS (SELECT k, 'lib/m' || k || '.ex' AS file, '.ex' AS extension, 5 + (k % 6 = 0)::INT AS added, 2 AS removed, 3 + (k % 6 = 0)::INT AS plain, 1 AS gone FROM d UNION ALL SELECT k, 'test/t_test.exs', '.exs', 1, 0, 1, 0 FROM d WHERE k % 3 = 0 UNION ALL SELECT k, 'lib/n.py', '.py', 2, 0, 2, 0 FROM d WHERE k % 4 = 0)"""


@query(WITH + _DIFFS + "," + _FILES + " SELECT k AS diff_id, file, added, removed FROM fl")
def diff_files(spark, d):
    return classify.diff_files(_diffs(spark, d)).drop("added_content")


@query(WITH + _DIFFS + "," + _FILES + " SELECT k AS diff_id, file, extension, plain AS added, gone AS removed FROM fl")
def diff_counts(spark, d):
    return classify.change_counts(_diffs(spark, d))


@query(WITH + _DIFFS + "," + _FILES + " SELECT k AS diff_id, count(*) AS files, sum(plain)::BIGINT AS added, sum(gone)::BIGINT AS removed, 'low' AS risk, '' AS suggestions FROM fl GROUP BY 1")
def diff_summary(spark, d):
    return classify.change_summary(_diffs(spark, d)).withColumn("suggestions", joined("suggestions", "; "))


_COMMENTS = """c AS (SELECT k, 'lib/m' || k || '.ex' AS file, 'credential' AS rule, 'security' AS type FROM d WHERE k % 5 = 0 UNION ALL SELECT k, 'lib/m' || k || '.ex', 'note', 'warning' FROM d WHERE k % 7 = 0 UNION ALL SELECT k, 'lib/m' || k || '.ex', 'docs', 'suggestion' FROM d
UNION ALL SELECT k, 'lib/m' || k || '.ex', 'length', 'suggestion' FROM d WHERE k % 6 = 0 UNION ALL SELECT k, 'lib/n.py', 'nesting', 'suggestion' FROM d WHERE k % 4 = 0 UNION ALL SELECT k, 'overall', 'tests', 'warning' FROM d WHERE k % 3 <> 0)"""


@query(WITH + _DIFFS + "," + _COMMENTS + " SELECT k AS diff_id, file, rule, type FROM c")
def review_comments(spark, d):
    return classify.comments(_diffs(spark, d)).drop("message")


@query(WITH + _DIFFS + "," + _FILES + "," + _COMMENTS + """, a AS (SELECT k, count(*) AS files, sum(added + removed)::BIGINT AS lines FROM fl GROUP BY 1), b AS (SELECT k, count(*) FILTER (WHERE type = 'security') AS security, count(*) FILTER (WHERE type = 'warning') AS warnings, count(*) FILTER (WHERE type = 'suggestion') AS suggestions FROM c GROUP BY 1)
SELECT k AS diff_id, files, lines, round(files + lines / 100 + CASE WHEN k % 4 = 0 THEN 7 ELSE 0 END, 6)::DOUBLE AS complexity, coalesce(security, 0) AS security, coalesce(warnings, 0) AS warnings, coalesce(suggestions, 0) AS suggestions, CASE WHEN security > 0 THEN 'request_changes' WHEN warnings > 0 THEN 'needs_changes' ELSE 'approved' END AS status FROM a LEFT JOIN b USING (k)""")
def review_verdicts(spark, d):
    return classify.review(_diffs(spark, d)).withColumn("complexity", F.round("complexity", 6))


@query("""WITH f AS (SELECT p_partkey AS k, 'lib/m' || p_partkey || '.ex' AS path FROM part), i AS (SELECT path, path AS file, 'credential' AS rule, 'critical' AS severity FROM f WHERE k % 5 = 0 UNION ALL SELECT path, path, 'dangerous', 'critical' FROM f WHERE k % 3 = 0 UNION ALL SELECT path, path, 'docs', 'medium' FROM f UNION ALL SELECT path, 'overall', 'tests', 'high' FROM f)
SELECT path, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, 0 AS low, count(*) AS issues FROM i GROUP BY 1""")
def file_reviews(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("def run(x) do\n"), F.when(k % 5 == 0, 'token = "abc"\n').otherwise(""), F.when(k % 3 == 0, "System.cmd(x)\n").otherwise(""), F.lit("end"))
    files = table(spark, d, "part").select(F.concat(F.lit("lib/m"), k.cast("string"), F.lit(".ex")).alias("path"), text.alias("content"))
    out = classify.issues_report(classify.file_issues(files))
    return out.withColumn("issues", F.json_array_length(F.get_json_object("report", "$.issues")).cast("long")).drop("report")


# Messages

@query("""WITH r AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'undefined function App.Foo.bar/2' WHEN turn % 3 = 0 THEN 'no match of nil' ELSE text END AS m FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'undefined_error' WHEN turn % 3 = 0 THEN 'match_error' ELSE
 CASE WHEN contains(lower(coalesce(m, '')), 'undefined') THEN 'undefined_error' WHEN contains(lower(m), 'argument error') THEN 'argument_error' WHEN contains(lower(m), 'function clause') THEN 'function_clause_error' WHEN contains(lower(m), 'matcherror') OR contains(lower(m), 'match') AND NOT contains(lower(m), 'clause') THEN 'match_error' WHEN contains(lower(m), 'key') THEN 'key_error' WHEN contains(lower(m), 'timeout') THEN 'timeout_error' WHEN contains(lower(m), 'nil') THEN 'nil_error' ELSE 'unknown' END END AS error_type,
 CASE WHEN turn % 2 = 0 THEN 'App.Foo' END AS module, CASE WHEN turn % 2 = 0 THEN 'bar/2' END AS function, CASE WHEN turn % 2 = 0 THEN 'App.Foo bar/2 undefined function app' END AS query, CASE WHEN turn % 2 = 0 THEN 2 WHEN turn % 3 = 0 THEN 2 END AS advice FROM r WHERE turn % 2 = 0 OR turn % 3 = 0""")
def error_triage(spark, d):
    rows = table(spark, d, "conversations").where("turn % 2 = 0 or turn % 3 = 0")
    m = F.when(F.col("turn") % 2 == 0, "undefined function App.Foo.bar/2").otherwise("no match of nil")
    out = classify.error_advice(classify.triage(rows.withColumn("m", m), "m"))
    even = F.col("turn") % 2 == 0
    return out.select("conv_id", "turn", "error_type", F.when(even, F.col("module")).alias("module"), F.when(even, F.col("function")).alias("function"), F.when(even, F.col("query")).alias("query"), F.size("suggestions").alias("advice"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'search_code' WHEN 1 THEN 'get_callers,get_callees' WHEN 2 THEN 'graph_stats' ELSE 'search_code' END AS intents, CASE turn % 4 WHEN 0 THEN 'the parser ' || conv_id WHEN 1 THEN 'who calls App.Run.go/1' WHEN 2 THEN 'overview' ELSE 'hm' END AS query,
CASE turn % 4 WHEN 0 THEN 'the parser ' || conv_id WHEN 1 THEN 'App.Run.go/1' WHEN 2 THEN 'overview' ELSE 'hm' END AS function_id FROM conversations""")
def question_intents(spark, d):
    t = F.col("turn") % 4
    text = F.when(t == 0, F.concat(F.lit("find the parser "), F.col("conv_id").cast("string"), F.lit(" in the code"))).when(t == 1, "who calls App.Run.go/1").when(t == 2, "overview").otherwise("hm")
    out = classify.asked(table(spark, d, "conversations").withColumn("text", text))
    return out.select("conv_id", "turn", joined("intents").alias("intents"), "query", "function_id")


@query("""SELECT conv_id, turn, turn % 3 <> 0 AS is_sufficient, CASE turn % 3 WHEN 0 THEN 'a,b' ELSE '' END AS missing, CASE turn % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence, turn % 3 <> 1 AS refine FROM conversations""")
def answer_critiques(spark, d):
    t = F.col("turn") % 3
    text = F.when(t == 0, 'so: {"is_sufficient": false, "missing_aspects": ["a", "b"], "confidence": 0.9}').when(t == 1, '{"is_sufficient": true, "confidence": 0.95} ok').otherwise(F.col("text"))
    out = classify.critiques(table(spark, d, "conversations").withColumn("text", F.when(t == 2, F.regexp_replace(text, r"[{}]", "")).otherwise(text)))
    return out.select("conv_id", "turn", "is_sufficient", joined("missing_aspects").alias("missing"), "confidence", "refine")


@query("SELECT conv_id, turn, CASE WHEN list_has_any({w}, {c}) THEN 'p1' WHEN list_has_any({w}, {q}) AND length(text) < 50 THEN 'p2' ELSE 'p9' END AS provider FROM conversations".format(w="string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+')", c=classify.CODE_WORDS, q=classify.QUICK_WORDS))
def specialist_routes(spark, d):
    rules = spark.createDataFrame([("code", "p1"), ("quick", "p2"), ("default", "p9")], "task string, provider string")
    return classify.routed(table(spark, d, "conversations"), rules).select("conv_id", "turn", "provider")


# Metrics

def _typed(spark, d):
    kind = F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("histogram")
    return table(spark, d, "events").select(F.col("event_type").alias("name"), kind.alias("type"), "value", "ts", "user_id")


@query("""SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'histogram' END AS type, count(*) AS count, round(CASE event_type WHEN 'click' THEN sum(value) WHEN 'view' THEN arg_max(value, (ts, value)) ELSE avg(value) END, 4) AS value,
CASE WHEN event_type NOT IN ('click', 'view') THEN quantile_disc(value, 0.5) END AS p50, CASE WHEN event_type NOT IN ('click', 'view') THEN quantile_disc(value, 0.95) END AS p95, CASE WHEN event_type NOT IN ('click', 'view') THEN quantile_disc(value, 0.99) END AS p99 FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def metric_details(spark, d):
    rows = _typed(spark, d)
    return metrics.metric_detail(rows, rows.where("name <> 'signup'").select("name")).withColumn("value", F.round("value", 4))


@query("WITH s AS (SELECT event_type AS name, CASE WHEN user_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL) SELECT name, status, n, round(m, 4) AS mean_seconds, round(n / sum(n) OVER (PARTITION BY name), 6) AS share FROM s")
def span_outcomes(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    rows = e.select(F.col("event_type").alias("name"), ts.alias("started"), (ts.cast("double") + F.col("value")).cast("timestamp").alias("ended"), F.when(F.col("user_id") % 5 == 0, "error").otherwise("ok").alias("status"))
    return metrics.span_outcomes(rows).withColumns({"mean_seconds": F.round("mean_seconds", 4), "share": F.round("share", 6)})


def _summaries(spark, d):
    rows = _typed(spark, d)
    h = metrics.histogram_summary(rows.where("type = 'histogram'"))
    c = rows.where("type = 'counter'").groupBy(F.concat(F.col("name"), F.lit("_error"), (F.col("user_id") % 3).cast("string")).alias("name")).agg(F.count("*").alias("total"))
    g = rows.where("type = 'gauge'").withColumn("k", (F.col("user_id") % 4).cast("string"))
    g = metrics.gauges_latest(g, "k").select("name", F.create_map(F.lit("k"), F.col("k")).alias("tags"), "value")
    return h, c, g


@query("""WITH h AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS operations, sum(m * n) / sum(n) AS mean_latency, count(*) AS k FROM h), c AS (SELECT count(*) AS errors, count(DISTINCT user_id % 3) AS k FROM events WHERE event_type = 'click')
SELECT operations, round(mean_latency, 4) AS mean_latency, errors, s.k + c.k + 1 AS metric_count, round(100.0 * errors / operations, 4)::DOUBLE AS error_rate, CASE WHEN 100.0 * errors / operations > 10 THEN 'unhealthy' WHEN 100.0 * errors / operations > 5 THEN 'degraded' ELSE 'healthy' END AS status FROM s, c""")
def aggregate_stats(spark, d):
    return metrics.aggregate_stats(*_summaries(spark, d)).withColumns({"mean_latency": F.round("mean_latency", 4), "error_rate": F.round("error_rate", 4)})


@query("""WITH c AS (SELECT 'click_error' || (user_id % 3) AS name, count(*) AS total FROM events WHERE event_type = 'click' GROUP BY 1), g AS (SELECT (user_id % 4)::VARCHAR AS k, arg_max(value, (ts, value)) AS value FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT 'prometheus' AS format, name, '# HELP ' || name || '_total Total ' || name || chr(10) || '# TYPE ' || name || '_total counter' || chr(10) || name || '_total ' || total AS line FROM c UNION ALL SELECT 'text', name, name || ': ' || total FROM c
UNION ALL SELECT 'json', name, '{"name":"' || name || '","total":' || total || '}' FROM c UNION ALL SELECT 'prometheus', 'view', '# HELP view Current view' || chr(10) || '# TYPE view gauge' || chr(10) || (SELECT string_agg('view{k="' || k || '"} ' || value, chr(10) ORDER BY 'view{k="' || k || '"} ' || value) FROM g)
UNION ALL SELECT 'text', 'view', 'view[k=' || k || ']: ' || value FROM g""")
def metric_exports(spark, d):
    h, c, g = _summaries(spark, d)
    named = lambda df, f: df.select(F.lit(f).alias("format"), "name", "line")
    out = named(metrics.prometheus_counters(c), "prometheus").unionByName(named(metrics.prometheus_gauges(g), "prometheus"))
    return out.unionByName(named(metrics.text_summary(h.limit(0), c, g), "text")).unionByName(named(metrics.as_json(c), "json"))


# Streams: the events file as a stream, read to its end

def _stream(spark, d, name="events"):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drained(spark, rows, mode: str):
    """The last result of each batch of a stream, as (batch, columns of rows)."""
    path = shared_path(spark, "stream")

    def keep(batch, number):  # a batch that comes again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={number}")

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS name, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def stream_windows(spark, d):
    rows = stream.windowed(_stream(spark, d).select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("ts")))
    out = _drained(spark, rows, "complete")
    return out.where(F.col("_batch") == out.agg(F.max("_batch")).first()[0]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "name", "count", F.round("sum", 4).alias("sum"), "min", "max")


@query("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g), done AS (SELECT user_id, min(ts) AS started, count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, sid)
SELECT user_id, started, n FROM done WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    """Sessions that the watermark has closed by the end of the stream."""
    rows = stream.sessions(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    out = _drained(spark, rows, "append")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT event_type AS name, (user_id % 10)::VARCHAR AS tag, arg_max(value, (ts, value)) AS value FROM events GROUP BY ALL")
def stream_gauges(spark, d):
    rows = _stream(spark, d).select(F.col("event_type").alias("name"), (F.col("user_id") % 10).cast("string").alias("tag"), "value", "ts")
    out = _drained(spark, stream.latest_gauges(rows), "update")
    return out.groupBy("name", "tag").agg(F.max_by("value", "_batch").alias("value"))


@query("""WITH c AS (SELECT (user_id % 7)::VARCHAR AS provider, ts, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, count(*) OVER w AS n, sum((NOT ok)::INT) OVER w AS f FROM c WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id)),
e AS (SELECT *, CASE WHEN ok THEN true WHEN n >= 3 AND f / n > 0.5 THEN false END AS e FROM r) SELECT provider, max(n) AS calls, max(f)::BIGINT AS failures, coalesce(arg_max(e, (ts, event_id)) FILTER (WHERE e IS NOT NULL), true) AS healthy FROM e GROUP BY 1""")
def stream_providers(spark, d):
    rows = _stream(spark, d).select((F.col("user_id") % 7).cast("string").alias("provider"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    out = _drained(spark, stream.provider_states(rows), "update")
    return out.groupBy("provider").agg(F.max("calls").alias("calls"), F.max("failures").alias("failures"), F.max_by("healthy", "_batch").alias("healthy"))


@query("""SELECT 'lib/m' || p_partkey || '.ex' AS path, 4 AS chunks FROM part WHERE p_partkey % 4 = 2""")
def stream_index(spark, d):
    path = shared_path(spark, "index")
    rows = source_files(_stream(spark, d, "part")).where("path like 'lib/%'")
    q = rows.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(stream.index_batch(f"{path}/out")).start()
    q.awaitTermination()
    return stream.indexed(spark, f"{path}/out").groupBy("path").agg(F.count("*").cast("int").alias("chunks"))


# Row steps

def _step(row: dict) -> dict | None:
    if row["event_id"] % 97 == 0:
        raise ValueError("bad row")
    return None if row["event_id"] % 11 == 0 else {"event_id": row["event_id"], "half": row["value"] / 2}


@query("SELECT event_id, value / 2 AS half, NULL AS error FROM events WHERE event_id % 97 <> 0 AND event_id % 11 <> 0 UNION ALL SELECT event_id, NULL, 'ValueError: bad row' FROM events WHERE event_id % 97 = 0")
def collected_steps(spark, d):
    out = steps.apply_step(table(spark, d, "events").select("event_id", "value"), _step, "event_id long, half double", "collect")
    return out.select(F.coalesce("event_id", F.get_json_object("item", "$.event_id").cast("long")).alias("event_id"), "half", "error")


@query("SELECT event_id % 10 AS bucket, count(*) AS n, round(sum(value / 2), 4) AS total FROM events WHERE event_id % 97 <> 0 AND event_id % 11 <> 0 GROUP BY 1")
def reduced_steps(spark, d):
    return steps.map_reduce(table(spark, d, "events").select("event_id", "value"), lambda r: (s := _step(r)) and {"bucket": s["event_id"] % 10, "half": s["half"]}, "bucket long, half double", ["bucket"], {"n": F.count("*"), "total": F.round(F.sum("half"), 4)})


# Trees of files


@query(f"WITH {FILES_SQL}, placed AS (SELECT CASE k % 6 WHEN 0 THEN '.hidden/' WHEN 1 THEN '_private/' WHEN 2 THEN 'deps/' ELSE '' END || path AS relative_path, language, content FROM files) SELECT relative_path, language, octet_length(content::BLOB)::BIGINT AS size, sha256(content) AS h FROM placed WHERE NOT contains(relative_path, 'deps/') AND language IN ('python', 'elixir')")
def scanned_tree(spark, d):
    """The files are written to the shared folder, some to hidden and left-out folders, and scanned there; languages are pushed down."""
    k = F.regexp_extract("path", r"m(\d+)", 1).cast("long")
    rows = source_files(table(spark, d, "part"))
    rows = rows.withColumn("path", F.concat(F.when(k % 6 == 0, ".hidden/").when(k % 6 == 1, "_private/").when(k % 6 == 2, "deps/").otherwise(""), "path"))
    folder = shared_path(spark, "tree")
    tree.write_files(rows, folder)
    found = tree.scan_tree(spark, folder).where(F.col("language").isin("python", "elixir"))
    return found.select("relative_path", "language", "size", F.sha2("content", 256).alias("h"))
