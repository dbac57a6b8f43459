"""Queries on source files: extraction, chunks, documentation, tests and question cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import chunking, docs, extract, questions
from skerry.sources import files as sources

from .base import FILES_SQL, REFERENCES_SQL, SYMBOLS_SQL, files, joined, query, table

WITH = "WITH "


@query(WITH + SYMBOLS_SQL + " SELECT * FROM symbols")
def source_symbols(spark, d):
    pairs = F.transform("defaults", lambda x: F.concat(x["name"], F.lit("="), x["default"]))
    out = extract.symbols(files(spark, d)).withColumn("defaults", F.coalesce(F.array_join(pairs, ","), F.lit("")))
    return out.select("path", "language", "type", "name", "line", "visibility", "arity", *[joined(c).alias(c) for c in ("bases", "implements", "args")], "defaults", joined("flags").alias("flags"))


@query(WITH + REFERENCES_SQL + " SELECT * FROM refs")
def source_references(spark, d):
    names = F.array_join(F.transform("names", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["alias"], F.lit("")))), ",")
    return extract.references(files(spark, d)).select("path", "language", "type", "kind", "module", "line", names.alias("names"))


@query(WITH + FILES_SQL + " SELECT path, 4 AS line, 'cache' AS name, s::VARCHAR AS args FROM files JOIN p USING (k) WHERE k % 4 = 0")
def source_decorators(spark, d):
    return extract.decorators(files(spark, d))


@query(WITH + FILES_SQL + " SELECT path, 5 AS line, 'C' || k AS name, 'Doc of C' || k || '.' AS docstring FROM files WHERE k % 4 = 0")
def source_docstrings(spark, d):
    return extract.docstrings(files(spark, d))


@query(WITH + FILES_SQL + """ SELECT path, 13 AS line, 'named' AS kind, 'K' || k AS name, NULL AS alias FROM files WHERE k % 4 = 1
UNION ALL SELECT path, 13, 'named', 'run' || k, 'go' FROM files WHERE k % 4 = 1 UNION ALL SELECT path, 14, 'default', 'Main', NULL FROM files WHERE k % 4 = 1""")
def source_exports(spark, d):
    return extract.exports(files(spark, d))


@query(WITH + FILES_SQL + " SELECT path, 9 AS line, 'limit' AS name, s::VARCHAR AS value FROM files JOIN p USING (k) WHERE k % 4 = 2")
def source_attributes(spark, d):
    return extract.module_attributes(files(spark, d))


@query("SELECT 'misc/r' || s_suppkey || '.rb' AS path, 'unsupported_language' AS error FROM supplier")
def source_errors(spark, d):
    return extract.unsupported(files(spark, d))


@query(WITH + SYMBOLS_SQL + """ SELECT path, line, name, CASE WHEN type = 'class' THEN 'class ' || name || CASE WHEN bases <> '' THEN '(' || replace(bases, ',', ', ') || ')' ELSE '' END
ELSE split_part(name, '/', 1) || '(' || replace(args, ',', ', ') || ')' END AS signature, visibility, contains(flags, 'async') AS async FROM symbols WHERE type IN ('function', 'macro', 'class')""")
def source_signatures(spark, d):
    return extract.signatures(extract.symbols(files(spark, d)))


@query(WITH + SYMBOLS_SQL + " SELECT path, line, type, name FROM symbols WHERE type IN ('module', 'class', 'interface')")
def source_definitions(spark, d):
    return extract.definitions(extract.symbols(files(spark, d), extract.DEFINED))


_METRICS = FILES_SQL + """, counted AS (SELECT path, language, k % 4 AS r, k, len(string_split(content, chr(10))) AS total, len(list_filter(string_split(content, chr(10)), lambda x: trim(x) = '')) AS blank FROM files),
metrics AS (SELECT path, language, total::INT AS total, (total - blank)::INT AS code, (CASE WHEN r = 1 OR r = 2 AND k % 3 = 0 THEN 1 ELSE 0 END)::INT AS comment, blank::INT AS blank, CASE r WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 2 END AS function_count,
CASE r WHEN 1 THEN 2 ELSE 1 END AS class_count, (CASE r WHEN 3 THEN 0 WHEN 2 THEN total // 3 ELSE total // 2 END)::INT AS avg_function_length FROM counted)"""


@query(WITH + _METRICS + " SELECT * FROM metrics")
def source_complexity(spark, d):
    return extract.complexity(files(spark, d))


@query(WITH + _METRICS + " SELECT language, count(*) AS files, sum(function_count)::BIGINT AS functions, sum(class_count)::BIGINT AS classes FROM metrics GROUP BY ROLLUP (language)")
def source_rollup(spark, d):
    return extract.rollup(extract.complexity(files(spark, d)))


@query(WITH + REFERENCES_SQL + ", used AS (SELECT path, string_agg(DISTINCT module, ',' ORDER BY module) AS modules FROM refs GROUP BY 1) SELECT path, modules, CASE WHEN k % 4 = 1 THEN 'K' || k || ',Main,run' || k ELSE '' END AS exported FROM files JOIN used USING (path)")
def source_dependencies(spark, d):
    return extract.file_dependencies(files(spark, d)).select("path", joined("modules").alias("modules"), joined("exported").alias("exported"))


@query(WITH + SYMBOLS_SQL + "," + REFERENCES_SQL[len(FILES_SQL) + 1 :] + """ SELECT 'language' AS kind, language AS type, count(*) AS n FROM files GROUP BY ALL UNION ALL SELECT 'language', 'unknown', count(*) FROM supplier
UNION ALL SELECT 'symbol', type, count(*) FROM symbols GROUP BY ALL UNION ALL SELECT 'reference', type, count(*) FROM refs GROUP BY ALL UNION ALL SELECT 'file', 'parsed', count(*) FROM files UNION ALL SELECT 'file', 'failed', count(*) FROM supplier""")
def source_type_counts(spark, d):
    return extract.type_counts(files(spark, d))


@query(WITH + SYMBOLS_SQL + """, c AS (SELECT count(*) FILTER (WHERE type IN ('function', 'class', 'module')) AS chunks_created, count(*) FILTER (WHERE type = 'module') AS modules, count(*) FILTER (WHERE type = 'function') AS functions, count(*) FILTER (WHERE type = 'class') AS classes FROM symbols)
SELECT (SELECT count(*) FROM files) AS files_processed, chunks_created, (SELECT count(*) FROM supplier) AS errors, modules, functions, classes FROM c""")
def index_run(spark, d):
    return extract.index_run(files(spark, d))


_CHUNKS = """, picked AS (SELECT path, type, name, line AS start_line, lead(line) OVER (PARTITION BY path ORDER BY line, name) AS after FROM symbols WHERE type IN ({types})),
cut AS (SELECT path, type, name, start_line, coalesce(after - 1, len(string_split(content, chr(10))))::INT AS end_line, string_split(content, chr(10)) AS l FROM picked JOIN files USING (path)
UNION ALL SELECT path, 'section', NULL, 1, len(string_split(content, chr(10)))::INT, string_split(content, chr(10)) FROM files WHERE path NOT IN (SELECT path FROM picked)),
chunks AS (SELECT path, type, name, start_line, end_line, sha256(array_to_string(l[start_line:end_line], chr(10))) AS h FROM cut)"""


@query(WITH + SYMBOLS_SQL + _CHUNKS.format(types="'module', 'class', 'interface', 'type', 'function', 'macro'") + " SELECT * FROM chunks")
def symbol_chunks(spark, d):
    rows = files(spark, d).where("language <> 'unknown'")
    return chunking.by_symbol(rows, extract.symbols(rows)).withColumn("h", F.sha2("content", 256)).drop("content")


@query(WITH + SYMBOLS_SQL + _CHUNKS.format(types="'function'") + " SELECT * FROM chunks")
def function_chunks(spark, d):
    rows = files(spark, d).where("language <> 'unknown'")
    return chunking.by_symbol(rows, extract.symbols(rows), ("function",)).withColumn("h", F.sha2("content", 256)).drop("content")


@query(WITH + SYMBOLS_SQL + _CHUNKS.format(types="'function', 'class', 'module'") + " SELECT 'chunk:' || path || ':' || (row_number() OVER (PARTITION BY path ORDER BY start_line, end_line) - 1) AS id, path, type, name, start_line, end_line, h FROM chunks")
def chunk_documents(spark, d):
    rows = files(spark, d).where("language <> 'unknown'")
    return chunking.as_documents(chunking.hybrid(rows, extract.symbols(rows))).withColumn("h", F.sha2("content", 256)).drop("content")


@query(WITH + FILES_SQL + """, m AS (SELECT path, 'App.M' || k AS top, k FROM files WHERE k % 4 = 2 UNION ALL SELECT path, CASE WHEN k % 8 = 3 THEN 'App.M' || (k - 1) || 'Test' ELSE 'App.Other' || k || 'Test' END, k FROM files WHERE k % 4 = 3)
SELECT 'file' AS type, count(*) AS n FROM files UNION ALL SELECT 'module', count(*) FROM m UNION ALL SELECT 'class', count(DISTINCT k) + 1 FROM (SELECT k FROM p WHERE k % 4 = 0 UNION ALL SELECT k FROM p WHERE k % 4 = 1)
UNION ALL SELECT 'function', sum(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 0 END)::BIGINT FROM p
UNION ALL SELECT 'external', (SELECT count(DISTINCT t) FROM (SELECT unnest(CASE k % 4 WHEN 0 THEN ['os', 'pkg' || s || '.mod'] WHEN 1 THEN ['./lib' || s, 'pkg', 'space', 'side' || s] WHEN 2 THEN ['App.Repo', 'Enum', 'Tool' || s] ELSE ['ExUnit.Case'] END) AS t FROM p))""")
def code_graph_nodes(spark, d):
    nodes, _ = extract.code_graph(files(spark, d).where("language <> 'unknown'"))
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


@query(WITH + FILES_SQL + """ SELECT 'App.M' || k AS source, 'App.Repo' AS target, 'alias' AS type FROM files WHERE k % 4 = 2 UNION ALL SELECT 'App.M' || k, 'Enum', 'imports' FROM files WHERE k % 4 = 2
UNION ALL SELECT 'App.M' || k, 'Tool' || s, 'uses' FROM p WHERE k % 4 = 2 UNION ALL SELECT CASE WHEN k % 8 = 3 THEN 'App.M' || (k - 1) || 'Test' ELSE 'App.Other' || k || 'Test' END, 'ExUnit.Case', 'uses' FROM p WHERE k % 4 = 3
UNION ALL SELECT path, 'App.M' || k, 'defines' FROM files WHERE k % 4 = 2 UNION ALL SELECT path, CASE WHEN k % 8 = 3 THEN 'App.M' || (k - 1) || 'Test' ELSE 'App.Other' || k || 'Test' END, 'defines' FROM files WHERE k % 4 = 3
UNION ALL SELECT 'App.M' || k, 'App.M' || k || '.' || unnest(['get/1', 'helper' || k || '/2', 'quick/1', 'bare/0']), 'defines' FROM p WHERE k % 4 = 2""")
def code_graph_edges(spark, d):
    _, edges = extract.code_graph(files(spark, d).where("language = 'elixir'"))
    return edges


@query(WITH + SYMBOLS_SQL + " SELECT DISTINCT 'file:' || path AS source, type || ':' || name AS target, 'defines' AS type FROM symbols")
def workflow_edges(spark, d):
    return extract.workflow_graph(files(spark, d))[1].distinct()


@query(WITH + FILES_SQL + " SELECT 'lib/m' || k || '.ex:get/1' AS source, 'helper' || k || '/2' AS target, 'calls' AS type FROM p WHERE k % 4 = 2")
def text_calls(spark, d):
    rows = files(spark, d).where("language = 'elixir'")
    found = extract.symbols(rows).where("type = 'function'")
    chunks = chunking.by_symbol(rows, found).where("type = 'function' and name = 'get/1'").select(F.concat_ws(":", "path", "name").alias("id"), F.substring_index(F.col("content"), "\n", 1).alias("content"))
    return extract.call_edges(chunks, found.where("name like 'helper%'").select(F.col("name").alias("id"), "name"))


# Manifests: one for each supplier, of four kinds.

_MANIFEST = {
    "mix.exs": 'app: :app<k>, mod: {App, []}, deps: [{:core, "~> 1.<k>"}, {:credo, "~> 2.0", only: [:dev]}]', "requirements.txt": "# comment\ncore==1.<k>\nflask>=2 \n-r more\n",
    "pyproject.toml": 'dependencies = ["core", "numpy", "core"]', "package.json": '{"name": "web<k>", "main": "i.js", "dependencies": {"core": "^1.<k>"}, "devDependencies": {"jest": "29"}}',
}


def _manifests(spark, d):
    k = F.col("s_suppkey")
    name, text = list(_MANIFEST), list(_MANIFEST.values())
    pick = lambda x: F.when(k % 4 == 0, x[0]).when(k % 4 == 1, x[1]).when(k % 4 == 2, x[2]).otherwise(x[3])
    return table(spark, d, "supplier").select(F.concat(F.lit("r"), k.cast("string")).alias("repo"), pick(name).alias("relative_path"), F.replace(pick(text), F.lit("<k>"), k.cast("string")).alias("content"))


@query("""WITH p AS (SELECT s_suppkey AS k FROM supplier) SELECT 'r' || k AS repo, 'core' AS dep, '~> 1.' || k AS version, 'runtime' AS scope FROM p WHERE k % 4 = 0 UNION ALL SELECT 'r' || k, 'credo', NULL, 'dev' FROM p WHERE k % 4 = 0
UNION ALL SELECT 'r' || k, 'core', '==1.' || k, 'runtime' FROM p WHERE k % 4 = 1 UNION ALL SELECT 'r' || k, 'flask', '>=2', 'runtime' FROM p WHERE k % 4 = 1 UNION ALL SELECT 'r' || k, unnest(['core', 'numpy']), NULL, 'runtime' FROM p WHERE k % 4 = 2
UNION ALL SELECT 'r' || k, 'core', '^1.' || k, 'runtime' FROM p WHERE k % 4 = 3 UNION ALL SELECT 'r' || k, 'jest', '29', 'dev' FROM p WHERE k % 4 = 3""")
def manifest_dependencies(spark, d):
    return extract.manifest_dependencies(_manifests(spark, d))


@query("""SELECT 'r' || s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'app' || s_suppkey WHEN 3 THEN 'web' || s_suppkey ELSE 'r' || s_suppkey END AS project, CASE s_suppkey % 4 WHEN 0 THEN 'application' WHEN 3 THEN 'library' ELSE 'unknown' END AS type,
CASE s_suppkey % 4 WHEN 0 THEN 'elixir' WHEN 3 THEN 'javascript' ELSE 'python' END AS language FROM supplier""")
def repository_kinds(spark, d):
    rows = _manifests(spark, d)
    return extract.project_names(rows).join(extract.repository_types(rows), "repo").join(sources.repositories(rows), "repo")


# Documentation and tests

_MODULES = FILES_SQL + """, lib AS (SELECT path, 'App.M' || k AS module, k, s FROM files JOIN p USING (k) WHERE k % 4 = 2), tst AS (SELECT path, CASE WHEN k % 8 = 3 THEN 'App.M' || (k - 1) ELSE 'App.Other' || k END || 'Test' AS module, k FROM files WHERE k % 4 = 3),
mods AS (SELECT path, module, k % 3 = 0 AS documented, CASE WHEN k % 3 = 0 THEN 'Does ' || s || '.' ELSE '' END AS description, 2 AS functions, (k % 5 <> 0)::INT AS documented_functions, (k % 5 <> 0)::INT AS examples, k % 3 < 2 AS has_moduledoc,
k % 3 <> 1 AS not_hidden, k % 5 <> 0 AS has_examples, k % 3 = 0 AS has_usage, false AS has_options, k % 5 <> 0 AS has_function_docs FROM lib
UNION ALL SELECT path, module, false, '', 0, 0, 0, false, true, false, false, false, false FROM tst),
scored AS (SELECT *, NOT not_hidden AS hidden, (has_moduledoc::INT * 30 + not_hidden::INT * 10 + has_examples::INT * 20 + has_usage::INT * 15 + has_function_docs::INT * 15) / 100 AS completeness FROM mods)"""


@query(WITH + _MODULES + " SELECT * FROM scored")
def documented_modules(spark, d):
    return docs.modules(files(spark, d)).drop("moduledoc")


@query(WITH + _MODULES + " SELECT count(*) AS modules, count(*) FILTER (WHERE documented) AS documented, round(100.0 * count(*) FILTER (WHERE documented) / count(*), 1)::DOUBLE AS coverage, count(*) FILTER (WHERE has_moduledoc AND NOT has_examples) AS issues, round(avg(completeness), 2)::DOUBLE AS avg_completeness FROM scored")
def documentation_report(spark, d):
    return docs.documentation_report(files(spark, d))


@query(WITH + _MODULES + """ SELECT module, path, 'missing_moduledoc' AS type FROM scored WHERE NOT has_moduledoc UNION ALL SELECT module, path, 'moduledoc_false' FROM scored WHERE hidden UNION ALL SELECT module, path, 'missing_examples' FROM scored WHERE NOT has_examples
UNION ALL SELECT module, path, 'missing_usage' FROM scored WHERE NOT has_usage UNION ALL SELECT module, path, 'no_examples' FROM scored WHERE has_moduledoc AND NOT has_examples UNION ALL SELECT module, path, 'incomplete_docs' FROM scored WHERE has_moduledoc AND completeness < 0.3""")
def documentation_advice(spark, d):
    mods = docs.modules(files(spark, d))
    return docs.suggestions(mods).drop("message").unionByName(docs.quality_issues(mods))


@query(WITH + _MODULES + " SELECT module, path, description FROM scored")
def module_list(spark, d):
    return docs.list_modules(files(spark, d))


@query(WITH + _MODULES + " SELECT 'App.M' || k AS module, path, description, coalesce(functions, 0) AS functions, coalesce(has_examples, false) AS has_examples FROM p LEFT JOIN scored ON module = 'App.M' || k")
def module_summaries(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("App.M"), F.col("p_partkey").cast("string")).alias("module"))
    return docs.module_summary(names, files(spark, d))


@query(WITH + _MODULES + " SELECT path, module, 'get' AS function, 'x' AS args, 1 AS arity, 'public' AS visibility FROM lib UNION ALL SELECT path, module, 'helper' || k, 'a, b', 2, 'private' FROM lib")
def module_functions(spark, d):
    return docs.functions(files(spark, d), private=True)


@query(WITH + _MODULES + " SELECT module, 'get' AS function, 1 AS arity, CASE WHEN k % 5 <> 0 THEN 'iex> get(1)' END AS description FROM lib")
def function_docs(spark, d):
    return docs.function_docs(files(spark, d))


@query(WITH + _MODULES + """ SELECT 'n' || n_nationkey AS query_id, module, function, arity FROM nation, (SELECT module, 'get' AS function, 1 AS arity FROM lib) WHERE contains('get', lower(substr('GETxyz', 1 + (n_nationkey % 4), 2)))""")
def function_search(spark, d):
    asked = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), F.expr("substr('GETxyz', 1 + (n_nationkey % 4), 2)").alias("query"))
    return docs.search_functions(files(spark, d), asked)


@query(WITH + _MODULES + """, pages AS (SELECT module AS title, CASE WHEN k % 3 = 0 THEN 'Does ' || s || '.' || chr(10) || '  ## Usage' ELSE 'No module documentation.' END || chr(10) || chr(10) || '## Functions' || chr(10) || chr(10) || '- `get/1`' || chr(10) || '- `helper' || k || '/2` (private)' AS body FROM lib
UNION ALL SELECT module, 'No module documentation.' FROM tst)
SELECT title, 'markdown' AS format, sha256('# ' || title || chr(10) || chr(10) || body || chr(10)) AS h FROM pages UNION ALL SELECT title, 'text', sha256(title || chr(10) || repeat('=', length(title)) || chr(10) || chr(10) || body || chr(10)) FROM pages
UNION ALL SELECT title, 'html', sha256('<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><title>' || title || '</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>' || title || '</h1>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) FROM pages""")
def module_pages(spark, d):
    pages = docs.module_docs(files(spark, d), private=True)
    made = [docs.formatted(pages, f).select("title", F.lit(f).alias("format"), F.sha2("output", 256).alias("h")) for f in ("markdown", "html", "text")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(WITH + _MODULES + " SELECT module, 'get' AS function, '## ' || module || '.get/1' || chr(10) || chr(10) || '```elixir' || chr(10) || 'get(x)' || chr(10) || '```' AS page FROM lib UNION ALL SELECT module, 'lost', '## lost' || chr(10) || chr(10) || 'Function not found.' FROM lib")
def function_pages(spark, d):
    names = docs.list_modules(files(spark, d)).where("path like 'lib/%'").select("module", F.explode(F.array(F.lit("get"), F.lit("lost"))).alias("function"))
    return docs.function_page(names, files(spark, d))


@query(WITH + _MODULES + " SELECT path, 'get' AS function, 'integer' AS args, 'atom' AS returns FROM lib")
def type_specs(spark, d):
    return docs.type_specs(files(spark, d))


@query(WITH + _MODULES + " SELECT path, 'iex' AS kind, 'get(1)' AS text FROM lib WHERE k % 5 <> 0")
def doc_examples(spark, d):
    return docs.examples(files(spark, d))


@query("SELECT p_brand AS type, sha256(string_agg('- ' || p_name, chr(10) ORDER BY p_name)) AS h FROM part GROUP BY 1")
def changelog(spark, d):
    out = docs.changelog(table(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("text")))
    return out.select("type", F.sha2("entry", 256).alias("h"))


@query(WITH + _MODULES + " SELECT path, module, 2 AS tests, 1 AS describes, k % 16 = 3 AS has_setup FROM tst")
def test_files(spark, d):
    return docs.test_files(files(spark, d))


@query(WITH + _MODULES + " SELECT module, path FROM lib WHERE k % 8 = 6")
def untested_modules(spark, d):
    return docs.untested_modules(files(spark, d))


@query(WITH + _MODULES + " SELECT path, 'gets ' || k AS test FROM tst UNION ALL SELECT path, 'again' FROM tst")
def test_cases(spark, d):
    return docs.test_cases(files(spark, d))


@query(WITH + _MODULES + " SELECT 'App.M' || (k - 1) AS module, path FROM tst WHERE k % 8 = 3")
def related_tests(spark, d):
    return docs.related_tests(files(spark, d))


@query(WITH + _MODULES + " SELECT module, CASE WHEN k % 8 = 2 THEN 2 ELSE 0 END AS test_count, 2 AS total_functions, CASE WHEN k % 8 = 2 THEN 1 ELSE 0 END AS covered, CASE WHEN k % 8 = 2 THEN 50.0 ELSE 0.0 END::DOUBLE AS coverage FROM lib")
def module_test_coverage(spark, d):
    return docs.module_test_coverage(files(spark, d))


@query(WITH + _MODULES + """ SELECT module, 'get' AS function, 1 AS arity, 'Add test for get/1' AS suggestion, 'test "get/1 returns expected result" do' || chr(10) || '  result = ' || module || '.get(arg1)' || chr(10) || '  assert result == :expected' || chr(10) || 'end' || chr(10) AS template FROM lib
UNION ALL SELECT module, 'helper' || k, 2, 'Add test for helper' || k || '/2', 'test "helper' || k || '/2 returns expected result" do' || chr(10) || '  result = ' || module || '.helper' || k || '(arg1, arg2)' || chr(10) || '  assert result == :expected' || chr(10) || 'end' || chr(10) FROM lib""")
def test_suggestions(spark, d):
    return docs.test_suggestions(files(spark, d))


@query(WITH + _MODULES + """, c AS (SELECT count(*) AS test_files, 2 * count(*) AS tests, count(*) AS describes, count(*) FILTER (WHERE k % 16 = 3) AS with_setup FROM tst), u AS (SELECT count(*) AS untested FROM lib WHERE k % 8 = 6)
SELECT *, round(tests / test_files, 1)::DOUBLE AS avg_tests, round(100.0 * test_files / (test_files + untested), 1)::DOUBLE AS coverage FROM c, u""")
def test_quality(spark, d):
    return docs.test_quality(files(spark, d))


# Question cases

_CODE_CASES = SYMBOLS_SQL + """, code AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY type DESC, line, name) AS n, CASE WHEN type = 'module' THEN 'What is the purpose of the ' || name || ' module?' ELSE 'What does the ' || name || ' function do?' END AS question,
CASE WHEN type = 'module' THEN substr(content, 1, 500) ELSE content END AS context, CASE WHEN type = 'module' THEN 'Module ' || name || ' provides functionality' ELSE 'The ' || split_part(name, '/', 1) || ' function performs an operation' END AS expected_answer, type || '|' || split_part(name, '/', 1) AS about
FROM symbols JOIN files USING (path) WHERE type IN ('module', 'function'))"""


@query(WITH + _CODE_CASES + " SELECT path, n::INT AS n, question, sha256(context) AS h, expected_answer, about FROM code")
def code_questions(spark, d):
    out = questions.from_code(files(spark, d))
    return out.select("path", "n", "question", F.sha2("context", 256).alias("h"), "expected_answer", F.concat(F.col("metadata")["type"], F.lit("|"), F.col("metadata")["name"]).alias("about"))


_GUIDE = "Intro\n# Part <k>\nThe first line tells what part <k> is good for.\nThe second line is longer than the first one was.\nThird\n## Short\nno\n## Use <n>\n\nUse it as long as it lasts, and then use another part\n"
_GUIDES = f"guides AS (SELECT p_partkey AS k, replace(replace('{_GUIDE}', '<k>', p_partkey::VARCHAR), '<n>', p_name) AS t FROM part)"
_DOC_CASES = _GUIDES + """, dcases AS (SELECT p_partkey AS k, 1 AS n, 'What is Part ' || p_partkey || '?' AS question, 'The first line tells what part ' || p_partkey || ' is good for.' || chr(10) || 'The second line is longer than the first one was.' || chr(10) || 'Third' AS context, 'The first line tells what part ' || p_partkey || ' is good for. The second line is longer than the first one was.' AS expected_answer FROM part
UNION ALL SELECT p_partkey, 2, 'What is Use ' || p_name || '?', 'Use it as long as it lasts, and then use another part', 'Use it as long as it lasts, and then use another part' FROM part)"""


def _doc_cases(spark, d):
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    guides = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.replace(F.replace(F.lit(_GUIDE), F.lit("<k>"), k), F.lit("<n>"), name).alias("t"))
    return questions.from_docs(guides, "k", "t")


@query(WITH + _DOC_CASES + " SELECT * FROM dcases")
def doc_questions(spark, d):
    return _doc_cases(spark, d).drop("metadata")


@query(WITH + _DOC_CASES + """ SELECT k, n, 'misleading' AS variant, question, context || chr(10) || chr(10) || '# Note: The above code is deprecated.' || chr(10) || '# Consider using the new API instead.' || chr(10) AS context, 'misleading' AS adversarial FROM dcases
UNION ALL SELECT k, n, 'irrelevant', question, context || chr(10) || chr(10) || '# Unrelated code' || chr(10) || 'def foo, do: :bar', 'irrelevant_context' FROM dcases UNION ALL SELECT k, n, 'paraphrase', replace(question, 'What is', 'Please describe'), context, 'paraphrase' FROM dcases""")
def adversarial_questions(spark, d):
    return questions.adversarial(_doc_cases(spark, d)).select("k", "n", "variant", "question", "context", F.col("metadata")["adversarial"].alias("adversarial"))


@query(WITH + _CODE_CASES + """, few AS (SELECT * FROM code WHERE n <= 5), g AS (SELECT path, count(*) AS c FROM few GROUP BY 1), every AS (SELECT path FROM files UNION ALL SELECT 'misc/r' || s_suppkey || '.rb' FROM supplier)
SELECT path AS "group", n::INT AS id, question, sha256(context) AS h FROM few UNION ALL SELECT path, (n + c + 5)::INT, question, sha256(context || chr(10) || chr(10) || '# Unrelated code' || chr(10) || 'def foo, do: :bar') FROM few JOIN g USING (path)
UNION ALL SELECT path, (coalesce(c, 0) + e.i)::INT, e.q, e.h FROM every LEFT JOIN g USING (path), (VALUES """ + ", ".join("({}, '{}', sha256('{}'))".format(i, q.replace("'", "''"), c.replace("'", "''")) for i, (q, c, _, _) in enumerate(questions.EDGE_CASES[:5], 1)) + ") e(i, q, h)")
def golden_questions(spark, d):
    return questions.golden(files(spark, d)).select("group", "id", "question", F.sha2("context", 256).alias("h"))


# Files

@query(WITH + FILES_SQL + " SELECT path, CASE k % 4 WHEN 0 THEN 'm' || k || '.py' WHEN 1 THEN 'm' || k || '.ts' WHEN 2 THEN 'm' || k || '.ex' ELSE 'm' || k || '_test.exs' END AS name, regexp_extract(path, '(\\.[a-z]+)$', 1) AS extension, language FROM files WHERE k % 4 <> 1 AND NOT contains(path, 'lib/') AND regexp_matches(path, '/m[0-9]*1?[0-9]*[02468]\\.py$|/m.*_test.exs$')")
def file_listing(spark, d):
    rows = files(spark, d).withColumns({"relative_path": F.col("path"), "size": F.length("content"), "mtime": F.lit(None).cast("timestamp")})
    return sources.listing(rows, pattern="m*", extensions=(".py", ".exs", ".ex"), exclude=("lib/",)).select("path", "name", "extension", "language")


@query(WITH + FILES_SQL + """, r AS (SELECT path, 2 + k % 3 AS a, 4 + k % 20 AS b, string_split(content, chr(10)) AS l FROM files)
SELECT path, a AS start_line, b AS end_line, array_to_string(list_transform(l[a:b], lambda x, i: lpad((a + i - 1)::VARCHAR, 4, ' ') || ' | ' || x), chr(10)) AS text, b > len(l) AS truncated FROM r""")
def line_ranges(spark, d):
    k = F.regexp_extract("path", r"m(\d+)", 1).cast("long")
    rows = files(spark, d).where("language <> 'unknown'")
    return sources.line_range(rows, rows.select("path", (2 + k % 3).cast("int").alias("start_line"), (4 + k % 20).cast("int").alias("end_line"))).drop("error")


@query("SELECT '/w/p' || s_suppkey AS path, 'p' || s_suppkey AS name, s_suppkey % 3 <> 0 AS is_new FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey <> 4")
def discovered_repositories(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("/w/p"), F.col("s_suppkey").cast("string")).alias("root"), F.col("s_suppkey").alias("k"))
    manifest = s.select(F.concat("root", F.when(F.col("k") % 2 == 0, "/.git/HEAD").otherwise("/README")).alias("path"))
    return sources.discover(manifest, s.where("k % 3 = 0").select(F.col("root").alias("path")), exclude=("**/p4/**",))


@query(WITH + FILES_SQL + ", l AS (SELECT path, language, contains(path, 'src/') OR regexp_matches(path, '_test') AS excluded FROM files) SELECT path, language AS language, excluded FROM l")
def excluded_files(spark, d):
    rows = files(spark, d).where("language <> 'unknown'")
    return rows.select("path", extract.language_of(F.col("path")).alias("language"), sources.excluded(F.col("path"), ("src/", "*_test*")).alias("excluded"))
