"""Documentation and test coverage of modules in source files: files (path, content). A file may define several modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search as ranked

#: Patterns of modules, their documentation, functions, specifications, examples and tests.
MODULE = r"defmodule\s+([A-Z][\w.]+)"
MODULEDOC, MODULEDOC_LINE = r"@moduledoc\s+(?:~[sS])?[\"']{3}([\s\S]*?)[\"']{3}", r"@moduledoc\s+\"([^\"]+)\""
FUNCTION, ANY_FUNCTION = r"\bdef\s+(\w+)\s*\(([^)]*)\)", r"\bdef(p)?\s+(\w+)\s*\(([^)]*)\)"
FUNCTION_DOC = r"@doc\s+(?:~[sS])?[\"']{1,3}([^\"']+)[\"']{1,3}\s*(?:@spec[^\n]*\s*)?def\s+(\w+)"
SPEC = r"@spec\s+(\w+)\s*\(([^)]*)\)\s*::\s*([^\n]+)"
PROMPT, FENCE = r"iex>\s*(.+)", r"```\w*\n([\s\S]*?)```"
TEST_FILE = r"(_test\.exs?|\.test\.js|_spec\.rb)$"
TEST, DESCRIBE = r"\btest\s+\"([^\"]+)\"\s+do", r"\bdescribe\s+\"[^\"]+\"\s+do"
#: Weights of completeness in percent, in the order of the flags below.
COMPLETE = {"has_moduledoc": 30, "not_hidden": 10, "has_examples": 20, "has_usage": 15, "has_options": 10, "has_function_docs": 15}
#: What to suggest where a flag is missing (or, for hidden, set).
SUGGESTIONS = [
    ("missing_moduledoc", "Add @moduledoc to document this module"), ("moduledoc_false", "Consider adding documentation instead of @moduledoc false"),
    ("missing_examples", "Add usage examples to help users"), ("missing_usage", "Add a ## Usage section"),
]


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_modules(files: DataFrame) -> DataFrame:
    """(path, module, content): the text of each module, from its head to the next one's."""
    parts = F.filter(F.split(F.coalesce("content", F.lit("")), r"(?=defmodule\s+[A-Z])"), lambda p: p.rlike(r"^" + MODULE))
    return files.select("path", F.explode(parts).alias("content")).select("path", F.regexp_extract("content", MODULE, 1).alias("module"), "content")


def modules(files: DataFrame) -> DataFrame:
    """(path, module, documented, description, functions, documented_functions, examples, flags of COMPLETE, hidden, completeness).

    description: the first line of the module's documentation; completeness: the weighed share of the flags, 0 to 1.
    """
    c = F.col("content")
    text = _trimmed(F.coalesce(F.nullif(F.regexp_extract(c, MODULEDOC, 1), F.lit("")), F.regexp_extract(c, MODULEDOC_LINE, 1)))
    count = lambda p: F.regexp_count(c, F.lit(p))
    hidden = c.contains("@moduledoc false")
    rows = split_modules(files).withColumns({
        "hidden": hidden, "has_moduledoc": c.contains("@moduledoc"), "not_hidden": ~hidden, "has_examples": c.contains("iex>") | c.contains("```"),
        "has_usage": c.rlike(r"(?i)##\s+Usage"), "has_options": c.rlike(r"(?i)##\s+Options"), "moduledoc": text, "functions": count(r"\bdef\s+\w+"),
        "documented_functions": count(r"@doc\s+[\"']{3}") + count(r"@doc\s+\"[^\"]+\""), "examples": count(r"iex>") + count(r"```\w*\n"),
    })
    rows = rows.withColumns({"documented": F.col("has_moduledoc") & ~F.col("hidden"), "description": F.element_at(F.split("moduledoc", "\n"), 1), "has_function_docs": F.col("documented_functions") > 0})
    score = sum((F.when(F.col(f), w).otherwise(0) for f, w in COMPLETE.items()), F.lit(0)) / 100
    return rows.select("path", "module", "documented", "description", "functions", "documented_functions", "examples", *COMPLETE, "hidden", score.alias("completeness"), "moduledoc")


def search_documented(docs: DataFrame, queries: DataFrame, limit: int = 20, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(query_id, id, score, rank, excerpt): of the best hits those with documentation, and their first 200 characters with blanks collapsed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.where(text.contains("@moduledoc") | text.contains("@doc")).select(F.col(id_col).alias("id"), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 200).alias("excerpt"))
    return ranked.search(docs, queries, limit, id_col=id_col, text_col=text_col).join(kept, "id").select("query_id", "id", "score", "rank", "excerpt")


def list_modules(files: DataFrame) -> DataFrame:
    """(module, path, description): each module once, that of the first path."""
    return modules(files).groupBy("module").agg(F.min(F.struct("path", "description")).alias("m")).select("module", "m.path", "m.description")


def functions(files: DataFrame, private: bool = False) -> DataFrame:
    """(path, module, function, args, arity, visibility): heads with parentheses, each name and arity once."""
    rows = split_modules(files).select("path", "module", F.explode(F.regexp_extract_all("content", F.lit(ANY_FUNCTION), 0)).alias("h"))
    args = F.trim(F.regexp_extract("h", ANY_FUNCTION, 3))
    rows = rows.select("path", "module", F.regexp_extract("h", ANY_FUNCTION, 2).alias("function"), args.alias("args"), F.when(args == "", 0).otherwise(F.size(F.split(args, ","))).alias("arity"), F.when(F.regexp_extract("h", ANY_FUNCTION, 1) == "p", "private").otherwise("public").alias("visibility"))
    rows = rows if private else rows.where("visibility = 'public'")
    return rows.groupBy("path", "module", "function", "arity").agg(F.min(F.struct("visibility", "args")).alias("x")).select("path", "module", "function", "x.args", "arity", F.col("x.visibility"))


def search_functions(files: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, query): (query_id, module, function, arity) of functions whose names hold the query, ignoring case."""
    found = functions(files).select("module", "function", "arity").distinct()
    q = queries.select("query_id", F.lower("query").alias("_q"))
    return found.join(F.broadcast(q) if ranked.is_small(q) else q, F.lower("function").contains(F.col("_q"))).select("query_id", "module", "function", "arity")


def examples(files: DataFrame) -> DataFrame:
    """(path, kind, text): prompt lines and fenced blocks."""
    pick = lambda p, kind: files.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(p), 1)).alias("text"))
    return pick(PROMPT, "iex").unionByName(pick(FENCE, "block").withColumn("text", _trimmed(F.col("text"))))


def module_summary(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (module): (module, path, description, functions, has_examples); nulls and 0 where there is no such module."""
    first = modules(files).groupBy("module").agg(F.min(F.struct("path", "description", "functions", "has_examples")).alias("m")).select("module", "m.*")
    return names.join(first, "module", "left").select("module", "path", "description", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("has_examples", F.lit(False)).alias("has_examples"))


def function_docs(files: DataFrame) -> DataFrame:
    """(module, function, arity, description): the text of the @doc right before a function; null without one."""
    said = split_modules(files).select("module", F.explode(F.regexp_extract_all("content", F.lit(FUNCTION_DOC), 0)).alias("h"))
    said = said.groupBy("module", F.regexp_extract("h", FUNCTION_DOC, 2).alias("function")).agg(F.min(_trimmed(F.regexp_extract("h", FUNCTION_DOC, 1))).alias("description"))
    return functions(files).select("module", "function", "arity").distinct().join(said, ["module", "function"], "left")


def module_docs(files: DataFrame, private: bool = False) -> DataFrame:
    """(module, title, body): Markdown of each module: its documentation, then a bullet for each function."""
    mark = F.when(F.col("visibility") == "private", " (private)").otherwise("")
    bullets = functions(files, private).groupBy("path", "module").agg(F.array_sort(F.collect_set(F.concat(F.lit("- `"), F.concat_ws("/", "function", F.col("arity").cast("string")), F.lit("`"), mark))).alias("_b"))
    rows = modules(files).join(bullets, ["path", "module"], "left")
    text = F.when(F.col("moduledoc") != "", F.col("moduledoc")).otherwise("No module documentation.")
    body = F.concat(text, F.when(F.size("_b") > 0, F.concat(F.lit("\n\n## Functions\n\n"), F.array_join("_b", "\n"))).otherwise(""))
    return rows.select("module", F.col("module").alias("title"), body.alias("body"))


def function_page(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (module, function): (module, function, page): heading and signature, or that it was not found."""
    first = functions(files).groupBy("module", "function").agg(F.min(F.struct("arity", "args")).alias("f"))
    rows = names.join(first, ["module", "function"], "left")
    page = F.concat(F.lit("## "), F.col("module"), F.lit("."), F.col("function"), F.lit("/"), F.col("f.arity").cast("string"), F.lit("\n\n```elixir\n"), F.col("function"), F.lit("("), F.col("f.args"), F.lit(")\n```"))
    return rows.select("module", "function", F.coalesce(page, F.concat(F.lit("## "), F.col("function"), F.lit("\n\nFunction not found."))).alias("page"))


def type_specs(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(SPEC), 0)).alias("s"))
    return rows.select("path", *[F.trim(F.regexp_extract("s", SPEC, i)).alias(n) for i, n in ((1, "function"), (2, "args"), (3, "returns"))])


def changelog(changes: DataFrame) -> DataFrame:
    """changes (type, text): (type, entry) with a bullet for each text."""
    bullets = F.transform(F.array_sort(F.collect_list("text")), lambda t: F.concat(F.lit("- "), t))
    return changes.groupBy("type").agg(F.array_join(bullets, "\n").alias("entry"))


def formatted(pages: DataFrame, format: str = "markdown") -> DataFrame:
    """pages (title, body) with `output`: markdown, html or text."""
    t, b = F.col("title"), F.col("body")
    html = F.concat(F.lit("<!DOCTYPE html>\n<html>\n<head><title>"), t, F.lit("</title></head>\n<body>\n<h1>"), t, F.lit("</h1>\n"), b, F.lit("\n</body>\n</html>\n"))
    kinds = {"markdown": F.concat(F.lit("# "), t, F.lit("\n\n"), b, F.lit("\n")), "html": html, "text": F.concat(t, F.lit("\n"), F.repeat(F.lit("="), F.length(t)), F.lit("\n\n"), b, F.lit("\n"))}
    return pages.withColumn("output", kinds[format])


def documentation_coverage(mods: DataFrame) -> DataFrame:
    """One row: modules, documented, coverage in percent with one decimal."""
    out = mods.agg(F.count("*").alias("modules"), F.count_if("documented").alias("documented"))
    return out.withColumn("coverage", F.when(F.col("modules") > 0, F.round(F.col("documented") * 100.0 / F.col("modules"), 1)).otherwise(0.0))


def suggestions(mods: DataFrame) -> DataFrame:
    """(module, path, type, message): what each module's documentation lacks."""
    met = (~F.col("has_moduledoc"), F.col("hidden"), ~F.col("has_examples"), ~F.col("has_usage"))
    rows = F.array_compact(F.array(*[F.when(m, F.struct(F.lit(t).alias("type"), F.lit(s).alias("message"))) for m, (t, s) in zip(met, SUGGESTIONS, strict=True)]))
    return mods.select("module", "path", F.explode(rows).alias("s")).select("module", "path", "s.type", "s.message")


def quality_issues(mods: DataFrame) -> DataFrame:
    """(module, path, type): incomplete_docs (documented, completeness under 0.3) and no_examples (documented without any)."""
    with_docs = mods.where("has_moduledoc")
    thin = with_docs.where("completeness < 0.3").select("module", "path", F.lit("incomplete_docs").alias("type"))
    return thin.unionByName(with_docs.where("not has_examples").select("module", "path", F.lit("no_examples").alias("type")))


def documentation_report(files: DataFrame) -> DataFrame:
    """One row: modules, documented, coverage, issues, avg_completeness (two decimals)."""
    mods = modules(files)
    issues = quality_issues(mods).agg(F.count("*").alias("issues"))
    mean = mods.agg(F.round(F.coalesce(F.avg("completeness"), F.lit(0.0)), 2).alias("avg_completeness"))
    return documentation_coverage(mods).crossJoin(issues).crossJoin(mean)


def test_files(files: DataFrame) -> DataFrame:
    """(path, module, tests, describes, has_setup): files that are tests by name."""
    rows = files.where(F.col("path").contains("test") & F.col("path").rlike(TEST_FILE)).withColumn("content", F.coalesce("content", F.lit("")))
    count = lambda p: F.regexp_count("content", F.lit(p))
    return rows.select("path", F.regexp_extract("content", MODULE, 1).alias("module"), count(TEST).alias("tests"), count(DESCRIBE).alias("describes"), F.col("content").rlike(r"\bsetup(_all)?\b").alias("has_setup"))


def untested_modules(files: DataFrame) -> DataFrame:
    """(module, path): modules under lib/ or src/ without a test module of their name or their name followed by Test."""
    m = split_modules(files).where(F.col("path").rlike(r"(^|/)(lib|src)/")).select("module", "path")
    t = test_files(files).select("module").distinct()
    return m.join(t, "module", "left_anti").join(t.select(F.regexp_replace("module", "Test$", "").alias("module")).distinct(), "module", "left_anti")


def test_cases(files: DataFrame) -> DataFrame:
    """(path, test): the names of tests."""
    rows = files.where(F.col("path").contains("test") & F.col("path").rlike(TEST_FILE))
    return rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(TEST), 1)).alias("test"))


def related_tests(files: DataFrame) -> DataFrame:
    """(module, path): test files that name a module; names are matched as whole words by an equality join."""
    mods = split_modules(files).where(~F.col("path").rlike(TEST_FILE)).select("module").distinct()
    tests = files.where(F.col("path").contains("test") & F.col("path").rlike(TEST_FILE))
    names = F.transform(F.regexp_extract_all("content", F.lit(r"\b([A-Z]\w*(?:\.[A-Z]\w*)*)"), 1), lambda x: F.regexp_replace(x, "Test$", ""))
    return tests.select("path", F.explode(F.array_distinct(names)).alias("module")).join(mods, "module").select("module", "path")


def module_test_coverage(files: DataFrame) -> DataFrame:
    """(module, test_count, total_functions, covered, coverage): functions whose names occur in a related test file, in percent."""
    related = related_tests(files)
    counts = related.join(test_files(files).select("path", "tests"), "path").groupBy("module").agg(F.sum("tests").alias("test_count"))
    heads = functions(files, private=True).where(~F.col("path").rlike(TEST_FILE)).select("module", "function", "arity").distinct()
    said = files.where(F.col("path").rlike(TEST_FILE)).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)"), 1))).alias("function"))
    met = related.join(said, "path").select("module", "function").distinct().withColumn("_c", F.lit(1))
    per = heads.join(met, ["module", "function"], "left").groupBy("module").agg(F.count("*").alias("total_functions"), F.count("_c").alias("covered"))
    mods = split_modules(files).where(~F.col("path").rlike(TEST_FILE)).select("module").distinct()
    out = mods.join(counts, "module", "left").join(per, "module", "left").fillna(0, ["test_count", "total_functions", "covered"])
    return out.withColumn("coverage", F.when(F.col("total_functions") > 0, F.round(F.col("covered") * 100.0 / F.col("total_functions"), 1)).otherwise(0.0))


def test_suggestions(files: DataFrame) -> DataFrame:
    """(module, function, arity, suggestion, template): a test to write for each function."""
    heads = functions(files, private=True).where(~F.col("path").rlike(TEST_FILE)).select("module", "function", "arity").distinct()
    name = F.concat_ws("/", "function", F.col("arity").cast("string"))
    args = F.when(F.col("arity") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("arity", F.lit(1))), lambda i: F.concat(F.lit("arg"), i.cast("string"))), ", ")).otherwise("")
    template = F.concat(F.lit('test "'), name, F.lit(' returns expected result" do\n  result = '), F.col("module"), F.lit("."), F.col("function"), F.lit("("), args, F.lit(")\n  assert result == :expected\nend\n"))
    return heads.select("module", "function", "arity", F.concat(F.lit("Add test for "), name).alias("suggestion"), template.alias("template"))


def test_quality(files: DataFrame) -> DataFrame:
    """One row: test_files, tests, describes, with_setup, avg_tests, untested, coverage (test files of these and untested modules, percent)."""
    out = test_files(files).agg(F.count("*").alias("test_files"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"), F.coalesce(F.sum("describes"), F.lit(0)).alias("describes"), F.count_if("has_setup").alias("with_setup"))
    out = out.crossJoin(untested_modules(files).agg(F.count("*").alias("untested")))
    share = lambda a, b, f=1.0: F.when(b > 0, F.round(a * f / b, 1)).otherwise(0.0)
    return out.withColumns({"avg_tests": share(F.col("tests"), F.col("test_files")), "coverage": share(F.col("test_files"), F.col("test_files") + F.col("untested"), 100.0)})
