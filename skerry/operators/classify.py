"""Classifying messages and errors, and reviewing diffs by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell the kind of a task.
CODE_WORDS = "code bug fix debug refactor implement function module class method test".split()
QUICK_WORDS = "yes no true false correct simple short".split()
REASONING_WORDS = "explain why analyze compare reason think understand".split()
#: Signs of credentials, calls that need care, and notes about security.
CREDENTIALS = [
    r"""(?i)password\s*=\s*["'][^"']+["']""", r"""(?i)api_key\s*=\s*["'][^"']+["']""", r"""(?i)secret\s*=\s*["'][^"']+["']""",
    r"""(?i)token\s*=\s*["'][^"']+["']""", r"sk-[a-zA-Z0-9]+", r"AKIA[A-Z0-9]{16}",
]
DANGEROUS = ["System.cmd", "Code.eval_string", "Code.eval_quoted", ":os.cmd", "File.write!", "send_resp"]
NOTES = [r"(?i)TODO.*security", r"(?i)FIXME.*security", r"(?i)TODO.*bypass", r"(?i)HACK"]
#: Words whose lines count as nesting.
NESTING = ["if ", "case ", "cond ", "with ", "fn ", "for ", "receive "]
#: Signs of kinds of errors, in order, and what to look at for each kind.
ERRORS = [("undefined", "undefined_error"), ("argument error", "argument_error"), ("function clause", "function_clause_error"), ("match", "match_error"), ("key", "key_error"), ("timeout", "timeout_error"), ("nil", "nil_error")]
ADVICE = [
    ("undefined_error", ["Check if the module/function exists", "Verify imports and aliases"]), ("argument_error", ["Check function argument types", "Verify data structures"]),
    ("match_error", ["Check pattern matching clauses", "Verify expected data format"]), ("nil_error", ["Add nil checks", "Trace where nil is introduced"]),
]
#: Phrases that tell what a question asks for, and words around what it is about.
INTENTS = [
    ("search_code", ["search", "find", "look for", "where is", "show me"]), ("get_callers", ["who calls", "callers", "called by", "uses"]),
    ("get_callees", ["what does", "callees", "calls", "dependencies of"]), ("get_imports", ["imports", "uses module", "depends on"]),
    ("graph_stats", ["stats", "overview", "summary", "structure"]), ("find_path", ["path between", "how does", "connection", "chain"]),
]
FILLER_BEFORE, FILLER_AFTER = r"(?i)^(find|search|look for|show me|where is)\s+", r"(?i)\s+(in the codebase|in the code|in the project)$"
FUNCTION_ID, MODULE_ID = r"([A-Z]\w*(?:\.[A-Z]\w*)*\.\w+/\d+|\w+/\d+)", r"([A-Z]\w*(?:\.[A-Z]\w*)*)"
#: Severities of comment types.
SEVERITY = {"security": "critical", "warning": "high", "suggestion": "medium", "info": "low"}


def task_type(message: Column) -> Column:
    """code, quick (short only), reasoning or general, by whole words."""
    words = F.split(F.lower(F.coalesce(message, F.lit(""))), r"[^a-z0-9_]+")
    has = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return F.when(has(CODE_WORDS), "code").when(has(QUICK_WORDS) & (F.length(message) < 50), "quick").when(has(REASONING_WORDS), "reasoning").otherwise("general")


def routed(messages: DataFrame, rules: DataFrame, text_col: str = "text", first: str | None = None) -> DataFrame:
    """messages with task and provider: the rule (task, provider) of the task, else that of `default`, else `first`."""
    rows = messages.withColumn("task", task_type(F.col(text_col)))
    rules = rules.groupBy("task").agg(F.min("provider").alias("provider"))
    other = rules.where("task = 'default'").agg(F.min("provider").alias("_other"))
    return rows.join(rules, "task", "left").crossJoin(F.broadcast(other)).withColumn("provider", F.coalesce("provider", "_other", F.lit(first))).drop("_other")


def intents(message: Column) -> Column:
    """What a question asks for, in fixed order; search_code if nothing is recognised."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda phrases: sum((m.contains(p).cast("int") for p in phrases), F.lit(0)) > 0
    tags = F.array_compact(F.array(*[F.when(has(phrases), F.lit(tag)) for tag, phrases in INTENTS]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("search_code")))


def asked(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with intents, query (without filler words), function_id and module_id (the query where there is none)."""
    m = F.coalesce(F.col(text_col), F.lit(""))
    query = F.trim(F.regexp_replace(F.regexp_replace(m, FILLER_BEFORE, ""), FILLER_AFTER, ""))
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(m, p, 1), F.lit("")), query)
    return messages.withColumns({"intents": intents(F.col(text_col)), "query": query, "function_id": part(FUNCTION_ID), "module_id": part(MODULE_ID)})


def critiques(responses: DataFrame, text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """responses with is_sufficient, missing_aspects, confidence (true, none and 0.5 unless the first JSON object says
    otherwise) and refine: not sufficient, or confidence below the threshold."""
    data = F.from_json(F.regexp_extract(F.coalesce(F.col(text_col), F.lit("")), r"(\{[^}]+\})", 1), "is_sufficient boolean, missing_aspects array<string>, confidence double")
    rows = responses.withColumn("_d", data)
    out = rows.withColumns({"is_sufficient": F.coalesce("_d.is_sufficient", F.lit(True)), "missing_aspects": F.coalesce("_d.missing_aspects", F.array().cast("array<string>")), "confidence": F.coalesce("_d.confidence", F.lit(0.5))}).drop("_d")
    return out.withColumn("refine", ~F.col("is_sufficient") | (F.col("confidence") < threshold))


def error_type(message: Column) -> Column:
    """The first kind whose sign the message holds; the sign of a failed match must not stand beside `clause`."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for sign, kind in reversed(ERRORS):
        met = m.contains(sign)
        if kind == "match_error":
            met = m.contains("matcherror") | (met & ~m.contains("clause"))
        out = F.when(met, kind).otherwise(out)
    return out


def error_advice(errors: DataFrame) -> DataFrame:
    """triaged errors with suggestions: by kind, after the hint to look at search results where `has_results` is set."""
    out = F.array().cast("array<string>")
    for kind, said in ADVICE:
        out = F.when(F.col("error_type") == kind, F.array(*map(F.lit, said))).otherwise(out)
    seen = F.coalesce(F.col("has_results"), F.lit(False)) if "has_results" in errors.columns else F.lit(False)
    return errors.withColumn("suggestions", F.concat(F.when(seen, F.array(F.lit("Review related code in search results"))).otherwise(F.array().cast("array<string>")), out))


def keywords(message: Column, limit: int = 10) -> Column:
    """The first distinct words of three characters or more."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), 1, limit)


def triage(errors: DataFrame, text_col: str = "message") -> DataFrame:
    """errors with module, function, error_type, keywords and a search query of the first five of them."""
    m = F.coalesce(F.col(text_col), F.lit(""))
    part = lambda p: F.nullif(F.regexp_extract(m, p, 1), F.lit(""))
    rows = errors.withColumns({"module": part(r"([A-Z]\w*(?:\.[A-Z]\w*)*)"), "function": part(r"(\w+/\d+|:\w+)"), "error_type": error_type(m), "keywords": keywords(m)})
    return rows.withColumn("query", F.array_join(F.slice(F.concat(F.array_compact(F.array("module", "function")), F.col("keywords")), 1, 5), " "))


def security_rules() -> list[tuple[str, str, str]]:
    """(kind, pattern, severity): regular expressions of all rules."""
    quote = lambda t: "".join(c if c.isalnum() else "\\" + c for c in t)
    return [*(("credential", p, "security") for p in CREDENTIALS), *(("dangerous", quote(d), "security") for d in DANGEROUS), *(("note", p, "warning") for p in NOTES)]


def rule_hits(files: DataFrame, key: str, text_col: str, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(key, rule, kind, severity): a row for each rule that a text meets. The rules are a short list; texts are read once."""
    rules = rules or security_rules()
    hits = F.array(*[F.when(F.col(text_col).rlike(p), F.struct(F.lit(i).alias("rule"), F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for i, (k, p, s) in enumerate(rules)])
    return files.select(key, F.explode(F.array_compact(hits)).alias("h")).select(key, "h.rule", "h.kind", "h.severity")


def diff_files(diffs: DataFrame) -> DataFrame:
    """diffs (diff_id, diff): (diff_id, file, added, removed, added_content) for each file; + and - lines, headers too."""
    parts = F.explode(F.filter(F.split("diff", r"(?m)^diff --git "), lambda p: p.rlike(r"^a/")))
    rows = diffs.select("diff_id", parts.alias("p")).withColumn("_l", F.split("p", "\n"))
    plus, minus = F.filter("_l", lambda x: x.startswith("+")), F.filter("_l", lambda x: x.startswith("-"))
    return rows.select("diff_id", F.regexp_extract("p", r"a/(.+?) b/", 1).alias("file"), F.size(plus).alias("added"), F.size(minus).alias("removed"), F.array_join(F.transform(plus, lambda x: F.substr(x, F.lit(2))), "\n").alias("added_content"))


def nesting(content: Column) -> Column:
    lines = F.split(content, "\n")

    def holding(word: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.contains(word)))

    return F.floor(sum((holding(k) for k in NESTING[1:]), holding(NESTING[0])) / 2)


def change_counts(diffs: DataFrame) -> DataFrame:
    """(diff_id, file, extension, added, removed): lines, without headers and blank changes."""
    parts = F.explode(F.filter(F.split("diff", r"(?m)^diff --git "), lambda p: p.rlike(r"^a/")))
    rows = diffs.select("diff_id", parts.alias("p"))
    file = F.regexp_extract("p", r"a/(.+?) b/", 1)
    return rows.select("diff_id", file.alias("file"), F.regexp_extract(file, r"(\.[A-Za-z0-9]+)$", 1).alias("extension"), F.regexp_count("p", F.lit(r"(?m)^\+[^+\n]")).alias("added"), F.regexp_count("p", F.lit(r"(?m)^-[^-\n]")).alias("removed"))


def change_summary(diffs: DataFrame) -> DataFrame:
    """(diff_id, files, added, removed, risk, suggestions): high over 500 changed lines, medium over 100; hints for many lines or files."""
    per = change_counts(diffs).groupBy("diff_id").agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if(F.col("extension") == ".ex").alias("_ex"))
    total = F.col("added") + F.col("removed")
    hints = F.array_compact(F.array(F.when(F.col("_ex") > 5, "Many Elixir files changed - ensure tests cover all changes"), F.when(F.col("added") > 200, "Consider breaking this into smaller PRs")))
    return per.select("diff_id", "files", "added", "removed", F.when(total > 500, "high").when(total > 100, "medium").otherwise("low").alias("risk"), hints.alias("suggestions"))


def comments(diffs: DataFrame, max_lines: int = 500, max_length: int = 120) -> DataFrame:
    """(diff_id, file, rule, type, message): security, nesting, style, size and missing tests; file `overall` for the last two."""
    return _comments(diff_files(diffs), max_lines, max_length)


def _comments(files: DataFrame, max_lines: int, max_length: int) -> DataFrame:
    c = F.col("added_content")
    rules = F.array(*[F.when(c.rlike(p), F.struct(F.lit(k).alias("rule"), F.lit(s).alias("type"), F.concat(F.lit("Rule "), F.lit(str(i)), F.lit(f": {k}")).alias("message"))) for i, (k, p, s) in enumerate(security_rules())])
    deep, long = nesting(c), F.size(F.filter(F.split(c, "\n"), lambda x: F.length(x) > max_length))
    bare = F.col("file").endswith(".ex") & c.rlike(r"def \w+") & ~c.contains("@doc") & ~c.contains("@moduledoc")
    note = lambda met, rule, *text: F.when(met, F.struct(F.lit(rule).alias("rule"), F.lit("suggestion").alias("type"), F.concat(*text).alias("message")))
    own = F.array(
        note(deep > 4, "nesting", F.lit("High nesting depth ("), deep.cast("string"), F.lit("). Consider extracting helper functions.")),
        note(bare, "docs", F.lit("Consider adding @doc or @moduledoc for public functions.")),
        note(long > 0, "length", long.cast("string"), F.lit(f" lines exceed {max_length} characters. Consider breaking them up.")),
    )
    found = files.select("diff_id", "file", F.explode(F.array_compact(F.concat(rules, own))).alias("h")).select("diff_id", "file", "h.rule", "h.type", "h.message")
    lib, test = F.col("file").rlike(r"^lib/.*\.ex$"), F.col("file").startswith("test/") | F.col("file").contains("_test.ex")
    per = files.groupBy("diff_id").agg(F.sum(F.col("added") + F.col("removed")).alias("lines"), F.bool_or(lib).alias("lib"), F.bool_or(test).alias("tests"))
    large = per.where(F.col("lines") > max_lines).select("diff_id", F.lit("overall").alias("file"), F.lit("size").alias("rule"), F.lit("warning").alias("type"), F.concat(F.lit("Large PR with "), F.col("lines").cast("string"), F.lit(" changed lines. Consider breaking into smaller PRs.")).alias("message"))
    untested = per.where("lib and not tests").select("diff_id", F.lit("overall").alias("file"), F.lit("tests").alias("rule"), F.lit("warning").alias("type"), F.lit("No test changes detected. Please add tests for new functionality.").alias("message"))
    return found.unionByName(large).unionByName(untested)


def file_issues(files: DataFrame, max_lines: int = 500, max_length: int = 120) -> DataFrame:
    """files (path, content), every line taken as added: (path, file, rule, severity, message)."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    rows = files.select(F.col("path").alias("diff_id"), F.col("path").alias("file"), F.size(lines).alias("added"), F.lit(0).alias("removed"), F.coalesce("content", F.lit("")).alias("added_content"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return _comments(rows, max_lines, max_length).select(F.col("diff_id").alias("path"), "file", "rule", F.coalesce(F.try_element_at(severity, F.col("type")), F.lit("medium")).alias("severity"), "message")


def issues_report(issues: DataFrame, by: str = "path") -> DataFrame:
    """(by, total, critical, high, medium, low, report): counts by severity, and all as one JSON text per group, in order."""
    levels = list(SEVERITY.values())
    body = F.array_sort(F.collect_list(F.struct("severity", "file", "rule", "message")))
    out = issues.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == v).alias(v) for v in levels], body.alias("issues"))
    report = F.to_json(F.struct("issues", F.struct("total", *levels).alias("summary")))
    return out.select(by, "total", *levels, report.alias("report"))


def review(diffs: DataFrame, max_lines: int = 500, max_length: int = 120) -> DataFrame:
    """(diff_id, files, lines, complexity, security, warnings, suggestions, status) for each diff."""
    files = diff_files(diffs).withColumn("nesting", nesting(F.col("added_content")))
    hits = rule_hits(files.withColumn("_k", F.struct("diff_id", "file")), "_k", "added_content").groupBy(F.col("_k.diff_id").alias("diff_id")).agg(F.count_if(F.col("severity") == "security").alias("security"), F.count_if(F.col("severity") == "warning").alias("notes"))
    long = F.size(F.filter(F.split("added_content", "\n"), lambda x: F.length(x) > max_length)) > 0
    undocumented = F.col("file").endswith(".ex") & F.col("added_content").rlike(r"\bdef\s") & ~F.col("added_content").rlike("@doc|@moduledoc")
    lib, tests = F.col("file").rlike(r"^lib/.*\.ex$"), F.col("file").rlike(r"test/|_test\.ex")
    per = files.groupBy("diff_id").agg(
        F.count("*").alias("files"), F.sum(F.col("added") + F.col("removed")).alias("lines"), F.sum("nesting").alias("nesting"), F.count_if(F.col("nesting") > 4).alias("deep"),
        F.count_if(long).alias("long"), F.count_if(undocumented).alias("undocumented"), F.bool_or(lib).alias("lib"), F.bool_or(tests).alias("tests"),
    )
    out = per.join(hits, "diff_id", "left").fillna(0, ["security", "notes"])
    warnings = F.col("notes") + (F.col("lines") > max_lines).cast("int") + (F.col("lib") & ~F.col("tests")).cast("int")
    out = out.withColumns({"complexity": F.col("files") + F.col("lines") / 100 + F.col("nesting"), "warnings": warnings, "suggestions": F.col("deep") + F.col("long") + F.col("undocumented")})
    status = F.when(F.col("security") > 0, "request_changes").when(F.col("warnings") > 0, "needs_changes").otherwise("approved")
    return out.select("diff_id", "files", "lines", "complexity", "security", "warnings", "suggestions", status.alias("status"))
