"""Symbols and references of source files, by native regular expressions over whole contents.

A match is an entry (line, text), with the line where it stands, so heads and imports over several lines and repeated
names are told apart. All patterns of a language are tried in one pass over the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of definitions by language: type, pattern, and the groups of name, arguments or bases, and of
#: further parts by name.
SYMBOLS = {
    "python": [
        ("class", r"(?m)^[ \t]*class\s+(\w+)(?:\(([^)]*)\))?\s*:", 1, 2, {}),
        ("function", r"(?m)^[ \t]*(async\s+)?def\s+(\w+)\s*\(([^)]*)\)", 2, 3, {"async": 1}),
    ],
    "javascript": [
        ("class", r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?\bclass\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", 1, 2, {"implements": 3}),
        ("function", r"(?:export\s+)?(?:default\s+)?(async\s+)?\bfunction\s*(\*)?\s*(\w+)\s*\(([^)]*)\)", 3, 4, {"async": 1, "generator": 2}),
        ("arrow", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(?([^)=]*)\)?\s*=>", 1, 3, {"async": 2}),
        ("interface", r"(?:export\s+)?\binterface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?", 1, 2, {}),
        ("type", r"(?:export\s+)?\btype\s+(\w+)(?:<[^>]+>)?\s*=", 1, 0, {}),
    ],
    "elixir": [
        ("module", r"(?m)^[ \t]*defmodule\s+([A-Z][\w.]*)", 1, 0, {}),
        ("function", r"(?m)^[ \t]*def(p)?\s+([a-z_]\w*[?!]?)(?:\(([^)]*)\))?", 2, 3, {"private": 1}),
        ("macro", r"(?m)^[ \t]*defmacro(p)?\s+([a-z_]\w*[?!]?)(?:\(([^)]*)\))?", 2, 3, {"private": 1}),
    ],
}
#: Patterns of imports by language: type, kind, pattern, and the groups of module and names.
REFERENCES = {
    "python": [("import", "import", r"(?m)^import\s+([\w.]+)(?:\s+as\s+(\w+))?", 1, 2), ("from_import", "from_import", r"(?m)^from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n]+)", 1, 2)],
    "javascript": [
        ("import", "named", r"""\bimport\s+\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]""", 2, 1), ("import", "default", r"""\bimport\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 2, 1),
        ("import", "namespace", r"""\bimport\s+\*\s+as\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 2, 1), ("import", "side_effect", r"""\bimport\s+['"]([^'"]+)['"]""", 1, 0),
    ],
    "elixir": [
        ("import", "import", r"(?m)^[ \t]*import\s+([A-Z][\w.]*)", 1, 0), ("use", "use", r"(?m)^[ \t]*use\s+([A-Z][\w.]*)", 1, 0),
        ("alias", "alias", r"(?m)^[ \t]*alias\s+([A-Z][\w.]*)(?:,\s*as:\s*(\w+))?", 1, 2), ("require", "require", r"(?m)^[ \t]*require\s+([A-Z][\w.]*)", 1, 0),
    ],
}
#: Languages of file extensions.
EXTENSIONS = {
    ".ex": "elixir", ".exs": "elixir", ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".md": "markdown", ".txt": "text", ".json": "json", ".yml": "yaml", ".yaml": "yaml",
}
#: Lines that are comments, and other patterns of single constructs.
COMMENTS = {"python": r"^\s*#", "elixir": r"^\s*#", "javascript": r"^\s*(//|/\*|\*)"}
DECORATOR = r"(?m)^[ \t]*@(\w+)(?:\(([^)]*)\))?"
DOCSTRING = r'(?:class|def)\s+(\w+)(?:\([^)]*\))?[^:\n]*:\s*\n\s*"""([\s\S]*?)"""'
EXPORTS, EXPORT_DEFAULT = r"\bexport\s+\{([^}]+)\}", r"\bexport\s+default\s+(?:(?:async\s+)?(?:class|function)\s*\*?)?\s*(\w+)?"
ATTRIBUTE = r"(?m)^[ \t]*@(?!moduledoc|doc|spec|type|impl)([a-z_]\w*)[ \t]+([^\n]+)"
LITERAL = r"""^(-?\d[\d_.]*|"[^"]*"|:\w+|true|false|nil)$"""


def language_of(path: Column) -> Column:
    """The language of a file name's extension, else unknown."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def grammar(language: Column) -> Column:
    """The patterns that a language uses: TypeScript those of JavaScript."""
    return F.when(language == "typescript", "javascript").otherwise(language)


def without_comments(content: Column, language: Column) -> Column:
    """content with lines that are comments, and trailing // comments, made blank; lines keep their numbers."""
    marked = F.regexp_replace(content, r"(?m)^[ \t]*#[^\n]*", "")
    slashed = F.regexp_replace(F.regexp_replace(content, r"(?m)^[ \t]*(//|/\*|\*)[^\n]*", ""), r"(?<=[\s;{}])//[^\n]*", "")
    return F.when(language == "javascript", slashed).otherwise(marked)


def spots(content: Column, pattern: str) -> Column:
    """Every match of a pattern as a struct: the line of its first character that is not blank, and its text."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    between = F.split(content, pattern, -1)
    found = F.transform(F.regexp_extract_all(content, F.lit(pattern), 0), lambda m, i: F.struct(F.get(between, i).alias("s"), m.alias("m")))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("out"))

    def add(acc, x):
        here = acc["line"] + breaks(x["s"])
        own = F.struct((here + breaks(F.regexp_extract(x["m"], r"^(\s*)", 1))).alias("line"), F.trim(x["m"]).alias("text"))
        return F.struct((here + breaks(x["m"])).alias("line"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(found, start, add)["out"]


def _clean(files: DataFrame) -> DataFrame:
    rows = files.where("content is not null").select("path", "language", grammar(F.col("language")).alias("_g"), "content")
    return rows.where(F.col("_g").isin(*SYMBOLS)).withColumn("_c", without_comments(F.col("content"), F.col("_g")))


def _by_language(entries: dict[str, list[Column]]) -> Column:
    out = None
    for language, arrays in entries.items():
        own = F.concat(*arrays)
        out = F.when(F.col("_g") == language, own) if out is None else out.when(F.col("_g") == language, own)
    return out


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group) if group else F.lit("")


def pieces(text: Column) -> Column:
    """What stands between commas, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "")


def arguments(args: Column) -> Column:
    """Names of arguments: split at commas, without stars, types and defaults."""
    one = lambda a: F.regexp_replace(F.trim(F.regexp_replace(F.element_at(F.split(a, "="), 1), r":[\s\S]*$", "")), r"^\*+", "")
    return F.filter(F.transform(pieces(args), one), lambda a: a != "")


def defaults(args: Column) -> Column:
    """(name, default) of arguments that have one."""
    with_one = F.filter(pieces(args), lambda a: a.contains("="))
    return F.transform(with_one, lambda a: F.struct(F.element_at(arguments(a), 1).alias("name"), F.trim(F.regexp_replace(a, r"^[^=]*=", "")).alias("default")))


def _symbol(kind: str, pattern: str, name: int, args: int, more: dict[str, int]):
    def one(x: Column) -> Column:
        part = lambda g: _part(x["text"], pattern, g)
        flags = [F.when(part(g) != "", F.lit(f)) for f, g in more.items() if f != "implements"] + [F.lit("arrow")] * (kind == "arrow")
        return F.struct(
            F.lit("function" if kind == "arrow" else kind).alias("type"), part(name).alias("name"), x["line"].alias("line"), part(args).alias("args"),
            part(more.get("implements", 0)).alias("implements"), F.array_compact(F.array(F.lit(None).cast("string"), *flags)).alias("flags"),
        )

    return one


def _reference(type_: str, kind: str, pattern: str, module: int, names: int):
    def one(x: Column) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.lit(kind).alias("kind"), _part(x["text"], pattern, module).alias("module"), x["line"].alias("line"), _part(x["text"], pattern, names).alias("names"))

    return one


#: What an entry of a symbol is.
_ENTRIES = "array<struct<type:string,name:string,line:int,args:string,implements:string,flags:array<string>>>"
#: Types of definitions.
DEFINED = ("module", "class", "interface")


def symbols(files: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """files (path, language, content): (path, language, type, name, line, visibility, arity, bases, implements, args,
    defaults, flags). Elixir functions are name/arity. flags: async, generator, arrow. Files without content or of
    other languages give no rows. types: of these only; the others are not looked for."""
    entries: dict[str, list[Column]] = {language: [F.array().cast(_ENTRIES)] for language in SYMBOLS}
    for language, patterns in SYMBOLS.items():
        for kind, pattern, name, args, more in patterns:
            if types is not None and {"arrow": "function"}.get(kind, kind) not in types:
                continue
            entries.setdefault(language, []).append(F.transform(spots(F.col("_c"), pattern), _symbol(kind, pattern, name, args, more)))
    rows = _clean(files).select("path", "language", "_g", F.explode_outer(_by_language(entries)).alias("h")).where("h is not null").select("path", "language", "_g", "h.*")  # explode adds a filter that computes the entries once more
    callable_ = F.col("type").isin("function", "macro")
    rows = rows.withColumn("arity", F.when(callable_, F.size(arguments(F.col("args")))))
    private = F.array_contains("flags", "private") | (F.col("name").startswith("_") & (F.col("_g") == "python"))
    name = F.when((F.col("_g") == "elixir") & callable_, F.concat_ws("/", "name", F.col("arity").cast("string"))).otherwise(F.col("name"))
    typed = F.col("type").isin("class", "interface")
    return rows.select(
        "path", "language", "type", name.alias("name"), "line", F.when(private, "private").otherwise("public").alias("visibility"), "arity",
        F.when(typed, arguments(F.col("args"))).alias("bases"), F.when(F.col("type") == "class", pieces(F.col("implements"))).alias("implements"),
        F.when(callable_, arguments(F.col("args"))).alias("args"), F.when(callable_, defaults(F.col("args"))).alias("defaults"), F.array_remove("flags", "private").alias("flags"),
    )


def references(files: DataFrame) -> DataFrame:
    """(path, language, type, kind, module, line, names): names are structs of name and alias. A bare JavaScript import is
    left out if its module is also imported by name."""
    entries: dict[str, list[Column]] = {}
    for language, patterns in REFERENCES.items():
        for type_, kind, pattern, module, names in patterns:
            entries.setdefault(language, []).append(F.transform(spots(F.col("_c"), pattern), _reference(type_, kind, pattern, module, names)))
    rows = _clean(files).withColumn("_h", _by_language(entries))
    rows = rows.withColumn("_h", F.filter("_h", lambda x: (x["kind"] != "side_effect") | ~F.exists("_h", lambda y: (y["kind"] != "side_effect") & (y["module"] == x["module"]))))
    rows = rows.select("path", "language", F.explode_outer("_h").alias("h")).where("h is not null").select("path", "language", "h.*")  # explode adds a filter that computes _h once more
    named = lambda a: F.struct(F.element_at(F.split(a, r"\s+as\s+"), 1).alias("name"), F.try_element_at(F.split(a, r"\s+as\s+"), F.lit(2)).alias("alias"))
    whole = F.when((F.col("kind") == "import") & (F.col("names") != ""), F.array(F.struct(F.col("module").alias("name"), F.col("names").alias("alias"))))
    short = F.element_at(F.split("module", r"\."), -1)
    alias = F.when(F.col("kind") == "alias", F.array(F.struct(F.col("module").alias("name"), F.when(F.col("names") != "", F.col("names")).otherwise(short).alias("alias"))))
    return rows.select("path", "language", "type", "kind", "module", "line", F.coalesce(whole, alias, F.transform(pieces(F.regexp_replace("names", r"[(){}]", "")), named)).alias("names"))


def decorators(files: DataFrame) -> DataFrame:
    """(path, line, name, args) of Python decorators."""
    rows = _clean(files).where("_g = 'python'").select("path", F.explode(spots(F.col("_c"), DECORATOR)).alias("h"))
    return rows.select("path", "h.line", F.regexp_extract("h.text", DECORATOR, 1).alias("name"), F.regexp_extract("h.text", DECORATOR, 2).alias("args"))


def docstrings(files: DataFrame) -> DataFrame:
    """(path, line, name, docstring) of Python classes and functions."""
    rows = _clean(files).where("_g = 'python'").select("path", F.explode(spots(F.col("content"), DOCSTRING)).alias("h"))
    return rows.select("path", "h.line", F.regexp_extract("h.text", DOCSTRING, 1).alias("name"), F.regexp_replace(F.regexp_extract("h.text", DOCSTRING, 2), r"^\s+|\s+$", "").alias("docstring"))


def exports(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, alias): exported names of JavaScript and TypeScript; a default export may lack a name."""
    rows = _clean(files).where("_g = 'javascript'")
    lists = rows.select("path", F.explode(spots(F.col("_c"), EXPORTS)).alias("h")).select("path", "h.line", F.explode(pieces(F.regexp_extract("h.text", EXPORTS, 1))).alias("n"))
    parts = F.split("n", r"\s+as\s+")
    named = lists.select("path", "line", F.lit("named").alias("kind"), parts[0].alias("name"), F.try_element_at(parts, F.lit(2)).alias("alias"))
    default = rows.select("path", F.explode(spots(F.col("_c"), EXPORT_DEFAULT)).alias("h"))
    return named.unionByName(default.select("path", "h.line", F.lit("default").alias("kind"), F.nullif(F.regexp_extract("h.text", EXPORT_DEFAULT, 1), F.lit("")).alias("name"), F.lit(None).cast("string").alias("alias")))


def module_attributes(files: DataFrame) -> DataFrame:
    """(path, line, name, value) of Elixir modules: a literal, else `complex`."""
    rows = _clean(files).where("_g = 'elixir'").select("path", F.explode(spots(F.col("_c"), ATTRIBUTE)).alias("h"))
    value = F.trim(F.regexp_extract("h.text", ATTRIBUTE, 2))
    return rows.select("path", "h.line", F.regexp_extract("h.text", ATTRIBUTE, 1).alias("name"), F.when(value.rlike(LITERAL), value).otherwise("complex").alias("value"))


def unsupported(files: DataFrame) -> DataFrame:
    """(path, error) for files of other languages and for files without content."""
    known = F.coalesce(grammar(F.col("language")).isin(*SYMBOLS), F.lit(False))
    return files.where(~known | F.col("content").isNull()).select("path", F.when(~known, "unsupported_language").otherwise("unreadable").alias("error"))


def signatures(found: DataFrame) -> DataFrame:
    """symbols: (path, line, name, signature, visibility, async) of functions, macros and classes."""
    bare = F.element_at(F.split("name", "/"), 1)
    inside = F.array_join(F.coalesce("args", "bases", F.array().cast("array<string>")), ", ")
    text = F.when(F.col("type") == "class", F.concat(F.lit("class "), bare, F.when(F.size("bases") > 0, F.concat(F.lit("("), inside, F.lit(")"))).otherwise(""))).otherwise(F.concat(bare, F.lit("("), inside, F.lit(")")))
    return found.where("type in ('function', 'macro', 'class')").select("path", "line", "name", text.alias("signature"), "visibility", F.array_contains("flags", "async").alias("async"))


def definitions(found: DataFrame) -> DataFrame:
    """symbols that are modules, classes or interfaces."""
    return found.where("type in ('module', 'class', 'interface')").select("path", "line", "type", "name")


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def complexity(files: DataFrame) -> DataFrame:
    """(path, language, total, code, comment, blank, function_count, class_count, avg_function_length) of readable files of known
    languages; comments are code too, arrow functions do not count."""
    lines = F.split("content", "\n")
    comment = F.lit(0)
    for language, pattern in COMMENTS.items():
        comment = F.when(F.col("_g") == language, F.size(F.filter(lines, _like(pattern)))).otherwise(comment)
    blank = F.size(F.filter(lines, lambda x: ~x.rlike(r"\S")))
    count = lambda g, *kinds: sum((F.size(spots(F.col("_c"), p)) for k, p, *_ in SYMBOLS[g] if k in kinds), F.lit(0))
    per = lambda *kinds: F.when(F.col("_g") == "python", count("python", *kinds)).when(F.col("_g") == "javascript", count("javascript", *kinds)).otherwise(count("elixir", *kinds))
    rows = _clean(files).select("path", "language", F.size(lines).alias("total"), (F.size(lines) - blank).alias("code"), comment.alias("comment"), blank.alias("blank"), per("function").alias("function_count"), per("class", "module").alias("class_count"))
    return rows.withColumn("avg_function_length", F.when(F.col("function_count") > 0, F.expr("cast(total div function_count as int)")).otherwise(0))


def rollup(metrics: DataFrame) -> DataFrame:
    """(language, files, functions, classes), and all languages (null)."""
    return metrics.rollup("language").agg(F.count("*").alias("files"), F.sum("function_count").alias("functions"), F.sum("class_count").alias("classes"))


def file_dependencies(files: DataFrame) -> DataFrame:
    """(path, modules, exported): the modules that each file of a known language imports, and the names it exports. Rows of one path have those
    of all of them, a row without a path has none."""
    imported: dict[str, list[Column]] = {}
    for language, patterns in REFERENCES.items():
        for type_, kind, pattern, module, _ in patterns:
            imported.setdefault(language, []).append(F.regexp_extract_all("_c", F.lit(pattern), F.lit(module)))
    named = F.flatten(F.transform(F.regexp_extract_all("_c", F.lit(EXPORTS), 1), lambda x: F.transform(pieces(x), lambda n: F.split(n, r"\s+as\s+")[0])))
    default = F.transform(F.regexp_extract_all("_c", F.lit(EXPORT_DEFAULT), 0), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, EXPORT_DEFAULT, 1), F.lit("")), F.lit("default")))
    none = F.array().cast("array<string>")
    rows = _clean(files).select("path", F.array_distinct(_by_language(imported)).alias("m"), F.when(F.col("_g") == "javascript", F.array_distinct(F.concat(named, default))).otherwise(none).alias("x"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.where("path is not null").groupBy("path").agg(every("m").alias("modules"), every("x").alias("exported"), F.count("*").alias("n"))
    out = out.select("path", "modules", "exported", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
    return out.unionByName(rows.where("path is null").select("path", none.alias("modules"), none.alias("exported")))


def type_counts(files: DataFrame) -> DataFrame:
    """(kind, type, n): files by language, symbols and references by type, files parsed and failed."""
    known = F.coalesce(grammar(F.col("language")).isin(*SYMBOLS), F.lit(False)) & F.col("content").isNotNull()
    rows = files.select("language", grammar(F.col("language")).alias("_g"), known.alias("_known"), "content").withColumn("_c", F.when(F.col("_known"), without_comments(F.col("content"), F.col("_g"))))
    entry = lambda kind, type_, n: F.struct(F.lit(kind).alias("kind"), type_.alias("type"), n.cast("long").alias("n"))
    every = [entry("language", F.col("language"), F.lit(1)), entry("file", F.when(F.col("_known"), "parsed").otherwise("failed"), F.lit(1))]
    own = F.array(*every)
    for g in SYMBOLS:
        said = {kind: F.regexp_extract_all("_c", F.lit(pattern), F.lit(module)) for _, kind, pattern, module, _ in REFERENCES[g]}
        named = [m for kind, m in said.items() if kind != "side_effect"]
        if "side_effect" in said:  # as references leaves them out
            by_name = F.concat(*named)
            said["side_effect"] = F.filter(said["side_effect"], lambda m: ~F.array_contains(by_name, m))  # noqa: B023
        found = [entry("symbol", F.lit("function" if kind == "arrow" else kind), F.size(F.regexp_extract_all("_c", F.lit(pattern), F.lit(0)))) for kind, pattern, *_ in SYMBOLS[g]]
        found += [entry("reference", F.lit(type_), F.size(said[kind])) for type_, kind, *_ in REFERENCES[g]]
        own = F.when(F.col("_known") & (F.col("_g") == g), F.array(*every, *found)).otherwise(own)
    out = rows.select(F.explode_outer(own).alias("e")).select("e.*").where("n > 0")
    return out.groupBy("kind", "type").agg(F.sum("n").alias("n"))


def index_run(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row: files_processed, chunks_created, errors, modules, functions, classes of an indexing run with hybrid chunks."""
    from . import chunking
    from .common import stored

    found = stored(symbols(files).select("path", "type", "name", "line"), "symbols")  # read by chunks and counts
    readable = _clean(files).select("path", "language", "content")
    chunks = chunking.hybrid(readable, found, size, overlap).agg(F.count("*").alias("chunks_created"))
    kinds = found.agg(F.count_if(F.col("type") == "module").alias("modules"), F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"))
    return readable.agg(F.count("*").alias("files_processed")).crossJoin(chunks).crossJoin(unsupported(files).agg(F.count("*").alias("errors"))).crossJoin(kinds)


#: Dependencies in manifests.
MIX, MIX_DEV, MIX_NAME = r'\{:(\w+),\s*"([^"]*)"', r"\{:(\w+),[^}]*only:\s*(?::dev|:test|\[:dev|\[:test)", r"app:\s*:(\w+)"
QUOTED, REQUIREMENT_END = r'"([a-zA-Z0-9_-]+)"', r"[=<>!~\[]"


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """files (repo, relative_path, content): (repo, dep, version, scope) from mix.exs, requirements.txt, pyproject.toml and
    package.json. Runtime dependencies are those not only for development; a version is null where none is given."""
    base = F.element_at(F.split("relative_path", "/"), -1)
    rows = files.select("repo", base.alias("base"), F.coalesce("content", F.lit("")).alias("c"))
    pair = "array<struct<dep:string,version:string>>"
    entry = lambda name, version: F.struct(name.alias("dep"), F.nullif(version, F.lit("")).alias("version"))
    dev = F.regexp_extract_all("c", F.lit(MIX_DEV), 1)
    mix = F.transform(F.regexp_extract_all("c", F.lit(MIX), 0), lambda m: entry(F.regexp_extract(m, MIX, 1), F.regexp_extract(m, MIX, 2)))
    named = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    lines = F.transform(named, lambda x: entry(F.trim(F.split(x, REQUIREMENT_END)[0]), F.trim(F.regexp_replace(x, r"^[^=<>!~]*", ""))))
    package = F.from_json("c", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.array().cast(pair)
    listed = lambda f: F.coalesce(F.transform(F.map_entries(package[f]), lambda e: entry(e["key"], e["value"])), none)
    quoted = F.transform(F.array_distinct(F.regexp_extract_all("c", F.lit(QUOTED), 1)), lambda d: entry(d, F.lit(None).cast("string")))
    kinds = {"mix.exs": F.filter(mix, lambda e: ~F.array_contains(dev, e["dep"])), "requirements.txt": lines, "pyproject.toml": quoted, "package.json": listed("dependencies")}
    runtime = none
    for name, value in kinds.items():
        runtime = F.when(F.col("base") == name, value.cast(pair)).otherwise(runtime)
    only_dev = F.when(F.col("base") == "mix.exs", F.transform(dev, lambda d: entry(d, F.lit(None).cast("string"))).cast(pair)).when(F.col("base") == "package.json", listed("devDependencies").cast(pair)).otherwise(none)
    out = rows.select("repo", F.explode(runtime).alias("d"), F.lit("runtime").alias("scope")).unionByName(rows.select("repo", F.explode(only_dev).alias("d"), F.lit("dev").alias("scope")))
    return out.select("repo", "d.dep", "d.version", "scope").distinct()


def project_names(files: DataFrame) -> DataFrame:
    """(repo, project): the name in the manifest, else the repository's."""
    base = F.element_at(F.split("relative_path", "/"), -1)
    c = F.coalesce("content", F.lit(""))
    name = F.when(base == "mix.exs", F.nullif(F.regexp_extract(c, MIX_NAME, 1), F.lit(""))).when(base == "package.json", F.get_json_object(c, "$.name"))
    return files.groupBy("repo").agg(F.coalesce(F.min(name), F.first("repo")).alias("project"))


def repository_types(files: DataFrame) -> DataFrame:
    """(repo, type): application, library or unknown, by what the manifests say."""
    base = F.element_at(F.split("relative_path", "/"), -1)
    c = F.coalesce("content", F.lit(""))
    has = lambda name, test: F.coalesce(F.bool_or((base == name) & test), F.lit(False))
    out = files.groupBy("repo").agg(
        has("mix.exs", c.contains(":phoenix") | c.rlike(r"\bmod:") | c.contains("escript:")).alias("app"), has("mix.exs", F.lit(True)).alias("mix"),
        has("package.json", c.contains('"main"') | c.contains('"exports"')).alias("js_lib"), has("package.json", F.lit(True)).alias("js"), has("setup.py", F.lit(True)).alias("py"),
    )
    kind = F.when(F.col("app"), "application").when(F.col("mix"), "library").when(F.col("js_lib"), "library").when(F.col("js"), "application").when(F.col("py"), "library").otherwise("unknown")
    return out.select("repo", kind.alias("type"))


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: files define modules and classes, these define functions; imports lead to modules or external names."""
    from . import graph
    from .common import stored

    found = stored(symbols(files).select("path", "language", "type", "name", "line", "arity"), "symbols")  # read by nodes and edges
    tops = found.where("type in ('module', 'class')")
    functions = graph.enclosing(found.where("type in ('function', 'macro')"), tops)
    fid = F.concat(F.coalesce("parent", "path"), F.lit("."), F.when(F.col("language") == "elixir", F.col("name")).otherwise(F.concat_ws("/", "name", F.col("arity").cast("string"))))
    used = stored(references(files).select("path", "type", F.col("module").alias("name"), "line"), "references")
    refs = graph.enclosing(used, tops, inclusive=True)
    kind = F.when(F.col("type") == "use", "uses").when(F.col("type") == "alias", "alias").otherwise("imports")
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"))
    nodes = nodes.unionByName(tops.select(F.col("name").alias("id"), "type", "name")).unionByName(functions.select(fid.alias("id"), F.lit("function").alias("type"), "name"))
    nodes = nodes.dropDuplicates(["id"])
    edges = tops.select(F.col("path").alias("source"), F.col("name").alias("target"), F.lit("defines").alias("type"))
    edges = edges.unionByName(functions.select(F.coalesce("parent", "path").alias("source"), fid.alias("target"), F.lit("defines").alias("type")))
    edges = edges.unionByName(refs.select(F.coalesce("parent", "path").alias("source"), F.col("name").alias("target"), kind.alias("type")))
    outside = edges.select(F.col("target").alias("id")).distinct().hint("merge").join(nodes.select("id").hint("merge"), "id", "left_anti")
    return nodes.unionByName(outside.select("id", F.lit("external").alias("type"), F.col("id").alias("name"))), edges


def workflow_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes file:path and type:name, and edges from files to what they define."""
    found = symbols(files).withColumn("id", F.concat_ws(":", "type", "name"))
    nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"))
    nodes = nodes.unionByName(found.select("id", "type", "name").dropDuplicates(["id"]))
    return nodes, found.select(F.concat(F.lit("file:"), "path").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"))


def call_edges(chunks: DataFrame, functions: DataFrame) -> DataFrame:
    """chunks (id, content) of functions and functions (id, name): calls where a known name stands before a parenthesis."""
    said = chunks.select(F.col("id").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*[?!]?)\("), 1)).alias("name"))
    names = functions.select(F.col("id").alias("target"), F.element_at(F.split("name", "/"), 1).alias("name"))
    return said.join(names, "name").where("source <> target").select("source", "target", F.lit("calls").alias("type"))
