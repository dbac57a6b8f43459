"""Files as tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.extract import EXTENSIONS, language_of

#: Folders left out of a scan, extensions read by default, and the languages of marker files by rank.
EXCLUDED = ("deps/", "_build/", "node_modules/")
DEFAULT_EXTENSIONS = (".ex", ".exs", ".py", ".js", ".ts")
MARKERS = [
    ("mix.exs", "elixir"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("package.json", "javascript"), ("Cargo.toml", "rust"),
    ("go.mod", "go"), ("rebar.config", "erlang"), ("Gemfile", "ruby"), ("pom.xml", "java"), ("build.gradle", "java"),
]


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """A pattern is part of the path, the file's name, or (with *) a glob on the name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p) | (name == p)
        if "*" in p:
            out = out | name.rlike("".join(".*" if c == "*" else c if c.isalnum() else "\\" + c for c in p))
    return out


def relative_to(path: Column, root: Column) -> Column:
    """path without the root folder before it (schemes like file: aside); the whole path if it lies elsewhere."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z0-9]+:/*", "/"), r"/+", "/")
    start = F.concat(F.regexp_replace(bare(root), "/$", ""), F.lit("/"))
    return F.when(bare(path).startswith(start), F.substr(bare(path), F.length(start) + 1)).otherwise(bare(path))


def scan(spark: SparkSession, *folders: str, extensions: tuple[str, ...] = tuple(EXTENSIONS), languages: tuple[str, ...] | None = None, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, relative_path, language, size, mtime, content) of all source files; folders follow each other, repeats kept.
    Spark itself leaves out paths whose parts start with a dot or an underscore."""
    out = None
    for folder in folders:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        rows = _source_rows(rows, relative_to(F.col("path"), F.lit(folder)), extensions, exclude)
        out = rows if out is None else out.unionByName(rows)
    return out if languages is None else out.where(F.col("language").isin(*languages))


def from_list(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """The named files, in the same columns as a scan; relative_path is the path."""
    rows = spark.read.format("binaryFile").load(paths)
    return _source_rows(rows, F.col("path"), extensions, exclude)


def _source_rows(rows: DataFrame, relative: Column, extensions: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*extensions)).withColumn("relative_path", relative).where(~excluded(F.col("relative_path"), exclude))
    return rows.select("path", "relative_path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def listing(files: DataFrame, hidden: bool = False, pattern: str | None = None, extensions: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Name, extension, size and time of files; the content is not read. Filters: extensions, hidden paths, a glob on the name,
    excluded parts of the path. With a limit the first by path, and `truncated` tells whether there were more."""
    name, extension = F.element_at(F.split("relative_path", "/"), -1), F.regexp_extract("relative_path", r"(\.[A-Za-z0-9]+)$", 1)
    rows = files.where(F.lower(extension).isin(*extensions)) if extensions else files
    rows = rows if hidden else rows.where(~F.col("relative_path").rlike(r"(^|/)\."))
    if pattern:
        rows = rows.where(name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in pattern) + "$"))
    for part in exclude:
        rows = rows.where(~F.col("relative_path").contains(part))
    rows = rows.select("path", "relative_path", name.alias("name"), extension.alias("extension"), "size", F.col("mtime").alias("modified"), "language")
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    total = rows.agg(F.count("*").alias("_n"))
    return rows.orderBy("relative_path").limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("_n") > limit).drop("_n")


#: Files of more bytes are not read by line.
MOST_BYTES = 1_000_000


def line_range(files: DataFrame, ranges: DataFrame, most: int = 1000) -> DataFrame:
    """ranges (path, start_line, end_line): numbered lines of each range, at most so many; truncated tells if cut. Files of
    more than MOST_BYTES are rejected: no text, and `error` says so."""
    large = F.octet_length("content") > MOST_BYTES
    rows = ranges.join(files.select("path", F.when(~large, F.split("content", "\n")).alias("_l"), F.when(large, "file_too_large").alias("error")), "path")
    first = F.greatest(F.col("start_line"), F.lit(1))
    last = F.least(F.coalesce("end_line", F.size("_l")), F.size("_l"), first + F.lit(most - 1))
    numbered = F.transform(F.slice("_l", first, F.greatest(last - first + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((first + i).cast("string"), 4, " "), F.lit(" | "), x))
    return rows.select("path", "start_line", "end_line", F.array_join(numbered, "\n").alias("text"), (F.coalesce("end_line", F.size("_l")) > last).alias("truncated"), "error")


def repositories(files: DataFrame) -> DataFrame:
    """(repo, language): the language of the marker files at each repository's root, by rank."""
    names = F.array(*[F.lit(n) for n, _ in MARKERS])
    rank = F.array_position(names, F.col("relative_path"))
    best = F.min(F.when(rank > 0, rank))
    return files.groupBy("repo").agg(F.coalesce(F.try_element_at(F.array(*[F.lit(n) for _, n in MARKERS]), best.cast("int")), F.lit("unknown")).alias("language"))


def plain_pattern(pattern: str) -> str:
    """What an exclude pattern like **/x/**, x/ or x names."""
    return pattern.replace("*", "").strip("/")


def discover(manifest: DataFrame, registry: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """manifest (path) of a tree's files, registry (path): (path, name, is_new) of folders that hold a .git folder, those whose
    name is excluded left out."""
    root = F.regexp_extract("path", r"^(.*)/\.git/", 1)
    found = manifest.where(F.col("path").contains("/.git/")).select(root.alias("path")).where("path <> ''").distinct().withColumn("name", F.element_at(F.split("path", "/"), -1))
    if exclude:
        found = found.where(~F.col("name").isin(*[plain_pattern(p) for p in exclude]))
    known = registry.select("path").distinct().withColumn("_k", F.lit(True))
    return found.join(known, "path", "left").select("path", "name", F.col("_k").isNull().alias("is_new"))


def write_state(state: DataFrame, path: str) -> None:
    """Keep a snapshot (path, hash, mtime, size) as a table; an older one at the path is replaced."""
    state.select("path", "hash", "mtime", "size").write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, hash string, mtime long, size long").parquet(path)


CASE = "question string, context string, expected_answer string, metadata map<string,string>"


def write_cases(cases: DataFrame, path: str) -> None:
    """Question cases as lines of JSON."""
    cases.select("question", "context", "expected_answer", "metadata").write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """One text column as text files."""
    lines.select(column).write.mode("overwrite").text(path)
