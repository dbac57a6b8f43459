"""Cutting files into chunks of lines or characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Line lengths assumed when a size in characters is turned into lines.
PER_LINE = 60


def line_windows(files: DataFrame, size: int = 1500, overlap: int = 200, key: str = "path", text_col: str = "content", tail_fragments: bool = False) -> DataFrame:
    """(key, start_line, end_line, content): windows of size div 60 lines with overlap div 60 lines in common."""
    c, o = max(1, size // PER_LINE), overlap // PER_LINE
    step = max(1, c - o)
    lines = files.select(key, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_l"))
    n = F.size("_l")
    last = F.greatest(F.lit(1), n) if tail_fragments else F.greatest(F.lit(1), n - F.lit(c) + F.lit(step))
    starts = F.explode(F.sequence(F.lit(1), last, F.lit(step)))
    rows = lines.select(key, "_l", starts.alias("start_line"))
    rows = rows.where((F.col("start_line") == 1) | (F.col("start_line") <= n - F.lit(c) + F.lit(step)) & (F.col("start_line") <= n)) if not tail_fragments else rows
    end = F.least(F.col("start_line") + F.lit(c - 1), n)
    return rows.select(key, "start_line", end.alias("end_line"), F.array_join(F.slice("_l", F.col("start_line"), F.lit(c)), "\n").alias("content"))


def char_windows(files: DataFrame, size: int = 1000, overlap: int = 200, key: str = "path", text_col: str = "content") -> DataFrame:
    """(key, n, content): windows of characters; the last may be shorter. Empty texts give none."""
    step = max(1, size - overlap)
    rows = files.where(F.length(text_col) > 0).select(key, F.col(text_col).alias("_t"), F.posexplode(F.sequence(F.lit(1), F.length(text_col), F.lit(step))).alias("n", "_s"))
    return rows.select(key, "n", F.substring("_t", F.col("_s"), F.lit(size)).alias("content"))


def by_symbol(files: DataFrame, symbols: DataFrame, types: tuple[str, ...] | None = None, key: str = "path", text_col: str = "content") -> DataFrame:
    """A chunk from each symbol's line to that of the next; a file without symbols of the types is one `section`.

    The symbols of a file meet its text once, in a shuffled join: files that are derived from a narrow table look small to Spark, which
    would gather their texts in the driver to broadcast them.
    """
    s = symbols if types is None else symbols.where(F.col("type").isin(*types))
    s = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "name", "type"))).alias("_s"))
    rows = files.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).hint("merge").join(s.hint("merge"), key, "left")
    start = lambda type_, name, line, after: F.struct(type_.alias("type"), name.alias("name"), line.alias("line"), after.alias("after"))
    own = F.transform("_s", lambda x, i: start(x["type"], x["name"], x["line"], F.get(F.col("_s"), i + 1)["line"]))
    whole = F.array(start(F.lit("section"), F.lit(None).cast("string"), F.lit(1), F.lit(None).cast("int")))
    rows = rows.select(key, F.split("_t", "\n").alias("_l"), F.explode(F.coalesce(own, whole)).alias("s")).select(key, "_l", "s.*")
    end = F.greatest(F.coalesce(F.col("after") - 1, F.size("_l")), F.col("line"))
    first = F.greatest(F.col("line"), F.lit(1))
    return rows.select(key, "type", "name", F.col("line").alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_l", first, end - first + 1), "\n").alias("content"))


def hybrid(files: DataFrame, symbols: DataFrame, size: int = 1500, overlap: int = 200, key: str = "path", text_col: str = "content") -> DataFrame:
    """Chunks by symbol; those longer than twice the size are cut again by lines, with lines counted in the file."""
    chunks = by_symbol(files, symbols, ("function", "method", "class", "module"), key, text_col)
    long = (F.length("content") > 2 * size) | (F.col("type") == "section")
    parts = line_windows(chunks.where(long).select(F.struct(key, "type", "name", "start_line").alias("_of"), "content"), size, overlap, "_of")
    again = parts.select(f"_of.{key}", "_of.type", "_of.name", (F.col("_of.start_line") + F.col("start_line") - 1).alias("start_line"), (F.col("_of.start_line") + F.col("end_line") - 1).alias("end_line"), "content")
    return chunks.where(~long).unionByName(again)


def as_documents(chunks: DataFrame, key: str = "path") -> DataFrame:
    """Chunks with ids chunk:{file}:{n}, numbered by line from 0."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_line", "end_line")) - 1
    return chunks.withColumn("id", F.concat(F.lit("chunk:"), F.col(key), F.lit(":"), n.cast("string")))


def line_metrics(files: DataFrame, key: str = "path", text_col: str = "content", comment: str = r"^\s*#") -> DataFrame:
    """(key, total, code, comment, blank): code is every line that is not blank."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = files.select(key, lines.alias("_l"))
    blank = F.size(F.filter("_l", lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) == ""))
    return rows.select(key, F.size("_l").alias("total"), (F.size("_l") - blank).alias("code"), F.size(F.filter("_l", lambda x: x.rlike(comment))).alias("comment"), blank.alias("blank"))
