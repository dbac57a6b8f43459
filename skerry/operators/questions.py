"""Question cases (question, context, expected_answer, metadata) made from code and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import docs, evaluate, extract, search
from .common import small_side, stored

#: Texts of variants and of cases at the edge.
UNRELATED = "\n\n# Unrelated code\ndef foo, do: :bar"
MISLEADING = "\n\n# Note: The above code is deprecated.\n# Consider using the new API instead.\n"
PARAPHRASES = [("What does", "Can you explain what"), ("How do I", "What's the way to"), ("What is", "Please describe"), ("does the", "is the purpose of the")]
EDGE_CASES = [
    ("", "Some context about functions", "", "empty_question"),
    ("What does this do?", "", "Unable to answer without context", "empty_context"),
    ("What is the purpose of this module?", "def func1, do: :ok\n" * 100, "The module contains multiple function definitions", "long_context"),
    ("What does `@spec` mean?", "@spec add(integer(), integer()) :: integer()", "@spec defines type specifications for functions", "special_chars"),
    ("What language is this code?", "def add(a, b):\n    return a + b", "This is Python code", "language_detection"),
    ("What does foo do?", "def foo, do: :bar\ndef foo(x), do: x", "There are multiple foo functions with different arities", "ambiguous"),
    ("How do I install dependencies?", "Run `mix deps.get` in the project directory", "Run mix deps.get to install dependencies", "non_code"),
    (
        "How are User and Account related?",
        "# File: user.ex\ndefmodule User do\n  has_one :account\nend\n\n# File: account.ex\ndefmodule Account do\n  belongs_to :user\nend\n",
        "User has one Account, and Account belongs to User", "multi_file",
    ),
    ("What happens if the file doesn't exist?", "def read(path), do: File.read!(path)", "File.read! raises an error if the file doesn't exist", "error_handling"),
    ("Is this code well-documented?", "defmodule Foo do\n  def bar, do: :baz\nend", "No, the code lacks documentation", "meta_question"),
]


def _meta(**values: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.cast("string") for v in values.values()]))


def from_code(files: DataFrame, most: int = 10) -> DataFrame:
    """(path, n, question, context, expected_answer, metadata): questions on modules, then on functions, by line, at most so many a
    file. A module's context is the first 500 characters from its head, a function's the file."""
    found = extract.symbols(files).where("type in ('module', 'function')")
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("type"), "line", "name"))
    rows = found.withColumn("n", place).where(F.col("n") <= most).join(files.select("path", "content"), "path")
    cut = docs.split_modules(files).groupBy("path", "module").agg(F.min(F.substring("content", 1, 500)).alias("_m"))
    rows = rows.join(cut.withColumnRenamed("module", "name"), ["path", "name"], "left")
    module, bare = F.col("type") == "module", F.element_at(F.split("name", "/"), 1)
    question = F.when(module, F.format_string("What is the purpose of the %s module?", "name")).otherwise(F.format_string("What does the %s function do?", "name"))
    answer = F.when(module, F.format_string("Module %s provides functionality", "name")).otherwise(F.format_string("The %s function performs an operation", bare))
    return rows.select("path", "n", question.alias("question"), F.when(module, F.coalesce("_m", F.substring("content", 1, 500))).otherwise(F.col("content")).alias("context"), answer.alias("expected_answer"), _meta(type=F.col("type"), language=F.col("language"), name=bare, arity=F.col("arity")).alias("metadata"))


def from_docs(texts: DataFrame, key: str = "path", text_col: str = "content", most: int = 10) -> DataFrame:
    """(key, n, question, context, expected_answer, metadata): a question for each section under a heading of one or two signs whose
    body is longer than 50 characters, at most so many a text."""
    sections = F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^##?\s+")
    rows = texts.select(key, F.posexplode(sections).alias("_at", "s"))
    lines = F.filter(F.split("s", "\n"), lambda x: x != "")
    rows = rows.select(key, "_at", F.trim(F.try_element_at(lines, F.lit(1))).alias("head"), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))).alias("_l"))
    rows = rows.withColumn("context", F.array_join("_l", "\n")).where(F.length("context") > 50)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where(F.col("n") <= most)
    answer = F.substring(F.array_join(F.slice("_l", 1, 2), " "), 1, 200)
    return rows.select(key, "n", F.concat(F.lit("What is "), "head", F.lit("?")).alias("question"), "context", answer.alias("expected_answer"), _meta(type=F.lit("documentation"), section=F.col("head")).alias("metadata"))


def _as(name: Column) -> Column:
    return F.map_concat(F.map_filter("metadata", lambda k, v: k != "adversarial"), F.create_map(F.lit("adversarial"), name))


def adversarial(cases: DataFrame, types: tuple[str, ...] = ("misleading", "irrelevant", "paraphrase")) -> DataFrame:
    """Each case once for each variant, with `variant`: a misleading note, unrelated code, or other words for the question."""
    question = F.col("question")
    for old, new in PARAPHRASES:
        question = F.replace(question, F.lit(old), F.lit(new))
    rows = cases.withColumn("variant", F.explode(F.array(*map(F.lit, types))))
    is_ = lambda t: F.col("variant") == t
    name = F.when(is_("irrelevant"), "irrelevant_context").otherwise(F.col("variant"))
    return rows.withColumns({
        "question": F.when(is_("paraphrase"), question).otherwise(F.col("question")),
        "context": F.when(is_("misleading"), F.concat("context", F.lit(MISLEADING))).when(is_("irrelevant"), F.concat("context", F.lit(UNRELATED))).otherwise(F.col("context")),
        "metadata": _as(name),
    })


def edge_cases(spark, count: int = 10) -> DataFrame:
    """The first of ten fixed cases at the edge."""
    rows = [(q, c, a, {"type": "edge_case", "subtype": s}) for q, c, a, s in EDGE_CASES[:count]]
    return spark.createDataFrame(rows, "question string, context string, expected_answer string, metadata map<string,string>")


def golden(files: DataFrame, per_file: int = 5, edges: int = 5) -> DataFrame:
    """(group, id, question, context, expected_answer, metadata): for each file its code cases, the edge cases, and its code cases
    with unrelated code; ids from 1 in that order."""
    fields = ("question", "context", "expected_answer", "metadata")
    code = from_code(files, per_file)
    edge = edge_cases(files.sparkSession, edges).withColumn("n", F.monotonically_increasing_id())
    code = code.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(2))))  # both forms of a case in one pass
    as_is = F.col("_k") == 0
    code = code.withColumns({"context": F.when(as_is, F.col("context")).otherwise(F.concat("context", F.lit(UNRELATED))), "metadata": F.when(as_is, F.col("metadata")).otherwise(_as(F.lit("irrelevant_context")))})
    rows = code.select("path", "_k", "n", *fields).unionByName(files.select("path").crossJoin(F.broadcast(edge)).select("path", F.lit(1).alias("_k"), F.col("n"), *fields))
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("path").orderBy("_k", "n", "question"))).select(F.col("path").alias("group"), "id", *fields)


def query_benchmark(docs_: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", text_col: str = "content", index: search.Index | None = None) -> DataFrame:
    """queries (query_id, query): recall, precision and f1 at k of the ten best hits, where those whose text holds the query are relevant.
    With an index of docs_ only the texts of hits are read from them."""
    hits = stored(search.search(docs_, queries, 10, digits=9, id_col=id_col, text_col=text_col, index=index), "hits")
    held = docs_.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).join(small_side(hits), "id").join(queries.select("query_id", "query"), "query_id")
    qrels = held.where(F.col("_t").contains(F.col("query"))).select("query_id", F.col("id").alias("doc_id"), F.lit(1).alias("grade"))
    return evaluate.retrieval_metrics(hits.select("query_id", F.col("id").alias("doc_id"), "rank"), qrels, k).select("query_id", "recall", "precision", "f1")


def benchmark_means(metrics: DataFrame) -> DataFrame:
    """One row: the means over queries."""
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in metrics.columns if c != "query_id"])
