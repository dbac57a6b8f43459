"""The registry of queries, and tables of source files, graphs and repositories that queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.common import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(array: str, sep: str = ",") -> Column:
    """An array as text; null is empty."""
    return F.coalesce(F.array_join(F.col(array).cast("array<string>"), sep), F.lit(""))


# Source files: one for each part, by its key k modulo 4: Python, TypeScript, an Elixir module, a test of the module before;
# and one of no known language for each supplier. <k> is the key, <s> the part's size, <m> the key before.

PYTHON = '''import os as system
from pkg<s>.mod import (alpha, beta as b)

@cache(<s>)
class C<k>(Base<s>, Mixin):
    """Doc of C<k>."""
    async def _load(self, x: int = <s>,
                    *rest):
        return g<k>(x)

def g<k>(y):
    return y'''
TYPESCRIPT = """import { one,
  two as t } from './lib<s>';
import def<k> from "pkg";
import * as ns from 'space';
import 'side<s>';
// function ghost(q) {}
export class K<k> extends Base<s> implements Ia, Ib {}
export interface Shape<k> extends Ia {}
type Name<k> = string;
export async function run<k>(a: number, b = 2) { return go(a); }
function* gen(x) {}
const arrow<k> = async (p, q) => p;
export { K<k>, run<k> as go };
export default class Main {}"""
ELIXIR = """defmodule App.M<k> do
<about>
  alias App.Repo, as: R
  import Enum
  use Tool<s>
  @limit <s>
<example>
  @spec get(integer) :: atom
  def get(x) when x > 0, do: helper<k>(x)
  defp helper<k>(a, b), do: a
  defmacro quick(z), do: z
  def bare, do: :ok
end"""
ABOUT = ['  @moduledoc """\n  Does <s>.\n  ## Usage\n  """', "  @moduledoc false\n\n\n", "\n\n\n"]
EXAMPLE = '  @doc """\n      iex> get(1)\n  """'
TEST = """defmodule App.<of>Test do
  use ExUnit.Case
<setup>
  describe "get" do
    test "gets <k>" do
      assert App.<of>.get(1)
    end
    test "again" do
    end
  end
end"""


def filled(template: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        template = F.replace(template, F.lit(f"<{name}>"), value.cast("string"))
    return template


def source_files(parts: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """(repo, path, language, content) of the files told above."""
    k = F.col("p_partkey")
    about = F.when(k % 3 == 0, ABOUT[0]).when(k % 3 == 1, ABOUT[1]).otherwise(ABOUT[2])
    of = F.when(k % 8 == 3, F.concat(F.lit("M"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("Other"), k.cast("string")))
    text = F.when(k % 4 == 0, PYTHON).when(k % 4 == 1, TYPESCRIPT).when(k % 4 == 2, ELIXIR).otherwise(TEST)
    text = filled(text, about=about, example=F.when(k % 5 == 0, "\n\n").otherwise(EXAMPLE), setup=F.when(k % 16 == 3, "  setup do").otherwise(""), of=of, k=k, s=F.col("p_size"))
    name = lambda before, after: F.concat(F.lit(before), k.cast("string"), F.lit(after))
    path = F.when(k % 4 == 0, name("src/m", ".py")).when(k % 4 == 1, name("web/m", ".ts")).when(k % 4 == 2, name("lib/m", ".ex")).otherwise(name("test/m", "_test.exs"))
    language = F.when(k % 4 == 0, "python").when(k % 4 == 1, "typescript").otherwise("elixir")
    rows = parts.select(F.concat(F.lit("repo"), (k % 25).cast("string")).alias("repo"), path.alias("path"), language.alias("language"), text.alias("content"))
    if suppliers is None:
        return rows
    other = suppliers.select(F.lit("misc").alias("repo"), F.concat(F.lit("misc/r"), F.col("s_suppkey").cast("string"), F.lit(".rb")).alias("path"), F.lit("unknown").alias("language"), F.lit("puts 1").alias("content"))
    return rows.unionByName(other)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a narrow table dealt to all cores by their key: its file is small, so Spark reads it in a task or two, but what is
    derived from a row is costly. They are stored, since filters on what is derived would be pushed below the exchange."""
    return stored(rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key), "spread")


def files(spark: SparkSession, d: str) -> DataFrame:
    return source_files(spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), table(spark, d, "supplier"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same files in SQL: parts p (k, s), files (k, path, language, content).
FILES_SQL = f"""p AS (SELECT p_partkey AS k, p_size AS s FROM part),
files AS (SELECT k, CASE k % 4 WHEN 0 THEN 'src/m' || k || '.py' WHEN 1 THEN 'web/m' || k || '.ts' WHEN 2 THEN 'lib/m' || k || '.ex' ELSE 'test/m' || k || '_test.exs' END AS path,
  CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'elixir' END AS language,
  replace(replace(replace(replace(replace(replace(CASE k % 4 WHEN 0 THEN {_quoted(PYTHON)} WHEN 1 THEN {_quoted(TYPESCRIPT)} WHEN 2 THEN {_quoted(ELIXIR)} ELSE {_quoted(TEST)} END,
    '<about>', CASE k % 3 WHEN 0 THEN {_quoted(ABOUT[0])} WHEN 1 THEN {_quoted(ABOUT[1])} ELSE {_quoted(ABOUT[2])} END), '<example>', CASE WHEN k % 5 = 0 THEN {_quoted(chr(10) * 2)} ELSE {_quoted(EXAMPLE)} END),
    '<setup>', CASE WHEN k % 16 = 3 THEN '  setup do' ELSE '' END), '<of>', CASE WHEN k % 8 = 3 THEN 'M' || (k - 1) ELSE 'Other' || k END), '<k>', k::VARCHAR), '<s>', s::VARCHAR) AS content FROM p)"""

#: What the extraction must find: symbols (path, language, type, name, line, visibility, arity, bases, implements, args, defaults, flags).
SYMBOLS_SQL = FILES_SQL + """,
found AS (
SELECT k, 0 AS r, 'class' AS type, 'C' || k AS name, 5 AS line, 'public' AS visibility, NULL AS arity, 'Base' || s || ',Mixin' AS bases, '' AS implements, '' AS args, '' AS defaults, '' AS flags FROM p
UNION ALL SELECT k, 0, 'function', '_load', 7, 'private', 3, '', '', 'self,x,rest', 'x=' || s, 'async' FROM p
UNION ALL SELECT k, 0, 'function', 'g' || k, 11, 'public', 1, '', '', 'y', '', '' FROM p
UNION ALL SELECT k, 1, 'class', 'K' || k, 7, 'public', NULL, 'Base' || s, 'Ia,Ib', '', '', '' FROM p
UNION ALL SELECT k, 1, 'class', 'Main', 14, 'public', NULL, '', '', '', '', '' FROM p
UNION ALL SELECT k, 1, 'interface', 'Shape' || k, 8, 'public', NULL, 'Ia', '', '', '', '' FROM p
UNION ALL SELECT k, 1, 'type', 'Name' || k, 9, 'public', NULL, '', '', '', '', '' FROM p
UNION ALL SELECT k, 1, 'function', 'run' || k, 10, 'public', 2, '', '', 'a,b', 'b=2', 'async' FROM p
UNION ALL SELECT k, 1, 'function', 'gen', 11, 'public', 1, '', '', 'x', '', 'generator' FROM p
UNION ALL SELECT k, 1, 'function', 'arrow' || k, 12, 'public', 2, '', '', 'p,q', '', 'async,arrow' FROM p
UNION ALL SELECT k, 2, 'module', 'App.M' || k, 1, 'public', NULL, '', '', '', '', '' FROM p
UNION ALL SELECT k, 2, 'function', 'get/1', 14, 'public', 1, '', '', 'x', '', '' FROM p
UNION ALL SELECT k, 2, 'function', 'helper' || k || '/2', 15, 'private', 2, '', '', 'a,b', '', '' FROM p
UNION ALL SELECT k, 2, 'macro', 'quick/1', 16, 'public', 1, '', '', 'z', '', '' FROM p
UNION ALL SELECT k, 2, 'function', 'bare/0', 17, 'public', 0, '', '', '', '', '' FROM p
UNION ALL SELECT k, 3, 'module', CASE WHEN k % 8 = 3 THEN 'App.M' || (k - 1) || 'Test' ELSE 'App.Other' || k || 'Test' END, 1, 'public', NULL, '', '', '', '', '' FROM p),
symbols AS (SELECT path, language, found.* EXCLUDE (k, r) FROM found JOIN files USING (k) WHERE r = k % 4)"""

REFERENCES_SQL = FILES_SQL + """,
said AS (
SELECT k, 0 AS r, 'import' AS type, 'import' AS kind, 'os' AS module, 1 AS line, 'os:system' AS names FROM p
UNION ALL SELECT k, 0, 'from_import', 'from_import', 'pkg' || s || '.mod', 2, 'alpha:,beta:b' FROM p
UNION ALL SELECT k, 1, 'import', 'named', './lib' || s, 1, 'one:,two:t' FROM p
UNION ALL SELECT k, 1, 'import', 'default', 'pkg', 3, 'def' || k || ':' FROM p
UNION ALL SELECT k, 1, 'import', 'namespace', 'space', 4, 'ns:' FROM p
UNION ALL SELECT k, 1, 'import', 'side_effect', 'side' || s, 5, '' FROM p
UNION ALL SELECT k, 2, 'alias', 'alias', 'App.Repo', 6, 'App.Repo:R' FROM p
UNION ALL SELECT k, 2, 'import', 'import', 'Enum', 7, '' FROM p
UNION ALL SELECT k, 2, 'use', 'use', 'Tool' || s, 8, '' FROM p
UNION ALL SELECT k, 3, 'use', 'use', 'ExUnit.Case', 2, '' FROM p),
refs AS (SELECT path, language, said.* EXCLUDE (k, r) FROM said JOIN files USING (k) WHERE r = k % 4)"""


# Calls among parts 10 and up, in blocks of five: a chain from the first to the last and a short cut from the first to the
# third; in every other block the last calls the first. A part whose key 7 divides calls the one ten further. Ten parts are a module.

CALLS_SQL = """n AS (SELECT count(*) AS n FROM part), f AS (SELECT p_partkey AS id FROM part, n WHERE p_partkey >= 10 AND p_partkey < n),
calls AS (SELECT id AS source, id + 1 AS target FROM f WHERE id % 5 < 4 UNION ALL SELECT id, id + 2 FROM f WHERE id % 5 = 0
  UNION ALL SELECT id, id - 4 FROM f WHERE id % 5 = 4 AND (id // 5) % 2 = 0 UNION ALL SELECT id, id + 10 FROM f, n WHERE id % 7 = 0 AND id + 10 < n),
own AS (SELECT 'm' || (id // 10) AS module, id FROM f)"""


#: The same calls among all parts: a call is left out only if there is no part with the key it leads to.
ALL_CALLS_SQL = """all_calls AS (SELECT p_partkey AS source, p_partkey + 1 AS target FROM part WHERE p_partkey % 5 < 4 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 5 = 0
  UNION SELECT p_partkey, p_partkey - 4 FROM part WHERE p_partkey % 5 = 4 AND (p_partkey // 5) % 2 = 0 UNION SELECT p_partkey, p_partkey + 10 FROM part WHERE p_partkey % 7 = 0),
e AS (SELECT source, target FROM all_calls WHERE target IN (SELECT p_partkey FROM part))"""


def calls(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as told above; ids are the keys as text. whole: of all parts, with every call that leads to one."""
    part = table(spark, d, "part")
    n = part.agg(F.count("*").alias("_n"))
    f = part.where("true" if whole else "p_partkey >= 10").select(F.col("p_partkey").alias("k"))
    edge = lambda rows, to: rows.select(F.col("k").alias("source"), to.alias("target"), F.lit("calls").alias("type"))
    far = f.where("k % 7 = 0") if whole else f.where("k % 7 = 0").crossJoin(F.broadcast(n)).where("k + 10 < _n")
    edges = edge(f.where("k % 5 < 4"), F.col("k") + 1).unionByName(edge(f.where("k % 5 = 0"), F.col("k") + 2))
    edges = edges.unionByName(edge(f.where("k % 5 = 4 and (k div 5) % 2 = 0"), F.col("k") - 4)).unionByName(edge(far, F.col("k") + 10))
    if whole:
        edges = edges.hint("merge").join(f.select(F.col("k").alias("target")).hint("merge"), "target", "left_semi").select("source", "target", "type")
    module = F.concat(F.lit("m"), F.expr("cast(k div 10 as string)"))
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    edges = text(edges).unionByName(f.select(module.alias("source"), F.col("k").cast("string").alias("target"), F.lit("defines").alias("type")))
    nodes = f.select(F.col("k").cast("string").alias("id"), F.lit("function").alias("type"), F.col("k").cast("string").alias("name"))
    modules = f.select(module.alias("id")).distinct()
    return nodes.unionByName(modules.select("id", F.lit("module").alias("type"), F.col("id").alias("name"))), edges


# Modules: supplier k imports k modulo 13 others, by a rule; the last five targets are external.

IMPORTS_SQL = """m AS (SELECT count(*) AS m FROM supplier), mods AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id FROM supplier),
raw AS (SELECT k, (k * 7 + unnest(range(1, (k % 13 + 1)::BIGINT))) AS t FROM mods),
imports AS (SELECT 's' || k AS source, CASE WHEN t % (m + 5) < m THEN 's' || (t % (m + 5)) ELSE 'ext' || (t % (m + 5) - m) END AS target FROM raw, m)"""


def imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    m = s.agg(F.count("*").alias("m"))
    rows = s.where("k % 13 > 0").select("k", F.explode(F.expr("sequence(1L, k % 13)")).alias("i")).crossJoin(F.broadcast(m)).withColumn("t", F.expr("(k * 7 + i) % (m + 5)"))
    target = F.when(F.col("t") < F.col("m"), F.concat(F.lit("s"), F.col("t").cast("string"))).otherwise(F.concat(F.lit("ext"), (F.col("t") - F.col("m")).cast("string")))
    edges = rows.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("source"), target.alias("target"), F.lit("imports").alias("type"))
    nodes = s.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), F.lit("module").alias("type"))
    outside = edges.where("target like 'ext%'").select(F.col("target").alias("id"), F.lit("external").alias("type")).distinct()
    return nodes.unionByName(outside).withColumn("name", F.col("id")), edges


# Repositories and relationships: one for each supplier.

REPOS_SQL = """repos AS (SELECT s_suppkey AS k, 'r' || s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name, '/p/' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'elixir' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' END AS language,
  CASE WHEN s_suppkey % 2 = 0 THEN 'library' ELSE 'application' END AS type, CASE s_suppkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'blocked' WHEN 2 THEN 'active' END AS status FROM supplier),
relations AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'depends_on' WHEN s_suppkey % 3 = 1 THEN 'port_of' ELSE 'likes' END AS type, 'r' || s_suppkey AS "from", 'r' || (s_suppkey * 3 % 10) AS "to" FROM supplier)"""


def repos(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 11 != 0, F.col("s_name")).alias("name"), F.concat(F.lit("/p/"), k.cast("string")).alias("path"),
        F.when(k % 4 == 0, "elixir").when(k % 4 == 1, "python").when(k % 4 == 2, "rust").alias("language"), F.when(k % 2 == 0, "library").otherwise("application").alias("type"),
        F.when(k % 5 == 0, "stale").when(k % 5 == 1, "blocked").when(k % 5 == 2, "active").alias("status"), none.alias("remote_url"), F.lit(None).cast("array<string>").alias("tags"),
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.when(k % 3 == 0, "depends_on").when(k % 3 == 1, "port_of").otherwise("likes").alias("type"), F.concat(F.lit("r"), k.cast("string")).alias("from"), F.concat(F.lit("r"), (k * 3 % 10).cast("string")).alias("to"))
