"""Index tables read off the star-schema tables, so that every operator runs on them; VIEWS has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["class", "interface", "function", "type", "enum", "constant", "variable", "method", "property", "text"]
_FILE = "concat('/ws/', CASE WHEN {k} % 23 = 0 THEN 'node_modules/pkg' WHEN {k} % 29 = 0 THEN 'lib/dist' ELSE 'src/mod' END, CAST({k} % 40 AS {s}), '/', CASE WHEN {k} % 31 = 0 THEN 'index' WHEN {k} % 37 = 0 THEN 'unit.spec' ELSE concat('file', CAST({k} % 90 AS {s})) END, '.ts')"


def _file(k: str, text: str = "STRING") -> str:
    return _FILE.format(k=k, s=text)


def _name(key: str, words: str, dialect: str) -> str:
    if dialect == "spark":
        camel = f"array_join(transform(split({words}, ' '), x -> concat(upper(substr(x, 1, 1)), substr(x, 2))), '')"
    else:
        camel = f"array_to_string(list_transform(string_split({words}, ' '), lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2))), '')"
    full = f"concat({camel}, CASE {key} % 5 WHEN 0 THEN 'Service' WHEN 1 THEN 'State' WHEN 2 THEN '_old' ELSE '' END)"
    return f"CASE WHEN {key} % 3 = 0 THEN concat(lower(substr({full}, 1, 1)), substr({full}, 2)) ELSE {full} END"


def _symbols(dialect: str) -> str:
    text, kinds = ("STRING", "element_at(array({}), CAST(p_partkey % 10 AS INT) + 1)") if dialect == "spark" else ("VARCHAR", "list_extract([{}], CAST(p_partkey % 10 AS INTEGER) + 1)")
    return f"""
SELECT {_file('p_partkey', text)} AS uri, CAST(p_partkey AS INT) AS ordinal, {_name('p_partkey', 'p_name', dialect)} AS name,
  {kinds.format(', '.join(repr(k) for k in KINDS))} AS kind,
  CAST(p_partkey % 97 AS INT) AS line, CAST(p_size % 40 AS INT) AS character,
  CAST(p_partkey % 97 AS INT) AS start_line, 0 AS start_character, CAST(p_partkey % 97 + p_size % 9 AS INT) AS end_line, CAST(p_size AS INT) AS end_character,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS container_name,
  CASE WHEN p_partkey % 4 = 0 THEN concat('Root.', p_brand) END AS full_container_path,
  p_partkey % 3 = 1 AS is_static, p_partkey % 6 <> 0 AS is_definition,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS is_exported,
  CASE p_partkey % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'public' END AS visibility,
  CAST(p_size % 4 AS INT) AS parameters_count FROM part"""


def _refs(dialect: str) -> str:
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return f"""
SELECT {_file('l_orderkey', text)} AS uri, s.name AS symbol_name, CAST(l_linenumber * 7 + l_suppkey % 60 AS INT) AS line, CAST(l_quantity AS INT) AS character,
  CASE WHEN l_suppkey % 5 = 0 THEN h.name END AS container_name, l_linenumber = 1 AS is_import, l_returnflag = 'R' AS is_local,
  CASE WHEN l_linestatus = 'F' THEN '<global>' ELSE concat('fn', CAST(l_suppkey % 9 AS {text})) END AS scope_id
FROM lineitem JOIN symbols s ON s.ordinal = l_partkey LEFT JOIN symbols h ON h.ordinal = l_suppkey"""


def _imports(dialect: str) -> str:
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return f"""
SELECT {_file('o_orderkey', text)} AS uri, CAST(o_orderkey AS INT) AS ordinal, CASE WHEN o_orderkey % 4 = 0 THEN concat(s.name, 'Alias') ELSE s.name END AS local_name,
  CASE WHEN o_custkey % 3 = 0 THEN concat('./file', CAST(o_custkey % 90 AS {text})) WHEN o_custkey % 3 = 1 THEN concat('../mod', CAST(o_custkey % 40 AS {text}), '/file', CAST(o_custkey % 90 AS {text}), '.js') ELSE concat('../mod', CAST(o_custkey % 40 AS {text})) END AS module_specifier,
  o_orderkey % 9 = 0 AS is_default, CASE WHEN o_orderkey % 4 = 0 THEN s.name END AS exported_name
FROM orders JOIN symbols s ON s.ordinal = o_custkey"""


#: CTEs in DuckDB SQL: symbols, refs, imports, files.
VIEWS = f"""symbols AS ({_symbols('duckdb')}),
refs AS ({_refs('duckdb')}),
imports AS ({_imports('duckdb')}),
files AS (SELECT uri, count(*) AS n_symbols, CAST(sum(end_line) AS BIGINT) AS size, CAST(max(ordinal) AS BIGINT) AS mtime FROM symbols GROUP BY uri)"""


class Index:
    """The index tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text.replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}").replace("JOIN symbols", "JOIN {symbols}"), **tables)

    @property
    def symbols(self) -> DataFrame:
        return self._sql(_symbols("spark"), part=self.table("part"))

    @property
    def refs(self) -> DataFrame:
        return self._sql(_refs("spark"), lineitem=self.table("lineitem"), symbols=self.symbols)

    @property
    def imports(self) -> DataFrame:
        return self._sql(_imports("spark"), orders=self.table("orders"), symbols=self.symbols)

    @property
    def files(self) -> DataFrame:
        return self.symbols.groupBy("uri").agg(F.count("*").alias("n_symbols"), F.sum("end_line").alias("size"), F.max("ordinal").cast("long").alias("mtime"))
