"""Registered queries of the engine over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..extract import words
from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import cursor, graph, liveness, resolve, search, stats
from ..sources.testtables import VIEWS, Index
from . import extraction

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Index(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{VIEWS}\n{sql}" if views else sql
        return f

    return add


def _boundaries(n: str) -> str:
    return f"array_to_string(list_filter([CASE WHEN i = 1 OR (regexp_matches(substr({n}, i, 1), '[A-Z]') AND regexp_matches(substr({n}, i - 1, 1), '[a-z]')) OR (regexp_matches(substr({n}, i, 1), '[A-Za-z]') AND regexp_matches(substr({n}, i - 1, 1), '[^A-Za-z]')) THEN substr({n}, i, 1) END for i in range(1, length({n}) + 1)], lambda x: x IS NOT NULL), '')"


def _fuzzy(n: str, q: str) -> str:
    """The score in SQL; the greedy positions are written out, a CTE level for each character."""
    return f"CASE WHEN {n} = '{q}' THEN 100.0 WHEN lower({n}) = lower('{q}') THEN 90.0 WHEN upper({_boundaries(n)}) LIKE '%{'%'.join(q.upper())}%' THEN 80.0 WHEN starts_with(lower({n}), lower('{q}')) THEN 70.0 WHEN contains({n}, '{q}') THEN 50.0 WHEN {n} ILIKE '%{'%'.join(q)}%' THEN sub END"


def _scored(table: str, q: str, columns: str = "*") -> str:
    """A CTE chain g0, g1, ... with the greedy subsequence score as column sub."""
    out = f"g0 AS (SELECT {columns}, 0 AS pos, 0 AS run, 0.0::DOUBLE AS sub FROM {table})"
    for k, c in enumerate(q):
        p = "pos + strpos(substr(lower(name), pos + 1), '{}')".format(c.lower())
        out += f""",
g{k + 1}a AS (SELECT * EXCLUDE (pos), pos AS last, {p} AS pos FROM g{k}),
g{k + 1}b AS (SELECT * EXCLUDE (run), CASE WHEN pos = last + 1 THEN run + 1 ELSE 0 END AS run, substr(name, pos, 1) AS h, CASE WHEN pos > 1 THEN substr(name, pos - 1, 1) ELSE '' END AS b FROM g{k + 1}a),
g{k + 1} AS (SELECT * EXCLUDE (sub, h, b, last), sub + 2 + run * 3 + CASE WHEN pos > 1 AND ((regexp_matches(h, '[A-Z]') AND regexp_matches(b, '[a-z]')) OR (regexp_matches(h, '[A-Za-z]') AND regexp_matches(b, '[^A-Za-z]'))) THEN 5 ELSE 0 END
  + CASE WHEN pos > 1 AND b IN ('_', '-', '.', '/', '\\') THEN 3 ELSE 0 END + greatest(0.0, 2 * (1 - (pos - 1) / length(name))) + CASE WHEN h = '{c}' THEN 1 ELSE 0 END AS sub FROM g{k + 1}b)"""
    return out + f",\ngreedy AS (SELECT * EXCLUDE (sub), least(39.0, sub) AS sub FROM g{len(q)})"


_KIND_BONUS = "CASE WHEN kind IN ('class', 'interface', 'enum') THEN 15 WHEN kind = 'function' THEN 10 ELSE 0 END"
_DIR = "regexp_replace({0}, '/[^/]*$', '')"
_KIND_RANK = "CASE kind WHEN 'class' THEN 1 WHEN 'function' THEN 2 WHEN 'interface' THEN 3 WHEN 'enum' THEN 4 WHEN 'type' THEN 5 WHEN 'variable' THEN 6 WHEN 'constant' THEN 7 WHEN 'method' THEN 8 WHEN 'property' THEN 9 ELSE 999 END"
_WORDS = "doc_words AS (SELECT doc_id, CAST(l - 1 AS INT) AS line, s, unnest(regexp_extract_all(s, '\\b[a-zA-Z_][a-zA-Z0-9_]{2,}\\b')) AS name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM documents))"


# --- search and ranking


@query(f", {_scored('symbols', 'rbo')}, f AS (SELECT *, {_fuzzy('name', 'rbo')} AS f FROM greedy), s AS (SELECT *, round(f + {_KIND_BONUS}, 6) AS score FROM f WHERE f IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY uri, line, character ORDER BY score DESC, name, ordinal) AS n FROM s) SELECT uri, name, kind, line, character, CAST(score AS DOUBLE) AS score FROM d WHERE n = 1 ORDER BY score DESC, name, uri, line, character LIMIT 200")
def symbol_search(x: Index) -> DataFrame:
    return search.search(x.symbols, "rbo").select("uri", "name", "kind", "line", "character", "score")


@query(f", {_scored('symbols', 'rS')}, f AS (SELECT *, {_fuzzy('name', 'rS')} AS f FROM greedy) SELECT ordinal, CAST(round(f, 6) AS DOUBLE) AS score FROM f WHERE f IS NOT NULL")
def fuzzy_scores(x: Index) -> DataFrame:
    return x.symbols.select("ordinal", F.round(S.fuzzy_score(F.col("name"), "rS"), 6).alias("score")).where("score is not null")


@query(f", {_scored('symbols', 'wid')}, f AS (SELECT *, {_fuzzy('name', 'wid')} AS f FROM greedy), s AS (SELECT *, round(f + {_KIND_BONUS} + CASE WHEN uri = '/ws/src/mod3/file3.ts' THEN 100 ELSE 0 END - CASE WHEN contains(uri, 'node_modules') THEN 50 ELSE 0 END - CASE WHEN contains(uri, '/dist/') OR contains(uri, '/out/') OR contains(uri, '/build/') THEN 30 ELSE 0 END + CASE WHEN {_DIR.format('uri')} = '/ws/src/mod5' THEN 30 ELSE 0 END + CASE WHEN contains(uri, '/src/') THEN 10 ELSE 0 END, 6) AS score FROM f WHERE f IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY uri, line, character ORDER BY score DESC, name, ordinal) AS n FROM s) SELECT uri, name, CAST(score AS DOUBLE) AS score FROM d WHERE n = 1 ORDER BY score DESC, name, uri, line, character LIMIT 50")
def symbol_search_in_context(x: Index) -> DataFrame:
    return search.search(x.symbols, "wid", 50, ["/ws/src/mod3/file3.ts"], "/ws/src/mod5/file5.ts").select("uri", "name", "score")


@query("SELECT uri, name, ordinal, CASE WHEN name = 'RedBoltState' THEN 100.0 ELSE 1.0 END * CASE WHEN is_definition THEN 2.0 ELSE 1.0 END * CASE WHEN is_exported THEN 1.5 ELSE 1.0 END AS relevance FROM symbols WHERE contains(lower(name), 'redboltstate') ORDER BY relevance DESC, name, uri, ordinal LIMIT 100".replace("100.0 ELSE 1.0 END", "CAST(100 AS DOUBLE) ELSE 1 END"))
def relevance_top_k(x: Index) -> DataFrame:
    return search.relevance(x.symbols, "RedBoltState").select("uri", "name", "ordinal", "relevance")


@query("SELECT uri, name, ordinal, CASE WHEN name = 'RedBolt' THEN CAST(200 AS DOUBLE) WHEN starts_with(lower(name), 'redbolt') THEN 5 ELSE 1 END * CASE WHEN is_definition THEN 2.0 ELSE 1.0 END * CASE WHEN is_exported THEN 1.5 ELSE 1.0 END AS relevance FROM symbols WHERE contains(lower(name), 'redbolt') ORDER BY relevance DESC, name, uri, ordinal LIMIT 100")
def relevance_with_prefix(x: Index) -> DataFrame:
    return search.relevance(x.symbols, "RedBolt", exact=200, prefix=5).select("uri", "name", "ordinal", "relevance")


@query("SELECT uri, ordinal, name FROM symbols WHERE contains(lower(name), 'gear') ORDER BY name, uri, ordinal LIMIT 100")
def contains_search(x: Index) -> DataFrame:
    return x.symbols.where(F.lower("name").contains("gear")).select("uri", "ordinal", "name").orderBy("name", "uri", "ordinal").limit(100)


@query(f", {_scored('symbols', 'red')}, f AS (SELECT *, {_fuzzy('name', 'red')} + {_KIND_BONUS} AS score FROM greedy), p AS (SELECT *, row_number() OVER (PARTITION BY uri, line, character ORDER BY round(score, 6) DESC, name, ordinal) AS a FROM f WHERE score IS NOT NULL), v AS (SELECT * FROM p WHERE a = 1 AND NOT (uri <> '/ws/src/mod3/file3.ts' AND coalesce(visibility, '') = 'private') AND NOT (uri <> '/ws/src/mod3/file3.ts' AND container_name IS NULL AND coalesce(NOT is_exported, false))), t AS (SELECT *, concat(CASE WHEN uri = '/ws/src/mod3/file3.ts' THEN '0' WHEN is_exported THEN '1' ELSE '2' END, CASE WHEN kind IN ('function', 'method') THEN '1' WHEN kind IN ('class', 'interface') THEN '2' WHEN kind IN ('variable', 'constant') THEN '3' WHEN kind IN ('type', 'enum') THEN '4' ELSE '5' END, lower(name)) AS sort_text, row_number() OVER (PARTITION BY name ORDER BY round(score, 6) DESC, uri, ordinal) AS n FROM v) SELECT name, kind, uri, sort_text FROM t WHERE n = 1 ORDER BY sort_text, name LIMIT 50")
def completion(x: Index) -> DataFrame:
    return search.complete(x.symbols, "red", "/ws/src/mod3/file3.ts").select("name", "kind", "uri", "sort_text")


@query("SELECT name, uri, ordinal, kind, concat(kind, ' ', CASE WHEN coalesce(container_name, '') <> '' THEN concat(container_name, '.') ELSE '' END, name) AS signature FROM symbols WHERE name = 'RedBoltState' ORDER BY uri <> '/ws/src/mod1/file1.ts', kind <> 'class', uri, ordinal LIMIT 1")
def hover(x: Index) -> DataFrame:
    return search.hover(x.symbols, "RedBoltState", "/ws/src/mod1/file1.ts", "class").select("name", "uri", "ordinal", "kind", "signature")


_SITES = "sites AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS site_id, min(symbol_name) AS name, min(site_uri) AS site_uri, min(container) AS container FROM (SELECT l_orderkey, l_linenumber, s.name AS symbol_name, concat('/ws/src/mod', CAST(l_orderkey % 40 AS VARCHAR), '/file', CAST(l_orderkey % 90 AS VARCHAR), '.ts') AS site_uri, CASE WHEN l_orderkey % 3 = 0 THEN s.container_name END AS container FROM lineitem JOIN symbols s ON s.ordinal = l_partkey) GROUP BY l_orderkey, l_linenumber)"


def _sites(x: Index) -> DataFrame:
    key = F.col("l_orderkey")
    rows = x.table("lineitem").join(x.symbols.select(F.col("ordinal").alias("l_partkey"), "name", "container_name"), "l_partkey")
    rows = rows.select((key * 10 + F.col("l_linenumber")).cast("long").alias("site_id"), "name", F.concat(F.lit("/ws/src/mod"), (key % 40).cast("string"), F.lit("/file"), (key % 90).cast("string"), F.lit(".ts")).alias("site_uri"), F.when(key % 3 == 0, F.col("container_name")).alias("container"))
    return rows.groupBy("site_id").agg(F.min("name").alias("name"), F.min("site_uri").alias("site_uri"), F.min("container").alias("container"))


_DEPTH = "list_aggregate([CASE WHEN list_slice(string_split({a}, '/'), 1, i) = list_slice(string_split({b}, '/'), 1, i) THEN 1 ELSE 0 END for i in range(1, least(len(string_split({a}, '/')), len(string_split({b}, '/'))) + 1)], 'sum')"
_PROXIMITY = f"CASE WHEN d = s THEN 100 WHEN d = {_DIR.format('s')} THEN 70 WHEN {_DIR.format('d')} = {_DIR.format('s')} THEN 50 WHEN {_DEPTH.format(a='d', b='s')} >= 3 THEN 30 ELSE 0 END - CASE WHEN contains(uri, 'node_modules') THEN 80 ELSE 0 END - CASE WHEN contains(uri, '/dist/') OR contains(uri, '/out/') OR contains(uri, '/build/') THEN 40 ELSE 0 END + CASE WHEN NOT contains(uri, 'node_modules') AND NOT (contains(uri, '/dist/') OR contains(uri, '/out/') OR contains(uri, '/build/')) THEN 20 ELSE 0 END + CASE WHEN contains(uri, '/src/') THEN 10 ELSE 0 END"


@query(f", {_SITES}, j AS (SELECT site_id, site_uri, container, symbols.*, {_DIR.format('uri')} AS d, {_DIR.format('site_uri')} AS s, coalesce(container_name = container, false) AS m FROM sites JOIN symbols USING (name)), k AS (SELECT *, bool_or(m) OVER (PARTITION BY site_id) AS a FROM j), p AS (SELECT *, {_PROXIMITY} AS score FROM k WHERE NOT a OR m), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, uri, line, character, ordinal) AS n FROM p) SELECT site_id, uri, ordinal, CAST(score AS INT) AS score FROM r WHERE n = 1")
def proximity_winner(x: Index) -> DataFrame:
    return search.proximity_winners(x.symbols, _sites(x)).select("site_id", "uri", "ordinal", "score")


@query(f", h AS (SELECT *, CASE WHEN name <> 'RedBolt' THEN -1000 ELSE 100 + CASE WHEN kind = 'method' THEN 50 WHEN kind IN ('function', 'method', 'property') THEN 30 ELSE 0 END + CASE WHEN container_name = 'Brand#4' THEN 100 ELSE 0 END + CASE WHEN full_container_path LIKE '%Brand#4' THEN 40 ELSE 0 END + CASE WHEN is_static IS NULL THEN 0 WHEN is_static = false THEN 30 ELSE -50 END + CASE WHEN uri = '/ws/src/mod3/file3.ts' THEN 20 ELSE 0 END END AS score FROM symbols WHERE name = 'RedBolt') SELECT ordinal, uri, CAST(score AS INT) AS score FROM h WHERE score = (SELECT max(score) FROM h)")
def hybrid_best(x: Index) -> DataFrame:
    return search.best_scored(x.symbols, {"name": "RedBolt", "kind": "method", "container": "Brand#4", "is_static": False, "uri": "/ws/src/mod3/file3.ts"}).select("ordinal", "uri", "score")


_CURSORS = "cursors AS (SELECT site_id AS cursor_id, name, site_uri AS cursor_uri, CAST(site_id % 97 AS INT) AS cursor_line, 3 AS cursor_character FROM sites)"


def _cursors(x: Index) -> DataFrame:
    return _sites(x).select(F.col("site_id").alias("cursor_id"), "name", F.col("site_uri").alias("cursor_uri"), (F.col("site_id") % 97).cast("int").alias("cursor_line"), F.lit(3).alias("cursor_character"))


@query(f", {_SITES}, {_CURSORS}, c AS (SELECT cursors.* EXCLUDE (name), symbols.* FROM cursors JOIN symbols USING (name)), r1 AS (SELECT * FROM c WHERE NOT (uri = cursor_uri AND (cursor_line > start_line OR (cursor_line = start_line AND cursor_character >= start_character)) AND (cursor_line < end_line OR (cursor_line = end_line AND cursor_character <= end_character)))), r2 AS (SELECT * FROM (SELECT *, bool_or(is_definition) OVER (PARTITION BY cursor_id) AS d FROM r1) WHERE NOT d OR kind <> 'text'), r3 AS (SELECT * FROM (SELECT *, bool_or(kind = 'class') OVER (PARTITION BY cursor_id, name) AS k1, bool_or(kind = 'interface') OVER (PARTITION BY cursor_id, name) AS k2 FROM r2) WHERE NOT (k1 AND k2) OR kind = 'class'), r5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cursor_id, uri ORDER BY start_line, ordinal) AS n FROM r3) WHERE n = 1), r6 AS (SELECT *, row_number() OVER (PARTITION BY cursor_id ORDER BY {_KIND_RANK}, uri, ordinal) AS w FROM r5) SELECT cursor_id, uri, ordinal FROM r6 WHERE w = 1")
def definition_cascade(x: Index) -> DataFrame:
    return search.definitions_at(_cursors(x), x.symbols).select("cursor_id", "uri", "ordinal")


# --- lookups


@query("SELECT ordinal, uri, line FROM symbols WHERE name = 'RedBolt' AND is_definition")
def definitions_by_name(x: Index) -> DataFrame:
    return search.by_name(x.symbols, "RedBolt").select("ordinal", "uri", "line")


@query("SELECT ordinal, uri FROM symbols WHERE name = 'RedBolt'")
def symbols_by_name(x: Index) -> DataFrame:
    return search.by_name(x.symbols, "RedBolt", False).select("ordinal", "uri")


@query("SELECT uri, line, character, scope_id FROM refs WHERE symbol_name = 'RedBolt' AND NOT is_local AND scope_id IS NOT DISTINCT FROM '<global>'")
def references_by_name(x: Index) -> DataFrame:
    return x.refs.where((F.col("symbol_name") == "RedBolt") & ~F.col("is_local") & F.col("scope_id").eqNullSafe(F.lit("<global>"))).select("uri", "line", "character", "scope_id")


@query("SELECT ordinal, name, kind FROM symbols WHERE uri = '/ws/src/mod3/file3.ts'")
def symbols_of_file(x: Index) -> DataFrame:
    return x.symbols.where("uri = '/ws/src/mod3/file3.ts'").select("ordinal", "name", "kind")


@query("SELECT ordinal, local_name, module_specifier FROM imports WHERE uri = '/ws/src/mod3/file3.ts'")
def imports_of_file(x: Index) -> DataFrame:
    return x.imports.where("uri = '/ws/src/mod3/file3.ts'").select("ordinal", "local_name", "module_specifier")


@query("SELECT uri, n_symbols, mtime FROM files WHERE uri IN ('/ws/src/mod3/file3.ts', '/ws/src/mod5/file5.ts')")
def batch_of_files(x: Index) -> DataFrame:
    wanted = x.spark.createDataFrame([("/ws/src/mod3/file3.ts",), ("/ws/src/mod5/file5.ts",)], "uri string")
    return x.files.join(wanted, "uri", "left_semi").select("uri", "n_symbols", "mtime")


_ID = "concat(substr(md5(uri), 1, 8), ':', CASE WHEN coalesce(container_name, '') <> '' THEN concat(container_name, '.') ELSE '' END, name, CASE WHEN kind IN ('method', 'function') THEN concat('#', substr(md5(concat(kind, ':', CASE WHEN is_static THEN 'static' ELSE 'instance' END, ':', CAST(coalesce(parameters_count, 0) AS VARCHAR))), 1, 4)) ELSE '' END)"


def _with_id(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", S.symbol_id(F.col("uri"), F.coalesce("container_name", F.lit("")), F.col("name"), F.col("kind"), F.col("is_static"), F.col("parameters_count")))


@query(f"SELECT ordinal, {_ID} AS id FROM symbols")
def symbol_ids(x: Index) -> DataFrame:
    return _with_id(x.symbols).select("ordinal", "id")


# --- joins


@query(f", s AS (SELECT *, {_ID} AS id FROM symbols WHERE (uri, name) IN (SELECT (uri, symbol_name) FROM refs)), d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY uri, ordinal) AS n FROM s) SELECT id, ordinal FROM d WHERE n = 1".replace("(uri, name) IN (SELECT (uri, symbol_name) FROM refs)", "EXISTS (SELECT 1 FROM refs r WHERE r.uri = symbols.uri AND r.symbol_name = symbols.name)"))
def referenced_in_own_file(x: Index) -> DataFrame:
    return resolve.referenced_symbols(_with_id(x.symbols), x.refs).select("id", "ordinal")


@query("SELECT uri, symbol_name, line, character, container_name, is_import, is_local, scope_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.uri = r.uri AND s.line = r.line AND s.character = r.character)")
def references_without_definitions(x: Index) -> DataFrame:
    return resolve.references_without_definitions(x.refs, x.symbols)


@query("SELECT r.uri AS uri, r.line AS line, r.character AS character, s.ordinal AS r_ordinal FROM refs r JOIN symbols s ON s.uri = r.uri WHERE (r.line > start_line OR (r.line = start_line AND r.character >= start_character)) AND (r.line < end_line OR (r.line = end_line AND r.character <= end_character)) AND s.kind = 'class'")
def references_in_ranges(x: Index) -> DataFrame:
    classes = x.symbols.where("kind = 'class'").select("uri", "ordinal", "start_line", "start_character", "end_line", "end_character")
    return resolve.contained(x.refs.select("uri", "line", "character"), classes).select("uri", "line", "character", "r_ordinal")


_GROUPS = "groups AS (SELECT name, ordinal, [name, concat(lower(substr(name, 1, 1)), substr(name, 2))] AS events FROM symbols WHERE kind = 'class'), last AS (SELECT name, arg_max(events, ordinal) AS events FROM groups GROUP BY name), pending AS (SELECT DISTINCT uri, container_name AS container, symbol_name AS member, line FROM refs WHERE container_name IS NOT NULL)"
_CAMEL = "array_to_string([CASE WHEN i = 1 THEN w[i] ELSE concat(upper(substr(w[i], 1, 1)), substr(w[i], 2)) END for i in range(1, len(w) + 1)], '')"
_PASCAL = "array_to_string([concat(upper(substr(y, 1, 1)), substr(y, 2)) for y in w], '')"
_SPLIT = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\-\\s]+'), lambda q: q <> '')"


@query(f", {_GROUPS}, j AS (SELECT pending.*, events, {_SPLIT.format('member')} AS w FROM pending LEFT JOIN last ON container = last.name), k AS (SELECT *, CASE WHEN list_contains(events, member) THEN member WHEN list_contains(events, {_CAMEL}) THEN {_CAMEL} WHEN list_contains(events, {_PASCAL}) THEN {_PASCAL} END AS event FROM j) SELECT uri, line, container, member, event, CASE WHEN event IS NOT NULL THEN member ELSE concat(container, '.', member) END AS symbol_name FROM k")
def resolved_links(x: Index) -> DataFrame:
    low = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substr(name, 2)"))
    events = F.when(low == F.col("name"), F.create_map("name", "name")).otherwise(F.create_map(F.col("name"), F.col("name"), low, F.col("name")))
    groups = x.symbols.where("kind = 'class'").select("name", "ordinal", events.alias("events"))
    pending = x.refs.where("container_name is not null").select("uri", F.col("container_name").alias("container"), F.col("symbol_name").alias("member"), "line").distinct()
    return resolve.resolve_links(pending, groups).select("uri", "line", "container", "member", "event", "symbol_name")


def _sql_candidates() -> str:
    base = f"regexp_replace(concat({_DIR.format('uri')}, '/', regexp_replace(module_specifier, '^\\./', '')), '/[^/]+/\\.\\./', '/')"
    probes = ", ".join(f"concat(b, '{p}')" for p in resolve.PROBES)
    index = ", ".join(f"concat(b, '/index{p}')" for p in resolve.PROBES)
    return f"base AS (SELECT *, {base} AS b FROM imports), stem AS (SELECT *, regexp_replace(b, '\\.(js|jsx|mjs|cjs)$', '') AS st FROM base), tries AS (SELECT uri, ordinal, unnest([CASE WHEN b <> st THEN concat(st, '.ts') END, CASE WHEN b <> st THEN concat(st, '.tsx') END, b, {probes}, {index}]) AS path, unnest(range(0, {3 + 2 * len(resolve.PROBES)})) AS pr FROM stem WHERE starts_with(module_specifier, '.')), best AS (SELECT uri, ordinal, arg_min(path, pr) AS resolved_uri FROM tries WHERE path IN (SELECT uri FROM files) GROUP BY uri, ordinal), resolved AS (SELECT imports.*, resolved_uri FROM imports LEFT JOIN best USING (uri, ordinal))"


@query(f", {_sql_candidates()} SELECT uri, ordinal, module_specifier, resolved_uri FROM resolved")
def resolved_imports(x: Index) -> DataFrame:
    return resolve.resolve_imports(x.imports, x.files).select("uri", "ordinal", "module_specifier", "resolved_uri")


@query("SELECT uri, local_name, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY uri, local_name ORDER BY ordinal) AS n FROM imports) WHERE n = 1")
def first_imports(x: Index) -> DataFrame:
    return resolve.import_of(x.imports).select("uri", "local_name", "ordinal")


@query(f", {_sql_candidates()}, b2 AS (SELECT DISTINCT r.uri, r.local_name, r.resolved_uri, coalesce(exported_name, local_name) AS xn FROM resolved r WHERE resolved_uri IS NOT NULL), t AS (SELECT DISTINCT uri AS resolved_uri, name AS xn, {_ID} AS target_id FROM symbols) SELECT refs.uri AS uri, symbol_name, line, character, resolved_uri, target_id FROM refs JOIN (SELECT uri, local_name, resolved_uri, xn FROM b2) b ON refs.uri = b.uri AND symbol_name = local_name JOIN t USING (resolved_uri, xn)")
def references_through_imports(x: Index) -> DataFrame:
    resolved = resolve.resolve_imports(x.imports, x.files).select("uri", "local_name", "resolved_uri", "exported_name").distinct()
    return resolve.references_through_imports(x.refs, resolved, _with_id(x.symbols)).select("uri", "symbol_name", "line", "character", "resolved_uri", "target_id")


@query(", s AS (SELECT 0 AS tier, uri, name, line, character, ordinal FROM symbols WHERE kind = 'class' UNION ALL SELECT 1, uri, name, line, character, ordinal FROM symbols WHERE is_definition UNION ALL SELECT 2, uri, name, line, character, ordinal FROM symbols), d AS (SELECT *, row_number() OVER (PARTITION BY name, uri, line, character ORDER BY tier, ordinal) AS n FROM s) SELECT name, uri, line, character, CAST(tier AS INT) AS tier, ordinal FROM d WHERE n = 1")
def merged_tiers(x: Index) -> DataFrame:
    s = x.symbols.select("uri", "name", "line", "character", "ordinal", "kind", "is_definition")
    tiers = [t.drop("kind", "is_definition") for t in (s.where("kind = 'class'"), s.where("is_definition"), s)]
    return resolve.merge_tiers(tiers, ["name", "uri", "line", "character"], ["ordinal"])


@query(", s AS (SELECT 0 AS tier, uri, ordinal FROM symbols WHERE kind = 'class' UNION ALL SELECT 1, uri, ordinal FROM symbols) SELECT uri, ordinal, CAST(tier AS INT) AS tier FROM s WHERE tier = (SELECT min(tier) FROM s t WHERE t.uri = s.uri)")
def first_tier_of_files(x: Index) -> DataFrame:
    s = x.symbols.select("uri", "ordinal", "kind")
    return resolve.file_tier([s.where("kind = 'class'").drop("kind"), s.drop("kind")])


@query("SELECT uri FROM files WHERE uri NOT IN (SELECT uri FROM refs WHERE is_local)")
def stale_files(x: Index) -> DataFrame:
    return x.files.select("uri").join(x.refs.where("is_local").select("uri").distinct(), "uri", "left_anti")


@query("SELECT uri, line, character FROM (SELECT uri, line, character FROM symbols UNION ALL SELECT uri, line, character FROM refs) GROUP BY ALL")
def all_positions(x: Index) -> DataFrame:
    return x.symbols.select("uri", "line", "character").unionByName(x.refs.select("uri", "line", "character")).distinct()


# --- recursion

_EDGES = "edges AS (SELECT DISTINCT r.uri AS uri, s.uri AS target_uri FROM (SELECT DISTINCT uri, symbol_name FROM refs WHERE is_import) r JOIN (SELECT DISTINCT name, uri FROM symbols WHERE kind = 'class') s ON s.name = r.symbol_name WHERE r.uri <> s.uri)"


def _edges(x: Index) -> DataFrame:
    used = x.refs.where("is_import").select("uri", F.col("symbol_name").alias("name")).distinct()
    homes = x.symbols.where("kind = 'class'").select("name", F.col("uri").alias("target_uri")).distinct()
    return used.join(homes, "name").where("uri <> target_uri").select("uri", "target_uri").distinct()


@query(f", {_EDGES}, walk(uri, depth) AS (SELECT '/ws/src/mod0/file0.ts', 0 UNION SELECT e.uri, w.depth + 1 FROM walk w JOIN edges e ON e.target_uri = w.uri WHERE w.depth < 3) SELECT uri, CAST(min(depth) AS INT) AS depth FROM walk WHERE uri <> '/ws/src/mod0/file0.ts' GROUP BY uri", recursive=True)
def impacted_files(x: Index) -> DataFrame:
    return graph.impacted_files(_edges(x), "/ws/src/mod0/file0.ts")


_INHERITS = "inherits AS (SELECT DISTINCT concat('n', CAST(n_nationkey AS VARCHAR)) AS child, concat('r', CAST(n_regionkey AS VARCHAR)) AS parent FROM nation UNION SELECT DISTINCT concat('s', CAST(s_suppkey AS VARCHAR)), concat('n', CAST(s_nationkey AS VARCHAR)) FROM supplier UNION SELECT DISTINCT concat('c', CAST(c_custkey AS VARCHAR)), concat('n', CAST(c_nationkey AS VARCHAR)) FROM customer)"


@query(f"WITH RECURSIVE {_INHERITS}, w(node, depth) AS (SELECT 'r1', 0 UNION SELECT child, depth + 1 FROM w JOIN inherits ON parent = node WHERE depth < 10) SELECT node, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY node", views=False)
def implementations(x: Index) -> DataFrame:
    edge = lambda t, a, p, b, q: x.table(t).select(F.concat(F.lit(a), F.col(p).cast("string")).alias("child"), F.concat(F.lit(b), F.col(q).cast("string")).alias("parent"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).distinct()
    return graph.implementations(edges, "r1", 4)


# modules m0, m1, ...: symbol o is declared in m(o div 5), and m(o) re-exports from m(o div 3) and, by name, from m(o div 2)
_REEX = "re AS (SELECT concat('m', ordinal) AS uri, concat('m', ordinal // 3) AS target, ordinal % 2 = 0 AS is_all, name FROM symbols UNION SELECT concat('m', ordinal), concat('m', ordinal // 2), false, name FROM symbols), defs AS (SELECT concat('m', ordinal // 5) AS uri, name, ordinal, line FROM symbols), req AS (SELECT r.ordinal AS request_id, concat('m', r.ordinal) AS uri, s.name FROM symbols r JOIN symbols s ON s.ordinal = 5 * (r.ordinal // 9) + 1)"


@query(f", {_REEX}, w(request_id, uri, name, level) AS (SELECT request_id, uri, name, 0 FROM req UNION SELECT w.request_id, re.target, w.name, level + 1 FROM w JOIN re ON re.uri = w.uri AND (re.is_all OR re.name = w.name) WHERE level < 5), f AS (SELECT w.request_id, w.uri, level, ordinal, row_number() OVER (PARTITION BY w.request_id ORDER BY level, w.uri, ordinal) AS n FROM w JOIN defs ON defs.uri = w.uri AND defs.name = w.name) SELECT request_id, uri, CAST(level AS INT) AS level, ordinal FROM f WHERE n = 1", recursive=True)
def reexport_chains(x: Index) -> DataFrame:
    module = lambda n: F.expr(f"concat('m', CAST(ordinal div {n} AS STRING))")
    edge = lambda n, everything: x.symbols.select(module(1).alias("uri"), module(n).alias("target"), everything.alias("is_all"), F.array("name").alias("exported_names"))
    edges = edge(3, F.col("ordinal") % 2 == 0).unionByName(edge(2, F.lit(False))).distinct()
    defs = _with_id(x.symbols).select(module(5).alias("uri"), "name", "id", "line", "ordinal")
    wanted = x.symbols.select(F.col("ordinal").alias("_w"), "name")
    requests = x.symbols.select(F.col("ordinal").alias("request_id"), module(1).alias("uri"), F.expr("CAST(5 * (ordinal div 9) + 1 AS INT)").alias("_w")).join(wanted, "_w").drop("_w")
    return resolve.chase_reexports(requests, edges, defs).select("request_id", "uri", "level", "ordinal")


# --- liveness

# names carry their line, so that some of them have no uses
_AT_LINE = "sy AS (SELECT * REPLACE (concat(name, '@', line) AS name) FROM symbols), rf AS (SELECT * REPLACE (concat(symbol_name, '@', line) AS symbol_name, CASE WHEN container_name IS NOT NULL THEN concat(container_name, '@', line) END AS container_name) FROM refs)"
_DEAD = f"""{_AT_LINE}, ex AS (SELECT * FROM sy WHERE coalesce(container_name, '') = '' AND kind IN ('class', 'interface', 'function', 'type', 'enum', 'constant', 'variable')
  AND NOT (contains(uri, 'node_modules') OR contains(uri, 'dist/') OR contains(uri, '.spec.') OR contains(uri, '.test.')) AND uri NOT LIKE '%/index.ts' AND uri NOT LIKE '%.spec.ts'),
un AS (SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM rf r WHERE r.symbol_name = ex.name AND r.uri <> ex.uri)),
al AS (SELECT DISTINCT r.uri AS uri, r.symbol_name AS name FROM rf r JOIN ex h ON h.uri = r.uri WHERE NOT coalesce(is_import, false) AND h.name <> r.symbol_name AND (coalesce(r.container_name = h.name, false) OR
  ((r.line > start_line OR (r.line = start_line AND r.character >= start_character)) AND (r.line < end_line OR (r.line = end_line AND r.character <= end_character))))),
cn AS (SELECT uri, symbol_name AS name, count(DISTINCT (line, character)) AS n FROM rf GROUP BY ALL),
dead AS (SELECT un.uri AS uri, un.name AS name, ordinal, CAST(coalesce(cn.n, 0) AS BIGINT) AS local_uses FROM un LEFT JOIN cn ON cn.uri = un.uri AND cn.name = un.name WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.uri = un.uri AND al.name = un.name)),
conf AS (SELECT *, CASE WHEN local_uses = 0 THEN 'high' WHEN local_uses < 3 THEN 'medium' ELSE 'low' END AS confidence FROM dead)"""


def _at_line(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.concat(c, F.lit("@"), F.col("line").cast("string")) for c in columns})


def _dead(x: Index) -> DataFrame:
    return liveness.dead_code(_at_line(x.symbols, "name"), _at_line(x.refs, "symbol_name", "container_name"))


@query(f", {_DEAD} SELECT uri, name, ordinal, local_uses, confidence FROM conf")
def dead_code(x: Index) -> DataFrame:
    return _dead(x).select("uri", "name", "ordinal", "local_uses", "confidence")


@query(f", {_DEAD} SELECT confidence, count(*) AS n, count(DISTINCT uri) AS n_files FROM conf GROUP BY confidence")
def dead_code_totals(x: Index) -> DataFrame:
    return liveness.totals(_dead(x))


@query(f", {_AT_LINE}, e AS (SELECT uri, name, ordinal FROM sy WHERE coalesce(container_name, '') = '' AND kind IN ('class', 'interface', 'function', 'type', 'enum', 'constant', 'variable')), u AS (SELECT DISTINCT symbol_name AS name, uri AS ref_uri FROM rf), c AS (SELECT e.uri, e.name, e.ordinal, bool_and(regexp_matches(ref_uri, '(^|/)(index|public-api|barrel)\\.[jt]s$')) AS b, count(*) AS n_files FROM e JOIN u ON u.name = e.name WHERE ref_uri <> e.uri GROUP BY ALL) SELECT uri, name, ordinal, n_files FROM c WHERE b")
def barrel_only(x: Index) -> DataFrame:
    return liveness.barrel_only(_at_line(x.symbols, "name"), _at_line(x.refs, "symbol_name"))


# --- aggregates


@query("SELECT (SELECT count(*) FROM files) AS n_files, (SELECT sum(size) FROM files) AS bytes, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(DISTINCT name) FROM symbols) AS n_names".replace("(SELECT sum(size) FROM files)", "(SELECT CAST(sum(size) AS BIGINT) FROM files)"))
def index_stats(x: Index) -> DataFrame:
    return stats.index_stats(x.files, x.symbols)


@query(f"SELECT {_DIR.format('files.uri')} AS folder, count(*) AS n_files, CAST(sum(n_symbols) AS BIGINT) AS n_symbols, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def folder_breakdown(x: Index) -> DataFrame:
    return stats.folders(x.files.drop("n_symbols"), x.symbols)


@query(f", e AS (SELECT {_DIR.format('uri')} AS folder, concat(string_split(uri, '/')[-1], ':', CAST(size AS VARCHAR), ':', CAST(mtime AS VARCHAR)) AS sig FROM files) SELECT folder, sha256(array_to_string(list_sort(list(sig)), '|')) AS hash FROM e GROUP BY folder")
def folder_hashes(x: Index) -> DataFrame:
    entries = x.files.select(S.directory(F.col("uri")).alias("folder"), F.element_at(F.split("uri", "/"), -1).alias("name"), "size", "mtime")
    return stats.folder_hash(entries)


_TIMES = "t AS (SELECT event_type AS name, ts, event_id AS seq, value AS ms FROM events)"


@query(f"WITH {_TIMES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS n FROM t), l AS (SELECT name, list_sort(list(ms)) AS s FROM r WHERE n <= 100 GROUP BY name) SELECT t.name AS name, count(*) AS n, round(sum(ms), 4) AS total, min(ms) AS least, max(ms) AS most, round(avg(ms), 6) AS mean, any_value(s[least(CAST(floor(0.5 * len(s)) AS INT) + 1, len(s))]) AS p50, any_value(s[least(CAST(floor(0.95 * len(s)) AS INT) + 1, len(s))]) AS p95 FROM t JOIN l ON l.name = t.name GROUP BY t.name", views=False)
def timing_profile(x: Index) -> DataFrame:
    return stats.timings(_samples(x))


def _samples(x: Index) -> DataFrame:
    return x.table("events").select(F.col("event_type").alias("name"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("ms"))


@query(f"WITH {_TIMES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ms DESC, seq) AS n FROM t WHERE ms >= 10) SELECT name, seq, ms, CAST(n AS INT) AS rank FROM r WHERE n <= 5", views=False)
def timing_outliers(x: Index) -> DataFrame:
    return stats.outliers(_samples(x)).select("name", "seq", "ms", "rank")


# --- extraction of words


@query(f"WITH {_WORDS} SELECT doc_id, line, CAST(strpos(s, name) - 1 AS INT) AS character, name, count(*) AS n FROM doc_words GROUP BY ALL", views=False)
def document_words(x: Index) -> DataFrame:
    return words.text_symbols(x.table("documents").select("doc_id", F.col("text").alias("content"))).groupBy("doc_id", "line", "character", "name").agg(F.count("*").alias("n"))


@query(f"WITH {_WORDS} SELECT name, count(*) AS n_uses, count(DISTINCT doc_id) AS n_docs FROM doc_words WHERE name IN (SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '\\b[a-zA-Z_][a-zA-Z0-9_]{{2,}}\\b')) AS name FROM benchmark)) GROUP BY name", views=False)
def known_word_references(x: Index) -> DataFrame:
    names = words.text_symbols(x.table("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))).select("name").distinct()
    found = words.text_symbols(x.table("documents").select("doc_id", F.col("text").alias("content")))
    return found.join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n_uses"), F.countDistinct("doc_id").alias("n_docs"))


# --- scalars


@query(f", w AS (SELECT DISTINCT name, {_SPLIT.format('name')} AS w FROM symbols) SELECT name, {_CAMEL} AS camel, {_PASCAL} AS pascal, array_to_string(w, '-') AS kebab, array_to_string(w, '_') AS snake FROM w")
def case_forms(x: Index) -> DataFrame:
    n = F.col("name")
    return x.symbols.select("name").distinct().select("name", S.camel_case(n).alias("camel"), S.pascal_case(n).alias("pascal"), S.kebab_case(n).alias("kebab"), S.snake_case(n).alias("snake"))


@query(f", n AS (SELECT DISTINCT name FROM symbols) SELECT name, {_boundaries('name')} AS boundaries FROM n")
def camel_boundaries(x: Index) -> DataFrame:
    return x.symbols.select("name").distinct().withColumn("boundaries", S.boundary_characters(F.col("name")))


@query("SELECT DISTINCT kind, CAST(CASE kind WHEN 'class' THEN 5 WHEN 'method' THEN 6 WHEN 'property' THEN 7 WHEN 'enum' THEN 10 WHEN 'interface' THEN 11 WHEN 'function' THEN 12 WHEN 'constant' THEN 14 ELSE 13 END AS INT) AS protocol_kind FROM symbols")
def protocol_kinds(x: Index) -> DataFrame:
    return x.symbols.select("kind").distinct().withColumn("protocol_kind", S.protocol_kind(F.col("kind")))


@query("SELECT doc_id, CAST(len(h) - 1 AS INT) AS line, CAST(length(h[-1]) AS INT) AS character, w AS word FROM (SELECT doc_id, string_split(substr(text, 1, 100), chr(10)) AS h, CASE WHEN regexp_matches(concat(regexp_extract(substr(text, 1, 100), '[A-Za-z0-9_]*$'), regexp_extract(substr(text, 101), '^[A-Za-z0-9_]*')), '^[A-Za-z_]') THEN concat(regexp_extract(substr(text, 1, 100), '[A-Za-z0-9_]*$'), regexp_extract(substr(text, 101), '^[A-Za-z0-9_]*')) END AS w FROM documents)", views=False)
def word_at_offset(x: Index) -> DataFrame:
    at = F.lit(100)
    docs = x.table("documents")
    return docs.select("doc_id", S.position_of(F.col("text"), at).alias("p"), S.word_at(F.col("text"), at).alias("word")).select("doc_id", "p.line", "p.character", "word")


@query("SELECT ordinal, length(name) >= 3 AND regexp_matches(lower(name), '^(red|small|hot)') AND regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AS is_action FROM symbols".replace("red|small|hot", "|".join(P.ACTION_VERBS)))
def action_names(x: Index) -> DataFrame:
    return x.symbols.select("ordinal", P.action_name(F.col("name")).alias("is_action"))


@query("SELECT uri, (uri LIKE '%/main.ts' OR uri LIKE '%/public-api.ts' OR uri LIKE '%/index.ts' OR uri LIKE '%.stories.ts' OR uri LIKE '%.spec.ts' OR uri LIKE '%.test.ts' OR uri LIKE '%/test/%' OR uri LIKE '%/tests/%') AS is_entry, NOT (contains(uri, '/dist/') OR contains(uri, '/node_modules/')) AND size <= 50 AS is_indexable, uri = '/ws/src/mod1' OR starts_with(lower(uri), '/ws/src/mod1/') AS in_scope FROM files")
def file_predicates(x: Index) -> DataFrame:
    u = F.col("uri")
    return x.files.select("uri", P.entry_point(u).alias("is_entry"), P.indexable(u, F.col("size"), limit=50).alias("is_indexable"), P.in_scope(u, "/ws/src/MOD1/").alias("in_scope"))


# --- change stream, in batch form


@query("SELECT user_id, ts, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1", views=False)
def latest_event_of_key(x: Index) -> DataFrame:
    from ..streaming import incremental

    return incremental.latest(x.table("events"), "user_id", ["ts", "event_id"]).select("user_id", "ts", "event_type", "event_id")


@query("WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM h GROUP BY user_id, b", views=False)
def debounced_bursts(x: Index) -> DataFrame:
    from ..streaming import incremental

    return incremental.bursts(x.table("events"), "user_id", 60 * 60, tie="event_id")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'".replace("arg_max(event_type, (ts, event_id))", "arg_max(event_type, ts)"), views=False)
def live_keys(x: Index) -> DataFrame:
    from ..streaming import incremental

    return incremental.latest(x.table("events"), "user_id", ["ts", "event_id"]).where("event_type <> 'error'").select("user_id", "ts")


@query("SELECT d.doc_id AS doc_id, sha256(d.text) AS hash, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN l.quality = 0 THEN 'changed' ELSE 'same' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT -1 - page_id AS doc_id, sha256(html) AS hash, 'deleted' AS state FROM pages", views=False)
def staleness(x: Index) -> DataFrame:
    """Documents against a stored snapshot: of those with labels, the bad ones with another hash, and of all pages, now gone."""
    from ..streaming import incremental

    now = x.table("documents").select(F.col("doc_id").alias("uri"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    stored = x.table("labels").select(F.col("doc_id").alias("uri"), "quality").join(now, "uri").select("uri", F.when(F.col("quality") == 0, "old").otherwise(F.col("hash")).alias("hash"))
    gone = x.table("pages").select((-1 - F.col("page_id")).alias("uri"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return incremental.changes(stored.unionByName(gone), now).select(F.col("uri").alias("doc_id"), "hash", "state")


# --- text forms of resolution and liveness

_LINES = "lines AS (SELECT doc_id, CAST(l - 1 AS INT) AS line, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM documents))"


def _lines(x: Index) -> DataFrame:
    return x.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))


@query(f"WITH {_LINES}, p AS (SELECT doc_id, line, unnest(string_split(s, 'that')) AS piece, generate_subscripts(string_split(s, 'that'), 1) AS n FROM lines WHERE contains(s, 'that')) SELECT doc_id, line, CAST(place AS INT) AS character FROM (SELECT *, sum(length(piece) + 4) OVER (PARTITION BY doc_id, line ORDER BY n) - 4 AS place, count(*) OVER (PARTITION BY doc_id, line) AS m FROM p) WHERE n < m", views=False)
def literal_matches(x: Index) -> DataFrame:
    """All places of a literal in lines (action types in reducers and effects)."""
    pieces = _lines(x).where(F.col("s").contains("that")).select("doc_id", "line", F.posexplode(F.split("s", "that")).alias("n", "piece"))
    line = W.partitionBy("doc_id", "line")
    # where a piece ends, the literal stands, but for the last piece
    ends = pieces.select("doc_id", "line", "n", F.sum(F.char_length("piece") + 4).over(line.orderBy("n")).alias("end"), F.max("n").over(line).alias("last"))
    return ends.where("n < last").select("doc_id", "line", (F.col("end") - 4).cast("int").alias("character"))


@query(f"WITH {_LINES}, n AS (SELECT doc_id, line, s, unnest(regexp_extract_all(s, '[A-Za-z]+')) AS w FROM lines) SELECT doc_id, line, w, (contains(s, 'on(') OR contains(s, 'createAction') OR (length(w) >= 3 AND regexp_matches(lower(w), '^({'|'.join(P.ACTION_VERBS)})') AND regexp_matches(w, '^[a-z][a-zA-Z0-9]*$'))) AS store_like FROM n", views=False)
def store_lines(x: Index) -> DataFrame:
    """Which words of each line look like store symbols there."""
    words = _lines(x).withColumn("w", F.explode(F.regexp_extract_all("s", F.lit("[A-Za-z]+"), 0)))
    return words.select("doc_id", "line", "w", P.store_symbol(F.col("w"), F.col("s")).alias("store_like"))


@query("SELECT match, explicit, CASE WHEN match = 'symbol' AND explicit THEN 'high' WHEN match IN ('symbol', 'string') THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'string' ELSE 'wildcard' END AS match, o_orderkey % 2 = 0 AS explicit FROM orders) GROUP BY ALL", views=False)
def reference_confidence(x: Index) -> DataFrame:
    o = x.table("orders").select(F.expr("CASE o_custkey % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'string' ELSE 'wildcard' END").alias("match"), (F.col("o_orderkey") % 2 == 0).alias("explicit"))
    return o.withColumn("confidence", P.confidence(F.col("match"), F.col("explicit"))).groupBy("match", "explicit", "confidence").agg(F.count("*").alias("n"))


@query(", d AS (SELECT DISTINCT uri, line, character FROM refs WHERE symbol_name = 'RedBolt') SELECT uri, list_transform(list_sort(list(line * 1000 + character), 'DESC'), lambda p: CAST(p AS INT)) AS places FROM d GROUP BY uri")
def rename_places(x: Index) -> DataFrame:
    """Edits of a file, bottom up."""
    d = x.refs.where("symbol_name = 'RedBolt'").select("uri", "line", "character").distinct()
    return d.groupBy("uri").agg(F.sort_array(F.collect_list(F.col("line") * 1000 + F.col("character")), asc=False).alias("places"))


@query(f", {_GROUPS}, j AS (SELECT pending.*, events, {_SPLIT.format('member')} AS w FROM pending LEFT JOIN last ON container = last.name) SELECT count(*) AS n_pending, CAST(count(*) FILTER (WHERE list_contains(events, member) OR list_contains(events, {_CAMEL}) OR list_contains(events, {_PASCAL})) AS BIGINT) AS n_matched FROM j")
def link_stats(x: Index) -> DataFrame:
    return resolved_links(x).agg(F.count("*").alias("n_pending"), F.count("event").alias("n_matched"))


@query("SELECT name, CAST(count(*) AS BIGINT) AS n, bool_or(is_definition) AS any_definition, bool_and(is_static) AS all_static, max(kind) AS last_kind FROM symbols GROUP BY name HAVING count(DISTINCT kind) > 1")
def names_of_many_kinds(x: Index) -> DataFrame:
    g = x.symbols.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("is_definition").alias("any_definition"), F.bool_and("is_static").alias("all_static"), F.max("kind").alias("last_kind"), F.countDistinct("kind").alias("_k"))
    return g.where("_k > 1").drop("_k")


@query("SELECT tier, count(DISTINCT uri) AS n_files, count(*) AS n_symbols FROM (SELECT 'open' AS tier, uri FROM symbols WHERE kind = 'class' UNION ALL SELECT 'all', uri FROM symbols) GROUP BY tier")
def tier_stats(x: Index) -> DataFrame:
    s = x.symbols
    return stats.tier_stats(s.where("kind = 'class'").select(F.lit("open").alias("tier"), "uri").unionByName(s.select(F.lit("all").alias("tier"), "uri")))


@query("SELECT uri FROM files f LEFT JOIN (SELECT uri AS u, max(mtime) + min(ordinal) % 2 AS m FROM (SELECT uri, ordinal, is_exported, max(ordinal) OVER (PARTITION BY uri) AS mtime FROM symbols) WHERE is_exported GROUP BY uri) s ON s.u = f.uri WHERE m IS NULL OR m <> mtime")
def files_to_reindex(x: Index) -> DataFrame:
    from ..sources import workspace

    w = x.symbols.join(x.files.select("uri", "mtime"), "uri").where("is_exported")
    meta = w.groupBy("uri").agg((F.max("mtime") + F.min("ordinal") % 2).alias("mtime"))
    return workspace.needs_reindexing(x.files.select("uri", "mtime"), meta).select("uri")


@query("SELECT ordinal, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind <> 'class', coalesce(container_name, '') <> 'Brand#4', uri, ordinal) AS n FROM symbols) WHERE n = 1")
def matched_symbols(x: Index) -> DataFrame:
    """Best match by kind, then container."""
    return search.first_by(x.symbols, ["name"], F.col("kind") != "class", F.coalesce("container_name", F.lit("")) != "Brand#4", "uri", "ordinal").select("ordinal", "name")


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) AS n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1))) AS n_distinct FROM pages", views=False)
def page_links(x: Index) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), 1)
    return x.table("pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"))


@query("SELECT 'class' AS kind, count(*) AS n, count(DISTINCT ordinal) AS n_names FROM symbols UNION ALL SELECT 'method' AS kind, count(*) AS n, 1 AS n_names FROM symbols")
def source_extraction(x: Index) -> DataFrame:
    """Source files written from the symbol table, read back by the extractor: counts of what it finds by kind."""
    from ..extract import index

    name = F.concat(F.lit("N"), F.col("ordinal").cast("string"))
    line = F.concat(F.lit("export class "), name, F.lit(" extends Base { m(a: number) { return this.go("), name, F.lit("); } }\n"))
    files = x.symbols.groupBy("uri").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("content"))
    found = index.flatten(index.extract(files), "symbols")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


# --- at cursors

_PLACES = "cursors AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS cursor_id, {file} AS cursor_uri, CAST(l_suppkey % 97 AS INT) AS cursor_line, CAST(l_quantity AS INT) AS cursor_character FROM lineitem)"
_AT_PLACES = (
    _PLACES.format(file="concat('/ws/src/mod', CAST(l_orderkey % 40 AS VARCHAR), '/file', CAST(l_orderkey % 90 AS VARCHAR), '.ts')")
    + """, marks AS (SELECT uri, line, character, CAST(character + length(name) AS INT) AS end_character, name, kind, 0 AS stage FROM symbols
UNION ALL SELECT uri, line, character, CAST(character + length(symbol_name) AS INT), symbol_name, 'variable', 1 FROM refs),
met AS (SELECT c.cursor_id, m.*, row_number() OVER (PARTITION BY cursor_id ORDER BY stage, m.character, name, kind) AS k FROM cursors c JOIN marks m ON m.uri = c.cursor_uri AND m.line = c.cursor_line AND c.cursor_character BETWEEN m.character AND m.end_character),
found AS (SELECT * FROM met WHERE k = 1)"""
)


def _places(x: Index) -> DataFrame:
    key = F.col("l_orderkey")
    uri = F.concat(F.lit("/ws/src/mod"), (key % 40).cast("string"), F.lit("/file"), (key % 90).cast("string"), F.lit(".ts"))
    return x.table("lineitem").select((key * 10 + F.col("l_linenumber")).cast("long").alias("cursor_id"), uri.alias("cursor_uri"), (F.col("l_suppkey") % 97).cast("int").alias("cursor_line"), F.col("l_quantity").cast("int").alias("cursor_character"))


@query(f", {_AT_PLACES} SELECT cursor_id, uri, line, character, end_character, name, kind FROM found")
def symbol_at_cursor(x: Index) -> DataFrame:
    """The declared name or reference at every cursor."""
    return cursor.symbol_at(_places(x), x.symbols, x.refs).select("cursor_id", "uri", "line", "character", "end_character", "name", "kind")


@query(f", {_AT_PLACES}, known AS (SELECT name, uri AS first_uri FROM (SELECT name, uri, row_number() OVER (PARTITION BY name ORDER BY uri, ordinal) AS n FROM symbols WHERE is_definition) WHERE n = 1) SELECT c.cursor_id AS cursor_id, f.line AS line, f.character AS character, f.end_character AS end_character, f.name AS name, CASE WHEN f.name IS NULL THEN '{cursor.NO_SYMBOL}' WHEN first_uri IS NULL THEN '{cursor.NOT_INDEXED}' WHEN contains(first_uri, 'node_modules') THEN '{cursor.EXTERNAL}' END AS error FROM cursors c LEFT JOIN found f ON f.cursor_id = c.cursor_id LEFT JOIN known k ON k.name = f.name")
def rename_targets(x: Index) -> DataFrame:
    """Whether the symbol at every cursor can be renamed, and its range."""
    return cursor.prepare_rename(_places(x), x.symbols, x.refs)


@query("SELECT uri, ordinal, concat('```typescript', chr(10), '(', kind, ') ', CASE WHEN coalesce(container_name, '') <> '' THEN concat(container_name, '.') ELSE '' END, name, CASE WHEN is_static THEN ' [static]' ELSE '' END, CASE WHEN kind NOT IN ('function', 'method') OR parameters_count IS NULL THEN '' WHEN parameters_count > 0 THEN ' (...)' ELSE ' ()' END, chr(10), '```', chr(10), chr(10), CASE WHEN kind = 'class' THEN concat('**Angular Component**', chr(10), chr(10)) WHEN kind = 'constant' THEN concat('**NgRx Action:** `', name, '`', chr(10), chr(10), '**NgRx Action Group**', chr(10), chr(10)) ELSE '' END, '*Defined in:* `', list_extract(string_split(uri, '/'), -1), ':', CAST(line + 1 AS VARCHAR), ':', CAST(character + 1 AS VARCHAR), '`') AS text FROM symbols")
def hover_texts(x: Index) -> DataFrame:
    """The hover text of every symbol; classes count as components, constants as action groups."""
    group, kind = F.col("kind") == "constant", F.when(F.col("kind") == "class", F.array(F.lit("Component")))
    lines = cursor.framework_lines(F.when(group, "action"), F.when(group, F.col("name")), group, kind)
    return x.symbols.select("uri", "ordinal", cursor.hover_text(lines).alias("text"))


@query(f", {_DEAD} SELECT c.uri AS uri, c.ordinal AS ordinal, concat('Unused export: ', upper(substr(s.kind, 1, 1)), substr(s.kind, 2), ' ', chr(39), c.name, chr(39), ' is declared but never used in the workspace', CASE WHEN confidence = 'high' THEN '' ELSE concat(' (', confidence, ' confidence)') END) AS message FROM conf c JOIN symbols s ON s.uri = c.uri AND s.ordinal = c.ordinal")
def unused_messages(x: Index) -> DataFrame:
    """The message for every unused export."""
    return cursor.messages(_dead(x)).select("uri", "ordinal", "message")


_ASKED = ["Path", "const", "MAP", "maps", "newer", "new", "logger", "Info"]


@query("SELECT word, NOT lower(word) IN (" + ", ".join(f"'{k}'" for k in P.KEYWORDS) + f") AS is_searched FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT unnest({_ASKED}) AS word) t", views=False)
def words_searched(x: Index) -> DataFrame:
    """Which words the fallback of a definition looks up: all but keywords."""
    words = x.table("part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(x.spark.createDataFrame([(w,) for w in _ASKED], "word string")).distinct()
    return words.select("word", (~F.lower("word").isin(P.KEYWORDS)).alias("is_searched"))


for _query, _sql_text in extraction.QUERIES.items():
    query(_sql_text, views=False)(_query)
