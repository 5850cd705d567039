"""Joins that resolve names: tiers, links, imports, re-exports, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lineage import cut
from .search import first_by

#: Extensions in the order they are tried.
PROBES = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]


def merge_tiers(tiers: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Priority union: the first tier that has a key wins; within a tier the first row by order."""
    tagged = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_by(out, key, "tier", *order)


def file_tier(tiers: list[DataFrame]) -> DataFrame:
    """Rows of each file from the first tier that has any."""
    tagged = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    least = out.groupBy("uri").agg(F.min("tier").alias("_t"))
    return out.join(least, "uri").where("tier = _t").drop("_t")


def references_without_definitions(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    return refs.join(definitions.select("uri", "line", "character").distinct(), ["uri", "line", "character"], "left_anti")


def referenced_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols whose name is referenced in their own file, one for each id."""
    named = refs.select("uri", F.col("symbol_name").alias("name")).distinct()
    return first_by(symbols.join(named, ["uri", "name"], "left_semi"), ["id"], "uri", "ordinal")


def resolve_links(pending: DataFrame, groups: DataFrame) -> DataFrame:
    """Deferred member accesses against action groups (name, events, ordinal): as written, camel case, Pascal case.

    A match references the member, any other row ``container.member``. The last group of a name counts.
    """
    last = first_by(groups, ["name"], F.desc("ordinal")).select(F.col("name").alias("container"), "events")
    joined = pending.join(last, "container", "left")
    m = F.col("member")
    known = lambda x: F.when(F.map_contains_key("events", x), x)
    key = F.coalesce(known(m), known(S.camel_case(m)), known(S.pascal_case(m)))
    return joined.withColumn("event", key).withColumn("symbol_name", F.when(F.col("event").isNotNull(), m).otherwise(F.concat_ws(".", "container", "member"))).drop("events")


def folded(path: Column) -> Column:
    """path without '.' and empty segments, each '..' taken up with the segment before it; at the root it stays there."""
    root = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]+:)?/*", 0)

    def step(kept: Column, part: Column) -> Column:
        more = F.concat(kept, F.array(part))
        up = F.when(F.size(kept) == 0, F.when(root == "", more).otherwise(kept)).when(F.element_at(kept, -1) == "..", more).otherwise(F.slice(kept, 1, F.size(kept) - 1))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(more)

    parts = F.split(F.substring(path, F.char_length(root) + 1, F.char_length(path)), "/")
    return F.concat(root, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def import_bases(wanted: DataFrame, files: DataFrame, path_map: DataFrame | None = None) -> DataFrame:
    """wanted (folder, absolute, module_specifier) with each base, a path that may lack its extension, and its rank.

    A relative specifier has one base. Any other has those of the path map (pattern, paths), in its order, then those in
    the node_modules folders from its own folder upward that files know.
    """
    spec = F.col("module_specifier")
    relative = spec.rlike(r"^\.\.?(/|$)")
    key = ["folder", "absolute", "module_specifier"]
    rank = lambda *of: F.struct(*(x.cast("long").alias(f"r{i}") for i, x in enumerate(of))).alias("rank")
    own = F.when((F.col("folder") == "") & ~F.col("absolute"), spec).otherwise(F.concat_ws("/", "folder", spec))
    out = wanted.where(relative).select(*key, folded(own).alias("base"), rank(F.lit(0), F.lit(0), F.lit(0)))
    rest = wanted.where(~relative)
    if path_map is not None:
        star = F.instr("pattern", "*")
        before, after = F.substring_index("pattern", "*", 1), F.expr("substr(pattern, instr(pattern, '*') + 1)")
        fits = F.when(star == 0, spec == F.col("pattern")).otherwise(spec.startswith(before) & spec.endswith(after) & (F.char_length(spec) >= F.char_length("pattern") - 1))
        ordered = path_map.select("pattern", "paths", F.monotonically_increasing_id().alias("_m"))
        part = F.when(star == 0, "").otherwise(F.substring(spec, F.char_length(before) + 1, F.char_length(spec) - F.char_length("pattern") + 1))
        mapped = rest.join(F.broadcast(ordered), fits).select(*key, "_m", part.alias("_part"), F.posexplode("paths").alias("_k", "_path"))
        filled = F.when(F.instr("_path", "*") == 0, F.col("_path")).otherwise(F.concat(F.substring_index("_path", "*", 1), "_part", F.expr("substr(_path, instr(_path, '*') + 1)")))
        out = out.unionByName(mapped.select(*key, folded(filled).alias("base"), rank(F.lit(1), F.col("_m"), F.col("_k"))))
    cuts = F.split("uri", "(?:^|(?<=/))node_modules/")
    known = files.where(F.col("uri").rlike("(^|/)node_modules/")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.concat(F.array_join(F.slice(cuts, 1, i), "node_modules/"), F.lit("node_modules")))).alias("_in")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda i: F.array_join(F.concat(F.slice(parts, 1, i), F.array(F.lit("node_modules"))), "/"))
    walked = rest.select(*key, F.posexplode(above).alias("_k", "_in")).join(known, "_in")
    return out.unionByName(walked.select(*key, folded(F.concat_ws("/", "_in", spec)).alias("base"), rank(F.lit(2), F.lit(0), F.col("_k"))))


def probe_paths(bases: DataFrame) -> DataFrame:
    """bases (base) with every path it may stand for, and its priority."""
    base = F.col("base")
    stem = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    mapped = [F.concat(stem, F.lit(x)) for x in (".ts", ".tsx")]
    tried = [F.when(base != stem, x) for x in mapped] + [base] + [F.concat(base, F.lit(x)) for x in PROBES] + [F.concat(base, F.lit("/index" + x)) for x in PROBES]
    return bases.select("base", F.posexplode(F.array(*tried)).alias("priority", "path")).where("path is not null")


def resolve_imports(imports: DataFrame, files: DataFrame, path_map: DataFrame | None = None) -> DataFrame:
    """imports with resolved_uri: the first existing candidate; null if none. path_map: (pattern, paths), full paths.

    Many imports stand for one path, so paths are probed once each, not once for each import.
    """
    key = ["folder", "absolute", "module_specifier"]
    placed = imports.withColumns({"folder": S.directory(F.col("uri")), "absolute": F.col("uri").startswith("/")})
    bases = import_bases(placed.select(*key).distinct(), files, path_map)
    found = probe_paths(bases.select("base").distinct()).join(files.select(F.col("uri").alias("path")).distinct(), "path")
    best = bases.join(found, "base").groupBy(*key).agg(F.min_by("path", F.struct("rank", "priority")).alias("resolved_uri"))
    return placed.join(best, key, "left").select(*imports.columns, "resolved_uri")


def import_of(imports: DataFrame) -> DataFrame:
    """The first import of each local name in a file."""
    return first_by(imports, ["uri", "local_name"], "ordinal")


def references_through_imports(refs: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """References under their local alias, with the symbol they stand for."""
    exported = F.coalesce("exported_name", "local_name")
    bound = resolved.where("resolved_uri is not null").select("uri", "local_name", "resolved_uri", exported.alias("_x"))
    target = symbols.select(F.col("uri").alias("resolved_uri"), F.col("name").alias("_x"), F.col("id").alias("target_id")).distinct()
    local = bound.join(target, ["resolved_uri", "_x"]).select("uri", F.col("local_name").alias("symbol_name"), "resolved_uri", "target_id")
    return refs.join(local, ["uri", "symbol_name"])


def chase_reexports(requests: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """requests (request_id, uri, name) to definitions through re-export edges (uri, target, is_all, exported_names).

    Breadth first, at most depth levels; the nearest level wins, ties by uri and ordinal. A file is visited once for
    each request, so cycles end.
    """
    frontier = requests.select("request_id", "uri", "name")
    visited = frontier.select("request_id", "uri")
    names = symbols.select("uri", "name", "id", "line", "ordinal")
    found = None
    for level in range(depth + 1):
        hits = frontier.join(names, ["uri", "name"]).withColumn("level", F.lit(level))
        found = hits if found is None else found.unionByName(hits)
        if level == depth:
            break
        step = frontier.join(edges, "uri").where("is_all or array_contains(exported_names, name)").select("request_id", F.col("target").alias("uri"), "name").distinct()
        frontier = cut(step.join(visited, ["request_id", "uri"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("request_id", "uri"))
    return first_by(found, ["request_id"], "level", "uri", "ordinal")


def contained(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (uri, line, character) within ranges of the same file, ends inclusive."""
    r = ranges.select("uri", *(F.col(c).alias(f"r_{c}") for c in ranges.columns if c != "uri"))
    at, start, end = (F.struct(F.col(a).alias("l"), F.col(b).alias("c")) for a, b in (("line", "character"), ("r_start_line", "r_start_character"), ("r_end_line", "r_end_character")))
    return points.join(r, "uri").where(at.between(start, end))
