"""Search, ranking and selection over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_name(symbols: DataFrame, name: str, definitions_only: bool = True) -> DataFrame:
    found = symbols.where(F.col("name") == name)
    return found.where("is_definition") if definitions_only else found


def search(symbols: DataFrame, query: str, k: int = 200, open_uris: list[str] = (), current: str | None = None) -> DataFrame:
    """Fuzzy search: score, bonuses, one symbol for each position, best k. A blank query finds nothing."""
    if not query.strip():
        return symbols.where("false").withColumn("score", F.lit(0.0))
    scored = symbols.withColumn("_f", S.fuzzy_score(F.col("name"), query)).where("_f is not null")
    bonus = S.kind_bonus(F.col("kind"))
    if current is not None:
        bonus = bonus + S.context_bonus(F.col("uri"), list(open_uris), current)
    scored = scored.withColumn("score", F.round(F.col("_f") + bonus, 6)).drop("_f")
    best = first_by(scored, ["uri", "line", "character"], F.desc("score"), "name", "ordinal")
    return best.orderBy(F.desc("score"), "name", "uri", "line", "character").limit(k)


def relevance(symbols: DataFrame, query: str, k: int = 100, exact: float = 100, prefix: float | None = None) -> DataFrame:
    """Multiplied relevance: exact name, (prefix,) definition 2, exported 1.5; names that contain the query."""
    name = F.col("name")
    base = F.when(name == query, float(exact))
    base = base.when(F.lower(name).startswith(query.lower()), float(prefix)) if prefix else base
    score = base.otherwise(1.0) * F.when(F.col("is_definition"), 2.0).otherwise(1.0) * F.when(F.col("is_exported"), 1.5).otherwise(1.0)
    return symbols.where(F.lower(name).contains(query.lower())).withColumn("relevance", score).orderBy(F.desc("relevance"), "name", "uri", "ordinal").limit(k)


def complete(symbols: DataFrame, prefix: str, current: str, k: int = 50) -> DataFrame:
    """Completion items: what is visible from the file, first for each name, in order of the sort text."""
    other = F.col("uri") != current
    hidden = (other & (F.coalesce(F.col("visibility"), F.lit("")) == "private")) | (other & F.col("container_name").isNull() & F.coalesce(~F.col("is_exported"), F.lit(False)))
    seen = search(symbols, prefix, 1 << 30).where(~hidden)
    text = S.sort_text(F.col("uri"), F.col("kind"), F.col("is_exported"), F.col("name"), current)
    return first_by(seen.withColumn("sort_text", text), ["name"], F.desc("score"), "uri", "ordinal").orderBy("sort_text", "name").limit(k)


def proximity_ranked(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """candidates joined to call sites (site_id, name, site_uri, container), each scored; rank 1 is the winner.

    Where a site names a container that some candidate has, only such candidates stay.
    """
    both = sites.join(candidates, "name")
    match = F.coalesce(F.col("container_name") == F.col("container"), F.lit(False))
    both = both.withColumn("_m", match).withColumn("_any", F.max("_m").over(W.partitionBy("site_id"))).where("not _any or _m").drop("_m", "_any")
    both = both.withColumn("score", S.proximity(F.col("uri"), F.col("site_uri")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("score"), "uri", "line", "character", "ordinal")))


def proximity_winners(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """The winner of proximity_ranked for each site.

    A score depends on the site's name, folder and container alone, so each such context is ranked once, however many
    sites share it, and sites take their context's winner.
    """
    placed = sites.withColumn("_dir", S.directory(F.col("site_uri")))
    contexts = placed.select(F.col("name").alias("_name"), F.col("_dir").alias("_at"), F.col("container").alias("_container")).distinct()
    both = contexts.join(candidates.withColumn("_d", S.directory(F.col("uri"))), F.col("name") == F.col("_name")).drop("name")
    match = F.coalesce(F.col("container_name") == F.col("_container"), F.lit(False))
    both = both.withColumns({"_m": match, "score": S.folder_proximity(F.col("uri"), F.col("_d"), F.col("_at"))})
    won = first_by(both, ["_name", "_at", "_container"], F.desc("_m"), F.desc("score"), "uri", "line", "character", "ordinal").drop("_m", "_d")
    same = (F.col("name") == F.col("_name")) & (F.col("_dir") == F.col("_at")) & F.col("container").eqNullSafe(F.col("_container"))
    return placed.join(won, same).drop("_name", "_at", "_container", "_dir")


def best_scored(symbols: DataFrame, want: dict) -> DataFrame:
    """All symbols that share the best hybrid score."""
    c = {x: F.col(x) for x in ("name", "kind", "container_name", "full_container_path", "is_static", "uri")}
    # the whole-table best is found by one aggregate, not by a window that gathers all rows
    named = symbols.where(c["name"] == want["name"]).withColumn("score", S.hybrid_score(c["name"], c["kind"], c["container_name"], c["full_container_path"], c["is_static"], c["uri"], want))
    top = named.agg(F.max("score").alias("score"))
    return named.join(F.broadcast(top), "score")


def definition_rules(candidates: DataFrame) -> DataFrame:
    """Narrows candidates (cursor_id, cursor_uri, cursor_line, cursor_character, symbol columns) by the five rules."""
    at, start, end = (F.struct(F.col(a).alias("l"), F.col(b).alias("c")) for a, b in (("cursor_line", "cursor_character"), ("start_line", "start_character"), ("end_line", "end_character")))
    own = (F.col("uri") == F.col("cursor_uri")) & at.between(start, end)
    rows = candidates.where(~own)
    cursor = W.partitionBy("cursor_id")
    rows = rows.withColumn("_d", F.max("is_definition").over(cursor)).where("not coalesce(_d, false) or kind <> 'text'").drop("_d")
    named = W.partitionBy("cursor_id", "name")
    rows = rows.withColumns({"_c": F.max(F.col("kind") == "class").over(named), "_i": F.max(F.col("kind") == "interface").over(named)}).where("not (_c and _i) or kind = 'class'").drop("_c", "_i")
    rows = rows.where(~F.col("kind").isin(P.IMPORT_KINDS))
    rows = first_by(rows, ["cursor_id", "uri"], "start_line", "ordinal")
    rows = rows.withColumns({"_lo": F.min("name").over(cursor), "_hi": F.max("name").over(cursor), "_k": F.row_number().over(cursor.orderBy(S.kind_rank(F.col("kind")), "uri", "ordinal"))})
    return rows.where("_lo <> _hi or _k = 1").drop("_lo", "_hi", "_k")


def definitions_at(cursors: DataFrame, symbols: DataFrame) -> DataFrame:
    """What definition_rules leaves of all symbols of each cursor's name; cursors have a name and a unique cursor_id.

    Only the first rule looks at the cursor, and it drops symbols of the cursor's own file alone. What it drops decides by
    two flags (a definition is left; a class and an interface are) what the other rules keep, so for each name and pair of
    flags the best two files are found once. A place inside symbols of its name meets those of its own file only, and
    takes the better of what is left there and the best other file.
    """
    at, start, end = (F.struct(F.col(a).alias("l"), F.col(b).alias("c")) for a, b in (("cursor_line", "cursor_character"), ("start_line", "start_character"), ("end_line", "end_character")))
    place, counted = ["name", "cursor_uri", "cursor_line", "cursor_character"], {"_nd": "is_definition", "_nc": "kind = 'class'", "_ni": "kind = 'interface'"}
    flags = [(d, b) for d in (False, True) for b in (False, True)]

    def kept(d: bool, b: bool) -> Column:
        fits = ~F.col("kind").isin(P.IMPORT_KINDS)
        return fits & (F.col("kind") != "text" if d else F.lit(True)) & (F.col("kind") == "class" if b else F.lit(True))

    def firsts(among: Column) -> list[Column]:
        return [F.min_by("_s", F.when(kept(*f) & among, F.struct("start_line", "ordinal"))).alias(f"_c{i}") for i, f in enumerate(flags)]

    def counts(among: Column, mark: str) -> list[Column]:
        return [F.count(F.when(F.expr(what) & among, 1)).alias(n + mark) for n, what in counted.items()]

    def of_flags(prefix: str, left: dict[str, Column]) -> Column:
        d, b = left["_nd"] > 0, (left["_nc"] > 0) & (left["_ni"] > 0)
        return F.when(d & b, F.col(f"{prefix}3")).when(d, F.col(f"{prefix}2")).when(b, F.col(f"{prefix}1")).otherwise(F.col(f"{prefix}0"))

    def order(s: str) -> Column:
        return F.struct(S.kind_rank(F.col(f"{s}.kind")).alias("k"), F.col(f"{s}.uri").alias("u"), F.col(f"{s}.ordinal").alias("o"))

    rows = symbols.withColumn("_s", F.struct(*(c for c in symbols.columns if c != "name")))
    files = rows.groupBy("name", "uri").agg(*firsts(F.lit(True)), *counts(F.lit(True), ""))
    each = files.select("name", F.posexplode(F.array(*(f"_c{i}" for i in range(4)))).alias("_k", "_s")).where("_s is not null")
    each = each.withColumn("_n", F.row_number().over(W.partitionBy("name", "_k").orderBy(order("_s")))).where("_n <= 2")
    best = each.groupBy("name").agg(*(F.first(F.when((F.col("_k") == i) & (F.col("_n") == n), F.col("_s")), True).alias(f"_b{n}{i}") for i in range(4) for n in (1, 2)))
    names = files.groupBy("name").agg(*(F.sum(n).alias(n) for n in counted)).join(best, "name")

    near = cursors.select(*place).distinct().join(rows.withColumnRenamed("uri", "cursor_uri"), ["name", "cursor_uri"]).withColumn("_own", at.between(start, end))
    held = near.groupBy(*place).agg(F.max("_own").alias("_own"), *firsts(~F.col("_own")), *counts(F.col("_own"), "o")).where("_own").join(names, "name", "left")
    left = {n: F.col(n) - F.col(f"{n}o") for n in counted}
    held = held.select(*place, *(of_flags(p, left).alias(a) for p, a in (("_c", "_mine"), ("_b1", "_first"), ("_b2", "_second"))))
    held = held.withColumn("_other", F.when(F.col("_first.uri") == F.col("cursor_uri"), F.col("_second")).otherwise(F.col("_first")))
    won = F.when(F.col("_other").isNull() | (order("_mine") < order("_other")) & F.col("_mine").isNotNull(), F.col("_mine")).otherwise(F.col("_other"))
    held = held.select(*(F.col(c).alias(f"_at_{c}") for c in place), won.alias("_won"), F.lit(True).alias("_held"))

    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place]
    free = names.select("name", of_flags("_b1", {n: F.col(n) for n in counted}).alias("_free"))
    both = cursors.join(held, same, "left").join(free, "name", "left")
    found = both.withColumn("_s", F.when(F.col("_held"), F.col("_won")).otherwise(F.col("_free"))).where("_s is not null")
    return found.select(*cursors.columns, "_s.*")


def hover(symbols: DataFrame, name: str, uri: str, kind: str) -> DataFrame:
    """The symbol to describe: same file first, then same kind, then the first."""
    found = symbols.where(F.col("name") == name).withColumns({"_u": F.col("uri") != uri, "_k": F.col("kind") != kind})
    best = found.orderBy("_u", "_k", "uri", "ordinal").limit(1).drop("_u", "_k")
    signature = F.concat(F.col("kind"), F.lit(" "), F.when(F.coalesce("container_name", F.lit("")) != "", F.concat("container_name", F.lit("."))).otherwise(""), F.col("name"))
    return best.withColumn("signature", signature)
