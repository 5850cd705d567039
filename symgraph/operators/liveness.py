"""Dead code: exported symbols that nothing outside their file uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P


def dead_code(symbols: DataFrame, refs: DataFrame, scope: str | None = None, globs: list[str] = (), entry_globs: list[str] | None = None, include_tests: bool = False) -> DataFrame:
    """Candidates with reason and confidence. One aggregate of the references replaces a query for each symbol.

    A name is alive if another file refers to it, or a reference stands inside another exported symbol's range or
    container in its own file. Confidence falls with the number of positions in the own file that use the name.
    """
    u = F.col("uri")
    files = P.in_scope(u, scope) & ~P.unanalysed(u, list(globs), include_tests) & ~P.entry_point(u, entry_globs)
    exported = symbols.where(files & P.exportable(F.col("container_name"), F.col("kind")) & ~P.framework_alive(F.col("name")))
    uses = refs.select(F.col("symbol_name").alias("name"), F.col("uri").alias("ref_uri"), "line", "character", "container_name", "is_import").distinct()
    where = uses.groupBy("name").agg(F.min("ref_uri").alias("lo"), F.max("ref_uri").alias("hi"))
    unused = exported.join(where, "name", "left").where("lo is null or (lo = uri and hi = uri)").drop("lo", "hi")
    # only names without outside uses go on: their uses in the own file, all of them (for confidence) and those that
    # another exported symbol makes. Null-safe keys keep the optimizer from testing all the file patterns above on each use
    key = F.col("uri").eqNullSafe(F.col("_u")) & F.col("name").eqNullSafe(F.col("_n"))
    own = uses.withColumnRenamed("ref_uri", "uri").withColumnRenamed("container_name", "ref_container")
    own = own.join(unused.select(F.col("uri").alias("_u"), F.col("name").alias("_n")).distinct(), key, "left_semi")
    counted = own.groupBy(F.col("uri").alias("_u"), F.col("name").alias("_n")).agg(F.countDistinct("line", "character").alias("local_uses"))
    holders = exported.select(F.col("uri").alias("_u"), F.col("name").alias("holder"), "start_line", "start_character", "end_line", "end_character")
    at, start, end = (F.struct(F.col(a).alias("l"), F.col(b).alias("c")) for a, b in (("line", "character"), ("start_line", "start_character"), ("end_line", "end_character")))
    used = own.where("not coalesce(is_import, false)").join(holders, F.col("uri").eqNullSafe(F.col("_u")))
    used = used.where((F.col("holder") != F.col("name")) & ((F.col("ref_container") == F.col("holder")) | at.between(start, end)))
    alive = used.select(F.col("uri").alias("_u"), F.col("name").alias("_n")).distinct()
    dead = unused.join(alive, key, "left_anti").join(counted, key, "left").drop("_u", "_n")
    n = F.coalesce("local_uses", F.lit(0))
    return dead.withColumns({"local_uses": n, "confidence": F.when(n == 0, "high").when(n < 3, "medium").otherwise("low"), "reason": F.when(n == 0, "no references").otherwise("only local references")})


def barrel_only(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Exported symbols whose references from other files all stand in barrel files."""
    exported = symbols.where(P.exportable(F.col("container_name"), F.col("kind"))).select("uri", "name", "ordinal")
    uses = refs.select(F.col("symbol_name").alias("name"), F.col("uri").alias("ref_uri")).distinct()
    barrel = F.col("ref_uri").rlike(r"(^|/)(index|public-api|barrel)\.[jt]s$")
    cross = exported.join(uses, "name").where("ref_uri <> uri").groupBy("uri", "name", "ordinal").agg(F.bool_and(barrel).alias("all_barrels"), F.count("*").alias("n_files"))
    return cross.where("all_barrels").select("uri", "name", "ordinal", "n_files")


def totals(dead: DataFrame) -> DataFrame:
    return dead.groupBy("confidence").agg(F.count("*").alias("n"), F.countDistinct("uri").alias("n_files"))
