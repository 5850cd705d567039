"""What stands at cursors: symbols, hover texts, rename targets, and the fallback by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from . import search

#: Why a place can't be renamed.
NO_SYMBOL, NOT_INDEXED, EXTERNAL = "No symbol found at this position", "Symbol not found in index", "Cannot rename symbols from external libraries"
#: Labels of kinds in messages; other kinds stand for themselves.
LABELS = {"class": "Class", "interface": "Interface", "function": "Function", "type": "Type", "enum": "Enum", "constant": "Constant", "variable": "Variable", "method": "Method"}


def symbol_at(cursors: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """cursors (cursor_id, cursor_uri, cursor_line, cursor_character) with name, kind and range of what stands there.

    A declared name comes before a reference, whose kind is always variable; of several the first by start and name, and of
    places that share a cursor_id the first by uri and line. A place is looked up once, however many cursors stand there:
    names that earlier ones of their line cover wholly can't win and go first, so a place meets few.
    """
    declared = symbols.select("uri", "line", "character", "name", "kind", F.lit(0).alias("_stage"))
    used = refs.select("uri", "line", "character", F.col("symbol_name").alias("name"), F.lit("variable").alias("kind"), F.lit(1).alias("_stage"))
    end = (F.col("character") + F.char_length("name")).alias("end_character")
    key = ["uri", "line", "_stage", "character", "end_character"]
    names = declared.unionByName(used).select("uri", "line", "_stage", "character", end, "name", "kind").where("end_character is not null")
    names = names.distinct().groupBy(*key).agg(F.min(F.struct("name", "kind")).alias("_m"))
    earlier = W.partitionBy("uri", "line", "_stage").orderBy("character").rangeBetween(W.unboundedPreceding, -1)
    from_ = F.greatest("character", F.max("end_character").over(earlier) + 1)
    names = names.withColumn("_from", from_).where("_from <= end_character")
    here = cursors.select("cursor_id", F.col("cursor_uri").alias("uri"), F.col("cursor_line").alias("line"), "cursor_character")
    place = ["uri", "line", "cursor_character"]
    met = here.select(*place).distinct().join(names, ["uri", "line"]).where(F.col("cursor_character").between(F.col("_from"), F.col("end_character")))
    order = ["_stage", "character", "name", "kind"]
    best = search.first_by(met.select(*place, "_stage", "character", "end_character", "_m.name", "_m.kind"), place, *order)
    at = search.first_by(here.join(best, place), ["cursor_id"], *order, "uri", "line")
    return at.select("uri", "line", "cursor_id", "character", "end_character", "name", "kind")


def signature() -> Column:
    """(kind) container.name [static] (...), the parts that apply."""
    full = F.concat(F.when(F.coalesce("container_name", F.lit("")) != "", F.concat("container_name", F.lit("."))).otherwise(""), "name")
    call = F.when(F.col("kind").isin("function", "method") & F.col("parameters_count").isNotNull(), F.when(F.col("parameters_count") > 0, "(...)").otherwise("()"))
    return F.concat_ws(" ", F.concat(F.lit("("), "kind", F.lit(")")), full, F.when(F.coalesce("is_static", F.lit(False)), "[static]"), call)


def framework_lines(role: Column, action_type: Column, is_group: Column, decorators: Column) -> Column:
    """Paragraphs about decorators and store roles; null if there are none."""
    has = lambda name: F.coalesce(F.array_contains(decorators, name), F.lit(False))
    of_class = F.when(has("Component"), "**Angular Component**").when(has("Directive"), "**Angular Directive**").when(has("Injectable"), "**Angular Service** (Injectable)")
    of_role = F.when((role == "action") & action_type.isNotNull(), F.concat(F.lit("**NgRx Action:** `"), action_type, F.lit("`"))).when(role == "effect", "**NgRx Effect**").when(role == "reducer", "**NgRx Reducer**")
    found = F.concat_ws("\n\n", of_class, F.when(has("Input"), "**@Input** property"), F.when(has("Output"), "**@Output** property"), of_role, F.when(F.coalesce(is_group, F.lit(False)), "**NgRx Action Group**"))
    return F.when(found != "", found)


def footer() -> Column:
    place = F.concat_ws(":", F.element_at(F.split("uri", r"[\\/]"), -1), F.col("line") + 1, F.col("character") + 1)
    return F.concat(F.lit("*Defined in:* `"), place, F.lit("`"))


def hover_text(frameworks: Column) -> Column:
    """The text for a symbol: signature, frameworks (may be null), place."""
    head = F.concat(F.lit("```typescript\n"), signature(), F.lit("\n```\n\n"))
    return F.concat(head, F.coalesce(F.concat(frameworks, F.lit("\n\n")), F.lit("")), footer())


def hovers(cursors: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """cursor_id and the symbol to describe: a definition in the cursor's file first, then one of the kind at the cursor."""
    at = symbol_at(cursors, symbols, refs).select("cursor_id", "name", F.col("uri").alias("_uri"), F.col("kind").alias("_kind"))
    met = at.join(symbols.where("is_definition"), "name").withColumns({"_u": F.col("uri") != F.col("_uri"), "_k": F.col("kind") != F.col("_kind")})
    return search.first_by(met, ["cursor_id"], "_u", "_k", "uri", "ordinal").drop("_u", "_k", "_uri", "_kind")


def prepare_rename(cursors: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """cursor_id with the range and name to rename, or why it can't be."""
    at = symbol_at(cursors, symbols, refs).select("cursor_id", "line", "character", "end_character", "name")
    known = symbols.where("is_definition").groupBy("name").agg(F.min(F.struct("uri", "ordinal")).alias("_first"))
    all_ = cursors.select("cursor_id").join(at, "cursor_id", "left").join(known, "name", "left")
    outside = F.col("_first.uri").contains("node_modules")
    error = F.when(F.col("name").isNull(), NO_SYMBOL).when(F.col("_first").isNull(), NOT_INDEXED).when(outside, EXTERNAL)
    return all_.select("cursor_id", "line", "character", "end_character", "name", error.alias("error"))


def by_word(cursors: DataFrame, symbols: DataFrame) -> DataFrame:
    """The last resort of a definition: the rules over all symbols of the word at the cursor (name), unless it's a keyword."""
    return search.definitions_at(cursors.where(~F.lower("name").isin(P.KEYWORDS)), symbols)


def messages(dead: DataFrame) -> DataFrame:
    """dead_code() with the message of each row."""
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("kind")], F.col("kind"))
    sure = F.when(F.col("confidence") == "high", "").otherwise(F.concat(F.lit(" ("), "confidence", F.lit(" confidence)")))
    return dead.withColumn("message", F.concat(F.lit("Unused export: "), label, F.lit(" '"), "name", F.lit("' is declared but never used in the workspace"), sure))
