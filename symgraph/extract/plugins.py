"""Framework plugins: per-symbol hooks in the extractor, and predicates over symbol tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import LIFECYCLE


class Plugin:
    """name is unique. visit() runs on executors for every symbol and may return symbols, references and metadata."""

    name = ""

    def visit(self, symbol: dict, reader, first: int, last: int) -> dict | None:
        return None

    def is_entry_point(self) -> Column:
        return F.lit(False)

    def resolve_references(self, symbols: DataFrame, refs: DataFrame) -> DataFrame:
        return refs


class Registry:
    def __init__(self, *plugins: Plugin):
        self.plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name} is registered already")
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name, None)

    def clear(self) -> None:
        self.plugins.clear()

    def all(self) -> list[Plugin]:
        return list(self.plugins.values())

    def is_entry_point(self) -> Column:
        return reduce(lambda a, b: a | b, (p.is_entry_point() for p in self.plugins.values()), F.lit(False))


class Angular(Plugin):
    name = "angular"

    def is_entry_point(self) -> Column:
        marks = F.from_json(F.get_json_object("metadata", "$.angular.decorators"), "array<string>")
        return F.col("name").isin(LIFECYCLE) | F.coalesce(F.size(marks) > 0, F.lit(False))


class NgRx(Plugin):
    name = "ngrx"

    def is_entry_point(self) -> Column:
        return F.coalesce(F.col("ngrx.role").isin("action", "effect"), F.lit(False))


def default_registry() -> Registry:
    return Registry(Angular(), NgRx())
