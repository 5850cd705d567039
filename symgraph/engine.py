"""The public calls: build, update and query an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import index, plugins
from .operators import cursor, graph, liveness, resolve, search
from .sources import workspace
from .store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, registry: plugins.Registry | None = None, tsconfig: str | None = None):
        self.tsconfig = tsconfig
        self.spark, self.store = spark, Store(spark, root)
        self.registry = registry or plugins.default_registry()

    def build(self, tree: str, excluded: list[str] = ()) -> None:
        """Indexes a source tree anew."""
        self.store.clear()
        self.store.upsert(index.extract(workspace.scan(self.spark, tree, excluded), self.registry.all()))

    def update(self, tree: str, excluded: list[str] = ()) -> None:
        """Re-extracts what a tree changed, and drops what it lost. Only files with another mtime are read, and of these
        only those with another hash are extracted."""
        now, stored = workspace.listing(self.spark, tree, excluded), self.store.read("files")
        gone = stored.select("uri").join(now.select("uri"), "uri", "left_anti")
        # paths come to the driver, which lists the tree anyway
        paths = [r.path for r in workspace.needs_reindexing(now, stored).select("path").collect()]
        read = workspace.contents(self.spark, paths)
        state = workspace.changes_since(stored.join(read.select("uri"), "uri", "left_semi"), read)
        changed = read.join(state.where("state = 'added'"), "uri", "left_semi")
        same = [tuple(r) for r in read.join(state.where("state = 'added'"), "uri", "left_anti").select("uri", "mtime", "size").collect()]
        self.store.upsert(index.extract(changed, self.registry.all()), gone)
        if same:
            self.store.touch(self.spark.createDataFrame(same, "uri string, mtime double, size long"))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def search(self, query: str, k: int = 200, **context) -> DataFrame:
        return search.search(self.table("symbols"), query, k, **context)

    def complete(self, prefix: str, uri: str, k: int = 50) -> DataFrame:
        return search.complete(self.table("symbols"), prefix, uri, k)

    def imports(self) -> DataFrame:
        return self._resolved(self.table("imports"))

    def _resolved(self, rows: DataFrame) -> DataFrame:
        path_map = workspace.full_path_map(self.spark, self.tsconfig) if self.tsconfig else None
        return resolve.resolve_imports(rows, self.table("files"), path_map)

    def reexport_edges(self) -> DataFrame:
        found = self._resolved(self.table("reexports").withColumn("is_all", F.coalesce("is_all", F.lit(False))))
        return found.where("resolved_uri is not null").select("uri", F.col("resolved_uri").alias("target"), "is_all", "exported_names")

    def definitions(self, cursors: DataFrame) -> DataFrame:
        """cursors (cursor_id, cursor_uri, cursor_line, cursor_character, name): the definition of each; none of a keyword
        that nothing imports.

        An imported name is resolved to its file and through re-exports; any other by the rules over all candidates of
        its name. The first stage that answers a cursor wins.
        """
        symbols = self.table("symbols")
        first = resolve.import_of(self.imports()).where("resolved_uri is not null")
        bound = cursors.join(first.select(F.col("uri").alias("cursor_uri"), F.col("local_name").alias("name"), "resolved_uri", F.coalesce("exported_name", "local_name").alias("_x")), ["cursor_uri", "name"])
        requests = bound.select(F.col("cursor_id").alias("request_id"), F.col("resolved_uri").alias("uri"), F.col("_x").alias("name"))
        chased = resolve.chase_reexports(requests, self.reexport_edges(), symbols.where("is_definition"))
        by_import = chased.select(F.col("request_id").alias("cursor_id"), "uri", "name", "ordinal", F.lit(0).alias("stage"))
        by_name = cursor.by_word(cursors, symbols).select("cursor_id", "uri", "name", "ordinal", F.lit(1).alias("stage"))
        return search.first_by(by_import.unionByName(by_name), ["cursor_id"], "stage")

    def references(self, name: str) -> DataFrame:
        """References by name, under aliases of imports too, and declarations; one for each position."""
        symbols, refs = self.table("symbols"), self.table("refs")
        columns = ["uri", "line", "character", "end_line", "end_character"]
        plain = refs.where(F.col("symbol_name") == name).select(*columns)
        targets = symbols.where(F.col("name") == name)
        alias = resolve.references_through_imports(refs, self.imports(), targets).select(*columns)
        own = targets.where("is_definition").select("uri", "line", "character", F.col("line").alias("end_line"), (F.col("character") + F.char_length("name")).alias("end_character"))
        return plain.unionByName(alias).unionByName(own).dropDuplicates(["uri", "line", "character"])

    def rename_edits(self, name: str, new_name: str) -> DataFrame:
        """Edits by file, bottom up; names declared in node_modules can't be renamed."""
        outside = self.table("symbols").where((F.col("name") == name) & F.col("uri").contains("node_modules"))
        edits = self.references(name).join(outside.select(F.lit(1).alias("_o")).distinct(), F.lit(True), "left_anti")
        return edits.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("line", "character", "end_line", "end_character", F.lit(new_name).alias("text"))), asc=False).alias("edits"))

    def implementations(self, name: str) -> DataFrame:
        return graph.implementations(graph.inherits(self.table("symbols")), name)

    def impacted_files(self, uri: str, max_depth: int = 3) -> DataFrame:
        edges = self.imports().where("resolved_uri is not null").select("uri", F.col("resolved_uri").alias("target_uri"))
        return graph.impacted_files(edges, uri, max_depth)

    def dead_code(self, **options) -> DataFrame:
        """Unused exports, without entry points of plugins and what a public marker stands above."""
        alive = self.table("symbols").where(self.registry.is_entry_point() | F.coalesce("is_public", F.lit(False))).select("uri", "name").distinct()
        return liveness.dead_code(self.table("symbols"), self.table("refs"), **options).join(alive, ["uri", "name"], "left_anti")

    def unused_messages(self, **options) -> DataFrame:
        return cursor.messages(self.dead_code(**options))

    def symbol_at(self, cursors: DataFrame) -> DataFrame:
        """cursors (cursor_id, cursor_uri, cursor_line, cursor_character) with the name, kind and range at each."""
        return cursor.symbol_at(cursors, self.table("symbols"), self.table("refs"))

    def definitions_at(self, cursors: DataFrame) -> DataFrame:
        """definitions() of what stands at each cursor."""
        names = self.symbol_at(cursors).select("cursor_id", "name")
        return self.definitions(cursors.join(names, "cursor_id"))

    def hover(self, cursors: DataFrame) -> DataFrame:
        """cursor_id and the text to show there."""
        marks = F.from_json(F.get_json_object("metadata", "$.angular.decorators"), "array<string>")
        lines = cursor.framework_lines(F.col("ngrx.role"), F.col("ngrx.type"), F.col("ngrx.is_group"), marks)
        return cursor.hovers(cursors, self.table("symbols"), self.table("refs")).select("cursor_id", "uri", "name", cursor.hover_text(lines).alias("text"))

    def prepare_rename(self, cursors: DataFrame) -> DataFrame:
        return cursor.prepare_rename(cursors, self.table("symbols"), self.table("refs"))

    def stats(self) -> DataFrame:
        """Files, symbols and references of the index, and when it was last written."""
        files = self.table("files").agg(F.count("*").alias("n_files"), F.count("skip_reason").alias("n_skipped"), F.sum("n_symbols").alias("n_symbols"), F.max("last_indexed_at").alias("last_indexed_at"))
        return files.crossJoin(F.broadcast(self.table("refs").agg(F.count("*").alias("n_refs"))))

    def resolve_links(self) -> DataFrame:
        groups = self.table("symbols").where("ngrx.is_group and ngrx.events is not null").select("name", "ordinal", F.col("ngrx.events").alias("events"))
        return resolve.resolve_links(self.table("pending"), groups)

    def exports(self, uri: str) -> DataFrame:
        """Names that a file exports, by itself and through re-exports."""
        symbols = self.table("symbols").where("is_exported and container_name is null")
        start = self.spark.createDataFrame([(uri,)], "node string")
        edges = self.reexport_edges()
        whole = graph.reach(edges.where("is_all").select(F.col("uri").alias("src"), F.col("target").alias("dst")), start, 5).select(F.col("node").alias("uri"))
        named = edges.join(whole, "uri", "left_semi").where("exported_names is not null").select(F.col("target").alias("uri"), F.explode("exported_names").alias("name"))
        return symbols.join(whole, "uri", "left_semi").select("uri", "name", "kind").unionByName(symbols.join(named, ["uri", "name"], "left_semi").select("uri", "name", "kind")).distinct()
