"""Sources: source trees, prebuilt JSON indexes, snapshots, path maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..streaming.incremental import changes


_FILE = "path string, modificationTime timestamp, length long, content binary"


def _uri() -> Column:
    return S.normal_uri(F.regexp_replace("path", "^file:(//)?(?=/)", ""))


def _content() -> Column:
    """Text of a file; null if it isn't UTF-8, which extraction turns into a skip reason."""
    return F.try_validate_utf8(F.col("content").cast("string"))


def listing(spark: SparkSession, root: str, excluded: list[str] = (), max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """Indexable files under root: (uri, path, size, mtime). No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where(F.col("length") <= max_bytes).where(P.indexable(_uri(), F.col("length"), list(excluded), max_bytes))
    return kept.select(_uri().alias("uri"), "path", F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime"))


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files (uri, content, size, mtime, hash): content is null where it isn't UTF-8, hash is that of the bytes."""
    if not paths:
        return spark.createDataFrame([], "uri string, content string, size long, mtime double, hash string")
    files = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths])
    return files.select(_uri().alias("uri"), _content().alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("hash"))


def scan(spark: SparkSession, root: str, excluded: list[str] = (), max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """Indexable files under root as contents() has them. Files over max_bytes are dropped before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.where(F.col("length") <= max_bytes).where(P.indexable(_uri(), F.col("length"), list(excluded), max_bytes))
    return kept.select(_uri().alias("uri"), _content().alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("hash"))


def scan_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream of change events, one for each new file."""
    rows = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(root)
    return rows.where(P.indexable(_uri(), F.col("length"))).select(_uri().alias("uri"), F.lit("change").alias("event_type"), _content().alias("content"), F.col("modificationTime").alias("ts"))


def static_index(spark: SparkSession, path: str) -> DataFrame:
    """A prebuilt index, JSON files of {"symbols": [...]} or a bare array; unreadable files in a folder are skipped."""
    symbol = "struct<name: string, kind: string, containerName: string, location: struct<uri: string, line: int, character: int>>"
    files = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<symbols: array<{symbol}>>")["symbols"]
    bare = F.from_json("value", f"array<{symbol}>")
    rows = files.select(F.explode(F.when(F.trim("value").startswith("["), bare).otherwise(wrapped)).alias("s"))
    return rows.select(F.col("s.location.uri").alias("uri"), F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), F.col("s.location.line").alias("line"), F.col("s.location.character").alias("character"), F.col("s.containerName").alias("container_name")).where("name is not null")


def changes_since(stored: DataFrame | None, now: DataFrame) -> DataFrame:
    """Rows (uri, state): all added without a stored snapshot; of two snapshots, existing changes are added, missing ones deleted."""
    if stored is None:
        return now.select("uri", F.lit("added").alias("state"))
    found = changes(stored, now).where("state <> 'same'")
    return found.select("uri", F.when(F.col("state") == "changed", "added").otherwise(F.col("state")).alias("state"))


def needs_reindexing(files: DataFrame, file_meta: DataFrame) -> DataFrame:
    """Files with no metadata, no stored mtime, or another mtime."""
    meta = file_meta.select("uri", F.col("mtime").alias("_m"))
    return files.join(meta, "uri", "left").where(F.col("_m").isNull() | ~F.col("_m").eqNullSafe(F.col("mtime"))).drop("_m")


def path_map(spark: SparkSession, tsconfig: str) -> DataFrame:
    """Rows (pattern, paths) of a configuration's compilerOptions.paths."""
    text = spark.read.text(tsconfig, wholetext=True)
    entries = F.from_json(F.get_json_object("value", "$.compilerOptions.paths"), "map<string, array<string>>")
    return text.select(F.explode(entries).alias("pattern", "paths"))


def full_path_map(spark: SparkSession, tsconfig: str) -> DataFrame:
    """path_map with paths from the configuration's folder and its baseUrl on, as resolve_imports takes them."""
    text = spark.read.text(tsconfig, wholetext=True)
    base = F.coalesce(F.get_json_object("value", "$.compilerOptions.baseUrl"), F.lit(".")).alias("_base")
    folder = S.directory(S.normal_uri(F.regexp_replace(F.lit(tsconfig), "^file:(//)?(?=/)", "")))
    under = lambda a, b: F.when(b.startswith("/"), b).otherwise(F.concat_ws("/", a, b))
    rows = path_map(spark, tsconfig).crossJoin(F.broadcast(text.select(base)))
    return rows.select("pattern", F.transform("paths", lambda p: under(under(folder, F.col("_base")), p)).alias("paths"))
