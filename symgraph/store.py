"""A versioned Parquet store of index tables, in buckets of files: a write makes new versions of the buckets that it touches,
then publishes a numbered pointer that names the version of every bucket."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .extract.index import TABLES, files_table, flatten

#: Files are dealt over so many buckets by a hash of their uri; a store keeps the number that it was made with.
BUCKETS = 32
SCHEMA_VERSION = 2
#: Pointers whose versions stay when others are removed, so that a reader can finish with what it has begun.
KEPT = 2


class Store:
    """Tables of TABLES plus files. Readers see whole versions only; a writer that dies leaves the last one standing.

    One writer at a time: of two that publish the same number, the second fails.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith(start))

    def _pointer(self, name: str) -> dict:
        at = json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])
        if at["schema"] != SCHEMA_VERSION:
            raise ValueError(f"{self.root} has schema {at['schema']}, not {SCHEMA_VERSION}; build it anew")
        return at

    def current(self) -> dict | None:
        """The last pointer: its number, the number of buckets, and by bucket [version, tables that have rows]."""
        found = self._names("pointer-")
        return self._pointer(found[-1]) if found else None

    def version(self) -> int | None:
        """Number of the last published pointer."""
        found = self._names("pointer-")
        return int(found[-1].removeprefix("pointer-")) if found else None

    def _bucket(self, at: dict | None) -> Column:
        return F.pmod(F.xxhash64("uri"), F.lit(at["of"] if at else self._buckets)).cast("int")

    def _read(self, table: str, at: dict | None, buckets: set[int] | None = None) -> DataFrame:
        kind = schema.struct(schema.FILES if table == "files" else TABLES[table])
        paths = [f"{self.root}/{v}/{table}/_bucket={b}" for b, (v, tables) in (at or {"buckets": {}})["buckets"].items() if table in tables and (buckets is None or int(b) in buckets)]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, table: str) -> DataFrame:
        return self._read(table, self.current())

    def _publish(self, at: dict | None, tables: dict[str, DataFrame], touched: set[int]) -> None:
        version = f"v-{uuid.uuid4().hex}"
        bucket = self._bucket(at)
        held: dict[int, list[str]] = {b: [] for b in touched}
        for table, rows in tables.items():
            folder = f"{self.root}/{version}/{table}"
            rows.withColumn("_bucket", bucket).repartition(max(1, len(touched)), "_bucket").sortWithinPartitions("_bucket", "uri").write.partitionBy("_bucket").parquet(folder)
            for s in self._fs.listStatus(self._path(folder)):
                if (name := s.getPath().getName()).startswith("_bucket="):
                    held[int(name.removeprefix("_bucket="))].append(table)
        buckets = dict(at["buckets"]) if at else {}
        buckets |= {str(b): [version, t] for b, t in held.items()}
        number = (at["number"] if at else 0) + 1
        out = self._fs.create(self._path(f"{self.root}/{version}/pointer"), True)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "number": number, "of": at["of"] if at else self._buckets, "buckets": buckets}).encode()))
        out.close()
        # a rename publishes all at once; the pointers before it stay as they are
        if not self._fs.rename(self._path(f"{self.root}/{version}/pointer"), self._path(f"{self.root}/pointer-{number:012d}")):
            raise RuntimeError(f"{self.root}: version {number} was published by another writer")
        self.vacuum()

    def vacuum(self, kept: int = KEPT) -> None:
        """Deletes pointers but the last ones, and versions that none of these names."""
        pointers = self._names("pointer-")
        named = {v for p in pointers[-kept:] for v, _ in self._pointer(p)["buckets"].values()}
        for name in [*pointers[:-kept], *(v for v in self._names("v-") if v not in named)]:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _touched(self, at: dict | None, *uris: DataFrame) -> set[int]:
        """Buckets of these files: no more rows than there are buckets come to the driver."""
        return {r[0] for u in uris for r in u.select(self._bucket(at)).distinct().collect()}

    def upsert(self, nested: DataFrame, gone: DataFrame | None = None) -> None:
        """Replaces the rows of the files in nested, and drops those of gone (uri). Other buckets keep their files."""
        # extraction is Python work and feeds every table, so it is computed once, on disk
        staged = f"{self.root}/.stage-{uuid.uuid4().hex}"
        nested.write.parquet(staged)
        nested = self.spark.read.schema(nested.schema).parquet(staged)
        replaced = nested.select("uri")
        if gone is not None:
            replaced = replaced.unionByName(gone.select("uri"))
        at = self.current()
        touched = self._touched(at, replaced)
        if touched or at is None:
            tables = {}
            for table in ("files", *TABLES):
                new = files_table(nested) if table == "files" else flatten(nested, table)
                tables[table] = self._read(table, at, touched).join(replaced.distinct(), "uri", "left_anti").unionByName(new)
            self._publish(at, tables, touched)
        self._fs.delete(self._path(staged), True)

    def delete(self, uris: DataFrame) -> None:
        at, gone = self.current(), uris.select("uri").distinct()
        touched = self._touched(at, gone)
        if at and touched:
            self._publish(at, {t: self._read(t, at, touched).join(gone, "uri", "left_anti") for t in ("files", *TABLES)}, touched)

    def touch(self, seen: DataFrame) -> None:
        """New mtime and size of files (uri, mtime, size) whose content is as stored."""
        at = self.current()
        touched = self._touched(at, seen)
        if at and touched:
            tables = {t: self._read(t, at, touched) for t in ("files", *TABLES)}
            now = seen.select("uri", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
            tables["files"] = tables["files"].join(now, "uri", "left").withColumns({"mtime": F.coalesce("_m", "mtime"), "size": F.coalesce("_s", "size")}).drop("_m", "_s")
            self._publish(at, tables, touched)

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def stale(self, now: DataFrame) -> DataFrame:
        """Stored files that a snapshot (uri, hash) no longer has."""
        return self.read("files").select("uri").join(now.select("uri"), "uri", "left_anti")
