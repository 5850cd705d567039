"""Helpers shared by the corpus operators: tables, the shared folder, Arrow text blocks, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20
#: Edges whose components one task finds: 16 MB, some 100 MB while it works.
TASK_EDGES = 1 << 20
#: Documents for each task that writes rows of them without comparing any: more tasks than that cost more than they share.
TASK_DOCS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/symgraph/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, docs: int = 0) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    With docs, the number of documents that df is about, no more tasks write it than one for each TASK_DOCS, and 8.
    """
    path = new_dir(df.sparkSession, name)
    (df.coalesce(8 + docs // TASK_DOCS) if docs else df).write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables of materialise(), once all that was to be read from them has been written."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this that df hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_array(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets; null becomes empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings of a large_string array, and the n + 1 offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES):
    """Slices of the batch with about limit bytes of text each (one row at least), with their texts."""
    texts = text_array(batch.column(text))
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of edges (a, b), in order, and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root != (further := root[root])).any():
            root = further
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _forest(batches, limit: int = TASK_EDGES):
    """Edges (a, b) of a stream as stars around the smallest nodes, limit edges at a time."""
    held, n = [], 0

    def stars():
        nodes, low = connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return low[nodes != low], nodes[nodes != low]

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        n += len(batch)
        if n >= limit:
            held = [stars()]
            n = len(held[0][0])
            if 2 * n > limit:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], ["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node reachable.

    Each task first makes a forest of its own edges. If these are limit edges or fewer, one task connects them; any more go
    round by round (propagated).
    """

    def label(batches):
        found = [[x.column(c).to_numpy() for c in ("a", "b")] for x in batches]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in connected(*(np.concatenate(x) for x in zip(*found, strict=True)))], ["node", "component"])

    own = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    forest = materialise(own.mapInArrow(lambda batches: _forest(batches, limit), "a long, b long"), "forest")
    if forest.count() > limit:
        labels = propagated(forest)
    else:
        labels = materialise(forest.coalesce(1).mapInArrow(label, "node long, component long"), "labels")
    remove(forest)
    return labels


def propagated(edges: DataFrame) -> DataFrame:
    """components() of any number of edges (a, b).

    Minimum labels travel along edges and jump through their owners' labels; each round is written to the shared folder
    and the one before it deleted. No row is collected. Joins look labels up by a unique key, so a hot node splits as a
    skewed join.
    """
    both = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))
    pairs = materialise(edges.select(F.inline(both)).distinct(), "pairs")  # edges are made once
    labels = materialise(pairs.groupBy(F.col("s").alias("node")).agg(F.least(F.col("s"), F.min("d")).alias("label"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        by = labels.select(F.col("node").alias("d"), F.col("label").alias("seen"))
        near = pairs.join(by, "d").groupBy(F.col("s").alias("node")).agg(F.min("seen").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        low = F.least("low", F.coalesce("far", "low"))
        after = materialise(step.join(jump, "low", "left").select("node", low.alias("label"), (low != F.col("label")).alias("changed")), "labels")
        remove(labels)
        labels = after
    remove(pairs)
    return labels.select("node", F.col("label").alias("component"))
