"""WARC: deterministic sharded writer and reader.

Records are range-sorted by (page_id, a hash of url and html). Shards are equal stretches of bytes of that order: a light
pass sorts (key, size), exact running sums give the key at which each shard starts, and rows find their shard by those
keys, so that neither partitions nor retries of the input change a byte of the archive. A shard's task writes gzip
members, one a record, rolls to a new file when the compressed size passes the roll size, and makes headers and digests
anew from the payload. A file is written under a temporary name and renamed when whole, so a retried or speculative task
replaces a file by an equal one. The manifest inside the archive's folder, written last, names all files with sizes and
SHA-256; files that it doesn't name are never read, and temporary ones are deleted.

Payload: the html in UTF-8, null as empty. Of payloads of at least MIN_REVISIT bytes that are equal, the smallest
page_id's is the response and the others revisit it; shorter ones are all responses. Rows that repeat a page_id and its
payload are records of the same type each; equal rows of more than a shard's bytes are spread over shards as counted
copies. A null page_id sorts first, has no X-Page-ID, revisits a page that has an id, and is a response if none has its
payload. Null url: ``urn:page:<id>``. A very long page is one record and held once by its task. An empty table gives an
archive without files. Other columns than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialise, new_dir, partitions, remove, table

MIN_REVISIT = 100
ROLL_BYTES = 8 << 20
#: Bytes of payload and headers that a shard holds, as long as that makes no more than MOST_SHARDS.
SHARD_BYTES = 8 << 20
#: The starts of all shards are sent to every task: 16 bytes each.
MOST_SHARDS = 1 << 16
#: What headers add to a payload, about.
HEAD_BYTES = 600
_NO_ID = -(1 << 63)
LEVEL = 4
#: Fixed: archives of equal input are equal.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
COMMITTED, TEMPORARY = "_manifest", "_temporary"
MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"


def _head(version: bytes, fields: list[tuple[str, str]]) -> bytes:
    return version + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _one_line(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _name(page_id: int | None, digest: str, h: int, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}:{h}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: tuple[int, int] | None, h: int = 0, copy: int = 0) -> bytes:
    """A WARC/1.1 record; first: page and hash of the row that this one revisits; copy: its number among equal rows."""
    digest = hashlib.sha256(payload).hexdigest()
    http = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _name(page_id, digest, h, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url) if url else f"urn:page:{'null' if page_id is None else page_id}"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(first[0], digest, first[1], 0)), ("X-Refers-To-Page", str(first[0]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(b"WARC/1.1", fields) + block + b"\r\n\r\n"


def arrow_uri(folder: str) -> str:
    """A Hadoop address as one that Arrow's file systems know."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if folder.startswith(theirs):
            return ours + folder[len(theirs) :]
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


class Roller:
    """Writes members to files of about roll bytes, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.base = pafs.FileSystem.from_uri(arrow_uri(folder))
        self.fs.create_dir(f"{self.base}/{TEMPORARY}", recursive=True)
        self.shard, self.roll, self.part, self.out, self.done = shard, roll, 0, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        if self.out is None:
            self.temporary = f"{self.base}/{TEMPORARY}/{uuid.uuid4().hex}"
            self.out, self.sum, self.size, self.n, self.first = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0, page_id
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.n += 1
        self.last = page_id
        if self.size >= self.roll:
            self._finish()

    def _finish(self) -> None:
        self.out.close()
        name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.base}/{name}")
        self.done.append((name, self.n, self.size, self.sum.hexdigest(), self.first, self.last))
        self.part, self.out = self.part + 1, None

    def close(self) -> pa.RecordBatch:
        """The manifest rows of the shard, whose files are all whole now."""
        if self.out is not None:
            self._finish()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in self.done], t) for i, t in enumerate(kinds)], [x.split()[0] for x in MANIFEST.split(", ")])


def keys(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """A light row for each page: its place (pid, h) in the order, digest (null under least bytes) and bytes."""
    html = F.coalesce("html", F.lit(""))
    digest = F.when(F.octet_length(html) >= least, F.unhex(F.sha2(html.cast("binary"), 256)))
    return pages.select(*_place(), digest.alias("digest"), F.octet_length(html).cast("long").alias("size"))


def _place() -> list[Column]:
    page_id = F.col("page_id").cast("long")
    return [page_id.alias("page_id"), F.coalesce(page_id, F.lit(_NO_ID)).alias("pid"), F.xxhash64("url", "html").alias("h")]


def revisits(light: DataFrame) -> DataFrame:
    """Rows (pid, h, digest, first, first_h) of the keys whose payload a smaller page_id has."""
    known = light.where("digest is not null")
    firsts = known.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "h"))).alias("at"), F.count("*").alias("n"), F.max("page_id").alias("last"), F.max(F.col("page_id").isNull()).alias("unnamed"))
    firsts = firsts.where("at is not null and (at.page_id < last or unnamed)").select("digest", F.col("at.page_id").alias("first"), F.col("at.h").alias("first_h"))
    return known.join(firsts, "digest").where("page_id is null or page_id > first").select("pid", "h", "digest", "first", "first_h").distinct()


class Shards:
    """Where shards start: the shard of a key is that of the last start at or before it."""

    def __init__(self, starts: list[tuple[int, int, int]]):
        starts = sorted(starts)
        self.pid, self.h, self.shard = (np.array([x[i] for x in starts], np.int64) for i in range(3))

    def of(self, pid: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.pid, pid, "left"), np.searchsorted(self.pid, pid, "right")
        for p in np.unique(pid[high > low]):  # some shard starts within this page_id
            rows = np.flatnonzero(pid == p)
            a, b = low[rows[0]], high[rows[0]]
            high[rows] = a + np.searchsorted(self.h[a:b], h[rows], "right")
        return self.shard[np.maximum(high - 1, 0)] if len(self.shard) else np.zeros(len(pid), np.int64)


def layout(light: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[Shards, int, list[tuple[int, int]]]:
    """The shards, bytes of one, and the keys whose equal rows alone have more; all exact, from running sums."""
    spark = light.sparkSession
    sizes = light.groupBy("pid", "h").agg(F.sum(F.col("size") + HEAD_BYTES).alias("bytes"))
    ordered = sizes.repartitionByRange(partitions(spark), "pid", "h").sortWithinPartitions("pid", "h").select("*", F.spark_partition_id().alias("part"))
    ordered = materialise(ordered, "warc-keys")
    before, total = {}, 0
    for part, n in sorted(ordered.groupBy("part").agg(F.sum("bytes")).collect()):  # a row for each partition
        before[part], total = total, total + n
    each = max(shard_bytes, -(-total // MOST_SHARDS))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "h"])
        at = before[int(pdf.part.iloc[0])] + pdf.bytes.cumsum() - pdf.bytes
        shard = at // each
        # the first key of a part may start none, which changes no key's shard
        return pdf.assign(shard=shard)[(shard != shard.shift()) | (pdf.bytes > each)]

    # at most two rows for each shard and one for each part come to the driver
    found = ordered.groupBy("part").applyInPandas(cut, "pid long, h long, bytes long, part int, shard long").collect()
    remove(ordered)
    return Shards([(r.pid, r.h, r.shard) for r in found]), each, [(r.pid, r.h) for r in found if r.bytes > each]


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archive and returns its committed manifest; pages: (page_id, url, html)."""
    spark = pages.sparkSession
    light = materialise(keys(pages), "warc-light")
    shards, each, hot = layout(light, shard_bytes)

    @F.pandas_udf("long")
    def shard_of(pid: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shards.of(pid.to_numpy(), h.to_numpy()))

    nothing = {"url": "string", "html": "string", "digest": "binary", "first": "long", "first_h": "long"}
    lacks = lambda *names: [F.lit(None).cast(nothing[n]).alias(n) for n in names]
    columns = ["shard", "pid", "h", "kind", "page_id", "url", "html", "digest", "first", "first_h", "copy", "copies"]
    marks = revisits(light)
    one = [F.lit(0).cast("long").alias("copy"), F.lit(1).cast("long").alias("copies")]
    placed = pages.select(*_place(), "url", "html").withColumn("kind", F.lit(1))
    body = placed
    if hot:
        keys_of_hot = F.broadcast(spark.createDataFrame(hot, "pid long, h long"))  # no more than there are shards
        body = placed.join(keys_of_hot, ["pid", "h"], "left_anti")
    body = body.select("*", shard_of("pid", "h").alias("shard"), *lacks("digest", "first", "first_h"), *one).select(*columns)
    known = marks.select("*", shard_of("pid", "h").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), *lacks("url", "html"), *one).select(*columns)
    records = body.unionByName(known)
    if hot:  # equal rows meet as a count and are dealt to shards as copies of one
        room = F.greatest(F.lit(1), F.floor(F.lit(each) / (F.octet_length(F.coalesce("html", F.lit(""))) + HEAD_BYTES))).cast("long")
        alike = placed.join(keys_of_hot, ["pid", "h"]).groupBy("page_id", "pid", "h", "url", "html").agg(F.count("*").alias("n"))
        alike = alike.withColumn("digest", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))).join(marks, ["pid", "h", "digest"], "left").withColumn("room", room)
        parts = alike.withColumn("i", F.explode(F.expr("sequence(0l, (n - 1) div room)"))).withColumn("copy", F.col("i") * F.col("room"))
        records = records.unionByName(parts.select("*", (shard_of("pid", "h") + F.col("i")).alias("shard"), F.lit(1).alias("kind"), F.least(F.col("room"), F.col("n") - F.col("copy")).alias("copies")).select(*columns))
    ordered = records.repartitionById(partitions(spark), F.pmod("shard", F.lit(partitions(spark))).cast("int")).sortWithinPartitions("shard", "pid", "h", "kind", "digest", "url", "html")

    def run(batches):
        roller, known, last = None, {}, None
        for batch in batches:
            rows = [batch.column(c) for c in columns if c != "html"]
            for i, (shard, pid, h, kind, page_id, url, digest, first, first_h, copy, copies) in enumerate(zip(*(c.to_pylist() for c in rows), strict=True)):
                if roller is None or roller.shard != shard:
                    if roller:
                        yield roller.close()
                    roller, known, last = Roller(folder, shard, roll), {}, None
                if (pid, h) != last:
                    known, last, n = {}, (pid, h), 0
                if kind == 0:
                    known[digest] = first, first_h
                    continue
                payload = (batch.column("html")[i].as_py() or "").encode()
                revisited = (first, first_h) if first is not None else known.get(hashlib.sha256(payload).digest())
                for k in range(copies):
                    roller.add(page_id, record(page_id, url, payload, revisited, h, copy + k + n))
                n += copies
        if roller:
            yield roller.close()

    manifest = ordered.mapInArrow(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/{COMMITTED}")
    delete(spark, f"{folder}/{TEMPORARY}")
    remove(light)
    return committed(spark, folder)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the archive in folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{COMMITTED}")


def parse(data: bytes, step: int = 1 << 14):
    """(headers, block) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the last member is cut off")
            parts.append(unpacker.decompress(chunk))
            at += len(chunk) - len(unpacker.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the folder's manifest names, each checked against its digests."""
    manifest = committed(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    held = files.join(manifest.select("file", "sha256"), "file")

    def run(batches):
        for batch in batches:
            for file, content, expected in zip(*(batch.column(c) for c in ("file", "content", "sha256")), strict=True):
                data = content.as_py()
                if hashlib.sha256(data).hexdigest() != expected.as_py():
                    raise ValueError(f"{file}: not the bytes of the manifest")
                rows = []
                for fields, block in parse(data):
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{file}: block digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{file}: payload digest")
                    rows.append((int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None, file.as_py()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    return held.mapInArrow(run, RECORDS)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= {MIN_REVISIT}
"""
