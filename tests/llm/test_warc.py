import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import warc

SCHEMA = "page_id long, url string, html string, first long, digest string, shard int, h string"


def pages_of(spark, rows):
    """Pages with columns whose names clash with those that the writer makes."""
    return spark.createDataFrame([(*r, 1, "d", 2, "h") for r in rows], SCHEMA)


def brute(rows):
    """Result rows of (page_id, url, html) in plain Python."""
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h in least and (i is None or least[h] < i)
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    return sorted(want, key=str)


def files(folder):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.glob("*.warc.gz")}


def test_archive(spark, tmp_path):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://a/{i}", f"{body}{i % 7}é") for i in range(60)]
    rows += [(100, None, None), (101, "u v", ""), (102, "u", ""), (3, "http://a/3", f"{body}3é"), (200, "u", "short"), (201, "u", "short"), (-5, "neg", "y" * 150), (7, "other", "y" * 150)]
    rows += [(None, "n", "n"), (None, None, f"{body}3é"), (None, "n", "z" * 300), (None, "n", "z" * 300), (None, None, None), (300, "big", "é" * 700_000)]
    pages = pages_of(spark, rows)
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    manifests = [warc.write(p, f, roll=2000, shard_bytes=5000) for p, f in zip((pages.repartition(4), pages.repartition(2)), folders, strict=True)]
    first, second = ([tuple(r) for r in m.orderBy("file").collect()] for m in manifests)
    assert first == second and len(first) > 3 and not list(tmp_path.glob("*/_temporary"))
    for name, n, size, digest, *_ in first:
        data = (tmp_path / "a" / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == digest and len(list(warc.parse(data))) == n
    got = [tuple(r) for r in warc.read(spark, folders[0]).drop("url", "file").collect()]
    assert sorted(got, key=str) == brute(rows)
    names = [f["WARC-Record-ID"] for name, *_ in first for f, _ in warc.parse((tmp_path / "a" / name).read_bytes())]
    asked = [f["WARC-Refers-To"] for name, *_ in first for f, _ in warc.parse((tmp_path / "a" / name).read_bytes()) if "WARC-Refers-To" in f]
    assert len(set(names)) == len(names) == len(rows) and set(asked) <= set(names)
    (tmp_path / "a" / "pages-000000-99999.warc.gz").write_bytes(b"left over")
    assert warc.read(spark, folders[0]).count() == len(rows)
    broken = tmp_path / "a" / first[0][0]
    broken.write_bytes(broken.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="not the bytes of the manifest"):
        warc.read(spark, folders[0]).count()
    assert zlib.decompress((tmp_path / "b" / first[1][0]).read_bytes(), 31).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert warc.write(pages_of(spark, []), folder).count() == 0 and warc.read(spark, folder).count() == 0


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    pages = spark.range(20_000).selectExpr("id * id % 99991 as page_id", "concat('http://h/', id) as url", "repeat(cast(id % 9000 as string), 10 + cast(id % 40 as int)) as html")
    got = []
    for n in (2, 5):
        warc.write(pages.repartition(n), f"file://{tmp_path}/{n}", roll=60_000, shard_bytes=1 << 20)
        got.append(files(tmp_path / str(n)))
    assert got[0] == got[1] and len(got[0]) > 10


def test_a_third_of_equal_rows_spreads_over_shards(spark, tmp_path):
    html = "same page " * 30
    rows = [(i, f"u{i}", f"page {i} " * 20) for i in range(400)] + [(50, "u", html)] * 200 + [(70, "v", html)] * 3
    got = []
    for n in (1, 4):
        warc.write(pages_of(spark, rows).repartition(n), f"file://{tmp_path}/{n}", roll=1 << 20, shard_bytes=20_000)
        got.append(files(tmp_path / str(n)))
    assert got[0] == got[1]
    read = warc.read(spark, f"file://{tmp_path}/1")
    assert sorted((tuple(r) for r in read.drop("url", "file").collect()), key=str) == brute(rows)
    assert read.where("page_id = 50").select("file").distinct().count() >= 8
    most = read.groupBy("file").agg(F.sum(F.col("payload_bytes") + warc.HEAD_BYTES).alias("n")).agg(F.max("n")).first()[0]
    assert most < 45_000


def test_shards_of_keys():
    shards = warc.Shards([(5, 10, 1), (0, 0, 0), (5, 90, 2), (9, -4, 7)])
    pid, h = np.array([0, 4, 5, 5, 5, 5, 8, 9, 9, 12]), np.array([1, 99, 9, 10, 89, 90, 0, -5, -4, 0])
    assert shards.of(pid, h).tolist() == [0, 0, 0, 1, 1, 2, 2, 2, 7, 7]
