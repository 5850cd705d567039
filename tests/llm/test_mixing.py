import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import mixing

from .test_operators import EDGE, docs_of


def poisson_brute(u, rate):
    n, p = 0, np.exp(-rate)
    c = p
    while u >= c:
        n += 1
        p = p * rate / n
        c += p
    return n


def test_mixing(spark):
    source = {i: ("hot" if i % 3 == 0 else f"s{i % 5}") for i in range(600)} | {599: None}
    docs = docs_of(spark, ["ab" * (1 + i % 7) for i in range(600)], source=source)
    rates = mixing.rates(docs)
    by = {r.source: r.rate for r in rates.collect()}
    chars = {}
    for i in range(600):
        chars[source[i]] = chars.get(source[i], 0) + 2 * (1 + i % 7)
    root = sum(c**0.5 for c in chars.values())
    for s, c in chars.items():
        assert by[s] == pytest.approx(c**0.5 / root * sum(chars.values()) / c)
    got = mixing.mix(docs, rates).collect()
    for i in range(600):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        mine = sorted(r.copy_no for r in got if r.doc_id == i)
        assert mine == list(range(1, poisson_brute(u, by[source[i]]) + 1))
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got) and set(docs.columns) < set(got[0].asDict())
    weights = spark.createDataFrame([("hot", 3.0), ("s1", 1.0)], "source string, weight double")
    given = {r.source: r.rate for r in mixing.rates(docs, weights).collect()}
    assert given["s2"] == 0 and given["hot"] * chars["hot"] / (given["s1"] * chars["s1"]) == pytest.approx(3)


def test_mixing_edges(spark):
    docs = docs_of(spark, EDGE)
    assert mixing.mix(docs, mixing.rates(docs)).count() >= 0
    assert mixing.mix(docs.limit(0), mixing.rates(docs.limit(0))).count() == 0


def exact_inverse(u, rate):
    """By logarithms, term by term from 0."""
    n, c = 0, 0.0
    while True:
        c += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        if u < c:
            return n
        n += 1


def test_mixing_high_rates(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 700)
    rates = {"near": 500.0, "over": 501.0, "far": 2500.5, "most": 20000.25}
    docs = docs_of(spark, ["ab"] * 8, source={i: list(rates)[i % 4] for i in range(8)})
    got = mixing.mix(docs, spark.createDataFrame(list(rates.items()), "source string, rate double")).groupBy("doc_id", "source", "n_copies").agg({"copy_no": "max", "*": "count"}).collect()
    assert len(got) == 8
    for r in got:
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.n_copies == r["max(copy_no)"] == r["count(1)"] == exact_inverse(u, rates[r.source])


def test_tiny_source_passes(spark, tmp_path):
    rows = [(i, f"s{i}", "x" * 1_000_000) for i in range(4)] + [(9, "tiny", "y")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {r.source: r["count"] for r in mixing.op1_poisson_mix(spark, str(tmp_path)).groupBy("source").count().collect()}
    u = int(hashlib.md5(f"{mixing.SEED}:9".encode()).hexdigest()[:13], 16) / 2**52
    assert counts["tiny"] == exact_inverse(u, 4_000_001 / 4001)


def test_rate_of_ten_thousand(spark):
    docs = spark.createDataFrame([(5, "a"), (6, "a")], "doc_id long, source string")
    got = mixing.mix(docs, spark.createDataFrame([("a", 10_000.0)], "source string, rate double")).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("m"), F.max("n_copies").alias("c")).collect()
    for r in got:
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.n == r.m == r.c == exact_inverse(u, 10_000.0)


def test_clashing_columns_nulls_and_repeats(spark):
    names = "doc_id long, source string, text string, _of string, _RATE int, _place int, _part int, copy_no string, n_copies string, of int"
    rows = [(None, None, "t", "o", 1, 2, 3, "x", "y", 4)] * 3 + [(7, "s", "t" * 2_000_000, "o", 1, 2, 3, "x", "y", 4)] * 2
    docs = spark.createDataFrame(rows, names)
    got = mixing.mix(docs, spark.createDataFrame([(None, 6.5), ("s", 2.5)], "source string, rate double"))
    assert got.columns == [c for c in docs.columns if c not in ("copy_no", "n_copies")] + ["copy_no", "n_copies"]
    for r in got.groupBy("doc_id", "n_copies", "_of", "_RATE", "_place", "_part", "of").count().collect():
        assert r["count"] == r.n_copies * (3 if r.doc_id is None else 2) and (r._of, r._RATE, r._place, r._part, r.of) == ("o", 1, 2, 3, 4)


def test_repeats_of_one_id_spread(spark):
    docs = spark.range(1, numPartitions=2).crossJoin(spark.range(900)).select(F.lit(1).alias("doc_id"), F.lit("a").alias("source"))
    sizes = mixing.mix(docs, spark.createDataFrame([("a", 5.0)], "source string, rate double")).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 0.6 * sum(r["count"] for r in sizes)
