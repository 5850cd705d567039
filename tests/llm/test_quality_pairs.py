import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from symgraph.llm import common, quality_pairs

from .test_operators import EDGE, docs_of, words  # noqa: F401


def test_quality(spark, words):
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(500):
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        if i % 4 == 0:
            t = [w.upper() + "!!" for w in t]
        texts.append(" ".join(t))
        labels.append((i, int(i % 4 != 0)))
    vectors = quality_pairs.features(docs_of(spark, texts))
    ranker = quality_pairs.train(vectors, spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = vectors.select("doc_id", common.held_out().alias("h"), ranker.score(vectors.f).alias("s")).collect()
    assert len(scored) == 500 and all(0 <= r.s <= 1 for r in scored)
    assert np.mean([(r.s >= quality_pairs.CUT) == (r.doc_id % 4 != 0) for r in scored if r.h]) > 0.98


def test_quality_edges(spark):
    vectors = quality_pairs.features(docs_of(spark, EDGE))
    got = [r.f for r in vectors.collect()]
    assert len(got) == len(EDGE) and np.isfinite(np.array(got)).all()
    for labels, base in (([], 0.5), ([(1, 1), (3, 1)], 1.0), ([(1, None)], 0.5), ([(None, 1)], 0.5)):
        ranker = quality_pairs.train(vectors, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert ranker.base == base and not ranker.weights.any()
    assert quality_pairs.features(docs_of(spark, EDGE).limit(0)).count() == 0


def brute_features(text):
    """FEATURES of one text in plain Python."""
    data, words = (text or "").encode(), [w for w in (text or "").encode().split(b" ")]
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    size, n = max(1, len(data)), max(1, len(words))
    share = lambda chars: sum(b in chars for b in data) / size
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    lines = data.count(b"\n")
    rows = [x for x in (text or "").split("\n") if x.strip()]
    capitals = sum(sum("A" <= c <= "Z" for c in w) >= 2 for w in words)
    return [
        share(b" \t\n\x0b\x0c\r"), share(bytes(range(65, 91))), share(bytes(range(97, 123))), share(bytes(range(48, 58))), share(b"#*$%&|<>"), share(b"!"), share(b"|"),
        share(b".,;:?'\"()-"), share(bytes(range(128, 256))), math.log1p(len(data)), mean, math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean)), float(lines == 0),
        1 - len(set(rows)) / max(1, len(rows)) if lines else 0.0, 1 - len(set(words)) / n, sum(x > 20 for x in lengths) / n, capitals / n, math.log1p(lines),
    ]


def brute_fit(f, label, pairs, seed=3):
    """Weights by plain gradient descent on the mean logistic loss of the same pairs."""
    good, bad = [i for i, y in enumerate(label) if y == 1], [i for i, y in enumerate(label) if y == 0]
    scale = [max(1e-6, float(np.std([row[j] for row in f]))) for j in range(len(f[0]))]
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    x = np.array([[(f[i][j] - f[k][j]) / scale[j] for j in range(len(scale))] for i, k in zip(a, b, strict=True)])
    w = np.zeros(len(scale))
    for _ in range(60_000):
        slope = -(x / (1 + np.exp(np.clip(x @ w, -500, 500)))[:, None]).mean(0) + quality_pairs.L2 * w
        w -= 0.6 * slope
        if np.abs(slope).max() < 1e-9:
            break
    return w / scale


def test_equals_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(quality_pairs, "PAIRS", 150)
    monkeypatch.setattr(quality_pairs.Ranker.fit.__func__, "__defaults__", (150, quality_pairs.L2, 3))
    rnd = random.Random(12)
    texts, labels = {}, []
    for i in range(160):
        t = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        good = rnd.random() < 0.5
        texts[i] = (" " if rnd.random() < 0.5 else "\n").join(w.upper() if not good and rnd.random() < 0.4 else w for w in t)
        if i % 5:
            labels.append((i, int(good)))
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    known = [(i, y) for i, y in labels if not held[i]]
    f = {i: np.float32(brute_features(t)).astype(float) for i, t in texts.items()}
    vectors = quality_pairs.features(docs_of(spark, texts))
    for r in vectors.collect():
        assert np.allclose(r.f, f[r.doc_id], rtol=1e-5, atol=1e-6)
    w = brute_fit([f[i] for i, _ in known], [y for _, y in known], 150)
    raw = sorted(float(f[i] @ w) for i, _ in known)
    bad = sum(1 - y for _, y in known)
    cut = (raw[bad - 1] + raw[bad]) / 2
    ranker = quality_pairs.train(vectors, spark.createDataFrame(labels * 2, "doc_id long, quality int"))
    got = {r.doc_id: (r.h, r.s) for r in vectors.select("doc_id", common.held_out().alias("h"), ranker.score(vectors.f).alias("s")).collect()}
    for i in texts:
        assert got[i][0] == held[i] and abs(got[i][1] - 1 / (1 + math.exp(-(float(f[i] @ w) - cut + math.log(0.7 / 0.3))))) < 1e-3


def test_ties_at_the_threshold_pass(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(40)] + [(None, "x")], "doc_id long, text string")
    ranker = quality_pairs.train(quality_pairs.features(docs), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    scored = quality_pairs.features(docs).select("doc_id", common.held_out().alias("h"), ranker.score(F.col("f")).alias("s")).collect()
    assert all(r.s == quality_pairs.CUT for r in scored if r.doc_id is not None) and [r.h for r in scored if r.doc_id is None] == [False]


def test_order_statistic(spark):
    rnd = random.Random(4)
    values = [rnd.choice([1.5, rnd.random(), rnd.gauss(0, 1e6), -3.25]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for place in (0, 1, 250, 251, 498, 499):
        assert quality_pairs.order_statistic(rows, "x", place, few=8) == sorted(values)[place]


def test_repeated_ids_and_a_very_long_text(spark):
    rows = [(1, "Good words in a line.\n" * 60_000), (1, "BAD!! " * 30), (2, "BAD!! " * 30), (3, "good words")] * 3
    vectors = quality_pairs.features(spark.createDataFrame(rows, "doc_id long, text string"))
    ranker = quality_pairs.train(vectors, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int"))
    assert vectors.count() == 12 and np.isfinite(ranker.weights).all() and np.isfinite(ranker.threshold)
