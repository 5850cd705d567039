import numpy as np

from symgraph.llm import maxscore


def test_maxscore(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)) * 0.2
    x[100:130] = x[7]
    x[200:400] = np.abs(x[200:400])
    rows = [(int(i), [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] * 16, 0), (1004, [], 0), (1100, [0.0] * 16, 0), (1101, [0.5], 0), (7, rows[7][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, s int").repartition(3)
    valid = maxscore.valid(table)
    got = {}
    for r in maxscore.top_k(valid.where("vec_id % 50 = 0"), valid, query_bytes=400, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, np.floor(1024 * np.pad(np.array(e, np.float32).astype(float), (0, 16 - len(e)))).astype(int)) for i, e, _ in rows if e and all(v is not None and np.isfinite(v) for v in e)]
    ok = [(i, np.where(np.arange(16) < 1, v, 0) if i == 1101 else v) for i, v in ok]
    for q, v in [(i, v) for i, v in ok if i % 50 == 0]:
        best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert maxscore.top_k(valid.limit(0), valid).count() == 0


def test_shard_top_prunes_exactly():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = int(rng.integers(1, 300))
        x, q, ids = rng.integers(-40, 40, (9, m)) * (rng.random((9, 1)) < 0.8), rng.integers(-40, 40, 9) * (rng.random(9) < 0.6), rng.permutation(1000)[:m]
        want = sorted((-int(s), int(i)) for s, i in zip(q @ x, ids, strict=True) if i != ids[0])[:5]
        for known in (maxscore._FLOOR, -want[-1][0] - 3, -want[-1][0]) if len(want) == 5 else (maxscore._FLOOR,):
            found, score = maxscore.Shard(ids, x.T).top(int(ids[0]), q, 5, known)
            assert [(-int(s), int(i)) for i, s in zip(found, score, strict=True)] == want


def test_repeated_queries_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (100, [1.0, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [-1.0, 0.5])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, q_key int, x int")
    valid = maxscore.valid(table)
    got = {}
    for r in maxscore.top_k(valid.where("vec_id % 100 = 0"), valid, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    one = 1024 * 1024
    # query 0 twice, by its two vectors; ties to the smaller id, null last
    assert sorted(got[0], key=str) == sorted([(1, 5, one), (2, 100, one), (3, None, one)] * 2, key=str)
    assert sorted(got[100]) == [(1, 5, 2 * one), (2, None, 2 * one), (3, 0, one)] and len(got) == 2


def test_long_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5000))
    valid = maxscore.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = [(r.vec_id, r.score) for r in maxscore.top_k(valid.where("vec_id = 0"), valid, k=4).orderBy("rank").collect()]
    w = np.floor(1024 * x).astype(int)
    assert got == [(i, -s) for s, i in sorted((-int(w[0] @ w[i]), i) for i in range(1, 30))[:4]]
