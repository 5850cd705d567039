import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from symgraph.llm import common, quality_rules, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, v long, component long, shard int, spans int, n string, bits int, label string"


def docs_of(spark, texts, **columns):
    """Documents with columns whose names clash with those that operators make."""
    rows = [(i, t, columns.get("lang", {}).get(i), columns.get("source", {}).get(i), None, "x", 1, 2, 3, 4, "y", 5, "z") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]


EDGE = [None, "", " \n\t", "one", "one two three", "1234 !!! ###", "a " * 6000, "x" * 9000, "\x00 \x85 é ß", "dup\ndup\n\ndup"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (6, 7)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and got[5] == 4 and {got[i] for i in (6, 7, 8)} == {6}
    assert {got[i] for i in range(20, 61)} == {20} and {got[i] for i in range(100, 140)} == {100} and 9 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_or_more(spark):
    """Few edges take no rounds, however long a chain; more than one task may hold go round by round, with the same result."""
    rnd = np.random.default_rng(2)
    a, b = (np.r_[x, y] for x, y in zip(rnd.integers(-500, 500, (2, 400)), (np.arange(1000, 1400), np.arange(1001, 1401)), strict=True))
    root = {x: x for x in np.r_[a, b].tolist()}
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] = root[y] = min(root[x], root[y])
    brute = {x: r for x, r in root.items() if ((a == x) ^ (b == x)).any()}
    edges = spark.createDataFrame([(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] + [(None, 1), (1, None)], "a long, b long").repartition(5)
    jobs = {}
    for limit in (common.TASK_EDGES, 50):
        spark.sparkContext.setJobGroup(f"components-{limit}", "")
        assert {r.node: r.component for r in common.components(edges, limit=limit).collect()} == brute
        jobs[limit] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{limit}"))
    assert jobs[common.TASK_EDGES] <= 6 < jobs[50]


def test_parts_of_a_forest():
    """A stream beyond the limit gives out what it holds in parts, which connect what the stream does."""
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 90, (2, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 20]), pa.array(b[i : i + 20])], ["a", "b"]) for i in range(0, 300, 20)]
    for limit in (7, 40, 100, 1000):
        parts = pa.Table.from_batches(list(common._forest(iter(batches), limit)))
        got = dict(zip(*(x.tolist() for x in common.connected(*(parts.column(c).to_numpy() for c in ("a", "b")))), strict=True))
        assert got == dict(zip(*(x.tolist() for x in common.connected(a, b)), strict=True)) and (limit < 1000 or parts.num_rows < 90)


# 7 rules


def rules_brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules(spark, words):
    rnd = random.Random(2)
    texts = list(EDGE)
    for _ in range(120):
        t = [rnd.choice(words + ["the", "*", "x|y", "..."]) for _ in range(rnd.randint(0, 90))]
        t += t[: rnd.randint(0, 40)] * rnd.randint(0, 3)
        texts.append(rnd.choice([" ", "\n", "\t"]).join(t) + rnd.choice(["", "\n\n", " "]))
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_brute(t), (i, t)
        assert not (r.kept and r.base_failed)
    good = "the cat and the dog of this house are in it for that is was on by from at a to be with have " * 1
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs_of(spark, {0: good, 1: good.upper(), 2: good.replace(" ", "*** ")})).collect()}
    assert kept == {0: True, 1: False, 2: False}
    plan = quality_rules.judge(docs_of(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("RoundRobin", "").split("Project")[0]


# 9 suffix dedup


def dedup_brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("limit", "remembered"), [(suffix_dedup.SORT_BYTES, suffix_dedup.SEEN_BYTES), (1500, 700)])
def test_suffix_dedup(spark, words, limit, remembered):
    rnd = random.Random(6)
    bases = [" ".join(rnd.choice(words) for _ in range(150)) for _ in range(4)]
    texts = dict(enumerate(EDGE))
    for i in range(20, 200):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))
        if i % 3 == 0:
            s, a = rnd.choice(bases), rnd.randint(0, 300)
            t += s[a : a + rnd.randint(50, 500)] + t[: rnd.randint(0, 250)]
        if i % 17 == 0:
            t = "ab" * rnd.randint(1, 150) + t[:30]
        texts[i] = t
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs_of(spark, texts), limit, remembered).collect()}
    assert got == dedup_brute(texts)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(docs_of(spark, EDGE).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "q" * 150), (5, "r" * 99), (5, "r" * 99)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(rows).collect()) == [("5", 0), ("5", 0), ("None", 149)]


@pytest.mark.parametrize("limit", [suffix_dedup.SORT_BYTES, 300])
def test_suffix_dedup_repeated_rows(spark, words, limit):
    rnd = random.Random(8)
    texts = {i: " ".join(rnd.choice(words) for _ in range(90)) for i in range(6)}
    texts[4] += texts[1][50:300]
    texts[5] = texts[2]
    rows = [(i, t) for i, t in texts.items() for _ in range(1 + i % 3)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(4), limit).collect()
    want = dedup_brute(texts)
    assert len(got) == 2 * len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert want[0][1] == 0 and 0 < want[4][1] < want[4][0]


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for _ in range(30):
        t = rng.integers(1, 4, int(rng.integers(1, 90))).astype(np.uint8)
        order = suffix_dedup.two_stage_order(t, np.ones(len(t), bool))
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())
