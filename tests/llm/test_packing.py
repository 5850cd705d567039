import random
import time

import pytest

from symgraph.llm import packing

from .test_operators import EDGE, docs_of

LENGTHS = (4, 8, 16)


@pytest.mark.parametrize("with_text", [False, True])
def test_packing(spark, with_text):
    rnd = random.Random(1)
    texts = dict(enumerate([*EDGE, *("é" * rnd.randint(0, 3000) for _ in range(300)), "ab" * 30000]))
    rows = packing.pack(docs_of(spark, texts).select("doc_id", "text", "shard"), with_text=with_text, shard_rows=120).collect()
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault((r.shard, r.bin_no, r.bin_length), []).append((r.bin_offset, r.n_chars))
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.n_chars, r.text if with_text else (texts[r.doc_id] or "")[r.start : r.start + r.n_chars]))
    for (_, _, length), held in bins.items():
        used, at = sum(n for _, n in held), 0
        assert length == min(c for c in packing.LENGTHS if c >= used)
        for offset, n in sorted(held):
            assert offset == at
            at += n
    assert {i: "".join(p[3] or "" for p in sorted(parts[i])) for i in texts} == {i: t or "" for i, t in texts.items()}
    assert sum(r.n_chars for r in rows) / sum(k[2] for k in bins) > 0.9


def total(plan, lengths=packing.LENGTHS):
    return sum(packing.cost(c, lengths) for c in plan[2])


@pytest.mark.parametrize("sizes", [[1100] * 500, [1300] * 300 + [5500] * 50, [3000, 1000, 1000] * 40 + [700] * 9, [1100 + 13 * i % 400 for i in range(300)] + [5000 + 37 * i % 1000 for i in range(50)]])
def test_joint_plan_beats_both_single_rules(sizes):
    sizes = sorted(sizes, reverse=True)
    singles = [total(packing._single(sizes, packing.LENGTHS, largest)) for largest in (True, False)]
    assert total(packing._joint(sizes, packing.LENGTHS)) < min(singles)


def test_any_sizes():
    rnd = random.Random(9)
    sizes = sorted((rnd.randint(0, 16384) for _ in range(400)), reverse=True)
    plans = [packing._joint(sizes, packing.LENGTHS), *(packing._single(sizes, packing.LENGTHS, x) for x in (True, False))]
    assert total(packing.best_plan(sizes)) == min(map(total, plans))
    for bins, offsets, capacity in plans:
        held = sorted(zip(bins, offsets, sizes, strict=True))
        at = {}
        for b, offset, n in held:
            assert offset == at.get(b, 0) or n == 0
            at[b] = max(at.get(b, 0), offset + n)
        assert all(capacity[b] == min(c for c in packing.LENGTHS if c >= used) for b, used in at.items()) and len(at) == len(capacity)
    assert packing.best_plan([]) == ([], [], [])


def least_cost(sizes):
    """The cheapest packing of few pieces, by trying all."""
    best = [float("inf")]

    def place(i, used):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(c for c in LENGTHS if c >= u), LENGTHS) for u in used))
            return
        for b in range(len(used)):
            if used[b] + sizes[i] <= LENGTHS[-1]:
                place(i + 1, [*used[:b], used[b] + sizes[i], *used[b + 1 :]])
        place(i + 1, [*used, sizes[i]])

    place(0, [])
    return best[0]


def test_close_to_the_optimum():
    rnd, ratios = random.Random(2), []
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 16) for _ in range(rnd.randint(1, 8))), reverse=True)
        ratios.append(total(packing.best_plan(sizes, LENGTHS), LENGTHS) / least_cost(sizes))
    assert min(ratios) >= 1 - 1e-12 and max(ratios) < 1.25 and sum(ratios) / len(ratios) < 1.03


def test_long_texts_are_cut_in_linear_time(spark):
    took = []
    for n in (1, 1, 8):  # the first one warms up
        docs = spark.createDataFrame([(1, "é€" * (n << 19))], "doc_id long, text string")
        began = time.time()
        rows = packing.pieces(docs, with_text=True).selectExpr("count(*)", "sum(char_length(text))", "max(piece_no)").first()
        took.append(time.time() - began)
        assert tuple(rows) == (64 * n, n << 20, 64 * n - 1)
    assert took[2] < 16 * max(took[1], 0.1)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "ab"), (None, None), (1, ""), (1, ""), (1, "x" * 20000), (1, "x" * 20000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.piece_no, r.n_chars) for r in got) == [("1", 0, 0)] * 2 + [("1", 0, 16384)] * 2 + [("1", 1, 3616)] * 2 + [("None", 0, 0), ("None", 0, 2)]
    for with_text in (False, True):
        assert packing.pack(spark.createDataFrame([], "doc_id long, text string, shard int"), with_text=with_text).count() == 0
