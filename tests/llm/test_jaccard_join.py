import random

import numpy as np
import pytest

from symgraph.llm import jaccard_join

from .test_operators import EDGE, WORD, docs_of, words  # noqa: F401


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def join_brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"hot": 8}, {"group": 400, "block_docs": 7, "hot": 30}, {"group": 200, "block_docs": 3, "hot": 2}])
def test_jaccard_join(spark, words, limits):
    rnd = random.Random(4)
    families = [[rnd.choice(words) for _ in range(rnd.randint(3, 120))] for _ in range(14)]
    passage = [rnd.choice(words) for _ in range(50)]
    texts = dict(enumerate(EDGE))
    for i in range(20, 260):
        body = list(rnd.choice(families))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            body[rnd.randrange(len(body))] = rnd.choice(words)
        if i % 4 == 0:
            body = [rnd.choice(words) for _ in range(rnd.randint(0, 80))] + passage
        texts[i] = ("\n" if i % 2 else "  ").join(w.upper() if i % 5 == 0 and w.isascii() else w for w in body)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, texts), **limits).collect()}
    assert got == join_brute(texts)


def test_jaccard_edges(spark):
    assert jaccard_join.join(docs_of(spark, EDGE).limit(0)).count() == 0
    assert jaccard_join.keep_first(docs_of(spark, {0: None, 1: "", 2: "a b", 3: "A  B"})).count() == 3
    lonely = spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.join(lonely).collect()} == {(None, None), (4, None)}


def near_copies(words, n, changes, length=200, seed=11):
    rnd = random.Random(seed)
    base = [rnd.choice(words) for _ in range(length)]
    for _ in range(n):
        body = list(base)
        for _ in range(rnd.randint(0, changes)):
            body[rnd.randrange(length)] = f"{rnd.choice(words)}{rnd.randrange(1000)}"
        yield " ".join(body)


@pytest.mark.parametrize("changes", [2, 12])
def test_many_near_copies(spark, words, changes):
    """Copies of one text that share all pivots, some beyond the radius of any: hot regions and a large group."""
    texts = dict(enumerate(near_copies(words, 300, changes)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, texts), group=2000, hot=16, block_docs=10).collect()}
    assert got == join_brute(texts)


def test_edges_grow_in_proportion(spark, words):
    """Near copies, many of them beyond any pivot's radius, give out edges in proportion to documents, not pairs."""
    coarse, links = [], []
    for n in (300, 600):
        docs = spark.createDataFrame(list(enumerate(near_copies(words, n, 12))), "doc_id long, text string").repartition(6)
        classes = jaccard_join.materialise(jaccard_join.sketches(docs).where("n > 0"), "test")
        coarse.append(jaccard_join.coarse_edges(classes, hot=64).count())
        members = jaccard_join.set_rows(docs.selectExpr("doc_id", "text", "0l as component"), ["component"])
        links.append(jaccard_join.large_links(members, block_docs=20).count())
    assert coarse[1] < 2.6 * coarse[0] and links[1] < 2.6 * links[0] and links[1] < 30 * 600


def test_a_chain_of_links(spark, words):
    """Each text links with its neighbours only, so no pivot reaches far."""
    rnd = random.Random(3)
    body, texts = [rnd.choice(words) + str(i) for i in range(100)], {}
    for i in range(150):
        texts[i] = " ".join(body)
        body[(i * 7) % 100] = f"new{i}"
        body = body[1:] + [f"end{i}"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, texts), group=1000, hot=10, block_docs=8).collect()}
    assert got == join_brute(texts)


def test_repeated_rows_and_a_very_long_text(spark, words):
    rnd = random.Random(5)
    long_text = " ".join(rnd.choice(words) for _ in range(300_000))
    texts = {1: long_text, 2: long_text + " more", 3: "a b c d e f g", 4: "a b c d e f g"}
    docs = docs_of(spark, texts)
    got = [(r.doc_id, r.component_id) for r in jaccard_join.join(docs.union(docs)).collect()]
    assert len(long_text) > 1 << 20 and sorted(got) == sorted(2 * [(1, 1), (2, 1), (3, 3), (4, 3)])


def test_reach_is_sound(words):
    """No link between a row that a pivot takes and one outside its window."""
    rnd = random.Random(8)
    base = [rnd.choice(words) for _ in range(90)]
    texts = []
    for _ in range(160):
        body = list(base)[: rnd.randint(50, 90)]
        for _ in range(rnd.randint(0, 9)):
            body[rnd.randrange(len(body))] = rnd.choice(words)
        texts.append(" ".join(body) if rnd.random() < 0.8 else " ".join(body * 12))
    sets = [shingle_set(t) for t in texts]
    data = "".join(texts).encode()
    owner, value = jaccard_join.shingles(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    n, bits = np.bincount(owner), []
    for i in range(len(texts)):
        b = jaccard_join.sketch_bits(int(n[i]))
        odd = np.bincount((value[owner == i] & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
        bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    sketches, all_rows = jaccard_join.Sketches(n, bits), np.arange(len(texts))
    for p in range(0, len(texts), 5):
        taken, window = sketches.reach(p, all_rows)
        for x in np.flatnonzero(taken):
            for y in np.flatnonzero(~window):
                assert 100 * len(sets[x] & sets[y]) < 75 * len(sets[x] | sets[y])
