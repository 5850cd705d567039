import math
import random
import zlib
from collections import Counter

from symgraph.llm import langid

from .test_operators import EDGE, docs_of


def test_language(spark):
    rnd = random.Random(8)
    parts = {"aa": ["the", "ing", "th"], "bb": ["éau", "que", "ion"], "cc": ["sch", "ung", "ß"]}
    texts, lang = {}, {}
    for i in range(240):
        lang[i] = list(parts)[i % 3]
        texts[i] = " ".join("".join(rnd.choice(parts[lang[i]]) for _ in range(3)) for _ in range(30))
    truth = dict(lang)
    lang[3] = None
    texts |= {1000: None, 1001: "", 1002: "12 34 !!", 1003: "Schungß" * 3000}
    docs = docs_of(spark, texts, lang=lang)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[i].lang_pred == truth[i] for i in truth) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "cc"
    assert langid.keep_known(docs).count() == 241 and langid.keep_known(docs).columns == docs.columns
    none = docs_of(spark, EDGE)
    assert {r.lang_pred for r in langid.predict(none, langid.train(none)).collect()} == {"und"}
    assert langid.predict(none.limit(0), langid.train(none.limit(0))).count() == 0


def brute_grams(text, bits=langid.BITS):
    """Features of one text in plain Python: 1-, 2- and 3-grams of letters, runs of others as one space."""
    out = [" "]
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out[-1] != " ":
            out.append(" ")
    points, mask = [ord(c) for c in out], (1 << 64) - 1
    salt, found = [int(x) for x in langid._SALT], []
    for i in range(len(points)):
        mixed = 0
        for n in range(3):
            if i + n >= len(points):
                break
            mixed = (mixed + points[i + n] + n + 1) * salt[n] & mask
            mixed ^= mixed >> 29
            found.append((mixed * salt[2] & mask) >> (64 - bits))
    return found


def brute_predict(rows, held=True):
    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    total = {k: sum(c.values()) + 0.5 * (1 << langid.BITS) for k, c in counts.items()}
    out = {}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text) or not counts:
            out[i] = ("und", 0.0)
            continue
        sums = {k: sum(math.log((c[g] + 0.5) / total[k]) for g in brute_grams(text)) for k, c in counts.items()}
        best = min(sorted(sums), key=lambda k: -sums[k])
        out[i] = (best, 1 / sum(math.exp(min(700.0, s - sums[best])) for s in sums.values()))
    return out


def make(n=120, langs=7):
    rnd = random.Random(21)
    parts = [["".join(rnd.choice("abcdefghijklmnopqrsé") for _ in range(2)) for _ in range(8)] for _ in range(langs)]
    rows = [(i, " ".join("".join(rnd.choice(parts[i % langs]) for _ in range(2)) for _ in range(rnd.randint(1, 6))), f"l{i % langs}") for i in range(n)]
    return [*rows, (1000, None, "l1"), (1001, "", "l2"), (1002, "1 2", "l3"), (1003, "É" * 9, None), (None, "abc abc", "l0")]


def test_equals_brute_force(spark, monkeypatch):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute_predict(rows)
    for limit, counted in ((langid.MATRIX_BYTES, langid.COUNTED), (3 * (8 << langid.BITS), 2)):
        monkeypatch.setattr(langid, "MATRIX_BYTES", limit)
        monkeypatch.setattr(langid, "COUNTED", counted)
        trained = langid.train(docs)
        assert len(trained.parts) == (1 if limit > 1 << 20 else 3)
        for r in langid.predict(docs, trained).collect():
            assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9


def test_clashing_columns_repeats_and_a_very_long_text(spark):
    rows = [(i, f"{'ab cd' if i % 2 else 'xy zz'} " * (300_000 if i == 0 else 5), f"l{i % 2}", 1.5, "keep", 3) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[1:3], "doc_id long, text string, lang string, score double, lang_pred string, _best int")
    got = langid.predict(docs, langid.train(docs)).collect()
    assert len(got) == 42 and all(r.lang_pred == f"l{r.doc_id % 2}" and r._best == 3 for r in got)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {(1.5, "keep")}
