import hashlib
import random

import corpus_pipeline
from symgraph.llm import langid, mixing
from tests.llm.test_jaccard_join import join_brute
from tests.llm.test_mixing import poisson_brute


def test_pipeline(spark, tmp_path):
    rnd = random.Random(5)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["éau", "que", "ion", "ou"]}
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        text = " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(40))
        if i % 10 == 3:
            text = rows[i - 2][1] + " tail"
        if i % 10 == 5:
            text += f" write hein.{i}@mail.example.com now"
        if i % 10 == 7:
            text = "12 34"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs).model()
    known = {i: t for i, t, *_ in rows if model.score([t])[0][0] >= 0}
    assert len(known) == 144
    stay = {i: t for i, t in known.items() if join_brute(known)[i][1] == i}
    assert len(stay) < len(known)
    source = {r[0]: r[3] for r in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.text)
        assert r.piece_no == 0 and r.bin_length in (1024, 2048, 4096, 8192, 16384)
    # pseudonyms keep the length of these texts, so the sizes that rates depend on can be recomputed
    chars = {}
    for i, t in stay.items():
        chars[source[i]] = chars.get(source[i], 0) + len(t)
    root = sum(c**0.5 for c in chars.values())
    for i, t in stay.items():
        rate = chars[source[i]] ** 0.5 / root * sum(chars.values()) / chars[source[i]]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n = poisson_brute(u, rate)
        assert len(pieces.get(i, [])) == n
        for p in pieces.get(i, []):
            assert (p == t) == ("@" not in t) and f"hein.{i}@" not in p and len(p) == len(t)
    assert set(pieces) <= set(stay)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_values string, copy_no string, n_copies string, lang_pred string, score string, component_id string, shard string, _found string"


def test_stages_on_odd_tables(spark):
    """Null ids, repeated rows, clashing columns, a text above a block's size, and nothing at all."""
    long_text = "the ing and er the ing. " * 50_000
    text = "the ing and er write hein.7@mail.example.com now and then the ing and er"
    bodies = [(1, text), (1, text), (None, text + " with some more words that only this one has, all of them new here"), (2, None), (3, ""), (4, long_text), (5, "12 34")]
    rows = [(i, t, "aa", f"s{(i or 0) % 2}", len(t or ""), *"abcdefgh") for i, t in bodies]
    docs = spark.createDataFrame(rows, CLASHING)
    for table, want in ((docs, None), (docs.limit(0), 0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.materialise(stage(spark, now, ""), "odd")
            assert now.columns == docs.columns, name
            got = now.collect()
            assert all((r.n_values, r.copy_no, r.n_copies, r.lang_pred, r.score, r.component_id, r.shard, r._found) == tuple("abcdefgh") for r in got)
            if want == 0:
                assert not got
            elif name == "language ID":
                assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"]
            elif name == "n-gram Jaccard join":
                assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"]
            elif name == "PII":
                assert not any("hein.7@" in r.text for r in got) and all(r.n_chars == len(r.text) for r in got)
                assert len({r.text for r in got if r.doc_id == 1}) == 1 and any(r.text == long_text for r in got)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
        assert sum(len(p.text) for p in packed) == sum(r.n_chars for r in now.collect())
