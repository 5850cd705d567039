"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of characters that are not letters counts as one space; its 1-, 2- and 3-grams are
hashed into 2**BITS features. Counts are summed by Spark, the log-probability matrix (features x languages) is broadcast,
and batches are scored as sparse rows: features gathered from the matrix, summed by document. A matrix of more than
MATRIX_BYTES goes in parts of languages: one broadcast and one pass over the documents each, with the same result.

Null or letterless text: ``und`` with score 0. No labelled rows: ``und`` everywhere. Ties go to the first language in
order of name. Repeated rows are scored alike; a null doc_id is not held out. A very long text is scored whole, with some
100 bytes for each of its characters in that task. An empty table gives no rows. Other columns are passed through untouched
by ``predict``, but for a lang_pred or score of the input, which the result's replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fresh, held_out, materialise, table

BITS = 14
#: About so many labelled documents train the model, taken by a hash of doc_id.
TRAIN_DOCS = 12_000
#: Bytes of the matrix that are broadcast at once: 256 languages of 2**14 features.
MATRIX_BYTES = 32 << 20
#: Languages that a counting task holds at a time.
COUNTED = 64
UNKNOWN = "und"
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram, the document of each, and whether each document has a letter."""
    texts = [" " + t.lower() for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    letter = _is_letter()[points]
    lettered = np.bincount(doc, letter, len(texts)) > 0
    first = np.ones(len(points), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = letter | first
    keep[1:] |= letter[:-1]
    values, doc = np.where(letter, points, 32)[keep].astype(np.uint64), doc[keep]
    features, owners, mixed = [], [], np.zeros(len(values), np.uint64)
    for n in range(3):
        if len(values) <= n:
            break
        mixed = (mixed[: len(values) - n] + values[n:] + np.uint64(n + 1)) * _SALT[n]
        mixed ^= mixed >> np.uint64(29)
        inside = doc[n:] == doc[: len(doc) - n]
        features.append(((mixed * _SALT[2]) >> np.uint64(64 - bits)).astype(np.int32)[inside])
        owners.append(doc[: len(doc) - n][inside])
    if not features:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), lettered
    return np.concatenate(features), np.concatenate(owners), lettered


def counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (lang, feature, n) of docs (text, lang), summed within each task first."""

    def rows_of(total):
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "feature", "n"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                names, which = np.unique(np.array(rows.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                for first in range(0, len(names), COUNTED):
                    if len(total) >= COUNTED:
                        yield from rows_of(total)
                        total = {}
                    mine = np.flatnonzero((which >= first) & (which < first + COUNTED))
                    features, owner, _ = grams(texts.take(pa.array(mine)).to_pylist(), bits)
                    some = names[first : first + COUNTED]
                    flat = np.bincount((which[mine][owner] - first).astype(np.int64) * (1 << bits) + features, minlength=len(some) << bits)
                    for i, name in enumerate(some):
                        total[name] = total.get(name, 0) + flat[i << bits : (i + 1) << bits]
        yield from rows_of(total)

    found = docs.select("text", "lang").mapInArrow(count, "lang string, feature int, n long")
    return found.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities (features x languages) of some languages."""

    def __init__(self, langs: list[str], log_p: np.ndarray, bits: int):
        self.langs, self.log_p, self.bits = langs, log_p, bits

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By document: index of the likeliest language (-1: none), its log-likelihood, and the log of the sum over all."""
        best, top, all_ = np.full(len(texts), -1), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        if not self.langs:
            return best, top, all_
        features, owner, lettered = grams(texts, self.bits)
        total = np.stack([np.bincount(owner, self.log_p[:, i][features], len(texts)) for i in range(len(self.langs))], 1)
        high = total.max(1)
        best[lettered], top[lettered] = total.argmax(1)[lettered], high[lettered]
        all_[lettered] = (high + np.log(np.exp(total - high[:, None]).sum(1)))[lettered]
        return best, top, all_


class Trained:
    """Counts (lang, feature, n), and the languages in parts whose matrices are small enough to broadcast."""

    def __init__(self, found: DataFrame, langs: list[str], bits: int):
        self.found, self.bits, each = found, bits, max(1, MATRIX_BYTES // (8 << bits))
        self.parts = [langs[i : i + each] for i in range(0, len(langs), each)] or [[]]

    def model(self, part: int = 0) -> Model:
        langs = self.parts[part]
        n = np.zeros((len(langs), 1 << self.bits))
        if langs:  # at most MATRIX_BYTES / 8 rows come to the driver
            got = self.found.where(F.col("lang").between(langs[0], langs[-1])).toPandas()
            n[np.searchsorted(langs, got.lang.to_numpy(str)), got.feature] = got.n
        smooth = n + 0.5
        return Model(langs, np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T), self.bits)


def train(docs: DataFrame, bits: int = BITS, max_docs: int = TRAIN_DOCS, seed: int = 7) -> Trained:
    """docs (doc_id, text, lang): learns from about max_docs of the rows with text and lang that are not held out."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = max_docs / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = materialise(counts(labelled, bits), "language-counts")
    # the names of languages come to the driver
    return Trained(found, sorted(r.lang for r in found.select("lang").distinct().collect()), bits)


def _pass(docs: DataFrame, model: Model, names: dict[str, str]) -> DataFrame:
    """docs with the best language so far, its log-likelihood and the log of the sum of all, updated by model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    best, top, all_ = names["best"], names["top"], names["all"]
    schema = T.StructType([*(f for f in docs.schema if f.name not in names.values()), T.StructField(best, T.StringType()), T.StructField(top, T.DoubleType()), T.StructField(all_, T.DoubleType())])

    def run(batches):
        m = shared.value
        labels = np.array([*m.langs, None], dtype=object)
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                at, high, total = m.score(texts.to_pylist())
                lang = labels[at]
                if best in rows.schema.names:
                    had = rows.column(best).to_numpy(zero_copy_only=False), rows.column(top).to_numpy(), rows.column(all_).to_numpy()
                    better = high > had[1]
                    lang, high, total = np.where(better, lang, had[0]), np.maximum(high, had[1]), np.logaddexp(total, had[2])
                kept = [n for n in rows.schema.names if n not in names.values()]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), pa.array(lang, pa.string()), pa.array(high), pa.array(total)], [*kept, best, top, all_])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, trained: Trained) -> DataFrame:
    """docs with lang_pred and score added."""
    docs = docs.drop("lang_pred", "score")
    names = {k: fresh(docs, f"_{k}") for k in ("best", "top", "all")}
    done = docs
    for part in range(len(trained.parts)):
        done = _pass(done if part == 0 else materialise(done, "languages"), trained.model(part), names)
    best, top, all_ = names["best"], names["top"], names["all"]
    return done.select(*docs.columns, F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col(best).isNull(), 0.0).otherwise(F.least(F.exp(F.col(top) - F.col(all_)), F.lit(1.0))).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Drops documents with no language (null or letterless text) or whose best language isn't likelier than not."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    clash = docs.withColumnsRenamed({"lang_pred": fresh(docs, "_lang_pred"), "score": fresh(docs, "_score")}) if (lang, score) != ("lang_pred", "score") else docs
    kept = predict(clash, train(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*(F.col(c).alias(d) for c, d in zip(clash.columns, docs.columns, strict=True)))
