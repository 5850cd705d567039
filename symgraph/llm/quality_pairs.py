"""Quality classifier: Bradley-Terry pairwise ranking.

Each text becomes a short vector of character, word and line ratios. From labelled documents, pairs (preferred, other)
are drawn; the weights minimise the logistic loss of the score difference of the two, as in a Bradley-Terry model with
features, on a bounded sample. The threshold is the exact quantile of the scores of all labelled documents that are not
held out which leaves as many above it as are labelled 1; scores are mapped through a logistic curve so that the threshold
lies at 0.7.

Null text counts as empty and is scored like any text. With no labels, or labels of one kind only, every weight is 0 and
each score is 0.5 or the share of label 1. Equal labels of one doc_id count once, different ones once each; so do rows of
the documents that repeat a doc_id in the sample, while the quantile counts all rows. Ties at the threshold pass. A null
doc_id is scored, is not held out, and takes no label. A very long text is one block, some 60 bytes for each of its bytes in
that task. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held_out, materialise, raw, remove, table

#: About so many labelled documents, by a hash of doc_id, and so many pairs of them train the model.
TRAIN_DOCS = 20_000
PAIRS = 40_000
L2 = 1e-3
CUT = 0.7
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in enumerate((b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#*$%&|<>", b"!", b"|", b".,;:?'\"()-", bytes(range(128, 256)))):
    if _name != 6:
        _CLASS[list(_bytes)] = _name + 1
FEATURES = ["space", "upper", "lower", "digit", "symbol", "bang", "pipe", "plain", "other", "log_chars", "word_chars", "word_spread", "no_line", "dup_lines", "dup_words", "long_words", "caps_words", "log_lines"]


def _ratios(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = raw(texts)
    n, sizes = len(texts), np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    kind = _CLASS[data]
    by = np.bincount(doc * 10 + kind, minlength=n * 10).reshape(n, 10).astype(float)
    pipe = np.bincount(doc, data == 124, n)
    size = np.maximum(sizes, 1)
    space = kind == 1
    first = ~space
    first[1:] &= space[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    word = np.cumsum(first) - 1
    chars = ~space & (data & 0xC0 != 0x80)
    length = np.bincount(word[chars], minlength=len(starts)) if len(starts) else np.zeros(0)
    caps = np.bincount(word[~space], kind[~space] == 2, len(starts)) if len(starts) else np.zeros(0)
    owner = doc[starts]
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    mean = np.bincount(owner, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / words - mean**2, 0))
    lines = np.bincount(doc, data == 10, n)
    # words and lines that repeat: by a rolling sum that a word's bytes fix
    power = np.cumprod(np.full(max(1, int(length.max()) * 4 + 8 if len(length) else 1), 0x100000001B3, np.uint64))
    inside = ~space
    at = np.arange(len(data))[inside] - starts[word[inside]]
    at = np.minimum(at, len(power) - 1)
    code = np.zeros(len(starts), np.uint64)
    np.add.at(code, word[inside], (data[inside].astype(np.uint64) + np.uint64(1)) * power[at])
    both = code * np.uint64(0x9E3779B97F4A7C15) ^ owner.astype(np.uint64)
    distinct = np.bincount(owner[np.unique(both, return_index=True)[1]], minlength=n) if len(starts) else np.zeros(n)
    dup_lines = np.array([0.0 if c == 0 else 1 - len(set(rows := [x for x in t.split("\n") if x.strip()])) / max(1, len(rows)) for c, t in zip(lines, texts.to_pylist(), strict=True)])
    ratio = by[:, 1:] / size[:, None]
    return np.column_stack([
        ratio[:, :6], pipe / size, ratio[:, 7], ratio[:, 8], np.log1p(sizes), mean, spread, lines == 0, dup_lines,
        1 - distinct / words, np.bincount(owner, length > 20, n) / words, np.bincount(owner, caps >= 2, n) / words, np.log1p(lines),
    ])


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, f array<float>) of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                flat = pa.array(_ratios(texts).astype(np.float32).ravel())
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), flat)
                yield pa.RecordBatch.from_arrays([pc.cast(rows.column("doc_id"), pa.int64()), f], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<float>")


class Ranker:
    """score = logistic(sharpness * (w . f - threshold) + logit(CUT))"""

    def __init__(self, weights: np.ndarray, threshold: float = 0.0, base: float | None = None):
        self.weights, self.threshold, self.base = weights, threshold, base

    @classmethod
    def fit(cls, f: np.ndarray, label: np.ndarray, pairs: int = PAIRS, l2: float = L2, seed: int = 3) -> Ranker:
        """From features (documents x FEATURES) and labels, both 0 and 1 among them."""
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        scale = np.maximum(f.std(0), 1e-6)
        rng = np.random.default_rng(seed)
        x = (f[rng.choice(good, pairs)] - f[rng.choice(bad, pairs)]) / scale
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps on mean log(1 + exp(-w.x)) + l2 / 2 |w|^2
            p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / pairs + l2 * np.eye(len(w)), x.T @ p / pairs - l2 * w)
            w += step / max(1.0, np.abs(step).max() / 3)
            if np.abs(step).max() < 1e-6:
                break
        return cls(w / scale)

    def raw(self, f: F.Column) -> F.Column:
        return F.aggregate(F.zip_with(f, F.array(*(F.lit(float(w)) for w in self.weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def score(self, f: F.Column) -> F.Column:
        if self.base is not None:
            return F.lit(float(self.base))
        # at the threshold exactly CUT, whatever the last bit of the curve
        return F.when(self.raw(f) == self.threshold, CUT).otherwise(1 / (1 + F.exp(-(self.raw(f) - self.threshold + float(np.log(CUT / (1 - CUT)))))))


def order_statistic(rows: DataFrame, column: str, place: int, few: int = 4096) -> float:
    """The place-th smallest value (from 0) of a double column, exactly: histograms of few buckets, finer each time."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while low < high:
        width = (high - low) / few
        at = F.least(F.floor((x - low) / width), F.lit(few - 1)) if width > 0 else F.when(x > low, 1).otherwise(0)
        found = rows.where(x.between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy("at").collect()
        for r in found:  # few rows
            if place < r.n:
                low, high = r.a, r.b
                break
            place -= r.n
    return float(low)


def train(vectors: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, seed: int = 5) -> Ranker:
    """Of features() and labels (doc_id, quality); held-out documents are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    rows = materialise(vectors.join(known, "doc_id"), "quality-labelled")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if good in (0, n):
        return Ranker(np.zeros(len(FEATURES)), base=good / n if n else 0.5)
    share = max_docs / max(1, known.count())
    chosen = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about max_docs rows come to the driver: one for each label
    got = chosen.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).orderBy("doc_id", "quality").toPandas()
    if got.quality.nunique() < 2:
        return Ranker(np.zeros(len(FEATURES)), base=good / n)
    ranker = Ranker.fit(np.stack([np.asarray(x, float) for x in got.f]), got.quality.to_numpy())
    scores = materialise(rows.select(ranker.raw(F.col("f")).alias("raw")), "quality-raw")
    ranker.threshold = (order_statistic(scores, "raw", n - good - 1) + order_statistic(scores, "raw", n - good)) / 2
    remove(scores, rows)
    return ranker


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(features(table(spark, sf_dir, "documents")), "quality-features")
    ranker = train(vectors, table(spark, sf_dir, "labels"))
    scored = vectors.select("doc_id", held_out().alias("held_out"), ranker.score(F.col("f")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
