"""Mixing sources to target weights by Poisson replication.

A source of weight w (share of the mixture) and size c (characters, over all documents) gets the mean repetition rate
w * budget / c. A document's number of copies is the inverse Poisson distribution function at a uniform number hashed
from (seed, doc_id), so it needs no state and a retried task repeats it. Copies are exploded and then shuffled globally
by a hash of (seed, doc_id, copy, place in the table), which spreads a hot source and a hot doc_id evenly.

Null source: a source of its own. Null or empty text: adds no size, and is drawn like any other row; a source with no
characters at all has rate 0. Repeated rows, and all rows without a doc_id, draw the same number of copies. Any rate is
drawn exactly. n_copies is an int, so a document can't have 2^31 copies or more. Texts are not read beyond their length,
whatever that is. An empty table gives no rows. Other columns pass through, but for a copy_no or n_copies of the input,
which the result's replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, partitions, table

SEED = 17
#: Weights are sizes to this power (temperature sampling) unless given.
TEMPERATURE = 0.5
#: Characters of the mixture, as a multiple of the input.
BUDGET = 1.0
#: Up to this rate probabilities are summed from 0 on; exp(-rate) vanishes at about 745.
FROM_ZERO = 500
#: Copies that one array lists.
COPIES = 1 << 16
#: A table of at most so many rates is broadcast (some 10 MB); a longer one is joined by shuffling.
MOST_BROADCAST = 100_000


def rates(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET) -> DataFrame:
    """Rows (source, rate): of docs (source, text) and weights (source, weight), or size ** TEMPERATURE if None."""
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.pow("chars", F.lit(TEMPERATURE)))
    else:
        w = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        size = size.join(w, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    size = materialise(size, "source-sizes")
    # two sums come to the driver, whatever the input's size
    all_chars, all_weight = size.agg(F.sum("chars"), F.sum("weight")).first()
    rate = F.col("weight") / float(all_weight or 1) * budget * float(all_chars or 0) / F.col("chars")
    return size.select("source", F.when(F.col("chars") > 0, rate).otherwise(0.0).alias("rate"))


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in of))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _far_inverse(u: Column, rate: Column) -> Column:
    """The same for a high rate, from terms relative to the first one, 10 deviations and more below the mean.

    What lies outside the terms has a probability under 2^-52, the step of u.
    """
    wide = 10 * F.sqrt(rate) + 40
    first, last = F.floor(rate - wide), F.ceil(rate + wide)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("c"), first.alias("n"))

    def add(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), i.alias("n"))

    terms = F.sequence(first + 1, last)
    bound = u * F.aggregate(terms, start, add, lambda s: s["c"])
    return F.transform(F.array(bound), lambda b: F.aggregate(terms, start, lambda s, i: F.when(b >= s["c"], add(s, i)).otherwise(s), lambda s: s["n"]))[0].cast("int")


def poisson_inverse(u: Column, rate: Column) -> Column:
    """Least n with u < P(X <= n), X Poisson with this mean."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(u >= s["c"], F.struct(p.alias("p"), (s["c"] + p).alias("c"), i.alias("n"))).otherwise(s)

    found = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])
    return F.when(rate <= FROM_ZERO, found).otherwise(_far_inverse(u, rate))


def mix(docs: DataFrame, rate_table: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with copy_no (from 1) and n_copies, a row for each copy, in globally shuffled order."""
    docs = docs.drop("copy_no", "n_copies")
    of, rate, part, place = (fresh(docs, c) for c in ("_of", "_rate", "_part", "_place"))
    r = rate_table.select(F.col("source").alias(of), F.col("rate").alias(rate))
    if rate_table.count() <= MOST_BROADCAST:
        r = F.broadcast(r)  # the join then moves no text, and a hot source stays where it is
    drawn = docs.join(r, F.col("source").eqNullSafe(F.col(of))).withColumn("n_copies", poisson_inverse(uniform(seed, F.col("doc_id")), F.col(rate))).drop(of, rate)
    parts = drawn.where("n_copies > 0").withColumn(part, F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_copies - 1) div {COPIES} as int)"))))
    until = F.least(F.col("n_copies"), (F.col(part) + 1).cast("long") * COPIES).cast("int")
    copies = parts.withColumn(place, F.monotonically_increasing_id()).withColumn("copy_no", F.explode(F.sequence(F.col(part) * COPIES + 1, until))).drop(part)
    shuffled = copies.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", "copy_no", place)).repartition(partitions(docs.sparkSession), place)
    return shuffled.sortWithinPartitions(place).select(*docs.columns, "copy_no", "n_copies")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, rates(docs)).select("doc_id", "copy_no", "n_copies", "source", "text")


SQL = f"""
WITH size AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
total AS (SELECT sum(chars) AS all_chars, sum(sqrt(chars)) AS all_weight FROM size),
rate AS (SELECT source, sqrt(chars) / all_weight * {BUDGET} * all_chars / chars AS rate FROM size, total WHERE chars > 0),
cdf AS (SELECT source, n, sum(exp(-rate + n * ln(rate) - lgamma(n + 1))) OVER (PARTITION BY source ORDER BY n) AS c
        FROM rate, (SELECT unnest(generate_series(0, (SELECT CAST(ceil(max(rate) + 10 * sqrt(max(rate)) + 40) AS BIGINT) FROM rate))) AS n)),
drawn AS (SELECT d.doc_id, d.source, d.text,
                 CAST(('0x' || substr(md5('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / {float(1 << 52)} AS u FROM documents d),
picked AS (SELECT d.doc_id, d.source, d.text, CAST((SELECT count(*) FROM cdf WHERE cdf.source = d.source AND d.u >= cdf.c) AS INTEGER) AS n_copies FROM drawn d)
SELECT doc_id, CAST(unnest(generate_series(1, n_copies)) AS INTEGER) AS copy_no, n_copies, source, text FROM picked WHERE n_copies > 0
"""
