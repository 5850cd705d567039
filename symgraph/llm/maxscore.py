"""Exact top-k by inner product: MaxScore over sharded postings.

The terms of a query are its vector's non-zero components. In a shard, the posting list of term d holds the rows whose
component gives a positive product; the list's bound is the largest product there. Terms are taken in order of bound.
The essential ones are the shortest prefix after which the bounds of all the rest add up to less than the k-th best
score so far, so rows outside the essential lists can't qualify. Essential postings are traversed and summed; the
others are probed, a few terms at a time, only for rows whose sum plus the remaining bounds stays competitive.

Rows stay in the partition that reads them: a task cuts what it reads into shards of SHARD_ROWS, builds each shard's
postings once, and runs all queries of a block over it; the k-th best score of the shards before is the next one's floor. A
task gives out k rows for each query, and Spark merges those of all tasks. Queries (a stated set) go to the tasks in blocks
of at most QUERY_BYTES, one broadcast and one pass over the rows each.

Vectors null, empty, or with null or non-finite components take no part. Shorter vectors count as padded by zeros. Ties go
to the smaller vec_id; a query never returns rows of its own vec_id; repeated rows are returned as often as they stand. Rows
that repeat a query's vec_id and vector are one query; with another vector they are another query of the same id. A null
vec_id asks nothing, and is returned, last among ties. An empty table gives no rows. Other columns are not read. Components
are 64-bit integers; a score beyond that range wraps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, table

#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 16 << 20
SHARD_ROWS = 8192
K = 10
_LAST_ID = (1 << 63) - 1
_FLOOR = np.iinfo(np.int64).min


def valid(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, x array<long>) of vectors (vec_id, embedding): floor(1024 * component)."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(1024 * x.cast("double"))).alias("x"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row for each list, padded by zeros."""
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


class Shard:
    """Rows by component, with the postings of every component: the rows where it is positive, and where negative."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.x = ids, np.ascontiguousarray(rows.T)
        self.high, self.low = self.x.max(1), self.x.min(1)
        self.positive, self.negative = [np.flatnonzero(v > 0) for v in self.x], [np.flatnonzero(v < 0) for v in self.x]

    def top(self, query_id: int, q: np.ndarray, k: int = K, floor: int = _FLOOR) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for q by (score desc, id), by MaxScore; rows under floor may be left out."""
        a, b = q * self.high, q * self.low
        most, least = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort(-most, kind="stable")
        order = order[q[order] != 0]
        rest = np.concatenate([np.cumsum(np.maximum(most[order], 0)[::-1])[::-1], [0]])  # bound of the terms from place i on
        lose = np.concatenate([np.cumsum(np.minimum(least[order], 0)[::-1])[::-1], [0]])
        other = self.ids != query_id
        if len(order) and floor == _FLOOR:
            first = self.x[order[0]] * q[order[0]]
            n = min(len(first), 4 * k)
            seed = np.flatnonzero(other & (first >= np.partition(first, -n)[-n]))[: 8 * k]
            if len(seed) >= k:
                floor = int(np.partition(q @ self.x[:, seed], -k)[-k])
        essential = len(order) if floor <= 0 else min(len(order), max(int(np.searchsorted(-rest, -floor, "right")), 1))
        if floor > 0 and essential < len(order):
            here = np.zeros(len(self.ids), bool)
            for d in order[:essential]:
                here[self.positive[d] if q[d] > 0 else self.negative[d]] = True
            rows = np.flatnonzero(here & other)
        else:
            rows = np.flatnonzero(other)
        score, done = np.zeros(len(rows), np.int64), 0
        while done < len(order):
            # essential postings first, then probes of what can still reach the floor
            step = order[done : done + (essential if done == 0 else 8)]
            near = score + rest[done] >= floor
            rows, score = rows[near], score[near]
            score = score + q[step] @ self.x[np.ix_(step, rows)]
            done += len(step)
            if len(score) >= k:  # what a row may still lose is bounded too, so the floor rises with sums that are not complete
                floor = max(floor, int(np.partition(score, -k)[-k]) + int(lose[done]))
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


class Best:
    """The k best rows so far of each query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, shard: Shard) -> None:
        for i, (query_id, q) in enumerate(zip(self.ids, self.q, strict=True)):
            ids, scores = self.found[i]
            floor = int(scores[-1]) if len(scores) == self.k else _FLOOR
            more_ids, more = shard.top(query_id, q, self.k, floor)
            ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more])
            best = np.lexsort((ids, -scores))[: self.k]
            self.found[i] = ids[best], scores[best]


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): queries and rows are (vec_id, x)."""
    spark = rows.sparkSession
    asked = queries.where("vec_id is not null").dropDuplicates(["vec_id", "x"]).select("vec_id", "x", F.xxhash64("vec_id", "x").alias("q_key"))
    n_queries, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    width = max(width, rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0])
    n_blocks = max(1, -(-n_queries * width * 8 // query_bytes))
    held = rows.select(F.coalesce("vec_id", F.lit(_LAST_ID)).alias("vec_id"), "x")

    def search_for(shared):
        def search(batches):
            keys, ids, q = shared.value
            best, kept, n = Best(ids, q, k), [], 0
            for batch in batches:
                kept.append((batch.column("vec_id").to_numpy(), _matrix(batch.column("x"), width)))
                n += len(batch)
                while n >= shard_rows:
                    all_ids, all_rows = (np.concatenate([x[i] for x in kept]) for i in (0, 1))
                    best.add(Shard(all_ids[:shard_rows], all_rows[:shard_rows]))
                    kept, n = [(all_ids[shard_rows:], all_rows[shard_rows:])], n - shard_rows
            if n:
                best.add(Shard(*(np.concatenate([x[i] for x in kept]) for i in (0, 1))))
            sizes = [len(x) for x, _ in best.found]
            for a in range(0, len(ids), 1 << 14):
                b = a + (1 << 14)
                part = best.found[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[a:b], sizes[a:b])), pa.array(np.repeat(ids[a:b], sizes[a:b])), pa.array(np.concatenate([x for x, _ in part])), pa.array(np.concatenate([x for _, x in part]))], ["q_key", "query_id", "vec_id", "score"])

        return search

    found = None
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.col("q_key"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        lists = mine.column("x").combine_chunks()
        shared = spark.sparkContext.broadcast((mine.column("q_key").to_numpy(), mine.column("vec_id").to_numpy(), _matrix(lists, width)))
        part = held.mapInArrow(search_for(shared), "q_key long, query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id"))
    ranked = found.repartition(partitions(spark), "query_id", "q_key").withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _LAST_ID, F.col("vec_id")).alias("vec_id"), "score")


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 100 = 0"), rows)


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.x AS x, r.vec_id AS vec_id, CAST(list_dot_product(q.x, r.x) AS BIGINT) AS score
      FROM q JOIN v r ON r.vec_id IS NULL OR q.vec_id <> r.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s) WHERE n <= {K}
"""
