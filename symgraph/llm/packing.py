"""Best-fit packing with variable capacity.

Documents are cut into pieces no longer than the largest permitted length (whole texts, nothing is lost). A shard's pieces
are packed with all permitted lengths in view: the longest piece left opens a bin; for each length that holds it the bin is
filled with the best-fitting pieces of those left (the longest that fits the space, again and again), and the length whose
bin costs least for a character held is opened and filled so. Best fit into open bins with one opening rule (only the
largest length, or the smallest that fits) makes two more plans of the same pieces, and the cheapest of the three stands.
Every bin is downsized to the smallest permitted length that holds its contents, which its cost has counted all along.
Shards are dealt by a hash, so no source or copy is hot.

Null or empty text: one piece of length 0. Repeated rows are packed each. Equal lengths go by (doc_id, piece_no), a null
doc_id last. A very long text is cut in one pass. An empty table gives no rows. Other columns than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Permitted sequence lengths, in characters.
LENGTHS = (1024, 2048, 4096, 8192, 16384)
#: A bin of length c costs c * (1 + QUADRATIC * c / largest): longer sequences pay for attention.
QUADRATIC = 0.15
SHARD_ROWS = 20_000
#: With texts carried along, a shard stays small enough for one task's memory.
SHARD_ROWS_TEXT = 1500


def cost(c: int, lengths=LENGTHS) -> float:
    return c * (1 + QUADRATIC * c / lengths[-1])


def _single(sizes: list[int], lengths, largest: bool) -> tuple[list[int], list[int], list[int]]:
    """Best fit into open bins, new ones of the largest length or of the smallest that fits. sizes: descending.

    Bin of each piece and its offset in the bin; capacity of each bin after downsizing.
    """
    spaces: list[tuple[int, int]] = []  # (free, bin) of open bins
    bins, offsets, used = [], [], []
    for n in sizes:
        at = bisect_left(spaces, (n, -1))
        if at < len(spaces):
            free, b = spaces.pop(at)
        else:
            free, b = lengths[-1] if largest else lengths[bisect_left(lengths, n)], len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(spaces, (free - n, b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def _fill(free: int, kinds: list[int], left: dict[int, list[int]]) -> tuple[list[tuple[int, int]], int]:
    """(length, pieces of it) that fill free best: the longest that fits, as often as it does; and what stays free."""
    taken, at = [], bisect_right(kinds, free) - 1
    while at >= 0:
        n = kinds[at]
        k = min(len(left[n]), free // n) if n else len(left[n])
        taken.append((n, k))
        free -= n * k
        at = min(at, bisect_right(kinds, free)) - 1
    return taken, free


def _joint(sizes: list[int], lengths) -> tuple[list[int], list[int], list[int]]:
    """The same, the length of each bin being the one that the pieces left fill at the least cost for a character."""
    left: dict[int, list[int]] = {}  # places of the pieces of each length, the last one first
    for i in range(len(sizes) - 1, -1, -1):
        left.setdefault(sizes[i], []).append(i)
    kinds = sorted(left)
    bins, offsets, capacity = [0] * len(sizes), [0] * len(sizes), []
    while kinds:
        best = None
        for c in lengths[bisect_left(lengths, kinds[-1]) :]:
            taken, free = _fill(c, kinds, left)
            fits = lengths[bisect_left(lengths, c - free)]
            each = cost(fits, lengths) / max(1, c - free)
            if best is None or each < best[0]:
                best = each, fits, taken
        at = 0
        for n, k in best[2]:
            for _ in range(k):
                i = left[n].pop()
                bins[i], offsets[i] = len(capacity), at
                at += n
            if not left[n]:
                del left[n], kinds[bisect_left(kinds, n)]
        capacity.append(best[1])
    return bins, offsets, capacity


def best_plan(sizes: list[int], lengths=LENGTHS) -> tuple[list[int], list[int], list[int]]:
    plans = [_joint(sizes, lengths), _single(sizes, lengths, True), _single(sizes, lengths, False)]
    return min(plans, key=lambda p: sum(cost(c, lengths) for c in p[2]))


def pieces(docs: DataFrame, lengths=LENGTHS, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, piece_no, start, n_chars[, text]): start counts characters from 0."""
    most, text = lengths[-1], F.coalesce("text", F.lit(""))
    if with_text:  # one pass over the text, and a row carries its own piece only
        parts = docs.select("doc_id", F.posexplode_outer(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{most}}}"), 0)).alias("piece_no", "text"))
        cut = parts.select("doc_id", F.coalesce("piece_no", F.lit(0)).alias("piece_no"), F.coalesce("text", F.lit("")).alias("text"))
        return cut.select("doc_id", "piece_no", (F.col("piece_no") * most).alias("start"), F.char_length("text").alias("n_chars"), "text")
    n = docs.select("doc_id", F.char_length(text).alias("n"))
    cut = n.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most).cast("int") - 1, F.lit(0)))))
    return cut.select("doc_id", "piece_no", (F.col("piece_no") * most).alias("start"), F.least(F.col("n") - F.col("piece_no") * most, F.lit(most)).alias("n_chars"))


def pack(docs: DataFrame, lengths=LENGTHS, with_text: bool = False, shard_rows: int | None = None) -> DataFrame:
    """pieces() with shard, bin_no (within the shard), bin_length and bin_offset; a bin is (shard, bin_no)."""
    lengths = tuple(sorted(lengths))
    cut = pieces(docs, lengths, with_text)
    rows = shard_rows or (SHARD_ROWS_TEXT if with_text else SHARD_ROWS)
    n_shards = max(1, -(-pieces(docs, lengths).count() // rows))
    # the row's place in its table counts too, else all repeats of one row met in one shard
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_chars", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        bins, offsets, capacity = best_plan(pdf.n_chars.tolist(), lengths)
        return pdf.assign(bin_no=bins, bin_length=[capacity[b] for b in bins], bin_offset=offsets)

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", bin_no int, bin_length int, bin_offset int"
    return dealt.groupBy("shard").applyInPandas(fill, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
