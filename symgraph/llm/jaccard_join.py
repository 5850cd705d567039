"""N-gram Jaccard join: pivots, Voronoi regions, triangle-inequality windows, recursive exact joins.

A document is the set of its 5-word shingles (64-bit hashes); two documents link when the Jaccard distance of their sets
is at most 1 / 4. Distance 1 is what unrelated documents have from every pivot document, so a Voronoi diagram of pivot
documents alone would leave the corpus in one region (the README has figures). The join therefore goes in four levels:

1. Equal sets form a class; its smallest doc_id stands for it.
2. Regions: under each of KEYS random orders of all shingles, a set's nearest pivot is its least shingle. Two sets at
   distance d share a region of one order with probability 1 - d, so a link escapes all of them with a probability of at
   most 4 ** -KEYS (2e-10).
3. In a region, a pivot takes the members close to it by a lower bound of the distance (symmetric difference of parity
   sketches, a metric), and the triangle inequality gives the window of boundary members that may link to what it took;
   those are replicated: joined to its family and kept for the next pivot. Families are connected to coarse groups, which
   no link leaves. A region of more than HOT members is dealt in blocks of HOT by HOT. One of more than 2 HOT goes round by
   round instead: its salted blocks all meet the same few pivots, and what no pivot took and nothing has connected to the
   region's largest part asks on, until that is 2 HOT or fewer, which are compared with the open rest in blocks. If more
   ask after the first round, the region is split once by the pivots of the other orders (a link that shares just one of
   the 16 pivots is then missed: at most 1.1e-8).
4. Coarse groups are joined exactly on whole sets: a pivot document, its ball, and for the others the window of members
   that the triangle inequality allows, by recursion over what is left. Groups of more than GROUP shingles meet several
   pivots at a time in salted blocks, round by round; what is not connected to the group's largest part in the end is
   compared with what the triangle inequality over all pivots leaves, in blocks of BLOCK_DOCS on each side. Every task
   gives out a forest, never all links.

Words are lower-cased in A-Z only. Null or wordless text: empty set, linked with nothing. Fewer than 5 words: the whole
sequence as one shingle. Equal rows get equal results; of rows that repeat a doc_id with another text, each has the
component of its own text, and texts whose class has the same smallest id count as linked. A null doc_id is treated as the
smallest id. A very long text is one block of its own, some 60
bytes for each of its bytes in that task. Other columns than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, components, materialise, partitions, raw, remove, table

SHINGLE = 5
KEYS = 16
#: Members of a region, or of a block of a larger one, that one task compares: 64 MB of sketches at most, a second or two.
HOT = 8192
#: Pivots of a hot region in its first round; later rounds have HOT.
PIVOTS = 128
#: Shingles of a coarse group that one task joins.
GROUP = 300_000
#: Pivots of a larger group in a round, and rounds at most.
GROUP_PIVOTS, ROUNDS = 16, 6
#: Documents in one side of a block of a larger group; one of more than UNIT shingles counts as several.
BLOCK_DOCS, UNIT = 256, 1000
_NO_ID = -(1 << 63)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)) for i in range(max(KEYS, 8))]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWER = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, sorted."""
    global _POWER
    n_docs = len(offsets) - 1
    if len(data) > len(_POWER):
        _POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(data), 1 << 20), _BASE)]))
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, stop = cuts[:-1], cuts[1:]
    word = (stop > start) & ~space[np.minimum(start, len(data) - 1)] if len(data) else np.zeros(0, bool)
    start, stop = start[word], stop[word]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # a word's hash is a polynomial in its bytes, read off running sums
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(_LOWER[data].astype(np.uint64) + _SEEDS[0]) * _POWER[: len(data)])])
    back = _inverse_powers(len(data))
    words = _mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=n_docs)
    mixed = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        mixed = mixed * _M2 + words[k : k + len(mixed)]
    whole = doc[: len(mixed)] == doc[SHINGLE - 1 :]
    owner, value = doc[: len(mixed)][whole], _mix(mixed[whole])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    first = np.searchsorted(doc, short)
    extra = np.zeros(len(short), np.uint64)
    for i, (a, n) in enumerate(zip(first, count[short], strict=True)):
        v = int(_SEEDS[int(n)])
        for x in words[a : a + n].tolist():
            v = (v * int(_M1) + x) % (1 << 64)
        extra[i] = v
    owner, value = np.concatenate([owner, short]), np.concatenate([value, _mix(extra)])
    by = np.lexsort((value, owner))
    owner, value = owner[by], value[by]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]
    return owner[new], value[new]


_BACK = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _BACK
    if n > len(_BACK):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _BACK = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), inverse)]))
    return _BACK


def sketch_bits(n: int) -> int:
    """Bits of the parity sketch of a set of n shingles: a power of two, 2n at least, within 1024 and 65536."""
    return int(min(max(1024, 1 << int(2 * n - 1).bit_length()), 1 << 16))


SKETCH = "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary"


def sketches(docs: DataFrame) -> DataFrame:
    """A row of SKETCH for each document (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                data, offsets = raw(texts)
                owner, value = shingles(data, offsets)
                n = np.bincount(owner, minlength=len(rows))
                full = np.flatnonzero(n)
                begin = np.concatenate([[0], np.cumsum(n)])
                d1, d2, keys = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64), np.zeros((len(rows), KEYS), np.uint64)
                if len(full):
                    d1[full], d2[full] = np.add.reduceat(_mix(value + _SEEDS[1]), begin[full]), np.add.reduceat(_mix(value + _SEEDS[2]), begin[full])
                    for k in range(KEYS):
                        keys[full, k] = _mix(np.minimum.reduceat(_mix(value ^ _SEEDS[k]), begin[full]) + _SEEDS[k])
                bits = []
                for i, m in enumerate(n):
                    if not m:
                        bits.append(None)
                        continue
                    b = sketch_bits(int(m))
                    odd = np.bincount((value[begin[i] : begin[i + 1]] & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
                    bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * KEYS), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, pa.array(bits, pa.binary())], ["doc_id", "n", "d1", "d2", "keys", "bits"])

    return docs.mapInArrow(run, SKETCH)


class Sketches:
    """Parity sketches of a group's members: lower bounds of their symmetric differences."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.size = n.astype(np.int64), np.array([len(b) for b in bits], np.int64)
        self.place, self.level, self.folded = np.zeros(len(n), np.int64), {}, {}
        for s in np.unique(self.size):
            at = np.flatnonzero(self.size == s)
            self.place[at] = np.arange(len(at))
            rows = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)
            self.level[s], half = rows, rows.shape[1] // 2
            self.folded[s] = rows[:, :half] ^ rows[:, half:]

    def apart(self, p: int, rows: np.ndarray) -> np.ndarray:
        """Bound of p with each of rows; 0 where the sketches' sizes differ by more than a factor of 2."""
        out, s, of = np.zeros(len(rows), np.int64), self.size[p], self.size[rows]
        for size, table, own in ((s, self.level, self.level), (2 * s, self.folded, self.level), (s // 2, self.level, self.folded)):
            at = of == size
            if at.any():
                out[at] = np.bitwise_count(table[size][self.place[rows[at]]] ^ own[s][self.place[p]]).sum(1)
        return out

    def reach(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows p takes (within half the link radius), and the window of what may link to a row that p takes.

        Of sets x and y, at most (|x| + |y|) / 7 shingles stand in one alone when they link, and parities of fewer differ.
        """
        apart, m, n = self.apart(p, rows), self.n[p], self.n[rows]
        taken = (14 * apart <= m + n) & (3 * n <= 4 * m) & (4 * n >= 3 * m) & (self.size[rows] >= self.size[p])
        window = (42 * apart <= np.minimum(15 * m + 6 * n, 3 * m + 18 * n)) & (9 * n <= 16 * m) & (16 * n >= 9 * m)
        return taken, window


def families(doc: np.ndarray, sketches: Sketches, is_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b), a forest, that connect pivots with all members that they or what they take may link to; and which
    members no pivot took. What a pivot takes has its links in that one's window and meets no other pivot."""
    by = np.argsort(sketches.n, kind="stable")
    n, left, edges, tree = sketches.n[by], np.ones(len(doc), bool), [], np.arange(len(doc))
    low, high = np.searchsorted(n, -(-n * 9 // 16)), np.searchsorted(n, n * 16 // 9, "right")
    for at in np.flatnonzero(is_pivot[by]):
        p = by[at]
        if not left[p]:
            continue
        left[p] = False
        near = by[low[at] : high[at]]
        near = near[left[near]]
        if not len(near):
            continue
        taken, window = sketches.reach(p, near)
        left[near[taken]] = False
        near = near[window]
        roots, first = np.unique(tree[near], return_index=True)
        new = roots != tree[p]
        if new.any():
            edges += [(doc[p], x) for x in doc[near[first[new]]]]
            tree[np.isin(tree, roots[new])] = tree[p]
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1], left


def _star(pivots: np.ndarray, rows: np.ndarray, meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, a forest, that connect pivots and rows as the matrix meet (pivots x rows) does."""
    if not len(pivots) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = meet.astype(np.float32)
    near, root = wide @ wide.T > 0, np.full(len(pivots), -1)
    for p in range(len(pivots)):
        reached = root == p
        if root[p] < 0:
            root[p], reached[p] = p, True
        while reached.any():
            reached = near[reached].any(0) & (root < 0)
            root[reached] = p
    any_, first = meet.any(0), meet.argmax(0)
    a, b = np.r_[pivots[root[first[any_]]], pivots[root]], np.r_[rows[any_], pivots]
    return a[a != b], b[a != b]


def _grouped(batches, key: str):
    """Tables of whole groups of a stream that is sorted by key."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        values = rows.column(key).to_numpy()
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block(group: pa.Table, is_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """families() of the rows of a table."""
    return families(group.column("doc_id").to_numpy(), Sketches(group.column("n").to_numpy(), group.column("bits").to_pylist()), is_pivot)


def region_edges(members: DataFrame) -> DataFrame:
    """Edges of families() in each region; members (region, doc_id, n, bits)."""

    def run(batches):
        for group in _grouped(batches, "region"):
            if len(group) > 1:
                yield _edges(*_block(group, np.ones(len(group), bool))[:2])

    dealt = members.select("region", "doc_id", "n", "bits").repartition(partitions(members.sparkSession), "region").sortWithinPartitions("region", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def salted(members: DataFrame, pivots: DataFrame, group: str, size: str, each: int, chunks: Column | None = None) -> DataFrame:
    """Rows of members in blocks of about each members of their group, and in every block its pivots (is_pivot), by block.

    members has group and size; pivots the same columns. With chunks, pivots are dealt to so many sets of blocks.
    """
    n = F.lit(1) if chunks is None else chunks
    salts = F.ceil(F.col(size) / each).cast("int")
    by = lambda k, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), k).cast("int")
    dealt = members.withColumn("is_pivot", F.lit(False)).withColumn("salt", by(salts, 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    copied = pivots.withColumn("is_pivot", F.lit(True)).withColumn("chunk", by(n, 2)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = dealt.unionByName(copied).withColumn("block", F.xxhash64(group, "salt", "chunk")).drop("salt", "chunk")
    return both.repartition(partitions(members.sparkSession), "block").sortWithinPartitions("block", "is_pivot", "doc_id")


def _first_of(rows: DataFrame, group: str, k: int, *seed) -> DataFrame:
    """The k rows of each group that come first by a hash of doc_id; the limit reaches below the exchange."""
    at = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(F.col("doc_id"), *(F.lit(x) for x in seed)), "doc_id"))
    return rows.withColumn("_at", at).where(F.col("_at") <= k).drop("_at")


_OPEN = "region long, doc_id long, n long, bits binary, keys array<long>, used array<long>, size long"
_COLUMNS = [x.split()[0] for x in _OPEN.split(", ")]


def peel(members: DataFrame, asked: DataFrame, k: int, each: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """A round of k pivots in every region of members (_OPEN), chosen from asked (region, doc_id): edges (a, b), and the
    members that no pivot took."""
    pivots = members.join(_first_of(asked, "region", k, seed), ["region", "doc_id"], "left_semi")

    def run(batches):
        for group in _grouped(batches, "block"):
            is_pivot = group.column("is_pivot").to_numpy()
            a, b, left = _block(group, is_pivot)
            left = group.filter(pa.array(left & ~is_pivot)).select(_COLUMNS)
            nulls = [pa.nulls(len(a), f.type) for f in left.schema]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*_COLUMNS, "a", "b"])
            for part in left.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())], [*_COLUMNS, "a", "b"])

    done = materialise(salted(members, pivots, "region", "size", each).mapInArrow(run, _OPEN + ", a long, b long"), "peeled")
    return done.where("a is not null").select("a", "b"), done.where("a is null").drop("a", "b")


def pair_edges(members: DataFrame, hot: int) -> DataFrame:
    """Edges of regions of members (_OPEN, asked, n_asked), all asked ones being pivots, in blocks of hot by hot."""
    needed = members.select("region", "doc_id", "n", "bits", "size", "n_asked", "asked")

    def run(batches):
        for group in _grouped(batches, "block"):
            yield _edges(*_block(group, group.column("is_pivot").to_numpy())[:2])

    return salted(needed, needed.where("asked"), "region", "size", hot, F.ceil(F.col("n_asked") / hot).cast("int")).mapInArrow(run, "a long, b long")


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (region, doc_id, ...) of regions in more than one part of labels (node, component), with asked: whether the
    row lies outside its region's largest part."""
    part = rows.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    most = part.groupBy("region", "part").agg(F.count("*").alias("m")).groupBy("region").agg(F.max(F.struct("m", "part"))["part"].alias("most"), F.count("*").alias("parts"))
    return part.join(most.where("parts > 1"), "region").withColumn("asked", F.col("part") != F.col("most")).drop("part", "most", "parts")


def coarse_edges(classes: DataFrame, hot: int = HOT, k: int = PIVOTS) -> DataFrame:
    """Edges (a, b) between classes (doc_id, n, keys, bits) whose components no link leaves."""
    keyed, n_docs = classes.select("doc_id", F.explode("keys").alias("region")), classes.count()
    sizes = materialise(keyed.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"), "region-sizes", n_docs)
    cool = keyed.join(sizes.where(F.col("size") <= hot), "region").join(classes.select("doc_id", "n", "bits"), "doc_id")
    edges = region_edges(cool)
    if sizes.where(F.col("size") > hot).isEmpty():
        return edges
    big = keyed.join(sizes.where(F.col("size") > hot), "region").join(classes.select("doc_id", "n", "keys", "bits"), "doc_id").withColumn("used", F.array("region"))
    big = materialise(big.select(*_COLUMNS, F.lit(True).alias("asked"), F.col("size").alias("n_asked")), "hot-regions", n_docs)
    pairs = F.col("n_asked") <= 2 * hot
    edges, turn = edges.unionByName(pair_edges(big.where(pairs), hot)), 0
    now = big.where(~pairs)
    while not now.isEmpty():
        taken, left = peel(now.select(*_COLUMNS), now.where("asked").select("region", "doc_id"), hot if turn else min(hot, k), hot, turn)
        labels = components(edges.unionByName(taken))
        left = _unsettled(left.drop("size"), labels)
        left = materialise(left.join(left.groupBy("region").agg(F.count("*").alias("size"), F.count_if("asked").alias("n_asked")), "region"), "open-regions", n_docs)
        split = ~pairs & (F.size("used") == 1)
        after = left.where(~split)
        if not left.where(split).isEmpty():
            other = left.where(split).withColumn("key", F.explode(F.filter("keys", lambda x: ~F.array_contains("used", x))))
            other = other.withColumn("used", F.array_sort(F.concat("used", F.array("key")))).withColumn("region", F.xxhash64("used")).dropDuplicates(["region", "doc_id"]).drop("size", "n_asked")
            met = other.groupBy("region").agg(F.count("*").alias("size"), F.count_if("asked").alias("n_asked")).where("size > 1 and n_asked > 0")
            after = materialise(after.unionByName(other.join(met, "region").select(*after.columns)), "split-regions", n_docs)
        # what is known so far is a star around the first node of each component
        edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        few = after.where(pairs)
        if not few.isEmpty():
            edges = materialise(edges.unionByName(pair_edges(few, hot)), "region-edges")
        now, turn = after.where(~pairs), turn + 1
    return edges


def set_rows(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, *carried) as (doc_id, *carried, shingles binary): sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                data, offsets = raw(texts)
                owner, value = shingles(data, offsets)
                ends = np.searchsorted(owner, np.arange(len(rows) + 1))
                sets = pa.array([value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(rows.column(c) for c in carried), sets], ["doc_id", *carried, "shingles"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *carried]) + ", shingles binary")


class Sets:
    """Shingle sets of a group, for overlaps of one with many."""

    def __init__(self, packed: list[bytes]):
        self.n = np.array([len(p) // 8 for p in packed], np.int64)
        self.flat = np.frombuffer(b"".join(packed), np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])

    def one(self, i: int) -> np.ndarray:
        return self.flat[self.begin[i] : self.begin[i + 1]]

    def overlap(self, probe: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Size of the intersection of probe (sorted) with each of rows."""
        if not len(rows):
            return np.zeros(0, np.int64)
        n = self.n[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.begin[rows] - (ends - n), n) + np.arange(ends[-1])
        x = self.flat[at]
        found = probe[np.minimum(np.searchsorted(probe, x), len(probe) - 1)] == x
        return np.bincount(np.repeat(np.arange(len(rows)), n), found, len(rows)).astype(np.int64)


def _linked(both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return 100 * both >= 75 * (a + b - both)


def exact_links(doc: np.ndarray, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Edges of links that connect what links connect in the group: pivots, balls and triangle windows."""
    left, edges = np.ones(len(doc), bool), []
    for p in range(len(doc)):
        if not left[p]:
            continue
        left[p] = False
        near = np.flatnonzero(left)
        if not len(near):
            break
        both = sets.overlap(sets.one(p), near)
        distance = 1 - both / (sets.n[p] + sets.n[near] - both)
        ball = _linked(both, sets.n[p], sets.n[near])
        taken = near[ball]
        edges += [(doc[p], doc[x]) for x in taken]
        left[taken] = False
        # y outside the ball may link to x inside only if d(x, p) >= d(y, p) - 1/4
        for y, d in zip(near[~ball], distance[~ball], strict=True):
            if d > 0.5 + 1e-9:
                continue
            rows = taken[distance[ball] >= d - 0.25 - 1e-9]
            hit = np.flatnonzero(_linked(sets.overlap(sets.one(y), rows), sets.n[y], sets.n[rows]))
            if len(hit):
                edges.append((doc[y], doc[rows[hit[0]]]))
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def small_links(members: DataFrame) -> DataFrame:
    """Edges of links in groups that one task holds; members (doc_id, component, shingles)."""

    def run(batches):
        for group in _grouped(batches, "component"):
            if len(group) > 1:
                yield _edges(*exact_links(group.column("doc_id").to_numpy(), Sets(group.column("shingles").to_pylist())))

    return members.repartition(partitions(members.sparkSession), "component").sortWithinPartitions("component", "doc_id").mapInArrow(run, "a long, b long")


_MEASURED = "component long, doc_id long, distances array<double>"


def measure(members: DataFrame, pivots: DataFrame, each: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of pivots that connect what they link, and _MEASURED: each member's distances to its pivots, in order
    of doc_id. members and pivots: (component, doc_id, shingles, size)."""

    def run(batches):
        for group in _grouped(batches, "block"):
            doc, is_pivot, sets = group.column("doc_id").to_numpy(), group.column("is_pivot").to_numpy(), Sets(group.column("shingles").to_pylist())
            pivots, rows = np.flatnonzero(is_pivot), np.flatnonzero(~is_pivot)
            both = np.array([sets.overlap(sets.one(p), rows) for p in pivots])
            n, m = sets.n[rows][None, :], sets.n[pivots][:, None]
            a, b = _star(doc[pivots], doc[rows], _linked(both, m, n))
            distance = 1 - both / (n + m - both)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(pivots)), pa.array(distance.T.ravel()))
            component = group.column("component").to_numpy()[rows]
            none = lambda k, t=pa.int64(): pa.nulls(k, t)
            names = ["component", "doc_id", "distances", "a", "b"]
            yield pa.RecordBatch.from_arrays([none(len(a)), none(len(a)), none(len(a), lists.type), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(component), pa.array(doc[rows]), lists, none(len(rows)), none(len(rows))], names)

    done = materialise(salted(members, pivots, "component", "size", each).mapInArrow(run, _MEASURED + ", a long, b long"), "measured")
    return done.where("a is not null").select("a", "b"), done.where("a is null").drop("a", "b")


def large_links(members: DataFrame, block_docs: int = BLOCK_DOCS, k: int = GROUP_PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """Edges of links that connect what links connect in groups of any size; members (doc_id, component, shingles)."""
    members = materialise(members, "large-groups")
    light = members.select("component", "doc_id").distinct()
    # long documents count for more than one, so that blocks are bounded in bytes too
    weight = F.greatest(F.lit(1), F.ceil(F.octet_length("shingles") / (8 * UNIT)))
    members = members.withColumn("weight", weight)
    members = members.join(members.groupBy("component").agg(F.sum("weight").alias("size")), "component")
    asked, edges, near, before = light, None, None, None
    for turn in range(rounds):
        pivots = members.join(_first_of(asked, "component", k, turn).select("doc_id"), "doc_id")
        busy = members if turn == 0 else members.join(asked.select("component").distinct(), "component", "left_semi")
        links, distances = measure(busy, pivots, 4 * block_docs)
        edges = links if edges is None else edges.unionByName(links)
        distances = distances.withColumnRenamed("distances", f"d{turn}")
        near = distances if near is None else near.join(distances, ["component", "doc_id"], "left")
        # the largest connected part of each group asks nothing more: the others ask it
        parts = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
        parts = light.join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        most = parts.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "part"))["part"].alias("most"))
        parts = materialise(parts.join(most, "component").withColumn("asked", F.col("part") != F.col("most")).drop("most"), "parts")
        asked = parts.where("asked").select("component", "doc_id")
        now = asked.groupBy("component").count().agg(F.max("count"), F.sum("count")).first()
        if not now[0]:
            return edges
        if now[0] <= block_docs or before is not None and 4 * now[1] > 3 * before:
            break
        before = now[1]
    lists = [F.coalesce(f"d{i}", F.array().cast("array<double>")) for i in range(turn + 1)]
    rows = members.join(parts, ["component", "doc_id"])
    counts = rows.groupBy("component").agg(F.ceil(F.sum(F.when(F.col("asked"), F.col("weight")).otherwise(0)) / block_docs).cast("int").alias("ni"), F.ceil(F.sum("weight") / block_docs).cast("int").alias("nj")).where("ni > 0")
    rows = rows.join(counts, "component").join(near.select("component", "doc_id", F.concat(*lists).alias("distances")), ["component", "doc_id"])
    chunk = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    columns = ["doc_id", "part", "distances", "shingles", "is_asked", "block"]
    block = F.xxhash64("component", "i", "j").alias("block")
    asking = rows.where("asked").withColumn("i", chunk("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).select("*", F.lit(True).alias("is_asked"), block)
    given = rows.withColumn("j", chunk("nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).select("*", F.lit(False).alias("is_asked"), block)
    tasks = asking.select(*columns).unionByName(given.select(*columns))

    def search(batches):
        for group in _grouped(batches, "block"):
            doc, is_asked, sets = group.column("doc_id").to_numpy(), group.column("is_asked").to_numpy(), Sets(group.column("shingles").to_pylist())
            part, d = group.column("part").to_numpy().copy(), np.stack(group.column("distances").to_numpy())
            there, found = np.flatnonzero(~is_asked), []
            for y in np.flatnonzero(is_asked):
                rows = there[(part[there] != part[y]) & (np.abs(d[there] - d[y]).max(1) <= 0.25 + 1e-9)]
                hit = rows[_linked(sets.overlap(sets.one(y), rows), sets.n[y], sets.n[rows])]
                roots, first = np.unique(part[hit], return_index=True)
                found += [(doc[y], doc[x]) for x in hit[first]]
                part[np.isin(part, roots)] = part[y]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield _edges(pairs[:, 0], pairs[:, 1])

    rest = tasks.repartition(partitions(members.sparkSession), "block").sortWithinPartitions("block", "doc_id").mapInArrow(search, "a long, b long")
    return edges.unionByName(rest)


def join(docs: DataFrame, group: int = GROUP, hot: int = HOT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id) of docs (doc_id, text)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    found = materialise(sketches(base), "sketches")
    n_docs = found.count()
    same = ["n", "d1", "d2"]
    classes = materialise(found.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "classes", n_docs)
    coarse = components(coarse_edges(classes, hot)).withColumnRenamed("node", "doc_id")
    sizes = coarse.join(classes.select("doc_id", "n"), "doc_id").groupBy("component").agg(F.sum("n").alias("total"))
    held = materialise(coarse.join(sizes, "component").select("doc_id", "component", (F.col("total") > group).alias("large")), "groups", n_docs)
    # equal rows count once
    chosen = lambda large: set_rows(base.join(held.where("large" if large else "not large"), "doc_id").withColumn("_tag", F.xxhash64("text")).dropDuplicates(["doc_id", "_tag"]).select("doc_id", "text", "component"), ["component"])
    links = small_links(chosen(False))
    if not held.where("large").isEmpty():
        links = links.unionByName(large_links(chosen(True), block_docs))
    links = materialise(links, "links")
    final = components(links).select(F.col("node").alias("class_id"), "component")
    remove(links, held)
    of_class = classes.select(*same, F.col("doc_id").alias("class_id")).join(final, "class_id", "left").select(*same, "class_id", F.coalesce("component", "class_id").alias("component"))
    out = found.join(of_class, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumns({c: F.when(F.col(c) != _NO_ID, F.col(c)) for c in ("doc_id", "component_id", "class_id")})


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id. Documents of an empty set all stay."""
    stay = join(docs.select("doc_id", "text")).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(stay.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")
