"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier.

1. Anchors. The windows of LENGTH bytes of a text are cut into runs that share the least hash of their 32-byte strings.
   Equal windows have equal least hashes, so a window can repeat only if its run's hash does. Hashes are counted by
   Spark, once for each block of texts, and runs whose hash stands alone are done.
2. Segments. The bytes of the other runs go to the task of their hash. A task goes through its documents in order and
   sends equal segments once, as far as it remembers them in bounded memory; the later ones are removed as they stand. A
   passage that stands in a third of all documents so arrives about once for each task that read texts.
3. Two-stage suffix sorting over the segments of a task: only suffixes smaller than their successors (type S) are sorted
   directly; a scan of the buckets from the smallest character on places all others (type L) by the suffix after them.
   Neighbours with a common prefix of LENGTH bytes are repeats, and all but the first start are removed.
4. Removed windows are merged into spans by document and cut out.

"Earlier" is a smaller doc_id, or an earlier start in the same document; strings are judged on the input. Matches never
cross documents. Null text counts as empty; texts under LENGTH bytes lose nothing. Rows that repeat doc_id and text are
one document and get the same result each; rows that repeat doc_id with another text go in order of a hash of the text.
A null doc_id comes before all others. An empty table gives no rows. A very long text is a block of its own, some 60 bytes
for each of its bytes in that task. Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, materialise, partitions, raw, table

LENGTH = 100
GRAM = 32
#: Bytes of segments that one suffix array takes, unless one hash has more (those go in parts of this size).
SORT_BYTES = 2 << 20
#: Bytes of segments that a task remembers as sent, in each of two generations.
SEEN_BYTES = 16 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NO_ID = -(1 << 63)


def _slide(f, h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        h = f(h[:-step], h[step:])
        step *= 2
    return f(h[: len(h) - (width - step)], h[width - step :])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows) of all runs of windows in the texts, start counting bytes of data; hashes that stand
    twice within a run, so that its own windows may be equal."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    h, step = (data.astype(np.uint64) + np.uint64(1)) * _M1, 1
    while step < GRAM:
        h = (h[:-step] * _M3) ^ (h[step:] + (h[step:] >> np.uint64(29)))
        h *= _M2
        h ^= h >> np.uint64(31)
        step *= 2
    width, own = LENGTH - GRAM + 1, h
    h = _slide(np.minimum, h, width)
    edge = np.zeros(width - 1, np.uint64)
    least = np.flatnonzero(own == _slide(np.maximum, np.concatenate([edge, h, edge]), width))
    twice = own[least[1:]][(own[least[1:]] == own[least[:-1]]) & (np.diff(least) <= width)]
    inside = np.ones(len(h), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(inside & np.r_[True, (h[1:] != h[:-1]) | ~inside[:-1]])
    stops = np.flatnonzero(inside & np.r_[(h[1:] != h[:-1]) | ~inside[1:], True])
    return h[starts].view(np.int64), starts, stops - starts + 1, np.unique(twice).view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """Rows (v, doc_id, tag, known): known runs repeat in their block; of the others, one row for each hash and block."""

    def run(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                data, offsets = raw(texts)
                v, start, _, twice = runs(data, offsets)
                doc = np.searchsorted(offsets, start, "right") - 1
                _, first, back, n = np.unique(v, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero((n[back] > 1) | np.isin(v, twice))
                take, known = np.concatenate([first, again]), np.repeat([False, True], [len(first), len(again)])
                ids, tags = (rows.column(c).to_numpy() for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[take], ids[doc[take]], tags[doc[take]], known)], ["v", "doc_id", "tag", "known"])

    return docs.mapInArrow(run, "v long, doc_id long, tag int, known boolean")


def repeated(found: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, v) of the runs whose hash occurs twice or more."""
    # known rows are dealt by document, so that a hot hash meets once for each block only
    dealt = found.repartition(partitions(found.sparkSession), F.when(F.col("known"), F.xxhash64("doc_id", "tag")).otherwise(F.col("v"))).sortWithinPartitions("known", "v")

    def run(batches):
        last: pa.RecordBatch | None = None  # the row before this batch, if it isn't known
        told = True  # whether that row has been given out
        for batch in batches:
            if not len(batch):
                continue
            known, v = batch.column("known").to_numpy(zero_copy_only=False), batch.column("v").to_numpy()
            same = np.r_[last is not None and last.column("v")[0].as_py() == v[0], v[1:] == v[:-1]] & ~known
            if same[0] and not told:
                yield last.select(["doc_id", "tag", "v"])
            keep = known | same | np.r_[same[1:], False]
            yield batch.filter(pa.array(keep)).select(["doc_id", "tag", "v"])
            last, told = (None, True) if known[-1] else (batch.slice(len(v) - 1), bool(keep[-1]))

    return dealt.mapInArrow(run, "doc_id long, tag int, v long")


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it."""
    n = len(t)
    step = np.zeros(n, bool)
    step[:-1] = t[:-1] != t[1:]
    step[-1] = True
    at = np.minimum.accumulate(np.where(step, np.arange(n), n)[::-1])[::-1]
    return np.r_[t, 0][at] < np.r_[t[1:], 0, 0][at]


def two_stage_order(t: np.ndarray, need: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Needed suffixes of t by their first depth characters. need is closed: a needed type L position's successor is needed.

    Rows of t that are 0 end a segment; no needed suffix is compared beyond its segment in a way that matters.
    """
    small = types(t)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(small & need)
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    by_char = np.searchsorted(t[direct], np.arange(257))
    arrived: dict[int, list[np.ndarray]] = {}
    if len(t) and need[-1]:  # the last suffix is type L, induced by the empty one
        arrived[int(t[-1])] = [np.array([len(t) - 1])]
    order = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Places the type L predecessors of scanned suffixes; returns those of the same character."""
        before = scanned[scanned > 0] - 1
        before = before[need[before] & ~small[before]]
        chars = t[before]
        same = before[chars == c]
        before, chars = before[chars > c], chars[chars > c]
        if len(before):
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
            for part, first in zip(np.split(before, cuts), chars[np.r_[0, cuts]], strict=True):
                arrived.setdefault(int(first), []).append(part)
        return same

    for c in range(256):
        now = np.concatenate(got) if (got := arrived.pop(c, None)) else np.zeros(0, np.int64)
        while len(now):
            order.append(now)
            now = induce(now, c)
        if by_char[c + 1] > by_char[c]:
            part = direct[by_char[c] : by_char[c + 1]]
            order.append(part)
            induce(part, c)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most most, in steps of 4 bytes."""
    padded = np.concatenate([t, np.zeros(most + 4, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)
    words = np.ascontiguousarray(words).view(np.uint32).ravel()
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 4):
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
        out[alive] = k + 4
    return out


def repeats(segments: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments in order of start: for each of their windows, in sequence, whether an equal one comes before it."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    # 0 ends a segment; text bytes are moved up by 1, and 0xFF, which UTF-8 never has, needs no room
    t = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    where = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    need = np.zeros(len(t), bool)
    need[where] = True
    small = types(t)
    at = begin + windows - 1
    while True:  # close: the successor of a needed type L suffix is needed
        at = at[~small[at] & (at + 1 < len(t))] + 1
        at = at[~need[at]]
        if not len(at):
            break
        need[at] = True
    is_window = np.zeros(len(t), bool)
    is_window[where] = True
    order = two_stage_order(t, need)
    order = order[is_window[order]]
    equal = common_prefix(t, order[:-1], order[1:]) >= LENGTH
    group = np.flatnonzero(np.r_[True, ~equal])
    first = np.zeros(len(t), bool)
    first[np.minimum.reduceat(order, group)] = True
    return ~first[where], np.repeat(np.arange(len(segments)), windows)


def _spans(doc, tag, start, windows, gone, owner):
    """Arrow rows (doc_id, tag, start, stop) of maximal stretches of windows that are gone in a segment."""
    place = np.arange(len(gone)) - np.repeat(np.cumsum(windows) - windows, windows)
    head = gone & np.r_[True, ~gone[:-1] | (owner[1:] != owner[:-1])]
    tail = gone & np.r_[~gone[1:] | (owner[1:] != owner[:-1]), True]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    s = owner[a]
    return doc[s], tag[s], start[s] + place[a], start[s] + place[b] + LENGTH


_SEGMENT = ["v", "doc_id", "tag", "start", "stop", "windows", "bytes"]


class Seen:
    """Which of the last strings have come before; what keeps coming is kept, the rest is forgotten when room is needed."""

    def __init__(self, limit: int = SEEN_BYTES):
        self.limit, self.size, self.old, self.new = limit, 0, set(), set()

    def before(self, x: bytes) -> bool:
        if x in self.new:
            return True
        again = x in self.old
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, set(), 0
        self.new.add(x)
        self.size += len(x)
        return again


def segments(docs: DataFrame, remembered: int = SEEN_BYTES) -> DataFrame:
    """docs (doc_id, tag, text, vs), each partition in order of (doc_id, tag): segments of runs with a hash in vs; those
    equal to one that their task still remembers come without bytes, as spans (start, stop) to remove."""

    def run(batches):
        seen = Seen(remembered)
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                data, offsets = raw(texts)
                v, start, windows, _ = runs(data, offsets)
                doc = np.searchsorted(offsets, start, "right") - 1
                lists = rows.column("vs")
                flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
                mix = lambda d, x: (x.view(np.uint64) ^ (d.astype(np.uint64) * _M1)) * _M2
                hit = np.flatnonzero(np.isin(mix(doc, v), mix(owner, flat)))
                ids, tags = (rows.column(c).to_numpy() for c in ("doc_id", "tag"))
                hit = hit[np.lexsort((start[hit], doc[hit]))]
                whole, out = data.tobytes(), []
                for i in hit:
                    piece = whole[start[i] : start[i] + windows[i] + LENGTH - 1]
                    d, at = doc[i], int(start[i] - offsets[doc[i]])
                    out.append((v[i], ids[d], tags[d], at, at + len(piece), windows[i], None if seen.before(piece) else piece))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], _SEGMENT)

    return docs.mapInArrow(run, "v long, doc_id long, tag int, start int, stop int, windows int, bytes binary")


def removed(cut: DataFrame, limit: int = SORT_BYTES) -> DataFrame:
    """Rows (doc_id, tag, start, stop): spans to remove, that may touch or overlap."""
    dealt = cut.repartition(partitions(cut.sparkSession), F.when(F.col("bytes").isNull(), F.xxhash64("doc_id", "tag")).otherwise(F.col("v"))).sortWithinPartitions(F.col("bytes").isNotNull(), "v", "doc_id", "tag", "start")

    def solve(rows: pa.Table, carried: int):
        """Spans of the rows from carried on, and which rows hold a first window."""
        doc, tag, start, windows = (rows.column(c).to_numpy() for c in ("doc_id", "tag", "start", "windows"))
        windows = windows.astype(np.int64)
        gone, owner = repeats(rows.column("bytes").to_pylist(), windows)
        holds = np.bincount(owner, ~gone, len(windows)) > 0
        gone = gone & (owner >= carried)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_spans(doc, tag, start, windows, gone, owner), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tag", "start", "stop"]), holds

    def run(batches):
        held: list[pa.Table] = []
        size = carried = 0
        for batch in batches:
            known = batch.filter(batch.column("bytes").is_null())
            if len(known):
                yield known.select(["doc_id", "tag", "start", "stop"])
            rest = pa.Table.from_batches([batch.filter(batch.column("bytes").is_valid())])
            at = 0
            while at < len(rest):
                ends = np.cumsum((rest.column("stop").to_numpy() - rest.column("start").to_numpy())[at:])
                take = min(len(rest) - at, int(np.searchsorted(ends, limit - size)) + 1)
                held.append(rest.slice(at, take))
                size, at = size + int(ends[take - 1]), at + take
                if size < limit:
                    continue
                rows = pa.concat_tables(held)
                v = rows.column("v").to_numpy()
                last = int(np.searchsorted(v, v[-1]))  # the hash that may go on
                if last > carried:
                    out, _ = solve(rows.slice(0, last), min(carried, last))
                    yield out
                    held, carried = [rows.slice(last)], 0
                else:  # one hash fills the array: earlier rows stay only where they hold a first window
                    out, holds = solve(rows, carried)
                    yield out
                    held = [rows.filter(pa.array(holds))]
                    carried = len(held[0])
                size = int((held[0].column("stop").to_numpy() - held[0].column("start").to_numpy()).sum())
                size = 0 if carried else size
        if held and (rows := pa.concat_tables(held)).num_rows > carried:
            yield solve(rows, carried)[0]

    return dealt.mapInArrow(run, "doc_id long, tag int, start int, stop int")


def apply(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, spans array<struct<start, stop>>, may be null) with the result columns."""

    def run(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                data, offsets = raw(texts)
                whole, out = data.tobytes(), []
                for a, b, spans in zip(offsets[:-1], offsets[1:], rows.column("spans").to_pylist(), strict=True):
                    text, kept, merged = whole[a:b], [], []
                    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append([*s])
                    at = 0
                    for start, stop in merged:
                        kept.append(text[at:start])
                        at = stop
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([x[j] for x in out], k) for j, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, limit: int = SORT_BYTES, remembered: int = SEEN_BYTES) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), text.alias("text"))
    base = base.withColumn("tag", F.hash("text"))
    listed = repeated(anchors(base)).groupBy("doc_id", "tag").agg(F.collect_set("v").alias("vs"))
    # repeated rows send their text once; the rows already lie by these keys, so this moves none
    once = listed.join(base, ["doc_id", "tag"]).select("doc_id", "tag", "text", "vs").dropDuplicates(["doc_id", "tag"]).sortWithinPartitions("doc_id", "tag")
    spans = removed(segments(once, remembered), limit).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialise(spans, "repeated-spans")
    done = apply(base.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans"))
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
