"""Incremental maintenance: the same functions serve batch tables and micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import first_by


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins for each key."""
    return first_by(events, [key], *(F.desc(c) for c in order))


def bursts(events: DataFrame, key: str, gap_seconds: int, tie: str) -> DataFrame:
    """Trailing debounce in batch form: events of a key no further apart than the gap are one reindex."""
    w = W.partitionBy(key).orderBy("ts", tie)
    starts = F.when(F.lag("ts").over(w) >= F.col("ts") - F.make_dt_interval(secs=F.lit(gap_seconds)), 0).otherwise(1)
    numbered = events.withColumn("_s", starts).withColumn("_b", F.sum("_s").over(w))
    return numbered.groupBy(key, "_b").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("_b")


def _last() -> Column:
    """Order of a key's events: by time, at the same time a save after a change and an unlink after all."""
    return F.struct("ts", F.when(F.col("event_type") == "unlink", 2).when(F.col("event_type") == "save", 1).otherwise(0))


def debounced(stream: DataFrame, key: str = "uri", gap: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The same on a stream, by session windows; the watermark bounds the state. kinds has all event types of the burst.

    A burst ends the gap after its last event, and at once after one that ends in a save, whose ready_at is its own time.
    """
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    found = rows.agg(F.max_by("content", _last()).alias("content"), F.max_by("event_type", _last()).alias("event_type"), F.sort_array(F.collect_set("event_type")).alias("kinds"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    ready = F.when(F.col("event_type") == "save", F.col("last_ts")).otherwise(F.col("session_window.end"))
    return found.select(key, ready.alias("ready_at"), "event_type", "content", "kinds", "n")


def changes(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Of (uri, hash) snapshots: state added, changed, same or deleted for each uri, with the newest hash."""
    both = now.select("uri", F.col("hash").alias("_now")).join(stored.select("uri", F.col("hash").alias("_old")), "uri", "full")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "deleted").when(F.col("_now") == F.col("_old"), "same").otherwise("changed")
    return both.select("uri", F.coalesce("_now", "_old").alias("hash"), state.alias("state"))


def maintain(stream: DataFrame, store, extract, checkpoint: str, name: str = "index") -> StreamingQuery:
    """Upserts a stream of (uri, event_type, content, ts) into a store: per micro-batch the last event of a uri counts,
    unlink deletes, everything else is extracted anew. A batch that is run again after a failure has the same result."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = latest(batch.withColumn("_at", _last()), "uri", ["_at"]).drop("_at")
        gone = last.where("event_type = 'unlink'").select("uri")
        rows = extract(last.where("event_type <> 'unlink'").select("uri", "content"))
        store.upsert(rows, gone)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
