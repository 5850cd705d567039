"""Recursive operators: impact, subtypes, member chains. Set semantics over frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    """Rows (node, depth) reachable along edges (src, dst) from start (node), each with its least depth; start is 0.

    Every level anti-joins what was visited, so cycles end, and is checkpointed: a level's plan stays as small as the
    first one's, and a lost executor costs one level.
    """
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    edges = cut(edges.select("src", "dst").distinct())
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impacted_files(edges: DataFrame, uri: str, max_depth: int = 3) -> DataFrame:
    """Files that reference uri, directly or through others; edges (uri, target_uri)."""
    start = edges.sparkSession.createDataFrame([(uri,)], "node string")
    found = reach(edges.select(F.col("target_uri").alias("src"), F.col("uri").alias("dst")), start, max_depth)
    return found.where("depth > 0").select(F.col("node").alias("uri"), "depth")


def inherits(symbols: DataFrame) -> DataFrame:
    """Edges (child, parent) of extends and implements."""
    both = F.array_compact(F.concat(F.coalesce("implements", F.array().cast("array<string>")), F.array("extends")))
    return symbols.select(F.col("name").alias("child"), F.explode(both).alias("parent")).distinct()


def implementations(edges: DataFrame, name: str, max_depth: int | None = 10) -> DataFrame:
    """All subtypes of a name."""
    start = edges.sparkSession.createDataFrame([(name,)], "node string")
    return reach(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start, max_depth).where("depth > 0")


def resolve_members(requests: DataFrame, members: DataFrame, depth: int = 10) -> DataFrame:
    """requests (request_id, base, properties) down members (base, property, target): the last target reached."""
    at = requests.select("request_id", F.col("base").alias("node"), "properties")
    ended = None
    step = members.select(F.col("base").alias("node"), F.col("property").alias("_p"), F.col("target").alias("_t"))
    for level in range(depth):
        over = F.size("properties") <= level
        done = at.where(over)
        at = at.where(~over).withColumn("_p", F.get("properties", F.lit(level))).join(step, ["node", "_p"]).select("request_id", F.col("_t").alias("node"), "properties")
        # requests that have arrived leave the walk, so a level's plan holds no case distinctions of the ones before
        ended = done if ended is None else ended.unionByName(done)
        at = cut(at)
        if at.isEmpty():
            break
    return ended.unionByName(at.where(F.size("properties") <= depth)).select("request_id", F.col("node").alias("target")).distinct()
