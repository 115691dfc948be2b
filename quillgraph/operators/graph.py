"""Neighbourhood and bounded breadth-first traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted

MAX_DEPTH = 10
#: Nodes of a level whose edges are read by their keys; the edges of more are found by a join. So many keys prune row
#: groups one by one (spark.sql.parquet.pushdown.inFilterThreshold).
LOOKUP = 10


def outgoing(edges: DataFrame, src: str, relation: str | None = None) -> DataFrame:
    found = edges.filter(F.col("src") == src)
    return found if relation is None else found.filter(F.col("relation") == relation)


def incoming(edges: DataFrame, dst: str, relation: str | None = None) -> DataFrame:
    found = edges.filter(F.col("dst") == dst)
    return found if relation is None else found.filter(F.col("relation") == relation)


def related(edges: DataFrame, id: str) -> DataFrame:
    """Edges at both sides with a ``direction``, in one scan; a self-loop comes in both directions."""
    ways = F.array(
        F.when(F.col("src") == id, F.lit("outgoing")), F.when(F.col("dst") == id, F.lit("incoming"))
    )
    both = edges.filter((F.col("src") == id) | (F.col("dst") == id))
    return both.select(F.explode(F.array_compact(ways)).alias("direction"), *edges.columns)


def traverse(
    entities: DataFrame, edges: DataFrame, start: str, relation: str | None = None, max_depth: int = 1
) -> DataFrame:
    """``id, depth, relation, place``: breadth-first along outgoing edges.

    The start comes first at depth 0; each node comes once, at its least depth, with the relation of the edge
    that found it first: edges are ordered by their source's place, then relation, then target. ``place`` is
    the chain of relations and ids that leads to a node, so ordering by depth and place gives the walk's order
    without numbering the rows. Targets without an entity are neither returned nor followed. An unknown start
    gives no rows. A walk of several levels sorts the edges to entities by source once; a level then reads only the
    row groups with edges of its nodes, while these are at most LOOKUP, and all edges beyond. An empty level ends the walk.
    """
    if isinstance(max_depth, bool) or not isinstance(max_depth, int) or max_depth < 0:
        raise ValueError("max_depth must be a whole number, 0 or more")
    followed = (edges if relation is None else edges.filter(F.col("relation") == relation)).select("src", "dst", "relation")
    ids = entities.select("id")
    none = F.lit(None).cast("string")
    level = ids.filter(F.col("id") == start).limit(1)
    level = level.select("id", F.lit(0).alias("depth"), none.alias("relation"), F.array().cast("array<string>").alias("place"))
    level, n = materialize_counted(level, "walk")
    several = n and max_depth > 1
    if several:
        followed = followed.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")
        followed = materialize(followed.repartitionByRange("src", "dst").sortWithinPartitions("src"), "edges")
    levels = [level]
    for depth in range(1, max_depth + 1):
        if not n:
            break
        near = followed
        if several and n <= LOOKUP:
            near = followed.filter(F.col("src").isin([r["id"] for r in level.select("id").collect()]))
        steps = near.join(level.select(F.col("id").alias("src"), "place"), "src")
        # the edge that comes first, per target: combined map-side, so a hot target is one row per task
        best = steps.groupBy("dst").agg(F.min(F.struct("place", "relation")).alias("via")).withColumnRenamed("dst", "id")
        seen = reduce(DataFrame.unionByName, levels).select("id")
        fresh = best.join(seen, "id", "left_anti")
        if not several:
            fresh = fresh.join(ids, "id", "left_semi")
        place = F.concat("via.place", F.array("via.relation", "id")).alias("place")
        level, n = materialize_counted(fresh.select("id", F.lit(depth).alias("depth"), F.col("via.relation").alias("relation"), place), "walk")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)
