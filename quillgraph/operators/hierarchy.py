"""Parent-child links to full hierarchies.

Level-wise frontier joins: the roots are level 0, and the levels found so far are joined with the links until
no more nodes are found. The first join goes one level down, the next two, then four: with each round the links are
joined with themselves, so that they lead as far as the levels found are deep. So a tree of depth d takes
log2(d) rounds of one job each, and the links of a long stride are few, as only deep nodes have them. Each node is
found once, from one ancestor. The rounds are written to one folder and read together, so the plan does not
grow with the depth. Joins are on the ancestor, which is one row of the levels; an ancestor of very many nodes makes a
skewed partition on the links' side only, which adaptive execution splits.

Nodes that the roots don't reach are on a cycle or below one; the number of steps to the cycle is not known
there, so they are resolved by doubling the jumps along their parents. For their ancestors, the nodes below
are walked down from the cycles like trees, and each cycle is walked once around from its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted, path_exists, work_path

#: Rows of a round: nodes found (``a`` the node, ``b`` its root), or links of the next stride (from ``a`` to ``b``).
_ROUND = "a string, b string, depth bigint, path array<string>"


def hierarchy_links(edges: DataFrame) -> DataFrame:
    """Distinct ``child, parent`` from ``contains`` (src is the parent) and ``part_of`` (src is the child), any case.

    Null ends are no link.
    """
    relation = F.lower("relation")
    down = relation == "contains"
    linked = relation.isin("contains", "part_of") & F.col("src").isNotNull() & F.col("dst").isNotNull()
    return (
        edges.filter(linked)
        .select(
            F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child"),
            F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"),
        )
        .distinct()
    )


def _levels(links: DataFrame, parents: DataFrame, with_paths: bool) -> DataFrame:
    """``node_id, root_id, depth[, path]`` of all nodes that the roots reach."""
    spark = links.sparkSession
    folder = work_path(spark, "levels")
    read = lambda n, tag: spark.read.schema(_ROUND).parquet(f"{folder}/round={n}/tag={tag}")
    path = lambda *c: (F.concat(*c) if with_paths else F.lit(None).cast("array<string>")).alias("path")

    def write(n: int, rows: DataFrame) -> int:
        seen = Observation()
        rows.observe(seen, F.count_if(F.col("tag") == "found").alias("n")).write.partitionBy("tag").parquet(f"{folder}/round={n}")
        return seen.get["n"]

    roots = parents.join(links.select(F.col("child").alias("parent")), "parent", "left_anti").withColumnRenamed("parent", "a")
    n = write(0, roots.select("a", F.col("a").alias("b"), F.lit(0).cast("bigint").alias("depth"), path(F.array("a")), F.lit("found").alias("tag")))
    # Descendants at a distance of exactly `stride`; their path has the nodes in between and the last.
    far = links.select(F.col("parent").alias("a"), F.col("child").alias("b"), path(F.array("child")))
    rounds, stride = 0, 1
    while n:
        levels, step = read("*", "found"), far.select("a", F.col("b").alias("to"), F.col("path").alias("step"))
        found = levels.join(step, "a").select(F.col("to").alias("a"), "b", (F.col("depth") + stride).alias("depth"), path("path", "step"), F.lit("found").alias("tag"))
        farther = far.select(F.col("a").alias("from"), F.col("b").alias("a"), "path").join(step, "a")
        farther = farther.select(F.col("from").alias("a"), F.col("to").alias("b"), F.lit(None).cast("bigint").alias("depth"), path("path", "step"), F.lit("far").alias("tag"))
        rounds, stride = rounds + 1, 2 * stride
        n = write(rounds, found.unionByName(farther))
        if not path_exists(spark, f"{folder}/round={rounds}/tag=far"):
            break  # no link leads farther
        far = read(rounds, "far")
    if not path_exists(spark, f"{folder}/round=0/tag=found"):
        return spark.createDataFrame([], "node_id string, root_id string, depth bigint" + (", path array<string>" if with_paths else ""))
    return read("*", "found").select(F.col("a").alias("node_id"), F.col("b").alias("root_id"), "depth", *(["path"] if with_paths else []))


def _cycles(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_id, root_id`` of nodes on or below a cycle, and of those on one; ``left`` has ``child, parent``, all within itself.

    After enough doublings the jumps of all nodes end on cycles; they do as soon as the number of distinct
    ends no longer falls. On the cycles, the minimum over windows of doubling length becomes that of the whole.
    """

    def ends(df: DataFrame) -> int:
        return df.agg(F.count_distinct("jump")).first()[0]

    def doubled(df: DataFrame) -> DataFrame:
        far = df.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        return materialize(
            df.join(far, "jump").select("node", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least")),
            "jumps",
        )

    cur = materialize(
        left.select(F.col("child").alias("node"), F.col("parent").alias("jump"), F.col("child").alias("least")), "jumps"
    )
    count = ends(cur)
    while True:
        cur = doubled(cur)
        fewer = ends(cur)
        if fewer == count:
            break
        count = fewer
    on_cycle = cur.select(F.col("jump").alias("node")).distinct()
    ring = left.select(F.col("child").alias("node"), F.col("parent").alias("jump"), F.col("child").alias("least"))
    ring = materialize(ring.join(on_cycle, "node", "left_semi"), "jumps")
    length = 1
    while length < count:
        ring, length = doubled(ring), 2 * length
    least = ring.select(F.col("node").alias("jump"), F.col("least").alias("root_id"))
    lost = cur.join(least, "jump").select(F.col("node").alias("node_id"), "root_id")
    return lost, ring.select(F.col("node").alias("node_id"), F.col("least").alias("root_id"))


def _reached(edges: DataFrame, with_paths: bool) -> tuple[DataFrame, DataFrame, int]:
    """Nodes that the roots reach, the links ``child, parent`` of all others, and the number of these."""
    pairs = materialize(hierarchy_links(edges), "pairs")
    links = materialize(pairs.groupBy("child").agg(F.min("parent").alias("parent")), "links")
    reached = _levels(links, pairs.select("parent").distinct(), with_paths)
    left = links.join(reached.select(F.col("node_id").alias("child")), "child", "left_anti")
    return reached, *materialize_counted(left, "unreached")


def hierarchy(edges: DataFrame, with_paths: bool = False) -> DataFrame:
    """``node_id, root_id, depth[, path]``: one row per id in a hierarchy link.

    ``depth`` is 0 for a root. A node on a cycle or below one has depth -1, the smallest id of the cycle as
    root, and (with paths) a null path. ``path`` is the array of ids from root to node. Of several parents the
    smallest id holds. Repeated links count once; an empty table gives no rows; extra columns of ``edges`` play
    no part.
    """
    reached, left, n = _reached(edges, with_paths)
    if not n:
        return reached
    lost = _cycles(left)[0].select("node_id", "root_id", F.lit(-1).cast("bigint").alias("depth"))
    return reached.unionByName(lost, allowMissingColumns=with_paths)


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, distance`` from paths: every descendant of every node of a tree, as ancestor pairs.

    Nodes on or below a cycle have no path and so no pair here; :func:`all_descendants` has theirs too.
    """
    return (
        tree.filter(F.col("depth") > 0)
        .select("node_id", "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"))
        .select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )


def _cycle_descendants(left: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, distance`` of the nodes on or below a cycle; ``left`` as in :func:`_cycles`."""
    ring = materialize(_cycles(left)[1], "ring")
    members = ring.select(F.col("node_id").alias("child"), "root_id")
    # Opened at the link to its smallest id, a cycle is a single path; the depth on it is the place on the cycle.
    opened = left.join(members, "child").filter(F.col("child") != F.col("root_id")).select("child", "parent")
    starts = ring.filter(F.col("node_id") == F.col("root_id")).select(F.col("node_id").alias("parent"))
    places = materialize(_levels(opened, starts, False), "places")
    below = _levels(left.join(members, "child", "left_anti"), ring.select(F.col("node_id").alias("parent")), True)
    below = materialize(below, "below")
    entry = places.select(F.col("node_id").alias("entry"), F.col("root_id").alias("cycle"), F.col("depth").alias("at"))
    sizes = places.groupBy(F.col("root_id").alias("cycle")).agg(F.count(F.lit(1)).alias("length"))
    other = places.select(F.col("node_id").alias("ancestor_id"), F.col("root_id").alias("cycle"), F.col("depth").alias("place"))
    around = below.join(entry, below["root_id"] == entry["entry"]).join(sizes, "cycle").join(other, "cycle")
    around = around.filter(F.col("ancestor_id") != F.col("entry")).select(
        "ancestor_id", "node_id", (F.col("depth") + F.pmod(F.col("at") - F.col("place"), F.col("length"))).alias("distance")
    )
    return descendants(below).unionByName(around)


def all_descendants(edges: DataFrame) -> DataFrame:
    """``ancestor_id, node_id, distance``: every descendant of every node, on and below cycles too.

    The members of a cycle are ancestors of each other and of all nodes below; ``distance`` is the least number
    of links, and no node is its own ancestor. Of several parents the smallest id holds, as in :func:`hierarchy`.
    """
    reached, left, n = _reached(edges, True)
    pairs = descendants(reached)
    return pairs.unionByName(_cycle_descendants(left)) if n else pairs
