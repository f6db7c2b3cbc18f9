"""What is done to large components before a sequential kernel: trees are visited level by level, vertices that hang on one other are taken off.

Both take rows of (src, dst, eid, component), an edge each, with a row of null ``dst`` and ``eid`` for each vertex, and give
what they have found and the rows that are left to the kernel.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.iterate import Rounds
from skein.plans.scratch import spread, written

#: Rounds, one a level; what is deeper is left to the kernel.
MOST_LEVELS = 40


def visited(rows: DataFrame, root: Any = None) -> tuple[DataFrame | None, DataFrame]:
    """(id, parent, eid, component, depth, size, discover, position) of the components that are trees with all edges away from their start.

    That is ``root`` or the smallest id, by which components are named. Of the edges out of a vertex the smallest ``eid`` comes first; ``discover``
    counts steps in and out of vertices, ``position`` is the place in reverse order of finishing.
    """
    start = F.col("component") if root is None else F.lit(root).cast(rows.schema["src"].dataType)
    edges = rows.filter("eid is not null")
    n = rows.groupBy("component").agg(F.count("eid").alias("e"), F.count("*").alias("n"))
    lost = edges.groupBy("component", "dst").count().filter((F.col("count") > 1) | (F.col("dst") == start)).select("component").distinct()
    trees = written(n.filter("e = n - e - 1").select("component").join(F.broadcast(lost), "component", "left_anti"), "trees")
    if trees.isEmpty():
        return None, rows
    edges = written(edges.join(F.broadcast(trees), "component", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("parent"), "eid", "component"), "tree-edges")
    with spread(rows.sparkSession, edges.count()):
        first = trees.select(start.alias("id"), F.lit(None).cast(edges.schema["id"].dataType).alias("parent"), F.lit(None).cast("long").alias("eid"), "component")
        levels = Rounds(first, "levels")
        level, found = levels.add(first), []
        while not level.isEmpty():
            found.append(level)
            if len(found) > MOST_LEVELS:
                return None, rows
            level = levels.add(edges.join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent", "eid", "component"))
        below, sized = None, []
        for level in reversed(found):
            hung = level.withColumn("hung", F.lit(0).cast("long")) if below is None else level.join(below.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("hung")), "id", "left")
            below = written(hung.select("id", "parent", "eid", "component", (F.coalesce("hung", F.lit(0)) + 1).alias("size")), "sizes")
            sized.insert(0, below)
        zero = F.lit(0).cast("long")
        top = sized[0].select("id", "parent", "eid", "component", zero.alias("depth"), "size", zero.alias("discover"), zero.alias("position"))
        places = Rounds(top, "places")
        above = places.add(top)
        earlier = Window.partitionBy("parent").orderBy("eid", "id").rowsBetween(Window.unboundedPreceding, -1)
        for level in sized[1:]:
            level = level.withColumn("before", F.coalesce(F.sum("size").over(earlier), zero))
            both = level.join(above.select(F.col("id").alias("parent"), "depth", F.col("size").alias("whole"), "discover", "position"), "parent")
            position = F.col("position") + F.col("whole") - F.col("before") - F.col("size")  # after the parent and all that hangs on later edges
            above = places.add(both.select("id", "parent", "eid", "component", (F.col("depth") + 1).alias("depth"), "size", (F.col("discover") + 1 + 2 * F.col("before")).alias("discover"), position.alias("position")))
    return places.all(), rows.join(F.broadcast(trees), "component", "left_anti")


def pendants(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(component, id, other, cut): vertices with one neighbour, the other end, and whether that has more, taken off round by round; edges run both ways."""
    arcs = written(rows.filter("eid is not null").select("component", "src", "dst", "eid"), "hanging")
    off = None
    for _ in range(MOST_LEVELS):
        with spread(rows.sparkSession, arcs.count()):
            degree = written(arcs.groupBy("src").agg(F.count_distinct("dst").alias("n")), "hanging-degrees")
            leaf = degree.filter("n = 1").select("src")
            if leaf.isEmpty():
                break
            here = arcs.join(leaf, "src", "left_semi").select("component", "src", "dst").distinct()
            gone = written(here.join(degree.select(F.col("src").alias("dst"), (F.col("n") > 1).alias("cut")), "dst").select("component", F.col("src").alias("id"), F.col("dst").alias("other"), "cut"), "hung")
            off = gone if off is None else off.unionByName(gone)
            arcs = written(arcs.join(leaf, "src", "left_anti").join(leaf.withColumnRenamed("src", "dst"), "dst", "left_anti").select("component", "src", "dst", "eid"), "hanging")
    core = arcs.select("component", "src").distinct().select("src", F.lit(None).cast(arcs.schema["dst"].dataType).alias("dst"), F.lit(None).cast("long").alias("eid"), "component")
    return off, arcs.select("src", "dst", "eid", "component").unionByName(core)
