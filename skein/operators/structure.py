"""Triangles, similarity, independent sets, label propagation, spanning forests and PageRank."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.errors import OutOfRange
from skein.graph import Graph
from skein.operators.components import min_labels, numbered
from skein.operators.wedges import closed
from skein.plans.iterate import Rounds
from skein.plans.scratch import dealt, spread, written


def _closed(g: Graph) -> DataFrame:
    """(w, u, v) of each triangle once, and for each of its pairs which arcs there are: ``wu`` is whether w points at u, and so on.

    Ids that are no whole numbers are numbered for it, in their order.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    ends = g.edges.filter("src != dst").select(a.alias("a"), b.alias("b"), (F.col("src") == a).alias("up"))
    if g.directed:
        pairs = ends.groupBy("a", "b").agg(F.max("up").alias("ab"), F.max(~F.col("up")).alias("ba"))
    else:
        pairs = ends.select("a", "b").distinct().withColumns({"ab": F.lit(True), "ba": F.lit(True)})
    with spread(g.spark, g.about):
        pairs = written(pairs, "pairs")
    if isinstance(pairs.schema["a"].dataType, T.IntegralType):
        return closed(pairs.withColumns({"a": F.col("a").cast("long"), "b": F.col("b").cast("long")}))
    number = written(numbered(pairs.select(F.explode(F.array("a", "b")).alias("component")).distinct()), "numbers")
    to = lambda c: number.withColumnsRenamed({"component": c, "number": f"{c}_"})
    found = closed(pairs.join(to("a"), "a").join(to("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "ab", "ba"))
    for c in "wuv":
        found = found.withColumnRenamed(c, "number").join(number.withColumnRenamed("component", c), "number").drop("number")
    return found


def triangles(g: Graph) -> DataFrame:
    """(a, b, c), a < b < c, of each triangle, direction and parallel edges aside."""
    three = _closed(g).select(F.array_sort(F.array("w", "u", "v")).alias("t"))
    return three.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def triangle_count(g: Graph) -> int:
    return _closed(g).count()


def directed_triangle_count(g: Graph) -> int:
    """Transitive triads: u to v, v to w and u to w, all different, on distinct edges."""
    return _triads(g, [(x, y, z) for x in "wuv" for y in "wuv" for z in "wuv" if len({x, y, z}) == 3], closing=(0, 2))


def cyclic_triangle_count(g: Graph) -> int:
    """Directed cycles of three vertices."""
    return _triads(g, [("w", "u", "v"), ("w", "v", "u")], closing=(2, 0))


def _triads(g: Graph, orders: list[tuple[str, str, str]], closing: tuple[int, int]) -> int:
    """The ways to order a triangle's vertices so that the first points at the second, that at the third, and the closing arc is there."""
    ways = [(F.col(t[0] + t[1]) & F.col(t[1] + t[2]) & F.col(t[closing[0]] + t[closing[1]])).cast("long") for t in orders]
    total = ways[0]
    for way in ways[1:]:
        total = total + way
    return _closed(g).agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def jaccard(g: Graph) -> DataFrame:
    """(src, dst, eid, common, union_size, jaccard) of each edge that is no loop, parallel ones too: likeness of its ends' sets of out-neighbours."""
    arcs = g.arcs.filter("src != dst")
    near = arcs.select("src", "dst").distinct()
    with spread(g.spark, g.about):
        size = written(near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "sizes")
    # a common neighbour makes a triangle with the edge's ends, both of which point at it
    pair = lambda x, y, z: F.when(F.col(x + z) & F.col(y + z), F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    hits = _closed(g).select(F.explode(F.array(pair("w", "u", "v"), pair("w", "v", "u"), pair("u", "v", "w"))).alias("p")).filter("p is not null")
    with spread(g.spark, 4 * g.about):  # several tasks count the same pair
        common = written(hits.groupBy("p.a", "p.b").agg(F.count("*").alias("common")), "common")
    rows = dealt(arcs.select("src", "dst", "eid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), g.about, "a", "b").join(dealt(common, g.about, "a", "b"), ["a", "b"], "left").drop("a", "b")
    by = lambda df, end, n: dealt(df, g.about, end).join(dealt(size.withColumnsRenamed({"id": end, "n": n}), g.about, end), end, "left")
    rows = by(by(rows, "src", "a"), "dst", "b")
    rows = rows.withColumn("common", F.coalesce("common", F.lit(0))).withColumn("union_size", F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - F.col("common"))
    return rows.select("src", "dst", "eid", "common", "union_size", F.when(F.col("union_size") == 0, 0.0).otherwise(F.col("common") / F.col("union_size")).alias("jaccard"))


def maximal_independent_set(g: Graph, seed: Any = None) -> DataFrame:
    """(id): the set that taking vertices one by one gives - the seed first (the smallest id without one), then ascending - unless an earlier choice has an edge to them.

    Vertices with a loop are left out. A round settles every vertex that no undecided earlier one has an edge to.
    """
    loops = g.edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    if seed is not None and not g.contains_vertex(seed):
        raise OutOfRange(f"no vertex {seed}")
    # before another: the seed, else the smaller id
    rank = lambda c: F.struct((F.lit(True) if seed is None else F.col(c) != F.lit(seed)).alias("later"), F.col(c).alias("id"))
    ends = lambda df: df.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    if not g.directed:  # each edge once, from the earlier end
        first = rank("src") < rank("dst")
        pairs = g.edges.filter("src != dst").select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    else:
        pairs = g.edges.filter("src != dst").select("src", "dst").filter(rank("src") < rank("dst"))
    with spread(g.spark, g.about):
        arcs = written(pairs.distinct(), "mis-edges")
        chosen = Rounds(g.vertices.select("id"), "mis")
        left = written(g.vertices.select("id").join(loops, "id", "left_anti"), "mis-left")
    with spread(g.spark, arcs.count()):
        arcs = written(ends(arcs), "mis-edges")
    while not left.isEmpty():
        with spread(g.spark, arcs.count()):
            free = chosen.add(left.join(arcs.select(F.col("dst").alias("id")), "id", "left_anti"))
            out = arcs.join(free.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            left = written(left.join(free, "id", "left_anti").join(out, "id", "left_anti"), "mis-left")
            arcs = written(ends(arcs), "mis-edges")
    return chosen.all() if chosen.n else g.vertices.select("id").limit(0)


def label_propagation(g: Graph, labels: DataFrame | None = None, max_iterations: int = 20) -> DataFrame:
    """(id, label): each vertex takes the commonest label of its out-neighbours (parallel edges vote twice), all at once, until nothing changes.

    A vertex keeps its label if that is among the commonest; other ties go to the smallest label. ``labels``: (id, label) to start from,
    null or missing ones don't vote; by default every vertex is its own label. A state that alternates ends the loop.
    """
    start = g.vertices.select("id", F.col("id").alias("label")) if labels is None else g.vertices.select("id").join(labels.select("id", "label"), "id", "left")
    arcs = written(g.arcs.select("src", "dst"), "votes")
    rounds = Rounds(start, "labels")
    state, marks = rounds.add(start), []
    for _ in range(max_iterations):
        votes = arcs.join(state.filter("label is not null").withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        own = state.withColumnRenamed("label", "own")
        ranked = votes.join(own, "id").groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), ~F.col("label").eqNullSafe(F.col("own")), "label")).alias("new"))
        state = rounds.add(state.join(ranked, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
        rounds.forget(rounds.n - 2)
        mark = tuple(state.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)")), F.count("*")).first())
        if mark in marks[-2:]:
            break
        marks.append(mark)
    return state


#: Edges between trees from which on the driver ends a spanning forest by itself; the forest is the same either way.
MOST_LOCAL_EDGES = 50_000


def _forest_of(rows: list) -> list[tuple]:
    """(src, dst, eid) of the forest of a few (a, b, e), by ascending e; nulls first and NaN last, as in Spark."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    out = []
    for a, b, e in sorted(rows, key=lambda r: tuple(map(rank, r["e"]))):
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            out.append((e["src"], e["dst"], e["eid"]))
    return out


def minimum_spanning_forest(g: Graph, weight: Column | str, descending: bool = False) -> DataFrame:
    """The edges of a spanning forest of least total weight (largest if ``descending``), direction aside: rounds in which every tree takes its best edge out.

    Of the edges between two vertices, either way, only the best counts. Equal weights are told apart by ``eid`` and the ends, so the
    forest is unique, and right where both directions of a pair are stored; loops are never taken.
    """
    w = F.col(weight) if isinstance(weight, str) else weight
    pairs = g.edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (-w if descending else w).alias("w"), "eid", "src", "dst")
    best = F.min(F.struct("w", "eid", "src", "dst")).alias("e")
    edges = written(pairs.groupBy("a", "b").agg(best), "mst-edges")
    tree = Rounds(edges.select("e.src", "e.dst", "e.eid"), "mst")
    while not edges.isEmpty():
        rest = edges.limit(MOST_LOCAL_EDGES + 1).collect()  # a proven bound
        if len(rest) <= MOST_LOCAL_EDGES:
            tree.add(g.spark.createDataFrame(_forest_of(rest), tree.schema))
            break
        ends = edges.select(F.col("a").alias("id"), "e").unionAll(edges.select(F.col("b").alias("id"), "e"))
        chosen = written(ends.groupBy("id").agg(F.min("e").alias("e")).select("e").distinct(), "mst-chosen")
        tree.add(chosen.select("e.src", "e.dst", "e.eid"))
        label = written(min_labels(edges.join(chosen, "e", "left_semi"), "a", "b"), "mst-labels")
        to = lambda c: label.withColumnsRenamed({"id": c, "component": f"{c}_"})  # noqa: B023, E731
        left = edges.join(to("a"), "a").join(to("b"), "b").filter("a_ != b_")
        # of the edges between two trees only the best can be chosen
        edges = written(left.groupBy(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).agg(F.min("e").alias("e")), "mst-edges")
    if not tree.n:
        return g.edges.limit(0)
    return g.edges.join(tree.all(), ["src", "dst", "eid"], "left_semi").dropDuplicates(["src", "dst", "eid"]).select(*g.edges.columns)


#: The same forest whichever algorithm a caller knows it by.
kruskal = minimum_spanning_forest


def spanning_forest_weight(g: Graph, weight: str, descending: bool = False) -> tuple[Any, int]:
    """The total weight of the spanning forest and its number of trees; every vertex counts."""
    forest = written(minimum_spanning_forest(g, weight, descending), "forest")
    total, n = forest.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    return total, g.num_vertices() - n


def prim(g: Graph, seed: Any, weight: str, descending: bool = False) -> tuple[DataFrame, Any]:
    """(id, predecessor) of the seed's tree in the spanning forest, and its total weight; other vertices are not in it."""
    from skein.operators.traverse import bfs

    forest = written(minimum_spanning_forest(g, weight, descending), "forest")
    tree = bfs(g._with(edges=forest, directed=False), seed)
    total = forest.join(tree.select(F.col("id").alias("src")), "src", "left_semi").agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return tree.select("id", F.coalesce("parent", "id").alias("predecessor")), total


def pagerank(g: Graph, damping: float = 0.85, tolerance: float = 1e-4, max_iterations: int = 100, weight: str | None = None) -> DataFrame:
    """(id, score): scores sum to 1; vertices without weight out share theirs with all; stops when the total change is below ``tolerance``."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    arcs = g.arcs.select("src", "dst", w.alias("w"))
    total = arcs.groupBy("src").agg(F.sum("w").alias("t")).filter("t > 0")
    share = written(arcs.join(total, "src").groupBy("src", "dst").agg((F.sum("w") / F.first("t")).alias("share")), "shares")
    linked = share.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    n = g.num_vertices()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("score"))
    start = g.vertices.select("id").join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("score"), F.lit(float("inf")).alias("change"))
    rounds = Rounds(start, "pagerank")
    state = rounds.add(start)
    for _ in range(max_iterations):
        change, hung = state.agg(F.sum("change"), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("score"))), F.lit(0.0))).first()
        if change < tolerance:
            break
        base = (1 - damping + damping * hung) / n
        got = share.join(state.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
        state = rounds.add(state.join(got, "id", "left").select("id", "linked", new.alias("score"), F.abs(new - F.col("score")).alias("change")))
        rounds.forget(rounds.n - 2)
    return state.select("id", "score")

