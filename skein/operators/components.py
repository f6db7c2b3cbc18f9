"""Connected components by alternating large-star and small-star contraction.

Each round rewires edges towards smaller ids until every vertex points at the
smallest of its component; rounds grow with the logarithm of the component size,
not with its diameter (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.iterate import Rounds
from skein.plans.scratch import written

MOST_ROUNDS = 60


def min_labels(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, component): for every end of an edge between different ids, the smallest id of its weak component."""
    a, b = F.col(src), F.col(dst)
    stars = written(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    mark = _signature(stars)
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # every edge now goes from a larger to a smaller id
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = written(small, "stars")
        now = _signature(stars)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def weak_components(arcs: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id of each vertex's weak component; vertices without edges are their own."""
    label = min_labels(arcs)
    if vertices is None:
        vertices = arcs.select(F.col("src").alias("id")).unionAll(arcs.select(F.col("dst").alias("id"))).distinct()
    return vertices.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(g) -> DataFrame:
    """(id, component): components numbered from 0 by their smallest id. Direction is ignored."""
    label = written(weak_components(g.edges, g.vertices), "components")
    number = numbered(label.select("component").distinct())
    return label.join(number, "component").select("id", F.col("number").alias("component"))


def numbered(keys: DataFrame) -> DataFrame:
    """Distinct ``component`` keys numbered from 0 in ascending order: ranks within key ranges, plus what the ranges before hold."""
    dealt = written(keys.repartitionByRange("component").withColumn("_p", F.spark_partition_id()), "ranges")
    before, at = {}, 0
    for p, n in sorted((r["_p"], r["count"]) for r in dealt.groupBy("_p").count().collect()):  # one row a partition
        before[p], at = at, at + n
    if not before:
        return dealt.select("component", F.lit(0).cast("long").alias("number"))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_p")]
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("component"))
    return dealt.select("component", (rank - 1 + offset).cast("long").alias("number"))


def num_components(g) -> int:
    return weak_components(g.edges, g.vertices).select("component").distinct().count()


def component_sizes(g) -> DataFrame:
    """(component, size), by the smallest id of each weak component."""
    return weak_components(g.edges, g.vertices).groupBy("component").agg(F.count("*").alias("size"))


def afforest(g, rounds: int = 2) -> DataFrame:
    """(id, component): the smallest id of each weak component. ``rounds`` of neighbour sampling change nothing here: contraction needs none."""
    return weak_components(g.edges, g.vertices)


def strong_components(g, kernel_edges: int = 2_000_000) -> DataFrame:
    """(id, component): the smallest id of each strongly connected component.

    Rounds of colouring: vertices that lack edges in or out are trimmed; every vertex takes the largest id that reaches it,
    and those of one colour that its root reaches backwards are a component. What is left of at most ``kernel_edges``
    edges is finished in one kernel.
    """
    arcs = written(g.edges.filter("src != dst").select("src", "dst").distinct(), "scc-edges")
    left = g.vertices.select("id")
    done = Rounds(left.withColumn("component", F.col("id")), "scc")
    while True:
        arcs, left, gone = _trimmed(arcs, left)
        done.add(gone.select("id", F.col("id").alias("component")))
        n = arcs.count()
        if not n:
            done.add(left.select("id", F.col("id").alias("component")))
            break
        if n <= kernel_edges:
            done.add(_kernel_strong(arcs, left))
            break
        colour = _flood(left.select("id", F.col("id").alias("c")), arcs, F.max, None)
        roots = colour.filter("id = c")
        inner = arcs.join(colour.withColumnsRenamed({"id": "src", "c": "c1"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "c2"}), "dst").filter("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        member = written(_flood(roots, written(inner, "scc-inner"), F.max, roots), "scc-members")
        least = member.groupBy("c").agg(F.min("id").alias("component"))
        done.add(member.join(least, "c").select("id", "component"))
        left = written(left.join(member.select("id"), "id", "left_anti"), "scc-left")
        arcs = written(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
    return done.all()


def _trimmed(arcs: DataFrame, left: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A few rounds of taking out vertices that lack edges in or out."""
    gone = None
    for _ in range(rounds):
        both = arcs.select(F.col("src").alias("id")).distinct().intersect(arcs.select(F.col("dst").alias("id")).distinct())
        out = written(left.join(both, "id", "left_anti"), "scc-trimmed")
        gone = out if gone is None else gone.unionByName(out)
        if out.isEmpty():
            break
        left = written(left.join(both, "id", "left_semi"), "scc-left")
        arcs = written(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
    return arcs, left, gone


def _flood(start: DataFrame, arcs: DataFrame, top, only: DataFrame | None) -> DataFrame:
    """(id, c): colours passed along edges until nothing changes; with ``only``, from those vertices alone."""
    state = written(start.withColumn("fresh", F.lit(True)), "flood")
    while True:
        offers = state.filter("fresh").select(F.col("id").alias("src"), "c").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(top("c").alias("o"))
        joined = state.drop("fresh").join(offers, "id", "full_outer" if only is not None else "left")
        better = F.col("o").isNotNull() & (F.col("c").isNull() | (F.col("o") > F.col("c")))
        state = written(joined.select("id", F.when(better, F.col("o")).otherwise(F.col("c")).alias("c"), F.coalesce(better, F.lit(False)).alias("fresh")), "flood")
        if state.filter("fresh").isEmpty():
            return state.select("id", "c")


def _kernel_strong(arcs: DataFrame, left: DataFrame) -> DataFrame:
    from skein.operators import kernels

    kind = left.schema["id"].dataType.simpleString()

    def run(frame):
        import pandas as pd

        out: dict = {}
        for u, v in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
            out.setdefault(u, []).append((v, 0))
        parts = kernels.strong_components(set(frame["src"]) | set(frame["dst"]), out)
        return pd.DataFrame([(u, p[0]) for p in parts for u in p], columns=["id", "component"])

    found = written(arcs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"id {kind}, component {kind}"), "scc-kernel")
    alone = left.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(alone)


def condensation_order(g) -> DataFrame:
    """(id, component, number): strong components numbered from 0 in topological order of the condensation (sources first)."""
    from skein.graph import Graph
    from skein.operators.traverse import topological_layers

    label = written(strong_components(g), "scc-labels")
    a, b = label.withColumnsRenamed({"id": "src", "component": "a"}), label.withColumnsRenamed({"id": "dst", "component": "b"})
    arcs = g.edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    dag = Graph.from_edges(arcs, label.select(F.col("component").alias("id")).distinct())
    layers = topological_layers(dag).select(F.struct("layer", "id").alias("component"))
    number = numbered(layers).select(F.col("component.id").alias("component"), "number")
    return label.join(number, "component").select("id", "component", "number")


def kosaraju(g) -> DataFrame:
    """(id, component): strong components numbered from 0 in topological order of the condensation."""
    return condensation_order(g).select("id", F.col("number").alias("component"))


def tarjan_scc(g) -> tuple[DataFrame, int]:
    """(id, component), numbered from 0 in reverse topological order (sinks first), and the number of components."""
    order = written(condensation_order(g), "condensation")
    top = order.agg(F.max("number")).first()[0]
    n = 0 if top is None else top + 1
    return order.select("id", (F.lit(n - 1) - F.col("number")).alias("component")), n


def articulation_points(g, **kw) -> DataFrame:
    """(id): vertices whose removal splits their component; direction is ignored, parallel edges count, loops don't."""
    from skein.operators import forests, kernels
    from skein.operators.traverse import by_component

    def ahead(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        off, core = forests.pendants(rows)
        return (None if off is None else off.filter("cut").select(F.col("other").alias("id"))), core

    kind = g.vertices.schema["id"].dataType.simpleString()
    found = by_component(g, lambda ids, out: ((u,) for u in sorted(kernels.low_points(ids, out)[0])), f"id {kind}", _symmetric(g), ahead=ahead, **kw)
    return found.distinct()  # what others hang on may be one in the rest too


def biconnected_components(g, **kw) -> DataFrame:
    """(block, id): blocks as sets of vertices, ``block`` being (smallest id of the component, number within it); a vertex without neighbours is a block."""
    from skein.operators import forests, kernels
    from skein.operators.traverse import by_component, in_kernel

    kind = g.vertices.schema["id"].dataType.simpleString()

    def ahead(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        off, core = forests.pendants(rows)
        if off is None:
            return None, rows
        blocks = in_kernel(core, lambda ids, out: ((b,) for b in kernels.low_points(ids, out)[1]), f"component {kind}, members array<{kind}>", keyed=True)
        pairs = off.select("component", F.array_sort(F.array("id", "other")).alias("members")).distinct()
        number = written(numbered(blocks.unionByName(pairs).select(F.struct("component", "members").alias("component"))).select("component.*", "number"), "blocks")
        first = number.groupBy("component").agg(F.min("number").alias("first"))  # as few as there are large components
        return number.join(F.broadcast(first), "component").select("component", (F.col("number") - F.col("first")).alias("number"), F.explode("members").alias("id")), rows.limit(0)

    rows = by_component(g, lambda ids, out: ((ids[0], k, u) for k, b in enumerate(sorted(kernels.low_points(ids, out)[1])) for u in b), f"component {kind}, number long, id {kind}", _symmetric(g), ahead=ahead, **kw)
    return rows.select(F.struct("component", "number").alias("block"), "id")


def _symmetric(g) -> DataFrame:
    """Each edge from both ends; a pair of opposite edges, as a symmetric graph stores an edge, counts as one."""
    e = g.edges.filter("src != dst")
    if not g.directed:
        return e.select("src", "dst", "eid").unionAll(e.select("dst", "src", "eid"))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    # of parallel edges one way, the n-th pairs with the n-th the other way
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("eid"))
    one = e.withColumn("_n", nth).groupBy(a.alias("a"), b.alias("b"), "_n").agg(F.min("eid").alias("eid"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "eid").unionByName(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "eid"))
