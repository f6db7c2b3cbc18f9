"""Traversals: breadth-first and depth-first search, shortest paths, topological order.

Breadth-first search and shortest paths run as rounds of join and aggregate over
the frontier; unreached vertices have nulls. Depth-first results depend on the
order of visits and run as a kernel on each group of connected edges.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.errors import CycleError, GraphError, OutOfRange
from skein.graph import Graph
from skein.operators import forests, kernels
from skein.operators.components import weak_components
from skein.plans.iterate import Rounds
from skein.plans.scratch import written

#: Edges of one component that a sequential kernel takes.
MOST_KERNEL_EDGES = 20_000_000
#: Edges and vertices of a component from which on a kernel is the last resort.
LARGE = 200_000


def source_rows(g: Graph, sources: Any) -> DataFrame:
    """The start vertices as rows; one that is not in the graph is an error."""
    if isinstance(sources, DataFrame):
        wanted = sources.select("id").distinct()
    else:
        ids = list(dict.fromkeys(sources if isinstance(sources, (list, tuple, set, range)) else [sources]))
        wanted = g.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("id", g.vertices.schema["id"].dataType)]))
    lost = wanted.join(g.vertices, "id", "left_anti").limit(1).collect()
    if lost:
        raise OutOfRange(f"no vertex {lost[0][0]}")
    return wanted


def bfs(g: Graph, sources: Any, reverse: bool = False, max_depth: int | None = None, prune: Callable[[str], Column] | None = None) -> DataFrame:
    """(id, depth, parent) of the vertices reached, by as few edges as can be; of several parents the smallest.

    ``reverse`` follows edges backwards; ``prune`` is a predicate on ids whose vertices are reached but not left.
    """
    # written once: every round reads it
    arcs = written((g.transpose() if reverse else g).arcs.filter("src != dst").select("src", "dst"), "bfs-arcs")
    start = source_rows(g, sources).select("id", F.lit(0).alias("depth"), F.lit(None).cast(g.vertices.schema["id"].dataType).alias("parent"))
    rounds = Rounds(start, "bfs")
    frontier = rounds.add(start)
    while max_depth is None or rounds.n <= max_depth:
        leaving = frontier if prune is None else frontier.filter(~prune("id"))
        met = leaving.select(F.col("id").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = rounds.add(met.join(rounds.all().select("id"), "id", "left_anti").select("id", F.lit(rounds.n).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
    return rounds.all()


def bfs_edges(g: Graph, sources: Any, **kw) -> DataFrame:
    """(src, dst, depth): the edges by which breadth-first search first reaches vertices."""
    return bfs(g, sources, **kw).filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), "depth")


def bfs_events(g: Graph, sources: Any) -> DataFrame:
    """(seq, event, id, eid): what breadth-first search fires, level by level, vertices ascending within a level.

    ``initialize_vertex`` fires for sources only, and edges are only examined.
    """
    levels = bfs(g, sources).select("id", "depth")
    base = levels.select("id", "depth")
    fired = [base.filter("depth = 0").select(F.lit(-1).alias("at"), F.lit(0).alias("step"), "id", F.lit(None).cast("long").alias("eid"), F.lit("initialize_vertex").alias("event"))]
    fired.append(base.select((F.col("depth") - 1).alias("at"), F.lit(1).alias("step"), "id", F.lit(None).cast("long").alias("eid"), F.lit("discover_vertex").alias("event")))
    for step, name in ((2, "examine_vertex"), (4, "finish_vertex")):
        fired.append(base.select(F.col("depth").alias("at"), F.lit(step).alias("step"), "id", F.lit(None).cast("long").alias("eid"), F.lit(name).alias("event")))
    fired.append(g.arcs.select(F.col("src").alias("id"), "eid").join(base, "id").select(F.col("depth").alias("at"), F.lit(3).alias("step"), "id", "eid", F.lit("examine_edge").alias("event")))
    out = fired[0]
    for x in fired[1:]:
        out = out.unionByName(x)
    return out.select(F.struct("at", "step", "id", "eid").alias("seq"), "event", "id", "eid")


def shortest_paths(g: Graph, sources: Any, weight: Column | str | None = None, combine: Callable[[Column, Column], Column] = operator.add, minimize: bool = True, zero: Any = 0, infinity: Any = None, most_rounds: int | None = None, _negative: bool = False) -> DataFrame:
    """(id, distance, predecessor) of every vertex: unreached ones have a null distance (or ``infinity``) and are their own predecessors.

    ``weight`` defaults to 1; ``combine`` extends a distance by a weight; ``minimize`` false prefers larger distances.
    A null weight never relaxes. Negative weights are an error.
    """
    state = _relaxed(g, sources, weight, combine, minimize, zero, most_rounds, _negative)[0]
    out = g.vertices.select("id").join(state.select("id", "distance", "predecessor"), "id", "left")
    far = F.col("distance") if infinity is None else F.coalesce("distance", F.lit(infinity))
    return out.select("id", far.alias("distance"), F.coalesce("predecessor", "id").alias("predecessor"))


def _weighted(g: Graph, weight: Column | str | None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    arcs = g.arcs.select("src", "dst", w.alias("w")).filter(F.col("w").isNotNull())
    if arcs.schema["w"].dataType.typeName() in ("double", "float"):  # an infinite weight never relaxes
        arcs = arcs.filter(F.col("w") < float("inf"))
    return arcs


def _relaxed(g: Graph, sources: Any, weight, combine, minimize: bool, zero: Any, most_rounds: int | None, negative: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """Distances after the last round, what it improved (None if nothing), and the rounds taken."""
    arcs = written(_weighted(g, weight), "path-arcs")  # every round reads it
    if not negative and not arcs.filter("w < 0").limit(1).isEmpty():
        raise OutOfRange("negative weights: use bellman_ford")
    start = source_rows(g, sources)
    kind = arcs.select(combine(F.lit(zero), F.col("w")).alias("d")).schema["d"].dataType
    state = start.select("id", F.lit(zero).cast(kind).alias("distance"), F.col("id").alias("predecessor"), F.lit(True).alias("fresh"))
    rounds = Rounds(state, "paths")
    state = rounds.add(state)
    # of equal distances the smaller predecessor
    first = F.struct("d", "src") if minimize else F.struct((-F.col("d")).alias("d"), "src")
    key = lambda c: F.col(c)
    top = F.min if minimize else F.max
    n = most_rounds if most_rounds is not None else None
    k = 0
    while n is None or k < n:
        k += 1
        step = state.filter("fresh").select(F.col("id").alias("src"), "distance").join(arcs, "src")
        offers = step.select(F.col("dst").alias("id"), combine(F.col("distance"), F.col("w")).cast(kind).alias("d"), "src").groupBy("id").agg(top("d").alias("d"), F.min_by("src", first).alias("p"))
        both = state.drop("fresh").join(offers, "id", "full_outer")
        better = F.col("d").isNotNull() & (F.col("distance").isNull() | ((F.col("d") < F.col("distance")) if minimize else (F.col("d") > F.col("distance"))))
        new = rounds.add(both.select("id", F.when(better, key("d")).otherwise(key("distance")).alias("distance"), F.when(better, key("p")).otherwise(key("predecessor")).alias("predecessor"), F.coalesce(better, F.lit(False)).alias("fresh")))
        rounds.forget(rounds.n - 2)
        state = new
        fresh = state.filter("fresh")
        if fresh.isEmpty():
            return state, None, k
        if negative and k & (k - 1) == 0 and _on_cycle(state) is not None:
            return state, fresh, k
    return state, fresh, k


def _on_cycle(state: DataFrame, root: Column | None = None) -> Any | None:
    """A vertex on a cycle of predecessors, or None: vertices jump along them, twice as far each time, and leave once they are known to end at a root.

    A source that nothing improved (``root``) is its own predecessor and hangs on no cycle; a loop does. What has jumped as
    often as there are vertices has come to a cycle; without one, the jumps end with the longest path.
    """
    if root is None:
        root = (F.col("id") == F.col("predecessor")) & (F.col("distance") == 0)
    hop = written(state.select("id", F.col("predecessor").alias("to"), F.coalesce(root, F.lit(False)).alias("root")).filter("not root").select("id", "to"), "hops")
    n, gone = hop.count(), 1
    while gone < n:
        # one that left ends at a root, and so does what points at it
        hop = written(hop.join(hop.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")), "hops")
        gone *= 2
        if hop.isEmpty():
            return None
    return hop.join(hop.select(F.col("id").alias("to")), "to", "left_semi").agg(F.min("to")).first()[0]


def init_shortest_paths(g: Graph) -> DataFrame:
    """(id, distance, predecessor) before anything is reached: null, and each vertex itself."""
    return g.vertices.select("id", F.lit(None).cast("double").alias("distance"), F.col("id").alias("predecessor"))


def relaxed_edges(g: Graph, paths: DataFrame, weight: Column | str | None = None) -> DataFrame:
    """(eid, event) of the edges out of reached vertices once distances have settled.

    ``edge_relaxed`` for the edge of each vertex's predecessor (the first of equal ones), ``edge_not_relaxed`` for the others,
    ``edge_not_minimized`` for one that would still shorten a path, as the edges of a negative cycle do.
    """
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    near = paths.select(F.col("id").alias("src"), F.col("distance").alias("a")).filter("a is not null")
    far = paths.select(F.col("id").alias("dst"), F.col("distance").alias("b"), "predecessor")
    rows = g.arcs.select("src", "dst", "eid", w.alias("w")).join(near, "src").join(far, "dst")
    tight = (F.col("predecessor") == F.col("src")) & (F.col("src") != F.col("dst")) & (F.col("a") + F.col("w") == F.col("b"))
    first = F.min(F.when(tight, F.col("eid"))).over(Window.partitionBy("src", "dst"))
    event = F.when(F.col("a") + F.col("w") < F.col("b"), "edge_not_minimized").when(tight & (F.col("eid") == first), "edge_relaxed").otherwise("edge_not_relaxed")
    return rows.select("eid", event.alias("event"))


def dijkstra(g: Graph, sources: Any, weight: Column | str | None = None, **kw) -> DataFrame:
    """Shortest paths over weights that are not negative."""
    return shortest_paths(g, sources, weight, **kw)


def dijkstra_distances(g: Graph, sources: Any, weight: Column | str | None = None, **kw) -> DataFrame:
    return shortest_paths(g, sources, weight, **kw).drop("predecessor")


def dijkstra_events(g: Graph, sources: Any, weight: Column | str | None = None, events: Iterable[str] | None = None) -> DataFrame:
    """(seq, event, id, eid): what a visit in order of distance (vertices of equal distance by id, edges by eid) fires; ``events`` names those wanted.

    All is told by the final distances: an edge relaxes if it offers less than every edge into its target that was
    examined before, and what first relaxes discovers. Weights are above zero, so that a vertex comes after those before
    it on its path; others are an error. Edges of null or infinite weight are examined and not relaxed.
    """
    from skein.functions.visitors import check_events

    wanted = check_events(events)
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    arcs = written(g.arcs.select("src", "dst", "eid", w.cast("double").alias("w")), "event-arcs")
    if not arcs.filter("w <= 0").limit(1).isEmpty():
        raise OutOfRange("events in order of distance need weights above zero")
    near = written(dijkstra_distances(g, sources, weight).filter("distance is not null"), "event-distances")
    start = source_rows(g, sources).select("id")
    nothing, kind = F.lit(None).cast("long"), F.col("distance").cast("double")

    def rows(df: DataFrame, at: Column, step: int, sub: int, name: str, of: str = "id", eid: Column = nothing, seq_id: str = "id") -> DataFrame:
        seq = F.struct(at.alias("at"), F.col(seq_id).alias("id"), F.lit(step).alias("step"), eid.alias("eid"), F.lit(sub).alias("sub"))
        return df.select(seq.alias("seq"), F.lit(name).alias("event"), F.col(of).alias("id"), eid.alias("eid"))

    met = arcs.join(near.select(F.col("id").alias("src"), kind.alias("a")), "src")
    before = Window.partitionBy("dst").orderBy("a", "src", "eid").rowsBetween(Window.unboundedPreceding, -1)
    offer = F.when(F.col("w").isNull() | (F.col("w") == float("inf")), None).otherwise(F.col("a") + F.col("w"))
    met = met.withColumn("offer", offer).withColumn("least", F.min("offer").over(before))
    met = met.join(start.select(F.col("id").alias("dst"), F.lit(True).alias("source")), "dst", "left")
    relaxed = F.col("offer").isNotNull() & F.col("source").isNull() & (F.col("least").isNull() | (F.col("offer") < F.col("least")))
    met = written(met.withColumn("relaxed", relaxed), "event-edges")
    at, eid = F.col("a"), F.col("eid")
    fired = [
        rows(g.vertices, F.lit(-2.0), 0, 0, "initialize_vertex"),
        rows(start, F.lit(-1.0), 1, 0, "discover_vertex"),
        rows(near, kind, 1, 0, "examine_vertex"),
        rows(met, at, 2, 0, "examine_edge", "src", eid, "src"),
        rows(met.filter("relaxed"), at, 2, 1, "edge_relaxed", "src", eid, "src"),
        rows(met.filter("not relaxed"), at, 2, 1, "edge_not_relaxed", "src", eid, "src"),
        rows(met.filter("relaxed and least is null"), at, 2, 2, "discover_vertex", "dst", eid, "src"),
        rows(near, kind, 3, 0, "finish_vertex"),
    ]
    out = fired[0]
    for more in fired[1:]:
        out = out.unionByName(more)
    return out if wanted is None else out.filter(F.col("event").isin(*wanted))


def bellman_ford(g: Graph, sources: Any, weight: Column | str | None = None) -> tuple[DataFrame, Any | None]:
    """Shortest paths over any weights, and a vertex that lies on a negative cycle that the sources reach (None without one)."""
    state, fresh, _ = _relaxed(g, sources, weight, operator.add, True, 0, g.num_vertices() + 1, True)
    cycle = None if fresh is None else _on_cycle(state)
    out = g.vertices.select("id").join(state.select("id", "distance", "predecessor"), "id", "left")
    return out.select("id", "distance", F.coalesce("predecessor", "id").alias("predecessor")), cycle


def negative_cycle(paths: DataFrame, vertex: Any) -> list:
    """The cycle of predecessors through a vertex, from it on along the edges; empty if the vertex is None."""
    if vertex is None:
        return []
    walk, at = [vertex], vertex
    pointers = written(paths.select("id", "predecessor"), "pointers")
    while True:  # as many look-ups as the cycle is long
        row = pointers.filter(F.col("id") == F.lit(at)).first()
        if row is None or row["predecessor"] == at and at != vertex:
            raise GraphError(f"vertex {vertex} lies on no cycle of predecessors")
        at = row["predecessor"]
        if at == vertex:
            return [vertex, *reversed(walk[1:])]
        if at in walk:
            raise GraphError(f"vertex {vertex} lies on no cycle of predecessors")
        walk.append(at)


# -- depth first ---------------------------------------------------------------------


def by_component(g: Graph, kernel: Callable[[list, kernels.Adjacency], Iterable[tuple]], schema: str, arcs: DataFrame | None = None, most_edges: int = MOST_KERNEL_EDGES, vertices: DataFrame | None = None, ahead: Callable[[DataFrame], tuple[DataFrame | None, DataFrame]] | None = None) -> DataFrame:
    """``kernel(vertices, adjacency)`` applied to each weakly connected component; it gives rows of ``schema``.

    ``ahead`` takes the rows of components above LARGE rows and gives rows of ``schema`` and the rows that are left to the kernel.
    A component of more than ``most_edges`` edges is an error: a sequential visit holds it in one task.
    """
    arcs = (g.arcs if arcs is None else arcs).select("src", "dst", "eid")
    vertices = (g.vertices if vertices is None else vertices).select("id")
    label = weak_components(arcs, vertices)
    rows = arcs.join(label.withColumnRenamed("id", "src"), "src").unionByName(vertices.join(label, "id").select(F.col("id").alias("src"), F.lit(None).cast(arcs.schema["dst"].dataType).alias("dst"), F.lit(None).cast("long").alias("eid"), "component"))
    rows = written(rows, "component-edges")
    done = None
    if ahead is not None:
        large = written(rows.groupBy("component").count().filter(F.col("count") > LARGE).select("component"), "large")  # few: each has many rows
        if not large.isEmpty():
            done, left = ahead(written(rows.join(F.broadcast(large), "component", "left_semi").select(*rows.columns), "large-edges"))
            rows = rows.join(F.broadcast(large), "component", "left_anti").select(*rows.columns).unionByName(left.select(*rows.columns))
    found = in_kernel(rows, kernel, schema, most_edges)
    return found if done is None else found.unionByName(done.select(*(F.col(f.name).cast(f.dataType) for f in found.schema)))


def in_kernel(rows: DataFrame, kernel: Callable[[list, kernels.Adjacency], Iterable[tuple]], schema: str, most_edges: int = MOST_KERNEL_EDGES, keyed: bool = False) -> DataFrame:
    """A kernel's rows over each ``component`` of (src, dst, eid, component), after its key if ``keyed``; vertices are rows without ``eid``."""
    large = rows.groupBy("component").count().filter(F.col("count") > most_edges).limit(1).collect()
    if large:
        raise GraphError(f"component {large[0][0]} has more than {most_edges} edges and vertices; a sequential visit holds it in one task")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ends = frame[frame["eid"].notna()].astype({"eid": "int64"}).sort_values(["src", "eid", "dst"])
        ids = sorted(frame.loc[frame["eid"].isna(), "src"])
        if ends["dst"].dtype == float:
            ends["dst"] = ends["dst"].astype("int64")
        out: kernels.Adjacency = {}
        for u, v, e in zip(ends["src"].tolist(), ends["dst"].tolist(), ends["eid"].tolist(), strict=True):
            out.setdefault(u, []).append((v, e))
        found = kernel(ids, out)
        return pd.DataFrame([(key[0], *row) for row in found] if keyed else list(found), columns=names)

    names = T.StructType.fromDDL(schema).names
    return rows.groupBy("component").applyInPandas(run, schema)


def _trees_ahead(root: Any, *columns: Column | str) -> Callable[[DataFrame], tuple[DataFrame | None, DataFrame]]:
    """Large components that are trees, visited without the kernel."""

    def ahead(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        seen, left = forests.visited(rows, root)
        return (None if seen is None else seen.select(*columns).filter(F.col(seen.select(*columns).columns[0]).isNotNull())), left

    return ahead


def _id_type(g: Graph) -> str:
    return g.vertices.schema["id"].dataType.simpleString()


def _reach(g: Graph, source: Any) -> tuple[DataFrame, DataFrame]:
    """The vertices that a source reaches, and the edges out of them."""
    seen = bfs(g, source).select("id")
    return seen, g.arcs.join(seen.withColumnRenamed("id", "src"), "src", "left_semi")


def dfs(g: Graph, source: Any = None, reverse: bool = False) -> DataFrame:
    """(id, parent, discover, finish, depth) of a depth-first visit from a source, or of each component from its vertices in ascending order.

    Times count within a component. ``reverse``, here and below, follows edges against their direction.
    """
    g = g.transpose() if reverse else g
    kind = _id_type(g)
    rows = lambda ids, out: ((r["id"], r["parent"], r["discover"], r["finish"], r["depth"]) for r in kernels.depth_first(ids, out, [source] if source is not None else ids)[0])
    finish = (F.col("discover") + 2 * F.col("size") - 1).alias("finish")
    return _visited(g, source, rows, f"id {kind}, parent {kind}, discover long, finish long, depth long", _trees_ahead(source, "id", "parent", "discover", finish, "depth"))


def _visited(g: Graph, source: Any, kernel, schema: str, ahead=None) -> DataFrame:
    if source is None:
        return by_component(g, kernel, schema, ahead=ahead)
    source_rows(g, source)
    vertices, arcs = _reach(g, source)
    return by_component(g, kernel, schema, arcs, vertices=vertices, ahead=ahead)


def dfs_edges(g: Graph, source: Any = None, reverse: bool = False) -> DataFrame:
    """(eid, class): how a depth-first visit meets each edge: tree, back or forward_or_cross."""
    g = g.transpose() if reverse else g
    return _visited(g, source, lambda ids, out: kernels.depth_first(ids, out, [source] if source is not None else ids)[1], "eid long, class string", _trees_ahead(source, "eid", F.lit("tree").alias("class")))


def dfs_events(g: Graph, source: Any, events: Iterable[str] | None = None, reverse: bool = False) -> DataFrame:
    """(seq, event, id, vertex, eid): what a depth-first visit fires, in order; ``events`` names those wanted. ``vertex`` is the id in its own type, ``id`` its text."""
    from skein.functions.visitors import check_events

    wanted = check_events(events)
    g = g.transpose() if reverse else g
    rows = lambda ids, out: ((k, e, str(u), u, x) for k, (e, u, x) in enumerate(kernels.depth_first(ids, out, [source])[2]) if wanted is None or e in wanted)
    return _visited(g, source, rows, f"seq long, event string, id string, vertex {_id_type(g)}, eid long")


def topological_sort(g: Graph, sources: Any = None, safe: bool = True, reverse: bool = False) -> DataFrame:
    """(component, position, id): a topological order of each component (of what the sources reach, if given): reverse order of finishing.

    ``safe``: a cycle, a loop too, raises CycleError; else the order is that of the visit.
    """
    g = g.transpose() if reverse else g
    kind = _id_type(g)
    wanted = None if sources is None else list(sources) if isinstance(sources, (list, tuple, set, range)) else [sources]

    def kernel(ids: list, out: kernels.Adjacency):
        known = set(ids)
        order, cycle = kernels.topological(ids, out, ids if wanted is None else [s for s in wanted if s in known])
        return ((ids[0], k, u, cycle) for k, u in enumerate(order))

    schema = f"component {kind}, position long, id {kind}, cycle {kind}"
    placed = ("component", "position", "id", F.lit(None).cast(kind).alias("cycle"))
    if wanted is None:
        rows = by_component(g, kernel, schema, ahead=_trees_ahead(None, *placed))
    else:
        vertices, arcs = _reach(g, wanted)
        rows = by_component(g, kernel, schema, arcs, vertices=vertices, ahead=_trees_ahead(wanted[0], *placed) if len(wanted) == 1 else None)
    if safe:
        rows = written(rows, "topological")
        hit = rows.filter("cycle is not null").limit(1).collect()
        if hit:
            raise CycleError(hit[0]["cycle"])
    return rows.drop("cycle")


def topological_layers(g: Graph) -> DataFrame:
    """(id, layer): the most edges on a path that ends at each vertex; ordering by layer and id is a topological order. Distributed: a round a layer.

    A cycle raises CycleError.
    """
    arcs = written(g.edges.select("src", "dst"), "dag-edges")
    degree = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    state = g.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need"))
    layers = Rounds(g.vertices.select("id").withColumn("layer", F.lit(0)), "layers")
    left = Rounds(state, "waiting")
    waiting = left.add(state)
    while True:
        free = layers.add(waiting.filter("need = 0").select("id", F.lit(layers.n).alias("layer")))
        if free.isEmpty():
            break
        met = free.select(F.col("id").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        waiting = left.add(waiting.filter("need > 0").join(met, "id", "left").select("id", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
        left.forget(left.n - 2)
    stuck = waiting.select("id").limit(1).collect()
    if stuck:
        raise CycleError(_vertex_on_cycle(arcs, waiting.select("id")))
    return layers.all()


def _vertex_on_cycle(arcs: DataFrame, stuck: DataFrame) -> Any:
    """Every stuck vertex has a stuck predecessor: following those ends on a cycle."""
    inner = arcs.join(stuck.withColumnRenamed("id", "src"), "src", "left_semi").join(stuck.withColumnRenamed("id", "dst"), "dst", "left_semi")
    back = inner.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor"))
    loop = back.filter("id = predecessor").agg(F.min("id")).first()[0]
    return loop if loop is not None else _on_cycle(back, F.lit(False))


def topological_edges(g: Graph) -> DataFrame:
    """Edges with the layer of their source: ordering by layer, src and eid gives the out-edges of vertices in topological order."""
    return g.edges.join(topological_layers(g).withColumnRenamed("id", "src"), "src")


def is_acyclic(g: Graph) -> bool:
    try:
        topological_layers(g)
    except CycleError:
        return False
    return True
