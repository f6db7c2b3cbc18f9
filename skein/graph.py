"""The graph model: a DataFrame of vertices and one of edges.

``vertices`` has ``id`` and any value columns, ``edges`` has ``src``, ``dst``, ``eid``
(which tells parallel edges apart) and any value columns. Graphs are immutable:
every change returns a new one. An undirected graph stores each edge once; its
``arcs`` are the edges in both directions, with a loop counted once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.errors import GraphError, OutOfRange
from skein.plans.scratch import dealt, tasks_for, written

EDGE_KEYS = ("src", "dst", "eid")
#: Targets that a source's pairs are made with at once.
BLOCK = 1_000


def _ordered(df: DataFrame, first: Iterable[str]) -> DataFrame:
    first = [c for c in first if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def _same(column: str, value: Any) -> Column:
    return F.col(column) == F.lit(value)


@dataclass(frozen=True)
class Graph:
    """Vertices, edges and how they are meant.

    ``sequential``: ids are 0 to n - 1 and stay so (removing a vertex renumbers those above it).
    ``value``: one user value for the whole graph. ``boundaries``: first ids of the partitions.
    ``about``: roughly how many edges there are, if known; operators deal large shuffles over more tasks by it.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    sequential: bool = False
    value: Any = None
    boundaries: tuple = ()
    about: int = 0
    _counts: dict[str, int] = field(default_factory=dict, compare=False, repr=False)

    # -- building -----------------------------------------------------------------

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, *, src: str = "src", dst: str = "dst", id: str = "id", n_vertices: int | None = None, keep: str = "all", directed: bool = True, value: Any = None, boundaries: Iterable = (), require_sorted: bool = False, about: int = 0) -> Graph:
        """A graph from an edge table and, where given, a vertex table; columns are mapped by name.

        ``n_vertices``: ids are 0 to that less one, whether an edge names them or not; an edge beyond is an error.
        Without vertices or ``n_vertices``, the ends of edges are the vertices. ``keep``: "all" parallel edges, the "first" or the "last".
        ``require_sorted``: edges out of order of their sources are an error.
        """
        e = edges.withColumnsRenamed({src: "src", dst: "dst"})
        missing = {"src", "dst"} - set(e.columns)
        if missing:
            raise GraphError(f"the edge table lacks {sorted(missing)}")
        kind = e.schema["src"].dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            e = e.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
        elif isinstance(kind, T.DecimalType):  # unsigned 64-bit ids, say
            if e.filter(F.greatest(F.abs("src"), F.abs("dst")) > F.lit(2**63 - 1).cast("decimal(20,0)")).limit(1).count():
                raise OutOfRange("vertex ids must fit a signed 64-bit integer")
            e = e.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
        numbered = "eid" in e.columns
        if not numbered:
            e = e.withColumn("eid", F.monotonically_increasing_id())
        e = _ordered(e, EDGE_KEYS)
        if require_sorted:
            late = e.withColumn("_p", F.spark_partition_id()).withColumn("_b", F.lag("src").over(Window.partitionBy("_p").orderBy("eid"))).filter("_b > src").limit(1).count()
            if late:
                raise GraphError("edges are not sorted by source")
        if not numbered:
            e = written(e, "edges")  # a plan that runs again may number its rows otherwise
        e = deduplicated(e, keep)
        if vertices is not None:
            v = _ordered(vertices.withColumnRenamed(id, "id"), ("id",))
            if isinstance(v.schema["id"].dataType, T.IntegerType):
                v = v.withColumn("id", F.col("id").cast("long"))
        elif n_vertices is not None:
            if e.filter((F.greatest("src", "dst") >= n_vertices) | (F.least("src", "dst") < 0)).limit(1).count():
                raise OutOfRange(f"an edge names a vertex outside 0 to {n_vertices - 1}")
            v = e.sparkSession.range(n_vertices)
        else:
            v = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
        return cls(v, e, directed, n_vertices is not None, value, tuple(boundaries), about)

    @classmethod
    def from_rows(cls, spark: SparkSession, edges: Iterable[tuple], n_vertices: int | None = None, weight: str = "value", **kw) -> Graph:
        """A small graph from (src, dst) or (src, dst, value) tuples; ``eid`` is their order."""
        rows = [tuple(r) for r in edges]
        wide = bool(rows) and len(rows[0]) > 2
        id_type = T.StringType() if rows and isinstance(rows[0][0], str) else T.LongType()
        fields = [T.StructField("src", id_type), T.StructField("dst", id_type)]
        if wide:
            fields.append(T.StructField(weight, T.DoubleType() if any(isinstance(r[2], float) for r in rows) else T.StringType() if isinstance(rows[0][2], str) else T.LongType()))
        fields.append(T.StructField("eid", T.LongType()))
        return cls.from_edges(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], T.StructType(fields)), n_vertices=n_vertices, **kw)

    @classmethod
    def from_adjacency(cls, rows: DataFrame, id: str = "id", neighbours: str = "neighbours", **kw) -> Graph:
        """A graph from one row for each vertex with an array of its targets (or of structs that begin with the target)."""
        element = rows.schema[neighbours].dataType.elementType
        flat = rows.select(F.col(id).alias("src"), F.posexplode(neighbours).alias("_pos", "_to"))
        if isinstance(element, T.StructType):
            first, *others = element.names
            flat = flat.select("src", F.col(f"_to.{first}").alias("dst"), *(F.col(f"_to.{c}").alias(c) for c in others))
        else:
            flat = flat.select("src", F.col("_to").alias("dst"))
        ends = rows.select(F.col(id).alias("id")).unionAll(flat.select(F.col("dst").alias("id"))).distinct()
        return cls.from_edges(flat, ends, **kw)

    # -- shape --------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def arcs(self) -> DataFrame:
        """What an operator that follows edges sees: the edges, in both directions if the graph is undirected."""
        return self.edges if self.directed else both_ways(self.edges)

    def _with(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, **kw) -> Graph:
        return replace(self, vertices=self.vertices if vertices is None else vertices, edges=self.edges if edges is None else edges, _counts={}, **kw)

    def transpose(self) -> Graph:
        """The graph with every edge reversed."""
        return self._with(edges=swapped(self.edges))

    def symmetrize(self) -> Graph:
        """A directed graph with each edge in both directions; loops are not doubled."""
        return self._with(edges=both_ways(self.edges), directed=True)

    def deduplicate(self, keep: str = "first") -> Graph:
        return self._with(edges=deduplicated(self.edges, keep))

    def without_loops(self) -> Graph:
        return self._with(edges=self.edges.filter("src != dst"))

    def filtered(self, vertex: Callable[[str], Column] | None = None, edge: Column | None = None, strict: bool = False) -> Graph:
        """Edges whose target passes ``vertex`` (a predicate on a column that holds ids) and which pass ``edge``.

        Vertices and sources are not tested unless ``strict``, which gives the induced subgraph.
        """
        e, v = self.edges, self.vertices
        if vertex is not None:
            e = e.filter(vertex("dst"))
            if strict:
                e, v = e.filter(vertex("src")), v.filter(vertex("id"))
        return self._with(v, e if edge is None else e.filter(edge))

    def filtered_vertices(self, vertex: Callable[[str], Column]) -> DataFrame:
        return self.vertices.filter(vertex("id"))

    def clear(self) -> Graph:
        return self._with(self.vertices.limit(0), self.edges.limit(0))

    # -- counts and look-ups --------------------------------------------------------

    def num_vertices(self, pid: int | None = None) -> int:
        if pid is not None:
            return self.partition_ids().filter(_same("pid", pid)).count()
        if "v" not in self._counts:
            self._counts["v"] = self.vertices.count()
        return self._counts["v"]

    def num_edges(self, u: Any = None) -> int:
        if u is not None:
            return self.arcs.filter(_same("src", u)).count()
        if "e" not in self._counts:
            self._counts["e"] = self.edges.count()
        return self._counts["e"]

    def has_edges(self) -> bool:
        return not self.edges.isEmpty()

    def contains_vertex(self, u: Any) -> bool:
        return not self.vertices.filter(_same("id", u)).isEmpty()

    def find_vertex(self, u: Any) -> DataFrame:
        return self.vertices.filter(_same("id", u)).limit(1)

    def vertex_value(self, u: Any, column: str = "value") -> Any:
        row = self.find_vertex(u).select(column).first()
        if row is None:
            raise OutOfRange(f"no vertex {u}")
        return row[0]

    def out_edges(self, u: Any) -> DataFrame:
        return self.arcs.filter(_same("src", u))

    def in_edges(self, u: Any) -> DataFrame:
        return self.arcs.filter(_same("dst", u))

    def find_out_edge(self, u: Any, v: Any) -> DataFrame:
        """The first edge from u to v, or no row."""
        return self.arcs.filter(_same("src", u) & _same("dst", v)).orderBy("eid").limit(1)

    def find_in_edge(self, u: Any, v: Any) -> DataFrame:
        """The first edge into u from v, or no row."""
        return self.find_out_edge(v, u)

    def contains_out_edge(self, u: Any, v: Any) -> bool:
        return not self.arcs.filter(_same("src", u) & _same("dst", v)).isEmpty()

    def contains_in_edge(self, u: Any, v: Any) -> bool:
        return self.contains_out_edge(v, u)

    def contains_edges(self, probes: DataFrame) -> DataFrame:
        """``src``, ``dst`` of each probe and whether there is such an edge: one join for all of them."""
        have = self.arcs.select("src", "dst").distinct().withColumn("_found", F.lit(True))
        return probes.select("src", "dst").join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("_found", F.lit(False)).alias("found"))

    def find_edges(self, probes: DataFrame) -> DataFrame:
        """The first edge of each probed pair, where there is one."""
        return _first_of_pairs(self.arcs.join(probes.select("src", "dst"), ["src", "dst"], "left_semi"))

    def contains_edges_alike(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """``contains_edges`` of every pair of a source and a target, tables of (id, k), whose k is the same; an id has one k.

        Pairs are made last, in place, from targets in blocks: neither they nor a table of them are shuffled.
        """
        s, t = sources.select("id", "k").distinct(), targets.select("id", "k").distinct()
        for ends in (s, t):
            twice = ends.groupBy("id").count().filter("count > 1").limit(1).collect()
            if twice:
                raise GraphError(f"vertex {twice[0]['id']} has more than one k")
        most, total = t.groupBy("k").agg(F.count("*").alias("t")).join(s.groupBy("k").agg(F.count("*").alias("s")), "k").agg(F.max("t"), F.sum(F.col("t") * F.col("s"))).first()
        blocks = max(1, -(-(most or 0) // BLOCK))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
        have = self._alike(s, t).groupBy(F.col("src").alias("id"), block("dst")).agg(F.collect_set("dst").alias("have"))
        spots = s.select("id", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        spots = spots.join(have, ["id", "block"], "left").withColumnRenamed("id", "src")
        n = tasks_for(self.spark, (total or 0) // 10)
        both = spots.repartition(n, "k", "block").join(t.select(F.col("id").alias("dst"), "k", block("id")).repartition(n, "k", "block"), ["k", "block"])
        return both.select("src", "dst", F.coalesce(F.array_contains("have", F.col("dst")), F.lit(False)).alias("found"))

    def find_edges_alike(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """``find_edges`` of every pair of a source and a target, tables of (id, k), whose k is the same; the pairs are not made."""
        return _first_of_pairs(self._alike(sources.select("id", "k").distinct(), targets.select("id", "k").distinct()))

    def _alike(self, s: DataFrame, t: DataFrame) -> DataFrame:
        keyed = dealt(self.arcs, self.about, "src").join(dealt(s.withColumnRenamed("id", "src"), self.about, "src"), "src")
        return dealt(keyed, self.about, "dst", "k").join(dealt(t.withColumnRenamed("id", "dst"), self.about, "dst", "k"), ["dst", "k"], "left_semi").select(*self.arcs.columns)

    def out_degrees(self) -> DataFrame:
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        found = self.arcs.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def sources(self) -> DataFrame:
        """Edges with the values of their source vertices."""
        return self._ends("src")

    def targets(self) -> DataFrame:
        """Edges with the values of their target vertices."""
        return self._ends("dst")

    def _ends(self, end: str) -> DataFrame:
        values = self.vertices.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in self.vertices.columns if c != "id"))
        return self.arcs.join(values, end)

    # -- partitions: contiguous ranges of ids ----------------------------------------

    def partition_ids(self) -> DataFrame:
        """(id, pid): the last boundary at or below each id; one partition 0 without boundaries."""
        bounds = sorted(self.boundaries)
        if not bounds:
            return self.vertices.select("id", F.lit(0).alias("pid"))
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))) - 1
        return self.vertices.select("id", F.greatest(at, F.lit(0)).alias("pid"))

    def num_partitions(self) -> int:
        return max(1, len(self.boundaries))

    def capabilities(self) -> dict[str, bool]:
        """What operators may expect of the graph."""
        columns = set(self.vertices.columns) | set(self.edges.columns)
        return {"directed": self.directed, "sequential": self.sequential, "partitioned": bool(self.boundaries), "weighted": bool(set(self.edges.columns) - set(EDGE_KEYS)), "labelled": "name" in columns, "valued": self.value is not None}

    def vertices_of_partition(self, pid: int) -> DataFrame:
        return self.vertices.join(self.partition_ids().filter(_same("pid", pid)).select("id"), "id", "left_semi")

    # -- vertex properties: side tables ------------------------------------------------

    def with_property(self, table: DataFrame, name: str, default: Any = None) -> Graph:
        """The graph with a vertex column from a side table of (id, name); ``default`` where it has no row."""
        joined = self.vertices.drop(name).join(table.select("id", name), "id", "left")
        return self._with(joined if default is None else joined.withColumn(name, F.coalesce(name, F.lit(default))))

    def contains_property(self, name: str) -> bool:
        return name in self.vertices.columns and name != "id"

    def property_of(self, u: Any, name: str, default: Any = None) -> Any:
        """A vertex's value of a property, or ``default`` where it has none."""
        row = self.find_vertex(u).select(name).first() if self.contains_property(name) else None
        return default if row is None or row[0] is None else row[0]

    # -- changes ---------------------------------------------------------------------

    def add_vertex(self, u: Any = None, **values: Any) -> tuple[Graph, Any]:
        """The graph with one more vertex, and its id (sequential graphs) or whether it is new (an old one's values are replaced)."""
        if u is None:
            if not self.sequential:
                raise GraphError("a vertex needs an id unless the graph's ids are sequential")
            u, told = self.num_vertices(), None
        else:
            told = not self.contains_vertex(u)
        row = self.spark.range(1).select(F.lit(u).cast(self.vertices.schema["id"].dataType).alias("id"), *(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.vertices.schema.fields if f.name != "id"))
        graph = self._with(self.vertices.filter(~_same("id", u)).unionByName(row))
        return graph, u if told is None else told

    def add_vertices(self, rows: DataFrame) -> Graph:
        """Vertices added or their values replaced."""
        return self._with(self.vertices.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def resize(self, n: int) -> Graph:
        """A sequential graph of ``n`` vertices: isolated ones are added, or those from ``n`` on go with their edges."""
        old = self.num_vertices()
        if n < old:
            return self._with(self.vertices.filter(F.col("id") < n), self.edges.filter((F.col("src") < n) & (F.col("dst") < n)))
        return self._with(self.vertices.unionByName(self.spark.range(old, n), allowMissingColumns=True))

    def add_edge(self, u: Any, v: Any, **values: Any) -> Graph:
        """The graph with one more edge; both ends must be there."""
        known = {r[0] for r in self.vertices.filter(F.col("id").isin(u, v)).select("id").collect()}  # at most two ids
        if not {u, v} <= known:
            raise OutOfRange(f"no vertex {u if u not in known else v}")
        top = self.edges.agg(F.max("eid")).first()[0]
        given = {"src": u, "dst": v, "eid": 0 if top is None else top + 1, **values}
        row = self.spark.range(1).select(*(F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in self.edges.schema.fields))
        return self._with(edges=self.edges.unionByName(row))

    def load_edges(self, rows: DataFrame, keep: str = "all") -> Graph:
        """Edges appended, and with them vertices that are not there yet."""
        top = self.edges.agg(F.max("eid")).first()[0]
        if "eid" not in rows.columns:
            rows = written(rows.withColumn("eid", F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)), "edges")
        edges = deduplicated(self.edges.unionByName(rows, allowMissingColumns=True), keep)
        ends = rows.select(F.col("src").alias("id")).unionAll(rows.select(F.col("dst").alias("id"))).distinct()
        new = ends.join(self.vertices.select("id"), "id", "left_anti")
        return self._with(self.vertices.unionByName(new, allowMissingColumns=True), edges)

    def load_vertices(self, rows: DataFrame) -> Graph:
        """Vertex values set from a table of (id, values); ids without a row keep nulls."""
        return self._with(self.vertices.select("id").join(rows, "id", "left"))

    def remove_edge(self, u: Any, v: Any) -> tuple[Graph, int]:
        """The graph without all edges from u to v (either way if undirected), and how many there were."""
        hit = _same("src", u) & _same("dst", v)
        if not self.directed:
            hit = hit | (_same("src", v) & _same("dst", u))
        return self._with(edges=self.edges.filter(~hit)), self.edges.filter(hit).count()

    def remove_vertex(self, u: Any) -> Graph:
        """The graph without a vertex and its edges; sequential graphs renumber the ids above it."""
        if not self.contains_vertex(u):
            raise OutOfRange(f"no vertex {u}")
        v = self.vertices.filter(~_same("id", u))
        e = self.edges.filter(~(_same("src", u) | _same("dst", u)))
        if self.sequential:
            down = lambda c: F.when(F.col(c) > u, F.col(c) - 1).otherwise(F.col(c))
            v, e = v.withColumn("id", down("id")), e.withColumns({"src": down("src"), "dst": down("dst")})
        return self._with(v, e)


def _first_of_pairs(arcs: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("eid"))
    return arcs.withColumn("_n", first).filter("_n = 1").drop("_n")


def swapped(edges: DataFrame) -> DataFrame:
    """Edges with their ends exchanged."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and, but for loops, their reverses."""
    return edges.unionByName(swapped(edges.filter("src != dst")))


def deduplicated(edges: DataFrame, keep: str) -> DataFrame:
    """Parallel edges all kept, or the first or last of each pair of ends."""
    if keep == "all":
        return edges
    if keep not in ("first", "last"):
        raise ValueError(f"keep is 'all', 'first' or 'last', not {keep!r}")
    order = F.col("eid").asc() if keep == "first" else F.col("eid").desc()
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(order))).filter("_n = 1").drop("_n")


def undirected(edges: DataFrame, **kw) -> Graph:
    """A graph whose edges run both ways."""
    return Graph.from_edges(edges, directed=False, **kw)


def matrix(edges: DataFrame, n_vertices: int, directed: bool = True, **kw) -> Graph:
    """A graph of a fixed number of vertices with at most one edge for each pair: the last one given."""
    if not directed:
        edges = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return Graph.from_edges(edges, n_vertices=n_vertices, keep="last", directed=directed, **kw)
