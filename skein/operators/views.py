"""Views: scans, projections and filters of a graph, and their forms for ``DataFrame.transform``-like chaining.

``value`` arguments take a Column (or its SQL text) that is computed for each row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.graph import Graph


def _valued(df: DataFrame, columns: list[str], value: Column | str | None) -> DataFrame:
    if value is None:
        return df.select(*columns)
    return df.select(*columns, (F.expr(value) if isinstance(value, str) else value).alias("value"))


def vertexlist(g: Graph, value: Column | str | None = None, first: Any = None, last: Any = None, subset: DataFrame | None = None, basic: bool = False) -> DataFrame:
    """Vertices (ids only if ``basic``), of all, of ids from ``first`` to before ``last``, or of a subset with a column ``id``."""
    v = g.vertices
    if first is not None:
        v = v.filter(F.col("id") >= F.lit(first))
    if last is not None:
        v = v.filter(F.col("id") < F.lit(last))
    if subset is not None:
        v = v.join(subset.select("id").distinct(), "id", "left_semi")
    return _valued(v, ["id"] if basic or value is not None else v.columns, value)


def edgelist(g: Graph, value: Column | str | None = None, basic: bool = False) -> DataFrame:
    """All edges; an undirected graph's edges come once from each end."""
    e = g.arcs
    return _valued(e, ["src", "dst"] if basic else ["src", "dst", "eid"] if value is not None else e.columns, value)


def edgelist_of(edges: DataFrame, src: str = "src", dst: str = "dst", value: Column | str | None = None) -> DataFrame:
    """An edge table that is no graph's, as a list of edges."""
    e = edges.withColumnsRenamed({src: "src", dst: "dst"})
    return _valued(e, ["src", "dst"] if value is not None else e.columns, value)


def incidence(g: Graph, u: Any, value: Column | str | None = None, basic: bool = False) -> DataFrame:
    """Edges out of a vertex."""
    e = g.out_edges(u)
    return _valued(e, ["dst"] if basic else ["src", "dst", "eid"] if value is not None else e.columns, value)


def in_incidence(g: Graph, u: Any, value: Column | str | None = None, basic: bool = False) -> DataFrame:
    """Edges into a vertex."""
    e = g.in_edges(u)
    return _valued(e, ["src"] if basic else ["src", "dst", "eid"] if value is not None else e.columns, value)


def neighbors(g: Graph, u: Any, value: Column | str | None = None, basic: bool = False) -> DataFrame:
    """The targets of a vertex's edges, one for each edge, with their values."""
    return _ends(g, g.out_edges(u), "dst", value, basic)


def in_neighbors(g: Graph, u: Any, value: Column | str | None = None, basic: bool = False) -> DataFrame:
    """The sources of the edges into a vertex, one for each edge, with their values."""
    return _ends(g, g.in_edges(u), "src", value, basic)


def _ends(g: Graph, edges: DataFrame, end: str, value: Column | str | None, basic: bool) -> DataFrame:
    ids = edges.select(F.col(end).alias("id"))
    if basic and value is None:
        return ids
    found = ids.join(g.vertices, "id")
    return _valued(found, ["id"] if value is not None else found.columns, value)


#: The same views under the names that say their direction.
out_incidence, out_neighbors = incidence, neighbors


def transpose(g: Graph) -> Graph:
    return g.transpose()


def adaptor(view: Callable[..., Any]) -> Callable[..., Callable[[Graph], Any]]:
    """``adaptor(view)(*arguments)`` awaits the graph: ``pipe(g, adaptor(vertexlist)())``."""
    return lambda *a, **kw: lambda g: view(g, *a, **kw)


def pipe(start: Any, *steps: Callable[[Any], Any]) -> Any:
    """Each step applied to the result of the one before."""
    for step in steps:
        start = step(start)
    return start
