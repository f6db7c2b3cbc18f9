"""Graph file formats: DOT, GraphML, JSON, DIMACS, METIS, adjacency text and SNAP edge lists.

Writers make one column of ordered lines and write them as text: parts in order,
or a single file. Readers give vertices and edges as DataFrames with string ids
(DIMACS and METIS: integers from 0). Line formats are parsed where their lines
are; formats whose meaning spans lines are parsed a file to a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import GraphError
from skein.graph import Graph, both_ways
from skein.plans.scratch import written

#: Characters of a file that one task parses whole.
MOST_FILE_CHARS = 1 << 30


@dataclass
class GraphFile:
    """What a file holds: vertices, edges, and what its header says."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    header: dict[str, Any] | None = None

    def graph(self, **kw) -> Graph:
        """The graph of the ids as they are."""
        return Graph.from_edges(self.edges, self.vertices, directed=self.directed, **kw)


def _write(lines: DataFrame, path: str, single: bool) -> None:
    """``lines``: columns o1, o2, o3 (order) and value."""
    ordered = lines.orderBy("o1", "o2", "o3")
    (ordered.coalesce(1) if single else ordered).select("value").write.mode("overwrite").text(path)


def _lines(part: int, df: DataFrame, value: Column, o2: Column | None = None, o3: Column | None = None) -> DataFrame:
    zero = F.lit(None).cast("string")
    return df.select(F.lit(part).alias("o1"), (zero if o2 is None else o2).alias("o2"), (zero if o3 is None else o3).cast("long").alias("o3"), value.alias("value"))


def _text_lines(spark: SparkSession, part: int, *text: str) -> DataFrame:
    return spark.createDataFrame([(part, None, k, t) for k, t in enumerate(text)], "o1 int, o2 string, o3 long, value string")


def _order(df: DataFrame, column: str) -> Column:
    """A string that sorts as the ids do."""
    kind = df.schema[column].dataType.typeName()
    return F.lpad(F.col(column).cast("string"), 20, "0") if kind in ("long", "integer", "short") else F.col(column).cast("string")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """``parse(text)`` of each whole file: rows."""
    names = [f.split()[0] for f in re.split(r",(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                if len(text) > MOST_FILE_CHARS:
                    raise GraphError(f"a file of {len(text)} characters: this format is parsed a file to a task")
                yield pd.DataFrame(list(parse(text)), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


# -- DOT ------------------------------------------------------------------------------


def write_dot(g: Graph, path: str, name: str = "G", vertex_label: Column | None = None, edge_label: Column | None = None, vertex_attributes: Column | None = None, edge_attributes: Column | None = None, single: bool = True) -> None:
    """Nodes, then edges, with labels (quoted) or raw attribute text."""
    arrow = " -> " if g.directed else " -- "
    attributes = lambda label, raw: F.coalesce(F.concat(F.lit(" ["), raw, F.lit("]")), F.lit("")) if raw is not None else F.coalesce(F.concat(F.lit(" [label="), _quoted(label.cast("string")), F.lit("]")), F.lit("")) if label is not None else F.lit("")
    ident = lambda c, df: _quoted(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c).cast("string")
    v, e = g.vertices, g.edges
    _write(_union(
        _text_lines(g.spark, 0, f"{'digraph' if g.directed else 'graph'} {name} {{"),
        _lines(1, v, F.concat(F.lit("  "), ident("id", v), attributes(vertex_label, vertex_attributes), F.lit(";")), _order(v, "id")),
        _lines(2, e, F.concat(F.lit("  "), ident("src", e), F.lit(arrow), ident("dst", e), attributes(edge_label, edge_attributes), F.lit(";")), _order(e, "src"), F.col("eid")),
        _text_lines(g.spark, 3, "}"),
    ), path, single)


DOT_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|->|--|[\[\]{}=;,]|[^\s\[\]{}=;,"]+?(?=->|--|[\s\[\]{}=;,"]|$)|[^\s\[\]{}=;,"]+')
DOT_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|^\s*#[^\n]*', re.DOTALL | re.MULTILINE)


def _dot(text: str) -> Iterator[tuple]:
    tokens = DOT_TOKEN.findall(DOT_COMMENT.sub(lambda m: m[1] or " ", text))
    plain = lambda t: t[1:-1].replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\") if t[:1] == '"' else t
    at, known, n = 0, {}, 0
    directed, name = True, ""
    while at < len(tokens) and tokens[at] != "{":
        word = tokens[at].lower()
        if word in ("digraph", "graph"):
            directed = word == "digraph"
        elif word != "strict":
            name = plain(tokens[at])
        at += 1
    yield ("header", name, str(directed).lower(), None, 0)
    at += 1
    while at < len(tokens) and tokens[at] != "}":
        if tokens[at] in (";", ","):
            at += 1
            continue
        chain = [plain(tokens[at])]
        at += 1
        if at < len(tokens) and tokens[at] == "=":  # an attribute of the graph
            at += 2
            continue
        while at + 1 < len(tokens) and tokens[at] in ("->", "--"):
            chain.append(plain(tokens[at + 1]))
            at += 2
        label = None
        while at < len(tokens) and tokens[at] == "[":
            at += 1
            while at < len(tokens) and tokens[at] != "]":
                if at + 2 < len(tokens) and tokens[at + 1] == "=":
                    if tokens[at] == "label":
                        label = plain(tokens[at + 2])
                    at += 3
                else:
                    at += 1
            at += 1
        if len(chain) == 1 and chain[0].lower() in ("node", "edge", "graph"):
            continue
        for c in chain:
            if c not in known:
                known[c] = None
        if len(chain) == 1:
            known[chain[0]] = label if label is not None else known[chain[0]]
        for a, b in zip(chain, chain[1:], strict=False):
            yield ("edge", a, b, label, n)
            n += 1
    for k, (v, label) in enumerate(known.items()):
        yield ("vertex", v, None, label, k)


def read_dot(spark: SparkSession, path: str) -> GraphFile:
    """Vertices (id, label) in order of first mention and edges (src, dst, label, eid); chains of edges are split."""
    rows = _parsed(spark, path, _dot, "kind string, a string, b string, label string, n long")
    head = rows.filter("kind = 'header'").first()
    v = rows.filter("kind = 'vertex'").select(F.col("a").alias("id"), "label")
    e = rows.filter("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("eid"), "label")
    return GraphFile(v, e, head is None or head["b"] == "true", {"name": head["a"] if head else ""})


# -- GraphML ----------------------------------------------------------------------------


def write_graphml(g: Graph, path: str, single: bool = True) -> None:
    """Vertex and edge columns are keys; nulls are left out."""
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))
    vertex = [c for c in g.vertices.columns if c != "id"]
    edge = [c for c in g.edges.columns if c not in ("src", "dst", "eid")]
    keys = {("node", c): f"d{k}" for k, c in enumerate(vertex)} | {("edge", c): f"d{k + len(vertex)}" for k, c in enumerate(edge)}
    kind = lambda df, c: {"long": "long", "integer": "int", "double": "double", "float": "float", "boolean": "boolean"}.get(df.schema[c].dataType.typeName(), "string")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'  <key id="{k}" for="{what}" attr.name="{escape(c)}" attr.type="{kind(g.vertices if what == "node" else g.edges, c)}"/>' for (what, c), k in keys.items()]
    head.append(f'  <graph id="G" edgedefault="{"directed" if g.directed else "undirected"}">')
    data = lambda what, columns: F.concat(F.lit(""), *(F.coalesce(F.concat(F.lit(f'<data key="{keys[what, c]}">'), xml(F.col(c)), F.lit("</data>")), F.lit("")) for c in columns))
    v, e = g.vertices, g.edges
    _write(_union(
        _text_lines(g.spark, 0, *head),
        _lines(1, v, F.concat(F.lit('    <node id="n'), xml(F.col("id")), F.lit('">'), data("node", vertex), F.lit("</node>")), _order(v, "id")),
        _lines(2, e, F.concat(F.lit('    <edge id="e'), F.col("eid").cast("string"), F.lit('" source="n'), xml(F.col("src")), F.lit('" target="n'), xml(F.col("dst")), F.lit('">'), data("edge", edge), F.lit("</edge>")), _order(e, "src"), F.col("eid")),
        _text_lines(g.spark, 3, "  </graph>", "</graphml>"),
    ), path, single)


def _graphml(text: str) -> Iterator[tuple]:
    local = lambda x: x.tag.rpartition("}")[2]
    data = lambda x: {d.get("key"): d.text or "" for d in x if local(d) == "data"}
    v = e = 0
    for x in ElementTree.fromstring(text).iter():
        tag = local(x)
        if tag == "key":
            yield ("key", x.get("id"), x.get("for"), {"name": x.get("attr.name") or "", "type": x.get("attr.type") or ""}, 0)
        elif tag == "graph":
            yield ("header", x.get("id") or "", str(x.get("edgedefault") != "undirected").lower(), {}, 0)
        elif tag == "node":
            yield ("vertex", x.get("id"), None, data(x), v)
            v += 1
        elif tag == "edge":
            yield ("edge", x.get("source"), x.get("target"), data(x), e)
            e += 1


def read_graphml(spark: SparkSession, path: str) -> GraphFile:
    """Vertices (id, data) and edges (src, dst, eid, data); data maps key ids to text, the header has the keys."""
    rows = _parsed(spark, path, _graphml, "kind string, a string, b string, data map<string,string>, n long")
    head = rows.filter("kind = 'header'").first()
    keys = {r["a"]: {"for": r["b"], **r["data"]} for r in rows.filter("kind = 'key'").collect()}  # a file's few keys
    v = rows.filter("kind = 'vertex'").select(F.col("a").alias("id"), "data")
    e = rows.filter("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("eid"), "data")
    return GraphFile(v, e, head is None or head["b"] == "true", {"id": head["a"] if head else "", "keys": keys})


# -- JSON -------------------------------------------------------------------------------


def write_json(g: Graph, path: str, single: bool = True) -> None:
    """One object: directed, nodes and edges, whose values are written as strings."""
    text = lambda df, keep: [F.col(c).cast("string").alias(n) for c, n in keep] + [F.col(c).cast("string").alias(c) for c in df.columns if c not in ("id", "src", "dst", "eid")]
    v, e = g.vertices, g.edges
    # commas come before every row but the first, which one aggregate finds
    v1, e1 = v.agg(F.min(_order(v, "id"))).first()[0], e.agg(F.min(F.struct(_order(e, "src").alias("o"), "eid"))).first()[0]
    comma_v = F.when(_order(v, "id") == F.lit(v1), " ").otherwise(",")
    comma_e = F.lit(" ") if e1 is None else F.when((_order(e, "src") == F.lit(e1["o"])) & (F.col("eid") == F.lit(e1["eid"])), " ").otherwise(",")
    _write(_union(
        _text_lines(g.spark, 0, "{", f'"directed": {str(g.directed).lower()},', '"nodes": ['),
        _lines(1, v, F.concat(comma_v, F.to_json(F.struct(*text(v, [("id", "id")])))), _order(v, "id")),
        _text_lines(g.spark, 2, "],", '"edges": ['),
        _lines(3, e, F.concat(comma_e, F.to_json(F.struct(*text(e, [("src", "source"), ("dst", "target")])))), _order(e, "src"), F.col("eid")),
        _text_lines(g.spark, 4, "]", "}"),
    ), path, single)


def _json(text: str) -> Iterator[tuple]:
    found = json.loads(text)
    flat = lambda x, but: {k: v if isinstance(v, str) else json.dumps(v) for k, v in x.items() if k not in but and not isinstance(v, (dict, list)) and v is not None}
    yield ("header", None, str(bool(found.get("directed", True))).lower(), {}, 0)
    for k, x in enumerate(found.get("nodes", [])):
        yield ("vertex", str(x["id"]), None, flat(x, ("id",)), k)
    for k, x in enumerate(found.get("edges", [])):
        yield ("edge", str(x["source"]), str(x["target"]), flat(x, ("source", "target")), k)


def read_json(spark: SparkSession, path: str) -> GraphFile:
    """Vertices (id, data) and edges (src, dst, eid, data); data maps attributes to text, nested values are left out."""
    rows = _parsed(spark, path, _json, "kind string, a string, b string, data map<string,string>, n long")
    head = rows.filter("kind = 'header'").first()
    v = rows.filter("kind = 'vertex'").select(F.col("a").alias("id"), "data")
    e = rows.filter("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("eid"), "data")
    return GraphFile(v, e, head is None or head["b"] == "true")


# -- DIMACS -----------------------------------------------------------------------------


def write_dimacs(g: Graph, path: str, problem: str = "sp", weight: str | None = None, source: int | None = None, sink: int | None = None, single: bool = True) -> None:
    """Ids from 1: a problem line, for maximum flow the source and the sink, and an ``a`` line for each edge."""
    head = [f"p {problem} {g.num_vertices()} {g.num_edges()}"]
    head += [f"n {v + 1} {what}" for v, what in ((source, "s"), (sink, "t")) if v is not None]
    w = F.lit("") if weight is None else F.coalesce(F.concat(F.lit(" "), F.col(weight).cast("string")), F.lit(""))
    e = g.edges
    one = lambda c: (F.col(c) + 1).cast("string")
    _write(_union(_text_lines(g.spark, 0, *head), _lines(1, e, F.concat(F.lit("a "), one("src"), F.lit(" "), one("dst"), w), _order(e, "src"), F.col("eid"))), path, single)


def write_dimacs_max_flow(g: Graph, path: str, source: int, sink: int, capacity: str, single: bool = True) -> None:
    write_dimacs(g, path, "max", capacity, source, sink, single)


def read_dimacs(spark: SparkSession, path: str) -> GraphFile:
    """Edges (src, dst, eid, weight as text) from ``a`` and ``e`` lines, ids from 0; the header has problem, sizes and designated nodes."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), F.monotonically_increasing_id().alias("eid"))
    less = lambda i: F.greatest(F.try_element_at("w", F.lit(i)).cast("long") - 1, F.lit(0))
    arcs = lines.filter(F.col("w")[0].isin("a", "e"))
    e = arcs.select(less(2).alias("src"), less(3).alias("dst"), "eid", F.try_element_at("w", F.lit(4)).alias("weight"))
    p = lines.filter(F.col("w")[0] == "p").select("w").first()
    nodes = {int(r["w"][1]) - 1: r["w"][2] for r in lines.filter(F.col("w")[0] == "n").select("w").collect()}  # a source and a sink
    header = {"problem": p["w"][1] if p else "", "num_vertices": int(p["w"][2]) if p else 0, "num_arcs": int(p["w"][3]) if p else 0, "nodes": nodes}
    return GraphFile(spark.range(header["num_vertices"]), e, True, header)


# -- METIS ------------------------------------------------------------------------------


def write_metis(g: Graph, path: str, weight: str | None = None, single: bool = True) -> None:
    """Ids from 1, a line of neighbours for each vertex 0 to n - 1; edges both ways, loops left out, of repeated ones the first weight."""
    both = both_ways(g.edges).filter("src != dst")
    w = F.lit(None).cast("string") if weight is None else F.col(weight).cast("string")
    # both directions carry the first weight of either
    first = both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "eid", w.alias("w")).groupBy("a", "b").agg(F.min_by("w", "eid").alias("w"))
    pair = first.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(first.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    near = pair.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("n"))
    word = lambda x: F.concat_ws(" ", (x["dst"] + 1).cast("string"), x["w"]) if weight else (x["dst"] + 1).cast("string")
    n = g.num_vertices()
    rows = g.spark.range(n).join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce(F.array_join(F.transform("n", word), " "), F.lit("")).alias("line"))
    m = first.count()
    _write(_union(_text_lines(g.spark, 0, f"{n} {m}" + (" 001" if weight else "")), _lines(1, rows, F.col("line"), _order(rows, "id"))), path, single)


def _metis(text: str) -> Iterator[tuple]:
    lines = [x for x in text.split("\n") if not x.lstrip().startswith("%")]
    while lines and not lines[0].strip():
        lines.pop(0)
    if not lines:
        return
    head = lines[0].split()
    n, m, fmt = int(head[0]), int(head[1]), (head[2] if len(head) > 2 else "0").zfill(3)
    constraints = int(head[3]) if len(head) > 3 else 1
    yield ("header", n, m, fmt, constraints, None)
    n_edges = 0
    # an empty line is a vertex without neighbours
    for u, line in enumerate(lines[1 : n + 1]):
        words = line.split()
        at = int(fmt[-3] == "1")
        held = words[at : at + constraints] if fmt[-2] == "1" else []
        at += len(held)
        if held:
            yield ("weight", u, None, " ".join(held), None, u)
        step = 2 if fmt[-1] == "1" else 1
        for k in range(at, len(words), step):
            yield ("edge", u, int(words[k]) - 1, words[k + 1] if step == 2 and k + 1 < len(words) else None, None, n_edges)
            n_edges += 1


def read_metis(spark: SparkSession, path: str) -> GraphFile:
    """Edges as the file's lines list them (each from both ends), ids from 0; an empty line keeps its place."""
    rows = _parsed(spark, path, _metis, "kind string, a long, b long, w string, c long, k long")
    head = rows.filter("kind = 'header'").first()
    header = {"num_vertices": head["a"], "num_edges": head["b"], "fmt": head["w"], "ncon": head["c"]} if head else {"num_vertices": 0, "num_edges": 0, "fmt": "000", "ncon": 1}
    weights = rows.filter("kind = 'weight'").select(F.col("a").alias("id"), F.col("w").alias("weights"))
    v = spark.range(header["num_vertices"]).join(weights, "id", "left")
    e = rows.filter("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("k").alias("eid"), F.col("w").alias("weight"))
    return GraphFile(v, e, True, header)


# -- adjacency text and SNAP ---------------------------------------------------------------


def write_adjacency_text(g: Graph, path: str, single: bool = True) -> None:
    """``u: v1 v2`` for each vertex."""
    near = g.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("eid", "dst"))).alias("n"))
    rows = g.vertices.select("id").join(near.withColumnRenamed("src", "id"), "id", "left")
    words = F.array_join(F.transform("n", lambda x: x["dst"].cast("string")), " ")
    _write(_lines(1, rows, F.concat_ws(" ", F.concat(F.col("id").cast("string"), F.lit(":")), words), _order(rows, "id")), path, single)


def read_adjacency_text(spark: SparkSession, path: str) -> GraphFile:
    """Lines of a vertex and its targets, parted by space, with or without a colon; ``#`` opens a comment."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", ":", " ")), r"\s+").alias("w")).filter((F.col("w")[0] != "") & ~F.col("w")[0].startswith("#"))
    # edges are numbered in the order of the file, and written so that the numbers stay
    e = written(lines.select(F.col("w")[0].alias("src"), F.explode(F.slice("w", 2, 1 << 30)).alias("dst")).select("src", "dst", F.monotonically_increasing_id().alias("eid")), "adjacency")
    v = lines.select(F.explode("w").alias("id")).distinct()
    return GraphFile(v, e)


def read_snap(spark: SparkSession, path: str) -> GraphFile:
    """``src<tab>dst`` lines; ``#`` opens a comment."""
    e = spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long").filter("src is not null").withColumn("eid", F.monotonically_increasing_id())
    v = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
    return GraphFile(v, e)
