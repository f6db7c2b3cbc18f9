import pytest
from graphs import COMPLETE, DIAMOND, MULTI, PATH, STAR
from pyspark.sql import functions as F

from skein.errors import GraphError, OutOfRange
from skein.graph import Graph, matrix, undirected
from skein.operators import views


def ends(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_counts(spark):
    g = Graph.from_rows(spark, PATH)
    assert pairs(g.out_degrees()) == {0: 1, 1: 1, 2: 1, 3: 0}
    assert pairs(g.in_degrees()) == {0: 0, 1: 1, 2: 1, 3: 1}
    assert (g.num_vertices(), g.num_edges(), g.num_edges(1), g.has_edges()) == (4, 3, 1, True)
    assert pairs(Graph.from_rows(spark, COMPLETE).out_degrees()) == dict.fromkeys(range(4), 3)
    assert pairs(Graph.from_rows(spark, STAR).out_degrees())[0] == 4
    assert pairs(Graph.from_rows(spark, MULTI).out_degrees())[0] == 2


def test_isolated_vertices_and_limits(spark):
    g = Graph.from_rows(spark, PATH, n_vertices=6)
    assert g.num_vertices() == 6 and g.sequential
    with pytest.raises(OutOfRange):
        Graph.from_rows(spark, PATH, n_vertices=3)
    with pytest.raises(GraphError):
        Graph.from_edges(spark.range(3))
    big = spark.sql("select cast(18446744073709551615 as decimal(20,0)) as src, cast(1 as decimal(20,0)) as dst")
    with pytest.raises(OutOfRange):
        Graph.from_edges(big)
    with pytest.raises(GraphError):
        Graph.from_edges(spark.createDataFrame([(1, 0, 0), (0, 1, 1)], "src long, dst long, eid long").coalesce(1), require_sorted=True)


def test_look_ups(spark):
    g = Graph.from_rows(spark, MULTI)
    assert g.find_out_edge(0, 1).first()["value"] == 10
    assert g.find_in_edge(2, 1).first()["value"] == 3
    assert g.contains_out_edge(0, 1) and not g.contains_out_edge(1, 0) and g.contains_in_edge(1, 0)
    assert g.contains_vertex(2) and not g.contains_vertex(9) and g.find_vertex(9).isEmpty()
    probes = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["found"] for r in g.contains_edges(probes).collect()} == {(0, 1): True, (1, 0): False}
    assert [r["value"] for r in g.find_edges(probes).collect()] == [10]


def test_parallel_edges(spark):
    g = Graph.from_rows(spark, MULTI, keep="first")
    assert sorted(r["value"] for r in g.edges.collect()) == [3, 10]
    assert sorted(r["value"] for r in Graph.from_rows(spark, MULTI, keep="last").edges.collect()) == [3, 5]
    m = matrix(spark.createDataFrame([(0, 1, 0, 7), (1, 0, 1, 8)], "src long, dst long, eid long, value long"), 2, directed=False)
    assert [r["value"] for r in m.edges.collect()] == [8] and ends(m.arcs) == [(0, 1), (1, 0)]


def test_undirected(spark):
    g = undirected(spark.createDataFrame([(0, 1), (1, 1)], "src long, dst long"))
    assert g.num_edges() == 2 and ends(g.arcs) == [(0, 1), (1, 0), (1, 1)]
    assert ends(g.symmetrize().edges) == [(0, 1), (1, 0), (1, 1)]
    assert pairs(g.out_degrees()) == {0: 1, 1: 2}
    assert g.remove_edge(1, 0)[1] == 1


def test_transposed_and_filtered(spark):
    g = Graph.from_rows(spark, DIAMOND)
    assert ends(g.transpose().edges) == [(1, 0), (2, 0), (3, 1), (3, 2)]
    loose = g.filtered(lambda c: F.col(c) != 1, F.col("value") > 2)
    assert ends(loose.edges) == [(0, 2), (2, 3)] and loose.num_vertices() == 4
    strict = g.filtered(lambda c: F.col(c) != 2, strict=True)
    assert ends(strict.edges) == [(0, 1), (1, 3)] and strict.num_vertices() == 3
    assert g.filtered_vertices(lambda c: F.col(c) > 1).count() == 2


def test_changes(spark):
    g = Graph.from_rows(spark, PATH, n_vertices=4)
    g2, new = g.add_vertex()
    assert new == 4 and g2.num_vertices() == 5 and g.num_vertices() == 4
    g3 = g2.add_edge(4, 0, value=9)
    assert (4, 0) in ends(g3.edges)
    with pytest.raises(OutOfRange):
        g.add_edge(0, 77)
    g4, gone = Graph.from_rows(spark, MULTI).remove_edge(0, 1)
    assert gone == 2 and ends(g4.edges) == [(1, 2)] and g4.remove_edge(8, 9)[1] == 0
    g5 = g.remove_vertex(1)
    assert ends(g5.edges) == [(1, 2)] and sorted(r["id"] for r in g5.vertices.collect()) == [0, 1, 2]
    keyed = Graph.from_rows(spark, PATH)
    assert ends(keyed.remove_vertex(1).edges) == [(2, 3)]
    same, told = keyed.add_vertex(1)
    assert told is False and same.num_vertices() == 4
    assert g.resize(2).num_edges() == 1 and g.resize(9).num_vertices() == 9 and g.clear().num_edges() == 0
    grown = keyed.load_edges(spark.createDataFrame([(3, 8, 1)], "src long, dst long, value long"))
    assert grown.num_vertices() == 5 and grown.num_edges() == 4


def test_partitions_and_properties(spark):
    g = Graph.from_rows(spark, PATH, boundaries=(0, 2))
    assert pairs(g.partition_ids()) == {0: 0, 1: 0, 2: 1, 3: 1} and g.num_partitions() == 2 and g.num_vertices(pid=1) == 2
    assert Graph.from_rows(spark, PATH).num_vertices(pid=1) == 0
    named = g.with_property(spark.createDataFrame([(0, "a")], "id long, name string"), "name", "none")
    assert named.vertex_value(0, "name") == "a" and named.vertex_value(3, "name") == "none"
    assert {r["src_name"] for r in named.sources().collect()} == {"a", "none"}


def test_views(spark):
    g = Graph.from_rows(spark, DIAMOND)
    assert sorted(r[0] for r in views.vertexlist(g, first=1, last=3).collect()) == [1, 2]
    assert {tuple(r) for r in views.vertexlist(g, value="id * 2").collect()} == {(k, 2 * k) for k in range(4)}
    assert views.vertexlist(g, subset=spark.range(2)).count() == 2
    assert ends(views.edgelist(g, basic=True)) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert sorted(r["value"] for r in views.edgelist(g, value=F.col("value") + 1).collect()) == [3, 4, 6, 8]
    assert sorted(r[0] for r in views.incidence(g, 0, basic=True).collect()) == [1, 2]
    assert sorted(r[0] for r in views.in_incidence(g, 3, basic=True).collect()) == [1, 2]
    assert sorted(r["id"] for r in views.neighbors(g, 0).collect()) == [1, 2]
    assert sorted(r["id"] for r in views.in_neighbors(g, 3).collect()) == [1, 2]
    assert views.neighbors(Graph.from_rows(spark, MULTI), 0).count() == 2
    assert views.pipe(g, views.transpose, views.adaptor(views.incidence)(3)).count() == 2


def test_string_ids_and_adjacency(spark):
    g = Graph.from_rows(spark, [("alice", "bob", 1), ("bob", "dave", 2)])
    assert pairs(g.out_degrees()) == {"alice": 1, "bob": 1, "dave": 0}
    rows = spark.createDataFrame([(0, [1, 2]), (1, []), (5, None)], "id long, neighbours array<long>")
    a = Graph.from_adjacency(rows)
    assert ends(a.edges) == [(0, 1), (0, 2)] and a.num_vertices() == 4


def test_pairs_of_like_ends_are_not_made_to_be_looked_up(spark, monkeypatch):
    import skein.graph

    monkeypatch.setattr(skein.graph, "BLOCK", 2)  # several blocks of targets
    edges = [(a, b, 10 * a + b) for a in range(8) for b in range(100, 112) if (a * b) % 3 == 0]
    g = Graph.from_rows(spark, edges + [(0, 102, 1), (0, 102, 2)])
    alike = lambda ids: spark.createDataFrame([(i, None if i == 7 else i % 4) for i in ids] + [(ids[0], ids[0] % 4)], "id long, k long")
    sources, targets = alike(list(range(10))), alike(list(range(98, 115)))
    probes = sources.join(targets.withColumnRenamed("id", "dst"), "k").select(F.col("id").alias("src"), "dst").distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(g.contains_edges_alike(sources, targets)) == rows(g.contains_edges(probes))
    assert rows(g.find_edges_alike(sources, targets)) == rows(g.find_edges(probes)) and len(rows(g.find_edges_alike(sources, targets))) > 5
    back = g.transpose()
    assert rows(back.find_edges_alike(targets, sources)) == rows(back.find_edges(probes.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    assert rows(g.contains_edges_alike(sources.limit(0), targets)) == []
    with pytest.raises(GraphError):
        g.contains_edges_alike(sources.unionAll(sources.withColumn("k", F.col("k") + 1)), targets)
