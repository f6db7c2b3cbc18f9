import pytest
from pyspark.sql import functions as F

from skein.graph import Graph, undirected
from skein.sources import formats
from skein.sources import generators as g


def ends(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_fixed_shapes(spark):
    assert ends(g.path_graph(spark, 4)) == [(0, 1), (1, 2), (2, 3)] and g.path_graph(spark, 1).count() == 0
    assert g.grid_2d(spark, 3, 4).count() == 2 * (3 * 3 + 2 * 4) and g.complete_graph(spark, 5).count() == 20
    for w, ok in (("uniform", F.col("weight").between(1, 100)), ("exponential", F.col("weight") >= 1), ("constant_one", F.col("weight") == 1)):
        assert g.complete_graph(spark, 12, weights=w).filter(~ok).count() == 0
    with pytest.raises(ValueError):
        g.path_graph(spark, 3, weights="none")


def simple(df):
    rows = ends(df)
    return len(rows) == len(set(rows)) and all(a != b for a, b in rows)


def test_random_shapes(spark):
    er = g.erdos_renyi(spark, 300, 0.05).cache()
    assert simple(er) and abs(er.count() - 300 * 299 * 0.05) < 5 * (300 * 299 * 0.05) ** 0.5
    assert ends(er) == ends(g.erdos_renyi(spark, 300, 0.05).repartition(5)) and ends(er) != ends(g.erdos_renyi(spark, 300, 0.05, seed=1))
    assert g.erdos_renyi(spark, 10, 1.0).count() == 90 and g.erdos_renyi(spark, 1, 0.5).count() == 0
    gnm = g.erdos_renyi_gnm(spark, 50, 700)
    assert simple(gnm) and gnm.count() == 700 and g.erdos_renyi_gnm(spark, 4, 999).count() == 12
    ba = g.barabasi_albert(spark, 400, 3)
    rows = set(ends(ba))
    assert simple(ba) and all((b, a) in rows for a, b in rows)
    degree = Graph.from_edges(ba).out_degrees().agg(F.max("degree"), F.avg("degree")).first()
    assert degree[0] > 4 * degree[1] and 4 < degree[1] <= 6
    assert len(rows) == 2 * (3 + 397 * 3)
    for n, m in ((30, 5), (3, 1), (2, 5), (40, 2)):
        some = ends(g.barabasi_albert(spark, n, m))
        clique = min(n, max(m, 2))
        assert len(set(some)) == len(some) == clique * (clique - 1) + 2 * m * (n - clique)
        assert all(sum(a == w and b < w for a, b in some) == m for w in range(clique, n))
    ws = g.watts_strogatz(spark, 200, 4, 0.1)
    assert simple(ws) and 700 < ws.count() <= 800 and g.watts_strogatz(spark, 20, 4, 0.0).count() == 80
    assert ws.count() == 800 and ends(ws) != ends(g.watts_strogatz(spark, 200, 4, 0.0)) and ends(ws) == ends(g.watts_strogatz(spark, 200, 4, 0.1))
    full = g.watts_strogatz(spark, 200, 6, 1.0)
    assert simple(full) and full.count() == 1200
    dense = g.watts_strogatz(spark, 5, 2, 1.0)
    assert simple(dense) and 8 <= dense.count() <= 10 and g.watts_strogatz(spark, 2, 2, 0.5).count() == 0
    rm = g.rmat(spark, 8, 2000)
    assert simple(rm) and 0 < rm.count() <= 2000 and rm.agg(F.max(F.greatest("src", "dst"))).first()[0] < 256
    pl = g.plod(spark, 300, 1.2, 0.05)
    assert simple(pl) and Graph.from_edges(pl).out_degrees().agg(F.max("degree")).first()[0] > 5
    ss = g.ssca(spark, 300, 6, 0.5, 3)
    pairs = ends(ss)
    assert len(pairs) > len(set(pairs)) and all(a != b and 0 <= min(a, b) and max(a, b) < 300 for a, b in pairs)
    # numbers of parallel edges begin at 1, links have 0
    link = [(r["src"], r["dst"]) for r in ss.filter("eid % 4 = 0").collect()]
    inside = set(pairs) - set(link)
    assert len({a for a, _ in link}) == len(link) and 110 < len(link) < 190 and all((b, a) in inside for a, b in inside)
    assert sum(b < a for a, b in link) > 30 and sum(abs(a - b) > 12 for a, b in link) > 3
    assert g.ssca(spark, 50, 1, 0.0, 1).count() == 0 and g.ssca(spark, 0, 3, 0.5, 1).count() == 0


def test_starts_in_blocks(spark):
    sizes = [(k, 1 + k * 7 % 5) for k in range(70)]
    found = {r["k"]: r["lo"] for r in g._starts(spark.createDataFrame(sizes, "k long, s long"), 70, block=4).collect()}
    assert found == {k: sum(s for _, s in sizes[:k]) for k, _ in sizes}


@pytest.fixture
def small(spark):
    edges = spark.createDataFrame([(0, 1, 0, 5), (1, 2, 1, None), (2, 2, 2, 7), (2, 0, 3, 9)], "src long, dst long, eid long, value long")
    vertices = spark.createDataFrame([(0, 'a "q" \\ <&>'), (1, None), (2, "c\nd"), (3, "é")], "id long, name string")
    return Graph.from_edges(edges, vertices)


def test_dot(spark, small, tmp_path):
    formats.write_dot(small, f"{tmp_path}/d", vertex_label=F.col("name"), edge_label=F.col("value"))
    back = formats.read_dot(spark, f"{tmp_path}/d")
    assert {r["id"]: r["label"] for r in back.vertices.collect()} == {"0": 'a "q" \\ <&>', "1": None, "2": "c\nd", "3": "é"}
    assert sorted((r["src"], r["dst"], r["label"]) for r in back.edges.collect() if r["label"]) == [("0", "1", "5"), ("2", "0", "9"), ("2", "2", "7")]
    (tmp_path / "x.dot").write_text('// c\ngraph "my g" { rankdir=LR; node [shape=box]; a -- b -- c [label="x;y"]; d /* e */ }\n')
    other = formats.read_dot(spark, f"{tmp_path}/x.dot")
    assert not other.directed and other.header["name"] == "my g" and ends(other.edges) == [("a", "b"), ("b", "c")] and other.vertices.count() == 4


def test_graphml(spark, small, tmp_path):
    formats.write_graphml(small, f"{tmp_path}/g")
    back = formats.read_graphml(spark, f"{tmp_path}/g")
    assert {k["name"]: k["for"] for k in back.header["keys"].values()} == {"name": "node", "value": "edge"}
    assert {r["id"]: r["data"].get("d0") for r in back.vertices.collect()} == {"n0": 'a "q" \\ <&>', "n1": None, "n2": "c\nd", "n3": "é"}
    assert ends(back.edges) == [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n2")] and back.directed


def test_json(spark, small, tmp_path):
    formats.write_json(small, f"{tmp_path}/j")
    back = formats.read_json(spark, f"{tmp_path}/j")
    assert {r["id"]: r["data"].get("name") for r in back.vertices.collect()}["0"] == 'a "q" \\ <&>'
    assert {(r["src"], r["dst"]): r["data"].get("value") for r in back.edges.collect()} == {("0", "1"): "5", ("1", "2"): None, ("2", "2"): "7", ("2", "0"): "9"}
    (tmp_path / "x.json").write_text('{"directed": false, "nodes": [{"id": 1, "k": {"deep": 1}, "s": "\\u00e9"}], "edges": [{"source": 1, "target": 1}]}')
    other = formats.read_json(spark, f"{tmp_path}/x.json")
    assert not other.directed and other.vertices.first()["data"] == {"s": "é"}


def test_dimacs(spark, small, tmp_path):
    formats.write_dimacs_max_flow(small, f"{tmp_path}/f", 0, 2, "value")
    back = formats.read_dimacs(spark, f"{tmp_path}/f")
    assert back.header == {"problem": "max", "num_vertices": 4, "num_arcs": 4, "nodes": {0: "s", 2: "t"}}
    assert sorted((r["src"], r["dst"], r["weight"]) for r in back.edges.fillna("").collect()) == [(0, 1, "5"), (1, 2, ""), (2, 0, "9"), (2, 2, "7")]
    (tmp_path / "x.col").write_text("c note\np edge 2 1\ne 1 2\na 0 1 3\n")
    assert ends(formats.read_dimacs(spark, f"{tmp_path}/x.col").edges) == [(0, 0), (0, 1)]


def test_metis(spark, small, tmp_path):
    formats.write_metis(small, f"{tmp_path}/m", weight="value")
    back = formats.read_metis(spark, f"{tmp_path}/m")
    assert back.header["num_vertices"] == 4 and back.header["num_edges"] == 3 and back.vertices.count() == 4
    assert sorted({(min(a, b), max(a, b)) for a, b in ends(back.edges)}) == [(0, 1), (0, 2), (1, 2)]
    (tmp_path / "x.graph").write_text("% c\n4 1 011 1\n7 3 5\n\n2 1 5\n1\n")
    other = formats.read_metis(spark, f"{tmp_path}/x.graph")
    assert sorted((r["src"], r["dst"], r["weight"]) for r in other.edges.collect()) == [(0, 2, "5"), (2, 0, "5")]
    assert {r["id"]: r["weights"] for r in other.vertices.collect()} == {0: "7", 1: None, 2: "2", 3: "1"}


def test_adjacency_text_and_snap(spark, small, tmp_path):
    formats.write_adjacency_text(small, f"{tmp_path}/a")
    back = formats.read_adjacency_text(spark, f"{tmp_path}/a")
    assert ends(back.edges) == [("0", "1"), ("1", "2"), ("2", "0"), ("2", "2")] and back.vertices.count() == 4
    (tmp_path / "s.txt").write_text("# a comment\n0\t1\n5\t0\n")
    snap = formats.read_snap(spark, f"{tmp_path}/s.txt")
    assert ends(snap.edges) == [(0, 1), (5, 0)] and snap.graph().num_vertices() == 3


def test_undirected_files(spark, tmp_path):
    formats.write_dot(undirected(spark.createDataFrame([(0, 1)], "src long, dst long")), f"{tmp_path}/u")
    assert not formats.read_dot(spark, f"{tmp_path}/u").directed
