import itertools
import random

import pytest
from graphs import COMPLETE, DISCONNECTED, SPANNING, both
from pyspark.sql import functions as F

from skein.errors import GraphError, OutOfRange
from skein.graph import Graph
from skein.operators import components as c
from skein.operators import kernels
from skein.operators import structure as s


def groups(df, name="component"):
    out = {}
    for r in df.collect():
        out.setdefault(r[name], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def random_edges(n, m, seed, loops=False):
    g = random.Random(seed)
    return [(a, b) for a, b in ((g.randrange(n), g.randrange(n)) for _ in range(m)) if loops or a != b]


def test_weak_components(spark):
    assert groups(c.connected_components(Graph.from_rows(spark, DISCONNECTED))) == [[0, 1], [2, 3, 4]]
    assert groups(c.connected_components(Graph.from_rows(spark, [(1, 0)]))) == [[0, 1]]
    g = Graph.from_rows(spark, [(5, 9), (9, 7), (2, 2)], n_vertices=10)
    assert {r["id"]: r["component"] for r in c.afforest(g).collect()}[7] == 5
    assert c.num_components(g) == 8 and {r["component"]: r["size"] for r in c.component_sizes(g).collect()}[5] == 3
    numbers = {r["id"]: r["component"] for r in c.connected_components(g).collect()}
    assert sorted(set(numbers.values())) == list(range(8)) and numbers[0] == 0 and numbers[9] == 5
    # a long path settles in few rounds
    path = Graph.from_edges(spark.range(500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert c.num_components(path) == 1


def test_strong_components(spark):
    for edges, want in (([(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)], [[0, 1], [2, 3]]), ([(0, 1), (0, 2), (2, 1)], [[0], [1], [2]])):
        g = Graph.from_rows(spark, edges)
        assert groups(c.strong_components(g)) == want and groups(c.strong_components(g, kernel_edges=0)) == want
    edges = random_edges(25, 45, 3)
    out = {}
    for k, (a, b) in enumerate(edges):
        out.setdefault(a, []).append((b, k))
    want = sorted(kernels.strong_components(range(25), out))
    assert groups(c.strong_components(Graph.from_rows(spark, edges, n_vertices=25), kernel_edges=0)) == want
    order = {r["id"]: r["number"] for r in c.condensation_order(Graph.from_rows(spark, edges, n_vertices=25)).collect()}
    assert all(order[a] <= order[b] for a, b in edges)


def test_numbered_strong_components(spark):
    g = Graph.from_rows(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)])
    forward = {r["id"]: r["component"] for r in c.kosaraju(g).collect()}
    backward, n = c.tarjan_scc(g)
    assert forward == {0: 0, 1: 0, 2: 1, 3: 1} and n == 2
    assert {r["id"]: r["component"] for r in backward.collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def cut_by_removal(vertices, edges):
    def parts(vs):
        left, n = set(vs), 0
        while left:
            stack = [left.pop()]
            n += 1
            while stack:
                u = stack.pop()
                for a, b in edges:
                    for x, y in ((a, b), (b, a)):
                        if x == u and y in left:
                            left.discard(y)
                            stack.append(y)
        return n

    return {v for v in vertices if parts(set(vertices) - {v}) > parts(vertices)}


def test_articulation_and_blocks(spark):
    edges = [(0, 1), (1, 2), (2, 0), (1, 3), (3, 4), (4, 5), (5, 3)]
    g = Graph.from_rows(spark, both(edges), n_vertices=7)
    assert {r["id"] for r in c.articulation_points(g).collect()} == {1, 3}
    assert groups(c.biconnected_components(g), "block") == [[0, 1, 2], [1, 3], [3, 4, 5], [6]]
    assert groups(c.biconnected_components(Graph.from_rows(spark, [(0, 0)])), "block") == [[0]]
    doubled = Graph.from_rows(spark, [(0, 1), (0, 1), (1, 2)])
    assert {r["id"] for r in c.articulation_points(doubled).collect()} == {1}
    for seed in range(4):
        e = random_edges(12, 14, seed)
        out = {}
        for k, (a, b) in enumerate(e):
            out.setdefault(a, []).append((b, k))
            out.setdefault(b, []).append((a, k))
        assert kernels.low_points(range(12), out)[0] == cut_by_removal(range(12), e)
    with pytest.raises(GraphError):
        c.articulation_points(g, most_edges=3)


def test_triangles(spark):
    assert s.triangle_count(Graph.from_rows(spark, COMPLETE)) == 4
    assert s.directed_triangle_count(Graph.from_rows(spark, [(0, 1), (1, 2), (0, 2)])) == 1
    assert s.directed_triangle_count(Graph.from_rows(spark, [(0, 1), (1, 2), (2, 0)])) == 0
    assert s.cyclic_triangle_count(Graph.from_rows(spark, [(0, 1), (1, 2), (2, 0)])) == 1
    assert s.directed_triangle_count(Graph.from_rows(spark, COMPLETE)) == 24
    edges = random_edges(15, 60, 1, loops=True) * 2
    have = {frozenset(e) for e in edges if e[0] != e[1]}
    want = [t for t in itertools.combinations(range(15), 3) if all(frozenset(p) in have for p in itertools.combinations(t, 2))]
    assert sorted(tuple(r) for r in s.triangles(Graph.from_rows(spark, edges)).collect()) == want


def test_jaccard(spark):
    rows = s.jaccard(Graph.from_rows(spark, both([(0, 1), (1, 2), (0, 2)]))).collect()
    assert len(rows) == 6 and all(abs(r["jaccard"] - 1 / 3) < 1e-12 for r in rows)
    edges = random_edges(12, 50, 2, loops=True)
    near = {v: {b for a, b in edges if a == v and b != v} for v in range(12)}
    for r in s.jaccard(Graph.from_rows(spark, edges)).collect():
        a, b = near[r["src"]], near[r["dst"]]
        assert (r["common"], r["union_size"]) == (len(a & b), len(a | b))


def greedy(n, edges, seed):
    out, gone = [], {a for a, b in edges if a == b}
    for v in [seed, *(v for v in range(n) if v != seed)] if seed is not None else range(n):
        if v not in gone:
            out.append(v)
            gone |= {b for a, b in edges if a == v}
    return set(out)


def test_independent_set(spark):
    loop = Graph.from_rows(spark, [(0, 0), (0, 1), (1, 0)], n_vertices=3)
    assert {r["id"] for r in s.maximal_independent_set(loop, 1).collect()} == {1, 2}
    edges = both(random_edges(20, 30, 5))
    g = Graph.from_rows(spark, edges, n_vertices=20)
    for seed in (None, 7):
        assert {r["id"] for r in s.maximal_independent_set(g, seed).collect()} == greedy(20, edges, seed)
    with pytest.raises(OutOfRange):
        s.maximal_independent_set(g, 99)


def test_label_propagation(spark):
    two = both([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])
    labels = {r["id"]: r["label"] for r in s.label_propagation(Graph.from_rows(spark, two)).collect()}
    assert len({labels[k] for k in (0, 1, 2)}) == 1 and labels[0] != labels[3]
    given = spark.createDataFrame([(0, 7), (1, None)], "id long, label long")
    spread = {r["id"]: r["label"] for r in s.label_propagation(Graph.from_rows(spark, both([(0, 1), (1, 2)])), given).collect()}
    assert set(spread.values()) == {7}


def kruskal(n, edges, sign=1):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0
    for a, b, w in sorted(edges, key=lambda e: sign * e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    return total, len({find(v) for v in range(n)})


def test_spanning_forest(spark):
    g = Graph.from_rows(spark, SPANNING)
    assert s.spanning_forest_weight(g, "value") == (37, 1) and s.minimum_spanning_forest(g, "value").count() == 8
    tri = Graph.from_rows(spark, [(0, 1, 1), (1, 2, 2), (2, 0, 3)])
    assert s.spanning_forest_weight(tri, "value") == (3, 1) and s.spanning_forest_weight(tri, "value", descending=True) == (5, 1)
    assert s.spanning_forest_weight(Graph.from_rows(spark, [(0, 1, 5)]), "value") == (5, 1)
    assert s.spanning_forest_weight(Graph.from_rows(spark, [(0, 1, 5), (1, 1, 1)]), "value") == (5, 1)
    g = random.Random(8)
    edges = [(a, b, g.randrange(-5, 5)) for a, b in random_edges(15, 30, 8)]
    assert s.spanning_forest_weight(Graph.from_rows(spark, edges, n_vertices=16), "value") == kruskal(16, edges)
    tree, total = s.prim(Graph.from_rows(spark, SPANNING + [(20, 21, 3)]), 0, "value")
    parents = {r["id"]: r["predecessor"] for r in tree.collect()}
    assert total == 37 and len(parents) == 9 and parents[0] == 0


def test_pagerank(spark):
    g = Graph.from_rows(spark, [(0, 1), (1, 2), (2, 0), (3, 0)], n_vertices=5)
    scores = {r["id"]: r["score"] for r in s.pagerank(g, tolerance=1e-10).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9
    x = [0.2] * 5
    for _ in range(200):
        base = 0.03 + 0.85 * x[4] / 5
        x = [base + 0.85 * (x[2] + x[3]), base + 0.85 * x[0], base + 0.85 * x[1], base, base]
    assert all(abs(scores[k] - x[k]) < 1e-8 for k in range(5))


@pytest.mark.parametrize("local", [0, 50_000])
def test_forests_of_symmetric_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(s, "MOST_LOCAL_EDGES", local)
    g = Graph.from_rows(spark, [(0, 1, 4), (1, 2, 8), (2, 0, 1)])
    for form in (g.symmetrize(), Graph.from_rows(spark, [(0, 1, 4), (1, 2, 8), (2, 0, 1), (1, 0, 4), (2, 1, 8), (0, 2, 1)])):
        assert s.spanning_forest_weight(form, "value") == (5, 1)
    assert s.minimum_spanning_forest(g.symmetrize(), "value").count() == 2 and s.prim(g.symmetrize(), 0, "value")[1] == 5
    assert s.spanning_forest_weight(g.symmetrize(), "value", descending=True) == (12, 1)


def test_triangles_join_no_wedges(spark, monkeypatch):
    from skein.operators import wedges

    for name, value in (("RANGE_PAIRS", 40), ("MOST_HEAVY", 5), ("PACK", 7), ("PROBE", 6)):
        monkeypatch.setattr(wedges, name, value)
    edges = random_edges(40, 260, 11) + [(0, k) for k in range(1, 40)]
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    want = {t for t in itertools.combinations(range(40), 3) if all(frozenset(p) in near for p in itertools.combinations(t, 2))}
    for name in (int, lambda k: f"v{k:02d}"):
        found = s.triangles(Graph.from_rows(spark, [(name(a), name(b)) for a, b in edges]))
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(map(name, t)) for t in want)
    assert s.triangle_count(Graph.from_rows(spark, [(-(2**40) * a, 3 - b) for a, b in edges if a < 3])) >= 0
    found = s.triangles(Graph.from_rows(spark, edges))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # a join would make all wedges
    assert s.triangle_count(Graph.from_rows(spark, [(0, 1), (1, 2)])) == 0 == s.triangle_count(Graph.from_rows(spark, [(0, 0)], n_vertices=2))


def test_large_graphs_give_the_same_in_more_tasks(spark, monkeypatch):
    from skein.plans import scratch

    edges = [(a, b) for a, b in {(min(e), max(e)) for e in random_edges(60, 150, 5)}]
    for directed in (True, False):
        g = Graph.from_rows(spark, edges, directed=directed)
        want = sorted(map(tuple, s.jaccard(g).collect())), sorted(map(tuple, s.maximal_independent_set(g, seed=9).collect()))
        with monkeypatch.context() as m:
            m.setattr(scratch, "TASK_ROWS", 20)
            tasks = []
            m.setattr(s, "spread", lambda spark, rows, f=s.spread: (tasks.append(rows), f(spark, rows))[1])
            big = Graph(g.vertices, g.edges, directed, about=len(edges))
            assert (sorted(map(tuple, s.jaccard(big).collect())), sorted(map(tuple, s.maximal_independent_set(big, seed=9).collect()))) == want
        assert len(edges) in tasks and min(tasks) < len(edges)  # fewer tasks once little is left
        assert {9} <= {t[0] for t in want[1]}


def test_what_hangs_on_large_components_is_taken_off_before_the_kernel(spark, monkeypatch):
    from skein.operators import traverse

    edges = random_edges(14, 20, 8, loops=True) + [(a % 14, 20 + a) for a in range(30)] + [(20, 60), (60, 61), (61, 62), (61, 62), (62, 63)]
    edges += [(100, 101)] + [(110, k) for k in range(111, 120)] + [(130, 130)]
    for directed in (True, False):
        g = Graph.from_rows(spark, edges, directed=directed)
        ask = lambda: (sorted(r["id"] for r in c.articulation_points(g).collect()), sorted(map(str, c.biconnected_components(g).collect())))  # noqa: B023, E731
        want = ask()
        with monkeypatch.context() as m:
            m.setattr(traverse, "LARGE", 2)
            assert ask() == want
    star = Graph.from_rows(spark, [(0, k) for k in range(1, 9)])
    monkeypatch.setattr(traverse, "LARGE", 2)
    monkeypatch.setattr(kernels, "low_points", None)  # the kernel isn't asked for a star
    assert [r["id"] for r in c.articulation_points(star).collect()] == [0] and c.biconnected_components(star).count() == 16
