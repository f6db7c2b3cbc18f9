import operator

import pytest
from graphs import CYCLE, DIAMOND, DISCONNECTED, MULTI, PATH, ROUTES, TREE
from pyspark.sql import functions as F

from skein.errors import CycleError, OutOfRange
from skein.graph import Graph
from skein.operators import traverse as t


def column(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_bfs(spark):
    g = Graph.from_rows(spark, TREE)
    assert column(t.bfs(g, 0), "depth") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2}
    assert column(t.bfs(g, [3, 5], reverse=True), "depth") == {3: 0, 5: 0, 1: 1, 2: 1, 0: 2}
    assert column(t.bfs(g, 0, max_depth=1), "depth") == {0: 0, 1: 1, 2: 1}
    assert set(column(t.bfs(g, 0, prune=lambda c: F.col(c) == 1), "depth")) == {0, 1, 2, 5, 6}
    assert sorted((r["src"], r["dst"]) for r in t.bfs_edges(g, 0).collect()) == TREE
    with pytest.raises(OutOfRange):
        t.bfs(g, 99)
    events = [r["event"] for r in t.bfs_events(Graph.from_rows(spark, [(0, 1)]), 0).orderBy("seq").collect()]
    assert events[:2] == ["initialize_vertex", "discover_vertex"] and events.count("examine_edge") == 1 and events.count("finish_vertex") == 2


def test_shortest_paths(spark):
    g = Graph.from_rows(spark, ROUTES, n_vertices=6)
    rows = {r["id"]: (r["distance"], r["predecessor"]) for r in t.dijkstra(g, 0, "value").collect()}
    assert {k: v[0] for k, v in rows.items()} == {0: 0, 1: 8, 2: 9, 3: 5, 4: 7, 5: None}
    assert rows[0][1] == 0 and rows[5][1] == 5
    weights = {(u, v): w for u, v, w in ROUTES}
    assert all(rows[p][0] + weights[p, v] == d for v, (d, p) in rows.items() if d and v != p)
    assert column(t.dijkstra_distances(Graph.from_rows(spark, MULTI), 0, "value"), "distance") == {0: 0, 1: 5, 2: 8}
    assert column(t.dijkstra(Graph.from_rows(spark, PATH), 0), "distance") == {0: 0, 1: 1, 2: 2, 3: 3}
    assert column(t.dijkstra(g, 0, "value", infinity=-1), "distance")[5] == -1
    assert column(t.dijkstra(Graph.from_rows(spark, DIAMOND), [1, 2], "value"), "distance") == {0: None, 1: 0, 2: 0, 3: 2}


def test_edges_after_the_search(spark):
    g = Graph.from_rows(spark, [(0, 1, 10), (0, 1, 5), (1, 2, 3), (0, 2, 9), (5, 0, 1)])
    events = {r["eid"]: r["event"] for r in t.relaxed_edges(g, t.dijkstra(g, 0, "value"), "value").collect()}
    assert events == {0: "edge_not_relaxed", 1: "edge_relaxed", 2: "edge_relaxed", 3: "edge_not_relaxed"}
    assert t.init_shortest_paths(g).filter("id = predecessor and distance is null").count() == 4
    far = Graph.from_rows(spark, [(0, 1, float("inf")), (0, 2, 1.0)])
    assert column(t.dijkstra(far, 0, "value"), "distance") == {0: 0, 1: None, 2: 1}


def test_widest_path(spark):
    g = Graph.from_rows(spark, DIAMOND)
    widest = t.shortest_paths(g, 0, "value", combine=lambda d, w: F.least(d, w), minimize=False, zero=1000)
    assert column(widest, "distance") == {0: 1000, 1: 5, 2: 3, 3: 3}
    assert operator.add(1, 1) == 2


def test_negative_weights(spark):
    bad = Graph.from_rows(spark, [(0, 1, 1), (1, 2, 1), (2, 0, -3)])
    with pytest.raises(OutOfRange):
        t.dijkstra(bad, 0, "value")
    paths, cycle = t.bellman_ford(bad, 0, "value")
    assert cycle in (0, 1, 2) and sorted(t.negative_cycle(paths, cycle)) == [0, 1, 2]
    good = Graph.from_rows(spark, [(0, 1, 4), (0, 2, 2), (2, 1, -1), (1, 3, 1)])
    paths, cycle = t.bellman_ford(good, 0, "value")
    assert cycle is None and column(paths, "distance") == {0: 0, 1: 1, 2: 2, 3: 2} and t.negative_cycle(paths, None) == []
    # the cycle hangs behind a tail, and a loop is one, too
    paths, cycle = t.bellman_ford(Graph.from_rows(spark, [(0, 2, -2), (2, 2, -1), (2, 1, 4)]), 0, "value")
    assert cycle == 2 and t.negative_cycle(paths, 2) == [2]


def test_dfs(spark):
    g = Graph.from_rows(spark, [(0, 1), (1, 2), (2, 0), (0, 2), (2, 3)])
    rows = {r["id"]: r for r in t.dfs(g, 0).collect()}
    assert [r["id"] for r in sorted(rows.values(), key=lambda r: r["discover"])] == [0, 1, 2, 3]
    assert rows[3]["parent"] == 2 and rows[0]["finish"] == 7
    assert {r["eid"]: r["class"] for r in t.dfs_edges(g, 0).collect()} == {0: "tree", 1: "tree", 2: "back", 3: "forward_or_cross", 4: "tree"}
    some = [(r["event"], r["id"]) for r in t.dfs_events(g, 0, ["discover_vertex"]).orderBy("seq").collect()]
    assert some == [("discover_vertex", str(k)) for k in range(4)]
    with pytest.raises(ValueError):
        t.dfs_events(g, 0, ["discover_vertx"])
    assert t.dfs(Graph.from_rows(spark, DISCONNECTED)).count() == 5


def test_topological_order(spark):
    g = Graph.from_rows(spark, DIAMOND)
    order = [r["id"] for r in t.topological_sort(g).orderBy("position").collect()]
    assert order[0] == 0 and order[-1] == 3 and sorted(order) == [0, 1, 2, 3]
    assert column(t.topological_layers(g), "layer") == {0: 0, 1: 1, 2: 1, 3: 2}
    assert [r["id"] for r in t.topological_sort(g, sources=1).orderBy("position").collect()] == [1, 3]
    c = Graph.from_rows(spark, CYCLE)
    with pytest.raises(CycleError):
        t.topological_sort(c)
    with pytest.raises(CycleError) as e:
        t.topological_layers(Graph.from_rows(spark, [(9, 0), (0, 1), (1, 2), (2, 1), (2, 3)]))
    assert e.value.vertex in (1, 2)
    assert t.is_acyclic(g) and not t.is_acyclic(c) and not t.is_acyclic(Graph.from_rows(spark, [(0, 0)]))
    assert t.topological_sort(c, safe=False).count() == 5
    assert t.topological_edges(g).count() == 4


def test_reverse_visits(spark):
    g = Graph.from_rows(spark, DIAMOND)
    assert {r["id"] for r in t.dfs(g, 1, reverse=True).collect()} == {0, 1} and {r["id"] for r in t.dfs(g, 1).collect()} == {1, 3}
    back = [r["id"] for r in t.topological_sort(g, reverse=True).orderBy("position").collect()]
    assert back[0] == 3 and back[-1] == 0 and sorted(back) == [0, 1, 2, 3]
    classes = [r["class"] for r in t.dfs_edges(g, 3, reverse=True).collect()]
    assert sorted(classes) == ["forward_or_cross", "tree", "tree", "tree"]
    some = t.dfs_events(g, 3, ["discover_vertex"], reverse=True).orderBy("seq").collect()
    assert some[0]["vertex"] == 3 and some[0]["id"] == "3" and {r["vertex"] for r in some} == {0, 1, 2, 3}


def visited(edges, n, source):
    """Events by a queue: (event, vertex, edge number) in order."""
    import heapq

    best, seen, out = {source: 0.0}, set(), [("initialize_vertex", v, None) for v in range(n)] + [("discover_vertex", source, None)]
    queue = [(0.0, source)]
    while queue:
        d, u = heapq.heappop(queue)
        if u in seen:
            continue
        seen.add(u)
        out.append(("examine_vertex", u, None))
        for e, (a, b, w) in enumerate(edges):
            if a == u:
                out.append(("examine_edge", u, e))
                if b not in best or d + w < best[b]:
                    out.append(("edge_relaxed", u, e))
                    if b not in best:
                        out.append(("discover_vertex", b, e))
                    best[b] = d + w
                    heapq.heappush(queue, (d + w, b))
                else:
                    out.append(("edge_not_relaxed", u, e))
        out.append(("finish_vertex", u, None))
    return out


def test_dijkstra_events_against_a_queue(spark):
    import random

    draw = random.Random(5)
    for edges, n in ((ROUTES, 5), ([(draw.randrange(30), draw.randrange(30), draw.randint(1, 9)) for _ in range(120)], 30)):
        g = Graph.from_edges(spark.createDataFrame([(a, b, e, w) for e, (a, b, w) in enumerate(edges)], "src long, dst long, eid long, value long"), n_vertices=n)
        found = [(r["event"], r["id"], r["eid"]) for r in t.dijkstra_events(g, 0, "value").orderBy("seq").collect()]
        assert found == visited(edges, n, 0)
    g = Graph.from_rows(spark, ROUTES)
    assert {r["event"] for r in t.dijkstra_events(g, 0, "value", ["finish_vertex"]).collect()} == {"finish_vertex"}
    with pytest.raises(ValueError):
        t.dijkstra_events(g, 0, "value", ["finished"])
    with pytest.raises(OutOfRange):
        t.dijkstra_events(Graph.from_rows(spark, [(0, 1, 0)]), 0, "value")


def test_looking_for_a_cycle_ends_with_the_longest_path(spark, monkeypatch):
    star = Graph.from_rows(spark, [(0, k, -1) for k in range(1, 300)] + [(7, 300, 1), (300, 301, 1)])
    names = []
    monkeypatch.setattr(t, "written", lambda df, name, f=t.written: (names.append(name), f(df, name))[1])
    paths, cycle = t.bellman_ford(star, 0, "value")
    assert cycle is None and {r["id"]: r["distance"] for r in paths.collect()}[301] == 1
    assert names.count("hops") <= 9  # three looks of a few jumps, not of as many as halve 300 vertices
    assert t.bellman_ford(Graph.from_rows(spark, [(0, 1, 1), (1, 2, -2), (2, 3, 0), (3, 1, 1), (1, 4, 0), (4, 5, 0), (0, 6, 0)]), 0, "value")[1] in (1, 2, 3)
    assert t.bellman_ford(Graph.from_rows(spark, [(0, 0, -1), (0, 1, 1)]), 0, "value")[1] == 0


def test_large_trees_are_visited_without_the_kernel(spark, monkeypatch):
    import random

    r = random.Random(4)
    edges = [(r.randrange(k), k) for k in range(1, 60)]  # a tree from 0
    edges += [(100 + a, 100 + b) for a, b in edges if b < 20] + [(115, 100)]  # with a cycle: not a tree
    edges += [(205, 200), (205, 203), (203, 204)]  # a tree, but not from its smallest id
    edges += [(300 + k, 301 + k) for k in range(20)]  # deeper than rounds go
    monkeypatch.setattr(t.forests, "MOST_LEVELS", 16)
    r.shuffle(edges)
    g = Graph.from_rows(spark, edges)
    tree = Graph.from_rows(spark, [e for e in edges if e[1] < 60])
    rows = lambda df: sorted(map(str, df.collect()))
    asked = [lambda: t.dfs(g), lambda: t.dfs(g, 205), lambda: t.dfs_edges(g), lambda: t.dfs_edges(g, 0), lambda: t.topological_sort(tree), lambda: t.topological_sort(tree, 2)]
    want = [rows(f()) for f in asked]
    monkeypatch.setattr(t, "LARGE", 3)
    assert [rows(f()) for f in asked] == want
    with pytest.raises(CycleError):
        t.topological_sort(g)
    monkeypatch.setattr(t.kernels, "depth_first", None)
    assert rows(t.dfs(tree)) == rows(t.dfs(tree, 0))
