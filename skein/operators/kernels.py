"""Sequential kernels: algorithms whose result depends on the order of visits, over one component at a time.

Each takes vertices in ascending order and, of each vertex, the (target, edge)
pairs in the order of the edges. They hold one component in memory and are
iterative, so depth is no matter.
"""

from __future__ import annotations

from collections.abc import Iterable

Adjacency = dict[object, list[tuple[object, int]]]


def depth_first(vertices: Iterable, out: Adjacency, roots: Iterable) -> tuple[list[dict], list[tuple[int, str]], list[tuple[str, object, int | None]]]:
    """Visits from each root in turn: vertices (id, parent, edge, discover, finish, depth), edge classes, and events in order."""
    found: dict[object, dict] = {}
    classes: list[tuple[int, str]] = []
    events: list[tuple[str, object, int | None]] = []
    clock = 0
    for root in roots:
        if root in found:
            continue
        events += [("initialize_vertex", root, None), ("start_vertex", root, None), ("discover_vertex", root, None)]
        found[root] = {"id": root, "parent": None, "edge": None, "discover": clock, "finish": None, "depth": 0}
        clock += 1
        stack = [(root, iter(out.get(root, ())))]
        while stack:
            u, edges = stack[-1]
            for v, e in edges:
                events.append(("examine_edge", u, e))
                seen = found.get(v)
                if seen is None:
                    classes.append((e, "tree"))
                    events += [("tree_edge", u, e), ("finish_edge", u, e), ("discover_vertex", v, None)]
                    found[v] = {"id": v, "parent": u, "edge": e, "discover": clock, "finish": None, "depth": len(stack)}
                    clock += 1
                    stack.append((v, iter(out.get(v, ()))))
                    break
                kind = "back" if seen["finish"] is None else "forward_or_cross"
                classes.append((e, kind))
                events += [(f"{kind}_edge", u, e), ("finish_edge", u, e)]
            else:
                found[u]["finish"] = clock
                clock += 1
                events.append(("finish_vertex", u, None))
                stack.pop()
    return list(found.values()), classes, events


def topological(vertices: Iterable, out: Adjacency, roots: Iterable) -> tuple[list, object | None]:
    """The vertices reachable from the roots in reverse order of finishing, and a vertex that closes a cycle, if any."""
    rows, classes, events = depth_first(vertices, out, roots)
    target = {e: v for u in out for v, e in out[u]}
    cycle = next((target[e] for e, kind in classes if kind == "back"), None)
    return [r["id"] for r in sorted(rows, key=lambda r: -r["finish"])], cycle


def low_points(vertices: Iterable, out: Adjacency) -> tuple[set, list[list]]:
    """Cut vertices, and blocks (sorted lists of vertices) of a symmetric graph; parallel edges make a cycle, loops are no edges."""
    order: dict[object, int] = {}
    low: dict[object, int] = {}
    cuts: set = set()
    blocks: list[list] = []
    for root in sorted(vertices):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        path = [root]  # vertices not yet in a block
        children = 0
        stack = [[root, None, False, iter(out.get(root, ()))]]
        while stack:
            frame = stack[-1]
            u, parent = frame[0], frame[1]
            for v, _ in frame[3]:
                if v == u:
                    continue
                if v == parent and not frame[2]:
                    frame[2] = True  # the edge that led here; another one to the parent counts
                    continue
                if v in order:
                    low[u] = min(low[u], order[v])
                    continue
                order[v] = low[v] = len(order)
                path.append(v)
                stack.append([v, u, False, iter(out.get(v, ()))])
                break
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[u])
                if low[u] >= order[parent]:
                    block = [parent]
                    while True:
                        block.append(path.pop())
                        if block[-1] == u:
                            break
                    blocks.append(sorted(block))
                    if parent != root:
                        cuts.add(parent)
                    else:
                        children += 1
        if children > 1:
            cuts.add(root)
        if children == 0:
            blocks.append([root])
    return cuts, blocks


def strong_components(vertices: Iterable, out: Adjacency) -> list[list]:
    """Strongly connected components, sinks of the condensation first."""
    order: dict[object, int] = {}
    low: dict[object, int] = {}
    held: set = set()
    path: list = []
    found: list[list] = []
    for root in sorted(vertices):
        if root in order:
            continue
        stack = [(root, iter(out.get(root, ())))]
        order[root] = low[root] = len(order)
        path.append(root)
        held.add(root)
        while stack:
            u, edges = stack[-1]
            for v, _ in edges:
                if v not in order:
                    order[v] = low[v] = len(order)
                    path.append(v)
                    held.add(v)
                    stack.append((v, iter(out.get(v, ()))))
                    break
                if v in held:
                    low[u] = min(low[u], order[v])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
                if low[u] == order[u]:
                    part = []
                    while True:
                        part.append(path.pop())
                        held.discard(part[-1])
                        if part[-1] == u:
                            break
                    found.append(sorted(part))
    return found
