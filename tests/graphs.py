"""Known graphs: edge tuples (source, target[, weight])."""

PATH = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
CYCLE = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 0, 1)]
COMPLETE = [(a, b) for a in range(4) for b in range(4) if a != b]
STAR = [(0, k) for k in range(1, 5)]
TREE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
DIAMOND = [(0, 1, 5), (0, 2, 3), (1, 3, 2), (2, 3, 7)]
DISCONNECTED = [(0, 1), (2, 3), (3, 4)]
MULTI = [(0, 1, 10), (0, 1, 5), (1, 2, 3)]
ROUTES = [(0, 1, 10), (0, 3, 5), (1, 2, 1), (1, 3, 2), (2, 4, 4), (3, 1, 3), (3, 2, 9), (3, 4, 2), (4, 0, 7), (4, 2, 6)]
SPANNING = [(0, 1, 4), (0, 7, 8), (1, 2, 8), (1, 7, 11), (2, 3, 7), (2, 5, 4), (2, 8, 2), (3, 4, 9), (3, 5, 14), (4, 5, 10), (5, 6, 2), (6, 7, 1), (6, 8, 6), (7, 8, 7)]


def both(edges):
    return edges + [(e[1], e[0], *e[2:]) for e in edges]
