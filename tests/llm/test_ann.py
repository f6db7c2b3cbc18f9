import math

import numpy as np
from pyspark.sql import functions as F

from skein.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, queries, k):
    kept = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None}
    out = {}
    for q in queries:
        scores = sorted((-(kept[q] * v).sum(), i) for i, v in kept.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_recall_and_exact_scores(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(3000, 16)) + 2 * g.normal(size=(30, 16))[g.integers(0, 30, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=10, most_sample=1024, leaf_rows=32, block_rows=256).toPandas()
    want = brute(rows, range(0, 3000, 20), 10)
    hits = 0
    for q, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and part["score"].is_monotonic_decreasing and q not in set(part["vec_id"])
        hits += len(set(part["vec_id"]) & {i for i, _ in want[q]})
        v = np.array(rows[q][1], np.float32).astype(float)
        assert np.allclose([(v * np.array(rows[i][1], np.float32).astype(float)).sum() for i in part["vec_id"]], part["score"], atol=1e-12)
    assert found["query_id"].nunique() == 150 and hits / 1500 >= 0.9


def test_every_query_returns_k_rows(spark):
    x = np.random.default_rng(3).normal(size=(2500, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    for some, k in ((df, 20), (df.filter("vec_id < 15"), 14)):
        found = ann.search(some, F.col("vec_id") % 20 == 0).toPandas()
        assert (found.groupby("query_id").size() == k).all() and found["query_id"].nunique() == (125 if k == 20 else 1)
    # a small sample leaves most rows to the leaves
    found = ann.search(df, F.col("vec_id") % 20 == 0, most_sample=300, target=0.3).toPandas()
    assert (found.groupby("query_id").size() == 20).all() and found["query_id"].nunique() == 125


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(500, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    for q, part in found.groupby("query_id"):
        want = [i for i in range(200) if i != q][:5] if q < 200 else [0, 1, 2, 3, 4]
        assert part.sort_values("rank")["vec_id"].tolist() == want


def test_ties_of_different_vectors_go_to_the_smaller_key(spark):
    g = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(k, [0.5, *g.normal(size=3).tolist()]) for k in range(1, 400)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    for sample in (8192, 64):  # whole, and leaves that find the rest
        found = ann.search(df.repartition(5), F.col("vec_id") == 0, most_sample=sample, target=1.0, leaf_rows=500 if sample == 64 else 16).orderBy("rank").collect()
        assert [r["vec_id"] for r in found] == list(range(1, 21)) and {r["score"] for r in found} == {0.5}


def test_large_leaves_are_split_from_their_own_rows(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(6000, 16)) + 3 * g.normal(size=(40, 16))[g.integers(0, 40, 6000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "") for r in rows] + [(20, rows[20][1], "again")], SCHEMA)
    # a sample of 128 allows 16 leaves a tree, of some 400 rows
    found = ann.search(df, F.col("vec_id") % 60 == 0, k=10, most_sample=128, leaf_rows=32, block_rows=4096).toPandas()
    want = brute(rows, range(0, 6000, 60), 10)
    hits = sum(len(set(part["vec_id"]) & {i for i, _ in want[q]}) for q, part in found.groupby("query_id"))
    assert (found.groupby("query_id").size() == 10).all() and hits / 1000 >= 0.9
    forest = ann.Forest(x, 1, 0)
    forest.sharpness = 2.0
    part, enough = forest.within(x[:400], x[400:450], 32)
    assert part.max() == 15 and 0 < enough.mean() < 0.9


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [math.nan, 1.0]), (80, [math.inf, 1.0]), (100, [1.0]), (None, [1.0, 1.0]), (3, [1.0, None]), (5, [0.5, 0.5]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    found = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 5), (0, 7)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_queue_order_by_a_heap():
    """Opening leaves from one priority queue over all trees gives the leaves that sorting gives."""
    import heapq

    g = np.random.default_rng(1)
    forest = ann.Forest(g.normal(size=(300, 6)), trees=3, depth=4)
    for x in g.normal(size=(5, 6)):
        heap, opened = [(0.0, t, 0, 0) for t in range(3)], []
        while heap and len(opened) < 11:
            cost, t, level, node = heapq.heappop(heap)
            if level == 4:
                opened.append((t << 4) + node)
                continue
            margin = forest.sharpness * (x @ forest.directions[t, level] - forest.medians[t][level][node])
            heapq.heappush(heap, (cost + np.log1p(np.exp(margin)), t, level + 1, 2 * node))
            heapq.heappush(heap, (cost + np.log1p(np.exp(-margin)), t, level + 1, 2 * node + 1))
        assert set(np.flatnonzero(forest.opened(x[None], 11)[0])) == set(opened)
