"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits at the median projection, on a random direction for each of its
levels. A query runs down all trees through one shared priority queue: a node costs
what the splits above it speak against a neighbour lying there (minus the logarithm
of a logistic chance in the margin), so that the likeliest leaf of any tree comes
next. Costs only grow downwards, so the queue hands out leaves in ascending cost,
and a batch of queries finds the same leaves by sorting, which is how it is done
here (a test holds both against each other). The candidates in the leaves are
reranked exactly, in double precision.

The forest is fitted on a bounded sample (at most ``most_sample`` vectors, those
with the smallest key hash); every row is indexed. How many leaves a query opens
is set on the sample, too: as few as find ``target`` of its true neighbours. Leaves
that hold more than ``leaf_rows`` rows, as they do in tables far larger than the
sample, are split on from their own rows where they are met.

A query's k best of the sample are candidates, too, beside those in the leaves: so no
query returns fewer than ``k`` rows while there are as many candidates. The k-th best
of them is a lower bound of its k-th best of all, so that partial results below it
are never emitted.

Work is dealt by cells (subtrees) of bounded size: cells that hold more rows than
``block_rows``, or are opened by more queries, are split into blocks, each pair of
which multiplies the rows of each leaf with the queries that open it. Of equal
vectors only the ``k + 1`` smallest keys are candidates, as the others cannot be
among a query's ``k`` nearest; so no group of copies grows large.

Vectors that are null, zero, of another length than most of the sample, or hold
null or non-finite components take no part, nor do null keys. Repeated keys count
once each as candidates. Ties go to the smaller key. Fewer than ``k`` candidates:
all are returned; an empty table gives no rows. Other columns are not read but by
``queries``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import slices, written

#: Pairs that a task holds before it keeps each query's best only. What part of the chance in a leaf its split parts must hold to be opened.
MOST_PAIRS, INSIDE = 400_000, 0.985


def against(margin: np.ndarray) -> np.ndarray:
    """What a margin costs on the side it speaks for."""
    return np.logaddexp(0, -margin)


class Forest:
    """Trees of equal depth; node ``i`` of a level has the children ``2 i`` and ``2 i + 1`` of the next. All nodes of a level share a direction."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        g = np.random.default_rng(seed)
        self.trees, self.depth, self.sharpness = trees, depth, 1.0
        self.directions = g.normal(size=(trees, depth, sample.shape[1]))
        self.directions /= np.maximum(np.linalg.norm(self.directions, axis=2, keepdims=True), 1e-300)
        self.medians: list[list[np.ndarray]] = []
        for t in range(trees):
            at, medians = np.zeros(len(sample), np.int64), []
            for level, p in enumerate((sample @ self.directions[t].T).T):
                order = np.lexsort((p, at))
                ends = np.searchsorted(at[order], np.arange(1 << level), "right")
                starts = np.concatenate([[0], ends[:-1]])
                low, high = p[order[np.minimum((starts + ends - 1) // 2, len(p) - 1)]], p[order[np.minimum((starts + ends) // 2, len(p) - 1)]]
                medians.append(np.where(ends > starts, (low + high) / 2, 0.0))
                at = 2 * at + (p > medians[-1][at])
            self.medians.append(medians)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for p, m in zip((x @ self.directions[t].T).T, self.medians[t], strict=True):
                out[:, t] = 2 * out[:, t] + (p > m[out[:, t]])
        return out

    def costs(self, x: np.ndarray) -> np.ndarray:
        """What each leaf of each tree costs each query: queries, trees * leaves."""
        out = []
        for t in range(self.trees):
            cost = np.zeros((len(x), 1))
            for p, m in zip((x @ self.directions[t].T).T, self.medians[t], strict=True):
                margin = self.sharpness * (p[:, None] - m)
                cost = (np.stack([against(-margin), against(margin)], 2) + cost[:, :, None]).reshape(len(x), -1)
            out.append(cost)
        return np.concatenate(out, 1)

    def opened(self, x: np.ndarray, budget: int) -> np.ndarray:
        """The ``budget`` leaves that the shared queue hands each query first, as a mask over trees * leaves."""
        cost = self.costs(x)
        out = np.zeros(cost.shape, bool)
        if budget >= cost.shape[1]:
            out[:] = True
        else:
            np.put_along_axis(out, np.argpartition(cost, budget, axis=1)[:, :budget], True, 1)
        return out

    def within(self, x: np.ndarray, q: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """A large leaf's rows split on from themselves: the part of each row, and which parts each query opens."""
        inner = Forest(x, 1, int(np.ceil(np.log2(len(x) / leaf_rows))), seed=len(x))
        inner.sharpness = self.sharpness
        chance = np.exp(-inner.costs(q))
        order = np.argsort(-chance, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
        enough = np.zeros(chance.shape, bool)
        np.put_along_axis(enough, order, np.concatenate([np.zeros((len(q), 1)), held[:, :-1]], 1) < INSIDE * held[:, -1:], 1)
        return inner.leaves(x)[:, 0], enough


def calibrate(forest: Forest, sample: np.ndarray, k: int, target: float, n_queries: int = 192) -> int:
    """Sets how sharply margins tell sides apart, and gives the smallest number of leaves that finds ``target`` of the sample's true neighbours."""
    total = forest.trees << forest.depth
    if len(sample) <= k + 1 or not forest.depth:
        return total
    queries = np.arange(0, len(sample), max(1, len(sample) // n_queries))
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    leaf = forest.leaves(sample) + (np.arange(forest.trees) << forest.depth)
    spread = float((sample @ forest.directions[:, 0].T).std()) or 1.0
    found = []
    for sharpness in (0.25, 0.5, 1.0, 2.0, 4.0):
        forest.sharpness = sharpness / spread
        order = np.argsort(np.argsort(forest.costs(sample[queries]), axis=1), axis=1)  # when each leaf is opened
        first = np.min(np.stack([np.take_along_axis(order, leaf[true, t], 1) for t in range(forest.trees)]), axis=0)
        found.append((min(total, int(np.quantile(first.ravel(), target)) + 1), forest.sharpness))
    budget, forest.sharpness = min(found)
    return budget


def fit(rows: DataFrame, n: int, k: int, trees: int, leaf_rows: int, most_sample: int, target: float) -> tuple[Forest, int, int, np.ndarray, np.ndarray] | None:
    """The forest, the budget of leaves, the vectors' length, and keys and vectors of the sample's candidates."""
    keys = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(most_sample)
    # at most most_sample keys: a proven bound
    found = rows.join(F.broadcast(keys), "_id", "left_semi").select("_id", "_v").limit(2 * most_sample).toPandas().sort_values("_id")
    if found.empty:
        return None
    dim = Counter(len(v) for v in found["_v"]).most_common(1)[0][0]
    found = found[[len(v) == dim for v in found["_v"]]].drop_duplicates("_id")
    ids, sample = found["_id"].to_numpy(np.int64), np.array(list(found["_v"]), np.float64)
    group = np.unique(sample, axis=0, return_inverse=True)[1].ravel()
    few = found.groupby(group).cumcount().to_numpy() <= k  # of equal vectors the k + 1 smallest keys, as of all rows
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf_rows)))), int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest(sample, trees, depth)
    return forest, calibrate(forest, sample, k, target), dim, ids[few], sample[few]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Best:
    """Each query's ``k`` best pairs so far, by exact score and then by key; ``bound``: what a score must reach to matter."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray):
        self.q, self.x, self.ids, self.k, self.bound = q, x, ids, k, bound.copy()
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, who: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Pairs of queries and rows by their matrix of scores, which may be rounded otherwise than the exact ones."""
        r, c = np.nonzero(scores >= self.bound[who][:, None])
        for at in range(0, len(r), MOST_PAIRS):
            self.waiting.append((who[r[at : at + MOST_PAIRS]], rows[c[at : at + MOST_PAIRS]]))
            self.n += len(self.waiting[-1][0])
            if self.n > MOST_PAIRS:
                self.settle()

    def settle(self) -> None:
        parts = [self.kept]
        for r, j in self.waiting:
            for at in range(0, len(r), 50_000):
                a, b = r[at : at + 50_000], j[at : at + 50_000]
                parts.append((a, self.ids[b], (self.q[a] * self.x[b]).sum(1)))
        self.waiting, self.n = [], 0
        r, j, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((j, -score, r))
        r, j, score = r[order], j[order], score[order]
        new = np.ones(len(r), bool)  # a row that several leaves hold counts once
        new[1:] = (r[1:] != r[:-1]) | (j[1:] != j[:-1])
        r, j, score = r[new], j[new], score[new]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        full = rank == self.k - 1
        self.bound[r[full]] = np.maximum(self.bound[r[full]], lowered(score[full]))
        self.kept = (r[rank < self.k], j[rank < self.k], score[rank < self.k])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries' rows, keys and exact scores, best first."""
        self.settle()
        return self.kept


def lowered(score: np.ndarray) -> np.ndarray:
    """A score less what rounding may take."""
    return score - 1e-9 * np.abs(score) - 1e-12


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = 8, leaf_rows: int = 128, most_sample: int = 8192, target: float = 0.92, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, the neighbour's key and score (inner product) of the rows for which ``queries`` holds, against all others."""
    spark = vectors.sparkSession
    # floats stay floats until they are multiplied
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast(f"array<{kind}>").alias("_v"), queries.alias("_q")).filter(F.col("_id").isNotNull() & _usable(F.col("_v")))
    out_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    n = rows.count()
    fitted = fit(rows, n, k, trees, leaf_rows, most_sample, target) if n else None
    if fitted is None:
        return spark.createDataFrame([], out_schema)
    forest, budget, dim, sample_ids, sample = fitted
    copies = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    candidates = rows.filter(F.size("_v") == dim).select("_id", "_v").withColumn("_n", copies).filter(F.col("_n") <= k + 1).select("_id", "_v")
    # cells are subtrees of about block_rows rows, so that a task's product is large and its partial results are few
    levels = min(forest.depth, max(0, int(np.ceil(np.log2(max(1, n / block_rows))))))
    below = forest.depth - levels

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            leaves = forest.leaves(_matrix(batch.column(1), dim))
            for t in range(forest.trees):
                yield pa.RecordBatch.from_arrays([pa.array((t << levels) + (leaves[:, t] >> below), pa.int32()), pa.array(leaves[:, t] & ((1 << below) - 1), pa.int32()), batch.column(0), batch.column(1)], names=["cell", "leaf", "id", "v"])

    def to_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 256):
            x = _matrix(some.column(1), dim)
            scores = x @ sample.T
            scores[some.column(0).to_numpy()[:, None] == sample_ids] = -np.inf
            bound = np.full(len(x), -1e308)
            if len(sample) > k:
                bound = np.maximum(bound, lowered(np.partition(scores, -k, axis=1)[:, -k]))
            best = Best(x, sample, sample_ids, k, bound)
            best.add(np.arange(len(x)), np.arange(len(sample)), scores)
            r, ids, exact = best.pairs()
            ends = np.cumsum(np.bincount(r, minlength=len(x)))
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(a)) for a in (ids, exact)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(best.bound), *lists], names=["query", "v", "bound", "id", "score"])

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x = _matrix(batch.column(1), dim)
            for at in range(0, len(x), 256):
                mask = forest.opened(x[at : at + 256], budget).reshape(len(x[at : at + 256]), forest.trees << levels, 1 << below)
                for cell in range(forest.trees << levels):
                    who = np.flatnonzero(mask[:, cell].any(1))
                    if len(who):
                        take = pa.array(who + at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), cell), pa.int32()), *(batch.column(c).take(take) for c in range(3)), pa.array([m.tobytes() for m in np.packbits(mask[who, cell], axis=1)], pa.binary())], names=["cell", "query", "v", "bound", "open"])

    index = written(candidates.mapInArrow(to_cells, f"cell int, leaf int, id long, v array<{kind}>"), "ann-index")
    asked = written(rows.filter((F.size("_v") == dim) & F.col("_q")).select("_id", "_v").mapInArrow(to_asked, f"query long, v array<{kind}>, bound double, id array<long>, score array<double>"), "ann-queries")
    visits = written(asked.select("query", "v", "bound").mapInArrow(to_visits, f"cell int, query long, v array<{kind}>, bound double, open binary"), "ann-visits")
    # one row for each cell: at most trees * 2 ** levels of them
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_rows")).join(visits.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_queries")), "cell")
    sizes = F.broadcast(written(sizes.coalesce(1), "ann-sizes"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.join(sizes, "cell").withColumn("rb", F.pmod(F.xxhash64("id"), F.col("n_rows")).cast("int")).select("cell", "rb", spread(F.col("n_queries")).alias("qb"), "leaf", "id", "v")
    right = visits.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("n_queries")).cast("int")).select("cell", "qb", spread(F.col("n_rows")).alias("rb"), "query", "v", "bound", "open")

    def product(rows: pa.Table, visits: pa.Table) -> pa.Table:
        if not rows.num_rows or not visits.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows = rows.sort_by([("leaf", "ascending"), ("id", "ascending")])
        x, q = _matrix(rows["v"], dim), _matrix(visits["v"], dim)
        ids, leaf, who = rows["id"].to_numpy(), rows["leaf"].to_numpy(), visits["query"].to_numpy()
        open_ = np.unpackbits(np.frombuffer(b"".join(visits["open"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, : 1 << below].astype(bool)
        best = Best(q, x, ids, k, visits["bound"].to_numpy())

        def multiply(asked: np.ndarray, some: np.ndarray) -> None:
            for at in range(0, len(asked), 1024):
                a = asked[at : at + 1024]
                scores = q[a] @ x[some].T
                scores[who[a][:, None] == ids[some]] = -np.inf
                best.add(a, some, scores)

        for value in np.unique(leaf):
            some = np.arange(np.searchsorted(leaf, value), np.searchsorted(leaf, value, "right"))
            asked = np.flatnonzero(open_[:, value])
            if len(some) <= 2 * leaf_rows or not len(asked):
                multiply(asked, some)
                continue
            part, enough = forest.within(x[some], q[asked], leaf_rows)
            for p in np.unique(part):
                multiply(asked[enough[:, p]], some[part == p])
        r, near, exact = best.pairs()
        return pa.table({"query_id": who[r], "id": near, "score": exact})

    found = left.groupBy("cell", "rb", "qb").cogroup(right.groupBy("cell", "rb", "qb")).applyInArrow(product, "query_id long, id long, score double")
    found = found.unionByName(asked.select(F.col("query").alias("query_id"), F.inline(F.arrays_zip("id", "score"))))
    # the same pair scores equally in every tree, so copies share a dense rank
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("query_id", "rank").agg(F.first("id").alias(key), F.first("score").alias("score"))
