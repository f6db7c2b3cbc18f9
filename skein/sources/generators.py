"""Seeded graph generators as DataFrames of (src, dst, weight, eid).

Randomness is counted, not drawn: each number is a hash of the seed, a stream and
the row's own counters, so a graph does not depend on how it is partitioned and a
lost task makes the same rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.scratch import written

WEIGHTS = ("uniform", "exponential", "constant_one")
SPAN = 1 << 52


def uniform(seed: int, stream: str, *counters: Column | str) -> Column:
    """A number in [0, 1), the same for the same seed, stream and counters."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *counters), F.lit(SPAN)) / F.lit(float(SPAN))


def below(n: Column | int, seed: int, stream: str, *counters: Column | str) -> Column:
    """An integer from 0 to n - 1."""
    top = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(uniform(seed, stream, *counters) * top), top - 1).cast("long")


def _weighted(edges: DataFrame, seed: int, weights: str) -> DataFrame:
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {WEIGHTS}")
    u = uniform(seed, "weight", "src", "dst", "eid")
    w = {"uniform": 1 + 99 * u, "exponential": 1 - F.log(1 - u) / 0.1, "constant_one": F.lit(1.0)}[weights]
    return edges.select("src", "dst", w.alias("weight"), "eid")


def _finished(pairs: DataFrame, seed: int, weights: str, n: int) -> DataFrame:
    """Pairs, at most one of each kind, numbered by what they are."""
    return _weighted(pairs.select("src", "dst", (F.col("src") * F.lit(n) + F.col("dst")).alias("eid")), seed, weights)


def path_graph(spark: SparkSession, n: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """0 to 1 to 2 and so on: n - 1 edges."""
    return _weighted(spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("id").alias("eid")), seed, weights)


def grid_2d(spark: SparkSession, rows: int, columns: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """A lattice with edges both ways between neighbours; vertex r * columns + c."""
    cell = spark.range(rows * columns).select("id", F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    step = lambda test, to: F.when(test, F.col("id") + to)
    near = F.array(step(F.col("r") > 0, -columns), step(F.col("c") > 0, -1), step(F.col("c") < columns - 1, 1), step(F.col("r") < rows - 1, columns))
    pairs = cell.select(F.col("id").alias("src"), F.explode(near).alias("dst")).filter("dst is not null")
    return _finished(pairs, seed, weights, rows * columns)


def complete_graph(spark: SparkSession, n: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Every ordered pair of different vertices."""
    return _finished(spark.range(n * (n - 1) if n > 1 else 0).select(*_decoded(F.col("id"), n)), seed, weights, max(1, n))


def _decoded(k: Column, n: int) -> tuple[Column, Column]:
    """The k-th ordered pair of different vertices."""
    u, r = F.floor(k / F.lit(n - 1)).cast("long"), (k % F.lit(n - 1)).cast("long")
    return u.alias("src"), F.when(r >= u, r + 1).otherwise(r).alias("dst")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Each ordered pair of different vertices with probability p.

    A vertex's targets are found by geometric skips from one to the next, so work is that of the edges, not of the pairs.
    """
    if not 0 <= p <= 1:
        raise ValueError("a probability is between 0 and 1")
    if n <= 1 or p == 0:
        return path_graph(spark, 0, seed, weights)
    if p == 1:
        return complete_graph(spark, n, seed, weights)
    # blocks of some targets each, so that no vertex's skips run in one long row
    width = max(1, min(n - 1, math.ceil(64 / p)))
    blocks = math.ceil((n - 1) / width)
    start = spark.range(n * blocks).select(F.floor(F.col("id") / blocks).alias("src"), (F.col("id") % blocks).alias("b"))
    # more draws than a block can need but once in some 10^9 times; what is beyond the block is left out
    draws = int(width * p + 7 * math.sqrt(width * p) + 40)
    skip = lambda i: 1 + F.floor(F.log(1 - uniform(seed, "skip", F.col("src"), F.col("b"), i)) / math.log(1 - p))
    gaps = start.select("src", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(min(draws, width) if width <= 64 else draws)), skip)).alias("i", "gap"))
    at = gaps.select("src", "b", (F.sum("gap").over(Window.partitionBy("src", "b").orderBy("i")) - 1).alias("at")).filter(F.col("at") < width)
    k = (F.col("b") * width + F.col("at")).cast("long")
    pairs = at.filter(k < n - 1).select("src", F.when(k >= F.col("src"), k + 1).otherwise(k).alias("dst"))
    return _finished(pairs, seed, weights, n)


def erdos_renyi_gnm(spark: SparkSession, n: int, m: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Exactly min(m, n (n - 1)) different ordered pairs.

    Counters are permuted over all pairs by a keyed bijection (four rounds on two halves, walked until inside), so no two are equal.
    """
    total = n * (n - 1) if n > 1 else 0
    m = min(m, total)
    if not m:
        return path_graph(spark, 0, seed, weights)
    half = max(1, math.ceil(math.log2(max(2, total)) / 2))
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for r in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), right).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    # the domain is less than four times the pairs: a walk is that many steps on average, and 200 steps outside have a chance of 10^-25
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), once(F.col("id")), lambda k, _: F.when(k < total, k).otherwise(once(k)))
    done = spark.range(m).select("id", walked.alias("k"))
    return _finished(done.select(*_decoded(F.col("k"), n)), seed, weights, n)


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Growth by preferential attachment, edges both ways: a seed clique of max(m, 2) vertices, then each new vertex joins m different earlier ones.

    Each new edge end copies the end of a uniformly drawn earlier one; a copy of a copy is resolved by hashing on,
    without any state (Sanders and Schulz, 2016). A vertex that draws a target again draws on, up to 32 more
    for each edge (a shortage has a chance of m 10^-14 at the first new vertex, the likeliest to have one).
    What others copy is an edge's first draw. A vertex is one row, so nothing is shuffled.
    """
    clique = min(n, max(m, 2))
    base = complete_graph(spark, clique, seed, weights).select("src", "dst")
    if n <= clique or m < 1:
        return _finished(base, seed, weights, max(1, n))
    fixed = clique * (clique - 1)  # ends that the clique's pairs hold, each pair two

    # positions: 0 to fixed - 1 are the clique's ends, then two for each new edge: its source and its target
    def draw(e: Column, t: Column) -> Column:
        return below(fixed + 2 * (e - (e % m)), seed, "attach", e, t)

    def target(e: Column, t: Column) -> Column:
        # a chain of copies halves its position each time on average: it is folded in one expression of bounded length
        hop = lambda at, _: F.when((at >= fixed) & ((at - fixed) % 2 == 1), draw(F.floor((at - fixed) / 2).cast("long"), F.lit(0))).otherwise(at)
        at = F.aggregate(F.sequence(F.lit(1), F.lit(96)), draw(e, t), hop)
        found = F.transform(F.array(at), lambda p: F.when(p < fixed, p % clique).otherwise(F.floor(F.floor((p - fixed) / 2) / m) + clique).cast("long"))
        return found[0]

    def targets(tries: Column) -> Column:
        return F.flatten(F.transform(tries, lambda t: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: target((F.col("id") - clique) * m + j, t))))

    first = spark.range(clique, n).select("id", F.array_distinct(targets(F.array(F.lit(0)))).alias("t"))
    more = F.slice(F.array_distinct(F.concat("t", targets(F.sequence(F.lit(1), F.lit(32))))), 1, m)
    grown = first.select(F.col("id").alias("src"), F.explode(F.when(F.size("t") == m, F.col("t")).otherwise(more)).alias("dst"))
    pairs = base.unionByName(grown).unionByName(grown.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _finished(pairs, seed, weights, n)


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """A ring in which each vertex joins k / 2 on either side (less than half the ring); an edge's far end is redrawn with probability beta.

    Edges both ways, no loops, none twice. Edges that stay have their place first. The others draw a free
    pair, up to 33 times; of edges that draw the same one, the first of the ring gets it. An edge that finds none goes
    back to its place on the ring, or is left out where another edge has taken that.
    """
    half = min(k // 2, (n - 1) // 2)
    if n < 2 or half < 1:
        return path_graph(spark, 0, seed, weights)
    slots = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(half))).alias("j"))
    slots = slots.withColumn("moves", uniform(seed, "coin", "u", "j") < beta)

    def pair(v: Column) -> tuple[Column, Column]:
        return F.least("u", v).cast("long").alias("a"), F.greatest("u", v).cast("long").alias("b")

    ring = (F.col("u") + F.col("j")) % n
    taken = slots.filter(~F.col("moves")).select(*pair(ring))
    waiting = slots.filter("moves").select("u", "j")
    for t in range(34):
        far = ring if t == 33 else (F.col("u") + 1 + below(n - 1, seed, "rewire", "u", "j", F.lit(t))) % n
        drawn = waiting.select("u", "j", *pair(far))
        clash = taken.join(drawn.select("a", "b").distinct(), ["a", "b"]).withColumn("held", F.lit(True))
        # few edges draw the same pair, unless nearly all pairs are taken
        turn = F.row_number().over(Window.partitionBy("a", "b").orderBy("u", "j"))
        tried = written(drawn.withColumn("turn", turn).join(clash, ["a", "b"], "left").select("u", "j", "a", "b", ((F.col("turn") == 1) & F.col("held").isNull()).alias("won")), "rewired")
        taken = taken.unionByName(tried.filter("won").select("a", "b"))
        waiting = tried.filter("not won").select("u", "j")
        if waiting.isEmpty():
            break
    return _finished(taken.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*"), seed, weights, n)


def rmat(spark: SparkSession, scale: int, m: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, d: float = 0.05, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """m draws of a pair of 2^scale vertices, quadrant by quadrant; loops and repeated pairs are left out."""
    total = a + b + c + d
    a, b, c = a / total, b / total, c / total
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(scale - 1)), F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")),
        lambda acc, i: _quadrant(acc, uniform(seed, "rmat", F.col("id"), i), a, b, c),
    ) if scale else F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))
    pairs = spark.range(m).select(bits.alias("p")).select(F.col("p.u").alias("src"), F.col("p.v").alias("dst")).filter("src != dst").distinct()
    return _finished(pairs, seed, weights, 1 << scale)


def _quadrant(acc: Column, x: Column, a: float, b: float, c: float) -> Column:
    down, right = (x >= a + b).cast("long"), (((x >= a) & (x < a + b)) | (x >= a + b + c)).cast("long")
    return F.struct((acc["u"] * 2 + down).alias("u"), (acc["v"] * 2 + right).alias("v"))


def plod(spark: SparkSession, n: int, alpha: float, beta: float, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Power-law out-degrees: vertex credits max(1, floor(beta x^-alpha n)) for a random rank x, spent on uniform targets within 4 credits + 8 tries; no loops, none twice."""
    if n < 2:
        return path_graph(spark, 0, seed, weights)
    x = 1 + below(n, seed, "rank", "id")
    credit = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.floor(beta * F.pow(x, -alpha) * n))).cast("int")
    tries = spark.range(n).select("id", credit.alias("c")).select("id", "c", F.explode(F.sequence(F.lit(1), F.col("c") * 4 + 8)).alias("i"))
    drawn = tries.select("id", "c", "i", below(n, seed, "target", "id", "i").alias("v")).filter("v != id").groupBy("id", "c", "v").agg(F.min("i").alias("i"))
    kept = drawn.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("i"))).filter("k <= c")
    return _finished(kept.select(F.col("id").alias("src"), F.col("v").alias("dst")), seed, weights, n)


def _starts(sizes: DataFrame, rows: int, block: int = 1024) -> DataFrame:
    """(k, lo): the sum of the sizes s before each k from 0 to rows - 1, summed in blocks, over blocks of blocks and so on."""
    if rows <= block:
        return sizes.select("k", (F.sum("s").over(Window.orderBy("k")) - F.col("s")).alias("lo"))
    local = sizes.select("k", "s", F.floor(F.col("k") / block).alias("b"))
    local = local.withColumn("t", F.sum("s").over(Window.partitionBy("b").orderBy("k")))
    above = _starts(local.groupBy(F.col("b").alias("k")).agg(F.sum("s").alias("s")), -(-rows // block), block)
    return local.join(above.withColumnsRenamed({"k": "b", "lo": "o"}), "b").select("k", (F.col("o") + F.col("t") - F.col("s")).alias("lo"))


def ssca(spark: SparkSession, n: int, max_clique: int, p_inter: float, max_parallel: int, seed: int = 42, weights: str = "uniform") -> DataFrame:
    """Consecutive cliques of 1 to ``max_clique`` vertices whose ordered pairs have 1 to ``max_parallel`` parallel edges, and links between cliques.

    A vertex has at most one link, with probability ``p_inter``: of 16 uniform candidates the first that is accepted,
    in another clique with a chance of 2^-(distance of the cliques); after those, any vertex of another clique.
    """
    if n < 1:
        return path_graph(spark, 0, seed, weights)
    max_clique, max_parallel = max(1, max_clique), max(1, max_parallel)
    cliques = spark.range(n).select(F.col("id").alias("k"), (below(max_clique, seed, "size", "id") + 1).alias("s"))
    spans = _starts(cliques, n).join(cliques, "k").select("k", "lo", F.least(F.col("lo") + F.col("s"), F.lit(n)).alias("hi")).filter(F.col("lo") < n)
    members = written(spans.select("k", "lo", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("u")), "cliques")
    others = members.select("k", "u", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("v")).filter("u != v")
    inside = others.select("u", "v", F.explode(F.sequence(F.lit(1), (below(max_parallel, seed, "parallel", "u", "v") + 1).cast("int"))).alias("i"))
    linked = members.filter(uniform(seed, "inter", "u") < p_inter).select("u", "k", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i"))
    tried = linked.withColumn("v", below(n, seed, "link", "u", "i")).join(members.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").filter("k != kv")
    chance = F.pow(F.lit(2.0), -F.least(F.abs(F.col("k") - F.col("kv")), F.lit(30)))
    accepted = tried.filter((F.col("i") == 16) | (uniform(seed, "accept", "u", "i") < chance))
    between = accepted.groupBy("u").agg(F.min_by("v", "i").alias("v")).select("u", "v", F.lit(0).alias("i"))
    edges = inside.unionByName(between)
    numbered = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), ((F.col("u") * F.lit(n) + F.col("v")) * F.lit(max_parallel + 1) + F.col("i")).alias("eid"))
    return _weighted(numbered, seed, weights)
