"""Exact n-gram Jaccard join by blocked sparse products of the document by n-gram incidence.

Documents with equal n-gram sets are one row of the incidence matrix. Two rows can
only reach the similarity if they share ``l`` columns among their first
``n - ceil(s n) + l``, in any one order of the columns (a size-derived bound, with
``l`` growing with the size: see ``least_shared``); columns go by ascending frequency, as far as a bounded
table of the most frequent ones tells, so that what many documents share comes last.
Rows with such columns are dealt to blocks - those of one hottest column together, in
blocks of bounded size - and multiplied in three steps. First each block by itself:
its components are known then. Where a hottest column has many blocks, one row of each
component (a representative) goes on to blocks of representatives, and so on while
that joins any. Last, two blocks are multiplied with those of their rows that share
enough first columns with a row of another component in the other block: what is one
component by then, as a large group of near copies is, is not compared again, and no
pair that could link two components is left out. In a product, overlap counts are
accumulated column by column (sparsely for rare columns, as a product of dense
slices for common ones) and compared with the bound that the two sizes give.

A product returns a spanning forest of its links only, so that a group of near
copies never becomes all its pairs; components of links are then contracted. Each step
writes a table and gives back the disk of what it shuffled.

A null or empty text, or one without words, has no n-grams and no links. Rows that
share a key are one document. A null key gets the component of its set's smallest
key, or null. An empty table gives no rows. A very long text is one row of the
incidence matrix, all of whose columns count. Columns of equal frequency (ties) go by
their hash. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import free_worker, fresh, give_back, slices, split_words
from skein.operators.components import min_labels
from skein.plans.scratch import freed_shuffles, remove, scratch_path, written

#: Bits of the filters that keep rows which are no copies from being looked up, and texts which share no column from being hashed again (2 MB).
FILTER_BITS = 1 << 24
ROWS = 2048
#: N-grams that are hashed at once, and that a task gathers before it counts them: what those steps need besides is several times as much.
SPAN, GATHERED = 1 << 16, 1 << 22
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * MULTIPLIERS[k % 4] + w


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; fewer words than ``n`` make one of all."""
    import xxhash

    number, distinct, offsets = split_words(pc.ascii_lower(fresh(texts)))
    distinct = distinct.cast(pa.large_binary()).to_pylist()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    bounds, flat = offsets.tolist(), words[number] if len(number) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for at in range(0, len(grams), SPAN):
            h = grams[at : at + SPAN]
            for k in range(n):
                h = _mix(h, flat[at + k : at + k + len(h)], k)
            grams[at : at + SPAN] = h ^ (h >> np.uint64(32))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64) * MULTIPLIERS[3]
                for k in range(a, b):
                    h = _mix(h, flat[k : k + 1], k - a)
                out.append(h ^ (h >> np.uint64(31)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n, percent: int, shared: int):
    """How many of its first columns a row of ``n`` shares with any as similar and no shorter: at least ``shared``, or a 32nd of them, so that chance is left behind."""
    return np.minimum(-(-percent * n // 100), np.maximum(shared, n // 32))


def known(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where among the sorted frequent hashes others are, and whether they are."""
    if not len(frequent):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return at, frequent[at] == hashes


def first_columns(sets: list[np.ndarray], frequent: np.ndarray, counts: np.ndarray, percent: int, shared: int = 1) -> list[np.ndarray]:
    """Of each set, the rarest hashes, of which a set as similar must share ``least_shared``."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at, there = known(flat, frequent)
    count = np.where(there, counts[at], 0) if len(frequent) else np.zeros(len(flat), np.int64)
    out, at = [], 0
    for s in sets:
        c, most = count[at : at + len(s)], len(s) - -(-percent * len(s) // 100) + int(least_shared(len(s), percent, shared))
        at += len(s)
        rare = s[c == 0]
        if len(rare) < most:
            common, k = s[c > 0], c[c > 0]
            rare = np.concatenate([rare, common[np.lexsort((common, k))]])
        out.append(rare[:most])
    return out


def column_counts(batches: Iterator[pa.RecordBatch], words: int, gathered: int = GATHERED) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of one task's n-grams, and of how many texts, counted from when one was first met twice among ``gathered``.

    What was met once so far is forgotten: the counts only order columns. Hashes lie in one buffer that is sorted in place,
    and only those that repeat are taken out of it, as two workers and a grown heap share an executor's memory.
    """
    columns, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room, used = np.empty(gathered, np.uint64), 0

    def settled() -> tuple[np.ndarray, np.ndarray]:
        some = room[:used]
        some.sort()
        again = some[1:] == some[:-1]
        edge = np.diff(again, prepend=False, append=False)  # where a run of equal ones begins, and where it ends
        runs = np.flatnonzero(edge).reshape(-1, 2)
        new, n = some[runs[:, 0]], runs[:, 1] - runs[:, 0] + 1
        total = counts + np.searchsorted(some, columns, "right") - np.searchsorted(some, columns, "left")
        more = ~known(new, columns)[1]
        at = np.searchsorted(columns, new[more])
        return np.insert(columns, at, new[more]), np.insert(total, at, n[more])

    for batch in slices(batches, ROWS):
        for s in ngram_sets(batch.column(0), words):
            if used + len(s) > len(room):
                columns, counts = settled()
                used = 0
                if len(s) > len(room):
                    room = np.empty(len(s), np.uint64)
            room[used : used + len(s)] = s
            used += len(s)
        give_back()
    if used:
        columns, counts = settled()
    return columns, counts


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int, dense_from: int = 9) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's sets: pairs of ids whose sets are as similar as ``percent``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if m < 2 or not sizes.sum():
        return []
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    count = np.bincount(column)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    overlap = np.zeros((m, m), np.int64)
    for k in np.unique(count[(count > 1) & (count < dense_from)]):
        rows = row[first[count == k][:, None] + np.arange(k)]  # columns, k: ascending in each
        for i in range(k):
            for j in range(i + 1, k):
                overlap += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).reshape(m, m)
    common = np.flatnonzero(count >= dense_from)
    for at in range(0, len(common), 2048):
        some = common[at : at + 2048]
        slice_ = np.zeros((m, len(some)), np.float32)
        for j, c in enumerate(some):
            slice_[row[first[c] : first[c] + count[c]], j] = 1
        overlap += np.rint(slice_ @ slice_.T).astype(np.int64)
    total = sizes[:, None] + sizes[None, :]
    a, b = np.nonzero(np.triu(100 * overlap >= percent * (total - overlap), 1) & (overlap > 0))
    label = np.arange(m)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[label[i]])) for i in range(m) if ids[label[i]] != ids[i]]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, shared: int = 3, block_rows: int = 512, most_frequent: int = 100_000, local_count: int = 8) -> DataFrame:
    """``key``, n_shingles and component_id of each row: links join documents whose n-gram sets have a Jaccard similarity of at least ``percent`` per cent.

    ``most_frequent`` bounds the table of frequent columns, which only orders columns: any table gives the same links.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        columns, counts = column_counts(batches, words)
        often = counts >= local_count
        yield pa.RecordBatch.from_arrays([pa.array(columns[often].view(np.int64)), pa.array(counts[often])], names=["s", "n"])

    met = _written(source.select("t").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "ngram-counts")
    power = F.floor(F.log2("n"))
    room, least = most_frequent, 64
    for row in met.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():  # at most 64 rows
        if row["count"] > room:
            break
        room, least = room - row["count"], row["p"]
    found = met.filter(power >= least).toPandas()  # at most most_frequent rows
    frequent, counts = found["s"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        free_worker()
        for batch in slices(batches, ROWS):
            sets = ngram_sets(batch.column(1), words)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            first = first_columns(sets, frequent, counts, percent, shared)
            hot = [known(c, frequent)[1] for c in first]
            split = [[c[h != rare].view(np.int64) for c, h in zip(first, hot, strict=True)] for rare in (True, False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(c, pa.list_(pa.int64())) for c in split)], names=["id", "n", "k1", "k2", "first", "hot"])
            give_back()

    # the first columns take most of this table's room, as those of them that several have do of the next: each goes once the next is written
    path, held = scratch_path(spark, "ngram-first"), scratch_path(spark, "ngram-columns")
    schema = "id long, n long, k1 long, k2 long, first array<long>, hot array<long>"
    source.mapInArrow(sign, schema).write.parquet(path)
    first = spark.read.schema(schema).parquet(path)
    signed = first.drop("first", "hot")
    sets = signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    signed = _written(signed.join(sets, ["k1", "k2", "n"], "left").select("id", "n", "rep"), "ngram-signed")
    with freed_shuffles(spark):
        _columns(first, signed).write.parquet(held)
    remove(spark, path)
    columns = _enough(spark.read.schema("s long, id long").parquet(held), signed, percent, shared)
    remove(spark, held)
    placed = _placed(columns, block_rows)
    multiply = _Products(source, words, percent)
    links_ = [multiply(_inside(placed))]
    label = links_[0].groupBy("src").agg(F.min("dst").alias("dst"))
    round_, waiting = 0, _written(placed.filter(F.col("df") > block_rows).select("id", "hot").distinct(), "ngram-waiting")
    while not waiting.isEmpty():
        # a row that points at none stands for its component
        waiting = _written(waiting.join(label.select(F.col("src").alias("id")), "id", "left_anti"), "ngram-representatives")
        parts = waiting.groupBy("hot").agg(F.ceil(F.count("*") / block_rows).alias("parts"), F.count("*").alias("rows")).filter("rows > 1")
        dealt = waiting.join(parts, "hot").select(F.xxhash64("hot", F.pmod(F.xxhash64("id", F.lit(round_)), "parts")).alias("b1"), "id")
        found = multiply(dealt.select("b1", F.col("b1").alias("b2"), "id"))
        if found.isEmpty():
            break
        links_.append(found)
        new = found.groupBy("src").agg(F.min("dst").alias("dst"))
        moved = label.withColumnRenamed("dst", "mid").join(new.select(F.col("src").alias("mid"), F.col("dst").alias("to")), "mid", "left").select("src", F.coalesce("to", "mid").alias("dst"))
        label = _written(moved.unionByName(new), "ngram-labels")
        waiting = waiting.join(parts.filter("parts > 1").select("hot"), "hot", "left_semi")
        round_ += 1
    links_.append(multiply(_across(placed, label)))
    edges = links_[0]
    for more in links_[1:]:
        edges = edges.unionByName(more)
    component = min_labels(edges)
    rows = signed.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; what its plan has shuffled is deleted then."""
    with freed_shuffles(df.sparkSession):
        return written(df, name)


def _bit(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), id_), F.lit(FILTER_BITS))


def _filter(ids: DataFrame) -> DataFrame:
    """(at, w): the words, of 64 bits each, of a filter of the column id; at most FILTER_BITS / 64 rows."""
    return ids.select(_bit(F.col("id")).alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("w"))


def _columns(first: DataFrame, signed: DataFrame) -> DataFrame:
    """(s, id): the first columns that more than one set has."""
    # only rows that a filter takes for copies of others are shuffled whole, to be looked up among the sets
    copies = F.broadcast(_filter(signed.filter("id != rep")))
    rows = first.filter("n > 0 and id is not null").select("id", "first", "hot", _bit(F.col("id")).alias("b")).join(copies, F.shiftright("b", 6) == F.col("at"), "left")
    copy = F.col("w").isNotNull() & (F.expr("shiftright(w, cast(b & 63 as int)) & 1") == 1)
    sets = signed.filter("rep is not null").select(F.col("rep").alias("id")).distinct()  # a semi join would be moved below the filter, to all rows
    rows = rows.filter(~copy).select("id", "first", "hot").unionByName(rows.filter(copy).select("id", "first", "hot").join(sets, "id"))
    # columns of the table of frequent ones are as many as that at most: their counts are broadcast, and none of them fills a task
    hot = rows.select("id", F.explode("hot").alias("s"))
    hot = hot.join(F.broadcast(hot.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")), "s")
    # a column that is not in that table is rare, or has a small share of all that are as common as the table's rarest
    rare = rows.select("id", F.explode("first").alias("s")).withColumn("df", F.count("*").over(Window.partitionBy("s"))).filter("df > 1")
    return hot.select("s", "id").unionByName(rare.select("s", "id"))


def _enough(columns: DataFrame, signed: DataFrame, percent: int, shared: int) -> DataFrame:
    """(s, id, need): the columns of the sets that have as many of them as they need."""
    # a document that is as similar may be shorter, down to this, and then shares as much as that calls for; of rows that share a key the shortest counts
    shortest = F.ceil(F.col("n") * percent / 100)
    need = F.least(F.ceil(shortest * percent / 100), F.greatest(F.lit(shared), F.floor(shortest / 32))).cast("int")
    needs = signed.filter("n > 0").groupBy("id").agg(F.min(need).alias("need"))
    own = F.count("*").over(Window.partitionBy("id"))
    return _written(columns.withColumn("own", own).join(needs, "id").filter("own >= need").select("s", "id", "need"), "ngram-columns")


def _placed(columns: DataFrame, block_rows: int) -> DataFrame:
    """(s, id, need, block, hot, df): those columns that two sets have still, with the block of each set, its hottest column and how many have that."""
    again = columns.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    each = Window.partitionBy("id")
    rows = columns.join(again, "s").withColumn("own", F.count("*").over(each)).withColumn("h", F.max(F.struct("df", "s")).over(each)).filter("own >= need")
    rows = rows.select("s", "id", "need", F.col("h.s").alias("hot"), F.col("h.df").alias("df"))
    return _written(rows.withColumn("block", F.xxhash64("hot", F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / block_rows)))), "ngram-blocks")


def _inside(placed: DataFrame) -> DataFrame:
    """(b1, b2, id): the rows of each block that share enough columns with others in it."""
    shared = placed.groupBy("block", "s").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    met = placed.join(shared, ["block", "s"]).groupBy("block", "id").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need")
    return met.select(F.col("block").alias("b1"), F.col("block").alias("b2"), "id")


def _across(placed: DataFrame, label: DataFrame) -> DataFrame:
    """(b1, b2, id): for pairs of blocks, the rows of either that share enough columns with rows of another component in the other one."""
    rows = placed.join(label.select(F.col("src").alias("id"), "dst"), "id", "left").select("s", "id", "need", "block", F.coalesce("dst", "id").alias("c"))
    own = F.count("*").over(Window.partitionBy("id"))
    for _ in range(2):
        # columns that one component has alone, or one block, say nothing; nor do rows with too few others
        held = rows.groupBy("s", F.col("block").alias("b")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        several = held.groupBy("s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).filter("lo != hi and n > 1").select("s")
        rows = _written(rows.join(several, "s", "left_semi").withColumn("own", own).filter("own >= need").drop("own"), "ngram-several")
    held = rows.groupBy("s", F.col("block").alias("b")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    met = rows.join(held, "s").filter("block != b and not (lo = c and hi = c)")
    met = met.groupBy(F.least("block", "b").alias("b1"), F.greatest("block", "b").alias("b2"), "id", "block", "c").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    met = _written(met.filter("n >= need").select("b1", "b2", "id", F.col("block").alias("b"), "c"), "ngram-met")
    sides = met.groupBy("b1", "b2", "b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    other = sides.select("b1", "b2", F.when(F.col("b") == F.col("b1"), F.col("b2")).otherwise(F.col("b1")).alias("b"), "lo", "hi")
    return met.join(other, ["b1", "b2", "b"]).filter("not (lo = c and hi = c)").select("b1", "b2", "id")


class _Products:
    """Products of blocks: tables of (b1, b2, id) become a spanning forest of the links among the rows of each (b1, b2)."""

    def __init__(self, source: DataFrame, words: int, percent: int):
        self.source, self.words, self.percent = source.filter("id is not null"), words, percent

    def __call__(self, tiles: DataFrame) -> DataFrame:
        words, percent = self.words, self.percent
        tiles = _written(tiles, "ngram-tiles")
        bits = _filter(tiles).toPandas()
        empty = tiles.sparkSession.createDataFrame([], "src long, dst long")
        if bits.empty:
            return empty
        wanted = np.zeros(FILTER_BITS // 64, np.int64)
        wanted[bits["at"].to_numpy(np.int64)] = bits["w"].to_numpy(np.int64)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_worker()
            for batch in slices(batches, ROWS):
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((wanted[at >> 6] >> (at & 63)) & 1 == 1))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in ngram_sets(batch.column(1), words)], pa.list_(pa.int64()))], names=["id", "set"])
                give_back()

        def product(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            found = links(rows["id"].to_numpy(), [np.asarray(s, np.int64).view(np.uint64) for s in _arrays(rows["set"])], percent)
            return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

        full = self.source.select("id", "t", _bit(F.col("id")).alias("b")).mapInArrow(again, "id long, set array<long>")
        return _written(tiles.join(full, "id").groupBy("b1", "b2").applyInArrow(product, "src long, dst long"), "ngram-links")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, ends = chunk.flatten().to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        ends = ends - ends[0]
        out += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out
