"""Triangles without a table of wedges: ranges of vertices are held one at a time and neighbour lists stream past them.

Every pair of vertices is oriented, so that a list of neighbours is short. The lists travel packed, each to the ranges
that its members lie in, and there two neighbours of a vertex are looked up among the range's own pairs. What is
shuffled is at most the lists times the ranges (or times a list's length), not the wedges, and ids that
are near each other stay in few ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.scratch import spread, written

#: Oriented pairs of one range, which a task holds.
RANGE_PAIRS = 3_000_000
#: Vertices whose degrees are sent to all tasks.
MOST_HEAVY = 100_000
#: Pairs packed together, and wedges looked up at once.
PACK, PROBE = 100_000, 2_000_000

_ARCS = {"wu": 1, "uw": 2, "wv": 4, "vw": 8, "uv": 16, "vu": 32}


def closed(pairs: DataFrame) -> DataFrame:
    """(w, u, v) of each triangle once and whether there are the arcs ``wu``, ``uw`` and so on, of (a, b, ab, ba) with a < b, long and distinct."""
    n = pairs.count()
    lists = _lists(pairs, n)
    starts = [r["first"] for r in lists.groupBy("part").agg(F.min("first").alias("first")).orderBy("first").collect()]  # one row a range
    if not starts:
        starts = [0]
    bounds = np.array(starts, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                w, v, f = _unpacked(blob.as_py())
                own = int(_range_of(bounds, w[:1])[0])  # a range's lists are packed apart
                out = [(own, 0, blob.as_py())]
                to = _range_of(bounds, v)
                head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                row = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(w)]))
                for r in np.unique(to):
                    met = np.zeros(len(head), dtype=bool)
                    met[row[to == r]] = True
                    met = met[row]
                    out.append((int(r), 1, blob.as_py() if met.all() else _packed(w[met], v[met], f[met])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["range", "kind", "blob"])

    dealt = lists.select("blob").mapInArrow(deal, "range int, kind int, blob binary")
    dealt = dealt.repartitionById(len(starts), "range").sortWithinPartitions("range", "kind")
    rows = dealt.mapInArrow(_close, "w long, u long, v long, arcs int")
    return rows.select("w", "u", "v", *((F.col("arcs").bitwiseAND(F.lit(bit)) != 0).alias(name) for name, bit in _ARCS.items()))


def _lists(pairs: DataFrame, n: int) -> DataFrame:
    """(part, first, blob): the oriented pairs by ascending w, in packs that hold whole lists; ``part`` is the range of w.

    Pairs go to the end of higher degree, where more than MOST_HEAVY vertices have one as high to the larger id: light lists are short by themselves.
    """
    spark = pairs.sparkSession
    with spread(spark, 2 * n):
        degree = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")), "degrees")
    above = degree.agg(*(F.count_if(F.col("d") >= 2**k).alias(f"n{k}") for k in range(48))).first()
    least = 2 ** next(k for k, x in enumerate(above) if x <= MOST_HEAVY)
    heavy = F.broadcast(degree.filter(F.col("d") >= least))
    both = pairs.join(heavy.withColumnsRenamed({"id": "a", "d": "da"}), "a", "left").join(heavy.withColumnsRenamed({"id": "b", "d": "db"}), "b", "left")
    da, db = F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))
    up = (da < db) | ((da == db) & (F.col("a") < F.col("b")))
    arcs = lambda x, y: F.col(x).cast("int") + F.col(y).cast("int") * 2
    either = lambda x, y: F.when(up, x).otherwise(y)
    out = both.select(either(F.col("a"), F.col("b")).alias("w"), either(F.col("b"), F.col("a")).alias("v"), either(db, da).alias("d"), either(arcs("ab", "ba"), arcs("ba", "ab")).alias("f"))
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // RANGE_PAIRS), min(cores, n // 100_000))
    out = out.repartitionByRange(parts, "w").sortWithinPartitions("w", "d", "v")
    return written(out.withColumn("part", F.spark_partition_id()).mapInArrow(_pack, "part int, first long, blob binary"), "lists")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    part = None

    def packs(last: bool) -> Iterator[pa.RecordBatch]:
        w, v, f = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        end = len(w) if last else head[-1]  # the last list may go on
        if not last:
            held.append((w[end:], v[end:], f[end:]))
        at = 0
        while at < end:
            k = np.searchsorted(head, at + PACK)
            to = min(end, head[k] if k < len(head) else len(w))
            blob = _packed(w[at:to], v[at:to], f[at:to])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([w[at]], pa.int64()), pa.array([blob], pa.binary())], names=["part", "first", "blob"])
            at = to

    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "v", "f")))
        n += batch.num_rows
        if n >= 4 * PACK:
            yield from packs(False)
            n = len(held[0][0])
    if held and n:
        yield from packs(True)


def _packed(w: np.ndarray, v: np.ndarray, f: np.ndarray) -> bytes:
    """Lists in a few bytes a member: differences, of which most have bytes alike."""
    head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    base = w[head]
    delta = np.diff(v, prepend=v[:1])
    planes = lambda x: np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    raw = b"".join(x.tobytes() for x in (np.array([len(head), len(v), v[0]], "<i8"), planes(np.diff(base, prepend=base[:1])), np.array(base[:1], "<i8"), planes(np.diff(head, append=len(w))), planes(delta), f.astype(np.uint8)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k, n, first = np.frombuffer(raw, "<i8", 3)
    at = 24

    def planes(m: int) -> np.ndarray:
        nonlocal at
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * m, at).reshape(8, m).T).view("<i8").ravel()
        at += 8 * m
        return x

    base = planes(k)
    base = np.cumsum(base) + np.frombuffer(raw, "<i8", 1, at)[0]
    at += 8
    size = planes(k)
    return np.repeat(base, size), np.cumsum(planes(n)) + first, np.frombuffer(raw, np.uint8, n, at)


def _range_of(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(bounds, ids, side="right") - 1, 0)


class _Held:
    """The pairs of a range, to be looked up by their ends."""

    def __init__(self, packs: list[tuple]):
        w, v, f = (np.concatenate(x) for x in zip(*packs, strict=True))
        self.ends, self.others = np.unique(w), np.unique(v)
        key = np.searchsorted(self.ends, w) * len(self.others) + np.searchsorted(self.others, v)
        order = np.argsort(key)
        self.keys, self.arcs = key[order], f[order]
        self.shift = np.uint64(64 - min(28, max(16, int(np.ceil(np.log2(16 * len(key)))))))
        seen = np.zeros(1 << (64 - int(self.shift)), dtype=np.uint8)
        seen[self.slot(key)] = 1
        self.bits = np.packbits(seen, bitorder="little")

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def close(self, w: np.ndarray, v: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The triangles of two members of one list of which the earlier one is an end of a pair held here."""
        at = np.minimum(np.searchsorted(self.ends, v), len(self.ends) - 1)
        first = np.flatnonzero(self.ends[at] == v)
        to = np.minimum(np.searchsorted(self.others, v), len(self.others) - 1)
        later = np.flatnonzero(self.others[to] == v)
        if not len(first) or not len(later):
            return
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        end = np.repeat(np.r_[head[1:], len(w)], np.diff(np.r_[head, len(w)]))
        lo, hi = np.searchsorted(later, first, side="right"), np.searchsorted(later, end[first])
        base, to = at[first] * len(self.others), to[later]
        n = hi - lo
        total = np.cumsum(n)
        k = 0
        while k < len(first):
            done = total[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(total, done + PROBE, side="right")))
            many = n[k:stop]
            pick = np.arange(total[stop - 1] - done) + np.repeat(lo[k:stop] - (total[k:stop] - many - done), many)
            key = np.repeat(base[k:stop], many) + to[pick]
            slot = self.slot(key)
            keep = np.flatnonzero((self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            key = key[keep]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            keep, found = keep[hit], found[hit]
            if len(keep):
                i = np.repeat(np.arange(k, stop), many)[keep]
                i, j = first[i], later[pick[keep]]
                arcs = f[i].astype(np.int32) + f[j].astype(np.int32) * 4 + self.arcs[found].astype(np.int32) * 16
                yield pa.RecordBatch.from_arrays([pa.array(w[i]), pa.array(v[i]), pa.array(v[j]), pa.array(arcs)], names=["w", "u", "v", "arcs"])
            k = stop


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs: list[tuple] = []
    held, at = None, None
    for batch in batches:
        for r, kind, blob in zip(*(batch.column(c) for c in ("range", "kind", "blob")), strict=True):
            lists = _unpacked(blob.as_py())
            if r.as_py() != at:
                at, packs, held = r.as_py(), [], None
            if kind.as_py() == 0:
                packs.append(lists)
                continue
            if held is None and packs:
                held, packs = _Held(packs), []
            if held is not None:
                yield from held.close(*lists)
