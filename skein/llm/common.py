"""What several operators share: tables, held-out folds, bounded samples and batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.plans.scratch import scratch_path, shared_dir, written  # noqa: F401  used by the operators

#: Rows and bytes of the texts that a task works on at once, far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and, as far as their rows are alike, ``most_bytes``: a task's memory doesn't depend on the session's settings."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def bounded_sample(rows: DataFrame, label: str, key: str, most: int, most_labels: int = 1024, most_rows: int | None = None) -> DataFrame:
    """At most ``most`` keys of each label, those with the smallest hash: the same rows at any partitioning.

    Of more than ``most_labels`` labels the commonest are sampled (of equally common ones those that sort first); with
    ``most_rows``, labels share that many rows. Null labels are none. Labels are counted first, and only keys whose hash
    is below what their label's count calls for (with room to spare) are ranked, so that a hot label sends the ranking
    task little more than ``most`` rows.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()
    if not counts:
        return rows.select(key, label).limit(0)
    if most_rows is not None:
        most = max(1, min(most, most_rows // len(counts)))
    span = 1 << 40
    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(span))
    below = [(r[0], min(span, int(span * (most + 6 * most**0.5 + 50) / r[1]))) for r in counts]
    bounds = rows.sparkSession.createDataFrame(below, T.StructType([T.StructField("_label", rows.schema[label].dataType), T.StructField("_bound", T.LongType())]))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash", F.col(key)))
    # at most most_labels rows: a proven bound
    near = rows.select(key, label).withColumn("_hash", hashed).join(F.broadcast(bounds), (F.col(label) == F.col("_label")) & (F.col("_hash") < F.col("_bound")), "left_semi")
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_hash", "_rank")


def flat(parameters: dict[str, np.ndarray]) -> bytes:
    """A model's parameters as the bytes of one vector, for ``averaged``."""
    return np.concatenate([parameters[k].ravel().astype(np.float64) for k in sorted(parameters)]).tobytes()


def averaged(taught: DataFrame, parameters: dict[str, np.ndarray], buckets: int = 16) -> dict[str, np.ndarray]:
    """The mean of the ``flat`` parameters in ``taught`` (part int, n double, p binary), each weighing ``n``; ``parameters`` if none weighs anything.

    Tasks add them up in ``buckets`` groups, always in the same order, so that the driver gets that many rows at any number of parts.
    """

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = sum(n * np.frombuffer(bytes(p), np.float64) for n, p in zip(frame["n"], frame["p"], strict=True))
        return pd.DataFrame([(int(key[0]), float(frame["n"].sum()), total.tobytes())], columns=["bucket", "n", "p"])

    # at most `buckets` rows: a proven bound
    found = taught.filter("n > 0").groupBy((F.col("part") % buckets).alias("bucket")).applyInPandas(add, "bucket int, n double, p binary").toPandas().sort_values("bucket")
    if found.empty:
        return parameters
    mean = sum(np.frombuffer(bytes(p), np.float64) for p in found["p"]) / found["n"].sum()
    out, at = {}, 0
    for k in sorted(parameters):
        a = parameters[k]
        out[k] = mean[at : at + a.size].reshape(a.shape).astype(a.dtype)
        at += a.size
    return out


def descend(parameters: dict[str, np.ndarray], gradient: dict[str, np.ndarray], rate: float, longest: float = 1.0) -> None:
    """One step against the gradient, in place; a gradient longer than ``longest`` counts as one of that length."""
    length = float(np.sqrt(sum(float((d * d).sum()) for d in gradient.values())))
    for k, d in gradient.items():
        parameters[k] -= (rate * min(1.0, longest / max(length, 1e-30)) * d).astype(parameters[k].dtype)


def kept_by_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps over its tasks (a cache: tasks never depend on it), until it makes another."""
    store = _store()
    if key not in store:
        free_worker()
        store[key] = make()
    return store[key]


def free_worker() -> None:
    """Gives back what a worker kept for another operator: workers outlive operators, and their memory is bounded together."""
    _store().clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives the system what Arrow and the C library have freed but kept: over many batches that grows to several times what is in use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_heaps(spark: SparkSession) -> None:
    """Lets the executors' heaps give back what an earlier stage has grown them by: a heap keeps its size until it is collected as a whole.

    One small task for each core, so that idle executors get some each; results never depend on which of them did.
    """
    n = spark.sparkContext.defaultParallelism
    with contextlib.suppress(Exception):  # a platform may not allow the call
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("_")).write.format("noop").mode("overwrite").save()


def _store() -> dict:
    module = sys.modules.setdefault("_skein_worker", types.ModuleType("_skein_worker"))
    return module.__dict__.setdefault("kept", {})


def fresh(texts: pa.Array) -> pa.Array:
    """The texts as large strings without nulls, in buffers of their own: some kernels misread arrays whose values don't begin at 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    return pa.concat_arrays([texts, texts.slice(0, 0)])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: each one's number among the distinct words, those, and where each text's words begin and end.

    Splitting and numbering run in Arrow's kernels, so that Python meets each distinct word of a batch once. A null text has no words.
    """
    lists = pc.ascii_split_whitespace(fresh(texts))
    coded = lists.flatten().dictionary_encode()
    number, offsets = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # what white space at an end leaves
        real = number != empty
        number, offsets = number[real], np.concatenate([[0], np.cumsum(real)])[offsets]
    return number, coded.dictionary, offsets
