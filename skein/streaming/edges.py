"""Edge streams: degrees as a running aggregate, and a deduplicated edge table grown batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.plans.scratch import written


def streaming_degrees(edges: DataFrame, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """(id, out_degree, in_degree) as a running aggregate of a stream of (src, dst); by windows of time, late edges dropped, if asked for.

    ``watermark``: a time column and how late an edge may be; ``window``: the windows' length.
    """
    if watermark:
        edges = edges.withWatermark(*watermark)
    at = [F.col(watermark[0]).alias("at")] if watermark else []
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"), *at)
    keys = [F.window("at", window)] if window else []
    return ends.groupBy(*keys, F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def append_edges(path: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: writes each batch's edges under its number; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def graph_at(spark: SparkSession, path: str, keep: str = "first", **kw) -> Graph:
    """The graph of all batches that ``append_edges`` has written so far."""
    # numbered in the order of the batches; written, so that the numbers stay
    batches = spark.read.parquet(path).repartitionByRange("batch").sortWithinPartitions("batch")
    edges = written(batches.withColumn("eid", F.monotonically_increasing_id()).drop("batch"), "stream-edges")
    return Graph.from_edges(edges, keep=keep, **kw)
