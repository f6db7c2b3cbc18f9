"""The corpus pipeline: quality classifier, language ID, n-gram Jaccard join, packing.

Each stage works on all that its predecessor kept. The first three return the
columns of ``documents``; the last returns the packed pieces.

A null or empty text is scored as an empty one by the first stage, and goes at the
second, as its language is ``und``. A null key passes the classifiers and counts as
its own document in the join, unless its text is that of another key. Repeated rows
(ties) share their fate: all rows of a kept key stay. Very long texts are read whole
by every stage. An empty table passes through all stages and gives no pieces. Further
columns pass the first three stages as they are, whatever their names, but for
``_quality``, ``_lang`` and ``_share``. Each stage begins with small heaps on idle
executors: what the stages before have grown them by is given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import langid, ngram_join, packing, quality
from skein.llm.common import fold, free_heaps, scratch_path, table
from skein.llm.queries import tokenizer

#: Below this score a document is rejected as of low quality.
LEAST_QUALITY = 0.7


def _but_key(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores at ``LEAST_QUALITY`` or more; all labelled ones are learned but for the held-out fold."""
    free_heaps(spark)
    labels, learn = table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2
    model = quality.teach(docs, labels, quality.train(docs, labels, learn), learn)
    return quality.score(docs, model, keep=_but_key(docs), name="_quality").filter(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in a language that was learned: not ``und``, and of a score that held-out texts of such a language have.

    All texts outside the held-out fold are learned, and all in it count for the least score.
    """
    free_heaps(spark)
    held_out = fold(F.col("doc_id"), 3) == 1
    net = langid.teach(docs, langid.train(docs, ~held_out), ~held_out)
    least = langid.least_share(docs, net, held_out)
    found = langid.predict(docs, net, keep=_but_key(docs), names=("_lang", "_share"))
    return found.filter((F.col("_lang") != langid.UNKNOWN) & (F.col("_share") >= least)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies: sets of five words that are alike to 80 per cent or more."""
    free_heaps(spark)
    found = ngram_join.near_duplicates(docs, words=5, percent=80)
    kept = found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    free_heaps(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("language ID", known_language), ("n-gram Jaccard join", one_of_each_group), ("packing", packed)]
#: No stage but the join can be expressed in SQL (two learned models, a tokenizer): tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
