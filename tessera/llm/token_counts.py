"""Exact length histogram of encoded documents, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm._shared import stored


def encoded_lengths(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every whole text (null: empty, no tokens); no special tokens."""
    ranks = tokens.ranks_of(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern, tokens.key_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(*shipped.value).encode_ordinary
        for b in batches:
            counts = pa.array([len(encode(x or "")) for x in b["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], counts], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row for each length that occurs, as a context limit.

    - ``context_limit``: the length; ``n_docs``, ``n_tokens``: documents of just that length and their tokens
    - ``docs_longer``, ``tokens_longer``: of all documents above the limit
    - ``total_docs``, ``total_tokens``: of all documents
    - ``truncated_tokens``: tokens that stay if each document is cut at the limit
    - ``quantile``: share of documents that are no longer than the limit

    Documents are aggregated by length first (partial sums, so a length that a third of all documents
    have costs one row a task). Suffix sums run in two levels: within blocks of ``block`` lengths, and
    over the blocks' totals, so that no task holds more than one block or one row per block. Null
    lengths are left out; an empty table gives no rows.
    """
    by_length = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))
    by_length = by_length.withColumn("n_tokens", F.col("context_limit") * F.col("n_docs")).withColumn("block", F.floor(F.col("context_limit") / block))
    counts, _ = stored(by_length, "lengths")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for c, w, name in (("d", after, "d_after"), ("t", after, "t_after"), ("d", everything, "total_docs"), ("t", everything, "total_tokens"))])
    longer = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").select(
        "context_limit", "n_docs", "n_tokens",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_after")).alias("docs_longer"),
        (F.coalesce(F.sum("n_tokens").over(longer), F.lit(0)) + F.col("t_after")).alias("tokens_longer"),
        "total_docs", "total_tokens",
    )
    return rows.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("context_limit") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit`` and ``truncated_tokens`` for any limits, whether or not a document has that length.

    Between two lengths that occur the total is linear, so the row of the largest length at or below
    the limit answers; below the smallest length every document is cut.
    """
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "asked long")
    kept = F.max(F.when(F.col("context_limit") <= F.col("asked"), F.struct("context_limit", "truncated_tokens", "docs_longer"))).alias("at")
    found = F.broadcast(asked).join(histogram, how="left", on=F.lit(True)).groupBy("asked").agg(kept, F.max("total_docs").alias("docs"))
    return found.select(
        F.col("asked").alias("context_limit"),
        F.coalesce(F.col("at.truncated_tokens") + (F.col("asked") - F.col("at.context_limit")) * F.col("at.docs_longer"), F.col("asked") * F.col("docs"), F.lit(0)).alias("truncated_tokens"),
    )


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed; None for no documents."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("context_limit")).first()[0]
