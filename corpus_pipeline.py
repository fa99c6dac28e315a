"""From raw documents to packed training sequences: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_documents, packing, substring_dedup, toxicity
from tessera.llm._shared import stored, table
from tessera.llm.queries import remainder


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with ``n_chars``, if there, brought up to date."""
    return docs.select(*[F.length("text").cast(dict(like.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores 0.7 or more go; labels that are held out are not learnt.

    Null and empty texts stay, repeated rows go or stay alike; without labels, or without documents, nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity.drop_toxic(docs, model, 0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go where they stand later; a document of which nothing is left goes with them.

    Null and empty texts stay. Of ties the row of the smaller doc_id keeps the line; repeated rows keep
    their lines alike. No documents give no rows.
    """
    return _recounted(line_dedup.dedup_lines(docs, least_exact=1, counts=False, drop_emptied=True), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that 5-word shingles with an exact Jaccard similarity of 0.8 or more link.

    Candidates come from SimHash segments. It is the one of the smallest doc_id (null ids last); of repeated rows, and of texts without words, one stays.
    """
    return near_documents.keep_one(docs, similar=0.8)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go where they stand later; a document of which nothing is left goes with them.

    Null and empty texts stay. Of ties the row of the smaller doc_id keeps the passage; repeated rows
    keep theirs alike. No documents give no rows.
    """
    return _recounted(substring_dedup.remove_passages(docs, drop_emptied=True), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences they fill; null texts are empty, repeated rows are packed one by one, no documents give no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("substring_dedup", dedup_passages),
    ("packing", pack),
]

#: Tokens, edit distances and learnt scores have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
