"""From raw documents to token ids: every stage reads what its predecessor wrote.

All stages take nulls in any column, texts of any length, repeated rows and empty tables: no rows give no rows, and
columns keep their names and values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latecast.llm import byte_bpe, exact_dedup, mixing, near_dup, quality
from latecast.llm.shared import Work, documents, drop_since

NEAR_THRESHOLD = 80  # per cent of shared shingles; 85 is the contract of op5 only


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged as the average document."""
    judged = quality.judged(docs, quality.train(docs), score_col="__score", keep_col="__keep")
    return judged.where("__keep").select(*docs.columns)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, one without id only if none has one. Null counts as
    empty."""
    return exact_dedup.without_copies(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and all without words."""
    return near_dup.without_near_copies(docs, threshold=NEAR_THRESHOLD).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words stay as they are. A null source is a source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the text as decoded from them; a null text has none and
    becomes empty. Columns called ``ids`` and ``n_tokens`` are replaced."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded_col="decoded")
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return encoded.select(
        *[F.col(f"`{c}`") for c in others], "ids", F.col("decoded").cast("string").alias("text"),
        F.size("ids").alias("n_tokens"),
    )


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("byte-level BPE", tokens),
]

#: No SQL: the first stage fits a classifier. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again."""
    work = Work(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        mark = len(Work.made)
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{i}")
        drop_since(mark)
        if i:
            work.drop(f"stage-{i - 1}")
    return docs
