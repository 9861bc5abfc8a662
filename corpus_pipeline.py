"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read_table, settle, settled, sweep
from millrace.llm.exact_dedup import drop_exact_copies
from millrace.llm.language import keep_identified
from millrace.llm.mixing import mixed_documents
from millrace.llm.near_dedup import drop_near_copies
from millrace.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, the largest id stays."""
    return drop_exact_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1, memo_entries=100_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained network, signatures and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the rows of the last.

    What a stage read and wrote on its way is removed once its result is there.
    """
    docs, mark = read_table(spark, sf_dir, "documents"), settled()
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, mark)
    return docs
