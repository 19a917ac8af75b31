"""From raw documents to packed training sequences: the stages in order, each an operator of ``usagelens.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import lines, minhash, mixing, packing, quality
from usagelens.llm.common import importable, table
from usagelens.sources.workspace import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that read like trusted text of their language; those the classifier rejects go."""
    return quality.kept_rows(docs, quality.trusted_ids(table(spark, folder, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each line once in the corpus, at its first place; a document all of whose lines went goes too."""
    importable(spark)
    left = lines.unrepeated(docs, **lines.WHOLE)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    importable(spark)
    return minhash.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn; a document is as many rows as the mix takes it times."""
    importable(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each token piece lies in the training sequences."""
    importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: The stages learn models, join by edit distance and cut tokens, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next stage."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
