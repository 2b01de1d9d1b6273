"""From raw documents to packed training sequences: five stages, each an operator of ``opinara.llm``.

Each stage gets what its predecessor kept and returns the columns of ``documents``; the last one
returns the packed pieces. SQL cannot express the stages; a brute-force version tests them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opinara.llm import exact_dedup, mixing, packing, parity_join, toxicity
from opinara.llm.queries import END_ID, WINDOW, toxicity_model, word_tokenizer
from opinara.session import checkpoint_dir

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), out="_toxicity")
    return scored.filter("_toxicity < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles the one with the smallest id stays."""
    return parity_join.drop_linked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.take(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return packing.pack(docs, word_tokenizer(), END_ID, WINDOW)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
    return docs
