"""Exact token statistics for every context limit from one histogram of document lengths.

Documents are aggregated by encoded length. With the running totals of the histogram, every limit has
its answers: documents and tokens up to it, the total after cutting every document at the limit
(tokens of shorter documents plus the limit for each longer one), and quantiles.

Defined results: a null or empty text has length 0. Every row counts, repeated or not. An empty
table gives an empty table. Further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import running_total
from .common import Scratch
from .tokens import encoder, text_batches


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in text_batches(batches):
            lengths = [len(ids) for ids in encode(batch.column("text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per occurring length: n_docs, docs_longer, tokens_longer, truncated_total, share_covered.

    ``truncated_total`` is the number of tokens left when every document is cut at that length.
    """
    scratch = Scratch(counts.sparkSession)
    bins = counts.groupBy(F.col(col).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    bins = scratch.write(bins.withColumn("n_tokens", F.col("length") * F.col("n_docs")), "bins")
    all_docs, all_tokens = (x or 0 for x in bins.agg(F.sum("n_docs"), F.sum("n_tokens")).first())
    upto = running_total(bins, ["length"], {"docs_upto": "n_docs", "tokens_upto": "n_tokens"})
    longer = F.lit(all_docs) - F.col("docs_upto")
    return upto.select(
        "length", "n_docs", longer.alias("docs_longer"), (F.lit(all_tokens) - F.col("tokens_upto")).alias("tokens_longer"),
        (F.col("tokens_upto") + longer * F.col("length")).alias("truncated_total"),
        (F.col("docs_upto") / F.lit(all_docs)).alias("share_covered"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at any limit, whether or not a document has that length."""
    kept = F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(F.sum(kept)).first()[0] or 0


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that covers at least the share ``q`` of documents."""
    return histogram.filter(F.col("share_covered") >= q).agg(F.min("length")).first()[0]
