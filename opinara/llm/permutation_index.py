"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted, with the ranks, in the
inverted files of those pivots. A query visits the files of its own nearest pivots and ranks the vectors met
by Spearman's footrule, the summed difference of pivot ranks (a pivot missing on one side counts as rank
``depth``). The best share of each block is reranked by exact cosine.

The index is dealt by blocks of vectors of bounded size, each with its own inverted files; queries come in
blocks too. A pair of blocks is one group, so memory does not depend on the number of vectors or on
copies. Ties of the footrule at the cut are all reranked.

Pivots are a sample of ``pivots`` vectors drawn by a hash of the id; every vector is indexed.

Defined results: vectors that are null, empty, zero, of another length than most pivots, or hold null or
non-finite components take no part. A query never finds rows with its own id. Ties go to the smaller id.
Repeated rows are separate candidates; of queries
with one id the smallest vector asks. An empty table gives an empty table. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

VECTORS_AT_ONCE, QUERIES_AT_ONCE = 16_384, 4_096


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    nonzero = F.exists(vector, lambda v: F.coalesce(v != 0, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & nonzero, F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nearest_pivots(units: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    near = units @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :depth]


class InvertedFiles:
    """For each pivot the vectors posted there and the rank of the pivot in their order."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.size, self.depth = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self._vector, self._rank = by_pivot // self.depth, (by_pivot % self.depth).astype(np.int32)
        self._start = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query order to every vector, up to a constant."""
        distance = np.zeros(self.size, np.int32)
        for rank, pivot in enumerate(order):
            part = slice(self._start[pivot], self._start[pivot + 1])
            # A pivot on both sides costs the difference of ranks instead of two missing ranks.
            distance[self._vector[part]] += np.abs(self._rank[part] - rank) - (self.depth - rank) - (self.depth - self._rank[part])
        return distance


def exact_cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the same order for every row."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray,
            depth: int, share: float, k: int) -> Iterator[tuple[int, int, float]]:
    units = _units(vectors)
    files = InvertedFiles(nearest_pivots(units, pivots, depth), len(pivots))
    orders = nearest_pivots(_units(queries), pivots, depth)
    quota = max(int(np.ceil(share * len(ids))), 4 * k)
    for number, (query_id, order) in enumerate(zip(query_ids, orders, strict=True)):
        distance = files.footrule(order)
        cut = np.partition(distance, quota - 1)[quota - 1] if quota < len(ids) else distance.max()
        at = np.flatnonzero((distance <= cut) & (ids != query_id))
        if not len(at):
            continue
        rough = units[at] @ _units(queries[number : number + 1])[0]
        if len(at) > k:
            at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
        score = exact_cosine(queries[number], vectors[at])
        best = np.lexsort((ids[at], -score))[:k]
        for i in best:
            yield int(query_id), int(ids[at[i]]), float(score[i])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 256, depth: int = 24, share: float = 0.4,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of every query, nearest first."""
    scratch = Scratch(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec")).filter(
            F.col("id").isNotNull() & usable(F.col("vec")))

    index = scratch.write(clean(vectors), "vectors")
    asked = scratch.write(clean(queries).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    width = index.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").select("w").first()
    schema = "query_id long, vec_id long, score double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, asked = (df.filter(F.size("vec") == width[0]) for df in (index, asked))
    # The sample is bounded by ``pivots``; equal vectors make one pivot only.
    chosen = index.select("vec", F.xxhash64(F.lit(5), "id").alias("h")).dropDuplicates(["vec"]).orderBy("h", "vec").limit(pivots)
    points = _units(np.array([r[0] for r in chosen.select("vec").collect()], float))
    depth = min(depth, len(points))

    blocks_v = -(-index.count() // VECTORS_AT_ONCE) or 1
    blocks_q = -(-asked.count() // QUERIES_AT_ONCE) or 1
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    rows = index.withColumn("bv", deal(blocks_v)).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1)))).withColumn(
        "query", F.lit(False))
    asks = asked.withColumn("bq", deal(blocks_q).cast("int")).withColumn(
        "bv", F.explode(F.sequence(F.lit(0), F.lit(blocks_v - 1)).cast("array<bigint>"))).withColumn("query", F.lit(True))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q = group["query"].to_numpy(bool)
        if q.all() or not q.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vec = np.stack(group["vec"].to_numpy()).astype(float)
        ids = group["id"].to_numpy(np.int64)
        found = _search(ids[~q], vec[~q], ids[q], vec[q], points, depth, share, k)
        return pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    both = rows.select("bv", "bq", "query", "id", "vec").unionByName(asks.select("bv", "bq", "query", "id", "vec"))
    hits = both.groupBy("bv", "bq").applyInPandas(run, schema)
    # Each block of vectors hands on at most k rows a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
