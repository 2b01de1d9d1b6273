"""Hard negatives by Kronecker-packed integer products.

Components become integers, ``floor(scale * x)``. In a block of candidates, every component is biased to be at
or above zero and the same component of several candidates is placed in separated fields of one wide
integer. One multiplication of that word with an anchor's biased component then serves all of its
candidates: a field is wide enough for the largest sum of products, so neighbours never carry into each other,
and taking the biases off the unpacked fields leaves the exact inner products. Words of up to 53 bits are
kept as doubles, in which sums of integers below 2^53 are exact in any order, so that a block is one matrix
product; components too large for that are packed into Python integers of any width.

Candidates are dealt into blocks of bounded size by a hash, anchors too, and a pair of blocks is one group of a
task. A block holds ``COMPONENTS_AT_ONCE`` components, so a candidate that is sent to a block of anchors takes part in
about a million multiplications there: the shuffle stays small against the arithmetic. The first
pass multiplies anchors with candidates of their own label and keeps the best of each block; once the positives are known,
the second pass looks for negatives in their bands of scores. Every row is compared exactly; nothing
is pruned or sampled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part.
Vectors are compared with vectors of the same length only. An anchor's partners have other ids than its own.
Rows that repeat an id are separate candidates; of anchors with one id the one with the smallest
label (as text) and vector asks. Ties go to the smaller id. An anchor without positives, or a
positive without negatives in its band, gives no rows. Scores beyond 64 bits count as the largest or smallest 64-bit integer,
products with ``scale`` beyond the range of doubles as the largest double.
An empty table gives an empty table. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

COMPONENTS_AT_ONCE = 1 << 20
ANCHORS_IN_TILE = 256
WORD_BITS = 53  # integers that a double holds exactly
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))),
                      F.lit(False))


class PackedBlock:
    """Integer vectors of one length, several to a word, ready to be multiplied with anchors."""

    def __init__(self, rows: np.ndarray, top_anchor: float, least_anchor: float):
        """``rows`` holds integers as doubles; anchors have components from ``least_anchor`` to ``top_anchor``."""
        self.n, self.width = rows.shape
        self.bias, self.anchor_bias = (int(-low) for low in (rows.min(initial=0), min(least_anchor, 0)))
        # Bounds in Python integers: they may exceed any machine word.
        most = self.width * (int(rows.max(initial=0)) + self.bias) * (int(max(top_anchor, 0)) + self.anchor_bias)
        self.bits = max(most.bit_length(), 1)
        self.wide = self.bits > WORD_BITS
        self.fields = 8 if self.wide else WORD_BITS // self.bits
        if self.wide:
            rows = np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)
        self.sums = rows.sum(axis=1)
        self.words = self._pack(rows)

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        per_field = -(-self.n // self.fields)
        words = np.zeros((per_field, self.width), rows.dtype)
        for field in range(self.fields):  # candidate i sits in field i // per_field
            part = rows[field * per_field : (field + 1) * per_field] + self.bias
            words[: len(part)] += part * (1 << (field * self.bits))
        return words

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates, as 64-bit integers."""
        if self.wide:
            anchors = np.array([[int(x) for x in row] for row in anchors], object).reshape(anchors.shape)
        packed = (anchors + self.anchor_bias) @ self.words.T
        if not self.wide:
            packed = packed.astype(np.int64)
        mask = (1 << self.bits) - 1
        raw = np.concatenate([(packed >> (field * self.bits)) & mask for field in range(self.fields)], axis=1)[:, : self.n]
        if self.wide:
            off = self.bias * anchors.sum(axis=1)[:, None] + self.anchor_bias * self.sums[None, :]
            exact = raw - off - self.width * self.bias * self.anchor_bias
            return np.array([[min(max(int(x), _LEAST), _MOST) for x in row] for row in exact], np.int64).reshape(raw.shape)
        off = self.bias * anchors.sum(axis=1).astype(np.int64)[:, None] + self.anchor_bias * self.sums.astype(np.int64)[None, :]
        return raw - off - self.width * self.bias * self.anchor_bias


def _products(rows: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number and scores of every anchor against all rows, a tile of anchors at a time."""
    block = PackedBlock(rows, anchors.max(initial=0), anchors.min(initial=0))
    for start in range(0, len(anchors), ANCHORS_IN_TILE):
        for i, scores in enumerate(block.products(anchors[start : start + ANCHORS_IN_TILE])):
            yield start + i, scores


def _first(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, the ``k`` with the highest scores, ties by the smaller id."""
    if len(at) > k:
        part = scores[at]
        at = at[part >= np.partition(part, len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]  # ~s falls as s rises, without overflow


def _integers(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    if not width:
        return np.zeros((len(vectors), 0))
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * np.stack(vectors.to_numpy()).astype(float)))


def _positives(rows: pd.DataFrame, anchors: pd.DataFrame, scale: float, k: int) -> Iterator[tuple]:
    kinds = {key: part for key, part in rows.groupby(["width", "label"])}
    for (width, label), asking in anchors.groupby(["width", "label"]):
        own = kinds.get((width, label))
        if own is None:
            continue
        ids, asks = own["id"].to_numpy(np.int64), asking["id"].to_numpy(np.int64)
        for i, scores in _products(_integers(own["vec"], width, scale), _integers(asking["vec"], width, scale)):
            for j in _first(ids, scores, np.flatnonzero(ids != asks[i]), k):
                yield int(asks[i]), int(ids[j]), int(scores[j])


def _negatives(rows: pd.DataFrame, anchors: pd.DataFrame, scale: float, k: int, low: int, high: int) -> Iterator[tuple]:
    kinds = {key: part for key, part in rows.groupby("width")}
    for width, asking in anchors.groupby("width"):
        own = kinds.get(width)
        if own is None:
            continue
        ids, asks = own["id"].to_numpy(np.int64), asking["id"].to_numpy(np.int64)
        codes, names = pd.factorize(pd.concat([own["label"], asking["label"]]))
        labels, asked = codes[: len(own)], codes[len(own):]
        found = asking["positives"].tolist()
        for i, scores in _products(_integers(own["vec"], width, scale), _integers(asking["vec"], width, scale)):
            # In whole numbers: low * p <= 100 * n <= high * p.
            bands = [(max(-(-low * int(p["score"]) // 100), _LEAST), min(high * int(p["score"]) // 100, _MOST), p) for p in found[i]]
            within = [b for b in bands if b[0] <= b[1]]
            if not within:
                continue
            other = np.flatnonzero((labels != asked[i]) & (ids != asks[i]) & (scores >= min(b[0] for b in within))
                                   & (scores <= max(b[1] for b in within)))
            for least, most, p in within:
                at = other[(scores[other] >= least) & (scores[other] <= most)]
                for j in _first(ids, scores, at, k):
                    yield int(asks[i]), int(p["n"]), int(p["id"]), int(p["score"]), int(ids[j]), int(scores[j])


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``rows``. An anchor's positives are its first ``positives`` other rows of the same
    label by score; each is answered by the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` hundredths of the positive's.
    """
    scratch = Scratch(rows.sparkSession)
    vec = F.col(f"`{vector_col}`")
    if dict(rows.dtypes)[vector_col] != "array<float>":
        vec = vec.cast("array<double>")
    used = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                       vec.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    used = used.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("vec"))).withColumn(
        "width", F.size("vec"))
    used = scratch.write(used, "rows")
    asking = used.filter("asks").groupBy("id").agg(F.min(F.struct("label", "width", "vec")).alias("a")).select("id", "a.*")
    asking = scratch.write(asking, "anchors")

    def blocks(df: DataFrame) -> int:
        return -(-(df.agg(F.sum(F.greatest("width", F.lit(1)))).first()[0] or 0) // COMPONENTS_AT_ONCE) or 1

    of_rows, of_anchors = blocks(used), blocks(asking)

    def dealt(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        """Each row in one block of its own side, once for every block of the other side."""
        number = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
        return df.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def meet(questions: DataFrame, task, schema: str) -> DataFrame:
        left = dealt(used.select("id", "label", "width", "vec"), "of_rows", of_rows, "of_anchors", of_anchors)
        right = dealt(questions, "of_anchors", of_anchors, "of_rows", of_rows)
        names = [part.split()[0] for part in schema.split(", ")]
        keys = ["of_rows", "of_anchors"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            lambda a, b: pd.DataFrame(list(task(a, b)) if len(a) and len(b) else [], columns=names), schema)

    # Each block hands on at most ``positives`` rows an anchor.
    near = meet(asking, lambda a, b: _positives(a, b, scale, positives), "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    best = near.withColumn("n", place).filter(F.col("n") <= positives).groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("n", F.col("id").alias("id"), "score")).alias("positives"))
    questions = scratch.write(asking.join(best, "id"), "questions")

    hard = meet(questions, lambda a, b: _negatives(a, b, scale, negatives, low, high),
                "anchor_id long, n int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "n").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
