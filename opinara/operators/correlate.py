"""Correlations of many columns from cross-products of blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import fmt_num
from ..session import ship_by_value

_ROWS = 2_048    # rows of a block, as one matrix
_MERGE = 32      # tasks whose sums are added first, per variable
_SUMS = ("n", "x", "x2", "y", "y2", "xy", "odd")  # per pair, over the rows where both are given
_SUM_TYPE = "i int, part int, at array<double>, " + ", ".join(f"{s} array<double>" for s in _SUMS)


def cor_matrix(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations: one row per variable, null diagonal.

    A pair uses the rows in which both are given; without two such rows, or without variation among them, its
    correlation is null, and a value that is not finite makes it NaN. ``digits`` turns the numbers into text without a
    leading zero and the diagonal into empty text.

    Rows are read once as matrices of 2,048 rows: products of the values and of the masks of given values add up, per
    task, to sums for all pairs at once. The plan grows with the number of columns, not of pairs. A task holds seven
    matrices of columns x columns numbers, 14 MB for 500 columns. Every task takes values relative to its own column
    means, so that sums do not cancel; adding up sums moves them to one point.
    """
    p = len(cols)
    values = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS x{i}" for i, c in enumerate(cols)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cross_products(batches, p)

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_added(table, p)])

    def finish(table: pa.Table) -> pa.Table:
        sums = _added(table, p)
        i = sums.column("i")[0].as_py()
        return pa.table({"i": pa.array([i], pa.int32()), "r": pa.array([_correlations(sums, i)], pa.list_(pa.float64()))})

    # Sums of one variable meet by parts of the tasks first, so that no group grows with all tasks' rows.
    sums = values.mapInArrow(blocks, _SUM_TYPE).withColumn("part", F.spark_partition_id() % _MERGE)
    sums = sums.groupBy("i", "part").applyInArrow(add, _SUM_TYPE).groupBy("i").applyInArrow(finish, "i int, r array<double>")
    every = df.sparkSession.range(p).select(F.col("id").cast("int").alias("_i"))  # also without any rows
    rows = F.broadcast(every).join(sums, F.col("i") == F.col("_i"), "left")
    if digits is not None:
        rows = rows.withColumn("r", F.transform("r", lambda r: F.coalesce(fmt_num(r, digits, leading_zero=False), F.lit(""))))
        rows = rows.withColumn("r", F.coalesce("r", F.array_repeat(F.lit(""), p)))
    names = F.array(*map(F.lit, cols))
    return rows.withColumns({"rank": F.col("_i") + 1, "term": names[F.col("_i")]}).selectExpr(
        "rank", "term", *[f"r[{j}] AS `{c}`" for j, c in enumerate(cols)])


def _cross_products(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of one task, for every pair of columns."""
    n, x, x2, xy, odd = (np.zeros((p, p)) for _ in range(5))
    at = None
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            given = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
            v = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns])
            strange = ~np.isfinite(v)
            if strange.any():
                s = strange.astype(float)
                odd += s.T @ given + given.T @ s - s.T @ s
                v = np.where(strange, 0.0, v)
            if at is None:
                at = v.sum(axis=0) / np.maximum((given * ~strange).sum(axis=0), 1)
            v = np.where(strange, 0.0, (v - at) * given)
            n += given.T @ given
            x += v.T @ given
            x2 += (v * v).T @ given
            xy += v.T @ v
    if at is not None:
        yield _sum_rows(range(p), np.tile(at, (p, 1)), [n, x, x2, x.T, x2.T, xy, odd])


def _sum_rows(rows, at: np.ndarray, matrices: Sequence[np.ndarray]) -> pa.RecordBatch:
    rows = list(rows)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
             for m in (at, *matrices)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([0] * len(rows), pa.int32()), *lists],
                                      ["i", "part", "at", *_SUMS])


def _added(table: pa.Table, p: int) -> pa.RecordBatch:
    """The sums of one variable over all rows given, taken relative to one point."""
    def matrix(name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, p)

    i = table.column("i")[0].as_py()
    at = matrix("at")
    n, x, x2, y, y2, xy, odd = map(matrix, _SUMS)
    dy = at - at[:1]
    dx = dy[:, i:i + 1]
    moved = [n, x + n * dx, x2 + 2 * dx * x + n * dx**2, y + n * dy, y2 + 2 * dy * y + n * dy**2,
             xy + dy * x + dx * y + n * dx * dy, odd]
    out = _sum_rows([i], at[:1], [m.sum(axis=0, keepdims=True) for m in moved])
    return out.set_column(1, "part", table.column("part").slice(0, 1).combine_chunks())


def _correlations(sums: pa.RecordBatch, i: int) -> list:
    """Correlations of one variable with all, None where there is none."""
    n, x, x2, y, y2, xy, odd = (sums.column(s).flatten().to_numpy() for s in _SUMS)
    out = []
    for j in range(len(n)):
        if j == i or n[j] < 2:
            out.append(None)
            continue
        vx, vy = x2[j] - x[j] ** 2 / n[j], y2[j] - y[j] ** 2 / n[j]
        if odd[j]:
            out.append(float("nan"))
        elif vx > 1e-12 * x2[j] and vy > 1e-12 * y2[j]:  # what rounding leaves of a constant is no variation
            out.append(float(np.clip((xy[j] - x[j] * y[j] / n[j]) / np.sqrt(vx * vy), -1.0, 1.0)))
        else:
            out.append(None)
    return out


ship_by_value(__name__)
