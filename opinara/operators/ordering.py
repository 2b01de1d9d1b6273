"""Row numbers, ranks, dense codes and running totals without a one-partition window.

A range sort spreads the rows; positions inside a partition plus the offset of the partition give
the global position. Only one row per partition is combined. The sorted rows are checkpointed, so
that the two uses see the same partition boundaries even when an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

_OFFSET_BITS = 33  # layout of monotonically_increasing_id(): partition above, position below


def _as_col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def _sorted_rows(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    # The hash as last key spreads rows that tie on the order over several range partitions.
    keys = [*[_as_col(c) for c in order], F.xxhash64(*[f"`{c}`" for c in df.columns])]
    placed = df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(placed).withColumns({
        "_part": F.shiftright("_at", _OFFSET_BITS),
        "_pos": F.col("_at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)),
    })


def _add_offsets(rows: DataFrame, totals: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Join, to every row, the sums over all earlier partitions (one row per partition)."""
    per_part = rows.groupBy("_part").agg(*[t.alias(n) for t, n in zip(totals, names, strict=True)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    return rows.join(F.broadcast(offsets), "_part")


def global_index(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based position of every row in the given order (make the order total)."""
    rows = _add_offsets(_sorted_rows(df, order), [F.count(F.lit(1))], ["_before"])
    return rows.withColumn(name, F.col("_before") + F.col("_pos") + 1).drop("_at", "_part", "_pos", "_before")


def row_id(df: DataFrame, order: Sequence[Column | str], name: str = "run") -> DataFrame:
    """Surrogate row number as the first column."""
    return global_index(df, order, name).select(name, *[f"`{c}`" for c in df.columns])


def rank_rows(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Row number after a global sort; add a unique last key to break ties."""
    return global_index(df, order, name)


def running_total(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Running totals (inclusive) of columns in the given order, ``{output: input}``."""
    rows = _sorted_rows(df, order)
    rows = _add_offsets(rows, [F.sum(c) for c in sums.values()], [f"_before_{n}" for n in sums])
    upto = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.sum(c).over(upto) + F.col(f"_before_{n}") for n, c in sums.items()}
    return rows.withColumns(out).drop("_at", "_part", "_pos", *[f"_before_{n}" for n in sums])


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """1-based code of the sorted distinct values; null stays null.

    Valid for the rows given only: code again after filtering.
    """
    keys = df.select(F.col(col).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    codes = global_index(keys, ["_key"], "_code")
    return (
        df.join(codes, F.col(col) == F.col("_key"), "left")
        .withColumn(out, F.col("_code"))
        .drop("_key", "_code")
    )


def index_within(df: DataFrame, by: Sequence[str], key: str, out: str) -> DataFrame:
    """Dense 1-based code of ``key`` that starts again in every group.

    Numbers all distinct (group, key) pairs at once and subtracts the first number of the group,
    so one large group never lands in one task.
    """
    pairs = global_index(df.select(*by, key).distinct(), [*by, key], "_code")
    first = pairs.groupBy(*by).agg(F.min("_code").alias("_first"))
    codes = pairs.join(first, list(by)).select(
        *by, key, (F.col("_code") - F.col("_first") + 1).alias(out)
    )
    return df.join(codes, [*by, key], "left")


def top_n_ties(df: DataFrame, n: int, by: Column | str, largest: bool = True) -> DataFrame:
    """The ``n`` largest (smallest) rows by value and all rows tied with the last of them.

    The threshold is a distributed top-k; the tied rows come back through a plain filter.
    """
    value = _as_col(by)
    order = value.desc_nulls_last() if largest else value.asc_nulls_last()
    head = df.filter(value.isNotNull()).select(value.alias("_v")).orderBy(
        F.desc("_v") if largest else F.asc("_v")).limit(n)
    last = head.agg((F.min("_v") if largest else F.max("_v")).alias("_v")).scalar()
    kept = df.filter(value >= last) if largest else df.filter(value <= last)
    return kept.orderBy(order)
