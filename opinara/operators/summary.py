"""Summaries of items, groups and scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import fmt_pct
from .correlate import cor_matrix
from .ordering import rank_rows, running_total
from .quantiles import quantiles
from .shape import join_na


# -- items -----------------------------------------------------------------------------------


def item_rates(df: DataFrame, item: Sequence[str], response: str, rate: str = "pr") -> DataFrame:
    """Share of endorsements per item."""
    return df.groupBy(*item).agg(F.avg(response).alias(rate))


def item_rate_table(df: DataFrame, item: Sequence[str], response: str) -> DataFrame:
    """Items ranked by endorsement rate, with the rate as percent text."""
    ranked = rank_rows(item_rates(df, item, response), [F.desc("pr"), *item], "rank")
    return ranked.select("rank", *item, F.round("pr", 6).alias("pr"), fmt_pct("pr").alias("pr_text"))


def threshold_share(df: DataFrame, by: Sequence[str], value: str, at_least: float, out: str) -> DataFrame:
    """Share of rows at or above a threshold, missing values left out."""
    return df.groupBy(*by).agg(F.avg((F.col(value) >= at_least).cast("int")).alias(out))


def group_means(df: DataFrame, by: Sequence[str], cols: Sequence[str], na_rm: bool = True,
                names: str = "{col}") -> DataFrame:
    """Means of several columns per group. ``na_rm=False``: one missing value makes the mean missing."""
    def mean(c: str) -> Column:
        return F.avg(c) if na_rm else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))

    return df.groupBy(*by).agg(*[mean(c).alias(names.format(col=c)) for c in cols])


def _only_listed(df: DataFrame, col: str, values: Sequence, drop_others: bool) -> DataFrame:
    """The column as ``_value``; a value that is not listed is an error when its row is read, unless not wanted."""
    value = F.col(col)
    other = value.isNotNull() & ~value.isin(*values)
    text = F.concat(F.lit("value without a column: "), value.cast("string"))
    return df.withColumn("_value", value if drop_others else F.when(other, F.raise_error(text)).otherwise(value))


def count_wide(df: DataFrame, by: Sequence[str], col: str, values: Sequence, prefix: str = "n_",
               drop_others: bool = False) -> DataFrame:
    """Counts per group and value, one column per value, zero where absent.

    Missing values are not counted; values outside the list raise an error unless ``drop_others``.
    """
    return _only_listed(df, col, values, drop_others).groupBy(*by).agg(
        *[F.count_if(F.col("_value") == F.lit(v)).alias(f"{prefix}{v}") for v in values])


def prop_wide(df: DataFrame, by: Sequence[str], col: str, values: Sequence, prefix: str = "p_",
              drop_others: bool = False) -> DataFrame:
    """Within-group proportions per value, one column per value; the total counts all listed values.

    Missing values are not counted; values outside the list raise an error unless ``drop_others``.
    """
    total = F.count_if(F.col("_value").isin(*values))
    return _only_listed(df, col, values, drop_others).groupBy(*by).agg(*[
        (F.count_if(F.col("_value") == F.lit(v)) / total).alias(f"{prefix}{v}") for v in values
    ])


def share_of_total(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Count and share of every value within its group, in long form."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return join_na(counts, totals, list(by), "inner").withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def model_sizes(df: DataFrame, indices: Mapping[str, str]) -> DataFrame:
    """Number of rows and the largest value of each index, e.g. ``{"I": "ii", "J": "jj"}``."""
    return df.agg(F.count(F.lit(1)).alias("N"), *[F.max(c).alias(n) for n, c in indices.items()])


# -- groups ----------------------------------------------------------------------------------


def describe(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Number of answers, mean and sample SD per group and column (long form)."""
    aggs = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                     F.stddev_samp(c).alias("sd")) for c in cols]
    wide = df.groupBy(*by).agg(F.array(*aggs).alias("_stats"))
    return wide.select(*by, F.inline("_stats"))


def demographics(df: DataFrame, col: str) -> DataFrame:
    """Counts by category, missing answers as their own category."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median and range; the counts behind the median shrink to distinct values."""
    q = quantiles(df, col, by, (0.0, 0.5, 1.0), ("min", "median", "max"))
    return q


def midpoint_shares(df: DataFrame, by: Sequence[str], col: str, midpoint: float) -> DataFrame:
    """Shares below and above the scale midpoint among those who answered."""
    return df.groupBy(*by).agg(
        F.avg((F.col(col) < midpoint).cast("int")).alias("below"),
        F.avg((F.col(col) > midpoint).cast("int")).alias("above"),
    )


def cohens_d(df: DataFrame, group: str, a, b, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Standardised mean difference ``a - b`` with the pooled SD, one row per column."""
    def part(g, c: str, fn) -> Column:
        return fn(F.when(F.col(group) == F.lit(g), F.col(c)))

    rows = []
    for c in cols:
        na, nb = part(a, c, F.count), part(b, c, F.count)
        pooled = F.sqrt(((na - 1) * part(a, c, F.var_samp) + (nb - 1) * part(b, c, F.var_samp)) / (na + nb - 2))
        rows.append(F.struct(F.lit(c).alias("variable"),
                             ((part(a, c, F.avg) - part(b, c, F.avg)) / pooled).alias("d")))
    wide = df.groupBy(*by).agg(F.array(*rows).alias("_d"))
    return wide.select(*by, F.inline("_d"))


def prob_superiority(df: DataFrame, group: str, a, b, col: str) -> DataFrame:
    """Share of cross-group pairs in which the member of ``a`` has the larger value.

    Computed from counts per distinct value and a distributed running total, never from pairs.
    ``strict`` counts ties as no win, ``half_ties`` as half a win.
    """
    counts = (
        df.filter(F.col(group).isin(a, b) & F.col(col).isNotNull())
        .groupBy(F.col(col).alias("_v"))
        .agg(F.count_if(F.col(group) == F.lit(a)).alias("_a"), F.count_if(F.col(group) == F.lit(b)).alias("_b"))
    )
    below = running_total(counts, ["_v"], {"_upto_b": "_b"})
    wins = F.sum(F.col("_a").cast("double") * (F.col("_upto_b") - F.col("_b")))
    ties = F.sum(F.col("_a").cast("double") * F.col("_b"))
    pairs = F.sum("_a").cast("double") * F.sum("_b")
    return below.agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
        (wins / pairs).alias("strict"), ((wins + 0.5 * ties) / pairs).alias("half_ties"),
    )


def prob_direction(df: DataFrame, claim: Column, by: Sequence[str] = (), out: str = "p") -> DataFrame:
    """Share of draws in which a comparison holds."""
    return df.groupBy(*by).agg(F.avg(claim.cast("int")).alias(out))


__all__ = ["cohens_d", "cor_matrix", "count_wide", "demographics", "describe", "group_means", "item_rate_table", "item_rates",
           "midpoint_shares", "model_sizes", "prob_direction", "prob_superiority", "prop_wide", "share_of_total", "spread",
           "threshold_share"]
