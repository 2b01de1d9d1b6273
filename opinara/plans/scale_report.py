"""Ratings and item parameters to the tables of a scale-development report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import fmt_num, round_even
from ..operators.graded import item_information
from ..operators.ordering import rank_rows
from ..operators.summary import cor_matrix, group_means, prop_wide


class ScaleReport(NamedTuple):
    """``items`` ranked by information, ``means`` in the same order, ``correlations`` as text."""

    items: DataFrame
    means: DataFrame
    correlations: DataFrame


def scale_report(
    ratings: DataFrame,
    parameters: DataFrame,
    y: str,
    categories: Sequence[int],
    scales: Mapping[str, str],
    item: str = "item",
    digits: int = 2,
) -> ScaleReport:
    """``ratings`` has one row per person and item, ``parameters`` one row per item.

    Each table is one aggregation of the ratings; ranks and texts are computed on item rows.
    """
    informed = item_information(parameters).select("item", "alpha", "information")
    shares = prop_wide(ratings, [item], y, categories, "pct_").withColumnRenamed(item, "item")
    table = informed.join(shares, "item")
    ranked = rank_rows(table, [F.desc("information"), "item"])
    items = ranked.select(
        "rank", "item", fmt_num("information", digits).alias("information"), fmt_num("alpha", digits).alias("alpha"),
        *[round_even(100 * F.col(f"pct_{k}"), 0).alias(f"pct_{k}") for k in categories])
    means = group_means(ratings, [item], list(scales)).withColumnRenamed(item, "item")
    texts = means.select("item", *[fmt_num(c, digits).alias(label) for c, label in scales.items()])
    renamed = ratings.select(*[F.col(c).alias(label) for c, label in scales.items()])
    return ScaleReport(items, ranked.select("rank", "item").join(texts, "item", "left"),
                       cor_matrix(renamed, list(scales.values()), digits))
