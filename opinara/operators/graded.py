"""Graded-response items: category probabilities, information and item selection.

Item tables have one row per item: ``item``, ``alpha`` and thresholds ``beta_1 .. beta_{K-1}``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.irt import inv_logit, irf
from .draws import spread_draws
from .ordering import rank_rows, top_n_ties
from .quantiles import quantiles
from .shape import cross_tuples, seq


def thresholds(items: DataFrame) -> list[str]:
    names = [c for c in items.columns if c.startswith("beta_")]
    return sorted(names, key=lambda c: int(c.split("_")[1]))


def _category_probs(items: DataFrame, theta: Column) -> list[Column]:
    above = [inv_logit(F.col("alpha") * theta - F.col(b)) for b in thresholds(items)]
    upper, lower = [F.lit(1.0), *above], [*above, F.lit(0.0)]
    return [u - v for u, v in zip(upper, lower, strict=True)]


def _on_grid(items: DataFrame, theta: Sequence[float]) -> DataFrame:
    return cross_tuples(items, ["theta"], [(float(t),) for t in theta], distinct=False)


def _at(mean: float | None, sd: float | None) -> Column:
    """Grid values are z-scores when the latent mean and SD are given."""
    return F.col("theta") if sd is None else F.col("theta") * F.lit(sd) + F.lit(mean)


def grm_probs(items: DataFrame, theta: Sequence[float], mean: float | None = None,
              sd: float | None = None) -> DataFrame:
    """Probability of every category over a theta grid, one column per category."""
    rows = _on_grid(items, theta)
    probs = _category_probs(items, _at(mean, sd))
    return rows.select("item", "theta", *[p.alias(f"p_{k}") for k, p in enumerate(probs, 1)])


def _information(items: DataFrame, theta: Column) -> list[Column]:
    return [F.col("alpha") * F.col("alpha") * p * (1 - p) for p in _category_probs(items, theta)]


def grm_information(items: DataFrame, theta: Sequence[float], level: str = "item",
                    mean: float | None = None, sd: float | None = None) -> DataFrame:
    """Information over a theta grid per ``option``, per ``item`` or in ``total``."""
    rows, options = _on_grid(items, theta), _information(items, _at(mean, sd))
    if level == "option":
        return rows.select("item", "theta", *[i.alias(f"info_{k}") for k, i in enumerate(options, 1)])
    info = sum(options[1:], options[0]).alias("info")
    if level == "item":
        return rows.select("item", "theta", info)
    return rows.select("theta", info).groupBy("theta").agg(F.sum("info").alias("info"))


def item_information(items: DataFrame, method: str = "closed", lo: float = -99.0, hi: float = 99.0,
                     step: float = 0.01, out: str = "information") -> DataFrame:
    """Item information integrated over theta.

    ``closed`` is exact over the whole real line: ``alpha * (2 + sum(2 + d - d * coth(d / 2)))``
    with ``d`` the distances of neighbouring thresholds. ``grid`` sums over a fixed grid.
    """
    betas = thresholds(items)
    if method == "closed":
        total: Column = F.lit(2.0)
        for a, b in zip(betas, betas[1:]):
            d = F.col(b) - F.col(a)
            total = total + F.when(F.abs(d) < 1e-6, F.lit(0.0)).otherwise(2.0 + d - d / F.tanh(d / 2.0))
        return items.withColumn(out, F.col("alpha") * total)
    n = int(round((hi - lo) / step))
    points = items.select("item", "alpha", *betas, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_i"))
    theta = F.lit(lo) + F.col("_i") * F.lit(step)
    options = _information(items, theta)
    info = points.select("item", sum(options[1:], options[0]).alias("_info"))
    sums = info.groupBy("item").agg((F.sum("_info") * step).alias(out))
    return items.join(sums, "item")


def select_items(items: DataFrame, n: int = 25, by: str = "information") -> DataFrame:
    """The ``n`` most informative items, ties with the last one included."""
    return top_n_ties(items, n, by)


def scale_curves(items: DataFrame, theta: Sequence[float], sizes: Sequence[int] | None = None,
                 by: str = "information", mean: float | None = None, sd: float | None = None) -> DataFrame:
    """Total information of the scales made of the best 1, 2, … items (all sizes, or those named).

    Items are ranked once; a running sum over ranks gives all scale sizes. A group of the window
    is one theta value and holds one row per item.
    """
    ranked = rank_rows(items, [F.desc(by), "item"], "n_items")
    options = _information(items, _at(mean, sd))
    rows = _on_grid(ranked, theta).select("theta", "n_items", sum(options[1:], options[0]).alias("_info"))
    upto = Window.partitionBy("theta").orderBy("n_items").rowsBetween(Window.unboundedPreceding, 0)
    curves = rows.withColumn("info", F.sum("_info").over(upto)).drop("_info")
    return curves if sizes is None else curves.filter(F.col("n_items").isin(*sizes))


def item_medians(draws: DataFrame, n_thresholds: int, index: str = "ii") -> DataFrame:
    """Posterior medians of discrimination and thresholds per item (one value per draw each)."""
    names = ["alpha", *[f"beta_{k}" for k in range(1, n_thresholds + 1)]]
    long = spread_draws(draws, {"beta": (index, "kk"), "alpha": (index,)})
    cells = F.array(F.struct(F.lit("alpha").alias("name"), F.when(F.col("kk") == 1, F.col("alpha")).alias("v")),
                    F.struct(F.concat(F.lit("beta_"), F.col("kk").cast("string")).alias("name"),
                             F.col("beta").alias("v")))
    values = long.select(index, F.inline(cells)).filter(F.col("v").isNotNull())
    med = quantiles(values, "v", [index, "name"], (0.5,), ("v",))
    return med.groupBy(F.col(index).alias("item")).agg(
        *[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])


def icc(items: DataFrame, theta: Sequence[float], sign: int = 1) -> DataFrame:
    """Item characteristic curves of binary items (``item, alpha, beta``) over a theta grid."""
    return _on_grid(items, theta).select("item", "theta", irf("alpha", "beta", F.col("theta"), 0.0, sign).alias("p"))


__all__ = ["grm_information", "grm_probs", "icc", "item_information", "item_medians", "scale_curves",
           "select_items", "seq", "thresholds"]
