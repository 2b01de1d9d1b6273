"""Posterior draws to effects, intervals and planned contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.contrasts import contrast_table
from ..operators.draws import latent_moments, spread_draws
from ..operators.effects import condition_effects, simple_slopes, std_coefs, tidy_metrics
from ..operators.quantiles import interval_set, median_qi
from ..operators.shape import to_long
from ..session import cut_lineage


class EffectReport(NamedTuple):
    """``effects`` per draw and cell, ``intervals`` per cell and metric, ``contrasts`` with text."""

    effects: DataFrame
    intervals: DataFrame
    contrasts: DataFrame


def effect_report(
    draws: DataFrame,
    people: DataFrame,
    labels: DataFrame,
    weights: Mapping[str, Column],
    sign: int = 1,
    mode: str = "sum",
    derived: Mapping[str, tuple[str, str]] | None = None,
    widths: Sequence[float] = (0.95,),
) -> EffectReport:
    """Condition effects of a fitted model.

    ``people`` has (jj, kk), ``labels`` one row per cell. Effects hold draws x cells rows, so the
    summaries behind them are small whatever the number of people. They are written once.
    """
    items = spread_draws(draws, {"alpha": ("ii",), "beta": ("ii",)}, ["draw"])
    cells = spread_draws(draws, {"delta": ("kk",)}, ["draw"])
    theta = spread_draws(draws, {"theta": ("jj",)}, ["draw"])
    effects = cut_lineage(condition_effects(people, theta, cells, items, sign).join(labels.distinct(), "kk", "right"))
    names = [c for c in labels.columns if c != "kk"]
    long = tidy_metrics(effects, ["kk", *names])
    intervals = interval_set(long, "estimate", ["kk", *names, "metric"], widths, name="estimate")
    return EffectReport(effects, intervals, contrast_table(effects, weights, mode=mode, derived=derived))


def covariate_report(
    draws: DataFrame,
    people: DataFrame,
    covariate: str,
    slope: str,
    coefs: Sequence[str] = (),
    values: Sequence[float] = (-1, 0, 1),
    sign: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Simple slopes (z, n, p per draw, cell and covariate value) and standardised coefficients."""
    items = spread_draws(draws, {"alpha": ("ii",), "beta": ("ii",)}, ["draw"])
    scalars = {c: () for c in coefs if c != slope}
    cells = spread_draws(draws, {"delta": ("kk",), slope: ("kk",), **scalars}, ["draw"])
    theta = spread_draws(draws, {"theta": ("jj",)}, ["draw"])
    moments = latent_moments(people.select("jj", "kk", covariate), theta, cells, slopes={covariate: slope})
    slopes = simple_slopes(cells, moments, slope, values, items, sign)
    names = [slope, *scalars]
    std = std_coefs(people.select("jj", "kk", covariate), theta, cells, {covariate: slope}, names)
    long = to_long(std, names, "(.*)", [("term", "string")], "estimate")
    return slopes, median_qi(cut_lineage(long.filter(F.col("estimate").isNotNull())), ["estimate"], ["term", "kk"])
