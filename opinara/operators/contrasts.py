"""Planned contrasts and marginal comparisons of per-draw effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import fmt_estimate
from ..session import cut_lineage
from .quantiles import median_qi

Weights = Mapping[str, Column]


def _per_draw(
    effects: DataFrame, weights: Weights, by: Sequence[str], mode: str, value: str, keys: Sequence[str]
) -> DataFrame:
    """One row per draw with one column per contrast."""
    group = [*keys, *by]
    if mode in ("sum", "mean"):
        fn = F.sum if mode == "sum" else F.avg
        # A null weight makes the product null, which takes the effect out of that contrast.
        return effects.groupBy(*group).agg(*[fn(F.col(value) * w.cast("double")).alias(n) for n, w in weights.items()])
    if mode != "balanced":
        raise ValueError(f"unknown mode {mode!r}")
    cells = [F.struct(F.lit(n).alias("_c"), w.cast("double").alias("_w")) for n, w in weights.items()]
    rows = effects.select(*group, F.col(value).alias("_v"), F.inline(F.array(*cells))).filter(F.col("_w").isNotNull())
    means = rows.groupBy(*group, "_c", "_w").agg(F.avg("_v").alias("_v"))
    return means.groupBy(*group).agg(
        *[F.sum(F.when(F.col("_c") == n, F.col("_v") * F.col("_w"))).alias(n) for n in weights])


def _as_rows(wide: DataFrame, names: Sequence[str], group: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("contrast"), F.col(n).alias("d")) for n in names]
    return wide.select(*group, F.inline(F.array(*cells))).filter(F.col("d").isNotNull())


def contrast(
    effects: DataFrame,
    weights: Weights,
    by: Sequence[str] = (),
    mode: str = "sum",
    value: str = "z",
    keys: Sequence[str] = ("draw",),
    derived: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Contrast ``d`` per draw.

    ``weights`` are column expressions over the cell labels. ``sum`` and ``mean`` combine
    ``value * weight`` over the cells. ``balanced`` averages the cells of each direction first
    and then adds ``mean * direction``, which also suits directions with unequal numbers of cells.
    ``derived`` are differences of two contrasts, ``{name: (plus, minus)}``.
    """
    wide = _per_draw(effects, weights, by, mode, value, keys)
    extra = {n: F.col(plus) - F.col(minus) for n, (plus, minus) in (derived or {}).items()}
    return _as_rows(wide.withColumns(extra), [*weights, *extra], [*keys, *by])


def contrast_table(
    effects: DataFrame,
    weights: Weights,
    by: Sequence[str] = (),
    mode: str = "sum",
    derived: Mapping[str, tuple[str, str]] | None = None,
    keys: Sequence[str] = ("draw",),
) -> DataFrame:
    """Median and 95% interval of planned contrasts, with the text for a report."""
    rows = contrast(effects, weights, by, mode, keys=keys, derived=derived)
    # One value per draw in every group: far fewer rows than the effects they come from.
    table = median_qi(cut_lineage(rows), ["d"], [*by, "contrast"])
    return table.withColumn("d_text", fmt_estimate("d", "lower", "upper"))


def marginal_diff(
    effects: DataFrame, factor: str, a, b, by: Sequence[str] = (), value: str = "z",
    keys: Sequence[str] = ("draw",),
) -> DataFrame:
    """Per draw, the mean over level ``a`` minus the mean over level ``b``; levels by name."""
    def level(x) -> Column:
        return F.avg(F.when(F.col(factor) == F.lit(x), F.col(value)))

    return effects.groupBy(*keys, *by).agg((level(a) - level(b)).alias("d"))


def marginal_table(effects: DataFrame, factors: Sequence[str], value: str,
                   keys: Sequence[str] = ("draw",)) -> DataFrame:
    """Average a coefficient over cells within factors per draw, then summarise over draws."""
    means = effects.groupBy(*keys, *factors).agg(F.avg(value).alias("b"))
    return median_qi(cut_lineage(means), ["b"], factors)


def align_signs(df: DataFrame, key: str, signs: Mapping[object, int], value: str) -> DataFrame:
    """Turn coefficients so that larger means the same for every key."""
    sign: Column = F.lit(None).cast("int")
    for k, s in signs.items():
        sign = F.when(F.col(key) == F.lit(k), s).otherwise(sign)
    return df.withColumn(value, F.col(value) * sign)


def coded(*pairs: tuple[Column, float | None], default: float | None = None) -> Column:
    """Contrast weight by first matching condition."""
    out: Column = F.lit(default).cast("double")
    for cond, w in reversed(pairs):
        out = F.when(cond, F.lit(w).cast("double")).otherwise(out)
    return out
