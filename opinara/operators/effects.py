"""Standardised effects, predicted endorsements and counterfactual curves per posterior draw."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.irt import irf, linear_predictor, monotonic
from ..session import cut_lineage
from .draws import KEYS, cell_moments, draw_z, latent_moments, pooled_moments, scale_by_sd
from .quantiles import interval_width, median_qi
from .shape import cross_tuples, spread_rows


def effect_z(
    people: DataFrame,
    person_draws: DataFrame,
    cell_draws: DataFrame,
    labels: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    by: Sequence[str] = ("kk",),
) -> DataFrame:
    """Standardised condition effect per draw and cell: ``(delta - mean) / sd`` of theta + delta.

    ``labels`` (one row per cell) names the cells; cells without draws are kept.
    """
    moments = latent_moments(people, person_draws, cell_draws, by=by, keys=keys)
    z = draw_z(cell_draws.select(*keys, *by, "delta"), F.col("delta"), moments, keys)
    return z if labels is None else z.join(labels.distinct(), list(by), "right")


def count_endorsed(
    rows: DataFrame,
    by: Sequence[str],
    eta: str = "delta",
    sign: int = 1,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = ("z",),
) -> DataFrame:
    """Number ``n`` and share ``p`` of items endorsed at theta = 0, from rows that carry item draws.

    Carried columns must be constant within a draw and cell; otherwise the query fails.
    """
    p = irf(F.col("alpha"), F.col("beta"), 0.0, F.col(eta), sign)
    constant = [
        F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))
        .otherwise(F.raise_error(F.lit(f"{c} differs within a draw and cell")).cast("double")).alias(c)
        for c in carry
    ]
    return rows.groupBy(*keys, *by).agg(*constant, F.sum(p).alias("n"), F.avg(p).alias("p"))


def item_bank(item_draws: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per draw with its items as an array, as long as the questionnaire, in a fixed order."""
    return item_draws.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("alpha", "beta"))).alias("_items"))


def expected_counts(rows: DataFrame, eta: Column, keep: Sequence[str], sign: int = 1,
                    keys: Sequence[str] = KEYS, n_items: int | None = None) -> DataFrame:
    """z, ``n`` and ``p`` for rows that carry the moments and the item bank of their draw.

    Items are summed inside the row, so a grid of any size adds rows but neither a row per item
    nor a shuffle. With ``n_items``, the length of the questionnaire, the sum is written out and
    compiled, several times faster than the loop; a draw with another number of items is an error.
    """
    rows = rows.withColumn("_eta", eta)

    def p(item: Column) -> Column:
        return irf(item["alpha"], item["beta"], 0.0, F.col("_eta"), sign)

    if n_items is None:
        n = F.aggregate("_items", F.lit(0.0), lambda acc, i: acc + p(i))
    else:
        total = reduce(lambda acc, i: acc + p(F.col("_items")[i]), range(1, n_items), p(F.col("_items")[0]))
        wrong = F.raise_error(F.lit(f"a draw does not have {n_items} items")).cast("double")
        n = F.when(F.size("_items") == n_items, total).otherwise(wrong)
    out = rows.select(*keys, *keep, ((F.col("_eta") - F.col("mean")) / F.col("sd")).alias("z"),
                      n.alias("n"), F.size("_items").alias("_size"))
    return out.select(*keys, *keep, "z", "n", (F.col("n") / F.col("_size")).alias("p"))


def predict_counts(
    effects: DataFrame,
    item_draws: DataFrame,
    by: Sequence[str],
    eta: str = "delta",
    sign: int = 1,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = ("z",),
) -> DataFrame:
    """Predicted counts per draw and cell; ``effects`` has one row per draw and cell, not per person."""
    rows = effects.join(item_draws.select(*keys, "alpha", "beta"), list(keys))
    return count_endorsed(rows, by, eta, sign, keys, carry)


def condition_effects(
    people: DataFrame,
    person_draws: DataFrame,
    cell_draws: DataFrame,
    item_draws: DataFrame,
    sign: int = 1,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """z, n and p per draw and cell."""
    effects = effect_z(people, person_draws, cell_draws, keys=keys)
    return predict_counts(effects, item_draws, ["kk"], sign=sign, keys=keys)


def coded_effects(
    coef_draws: DataFrame,
    names: Sequence[str],
    cells: Sequence[tuple],
    xs: Sequence[str],
    bs: Sequence[str],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Cell effects ``delta`` from coded design cells and coefficient draws.

    ``cells`` lists the design (labels and codes) once per cell, not per person; it is attached
    to every draw by a generator.
    """
    rows = cross_tuples(coef_draws, names, cells, distinct=False)
    return rows.withColumn("delta", linear_predictor(xs, bs)).select(*keys, *names, "delta")


def std_coefs(
    people: DataFrame,
    person_draws: DataFrame,
    cell_draws: DataFrame,
    slopes: Mapping[str, str],
    coefs: Sequence[str],
    keys: Sequence[str] = KEYS,
    names: str = "{col}",
) -> DataFrame:
    """Coefficients per draw and cell divided by the SD of the latent outcome."""
    moments = latent_moments(people, person_draws, cell_draws, slopes=slopes, keys=keys)
    return scale_by_sd(cell_draws.select(*keys, "kk", *coefs), coefs, moments, keys, names)


def sweep(
    coef_draws: DataFrame,
    item_draws: DataFrame,
    moments: DataFrame,
    outcomes: Mapping[str, str],
    values: Sequence[float],
    fixed: Mapping[str, float],
    coefs: Mapping[str, str],
    sign: int = -1,
    keys: Sequence[str] = KEYS,
    n_items: int | None = None,
) -> DataFrame:
    """Move one covariate at a time over a grid, the others fixed: z, n and p per draw and point.

    ``outcomes`` maps a label to the covariate that moves, ``fixed`` holds the resting values of
    all covariates, ``coefs`` maps covariates to coefficient columns. The grid is a literal.
    """
    points = []
    for label, moving in outcomes.items():
        for v in values:
            at = {**fixed, moving: v}
            points.append((label, float(v), *[float(at[x]) for x in coefs]))
    per_draw = coef_draws.select(*keys, *coefs.values()).join(moments, list(keys)).join(
        item_bank(item_draws, keys), list(keys))
    rows = cross_tuples(spread_rows(per_draw, keys), ["outcome", "x", *[f"_{x}" for x in coefs]], points, distinct=False)
    eta = linear_predictor([f"_{x}" for x in coefs], list(coefs.values()))
    return expected_counts(rows, eta, ["outcome", "x"], sign, keys, n_items)


def curve_by(
    cell_draws: DataFrame,
    item_draws: DataFrame,
    moments: DataFrame,
    cells: Sequence[tuple[int, object]],
    slopes: Mapping[object, str],
    values: Sequence[float],
    group: str = "x_for",
    sign: int = 1,
    keys: Sequence[str] = KEYS,
    n_items: int | None = None,
) -> DataFrame:
    """Condition-averaged curve over a covariate for each group of cells.

    ``cells`` pairs a cell with its group, ``slopes`` gives the coefficient column of each group.
    """
    in_group = F.lit(None)
    for kk, g in cells:
        in_group = F.when(F.col("kk") == kk, F.lit(g)).otherwise(in_group)
    slope = F.lit(None).cast("double")
    for g, c in slopes.items():
        slope = F.when(F.col(group) == F.lit(g), F.col(f"_{c}")).otherwise(slope)
    firsts = [F.first(c).alias(f"_{c}") for c in slopes.values()]
    mean = cell_draws.withColumn(group, in_group).groupBy(*keys, group).agg(F.avg("delta").alias("_delta"), *firsts)
    per_draw = mean.join(moments, list(keys)).join(item_bank(item_draws, keys), list(keys))
    rows = cross_tuples(spread_rows(per_draw, keys), ["x"], [(float(v),) for v in values], distinct=False)
    return expected_counts(rows, F.col("_delta") + slope * F.col("x"), [group, "x"], sign, keys, n_items)


def simple_slopes(
    cell_draws: DataFrame,
    moments: DataFrame,
    slope: str,
    values: Sequence[float] = (-1, 0, 1),
    item_draws: DataFrame | None = None,
    sign: int = 1,
    keys: Sequence[str] = KEYS,
    n_items: int | None = None,
) -> DataFrame:
    """Cell effects at chosen covariate values; with item draws also n and p."""
    per_cell = cell_draws.select(*keys, "kk", "delta", slope).join(moments, list(keys))
    if item_draws is not None:
        per_cell = per_cell.join(item_bank(item_draws, keys), list(keys))
    rows = cross_tuples(per_cell, ["x"], [(float(v),) for v in values], distinct=False)
    eta = F.col("delta") + F.col(slope) * F.col("x")
    if item_draws is None:
        return rows.select(*keys, "kk", "x", ((eta - F.col("mean")) / F.col("sd")).alias("z"))
    return expected_counts(rows, eta, ["kk", "x"], sign, keys, n_items)


def monotonic_draws(shares: DataFrame, simplex: str, levels: int, variant: str = "model",
                    keys: Sequence[str] = KEYS, out: str = "mo") -> DataFrame:
    """Monotonic transform of every level of an ordinal predictor, per draw."""
    rows = cross_tuples(shares.select(*keys, simplex), ["x"], [(x,) for x in range(1, levels + 1)], distinct=False)
    return rows.select(*keys, "x", monotonic(F.col(simplex), "x", variant).alias(out))


def ordinal_moments(
    people: DataFrame, person_draws: DataFrame, cell_draws: DataFrame, mo_draws: DataFrame,
    slope: str, x: str, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Pooled moments when the predictor is ordinal: cells are split by its levels first."""
    cells = cell_moments(people.withColumnRenamed(x, "x"), person_draws, by=("kk", "x"), keys=keys)
    joined = cells.join(cell_draws.select(*keys, "kk", "delta", slope), [*keys, "kk"]).join(
        mo_draws, [*keys, "x"])
    return pooled_moments(joined, F.col("delta") + F.col(slope) * F.col("mo"), keys=keys)


def predict_ordinal(
    mo_draws: DataFrame, coef_draws: DataFrame, coef: str, moments: DataFrame, item_draws: DataFrame,
    sign: int = 1, keys: Sequence[str] = KEYS, n_items: int | None = None,
) -> DataFrame:
    """z, n and p over the levels of an ordinal predictor."""
    rows = mo_draws.join(coef_draws.select(*keys, coef), list(keys)).join(moments, list(keys)).join(
        item_bank(item_draws, keys), list(keys))
    return expected_counts(rows, F.col(coef) * F.col("mo"), ["x"], sign, keys, n_items)


def precision_by_run(
    people: DataFrame, person_draws: DataFrame, cell_draws: DataFrame, item_draws: DataFrame,
    sign: int = 1, run: str = "run",
) -> DataFrame:
    """Interval and interval width of z, n and p per fit and cell, for stacked fits.

    Fits are rows, told apart by a key, so all of them are summarised in one job.
    """
    effects = condition_effects(people, person_draws, cell_draws, item_draws, sign, (run, "draw"))
    metrics = tidy_metrics(effects, [run, "draw", "kk"])
    # One value per draw: the group size is the number of posterior draws of a fit.
    return interval_width(median_qi(cut_lineage(metrics), ["estimate"], [run, "metric", "kk"]))


def tidy_metrics(effects: DataFrame, keep: Sequence[str], metrics: Sequence[str] = ("z", "n", "p")) -> DataFrame:
    """Effect columns to (metric, estimate) rows."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in metrics]
    return effects.select(*keep, F.inline(F.array(*cells)))

