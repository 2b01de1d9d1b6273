"""Posterior draws as tables: tidy long forms, pooled moments and per-draw summaries.

Draw tables are keyed by ``draw`` (plus, where several fits are stacked, ``run``). ``chain`` and
``iteration`` are functions of the draw and never needed as join keys.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ("draw",)


# -- wide to tidy ----------------------------------------------------------------------------


def _indexed(columns: Sequence[str], param: str) -> dict[tuple[int, ...], str]:
    pattern = re.compile(rf"^{re.escape(param)}\[(\d+(?:,\d+)*)\]$")
    hits = ((pattern.match(c), c) for c in columns)
    return {tuple(map(int, m.group(1).split(","))): c for m, c in hits if m}


def spread_draws(
    draws: DataFrame,
    params: Mapping[str, Sequence[str]],
    keep: Sequence[str] = ("chain", "iteration", "draw"),
) -> DataFrame:
    """Tidy rows of indexed parameters, e.g. ``{"beta": ("ii", "kk"), "alpha": ("ii",), "mu": ()}``.

    A wide draw holds all its parameters in one row, so the long form is a generator over that
    row and needs no pivot and no shuffle. A parameter is either spread over columns ``beta[1]``,
    ``beta[2]``, … or stored as one array column ``beta``. Parameters with fewer indices repeat.
    """
    keep = [c for c in keep if c in draws.columns]
    names = list(dict.fromkeys(i for idx in params.values() for i in idx))
    if not names:
        return draws.select(*keep, *params)
    arrays = [p for p, idx in params.items() if idx and p in draws.columns]
    if arrays:
        if len(names) != 1:
            raise ValueError("array parameters take one index")
        scalars = [p for p, idx in params.items() if not idx]
        zipped = F.arrays_zip(*[F.col(p) for p in arrays])
        rows = draws.select(*keep, *scalars, F.posexplode(zipped).alias("_i", "_v"))
        return rows.select(*keep, (F.col("_i") + 1).alias(names[0]),
                           *[F.col(p) if p in scalars else F.col(f"_v.{p}").alias(p) for p in params])
    found = {p: _indexed(draws.columns, p) for p, idx in params.items() if idx}
    longest = max((p for p in found), key=lambda p: len(params[p]))
    full = tuple(params[longest])
    keys = sorted(set(found[longest]) | {
        k for p, cols in found.items() if tuple(params[p]) == full for k in cols})
    # One SQL text instead of one expression object per parameter: draws have thousands of columns.
    cells = []
    for key in keys:
        at = dict(zip(full, key, strict=True))
        fields = [f"'{i}', {at[i]}" for i in names]
        for p, idx in params.items():
            source = p if not idx else found[p].get(tuple(at[i] for i in idx))
            fields.append(f"'{p}', " + ("CAST(NULL AS DOUBLE)" if source is None else f"`{source}`"))
        cells.append(f"named_struct({', '.join(fields)})")
    return draws.select(*keep, F.expr(f"inline(array({', '.join(cells)}))"))


def gather_draws(
    draws: DataFrame, params: Mapping[str, str], keep: Sequence[str] = ("chain", "iteration", "draw")
) -> DataFrame:
    """Name/value rows of indexed parameters: ``variable``, ``value`` and the index column."""
    parts = [
        spread_draws(draws, {p: (idx,)}, keep).withColumn("variable", F.lit(p)).withColumnRenamed(p, "value")
        for p, idx in params.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# -- per-draw moments ------------------------------------------------------------------------


def draw_moments(df: DataFrame, value: Column | str, by: Sequence[str] = KEYS) -> DataFrame:
    """Mean and sample SD of an expression per draw, as partial aggregates."""
    x = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def cell_moments(
    people: DataFrame,
    person_draws: DataFrame,
    covariates: Sequence[str] = (),
    by: Sequence[str] = ("kk",),
    keys: Sequence[str] = KEYS,
    person: str = "jj",
    theta: str = "theta",
) -> DataFrame:
    """Moments of ``theta`` and covariates per draw and design cell.

    This is the only step that touches people x draws rows: one join on the person and one
    partial aggregation down to cells x draws rows. Everything that depends on cell coefficients
    is then computed from these moments. ``people`` may carry the fit (``run``) it belongs to.
    """
    on = [person, *[k for k in keys if k in people.columns and k in person_draws.columns]]
    rows = people.select(*on, *by, *covariates).distinct().join(person_draws, on)
    terms = [theta, *covariates]
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.avg(t).alias(f"_m_{t}") for t in terms]]
    aggs += [F.covar_pop(a, b).alias(f"_c_{a}_{b}") for a, b in combinations_with_replacement(terms, 2)]
    return rows.groupBy(*keys, *by).agg(*aggs)


def pooled_moments(
    cells: DataFrame,
    offset: Column,
    slopes: Mapping[str, Column] | None = None,
    keys: Sequence[str] = KEYS,
    theta: str = "theta",
) -> DataFrame:
    """Mean and sample SD, over all people, of ``theta + offset + sum(slope * covariate)`` per draw.

    ``offset`` and ``slopes`` are cell-level columns. Within-cell variance comes from the cell's
    second moments, between-cell variance from the cell means.
    """
    b: dict[str, Column] = {theta: F.lit(1.0), **(slopes or {})}
    mean = reduce(lambda x, y: x + y, (b[t] * F.col(f"_m_{t}") for t in b), offset)
    within = reduce(lambda x, y: x + y, (
        (1.0 if s == t else 2.0) * b[s] * b[t] * F.col(f"_c_{s}_{t}")
        for s, t in combinations_with_replacement(b, 2)))
    rows = cells.select(*keys, "_n", mean.alias("_mean"), within.alias("_var"))
    n, total = F.sum("_n"), F.sum(F.col("_n") * F.col("_mean"))
    squares = F.sum(F.col("_n") * (F.col("_var") + F.col("_mean") * F.col("_mean")))
    return rows.groupBy(*keys).agg(
        (total / n).alias("mean"),
        F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))).alias("sd"),
    )


def latent_moments(
    people: DataFrame,
    person_draws: DataFrame,
    cell_draws: DataFrame,
    offset: str = "delta",
    slopes: Mapping[str, str] | None = None,
    by: Sequence[str] = ("kk",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Pooled mean and SD per draw of the latent outcome, with cell effects and covariate slopes.

    ``slopes`` maps a covariate of ``people`` to its coefficient column in ``cell_draws``.
    """
    slopes = dict(slopes or {})
    cells = cell_moments(people, person_draws, list(slopes), by, keys)
    coefs = cell_draws.select(*keys, *by, F.col(offset).alias("_offset"),
                              *[F.col(c).alias(f"_b_{x}") for x, c in slopes.items()])
    joined = cells.join(coefs, [*keys, *by])
    return pooled_moments(joined, F.col("_offset"), {x: F.col(f"_b_{x}") for x in slopes}, keys)


def draw_z(df: DataFrame, value: Column, moments: DataFrame, keys: Sequence[str] = KEYS,
           out: str = "z") -> DataFrame:
    """Standardise a per-draw quantity by the pooled mean and SD of its draw."""
    return df.join(moments, list(keys)).withColumn(out, (value - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def scale_by_sd(df: DataFrame, cols: Sequence[str], moments: DataFrame, keys: Sequence[str] = KEYS,
                names: str = "{col}") -> DataFrame:
    """Divide coefficients by the latent SD of their draw."""
    out = {names.format(col=c): F.col(c) / F.col("sd") for c in cols}
    return df.join(moments.select(*keys, "sd"), list(keys)).withColumns(out).drop("sd")
