"""Effects, predictions, curves and contrasts from posterior draws."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fmt_estimate
from ..operators import contrasts as c, draws as d, effects as e, quantiles as q
from ..operators.shape import seq, to_long
from ..session import cut_lineage
from . import views as v
from .registry import query, r6, rounded

_LABELS = [(i, *cell) for i, cell in enumerate(v.CELLS, 1)]
_VALUES_KK = ", ".join(f"({i}, '{a}', '{b}', '{x}')" for i, a, b, x in _LABELS)
_LAB_SQL = f", lab(kk, participant, protesters, cause) AS (VALUES {_VALUES_KK})"
_P = "1 / (1 + EXP(-alpha * (beta + eta)))"


def effects(spark: SparkSession, sf: str) -> DataFrame:
    """z, n and p per draw and cell."""
    cells = v.cell_draws(spark, sf).select("draw", "kk", "delta")
    return e.condition_effects(v.panel(spark, sf).select("jj", "kk"), v.person_draws(spark, sf), cells, v.item_draws(spark, sf))


def labelled(df: DataFrame) -> DataFrame:
    """Names of the design factors for a cell number (a literal of the design)."""
    out = df
    for i, name in enumerate(v.DESIGN, 1):
        col = F.lit(None).cast("string")
        for row in _LABELS:
            col = F.when(F.col("kk") == row[0], row[i]).otherwise(col)
        out = out.withColumn(name, col)
    return out


def _moments_x(spark: SparkSession, sf: str) -> DataFrame:
    return d.latent_moments(v.panel(spark, sf).select("jj", "kk", "x"), v.person_draws(spark, sf), v.cell_draws(spark, sf), slopes={"x": "b_kk"})


# -- effects and predictions -----------------------------------------------------------------


@query("m1_response_probability", "WITH" + v.SQL_DRAWS + """
SELECT draw, ii, jj, ROUND(1 / (1 + EXP(-alpha * (theta + beta))), 6) AS p_easy, ROUND(1 / (1 + EXP(-alpha * (theta - beta))), 6) AS p_hard
FROM post_ii JOIN post_jj USING (draw)""")
def response_probability(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import irf
    rows = v.item_draws(spark, sf).join(v.person_draws(spark, sf), "draw")
    return rows.select("draw", "ii", "jj", r6(irf("alpha", "beta", F.col("theta"))).alias("p_easy"),
                       r6(irf("alpha", "beta", F.col("theta"), sign=-1)).alias("p_hard"))


@query("m2_linear_predictor", "WITH" + v.SQL_DRAWS + """
SELECT draw, jj, ROUND(0.5 * e[15] + x * e[16] + x_sup * e[17], 6) + 0.0 AS eta FROM base, panel""")
def linear_predictor(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import linear_predictor as lp
    people = v.person_draws(spark, sf).select("draw", "jj").join(v.panel(spark, sf), "jj")
    coefs = v.draws(spark, sf).select("draw", *[F.col(f"`delta[{k}]`").alias(f"delta_{k}") for k in (1, 2, 3)])
    rows = people.join(coefs, "draw")
    return rows.select("draw", "jj", r6(lp([0.5, "x", "x_sup"], ["delta_1", "delta_2", "delta_3"])).alias("eta"))


@query("m3_effect_z", "WITH" + v.SQL_DRAWS + _LAB_SQL + """
SELECT draw, kk, ROUND(delta, 6) + 0.0 AS delta, ROUND(z, 6) + 0.0 AS z, participant, protesters, cause FROM effect_z RIGHT JOIN lab USING (kk)""")
def effect_z(spark: SparkSession, sf: str) -> DataFrame:
    labels = labelled(v.panel(spark, sf).select("kk").distinct())
    z = e.effect_z(v.panel(spark, sf).select("jj", "kk"), v.person_draws(spark, sf), v.cell_draws(spark, sf).select("draw", "kk", "delta"), labels)
    return rounded(z, "delta", "z")


@query("m4_a7_predicted_counts", "WITH" + v.SQL_DRAWS + "SELECT draw, kk, ROUND(z, 6) + 0.0 AS z, ROUND(n, 6) AS n, ROUND(p, 6) AS p FROM effects")
def predicted_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(effects(spark, sf), "z", "n", "p")


_CODED = [("A", "A", 1, 1, 1), ("A", "B", 0, 0, 0), ("B", "A", 1, 0, 0), ("B", "B", 0, 1, 0)]


@query("m3_m4_coded_conditions", "WITH" + v.SQL_DRAWS + """
, cell(sample, target, x_1, x_2, x_3) AS (VALUES ('A', 'A', 1, 1, 1), ('A', 'B', 0, 0, 0), ('B', 'A', 1, 0, 0), ('B', 'B', 0, 1, 0)),
who AS (SELECT jj, CASE WHEN (jj - 1) % 4 < 2 THEN 'A' ELSE 'B' END AS sample, CASE WHEN jj % 2 = 1 THEN 'A' ELSE 'B' END AS target FROM panel),
cd AS (SELECT draw, sample, target, x_1 * e[15] + x_2 * e[16] + x_3 * e[17] AS eta FROM base, cell),
m AS (SELECT draw, AVG(theta + eta) AS mean, STDDEV_SAMP(theta + eta) AS sd FROM who JOIN post_jj USING (jj) JOIN cd USING (draw, sample, target) GROUP BY 1)
SELECT draw, sample, target, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM(1 / (1 + EXP(-alpha * (-beta + eta)))), 6) AS n,
       ROUND(AVG(1 / (1 + EXP(-alpha * (-beta + eta)))), 6) AS p
FROM cd JOIN m USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2, 3""")
def coded_conditions(spark: SparkSession, sf: str) -> DataFrame:
    by = ["sample", "target"]
    people = v.panel(spark, sf).select("jj", F.when((F.col("jj") - 1) % 4 < 2, "A").otherwise("B").alias("sample"),
                                       F.when(F.col("jj") % 2 == 1, "A").otherwise("B").alias("target"))
    coefs = v.draws(spark, sf).select("draw", *[F.col(f"`delta[{k}]`").alias(f"delta_{k}") for k in (1, 2, 3)])
    xs = ["x_1", "x_2", "x_3"]
    cells = e.coded_effects(coefs, [*by, *xs], _CODED, xs, ["delta_1", "delta_2", "delta_3"])
    z = e.effect_z(people, v.person_draws(spark, sf), cells, by=by)
    return rounded(e.predict_counts(z, v.item_draws(spark, sf), by, sign=-1), "z", "n", "p")


_GRID = seq(-1.8, 1.8, 0.2)


@query("m5_covariate_sweep", "WITH" + v.SQL_DRAWS + f"""
, g AS (SELECT o.outcome, ROUND(CAST(-1.8 + i * 0.2 AS DOUBLE), 6) + 0.0 AS x FROM (VALUES ('x_2'), ('x_5')) o(outcome), range(0, 19) t(i)),
pts AS (SELECT draw, outcome, x, 0.4 * e[15] - 0.2 * e[17] + 0.1 * e[18] + x * CASE outcome WHEN 'x_2' THEN e[16] ELSE e[19] END AS eta FROM base, g)
SELECT draw, outcome, x, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM({_P.replace('(beta', '(-beta')}), 6) AS n, ROUND(AVG({_P.replace('(beta', '(-beta')}), 6) AS p
FROM pts JOIN latent USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2, 3""")
def covariate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    coefs = v.draws(spark, sf).select("draw", *[F.col(f"`delta[{k}]`").alias(f"delta_{k}") for k in range(1, 6)])
    moments = d.latent_moments(v.panel(spark, sf).select("jj", "kk"), v.person_draws(spark, sf), v.cell_draws(spark, sf))
    fixed = {"x_1": 0.4, "x_2": 0.0, "x_3": -0.2, "x_4": 0.1, "x_5": 0.0}
    out = e.sweep(coefs, v.item_draws(spark, sf), moments, {x: x for x in ("x_2", "x_5")}, _GRID, fixed,
                  {f"x_{k}": f"delta_{k}" for k in range(1, 6)}, n_items=v.N_ITEMS)
    return rounded(out, "x", "z", "n", "p")


@query("m6_curve_by_cause", "WITH" + v.SQL_DRAWS + f"""
, m AS (SELECT draw, kk % 2 AS x_for, AVG(delta) AS delta, ANY_VALUE(b_for) AS b_for, ANY_VALUE(b_against) AS b_against FROM post_kk GROUP BY 1, 2),
pts AS (SELECT draw, x_for, ROUND(CAST(-1.8 + i * 0.2 AS DOUBLE), 6) + 0.0 AS x, delta + (b_for * x_for + b_against * (1 - x_for)) * (-1.8 + i * 0.2) AS eta FROM m, range(0, 19) t(i))
SELECT draw, x_for, x, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM({_P}), 6) AS n, ROUND(AVG({_P}), 6) AS p
FROM pts JOIN latent_x USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2, 3""")
def curve_by_cause(spark: SparkSession, sf: str) -> DataFrame:
    out = e.curve_by(v.cell_draws(spark, sf), v.item_draws(spark, sf), _moments_x(spark, sf), [(k, k % 2) for k in range(1, 9)],
                     {1: "b_for", 0: "b_against"}, _GRID, n_items=v.N_ITEMS)
    return rounded(out, "x", "z", "n", "p")


@query("m7_simple_slopes", "WITH" + v.SQL_DRAWS + f"""
, pts AS (SELECT draw, kk, x, delta + b_kk * x AS eta FROM post_kk, (VALUES (-1.0::DOUBLE), (0), (1)) g(x))
SELECT draw, kk, x, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM({_P}), 6) AS n, ROUND(AVG({_P}), 6) AS p
FROM pts JOIN latent_x USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2, 3""")
def simple_slopes(spark: SparkSession, sf: str) -> DataFrame:
    out = e.simple_slopes(v.cell_draws(spark, sf), _moments_x(spark, sf), "b_kk", (-1, 0, 1), v.item_draws(spark, sf))
    return rounded(out, "z", "n", "p")


@query("m8_standardised_coefficients", "WITH" + v.SQL_DRAWS + """
, b AS (SELECT draw, kk, b_kk / sd AS b_kk, b_for / sd AS b_for, b_sup AS raw_sup, b_sup / sd AS b_sup FROM post_kk JOIN latent_x USING (draw)),
l AS (SELECT draw, kk, UNNEST([{'predictor': 'b_kk', 'b': b_kk}, {'predictor': 'b_for', 'b': b_for}, {'predictor': 'b_sup', 'b': b_sup}, {'predictor': 'raw_sup', 'b': raw_sup}], recursive := true) FROM b)
SELECT predictor, kk, ROUND(MEDIAN(b), 6) + 0.0 AS b, ROUND(QUANTILE_CONT(b, 0.025), 6) + 0.0 AS lower, ROUND(QUANTILE_CONT(b, 0.975), 6) + 0.0 AS upper, 0.95::DOUBLE AS width
FROM l GROUP BY 1, 2""")
def standardised_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    cells = v.cell_draws(spark, sf).withColumn("raw_sup", F.col("b_sup"))
    coefs = ["b_kk", "b_for", "b_sup"]
    std = e.std_coefs(v.panel(spark, sf).select("jj", "kk", "x"), v.person_draws(spark, sf), cells, {"x": "b_kk"}, coefs)
    both = std.join(cells.select("draw", "kk", "raw_sup"), ["draw", "kk"])
    long = to_long(both, [*coefs, "raw_sup"], "(.*)", [("predictor", "string")], "b")
    return rounded(q.median_qi(cut_lineage(long), ["b"], ["predictor", "kk"]), "b", "lower", "upper")


_SHARES = "ABS(e[4]) + ABS(e[5]) + ABS(e[6]) + ABS(e[7])"
_MO = f"""CASE x WHEN 1 THEN 0 WHEN 2 THEN ABS(e[4]) WHEN 3 THEN ABS(e[4]) + ABS(e[5]) WHEN 4 THEN ABS(e[4]) + ABS(e[5]) + ABS(e[6]) ELSE {_SHARES} END / ({_SHARES})"""
_MO_SQL = f", mo AS (SELECT draw, CAST(x AS INTEGER) AS x, {_MO} AS share FROM base, range(1, 6) t(x))"


@query("m9_monotonic_transform", "WITH" + v.SQL_DRAWS + _MO_SQL + "SELECT draw, x, ROUND(4 * share, 6) AS mo_model, ROUND((x - 1) * share, 6) AS mo_steps FROM mo")
def monotonic_transform(spark: SparkSession, sf: str) -> DataFrame:
    shares = v.draws(spark, sf).select("draw", "z_sup")
    model = e.monotonic_draws(shares, "z_sup", 5, out="mo_model")
    steps = e.monotonic_draws(shares, "z_sup", 5, "steps", out="mo_steps")
    return rounded(model.join(steps, ["draw", "x"]), "mo_model", "mo_steps")


def _ordinal_sql(scale: str) -> str:
    return "WITH" + v.SQL_DRAWS + _MO_SQL + f"""
, m AS (SELECT draw, AVG(theta + delta + b_kk * {scale} * share) AS mean, STDDEV_SAMP(theta + delta + b_kk * {scale} * share) AS sd
        FROM panel JOIN post_jj USING (jj) JOIN post_kk USING (draw, kk) JOIN mo ON mo.draw = post_jj.draw AND mo.x = panel.x_sup GROUP BY 1),
pts AS (SELECT draw, x, e[3] * {scale} * share AS eta FROM mo JOIN base USING (draw))
SELECT draw, x, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM({_P}), 6) AS n, ROUND(AVG({_P}), 6) AS p
FROM pts JOIN m USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2"""


def _ordinal(spark: SparkSession, sf: str, variant: str) -> DataFrame:
    mo = e.monotonic_draws(v.draws(spark, sf).select("draw", "z_sup"), "z_sup", 5, variant)
    moments = e.ordinal_moments(v.panel(spark, sf).select("jj", "kk", "x_sup"), v.person_draws(spark, sf), v.cell_draws(spark, sf), mo, "b_kk", "x_sup")
    return rounded(e.predict_ordinal(mo, v.draws(spark, sf), "b_sup", moments, v.item_draws(spark, sf)), "z", "n", "p")


@query("m10_ordinal_predictions", _ordinal_sql("4"))
def ordinal_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _ordinal(spark, sf, "model")


@query("m10_ordinal_predictions_steps", _ordinal_sql("(mo.x - 1)"))
def ordinal_predictions_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _ordinal(spark, sf, "steps")


# -- contrasts -------------------------------------------------------------------------------



# Effects of a two-level design as products of codes: every factor is coded +1 and -1, an effect is the
# product of the codes of its factors, and weights are scaled to the difference of two halves of the cells.
_EFFECTS = {"m_protesters": ("protesters",), "m_cause": ("cause",), "i_protesters_cause": ("protesters", "cause"),
            "i_all": ("participant", "protesters", "cause")}
_FIRST = {"participant": "A", "protesters": "A", "cause": "for"}


def _weights() -> dict:
    out = {}
    for name, factors in _EFFECTS.items():
        code = F.lit(1.0)
        for factor in factors:
            code = code * c.coded((F.col(factor) == _FIRST[factor], 1.0), default=-1.0)
        out[name] = code / 4
    return out


_W_SQL = "\n, w AS (" + " UNION ALL ".join(
    f"SELECT kk, '{name}' AS contrast, 0.25::DOUBLE * " + " * ".join(f"(CASE {f} WHEN '{_FIRST[f]}' THEN 1 ELSE -1 END)" for f in factors)
    + " AS w FROM lab" for name, factors in _EFFECTS.items()) + ")"


@query("m11_a13_planned_contrasts", "WITH" + v.SQL_DRAWS + _LAB_SQL + _W_SQL + """
, d AS (SELECT draw, contrast, SUM(z * w) AS d FROM effects JOIN w USING (kk) GROUP BY 1, 2),
q AS (SELECT contrast, MEDIAN(d) AS d, QUANTILE_CONT(d, 0.025) AS lower, QUANTILE_CONT(d, 0.975) AS upper FROM d GROUP BY 1)
SELECT contrast, ROUND(d, 6) + 0.0 AS d, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper, 0.95::DOUBLE AS width,
       'd = ' || PRINTF('%.2f', d) || ', [' || PRINTF('%.2f', lower) || ', ' || PRINTF('%.2f', upper) || ']' AS d_text FROM q""")
def planned_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.contrast_table(labelled(effects(spark, sf)), _weights()), "d", "lower", "upper")


_LEVELS = {f: tuple(dict.fromkeys(cell[i] for cell in v.CELLS)) for i, f in enumerate(v.DESIGN)}
# Simple effects of every factor within the levels of every other one, and how they change between those levels.
_SIMPLE = {f"{f}_within_{g}_{level}": (f, g, level) for f, g in permutations(v.DESIGN, 2) for level in _LEVELS[g]}
_CHANGES = {f"{f}_by_{g}": tuple(f"{f}_within_{g}_{level}" for level in _LEVELS[g]) for f, g in permutations(v.DESIGN, 2)}


def _simple_effects() -> dict:
    def code(f: str, g: str, level: str):
        here, first = F.col(g) == level, F.col(f) == _LEVELS[f][0]
        return c.coded((here & first, 1.0), (here & ~first, -1.0))

    return {name: code(*effect) for name, effect in _SIMPLE.items()}


_SIMPLE_SQL = "\n, w AS (" + " UNION ALL ".join(
    f"SELECT kk, '{name}' AS contrast, CASE {f} WHEN '{_LEVELS[f][0]}' THEN 1 ELSE -1 END AS w FROM lab WHERE {g} = '{level}'"
    for name, (f, g, level) in _SIMPLE.items()) + "),\npair(contrast, one, two) AS (VALUES " + ", ".join(
    f"('{name}', '{one}', '{two}')" for name, (one, two) in _CHANGES.items()) + ")"


@query("m11_a12_balanced_contrasts", "WITH" + v.SQL_DRAWS + _LAB_SQL + _SIMPLE_SQL + """,
m AS (SELECT draw, contrast, w, AVG(z) AS z FROM effects JOIN w USING (kk) GROUP BY 1, 2, 3),
d0 AS (SELECT draw, contrast, SUM(z * w) AS d FROM m GROUP BY 1, 2),
d AS (SELECT * FROM d0 UNION ALL SELECT a.draw, pair.contrast, a.d - b.d FROM pair JOIN d0 a ON a.contrast = one JOIN d0 b ON b.contrast = two AND a.draw = b.draw),
q AS (SELECT contrast, MEDIAN(d) AS d, QUANTILE_CONT(d, 0.025) AS lower, QUANTILE_CONT(d, 0.975) AS upper FROM d GROUP BY 1)
SELECT contrast, ROUND(d, 6) + 0.0 AS d, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper, 0.95::DOUBLE AS width,
       'd = ' || PRINTF('%.2f', d) || ', [' || PRINTF('%.2f', lower) || ', ' || PRINTF('%.2f', upper) || ']' AS d_text FROM q""")
def balanced_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    table = c.contrast_table(labelled(effects(spark, sf)), _simple_effects(), mode="balanced", derived=_CHANGES)
    return rounded(table, "d", "lower", "upper")


@query("m11_contrasts_by_slope", "WITH" + v.SQL_DRAWS + _LAB_SQL + _W_SQL.replace("0.25::", "1.0::") + """
, pts AS (SELECT draw, kk, x, (delta + b_kk * x - mean) / sd AS z FROM post_kk JOIN latent_x USING (draw), (VALUES (-1.0::DOUBLE), (0), (1)) g(x)),
d AS (SELECT draw, x, contrast, AVG(z * w) AS d FROM pts JOIN w USING (kk) GROUP BY 1, 2, 3)
SELECT x, contrast, ROUND(MEDIAN(d), 6) + 0.0 AS d, ROUND(QUANTILE_CONT(d, 0.025), 6) + 0.0 AS lower, ROUND(QUANTILE_CONT(d, 0.975), 6) + 0.0 AS upper, 0.95::DOUBLE AS width
FROM d GROUP BY 1, 2""")
def contrasts_by_slope(spark: SparkSession, sf: str) -> DataFrame:
    slopes = labelled(e.simple_slopes(v.cell_draws(spark, sf), _moments_x(spark, sf), "b_kk"))
    weights = {k: w * 4 for k, w in _weights().items()}
    table = c.contrast_table(slopes, weights, by=["x"], mode="mean").drop("d_text")
    return rounded(table, "d", "lower", "upper")


@query("m12_marginal_coefficients", "WITH" + v.SQL_DRAWS + _LAB_SQL + """
, b AS (SELECT draw, participant, cause, AVG(CASE cause WHEN 'for' THEN -b_kk ELSE b_kk END) AS b FROM post_kk JOIN lab USING (kk) GROUP BY 1, 2, 3)
SELECT participant, cause, ROUND(MEDIAN(b), 6) + 0.0 AS b, ROUND(QUANTILE_CONT(b, 0.025), 6) + 0.0 AS lower, ROUND(QUANTILE_CONT(b, 0.975), 6) + 0.0 AS upper, 0.95::DOUBLE AS width
FROM b GROUP BY 1, 2""")
def marginal_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    cells = c.align_signs(labelled(v.cell_draws(spark, sf)), "cause", {"for": -1, "against": 1}, "b_kk")
    return rounded(c.marginal_table(cells, ["participant", "cause"], "b_kk"), "b", "lower", "upper")


@query("m12_marginal_by_observer", "WITH" + v.SQL_DRAWS + _LAB_SQL + """
, m AS (SELECT draw, participant, AVG(z) FILTER (cause = 'for') - AVG(z) FILTER (cause = 'against') AS d FROM effects JOIN lab USING (kk) GROUP BY 1, 2),
q AS (SELECT participant, MEDIAN(d) AS d, QUANTILE_CONT(d, 0.025) AS lower, QUANTILE_CONT(d, 0.975) AS upper FROM m GROUP BY 1)
SELECT participant, ROUND(d, 6) + 0.0 AS d, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper, 'd = ' || PRINTF('%.2f', d) || ', [' || PRINTF('%.2f', lower) || ', ' || PRINTF('%.2f', upper) || ']' AS d_text FROM q""")
def marginal_by_observer(spark: SparkSession, sf: str) -> DataFrame:
    diff = c.marginal_diff(labelled(effects(spark, sf)), "cause", "for", "against", by=["participant"])
    table = q.median_qi(cut_lineage(diff), ["d"], ["participant"])
    return rounded(table.withColumn("d_text", fmt_estimate("d", "lower", "upper")), "d", "lower", "upper").select(
        "participant", "d", "lower", "upper", "d_text")


# -- precision over fits ---------------------------------------------------------------------


def _precision(spark: SparkSession, sf: str) -> DataFrame:
    wide = v.draws(spark, sf)
    keep = ["run", "draw"]
    return e.precision_by_run(
        v.panel(spark, sf).select("jj", "kk"), d.spread_draws(wide, {"theta": ("jj",)}, keep),
        d.spread_draws(wide, {"delta": ("kk",)}, keep), d.spread_draws(wide, {"alpha": ("ii",), "beta": ("ii",)}, keep))


_RUN_SQL = "WITH" + v.SQL_DRAWS + """
, l AS (SELECT draw, kk, UNNEST([{'metric': 'z', 'estimate': z}, {'metric': 'n', 'estimate': n}, {'metric': 'p', 'estimate': p}], recursive := true) FROM effects),
q AS (SELECT run, metric, kk, MEDIAN(estimate) AS estimate, QUANTILE_CONT(estimate, 0.025) AS lower, QUANTILE_CONT(estimate, 0.975) AS upper
      FROM l JOIN base USING (draw) GROUP BY 1, 2, 3)"""


@query("m23_precision_by_run", _RUN_SQL + """
SELECT run, metric, kk, ROUND(estimate, 6) + 0.0 AS estimate, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper, 0.95::DOUBLE AS width,
       ROUND(upper - lower, 6) AS interval_width FROM q""")
def precision_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_precision(spark, sf), "estimate", "lower", "upper", "interval_width")


@query("a16_mean_interval_width", _RUN_SQL + """
SELECT run % 2 AS size, metric, ROUND(AVG(upper - lower), 6) AS mean_width FROM q GROUP BY 1, 2""")
def mean_interval_width(spark: SparkSession, sf: str) -> DataFrame:
    df = _precision(spark, sf).groupBy((F.col("run") % 2).alias("size"), "metric").agg(F.avg("interval_width").alias("mean_width"))
    return rounded(df, "mean_width")
