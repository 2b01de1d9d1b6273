"""Estimation on the shared tables: factor models, calibration and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import calibrate as cal, factor
from ..operators.shape import bind_rows
from . import views as v
from .registry import query, rounded
from .scale import SQL_ITEMS, items

_SCALE = {"overall": [f"q12_{i}" for i in range(1, v.N_ITEMS + 1)]}
_ITEMS, _CELLS = range(1, v.N_ITEMS + 1), range(1, v.N_CELLS + 1)
_NODE_SQL = "node(q) AS (SELECT -4.0::DOUBLE + 0.4::DOUBLE * i FROM range(0, 21) t(i))"


@query("m18_factor_scores")
def factor_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = factor.factor_scores(v.wide(spark, sf), _SCALE)
    return rounded(df, "overall").select("id", "overall")


@query("m18_two_factor_scores")
def two_factor_scores(spark: SparkSession, sf: str) -> DataFrame:
    model = {"early": _SCALE["overall"][:3], "late": _SCALE["overall"][3:]}
    df = factor.factor_scores(v.wide(spark, sf), model)
    return rounded(df, *model).select("id", *model)


@query("m18_factor_loadings")
def factor_loadings(spark: SparkSession, sf: str) -> DataFrame:
    fit, _ = factor.fit_model(v.wide(spark, sf), _SCALE)
    return factor.factor_loadings(spark, fit)


_THREE = {"a": "l_partkey", "b": "l_suppkey", "c": "l_orderkey"}
_COMMUNALITY = """WITH x AS (SELECT (l_quantity + l_partkey % 29)::DOUBLE AS a, (l_quantity + l_suppkey % 31)::DOUBLE AS b,
                  (l_quantity + l_orderkey % 37)::DOUBLE AS c FROM lineitem),
s AS (SELECT COVAR_POP(a, b) AS ab, COVAR_POP(a, c) AS ac, COVAR_POP(b, c) AS bc, VAR_POP(a) AS aa, VAR_POP(b) AS bb, VAR_POP(c) AS cc FROM x),
l AS (SELECT 'a' AS item, ab * ac / bc AS communality, aa AS total FROM s UNION ALL SELECT 'b', ab * bc / ac, bb FROM s
      UNION ALL SELECT 'c', ac * bc / ab, cc FROM s)
SELECT item, ROUND(SQRT(communality), 4) AS loading, ROUND(total - communality, 3) AS uniqueness FROM l"""


@query("m18_three_item_loadings", _COMMUNALITY)
def three_item_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """One factor over three items, whose maximum of the likelihood has a closed form."""
    items = [(F.col("l_quantity") + F.col(key) % mod).cast("double").alias(n) for (n, key), mod in zip(_THREE.items(), (29, 31, 37), strict=True)]
    fit, patterns = factor.fit_model(v.table(spark, sf, "lineitem").select(*items), {"f": list(_THREE)})
    patterns.release()
    df = factor.factor_loadings(spark, fit)
    return rounded(rounded(df, "loading", digits=4), "uniqueness", digits=3).select("item", "loading", "uniqueness")


@query("m18_wide_factor_loadings")
def wide_factor_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Three correlated factors over 18 items with missing answers."""
    li = v.table(spark, sf, "lineitem")
    shared = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice") / 2000, "discount": F.col("l_discount") * 500}
    items, model = [], {}
    for factor_name, common in shared.items():
        model[factor_name] = [f"{factor_name}_{k}" for k in range(6)]
        for k, name in enumerate(model[factor_name]):
            noise = F.pmod(F.xxhash64(F.lit(name), "l_orderkey", "l_linenumber"), F.lit(40))
            given = F.pmod(F.xxhash64("l_orderkey", F.lit(k)), F.lit(50)) > 0
            items.append(F.when(given, common + noise).cast("double").alias(name))
    fit, patterns = factor.fit_model(li.select(*items), model)
    patterns.release()
    return factor.factor_loadings(spark, fit)


_PAIRS = [(i, j) for i in _ITEMS for j in _ITEMS if i <= j]


@query("m18_pattern_statistics", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + "\n, c AS (SELECT *, "
       + " || ".join(f"CASE WHEN q12_{i} IS NULL THEN '0' ELSE '1' END" for i in _ITEMS) + " AS pattern FROM wide)\nSELECT pattern, COUNT(*)::DOUBLE AS n, "
       + ", ".join(f"ROUND(AVG(q12_{i}), 9) AS m_{i}" for i in _ITEMS) + ", "
       + ", ".join(f"ROUND(COVAR_POP(q12_{i}, q12_{j}), 9) + 0.0 AS c_{i}{j}" for i, j in _PAIRS)
       + f"\nFROM c WHERE pattern <> '{'0' * v.N_ITEMS}' GROUP BY 1")
def pattern_statistics(spark: SparkSession, sf: str) -> DataFrame:
    table = factor.pattern_table(v.wide(spark, sf), _SCALE["overall"])
    means, covs = [f"m_{i}" for i in _ITEMS], [f"c_{i}{j}" for i, j in _PAIRS]
    df = table.select("pattern", "n", *[F.col("mean")[i].alias(c) for i, c in enumerate(means)],
                      *[F.col("cov")[i].alias(c) for i, c in enumerate(covs)])
    return rounded(df, *means, *covs, digits=9)


@query("m19_reliability_and_fit")
def reliability_and_fit(spark: SparkSession, sf: str) -> DataFrame:
    return factor.factor_fit(v.wide(spark, sf), _SCALE)


@query("m20_calibrate_2pl")
def calibrate_2pl(spark: SparkSession, sf: str) -> DataFrame:
    fit = cal.calibrate_2pl(v.indexed(spark, sf).filter(~F.col("exclude")), "id", "action", "response", cell="kk",
                            items_are=_ITEMS, cells_are=_CELLS)
    items = fit.items.select(F.col("item").cast("string").alias("term"), "alpha", "beta")
    effects = fit.effects.select("term", F.col("estimate").alias("beta"))
    return bind_rows({"item": items, "effect": effects}, "part")


@query("m20_calibrate_2pl_covariate")
def calibrate_2pl_covariate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.recode import z_score
    dl = z_score(v.indexed(spark, sf).filter(~F.col("exclude")), ["balance"])
    fit = cal.calibrate_2pl(dl, "id", "action", "response", cell="kk", covariates=["balance"], slopes_by_cell=True,
                            sign=-1, estimate_sigma=True, items_are=_ITEMS, cells_are=_CELLS)
    return fit.effects


@query("m20_calibrate_2pl_ordinal")
def calibrate_2pl_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return cal.calibrate_2pl(_level(spark, sf), "id", "action", "response", cell="kk", ordinal="sup").effects


def _level(spark: SparkSession, sf: str) -> DataFrame:
    """Included answers with an ordinal predictor of five levels."""
    level = F.least(F.lit(5), 1 + F.floor((F.col("balance") + 1000) / 2200)).cast("int")
    return v.indexed(spark, sf).filter(~F.col("exclude")).withColumn("sup", level)


_CAUSES = {i: cause for i, (*_, cause) in enumerate(v.CELLS, 1)}


@query("m20_calibrate_2pl_slope_groups")
def calibrate_2pl_slope_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of the cells of a cause around their own mean; all spreads estimated."""
    from ..operators.recode import z_score
    dl = z_score(v.indexed(spark, sf).filter(~F.col("exclude")), ["balance"])
    fit = cal.calibrate_2pl(dl, "id", "action", "response", cell="kk", covariates=["balance"], slope_groups=_CAUSES,
                            hierarchical=True, items_are=_ITEMS, cells_are=_CELLS)
    return fit.effects


@query("m20_calibrate_2pl_ordinal_cells")
def calibrate_2pl_ordinal_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A monotonic effect with deviations per cell."""
    return cal.calibrate_2pl(_level(spark, sf), "id", "action", "response", cell="kk", ordinal="sup", slopes_by_cell=True,
                             hierarchical=True).effects


_FIT_SQL = "WITH" + v.SQL_RESPONSES + """
SELECT action AS item, COUNT(*) AS n, ROUND(AVG(response), 5) AS expected FROM dl WHERE NOT exclude GROUP BY 1"""


@query("m20_item_fit", _FIT_SQL)
def item_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Shares that the fitted model expects, item by item. Where the likelihood is stationary they are the observed ones."""
    dl = v.indexed(spark, sf).filter(~F.col("exclude"))
    fit = cal.calibrate_2pl(dl, "id", "action", "response", cell="kk", prior_beta=1e4, tol=1e-8)
    effects = fit.effects.filter(F.col("term").startswith("delta")).select(
        F.regexp_extract("term", r"\[(\d+)\]", 1).cast("int").alias("kk"), F.col("estimate").alias("shift"))
    df = cal.item_fit(dl.join(F.broadcast(effects), "kk"), fit.items, "id", "action", "response", offset="shift")
    return rounded(df, "expected", digits=5).drop("observed")


@query("m21_calibrate_graded")
def calibrate_graded(spark: SparkSession, sf: str) -> DataFrame:
    return cal.calibrate_grm(v.graded(spark, sf), "id", "item", "y").items


_SCORE_SQL = "WITH" + v.SQL_RESPONSES + """
, bank AS (SELECT action, 0.5 + AVG(response) AS alpha, LN(AVG(response) / (1 - AVG(response))) AS beta FROM responses GROUP BY 1),
""" + _NODE_SQL + """,
ll AS (SELECT id, q, COUNT(*) AS n_items, SUM(CASE WHEN response = 1 THEN -LN(1 + EXP(-alpha * (q + beta))) ELSE -LN(1 + EXP(alpha * (q + beta))) END) - 0.5 * q * q AS l
       FROM responses JOIN bank USING (action), node GROUP BY 1, 2),
w AS (SELECT id, q, n_items, EXP(l - MAX(l) OVER (PARTITION BY id)) AS w FROM ll)
SELECT id, MAX(n_items) AS n_items, ROUND(SUM(w * q) / SUM(w), 6) + 0.0 AS theta,
       ROUND(SQRT(GREATEST(SUM(w * q * q) / SUM(w) - (SUM(w * q) / SUM(w)) * (SUM(w * q) / SUM(w)), 0)), 6) AS theta_sd
FROM w GROUP BY 1"""


@query("m22_person_scores", _SCORE_SQL)
def person_scores(spark: SparkSession, sf: str) -> DataFrame:
    resp = v.responses(spark, sf)
    rate = F.avg("response")
    bank = resp.groupBy(F.col("action").alias("item")).agg((0.5 + rate).alias("alpha"), F.log(rate / (1 - rate)).alias("beta"))
    return rounded(cal.score_eap(resp, bank, "id", "action", "response"), "theta", "theta_sd")


_CUT = "1 / (1 + EXP(-(alpha * q - beta_{})))"
_GRADED_P = "CASE y WHEN 1 THEN 1 - {c1} WHEN 2 THEN {c1} - {c2} WHEN 3 THEN {c2} - {c3} WHEN 4 THEN {c3} - {c4} ELSE {c4} END".format(
    **{f"c{k}": _CUT.format(k) for k in range(1, 5)})


@query("m22_graded_person_scores", "WITH" + v.SQL_GRADED + "," + SQL_ITEMS + f"""
, {_NODE_SQL},
ll AS (SELECT id, q, COUNT(*) AS n_items, SUM(LN({_GRADED_P})) - 0.5 * q * q AS l FROM graded JOIN items USING (item), node GROUP BY 1, 2),
w AS (SELECT id, q, n_items, EXP(l - MAX(l) OVER (PARTITION BY id)) AS w FROM ll)
SELECT id, MAX(n_items) AS n_items, ROUND(SUM(w * q) / SUM(w), 6) + 0.0 AS theta,
       ROUND(SQRT(GREATEST(SUM(w * q * q) / SUM(w) - (SUM(w * q) / SUM(w)) * (SUM(w * q) / SUM(w)), 0)), 6) AS theta_sd
FROM w GROUP BY 1""")
def graded_person_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = cal.score_eap(v.graded(spark, sf), items(spark, sf), "id", "item", "y")
    return rounded(df, "theta", "theta_sd")
