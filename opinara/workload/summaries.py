"""Aggregations, ranks and reported statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import share_matching
from ..operators import contrasts as c, draws as d, ordering, quantiles as q, recode, sample, summary as s
from . import views as v
from .registry import query, r6, rounded

_TABLE_SQL = "WITH" + v.SQL_RESPONSES + """
, t AS (SELECT action, AVG(response) AS pr FROM dl WHERE NOT exclude GROUP BY 1)
SELECT ROW_NUMBER() OVER (ORDER BY pr DESC, action) AS rank, action, ROUND(pr, 6) AS pr, PRINTF('%.0f', pr * 100) || '%' AS pr_text FROM t"""


@query("a1_w3_item_endorsement_table", _TABLE_SQL)
def item_endorsement_table(spark: SparkSession, sf: str) -> DataFrame:
    dl = sample.apply_exclusions(v.long_responses(spark, sf))
    return s.item_rate_table(dl, ["action"], "response")


@query("a2_threshold_share", "WITH" + v.SQL_RATINGS + "SELECT item, ROUND(AVG(CASE WHEN y >= 3 THEN 1 ELSE 0 END), 6) AS p_sometimes FROM ratings GROUP BY 1")
def threshold_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.threshold_share(v.ratings(spark, sf), ["item"], "y", 3, "p_sometimes"), "p_sometimes")


_RATINGS = ["acceptable", "disruptive", "violent", "extreme", "negative"]


@query("a3_group_means", "WITH" + v.SQL_RATINGS + "SELECT item, " + ", ".join(
    f"ROUND(AVG({x}), 4) AS {x}" for x in _RATINGS) + """, CASE WHEN COUNT(violent) = COUNT(*) THEN AVG(violent) END AS strict_violent
FROM ratings GROUP BY item""")
def group_means(spark: SparkSession, sf: str) -> DataFrame:
    df = v.ratings(spark, sf)
    strict = s.group_means(df, ["item"], ["violent"], na_rm=False, names="strict_{col}")
    return rounded(s.group_means(df, ["item"], _RATINGS), *_RATINGS, digits=4).join(strict, "item")


@query("a4_count_wide", "WITH" + v.SQL_RATINGS + "SELECT item, " + ", ".join(
    f"COUNT(*) FILTER (y = {k}) AS n_{k}" for k in range(1, 7)) + " FROM ratings GROUP BY item")
def count_wide(spark: SparkSession, sf: str) -> DataFrame:
    return s.count_wide(v.ratings(spark, sf), ["item"], "y", range(1, 7))


@query("a5_prop_wide", "WITH" + v.SQL_RATINGS + "SELECT item, " + ", ".join(
    f"ROUND(COUNT(*) FILTER (y = {k}) / COUNT(*)::DOUBLE, 6) AS p_{k}" for k in range(1, 6)) + " FROM ratings GROUP BY item")
def prop_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.prop_wide(v.ratings(spark, sf), ["item"], "y", range(1, 6)), *[f"p_{k}" for k in range(1, 6)])


@query("w6_share_of_total", "WITH" + v.SQL_RATINGS + """
SELECT item, y, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY item), 6) AS p FROM ratings GROUP BY item, y""")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.share_of_total(v.ratings(spark, sf), ["item"], "y"), "p")


@query("a6_model_sizes", "WITH" + v.SQL_RESPONSES + """
SELECT COUNT(*) AS "N", MAX(action) AS "I", CAST(COUNT(DISTINCT id) AS INTEGER) AS "J", MAX(kk) AS "K" FROM cells WHERE NOT exclude""")
def model_sizes(spark: SparkSession, sf: str) -> DataFrame:
    dl = ordering.dense_index(v.indexed(spark, sf).filter(~F.col("exclude")), "id", "jj")
    return s.model_sizes(dl, {"I": "action", "J": "jj", "K": "kk"})


@query("a8_w2_draw_moments", "WITH" + v.SQL_DRAWS + "SELECT draw, ROUND(mean, 6) + 0.0 AS mean, ROUND(sd, 6) AS sd FROM latent")
def draw_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.panel(spark, sf).select("jj", "kk").join(v.person_draws(spark, sf), "jj").join(v.cell_draws(spark, sf).select("draw", "kk", "delta"), ["draw", "kk"])
    return rounded(d.draw_moments(rows, F.col("theta") + F.col("delta")), "mean", "sd")


def _interval_sql(value: str, by: str, source: str) -> str:
    return f"""SELECT {by}, ROUND(QUANTILE_CONT({value}, 0.5), 6) + 0.0 AS x, ROUND(QUANTILE_CONT({value}, 0.025), 6) + 0.0 AS lower,
       ROUND(QUANTILE_CONT({value}, 0.975), 6) + 0.0 AS upper, 0.95::DOUBLE AS width FROM {source} GROUP BY {by}"""


@query("a9_median_interval", "WITH" + v.SQL_DRAWS + _interval_sql("delta", "kk", "post_kk"))
def median_interval(spark: SparkSession, sf: str) -> DataFrame:
    df = q.median_qi(v.cell_draws(spark, sf), {"x": "delta"}, ["kk"])
    return rounded(df, "x", "lower", "upper")


@query("a9_median_interval_large_groups", _interval_sql("l_extendedprice", "l_returnflag", "lineitem"))
def median_interval_large_groups(spark: SparkSession, sf: str) -> DataFrame:
    df = q.median_qi(v.table(spark, sf, "lineitem"), {"x": "l_extendedprice"}, ["l_returnflag"])
    return rounded(df, "x", "lower", "upper")


@query("a9_median_interval_several", "WITH" + v.SQL_DRAWS + """
SELECT ROUND(MEDIAN(mean), 6) + 0.0 AS mean, ROUND(QUANTILE_CONT(mean, 0.025), 6) + 0.0 AS mean_lower, ROUND(QUANTILE_CONT(mean, 0.975), 6) + 0.0 AS mean_upper,
       ROUND(MEDIAN(sd), 6) AS sd, ROUND(QUANTILE_CONT(sd, 0.025), 6) AS sd_lower, ROUND(QUANTILE_CONT(sd, 0.975), 6) AS sd_upper, 0.95::DOUBLE AS width
FROM (SELECT draw, AVG(theta) AS mean, STDDEV_SAMP(theta) AS sd FROM post_jj GROUP BY 1)""")
def median_interval_several(spark: SparkSession, sf: str) -> DataFrame:
    df = q.median_qi(d.draw_moments(v.person_draws(spark, sf), "theta"), ["mean", "sd"])
    return rounded(df, *[f"{x}{t}" for x in ("mean", "sd") for t in ("", "_lower", "_upper")])


@query("a10_interval_set", "WITH" + v.SQL_DRAWS + """
, w(width) AS (VALUES (0.5::DOUBLE), (0.8), (0.95), (0.99)), g AS (SELECT kk, LIST(p) AS ps FROM effects GROUP BY kk)
SELECT kk, width, ROUND(LIST_AGGREGATE(ps, 'quantile_cont', 0.5), 6) AS value,
       ROUND(CASE width WHEN 0.5 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.25) WHEN 0.8 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.1)
             WHEN 0.95 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.025) ELSE LIST_AGGREGATE(ps, 'quantile_cont', 0.005) END, 6) AS lower,
       ROUND(CASE width WHEN 0.5 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.75) WHEN 0.8 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.9)
             WHEN 0.95 THEN LIST_AGGREGATE(ps, 'quantile_cont', 0.975) ELSE LIST_AGGREGATE(ps, 'quantile_cont', 0.995) END, 6) AS upper
FROM g, w""")
def interval_set(spark: SparkSession, sf: str) -> DataFrame:
    from .posterior import effects
    return rounded(q.interval_set(effects(spark, sf), "p", ["kk"]), "value", "lower", "upper")


@query("a11_group_median", "SELECT c_mktsegment, ROUND(MEDIAN(c_acctbal), 6) AS median FROM customer GROUP BY 1")
def group_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(q.group_median(v.table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"], "median"), "median")


@query("a15_correlation_matrix", "WITH" + v.SQL_RATINGS + ", m AS (SELECT " + ", ".join(
    f"ROUND(CORR({a}, {b}), 6) + 0.0 AS {a}_{b}" for i, a in enumerate(_RATINGS) for b in _RATINGS[i + 1:]) + " FROM ratings)\n" + "\nUNION ALL ".join(
    f"SELECT {i + 1} AS rank, '{a}' AS term, " + ", ".join(
        (f"NULL::DOUBLE AS {b}" if a == b else f"{a if i < j else b}_{b if i < j else a} AS {b}") for j, b in enumerate(_RATINGS)) + " FROM m"
    for i, a in enumerate(_RATINGS)))
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.cor_matrix(v.ratings(spark, sf), _RATINGS), *_RATINGS)


@query("a15_correlation_table", "WITH" + v.SQL_RATINGS + """
, m AS (SELECT REPLACE(PRINTF('%.2f', CORR(acceptable, negative)), '0.', '.') AS an, REPLACE(PRINTF('%.2f', CORR(acceptable, disruptive)), '0.', '.') AS ad,
               REPLACE(PRINTF('%.2f', CORR(disruptive, negative)), '0.', '.') AS dn FROM ratings)
SELECT 1 AS rank, 'acceptable' AS term, '' AS acceptable, ad AS disruptive, an AS negative FROM m
UNION ALL SELECT 2, 'disruptive', ad, '', dn FROM m UNION ALL SELECT 3, 'negative', an, dn, '' FROM m""")
def correlation_table(spark: SparkSession, sf: str) -> DataFrame:
    return s.cor_matrix(v.ratings(spark, sf), ["acceptable", "disruptive", "negative"], digits=2)


@query("a17_demographics", """
SELECT NULLIF(c_mktsegment, 'FURNITURE') AS gender, COUNT(*) AS n FROM customer GROUP BY 1""")
def demographics(spark: SparkSession, sf: str) -> DataFrame:
    return s.demographics(v.table(spark, sf, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("gender")), "gender")


@query("a17_age_spread", """
SELECT MIN(l_quantity) AS min, MEDIAN(l_quantity) AS median, MAX(l_quantity) AS max FROM lineitem""")
def age_spread(spark: SparkSession, sf: str) -> DataFrame:
    return s.spread(v.table(spark, sf, "lineitem"), "l_quantity")


@query("a17_midpoint_shares", "WITH" + v.SQL_RATINGS + """
SELECT item, ROUND(AVG(CASE WHEN y < 3 THEN 1 ELSE 0 END), 6) AS below, ROUND(AVG(CASE WHEN y > 3 THEN 1 ELSE 0 END), 6) AS above FROM ratings GROUP BY 1""")
def midpoint_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.midpoint_shares(v.ratings(spark, sf), ["item"], "y", 3), "below", "above")


@query("a18_describe", "WITH" + v.SQL_RATINGS + "\nUNION ALL ".join(
    f"\nSELECT item, '{x}' AS variable, COUNT({x}) AS n, ROUND(AVG({x}), 4) AS mean, ROUND(STDDEV_SAMP({x}), 4) AS sd FROM ratings GROUP BY item" for x in ("violent", "negative")))
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.describe(v.ratings(spark, sf), ["item"], ["violent", "negative"]), "mean", "sd", digits=4)


_D = """(AVG({x}) FILTER ({a}) - AVG({x}) FILTER ({b})) / SQRT(((COUNT({x}) FILTER ({a}) - 1) * VAR_SAMP({x}) FILTER ({a})
        + (COUNT({x}) FILTER ({b}) - 1) * VAR_SAMP({x}) FILTER ({b})) / (COUNT({x}) FILTER ({a}) + COUNT({x}) FILTER ({b}) - 2))"""


@query("a19_cohens_d", "WITH" + v.SQL_RATINGS + ", g AS (SELECT *, id % 3 AS grp FROM ratings)" + "\nUNION ALL ".join(
    f"\nSELECT '{x}' AS variable, ROUND({_D.format(x=x, a='grp = 0', b='grp = 1')}, 6) + 0.0 AS d FROM g" for x in ("violent", "negative")))
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    df = v.ratings(spark, sf).withColumn("grp", F.col("id") % 3)
    return rounded(s.cohens_d(df, "grp", 0, 1, ["violent", "negative"]), "d")


@query("a20_prob_superiority", """
WITH n AS (SELECT n_chars, CASE lang WHEN 'en' THEN 'a' WHEN 'fr' THEN 'b' END AS g FROM documents),
ca AS (SELECT n_chars AS v, COUNT(*) AS c FROM n WHERE g = 'a' GROUP BY 1), cb AS (SELECT n_chars AS v, COUNT(*) AS c FROM n WHERE g = 'b' GROUP BY 1),
p AS (SELECT SUM(CASE WHEN ca.v > cb.v THEN ca.c * cb.c ELSE 0 END)::DOUBLE AS w, SUM(CASE WHEN ca.v = cb.v THEN ca.c * cb.c ELSE 0 END)::DOUBLE AS t FROM ca, cb),
k AS (SELECT COUNT(*) FILTER (g = 'a') AS n_a, COUNT(*) FILTER (g = 'b') AS n_b FROM n WHERE n_chars IS NOT NULL)
SELECT n_a, n_b, ROUND(w / n_a / n_b, 6) AS strict, ROUND((w + t / 2) / n_a / n_b, 6) AS half_ties FROM p, k""")
def prob_superiority(spark: SparkSession, sf: str) -> DataFrame:
    df = s.prob_superiority(v.table(spark, sf, "documents").select("lang", "n_chars"), "lang", "en", "fr", "n_chars")
    return rounded(df, "strict", "half_ties")


@query("a21_prob_direction", "WITH" + v.SQL_DRAWS + """
SELECT run, ROUND(AVG(CASE WHEN e[1] > e[2] THEN 1 ELSE 0 END), 6) AS p FROM base GROUP BY 1""")
def prob_direction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.prob_direction(v.draws(spark, sf), F.col("b_for") > F.col("b_against"), ["run"]), "p")


# -- order -----------------------------------------------------------------------------------


@query("w1_draw_z", "WITH" + v.SQL_DRAWS + """
SELECT draw, jj, ROUND((theta - AVG(theta) OVER (PARTITION BY draw)) / STDDEV_SAMP(theta) OVER (PARTITION BY draw), 6) + 0.0 AS z FROM post_jj""")
def draw_z(spark: SparkSession, sf: str) -> DataFrame:
    theta = v.person_draws(spark, sf)
    return rounded(d.draw_z(theta, F.col("theta"), d.draw_moments(theta, "theta")).select("draw", "jj", "z"), "z")


@query("w5_index_within", """
SELECT c_custkey, c_mktsegment, DENSE_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS run FROM customer""")
def index_within(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return ordering.index_within(df, ["c_mktsegment"], "c_nationkey", "run").select("c_custkey", "c_mktsegment", "run")


@query("t1_sort", "WITH" + v.SQL_RATINGS + "SELECT y, item, COUNT(*) AS n FROM ratings GROUP BY 1, 2 ORDER BY n DESC, y, item")
def sort(spark: SparkSession, sf: str) -> DataFrame:
    return v.ratings(spark, sf).groupBy("y", "item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y", "item")


@query("t2_top_n_ties", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, RANK() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM r WHERE r <= 25""")
def top_n_ties(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ordering.top_n_ties(df, 25, "l_quantity")


@query("p21_share_matching", """
SELECT lang, ROUND(AVG(CASE WHEN REGEXP_MATCHES(text, '[0-9]') THEN 1 ELSE 0 END), 6) AS share FROM documents GROUP BY 1""")
def share_with_digits(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "documents").groupBy("lang").agg(r6(share_matching("text", "[0-9]")).alias("share"))


@query("a14_marginal_difference", "WITH" + v.SQL_DRAWS + """
, m AS (SELECT draw, AVG(CASE WHEN kk % 2 = 1 THEN z END) - AVG(CASE WHEN kk % 2 = 0 THEN z END) AS d FROM effects GROUP BY 1)
SELECT ROUND(MEDIAN(d), 6) + 0.0 AS d, ROUND(QUANTILE_CONT(d, 0.025), 6) + 0.0 AS lower, ROUND(QUANTILE_CONT(d, 0.975), 6) + 0.0 AS upper, 0.95::DOUBLE AS width FROM m""")
def marginal_difference(spark: SparkSession, sf: str) -> DataFrame:
    from .posterior import effects
    labelled = recode.pick_by(effects(spark, sf).withColumns({"odd": F.lit("for"), "even": F.lit("against"), "k2": F.col("kk") % 2}), "k2", {1: "odd", 0: "even"}, "cause")
    return rounded(q.median_qi(c.marginal_diff(labelled, "cause", "for", "against"), ["d"]), "d", "lower", "upper")
