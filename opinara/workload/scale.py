"""Scale development: graded-response information, item selection, characteristic curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import draws as d, graded as g, ordering, quantiles as q
from ..operators.shape import seq
from . import views as v
from .registry import query, rounded

_THETA = seq(-3.0, 3.0, 0.5)

SQL_ITEMS = """
answers AS (SELECT p_brand AS item, 1 + CAST(l_suppkey AS INTEGER) % 5 AS y, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey),
items AS (
  SELECT item, 0.5 + 20 * AVG(l_discount) AS alpha,
         -LN(AVG(CASE WHEN y > 1 THEN 1.0 ELSE 0 END) / AVG(CASE WHEN y <= 1 THEN 1.0 ELSE 0 END)) AS beta_1,
         -LN(AVG(CASE WHEN y > 2 THEN 1.0 ELSE 0 END) / AVG(CASE WHEN y <= 2 THEN 1.0 ELSE 0 END)) AS beta_2,
         -LN(AVG(CASE WHEN y > 3 THEN 1.0 ELSE 0 END) / AVG(CASE WHEN y <= 3 THEN 1.0 ELSE 0 END)) AS beta_3,
         -LN(AVG(CASE WHEN y > 4 THEN 1.0 ELSE 0 END) / AVG(CASE WHEN y <= 4 THEN 1.0 ELSE 0 END)) AS beta_4
  FROM answers GROUP BY item),
grid AS (SELECT -3.0 + i * 0.5 AS theta FROM range(0, 13) t(i)),
s AS (SELECT item, theta, alpha, 1 / (1 + EXP(-(alpha * theta - beta_1))) AS s1, 1 / (1 + EXP(-(alpha * theta - beta_2))) AS s2,
             1 / (1 + EXP(-(alpha * theta - beta_3))) AS s3, 1 / (1 + EXP(-(alpha * theta - beta_4))) AS s4 FROM items, grid),
probs AS (SELECT item, CAST(theta AS DOUBLE) AS theta, alpha, 1 - s1 AS p_1, s1 - s2 AS p_2, s2 - s3 AS p_3, s3 - s4 AS p_4, s4 AS p_5 FROM s),
info AS (SELECT item, theta, alpha * alpha * p_1 * (1 - p_1) AS i_1, alpha * alpha * p_2 * (1 - p_2) AS i_2, alpha * alpha * p_3 * (1 - p_3) AS i_3,
                alpha * alpha * p_4 * (1 - p_4) AS i_4, alpha * alpha * p_5 * (1 - p_5) AS i_5 FROM probs),
total AS (SELECT item, alpha, beta_1, beta_2, beta_3, beta_4,
                 alpha * (2 + (2 + (beta_2 - beta_1) - (beta_2 - beta_1) * (EXP(beta_2 - beta_1) + 1) / (EXP(beta_2 - beta_1) - 1))
                            + (2 + (beta_3 - beta_2) - (beta_3 - beta_2) * (EXP(beta_3 - beta_2) + 1) / (EXP(beta_3 - beta_2) - 1))
                            + (2 + (beta_4 - beta_3) - (beta_4 - beta_3) * (EXP(beta_4 - beta_3) + 1) / (EXP(beta_4 - beta_3) - 1))) AS information
          FROM items)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Item parameters read off the data: a discrimination and four cumulative-logit thresholds."""
    li = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    y = 1 + F.col("l_suppkey") % 5

    def cut(k: int):
        return (-F.log(F.avg((y > k).cast("int")) / F.avg((y <= k).cast("int")))).alias(f"beta_{k}")

    return li.groupBy(F.col("p_brand").alias("item")).agg(
        (0.5 + 20 * F.avg("l_discount")).alias("alpha"), *[cut(k) for k in range(1, 5)])


def informed(spark: SparkSession, sf: str) -> DataFrame:
    return g.item_information(items(spark, sf))


_P = [f"p_{k}" for k in range(1, 6)]


@query("m13_category_probabilities", "WITH" + SQL_ITEMS + "SELECT item, theta, " + ", ".join(f"ROUND({p}, 6) AS {p}" for p in _P) + " FROM probs")
def category_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.grm_probs(items(spark, sf), _THETA), *_P)


@query("m14_option_information", "WITH" + SQL_ITEMS + "SELECT item, theta, " + ", ".join(f"ROUND(i_{k}, 6) AS info_{k}" for k in range(1, 6)) + " FROM info")
def option_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.grm_information(items(spark, sf), _THETA, "option"), *[f"info_{k}" for k in range(1, 6)])


@query("m14_item_information_curve", "WITH" + SQL_ITEMS + "SELECT item, theta, ROUND(i_1 + i_2 + i_3 + i_4 + i_5, 6) AS info FROM info")
def item_information_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.grm_information(items(spark, sf), _THETA, "item"), "info")


@query("m14_total_information_standardised", "WITH" + SQL_ITEMS.replace("-3.0 + i * 0.5 AS theta", "0.2 + 1.5 * (-3.0 + i * 0.5) AS theta") + """
SELECT ROUND((theta - 0.2) / 1.5, 6) + 0.0 AS theta, ROUND(SUM(i_1 + i_2 + i_3 + i_4 + i_5), 6) AS info FROM info GROUP BY 1""")
def total_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.grm_information(items(spark, sf), _THETA, "total", mean=0.2, sd=1.5), "theta", "info")


@query("m15_integrated_information", "WITH" + SQL_ITEMS + "SELECT item, ROUND(information, 6) AS closed, ROUND(information, 6) AS grid FROM total")
def integrated_information(spark: SparkSession, sf: str) -> DataFrame:
    bank = items(spark, sf)
    closed = g.item_information(bank, "closed", out="closed").select("item", "closed")
    return rounded(closed.join(g.item_information(bank, "grid", out="grid").select("item", "grid"), "item"), "closed", "grid")


@query("m16_item_selection", "WITH" + SQL_ITEMS + """
, r AS (SELECT *, RANK() OVER (ORDER BY information DESC) AS r FROM total)
SELECT item, ROUND(alpha, 6) AS alpha, ROUND(information, 6) AS information FROM r WHERE r <= 5""")
def item_selection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.select_items(informed(spark, sf), 5).select("item", "alpha", "information"), "alpha", "information")


@query("m16_w3_item_table", "WITH" + SQL_ITEMS + """
, w AS (SELECT item, COUNT(*) AS n, """ + ", ".join(f"ROUND(100.0 * COUNT(*) FILTER (y = {k}) / COUNT(*), 4) AS pct_{k}" for k in range(1, 6)) + """ FROM answers GROUP BY 1)
SELECT ROW_NUMBER() OVER (ORDER BY information DESC, item) AS rank, item, PRINTF('%.2f', information) AS information, PRINTF('%.2f', alpha) AS alpha, n, """
       + ", ".join(f"pct_{k}" for k in range(1, 6)) + " FROM total JOIN w USING (item)")
def item_table(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import fmt_num
    from ..operators.summary import prop_wide
    li = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("item"), (1 + F.col("l_suppkey") % 5).alias("y"))
    shares = prop_wide(li, ["item"], "y", range(1, 6), "pct_").withColumns({f"pct_{k}": F.round(100 * F.col(f"pct_{k}"), 4) for k in range(1, 6)})
    counts = li.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    table = informed(spark, sf).join(shares, "item").join(counts, "item")
    ranked = ordering.rank_rows(table, [F.desc("information"), "item"])
    return ranked.select("rank", "item", fmt_num("information").alias("information"), fmt_num("alpha").alias("alpha"), "n", *[f"pct_{k}" for k in range(1, 6)])


@query("m16_scale_curves", "WITH" + SQL_ITEMS + """
, r AS (SELECT item, ROW_NUMBER() OVER (ORDER BY information DESC, item) AS n_items FROM total)
SELECT theta, n_items, ROUND(SUM(i_1 + i_2 + i_3 + i_4 + i_5) OVER (PARTITION BY theta ORDER BY n_items), 6) AS info FROM info JOIN r USING (item)""")
def scale_curves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.scale_curves(informed(spark, sf), _THETA, None), "info")


@query("m17_item_medians", "WITH" + v.SQL_DRAWS + """
SELECT CAST(i AS INTEGER) AS item, ROUND(MEDIAN(EXP(e[i])), 6) AS alpha, """ + ", ".join(
    f"ROUND(MEDIAN(e[14 + (i - 1) * 4 + {k}]), 6) + 0.0 AS beta_{k}" for k in range(1, 5)) + " FROM base, range(1, 8) t(i) GROUP BY 1")
def item_medians(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    wide = v.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("draw"), *[F.exp(e[i - 1].cast("double")).alias(f"alpha[{i}]") for i in range(1, 8)],
        *[e[13 + (i - 1) * 4 + k].cast("double").alias(f"beta[{i},{k}]") for i in range(1, 8) for k in range(1, 5)])
    return rounded(g.item_medians(wide, 4), "alpha", *[f"beta_{k}" for k in range(1, 5)])


@query("m17_theta_moments", "WITH" + v.SQL_DRAWS + """
SELECT ROUND(MEDIAN(mean), 6) + 0.0 AS mean, ROUND(MEDIAN(sd), 6) AS sd FROM (SELECT draw, AVG(theta) AS mean, STDDEV_SAMP(theta) AS sd FROM post_jj GROUP BY 1)""")
def theta_moments(spark: SparkSession, sf: str) -> DataFrame:
    df = q.median_qi(d.draw_moments(v.person_draws(spark, sf), "theta"), ["mean", "sd"])
    return rounded(df.select("mean", "sd"), "mean", "sd")


@query("m24_characteristic_curves", "WITH" + v.SQL_DRAWS + """
, b AS (SELECT ii AS item, MEDIAN(alpha) AS alpha, MEDIAN(beta) AS beta FROM post_ii GROUP BY 1), g AS (SELECT CAST(-3.0 + i * 0.5 AS DOUBLE) AS theta FROM range(0, 13) t(i))
SELECT item, theta, ROUND(1 / (1 + EXP(-alpha * (theta + beta))), 6) AS p FROM b, g""")
def characteristic_curves(spark: SparkSession, sf: str) -> DataFrame:
    med = q.median_qi(v.item_draws(spark, sf), ["alpha", "beta"], ["ii"])
    return rounded(g.icc(med.select(F.col("ii").alias("item"), "alpha", "beta"), _THETA), "p")
