"""The end-to-end jobs on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import reverse_score, to_ts
from ..operators import sample
from ..plans import StudySpec, answered_block, covariate_report, effect_report, panel_table, scale_report, study_tables
from ..sources.export import read_export, read_text_csv
from . import views as v
from .posterior import _LAB_SQL, _P, _W_SQL, _weights, labelled
from .registry import query, rounded
from .scale import SQL_ITEMS, items
from .tables import export

def _spec() -> StudySpec:
    return StudySpec(
        items="q12_*", names_re=r".*_([0-9]+)", names=[("action", "int")], design=["finished"],
        wide=["id", "finished", "recorded_date", "r_1", "exclude"],
        steps=[
            lambda df: df.withColumns({"id": F.col("response_id").cast("bigint"), "recorded_date": to_ts("recorded_date")}),
            lambda df: sample.exclude_by_checks(df, [F.col("q12_1").isNull() | (F.col("q12_1") == "1"), F.col("comment").isNotNull()]),
            lambda df: sample.first_by(df, ["id"], ["exclude", "recorded_date"]),
        ],
        integers=["q12_*"], derived={"r_1": reverse_score("q12_1", 0, 1)}, placeholders={"[Field-protest]": "[for/against]"},
    )


def _tables(spark: SparkSession, sf: str):
    path = export(spark, sf)
    labels = read_text_csv(spark, path, multiline=True).filter(F.col("response_id") == "Response ID")
    return study_tables(read_export(spark, path, multiline=True), labels, _spec())


_TEXT_SQL = """, book AS (SELECT CAST(p_partkey % 7 + 1 AS INTEGER) AS action, 'A ' || MAX(p_name) || ' [for/against]' AS action_text FROM part GROUP BY 1)"""


@query("report_study_tables_long", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + _TEXT_SQL + """
SELECT id, CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '1' END AS finished, COALESCE(q12_1 = 0, FALSE) AS exclude, action, response, action_text
FROM responses JOIN wide USING (id) JOIN orders ON id = o_orderkey LEFT JOIN book USING (action)""")
def study_long(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).long


@query("report_study_tables_wide", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + """
SELECT id, CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '1' END AS finished, CAST(o_orderdate AS TIMESTAMP) AS recorded_date, 1 - q12_1 AS r_1,
       COALESCE(q12_1 = 0, FALSE) AS exclude
FROM wide JOIN orders ON id = o_orderkey""")
def study_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf).wide


@query("report_answered_block", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + """
SELECT id, 'first' AS target FROM wide WHERE COALESCE(q12_1, q12_2, q12_3) IS NOT NULL
UNION ALL SELECT id, 'second' FROM wide WHERE COALESCE(q12_4, q12_5) IS NOT NULL
UNION ALL SELECT id, NULL FROM wide WHERE COALESCE(q12_1, q12_2, q12_3, q12_4, q12_5) IS NULL""")
def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return answered_block(v.wide(spark, sf), {"first": "q12_1:q12_3", "second": "q12_4:q12_5"}, "target").select("id", "target")


@query("report_panel_table", """
SELECT c_custkey AS id, CAST(TRUNC(c_acctbal) AS INTEGER) AS age, NULLIF(NULLIF(c_mktsegment, 'HOUSEHOLD'), 'FURNITURE') AS segment FROM customer""")
def panel(spark: SparkSession, sf: str) -> DataFrame:
    raw = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("Id"), F.col("c_acctbal").cast("string").alias("Age"),
                                                F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"))
    return panel_table(raw, ["age", "balance_rank"], ["HOUSEHOLD", "FURNITURE"], ["id", "age", "segment"])


def _report(spark: SparkSession, sf: str):
    people = v.panel(spark, sf).select("jj", "kk")
    return effect_report(v.draws(spark, sf), people, labelled(people.select("kk").distinct()), _weights(), derived={"gap": ("m_protesters", "m_cause")},
                         widths=(0.5, 0.95))


@query("report_effect_intervals", "WITH" + v.SQL_DRAWS + _LAB_SQL + """
, l AS (SELECT kk, UNNEST([{'metric': 'z', 'e': z}, {'metric': 'n', 'e': n}, {'metric': 'p', 'e': p}], recursive := true) FROM effects),
q AS (SELECT kk, metric, 0.5::DOUBLE AS width, MEDIAN(e) AS estimate, QUANTILE_CONT(e, 0.25) AS lower, QUANTILE_CONT(e, 0.75) AS upper FROM l GROUP BY 1, 2
      UNION ALL SELECT kk, metric, 0.95, MEDIAN(e), QUANTILE_CONT(e, 0.025), QUANTILE_CONT(e, 0.975) FROM l GROUP BY 1, 2)
SELECT kk, participant, protesters, cause, metric, width, ROUND(estimate, 6) + 0.0 AS estimate, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper
FROM q JOIN lab USING (kk)""")
def effect_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf).intervals, "estimate", "lower", "upper")


@query("report_effect_contrasts", "WITH" + v.SQL_DRAWS + _LAB_SQL + _W_SQL + """
, d0 AS (SELECT draw, contrast, SUM(z * w) AS d FROM effects JOIN w USING (kk) GROUP BY 1, 2),
d AS (SELECT * FROM d0 UNION ALL SELECT a.draw, 'gap', a.d - b.d FROM d0 a JOIN d0 b USING (draw) WHERE a.contrast = 'm_protesters' AND b.contrast = 'm_cause'),
q AS (SELECT contrast, MEDIAN(d) AS d, QUANTILE_CONT(d, 0.025) AS lower, QUANTILE_CONT(d, 0.975) AS upper FROM d GROUP BY 1)
SELECT contrast, ROUND(d, 6) + 0.0 AS d, ROUND(lower, 6) + 0.0 AS lower, ROUND(upper, 6) + 0.0 AS upper, 'd = ' || PRINTF('%.2f', d) || ', [' || PRINTF('%.2f', lower) || ', ' || PRINTF('%.2f', upper) || ']' AS d_text FROM q""")
def effect_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf).contrasts, "d", "lower", "upper").select("contrast", "d", "lower", "upper", "d_text")


@query("report_covariate_slopes", "WITH" + v.SQL_DRAWS + f"""
, pts AS (SELECT draw, kk, x, delta + b_kk * x AS eta FROM post_kk, (VALUES (-1.0::DOUBLE), (1)) g(x))
SELECT draw, kk, x, ROUND(ANY_VALUE((eta - mean) / sd), 6) + 0.0 AS z, ROUND(SUM({_P}), 6) AS n, ROUND(AVG({_P}), 6) AS p
FROM pts JOIN latent_x USING (draw) JOIN post_ii USING (draw) GROUP BY 1, 2, 3""")
def covariate_slopes(spark: SparkSession, sf: str) -> DataFrame:
    slopes, _ = covariate_report(v.draws(spark, sf), v.panel(spark, sf), "x", "b_kk", ["b_for", "b_against"], (-1, 1))
    return rounded(slopes, "z", "n", "p")


_SCALES = {"amount": "Amount", "rebate": "Rebate", "duty": "Duty"}


def _scale(spark: SparkSession, sf: str):
    part = v.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("item"))
    li = v.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    ratings = li.select("item", (1 + F.col("l_suppkey") % 5).cast("int").alias("y"), F.col("l_quantity").alias("amount"),
                        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("rebate"), F.col("l_tax").alias("duty"))
    return scale_report(ratings, items(spark, sf), "y", range(1, 6), _SCALES)


@query("report_scale_means", "WITH" + SQL_ITEMS + """
, m AS (SELECT p_brand AS item, PRINTF('%.2f', AVG(l_quantity)) AS "Amount", PRINTF('%.2f', AVG(CASE WHEN l_discount > 0 THEN l_discount END)) AS "Rebate",
               PRINTF('%.2f', AVG(l_tax)) AS "Duty" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT ROW_NUMBER() OVER (ORDER BY information DESC, item) AS rank, item, "Amount", "Rebate", "Duty" FROM total JOIN m USING (item)""")
def scale_means(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf).means


@query("report_scale_items", "WITH" + SQL_ITEMS + """
, w AS (SELECT item, """ + ", ".join(f"ROUND_EVEN(100.0::DOUBLE * COUNT(*) FILTER (y = {k}) / COUNT(*), 0) AS pct_{k}" for k in range(1, 6)) + """ FROM answers GROUP BY 1)
SELECT ROW_NUMBER() OVER (ORDER BY information DESC, item) AS rank, item, PRINTF('%.2f', information) AS information, PRINTF('%.2f', alpha) AS alpha, """
       + ", ".join(f"pct_{k}" for k in range(1, 6)) + " FROM total JOIN w USING (item)")
def scale_items(spark: SparkSession, sf: str) -> DataFrame:
    return _scale(spark, sf).items
