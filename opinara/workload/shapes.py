"""Joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import draws as d, recode, shape
from . import views as v
from .registry import query, r6, rounded

_Q12 = [f"q12_{i}" for i in range(1, v.N_ITEMS + 1)]
_LONG_SQL = " UNION ALL ".join(f"SELECT id, {i} AS action, q12_{i} AS response FROM wide" for i in range(1, v.N_ITEMS + 1))


# -- joins -----------------------------------------------------------------------------------


@query("j1_attach_dimension", """
SELECT l_orderkey, l_linenumber, l_partkey, p_name AS action_text, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def attach_dimension(spark: SparkSession, sf: str) -> DataFrame:
    part = v.table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("action_text"), "p_brand")
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey", "left")


@query("j1_null_safe_join", """
WITH e AS (SELECT event_id, NULLIF(event_type, 'error') AS t FROM events),
c AS (SELECT NULLIF(event_type, 'error') AS t, COUNT(*) AS n FROM events GROUP BY 1)
SELECT event_id, e.t, n FROM e LEFT JOIN c ON e.t IS NOT DISTINCT FROM c.t""")
def null_safe_join(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("t"))
    return shape.join_na(e, e.groupBy("t").agg(F.count(F.lit(1)).alias("n")), ["t"]).select("event_id", "t", "n")


@query("j2_j3_expand_by_draws", "WITH" + v.SQL_DRAWS + """
SELECT draw, jj, kk, ROUND(theta, 6) + 0.0 AS theta, ROUND(delta, 6) + 0.0 AS delta
FROM panel JOIN post_kk USING (kk) JOIN post_jj USING (jj, draw)""")
def expand_by_draws(spark: SparkSession, sf: str) -> DataFrame:
    people = v.panel(spark, sf).select("jj", "kk")
    cells = v.cell_draws(spark, sf).select("draw", "kk", "delta")
    df = people.join(cells, "kk", "left").join(v.person_draws(spark, sf), ["jj", "draw"], "left")
    return rounded(df.select("draw", "jj", "kk", "theta", "delta"), "theta", "delta")


@query("j4_right_join", """
WITH big AS (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT n_nationkey, n_name, n FROM big RIGHT JOIN nation ON c_nationkey = n_nationkey""")
def right_join(spark: SparkSession, sf: str) -> DataFrame:
    big = v.table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return shape.join_na(big, v.table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "right")


@query("j5_natural_full_join", """
WITH a AS (SELECT NULLIF(c_mktsegment, 'FURNITURE') AS segment, c_nationkey AS nation, COUNT(*) AS n_rich FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2),
b AS (SELECT NULLIF(c_mktsegment, 'FURNITURE') AS segment, c_nationkey AS nation, COUNT(*) AS n_poor FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2)
SELECT COALESCE(a.segment, b.segment) AS segment, COALESCE(a.nation, b.nation) AS nation, n_rich, n_poor
FROM a FULL JOIN b ON a.segment IS NOT DISTINCT FROM b.segment AND a.nation IS NOT DISTINCT FROM b.nation""")
def natural_full_join(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    count = F.count(F.lit(1))
    return shape.natural_full_join(c.filter("c_acctbal > 8000").groupBy("segment", "nation").agg(count.alias("n_rich")),
                                   c.filter("c_acctbal < 0").groupBy("segment", "nation").agg(count.alias("n_poor")))


@query("j7_cross_tuples", "WITH" + v.SQL_DRAWS + """
SELECT draw, run, kk, x_for FROM (SELECT draw, run FROM base), (VALUES (1, 1), (2, 0), (3, 1), (4, 0)) t(kk, x_for)""")
def cross_tuples(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [(1, 1), (2, 0), (3, 1), (4, 0), (1, 1)]
    return shape.cross_tuples(v.draws(spark, sf).select("draw", "run"), ["kk", "x_for"], pairs)


@query("j8_bind_scores_by_key", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + """
, s AS (SELECT id, ROUND(AVG(response), 6) AS score FROM responses GROUP BY id)
SELECT id, q12_1, q12_2, score FROM wide JOIN s USING (id)""")
def bind_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = v.responses(spark, sf).groupBy("id").agg(r6(F.avg("response")).alias("score"))
    return v.wide(spark, sf).select("id", "q12_1", "q12_2").join(scores, "id")


# -- rows ------------------------------------------------------------------------------------


@query("u1_bind_rows", """
SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def bind_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = v.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return shape.bind_rows({"customer": c, "supplier": s}, "source")


@query("u2_distinct", "WITH" + v.SQL_RESPONSES + "SELECT DISTINCT kk, participant, protesters, cause FROM cells")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return v.indexed(spark, sf).select("kk", *v.DESIGN).distinct()


# -- wide and long ---------------------------------------------------------------------------


@query("r1_to_long_two_groups", """
SELECT l_orderkey, l_linenumber, l_partkey, 'size' AS kind, 1 AS place, CAST(TRUNC(l_quantity) AS INTEGER) AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'size', 2, CAST(TRUNC(l_extendedprice) AS INTEGER) FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'duty', 1, 1 FROM lineitem WHERE l_tax >= 0.04""")
def to_long_two_groups(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("string").alias("size#1"),
        F.col("l_extendedprice").cast("string").alias("size#2"), F.when(F.col("l_tax") >= 0.04, "1").otherwise("NA").alias("duty#1"))
    return shape.to_long(df, recode.select_cols(df, "~#").columns, r"([a-z]+)#(\d)",
                         [("kind", "string"), ("place", "int")], "amount", "int", drop_na=True)


@query("r2_to_long_one_group", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + _LONG_SQL.join(("\nSELECT * FROM (", ") WHERE response IS NOT NULL")))
def to_long_one_group(spark: SparkSession, sf: str) -> DataFrame:
    return shape.to_long(v.wide(spark, sf), _Q12, r"q\d+_(\d+)", [("action", "int")], "response", "int", drop_na=True)


@query("r3_to_long_prefix", "WITH" + v.SQL_DRAWS + """
SELECT draw, 'for' AS cause, ROUND(e[1], 6) + 0.0 AS b FROM base UNION ALL SELECT draw, 'against', ROUND(e[2], 6) + 0.0 FROM base""")
def to_long_prefix(spark: SparkSession, sf: str) -> DataFrame:
    df = v.draws(spark, sf).select("draw", "b_for", "b_against")
    return rounded(shape.to_long(df, ["b_for", "b_against"], "b_([a-z]+)", [("cause", "string")], "b", drop_na=True), "b")


@query("r4_to_wide", """
SELECT l_returnflag, """ + ", ".join(
    f"""COALESCE(SUM(l_quantity) FILTER (l_linestatus = '{s}' AND l_linenumber = {n}), 0) AS "{s}_{n}\"""" for s in "FO" for n in range(1, 8)) + """
FROM lineitem GROUP BY 1""")
def to_wide(spark: SparkSession, sf: str) -> DataFrame:
    sums = v.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return shape.to_wide(sums, ["l_linestatus", "l_linenumber"], "q", None, ["l_returnflag"], fill=0)


@query("r5_spread_draws", "WITH" + v.SQL_DRAWS + """
SELECT draw, chain, iteration, kk, ROUND(delta, 6) + 0.0 AS delta, ROUND(b_kk, 6) + 0.0 AS b_kk, ROUND(b_for, 6) + 0.0 AS b_for
FROM post_kk JOIN base USING (draw, run)""")
def spread_draws(spark: SparkSession, sf: str) -> DataFrame:
    df = d.spread_draws(v.draws(spark, sf), {"delta": ("kk",), "b_kk": ("kk",), "b_for": ()})
    return rounded(df, "delta", "b_kk", "b_for")


@query("r5_spread_draws_two_indexes", "WITH" + v.SQL_DRAWS + """
SELECT draw, CAST(i AS INTEGER) AS ii, CAST(k AS INTEGER) AS kk, ROUND(e[7 + (i - 1) * 8 + k], 6) + 0.0 AS beta, ROUND(EXP(e[i]), 6) AS alpha
FROM base, range(1, 8) s(i), range(1, 9) t(k)""")
def spread_draws_two_indexes(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    wide = v.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("draw"), *[F.exp(e[i - 1].cast("double")).alias(f"alpha[{i}]") for i in range(1, 8)],
        *[e[6 + (i - 1) * 8 + k].cast("double").alias(f"beta[{i},{k}]") for i in range(1, 8) for k in range(1, 9)])
    return rounded(d.spread_draws(wide, {"beta": ("ii", "kk"), "alpha": ("ii",)}), "beta", "alpha")


@query("r5_spread_draws_arrays", """
SELECT CAST(vec_id + 1 AS INTEGER) AS draw, CAST(j AS INTEGER) AS jj, ROUND(CAST(embedding[j] AS DOUBLE), 6) + 0.0 AS theta
FROM embeddings, range(1, 65) t(j)""")
def spread_draws_arrays(spark: SparkSession, sf: str) -> DataFrame:
    wide = v.table(spark, sf, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("draw"), F.col("embedding").cast("array<double>").alias("theta"))
    return rounded(d.spread_draws(wide, {"theta": ("jj",)}), "theta")


@query("r6_gather_draws", "WITH" + v.SQL_DRAWS + """
SELECT draw, chain, iteration, 'delta' AS variable, kk, ROUND(delta, 6) + 0.0 AS value FROM post_kk JOIN base USING (draw, run)
UNION ALL SELECT draw, chain, iteration, 'b_kk', kk, ROUND(b_kk, 6) + 0.0 FROM post_kk JOIN base USING (draw, run)""")
def gather_draws(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.gather_draws(v.draws(spark, sf), {"delta": "kk", "b_kk": "kk"}), "value")


@query("r7_runs_as_rows", "WITH" + v.SQL_DRAWS + """
SELECT run, kk, COUNT(*) AS n_draws, ROUND(AVG(delta), 6) + 0.0 AS delta, ROUND(STDDEV_SAMP(delta), 6) AS sd FROM post_kk GROUP BY 1, 2""")
def runs_as_rows(spark: SparkSession, sf: str) -> DataFrame:
    long = d.spread_draws(v.draws(spark, sf), {"delta": ("kk",)}, keep=["draw", "run"])
    return rounded(long.groupBy("run", "kk").agg(F.count(F.lit(1)).alias("n_draws"), F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("sd")), "delta", "sd")
