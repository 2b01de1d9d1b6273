"""Survey-shaped views of the shared test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import uuid
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.draws import spread_draws
from ..operators.recode import cell_index, z_score
from ..session import checkpoint_dir

# The three design factors, their levels and the size of the draws layout.
DESIGN = ("participant", "protesters", "cause")
CELLS = list(product(("A", "B"), ("A", "B"), ("for", "against")))
N_ITEMS, N_CELLS, N_PEOPLE = 7, 8, 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/opinara-{uuid.uuid4().hex}"


# -- responses -------------------------------------------------------------------------------


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One 0/1 answer per person (order) and item (line number)."""
    flag = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("action")
    ).agg(F.max(flag).alias("response"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Design factors, covariate and exclusion flag per person."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "A").otherwise("B").alias("participant"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "A").otherwise("B").alias("protesters"),
        F.when(F.col("o_orderkey") % 2 == 0, "for").otherwise("against").alias("cause"),
        F.col("c_acctbal").alias("balance"),
        (F.col("o_orderstatus") == "P").alias("exclude"),
    )


def long_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with the design factors and the flag of the person."""
    return responses(spark, sf).join(people(spark, sf), "id")


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    return cell_index(long_responses(spark, sf), DESIGN, CELLS)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person with the items as columns; unanswered items are null."""
    cols = [F.max(F.when(F.col("action") == i, F.col("response"))).alias(f"q12_{i}") for i in range(1, N_ITEMS + 1)]
    return responses(spark, sf).groupBy("id").agg(*cols)


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Five numeric ratings and one ordinal rating per row."""
    q = F.col
    return table(spark, sf, "lineitem").select(
        q("l_orderkey").alias("id"), q("l_linenumber").alias("item"),
        (1 + q("l_suppkey") % 5).cast("int").alias("y"),
        q("l_quantity").alias("acceptable"), q("l_extendedprice").alias("disruptive"),
        F.when(q("l_discount") > 0, q("l_discount")).alias("violent"), q("l_tax").alias("extreme"),
        (q("l_quantity") * (1 - q("l_discount"))).alias("negative"),
    )


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal answers, one per person (supplier and part) and item (brand)."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("item")).agg(
        F.max(1 + (F.col("l_quantity") / 10.001).cast("int")).alias("y"))


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated submissions with tied times."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("id"),
        F.when(F.col("value") < 90, F.date_trunc("hour", "ts")).alias("recorded_date"),
        (F.col("event_type") == "error").alias("exclude"), "event_type",
    )


SQL_RESPONSES = """
responses AS (
  SELECT l_orderkey AS id, l_linenumber AS action,
         MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS response
  FROM lineitem GROUP BY 1, 2),
people AS (
  SELECT o_orderkey AS id,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'A' ELSE 'B' END AS participant,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'A' ELSE 'B' END AS protesters,
         CASE WHEN o_orderkey % 2 = 0 THEN 'for' ELSE 'against' END AS cause,
         c_acctbal AS balance, o_orderstatus = 'P' AS exclude
  FROM orders JOIN customer ON o_custkey = c_custkey),
dl AS (SELECT * FROM responses JOIN people USING (id)),
cells AS (
  SELECT *, 1 + CASE WHEN participant = 'B' THEN 4 ELSE 0 END + CASE WHEN protesters = 'B' THEN 2 ELSE 0 END
          + CASE WHEN cause = 'against' THEN 1 ELSE 0 END AS kk
  FROM dl)"""

SQL_WIDE = """
wide AS (
  SELECT id, """ + ", ".join(
    f"MAX(CASE WHEN action = {i} THEN response END) AS q12_{i}" for i in range(1, N_ITEMS + 1)) + """
  FROM responses GROUP BY id)"""

SQL_RATINGS = """
ratings AS (
  SELECT l_orderkey AS id, l_linenumber AS item, CAST(1 + l_suppkey % 5 AS INTEGER) AS y,
         l_quantity AS acceptable, l_extendedprice AS disruptive,
         CASE WHEN l_discount > 0 THEN l_discount END AS violent, l_tax AS extreme,
         l_quantity * (1 - l_discount) AS negative
  FROM lineitem)"""

SQL_GRADED = """
graded AS (
  SELECT l_orderkey AS id, p_brand AS item, MAX(1 + CAST(FLOOR(l_quantity / 10.001) AS INTEGER)) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SQL_SUBMISSIONS = """
submissions AS (
  SELECT event_id, user_id AS id, CASE WHEN value < 90 THEN DATE_TRUNC('hour', ts) END AS recorded_date,
         event_type = 'error' AS exclude, event_type
  FROM events)"""


# -- posterior draws -------------------------------------------------------------------------


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Wide draws: one row per vector, its elements read as model parameters."""
    def indexed(name: str, first: int, n: int, of: str = "{}") -> list[str]:
        return [of.format(f"CAST(embedding[{first + i}] AS DOUBLE)") + f" AS `{name}[{i + 1}]`" for i in range(n)]

    size = "aggregate(shares, 0D, (a, b) -> a + b)"
    shares = "transform(slice(embedding, 4, 4), x -> abs(CAST(x AS DOUBLE))) AS shares"
    return table(spark, sf, "embeddings").selectExpr("*", shares).selectExpr(
        "CAST(vec_id + 1 AS INT) AS draw", "CAST(vec_id % 4 + 1 AS INT) AS chain",
        "CAST(floor(vec_id / 4) + 1 AS INT) AS iteration", "label AS run",
        *indexed("alpha", 0, N_ITEMS, "exp({})"), *indexed("beta", N_ITEMS, N_ITEMS), *indexed("delta", 14, N_CELLS),
        *indexed("theta", 22, N_PEOPLE), *indexed("b_kk", 56, N_CELLS),
        "CAST(embedding[0] AS DOUBLE) AS b_for", "CAST(embedding[1] AS DOUBLE) AS b_against",
        "CAST(embedding[2] AS DOUBLE) AS b_sup", f"transform(shares, s -> s / {size}) AS z_sup",
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """People of the draws with a standardised covariate, an ordinal one and coded factors."""
    jj = (F.col("c_custkey") % N_PEOPLE + 1).cast("int")
    raw = table(spark, sf, "customer").groupBy(jj.alias("jj")).agg(
        F.avg("c_acctbal").alias("x"), (1 + F.sum("c_nationkey") % 5).cast("int").alias("x_sup"))
    return z_score(raw, ["x"]).select("jj", ((F.col("jj") - 1) % N_CELLS + 1).alias("kk"), "x", "x_sup")


def item_draws(spark: SparkSession, sf: str) -> DataFrame:
    return spread_draws(draws(spark, sf), {"alpha": ("ii",), "beta": ("ii",)}, keep=["draw"])


def person_draws(spark: SparkSession, sf: str) -> DataFrame:
    return spread_draws(draws(spark, sf), {"theta": ("jj",)}, keep=["draw"])


def cell_draws(spark: SparkSession, sf: str) -> DataFrame:
    return spread_draws(draws(spark, sf), {"delta": ("kk",), "b_kk": ("kk",), "b_for": (), "b_against": (),
                                           "b_sup": ()}, keep=["draw"])


SQL_DRAWS = """
base AS (
  SELECT CAST(vec_id + 1 AS INTEGER) AS draw, CAST(vec_id % 4 + 1 AS INTEGER) AS chain,
         CAST(FLOOR(vec_id / 4) + 1 AS INTEGER) AS iteration, label AS run,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
post_ii AS (SELECT draw, run, CAST(i AS INTEGER) AS ii, EXP(e[i]) AS alpha, e[7 + i] AS beta
            FROM base, range(1, 8) t(i)),
post_kk AS (SELECT draw, run, CAST(k AS INTEGER) AS kk, e[14 + k] AS delta, e[56 + k] AS b_kk, e[1] AS b_for,
                   e[2] AS b_against, e[3] AS b_sup
            FROM base, range(1, 9) t(k)),
post_jj AS (SELECT draw, run, CAST(j AS INTEGER) AS jj, e[22 + j] AS theta FROM base, range(1, 43) t(j)),
panel0 AS (SELECT CAST(c_custkey % 42 + 1 AS INTEGER) AS jj, AVG(c_acctbal) AS x0,
                  CAST(1 + SUM(c_nationkey) % 5 AS INTEGER) AS x_sup
           FROM customer GROUP BY 1),
panel AS (SELECT jj, CAST((jj - 1) % 8 + 1 AS INTEGER) AS kk,
                 (x0 - AVG(x0) OVER ()) / STDDEV_SAMP(x0) OVER () AS x, x_sup
          FROM panel0),
latent AS (SELECT draw, AVG(theta + delta) AS mean, STDDEV_SAMP(theta + delta) AS sd
           FROM panel JOIN post_jj USING (jj) JOIN post_kk USING (draw, kk) GROUP BY draw),
latent_x AS (SELECT draw, AVG(theta + delta + b_kk * x) AS mean, STDDEV_SAMP(theta + delta + b_kk * x) AS sd
             FROM panel JOIN post_jj USING (jj) JOIN post_kk USING (draw, kk) GROUP BY draw),
effect_z AS (SELECT draw, kk, delta, (delta - mean) / sd AS z FROM post_kk JOIN latent USING (draw)),
effects AS (SELECT draw, kk, ANY_VALUE(z) AS z, SUM(1 / (1 + EXP(-alpha * (beta + delta)))) AS n,
                   AVG(1 / (1 + EXP(-alpha * (beta + delta)))) AS p
            FROM effect_z JOIN post_ii USING (draw) GROUP BY draw, kk)"""

SQL_LABELS = """
labels_kk AS (
  SELECT DISTINCT kk, participant, protesters, cause FROM cells)"""
