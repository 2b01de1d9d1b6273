"""Sources and sinks: the tables leave Spark as files and come back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import to_int, to_ts
from ..operators.shape import to_long
from ..sources import (read_codebook, read_draws, read_export, read_snapshot, write_csv,
                       write_snapshot)
from . import views as v
from .registry import query, rounded


def export(spark: SparkSession, sf: str) -> str:
    """Write wide responses the way a survey platform exports them: with two metadata rows."""
    path = v.scratch(spark)
    items = [f"q12_{i}" for i in range(1, v.N_ITEMS + 1)]
    o = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("recorded"),
        F.when(F.col("o_orderstatus") == "O", "0").otherwise("1").alias("finished"),
        F.concat(F.lit('He said "'), "o_orderpriority", F.lit('", then\nleft')).alias("comment"))
    answers = v.wide(spark, sf).join(o, "id").select(
        F.col("id").cast("string").alias("ResponseId"), F.col("recorded").cast("string").alias("RecordedDate"),
        F.col("finished").alias("Finished"), F.col("comment").alias("Comment"),
        *[F.col(c).cast("string").alias(c.upper()) for c in items])
    texts = v.table(spark, sf, "part").groupBy((F.col("p_partkey") % v.N_ITEMS + 1).alias("i")).agg(
        F.max("p_name").alias("name"))
    label = texts.agg(
        F.lit("Response ID").alias("ResponseId"), F.lit("Recorded Date").alias("RecordedDate"),
        F.lit("Finished").alias("Finished"), F.lit("Comment").alias("Comment"),
        *[F.max(F.when(F.col("i") == i, F.concat(F.lit("Which are fine? - A "), "name", F.lit(" [Field-protest]"))))
          .alias(f"Q12_{i}") for i in range(1, v.N_ITEMS + 1)])
    ids = label.select(*[F.lit(f'{{"ImportId":"{c}"}}').alias(c) for c in label.columns])
    write_csv(label.unionByName(ids).unionByName(answers), path)
    return path


@query("s1_s2_s5_export_scan", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + """
SELECT id, CAST(o_orderdate AS TIMESTAMP) AS recorded_date, o_orderstatus <> 'O' AS finished, LENGTH(o_orderpriority) + 21 AS comment_length,
       q12_1, q12_2, q12_3, q12_4, q12_5, q12_6, q12_7
FROM wide JOIN orders ON id = o_orderkey""")
def export_scan(spark: SparkSession, sf: str) -> DataFrame:
    df = read_export(spark, export(spark, sf), multiline=True)
    return df.select(
        F.col("response_id").cast("bigint").alias("id"), to_ts("recorded_date").alias("recorded_date"),
        (F.col("finished") == "1").alias("finished"), F.length("comment").cast("bigint").alias("comment_length"),
        *[to_int(f"q12_{i}").alias(f"q12_{i}") for i in range(1, v.N_ITEMS + 1)])


@query("s3_r8_codebook", """
SELECT CAST(p_partkey % 7 + 1 AS INTEGER) AS action, 'A ' || MAX(p_name) || ' [for/against]' AS action_text
FROM part GROUP BY 1""")
def codebook_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read_codebook(spark, export(spark, sf), "q12_*", F.col("response_id") == "Response ID",
                         placeholders={"[Field-protest]": "[for/against]"}, multiline=True)


@query("s4_snapshot", "WITH" + v.SQL_RESPONSES + """
SELECT cause, kk, COUNT(*) AS n, CAST(SUM(response) AS BIGINT) AS endorsed FROM cells WHERE NOT exclude GROUP BY 1, 2""")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = v.scratch(spark)
    write_snapshot(v.indexed(spark, sf), path, partition_by=["cause"])
    df = read_snapshot(spark, path, ["cause", "kk", "response", "exclude"]).filter(~F.col("exclude"))
    return df.groupBy("cause", "kk").agg(F.count(F.lit(1)).alias("n"), F.sum("response").alias("endorsed"))


@query("s6_read_draws", "WITH" + v.SQL_DRAWS + """
SELECT draw, chain, iteration, ii, ROUND(alpha, 6) AS alpha, ROUND(beta, 6) + 0.0 AS beta
FROM post_ii JOIN base USING (draw, run)""")
def draws_source(spark: SparkSession, sf: str) -> DataFrame:
    path = v.scratch(spark)
    wide = v.draws(spark, sf).drop("z_sup", "run")
    dotted = {"draw": ".draw", "chain": ".chain", "iteration": ".iteration"}
    wide.withColumnsRenamed(dotted).write.parquet(path)
    df = read_draws(spark, path)
    items = [c for c in df.columns if c.startswith(("alpha", "beta"))]
    long = to_long(df.select("draw", "chain", "iteration", *[f"`{c}`" for c in items]), items,
                   r"(\w+)\[(\d+)\]", [("name", "string"), ("ii", "int")], "value")
    out = long.groupBy("draw", "chain", "iteration", "ii").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("alpha", "beta")])
    return rounded(out, "alpha", "beta")
