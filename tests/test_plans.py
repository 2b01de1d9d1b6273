"""Physical plans: no Cartesian products, no Python on the hot path, pruning, skew handling."""

import os
import re

import pytest
from pyspark.sql import functions as F

from opinara.operators import sample, shape, summary
from opinara.operators.ordering import global_index
from opinara.workload import QUERIES, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
FITTED = {"m18_factor_scores", "m18_factor_loadings", "m19_reliability_and_fit", "m20_calibrate_2pl",
          "m20_calibrate_2pl_covariate", "m20_calibrate_2pl_ordinal", "m18_two_factor_scores", "m21_calibrate_graded"}
MATRICES = {"a15_correlation_matrix", "a15_correlation_table", "report_scale_correlations"}  # sums by NumPy, in blocks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    changed = {}

    def change(**conf):
        for key, value in conf.items():
            name = key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in changed.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_products_and_no_python(spark, settings, name):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", *([] if name in MATRICES else ["MapInArrow"]), "MapInPandas"):
        assert node not in text


@needs_data
def test_scan_reads_only_used_columns(spark):
    text = plan(summary.item_rates(views.responses(spark, SF), ["action"], "response"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_linenumber", "l_returnflag"}


@needs_data
def test_filter_reaches_the_scan(spark):
    text = plan(sample.apply_exclusions(views.people(spark, SF)).filter("balance > 100"))
    assert "GreaterThan(c_acctbal,100.0)" in text


@needs_data
def test_cells_are_reduced_before_the_second_shuffle(spark, settings):
    """People x draws rows are aggregated on the map side; only cells x draws rows are exchanged."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(QUERIES["m3_effect_z"](spark, SF))
    assert "partial_avg(theta" in text and "Window" not in text


def hot(spark, rows=60_000):
    return spark.range(rows, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"), (F.col("id") % 25).alias("action"),
        F.repeat(F.lit("x"), 20).alias("text"), F.col("id").alias("at"))


def test_hot_person_is_split_in_the_flag_join(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
             spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
             spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
             spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = hot(spark)
    people = rows.select("id").distinct().withColumn("exclude", F.col("id") % 2 == 1)
    out = sample.attach_flag(rows, people)
    assert out.collect() and "skew=true" in plan(out)
    assert out.count() == 60_000


def test_hot_key_shrinks_before_the_shuffle(spark):
    rows = hot(spark)
    unique = sample.keep_unique(rows, ["id"])
    assert unique.count() == 40_000 - 1 and plan(unique).count("Exchange") == 1
    first = sample.first_by(rows, ["id"], ["at"])
    assert first.count() == 40_000 and "Window" not in plan(first)


def test_tied_rows_are_numbered_by_several_tasks(spark, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = spark.range(0, 200_000, 1, 8).withColumn("tied", F.lit(1))
    numbered = global_index(rows, ["tied"], "n")
    assert numbered.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 200_000, 200_000)
    assert numbered.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_lookup_spreads_a_key_that_half_of_all_rows_hold(spark, settings):
    """No job while the plan is built, one answer in half of all rows, another missing in many: more than one task, same rows."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    rows = spark.range(0, 40_000, 1, 4).select("id", F.expr(
        "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id % 97) END").alias("answer"))
    table = spark.range(90).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value")).union(
        spark.createDataFrame([("hot", -1)], "key string, value long"))
    group = "lookup-builds-no-job"
    spark.sparkContext.setJobGroup(group, group)
    out = shape.lookup(rows, table, [F.col("answer")], ["key"]).withColumn("task", F.spark_partition_id())
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = out.filter("answer = 'hot'").groupBy("task").count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 12_000
    assert out.filter("answer IS NULL").select("task").distinct().count() > 1
    got = out.groupBy().agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count("value").alias("v")).first()
    want = rows.toPandas().answer.map(lambda a: -1 if a == "hot" else int(a[1:]) if a and int(a[1:]) < 90 else None)
    assert (got.n, got.s, got.v) == (40_000, int(want.sum()), int(want.notna().sum()))
