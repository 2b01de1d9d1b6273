"""Hand-computed cases: missing values, ties, text, rounding."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara import functions as fn
from opinara.operators import contrasts, graded, ordering, quantiles, recode, sample, shape, summary
from opinara.sources.export import codebook


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def column(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("y")).collect()]


def test_lenient_casts(spark):
    texts = ["3.7", "x", "", "NA", None, " 12 ", "-2.9", "1d", "1e2", "99999999999"]
    assert column(spark, texts, fn.to_int("x")) == [3, None, None, None, None, 12, -2, None, 100, None]
    assert column(spark, ["TRUE", "f", "F", "1", None], fn.to_bool("x")) == [True, None, False, None, None]
    assert column(spark, ["2021-01-15 10:00:00", "soon"], fn.to_ts("x")) == [dt.datetime(2021, 1, 15, 10), None]


def test_null_condition(spark):
    cond = F.col("x") == "a"
    assert column(spark, ["a", "b", None], fn.if_else_na(cond, 1, 0)) == [1, 0, None]
    assert column(spark, ["a", "b", None], fn.case_when((cond, 1), default=0)) == [1, 0, 0]


def test_text(spark):
    assert column(spark, ["stem - A sit-in", "none", None, "stem - "], fn.extract_na("x", "(?<= - ).*")) == ["A sit-in", None, None, ""]
    assert column(spark, ["for", "non-binary GIRL", "don't"], fn.title_case("x")) == ["For", "Non-Binary Girl", "Don't"]
    assert column(spark, ["sex AND gender", "", None], fn.sentence_case("x")) == ["Sex and gender", "", None]
    assert column(spark, ["aa bb cc", "abcdef g", ""], fn.wrap_text("x", 5)) == ["aa bb\ncc", "abcdef\ng", ""]


def test_numbers(spark):
    nums = [2.5, 3.5, -2.5]
    assert column(spark, nums, fn.round_even("x"), "double") == [2.0, 4.0, -2.0]
    assert column(spark, [0.126, -0.001, 1.5, None, 0.125], fn.fmt_num("x"), "double") == ["0.13", "-0.00", "1.50", None, "0.12"]
    assert column(spark, [0.126, -0.5], fn.fmt_num("x", 2, leading_zero=False), "double") == [".13", "-.50"]
    assert column(spark, [0.456, 1.0], fn.fmt_pct("x"), "double") == ["46%", "100%"]
    text = fn.fmt_estimate("x", F.col("x") - 1, F.col("x") + 1)
    assert column(spark, [0.5], text, "double") == ["d = 0.50, [-0.50, 1.50]"]
    assert column(spark, [1000.0, -1000.0, 0.0], fn.inv_logit("x"), "double") == [1.0, 0.0, 0.5]


def test_monotonic(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], x) for x in range(1, 6)], "z array<double>, x int")
    got = df.select(fn.monotonic(F.col("z"), "x").alias("m"), fn.monotonic(F.col("z"), "x", "steps").alias("s")).collect()
    assert [round(r.m, 9) for r in got] == [0.0, 0.4, 1.2, 2.4, 4.0]
    assert [round(r.s, 9) for r in got] == [0.0, 0.1, 0.6, 1.8, 4.0]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["RecordedDate", "Q12_1", "Highest education level", "q12 1", "age%"])
    clean = recode.clean_names(df)
    assert clean.columns == ["recorded_date", "q12_1", "highest_education_level", "q12_1_2", "agepercent"]
    picked = recode.select_cols(clean, "age=agepercent", "q12*", "everything()", "-q12_1_2")
    assert picked.columns == ["age", "q12_1", "recorded_date", "highest_education_level"]


def test_recode_dictionary_never_multiplies_rows(spark):
    df = spark.createDataFrame([(" Femail",), ("femail ",), ("other",), (None,)], "g string")
    words = shape.literal_table(spark, ["key", "value"], [("femail", "woman"), ("FEMAIL", "woman"), ("m", "man")])
    kept = recode.recode_dict(df, "g", words, keep_unmatched=True)
    assert rows(kept) == [("other",), ("woman",), ("woman",), (None,)]
    nulled = recode.recode_dict(df, "g", words, keep_unmatched=False)
    assert rows(nulled) == [("woman",), ("woman",), (None,), (None,)]


def test_z_score_with_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert rows(recode.z_score(df, ["x"])) == [(-0.7071067811865475,), (0.7071067811865475,), (None,)]
    assert rows(recode.z_score(df, ["x"], na_rm=False)) == [(None,)] * 3


def test_first_submission_keeps_ties_and_puts_missing_last(spark):
    df = spark.createDataFrame(
        [(1, False, 5, "a"), (1, False, 5, "b"), (1, True, 1, "c"), (2, True, None, "d"), (2, True, 7, "e"), (None, True, None, "f")],
        "id int, exclude boolean, at int, v string")
    got = sample.first_by(df, ["id"], ["exclude", "at"]).select("v")
    assert rows(got) == [("a",), ("b",), ("e",), ("f",)]
    assert sample.first_by(df, ["id"], ["exclude", "at"], ties=False).count() == 3
    assert rows(sample.keep_unique(df, ["id"]).select("v")) == [("f",)]


def test_exclusion_rules(spark):
    df = spark.createDataFrame([("A", "workers"), ("A", "Workers"), ("B", "workers"), ("A", None), ("A", ""), ("A", "poor ")], "c string, a string")
    rules = spark.createDataFrame([("A", "workers"), ("A", "workers"), ("A", "poor ")], "condition string, answer string")
    out = sample.exclude_by_answer(df, rules, "c", "a")
    assert rows(out) == [("A", "", True), ("A", "Workers", False), ("A", "poor ", True), ("A", "workers", True), ("A", None, True), ("B", "workers", False)]
    checked = sample.exclude_by_checks(spark.createDataFrame([(3, 1), (3, None), (2, None), (2, 1)], "a int, b int"), [F.col("a") == 3, F.col("b") == 1])
    assert rows(checked) == [(2, 1, True), (2, None, True), (3, 1, False), (3, None, True)]
    screened = sample.screen(spark.createDataFrame([(30, "x"), (30, None), (10, "x")], "age int, g string"), [(F.col("age") >= 25, F.col("g") == "x")])
    assert rows(screened) == [(10, "x", True), (30, "x", False), (30, None, True)]


def test_exclusions_off_equals_unfiltered(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, exclude boolean")
    assert rows(sample.apply_exclusions(df, False)) == [(1,), (2,)]
    assert rows(sample.apply_exclusions(df)) == [(2,)]


def test_joins_with_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (3, "q")], "k int, b string")
    assert rows(shape.join_na(a, b, ["k"])) == [(1, "x", None), (None, "y", "p")]
    assert rows(a.join(b, "k", "left")) == [(1, "x", None), (None, "y", None)]
    assert rows(shape.natural_full_join(a, b)) == [(1, "x", None), (3, None, "q"), (None, "y", "p")]
    assert rows(shape.join_na(a, b, ["k"], "right")) == [(3, None, "q"), (None, "y", "p")]
    assert rows(sample.keep_ids(a, b, ["k"])) == [(None, "y")]


def test_crossing_removes_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert rows(shape.crossing(df, g=[2, 1, 1])) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert len(shape.seq(-2.5, 2.5, 0.1)) == 51 and shape.seq(1, 5, 2) == [1, 3, 5]


def test_codebook(spark):
    df = spark.createDataFrame([("Stem - Do [Field-protest] it", "no separator")], ["q3_1", "q3_2"])
    got = codebook(df, "~q3_", placeholders={"[Field-protest]": "[for/against]"})
    assert rows(got) == [(1, "Do [for/against] it"), (2, None)]


def test_long_and_wide(spark):
    df = spark.createDataFrame([(7, "1", "x"), (8, None, "0")], "id int, q3_1 string, q5_2 string")
    long = shape.to_long(df, ["q3_1", "q5_2"], r"(.*)_([0-9]*)", [("target", "string"), ("action", "int")], "response", "int", True)
    assert rows(long) == [(7, "q3", 1, 1), (8, "q5", 2, 0)]
    wide = shape.to_wide(long, ["target", "action"], "response", [("q3", 1), ("q5", 2)], ["id"], fill=9)
    assert rows(wide) == [(7, 1, 9), (8, 9, 0)]


@pytest.mark.parametrize("one_pass", [True, False])
def test_quantiles(spark, one_pass):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    assert rows(quantiles.median_qi(df, ["x"], one_pass=one_pass)) == [(5.5, 1.225, 9.775, 0.95)]
    several = quantiles.median_qi(df.withColumn("y", -F.col("x")), ["x", "y"], one_pass=one_pass)
    assert list(several.first()) == pytest.approx([5.5, 1.225, 9.775, -5.5, -9.775, -1.225, 0.95])
    nested = quantiles.interval_set(df, "x", [], (0.5, 0.8), one_pass=one_pass)
    assert [tuple(round(v, 9) for v in r) for r in rows(nested)] == [(0.5, 5.5, 3.25, 7.75), (0.8, 5.5, 1.9, 9.1)]


def test_ordering(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "id string")
    assert rows(ordering.dense_index(df, "id", "jj")) == [("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, None)]
    top = ordering.top_n_ties(spark.createDataFrame([(5,), (3,), (3,), (1,), (None,)], "x int"), 2, "x")
    assert [r.x for r in top.collect()] == [5, 3, 3]
    totals = ordering.running_total(spark.range(100), ["id"], {"s": "id"})
    assert all(r.s == r.id * (r.id + 1) // 2 for r in totals.collect())
    numbered = ordering.global_index(spark.range(1000).repartition(7), [F.desc("id")], "n")
    assert all(r.n == 1000 - r.id for r in numbered.collect())


def test_superiority_and_effect_size(spark):
    a, b = [5, 4, 4, 3], [1, 4, 2]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("a", None), ("c", 9)], "g string, x int")
    got = summary.prob_superiority(df, "g", "a", "b", "x").first()
    wins, ties = sum(x > y for x in a for y in b), sum(x == y for x in a for y in b)
    assert got.strict == pytest.approx(wins / 12) and got.half_ties == pytest.approx((wins + ties / 2) / 12)
    d = summary.cohens_d(df, "g", "a", "b", ["x"]).first().d
    assert d == pytest.approx((4 - 7 / 3) / ((3 * (2 / 3) + 2 * (7 / 3)) / 5) ** 0.5)


def test_proportions(spark):
    df = spark.createDataFrame([("i", 1), ("i", 1), ("i", 2), ("j", 2), ("j", None)], "item string, y int")
    assert rows(summary.count_wide(df, ["item"], "y", [1, 2, 3])) == [("i", 2, 1, 0), ("j", 0, 1, 0)]
    assert rows(summary.prop_wide(df, ["item"], "y", [1, 2])) == [("i", 2 / 3, 1 / 3), ("j", 0.0, 1.0)]
    assert rows(summary.group_means(df, ["item"], ["y"], na_rm=False)) == [("i", 4 / 3), ("j", None)]


def test_information(spark):
    items = spark.createDataFrame([(1, 1.31, -0.4, 1.0, 2.6, 5.0)], "item int, alpha double, beta_1 double, beta_2 double, beta_3 double, beta_4 double")
    for method in ("closed", "grid"):
        assert graded.item_information(items, method).first().information == pytest.approx(7.5916261695, abs=1e-9)
    for r in graded.grm_probs(items, [-2.0, 0.0, 3.0]).collect():
        assert sum(r[f"p_{k}"] for k in range(1, 6)) == pytest.approx(1.0)


def test_contrast_modes(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 4.0), (1, "c", 50.0)], "draw int, g string, z double")
    w = {"k": contrasts.coded((F.col("g") == "a", -1.0), (F.col("g") == "b", 1.0))}
    assert rows(contrasts.contrast(df, w)) == [(1, "k", 5.0)]
    assert rows(contrasts.contrast(df, w, mode="mean")) == [(1, "k", 5.0 / 3)]
    assert rows(contrasts.contrast(df, w, mode="balanced")) == [(1, "k", 2.0)]
    assert rows(contrasts.marginal_diff(df, "g", "b", "a")) == [(1, 2.0)]


def test_correlations_of_many_columns(spark):
    """Nulls pair by pair, a constant, large means, values that are not finite, no rows; 200 columns plan quickly."""
    rng = np.random.default_rng(3)
    n, p = 5_000, 200
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, p)) + rng.normal(size=(n, p)) + 1e6
    x[:, 7] = 0.1
    x[rng.random((n, p)) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=[f"c.{i}" for i in range(p)])
    df = spark.createDataFrame(frame).repartition(5)
    df = df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in df.columns])
    got = summary.cor_matrix(df, df.columns).toPandas().sort_values("rank")
    want = frame.corr().to_numpy()
    np.fill_diagonal(want, np.nan)
    want[7], want[:, 7] = np.nan, np.nan
    assert list(got.term) == list(frame.columns)
    np.testing.assert_allclose(got[list(frame.columns)].to_numpy(float), want, atol=1e-9)
    odd = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("nan"), 3.0), (3.0, 5.0, None)], "a double, b double, c double")
    a, b, c = summary.cor_matrix(odd, ["a", "b", "c"]).orderBy("rank").collect()
    assert a.a is None and np.isnan(a.b) and a.c == pytest.approx(1.0) and np.isnan(b.c) and c.a == pytest.approx(1.0)
    none = summary.cor_matrix(odd.limit(0), ["a", "b"], digits=2).orderBy("rank").collect()
    assert [tuple(r) for r in none] == [(1, "a", "", ""), (2, "b", "", "")]


def test_values_without_a_column_are_an_error(spark):
    df = spark.createDataFrame([("i", 1), ("i", 4), ("i", None)], "item string, y int")
    for fn in (summary.count_wide, summary.prop_wide):
        with pytest.raises(Exception, match="value without a column: 4"):
            fn(df, ["item"], "y", [1, 2]).collect()
    assert rows(summary.count_wide(df, ["item"], "y", [1, 2], drop_others=True)) == [("i", 1, 0)]
    with pytest.raises(ValueError, match="more than 2 new columns"):
        shape.to_wide(spark.range(3), ["id"], "id", None, [], most=2)
