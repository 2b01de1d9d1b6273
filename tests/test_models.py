"""Recovery of known parameters, and agreement of local and distributed paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.operators.fixed_point import NotSettled
from opinara.operators import calibrate, draws, effects, factor, quantiles
from opinara.operators.draws import spread_draws


def frame(spark, **cols):
    df = spark.createDataFrame(pd.DataFrame(cols))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    n, lam = 2500, np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.8])
    f = rng.normal(size=n)
    x = 3 + f[:, None] * lam + rng.normal(size=(n, 6)) * 0.6
    x[rng.random(x.shape) < 0.06] = np.nan
    x[0] = np.nan
    big_id = 9_007_199_254_740_993 + np.arange(n)
    return frame(spark, id=big_id, **{f"s{i}": x[:, i] for i in range(6)}), lam, f, x


MODEL = {"g": [f"s{i}" for i in range(6)]}


def test_factor_model(people):
    df, lam, f, _ = people
    fit, patterns = factor.fit_model(df, MODEL)
    assert np.abs(fit.loadings[:, 0] - lam).max() < 0.06
    scores = factor.factor_scores(df, MODEL, fit)
    got = scores.toPandas().sort_values("id")
    assert got["id"].iloc[0] == 9_007_199_254_740_993 and scores.filter("g IS NULL").count() == 1
    assert np.corrcoef(got.g[1:], f[1:])[0, 1] > 0.9
    report = factor.factor_fit(df, MODEL).first()
    assert report.df == 9 and report.cfi > 0.98 and report.rmsea < 0.05 and 0.8 < report.omega < 0.95


def test_factor_model_distributed_equals_local(people):
    df, *_ = people
    near = factor.Patterns(df, MODEL["g"])
    far = factor.Patterns(df, MODEL["g"], cells=3)
    assert near.local is not None and far.local is None and far.rows is not None
    a, b = factor.fit_factors(near, MODEL, tol=1e-3), factor.fit_factors(far, MODEL, tol=1e-3)
    assert np.allclose(a.loadings, b.loadings) and a.log_lik == pytest.approx(b.log_lik)


def test_pattern_moments_agree_however_they_are_computed(people):
    df, *_ = people
    n, seen, mean, cov = factor.Patterns(df, MODEL["g"]).local
    table = {r.pattern: r for r in factor.pattern_table(df, MODEL["g"]).collect()}
    upper = np.triu_indices(seen.shape[1])
    assert len(table) == len(n)
    for k in range(len(n)):
        row = table["".join("1" if s else "0" for s in seen[k])]
        assert row.n == n[k]
        assert np.allclose(np.nan_to_num(np.array(row.mean, float)), mean[k])
        assert np.allclose(np.nan_to_num(np.array(row.cov, float)), cov[k][upper])


def test_two_factor_model(spark):
    rng = np.random.default_rng(2)
    n = 3000
    f = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], size=n)
    x = np.concatenate([f[:, [0]] * [0.9, 0.7, 0.8], f[:, [1]] * [0.6, 0.9, 0.7]], axis=1) + rng.normal(size=(n, 6)) * 0.5
    df = frame(spark, **{f"s{i}": x[:, i] for i in range(6)})
    fit, _ = factor.fit_model(df, {"a": ["s0", "s1", "s2"], "b": ["s3", "s4", "s5"]})
    assert abs(fit.phi[0, 1] - 0.5) < 0.06 and (fit.loadings[:3, 1] == 0).all()
    patterns = factor.Patterns(df, [f"s{i}" for i in range(6)])
    model = {"a": ["s0", "s1", "s2"], "b": ["s3", "s4", "s5"]}
    loose, tight = factor.fit_factors(patterns, model), factor.fit_factors(patterns, model, tol=1e-10)
    assert np.abs(loose.loadings - tight.loadings).max() < 1e-5 and loose.converged
    with pytest.raises(NotSettled):
        factor.fit_factors(patterns, model, max_iter=3)


def test_three_items_have_a_closed_form(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 1)) * [0.8, 0.6, 0.7] + rng.normal(size=(4000, 3)) * 0.6
    fit, _ = factor.fit_model(frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2]), {"f": ["a", "b", "c"]})
    s = np.cov(x.T, bias=True)
    want = np.sqrt([s[0, 1] * s[0, 2] / s[1, 2], s[0, 1] * s[1, 2] / s[0, 2], s[0, 2] * s[1, 2] / s[0, 1]])
    assert np.abs(fit.loadings[:, 0] - want).max() < 1e-4
    assert np.abs(fit.uniquenesses - (np.diag(s) - want**2)).max() < 1e-4


def test_six_factors_with_36_items(spark):
    rng = np.random.default_rng(14)
    phi = np.full((6, 6), 0.3) + np.eye(6) * 0.7
    f = rng.multivariate_normal(np.zeros(6), phi, size=4000)
    x = np.repeat(f, 6, axis=1) * rng.uniform(0.5, 0.9, 36) + rng.normal(size=(4000, 36)) * 0.6
    x[rng.random(x.shape) < 0.002] = np.nan
    df = frame(spark, **{f"s{i}": x[:, i] for i in range(36)})
    model = {f"f{k}": [f"s{i}" for i in range(6 * k, 6 * k + 6)] for k in range(6)}
    fit, patterns = factor.fit_model(df, model)
    assert patterns.local is not None and np.abs(fit.phi - phi).max() < 0.08
    assert factor.factor_scores(df, model, fit).count() == 4000


def unrelated(spark, seed, n=4_000):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 7)) < 0.4).astype(float)
    x[rng.random(x.shape) < 0.57] = np.nan
    return frame(spark, **{f"s{i}": x[:, i] for i in range(7)})


@pytest.mark.parametrize("parts", [[7], [3, 7]])
def test_hardly_related_items_settle_on_the_border(spark, parts):
    """The likeliest loading takes nearly all of an item's variance: a maximum that plain EM only creeps up to."""
    model = {f"f{end}": [f"s{i}" for i in range(start, end)] for start, end in zip([0, *parts], parts, strict=False)}
    border = 0
    for seed in range(3):
        patterns = factor.Patterns(unrelated(spark, seed), [f"s{i}" for i in range(7)])
        fit = factor.fit_factors(patterns, model, max_iter=1_000)
        mean, var = factor._observed_moments(patterns)
        border += (fit.uniquenesses / var < 1e-5).any()
        assert fit.log_lik > factor._log_lik(patterns, mean, np.diag(var)) and (fit.uniquenesses > 0).all()
    assert border


def test_slopes_of_the_factor_likelihood_are_its_differences(people):
    df, *_ = people
    patterns, loads = factor.Patterns(df, MODEL["g"]), np.array([[1, 0]] * 2 + [[1, 1]] + [[0, 1]] * 3, bool)

    def look(t):
        load, phi = np.zeros((6, 2)), np.eye(2)
        load[loads], phi[0, 1], phi[1, 0] = t[6:13], t[19], t[19]
        return factor._likelihood(patterns, t[:6], load, t[13:19], phi, loads)

    at = np.r_[np.full(6, 2.9), np.linspace(0.3, 0.9, 7), np.linspace(0.3, 0.6, 6), 0.3]
    _, gradient, curvature = look(at)
    for i, e in enumerate(1e-5 * np.eye(len(at))):
        (up, up_slope, _), (down, down_slope, _) = look(at + e), look(at - e)
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-5 * np.abs(gradient).max()
        assert np.abs((up_slope - down_slope) / 2e-5 - curvature[i]).max() < 1e-5 * np.abs(curvature).max()


def responses(spark, seed=3, n=3000, n_items=8):
    rng = np.random.default_rng(seed)
    a, b = np.exp(rng.normal(size=n_items) * 0.3), rng.normal(size=n_items)
    cell, x = rng.integers(1, 4, n), rng.normal(size=n)
    eta = rng.normal(size=n) + np.array([0.0, 0.6, -0.6])[cell - 1] + 0.5 * x
    y = (rng.random((n, n_items)) < 1 / (1 + np.exp(-a * (eta[:, None] + b)))).astype(int)
    df = frame(spark, id=np.repeat(np.arange(n), n_items), item=np.tile(np.arange(1, n_items + 1), n), y=y.ravel(),
               kk=np.repeat(cell, n_items), x=np.repeat(x, n_items))
    return df, a, b, eta


def test_binary_calibration(spark):
    df, a, b, eta = responses(spark)
    fit = calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"])
    items = fit.items.toPandas().sort_values("item")
    terms = {r.term: r.estimate for r in fit.effects.collect()}
    assert np.abs(items.alpha - a).max() < 0.25
    # The location of beta is only tied to the effects by their prior; the data determine alpha * beta.
    shift = np.median(items.beta - b)
    assert np.abs(items.alpha * (items.beta - shift) - a * b).max() < 0.2
    assert terms["delta[2]"] - terms["delta[3]"] == pytest.approx(1.2, abs=0.15)
    assert terms["b_x"] == pytest.approx(0.5, abs=0.08)
    flipped = calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"], sign=-1)
    same = calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"], tol=1e-8)
    tight = same.items.toPandas().sort_values("item")
    assert np.abs(flipped.items.toPandas().sort_values("item").beta + tight.beta).max() < 1e-4
    # A hundred times smaller steps change nothing that matters.
    assert np.abs(items.alpha - tight.alpha).max() < 1e-4 and np.abs(items.beta - tight.beta).max() < 1e-4
    scores = calibrate.score_eap(df, fit.items, "id", "item", "y").toPandas().sort_values("id")
    assert np.corrcoef(scores.theta, eta)[0, 1] > 0.8 and (scores.n_items == 8).all()


def test_monotonic_effect(spark):
    rng = np.random.default_rng(8)
    n, n_items, steps = 4000, 10, np.array([0.0, 0.6, 0.6, 0.7, 1.2])
    level = rng.integers(1, 6, n)
    eta = rng.normal(size=n) + steps[level - 1]
    b = rng.normal(size=n_items)
    y = (rng.random((n, n_items)) < 1 / (1 + np.exp(-1.3 * (eta[:, None] + b)))).astype(int)
    df = frame(spark, id=np.repeat(np.arange(n), n_items), item=np.tile(np.arange(n_items), n), y=y.ravel(), sup=np.repeat(level, n_items))
    terms = {r.term: r.estimate for r in calibrate.calibrate_2pl(df, "id", "item", "y", ordinal="sup").effects.collect()}
    assert terms["b_sup"] == pytest.approx(0.3, abs=0.06)
    assert sum(terms[f"step[{x}]"] for x in range(2, 6)) == pytest.approx(4 * terms["b_sup"])
    shares = [terms[f"z_sup[{i}]"] for i in range(1, 5)]
    assert min(shares) >= 0 and sum(shares) == pytest.approx(1) and shares[0] == pytest.approx(0.5, abs=0.12)


def test_equal_answers_are_pooled_exactly(spark):
    """A short scale is reduced to its answer patterns; repeated rows of one person add up."""
    df, *_ = responses(spark, n=1500, n_items=4)
    layout = calibrate.person_layout(df, "id", "item", "y", [1, 2, 3, 4], (0, 1)).withColumn("x", F.array().cast("array<double>"))
    pooled = calibrate._distinct_people(layout.select("counts", "x"))
    assert pooled.count() == 16 and pooled.agg(F.sum("weight")).first()[0] == 1500
    twice = calibrate.person_layout(df.unionByName(df), "id", "item", "y", [1, 2, 3, 4], (0, 1)).first()
    assert len(twice.counts) == 4 and all(c.n == 2 for c in twice.counts)


def test_graded_scores_match_brute_force(spark):
    items = spark.createDataFrame([(1, 1.2, -1.0, 0.5), (2, 0.7, -0.3, 1.4)], "item int, alpha double, beta_1 double, beta_2 double")
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 2), (2, 2, None)], "id int, item int, y int")
    nodes = np.linspace(-4, 4, 21)
    cum = lambda a, cuts: np.vstack([np.ones(21), *[1 / (1 + np.exp(-(a * nodes - c))) for c in cuts], np.zeros(21)])
    p = {1: cum(1.2, [-1.0, 0.5]), 2: cum(0.7, [-0.3, 1.4])}
    want = {}
    for person, answers in {1: [(1, 1), (2, 3)], 2: [(1, 2)]}.items():
        w = np.exp(-0.5 * nodes**2)
        for i, k in answers:
            w = w * (p[i][k - 1] - p[i][k])
        mean = (w * nodes).sum() / w.sum()
        want[person] = (mean, np.sqrt((w * nodes**2).sum() / w.sum() - mean**2))
    for r in calibrate.score_eap(df, items, "id", "item", "y").collect():
        assert (r.theta, r.theta_sd) == pytest.approx(want[r.id])


def test_graded_calibration(spark):
    rng = np.random.default_rng(4)
    n, n_items = 3000, 6
    a, cuts = np.exp(rng.normal(size=n_items) * 0.3), np.sort(rng.normal(size=(n_items, 4)) * 1.5, axis=1)
    theta = rng.normal(size=n)
    above = 1 / (1 + np.exp(-(a[None, :, None] * theta[:, None, None] - cuts[None])))
    y = 1 + (rng.random((n, n_items, 1)) < above).sum(2)
    df = frame(spark, id=np.repeat(np.arange(n), n_items), item=np.tile(np.arange(n_items), n), y=y.ravel())
    items = calibrate.calibrate_grm(df, "id", "item", "y").items.toPandas().sort_values("item")
    assert np.abs(items.alpha - a).max() < 0.2
    assert np.abs(items[[f"beta_{k}" for k in range(1, 5)]].to_numpy() - cuts).max() < 0.3


def test_large_group_quantiles_are_exact(spark):
    """One group holds most rows; brackets, gaps and ties are all in use."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.normal(size=150_000), np.full(60_000, 0.25)])
    small = rng.normal(size=101)
    df = frame(spark, g=np.repeat(["hot", "small"], [len(hot), len(small)]), x=np.concatenate([hot, small]))
    probs = [0.0, 0.025, 0.5, 0.6, 0.975, 1.0]
    got = {r.g: list(r)[1:] for r in quantiles.quantiles(df, "x", ["g"], probs, [f"q{i}" for i in range(6)]).collect()}
    assert np.allclose(got["hot"], np.quantile(hot, probs)) and np.allclose(got["small"], np.quantile(small, probs))
    whole = quantiles.quantiles(df, "x", [], probs, [f"q{i}" for i in range(6)]).first()
    assert np.allclose(list(whole), np.quantile(np.concatenate([hot, small]), probs))


def test_quantiles_of_several_columns_in_one_pass(spark):
    """Own groups, nulls and infinities per column; a bracket over a gap is no different."""
    rng = np.random.default_rng(8)
    n = 120_000
    split = np.where(np.arange(n) % 2 == 0, rng.normal(size=n), 1e9 + rng.normal(size=n))  # the median spans a gap
    other = np.where(np.arange(n) < n // 3, np.inf, rng.integers(0, 5, n).astype(float))
    df = frame(spark, g=np.repeat(["hot", "small"], [n - 90, 90]), a=split, b=other).withColumn(
        "b", F.expr("CASE WHEN g = 'hot' THEN b END"))
    probs = [0.25, 0.5, 0.9]
    got = {r.g: r for r in quantiles.quantile_columns(df, ["a", "b"], ["g"], probs, [["a1", "a2", "a3"], ["b1", "b2", "b3"]]).collect()}
    for g, at in (("hot", slice(0, n - 90)), ("small", slice(n - 90, n))):
        assert np.allclose([got[g].a1, got[g].a2, got[g].a3], np.quantile(split[at], probs))
    assert [got["hot"].b1, got["hot"].b2, got["hot"].b3] == list(np.quantile(other[: n - 90], probs, method="lower"))
    assert [got["small"].b1, got["small"].b2, got["small"].b3] == [None] * 3
    empty = quantiles.quantile_columns(df.filter("g = 'none'"), ["a"], ["g"], probs, [["x", "y", "z"]])
    assert empty.count() == 0


def test_pooled_sample_has_mean_zero_and_sd_one(spark):
    rng = np.random.default_rng(6)
    n, d = 50, 20
    wide = frame(spark, draw=np.arange(d), **{f"theta[{j}]": rng.normal(size=d) for j in range(1, n + 1)},
                 **{f"delta[{k}]": rng.normal(size=d) for k in (1, 2)}, **{f"b[{k}]": rng.normal(size=d) for k in (1, 2)})
    who = frame(spark, jj=np.arange(1, n + 1), kk=np.arange(n) % 2 + 1, x=rng.normal(size=n))
    theta, cells = spread_draws(wide, {"theta": ("jj",)}), spread_draws(wide, {"delta": ("kk",), "b": ("kk",)})
    moments = draws.latent_moments(who, theta, cells, slopes={"x": "b"})
    eta = who.join(theta, "jj").join(cells, ["draw", "kk"]).withColumn("eta", F.expr("theta + delta + b * x"))
    z = draws.draw_z(eta, F.col("eta"), moments).groupBy("draw").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    for r in z.collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1, abs=1e-9)


def test_written_out_item_sums_equal_the_loop(spark):
    items = spark.createDataFrame([(1, 1.0, 0.3), (1, 0.5, -1.0), (1, 2.0, 0.1)], "draw int, alpha double, beta double")
    rows = spark.createDataFrame([(1, 0.2, 0.1, 1.5)], "draw int, x double, mean double, sd double").join(effects.item_bank(items), "draw")
    loop, flat = (effects.expected_counts(rows, F.col("x"), ["x"], -1, n_items=n).first() for n in (None, 3))
    assert list(loop) == pytest.approx(list(flat))
    want = [1 / (1 + np.exp(-a * (0.2 - b))) for a, b in ((1.0, 0.3), (0.5, -1.0), (2.0, 0.1))]
    assert flat.n == pytest.approx(sum(want)) and flat.p == pytest.approx(np.mean(want)) and flat.z == pytest.approx(0.1 / 1.5)
    with pytest.raises(Exception, match="does not have 2 items"):
        effects.expected_counts(rows, F.col("x"), ["x"], n_items=2).collect()


def test_carried_value_must_be_constant(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.1), (1, 1, 0.0, 0.2)], "draw int, kk int, delta double, z double")
    items = spark.createDataFrame([(1, 1.0, 0.0)], "draw int, alpha double, beta double")
    with pytest.raises(Exception, match="z differs"):
        effects.predict_counts(rows, items, ["kk"]).collect()


@pytest.mark.parametrize("method", ["scoring", "em"])
def test_passes_read_blocks_of_people(spark, method, monkeypatch):
    """No pass turns a row per person into Arrow again, also where every person has a design of their own."""
    df, *_ = responses(spark, n=400, n_items=3)
    seen, name = [], {"scoring": "_evidence", "em": "_e_step"}[method]
    real = getattr(calibrate, name)
    monkeypatch.setattr(calibrate, name, lambda people, *rest: (seen.append(people), real(people, *rest))[1])
    fit = calibrate.calibrate_2pl(df, "id", "item", "y", covariates=["x"], tol=1e-3, method=method)
    assert fit.converged and seen[0].columns == ["block"]


def test_item_fit_pools_people(spark, monkeypatch):
    """People with the same answers and offset are one row of what item_fit writes; repeated answers count as often."""
    df, *_ = responses(spark, n=1500, n_items=4)
    fit = calibrate.calibrate_2pl(df, "id", "item", "y", prior_beta=1e4)
    written, real = [], calibrate.cut_lineage
    monkeypatch.setattr(calibrate, "cut_lineage", lambda rows: (written.append(real(rows)), written[-1])[1])
    once = {r.item: r for r in calibrate.item_fit(df, fit.items, "id", "item", "y").collect()}
    assert max(rows.count() for rows in written) <= 4 * 16
    for item, n, share in df.groupBy("item").agg(F.count("y"), F.avg("y")).collect():
        assert once[item].n == n and once[item].observed == pytest.approx(share)
    first = df.filter("id = 0")
    again = {r.item: r for r in calibrate.item_fit(df.unionByName(first), fit.items, "id", "item", "y").collect()}
    assert all(again[i].n == once[i].n + 1 for i in once)
