"""Second-order estimation: derivatives by differences, priors and shares by brute force, recovery, wide banks."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from opinara.operators import calibrate, scoring

NODE = np.linspace(-6, 6, 41)


def compressed(dense):
    person, at = np.nonzero(dense)
    return scoring.Answers(at, dense[person, at], np.bincount(person, minlength=len(dense)))


def evidence(curves, n_items, answers, x, weight, node=NODE):
    """The sums of all people without Spark."""
    sums = scoring.Sums(n_items, curves, x.shape[1], len(node))

    def at(psi):
        total = np.zeros(sums.size)
        first = curves.first(psi[: n_items * curves.per_item].reshape(n_items, -1), node)
        for s in (slice(0, len(x) // 3), slice(len(x) // 3, None)):
            sums.add(total, compressed(answers[s]), x[s], weight[s], psi, node, first)
        where, values = sums.shipped(total)
        flat = np.zeros(sums.size)
        flat[where] = values
        return sums.evidence(flat, psi, node)

    return at


def differences(f, x, h=1e-5):
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(len(x))])


def some_answers(rng, people, n_items, categories, missing=0.2):
    out = np.zeros((people, n_items, categories))
    y = rng.integers(0, categories, (people, n_items))
    out[np.arange(people)[:, None], np.arange(n_items)[None, :], y] = 1
    out[rng.random((people, n_items)) < missing] = 0
    out[0, 0] *= 3  # repeated rows add up
    return out.reshape(people, -1)


@pytest.mark.parametrize("pair_cost", [0, 1e9], ids=["pairs", "matrices"])
@pytest.mark.parametrize("curves", [scoring.BinaryCurves(), scoring.GradedCurves(4)], ids=["binary", "graded"])
def test_gradient_and_curvature(curves, pair_cost, monkeypatch):
    monkeypatch.setattr(scoring, "PAIR_COST", pair_cost)
    monkeypatch.setattr(scoring, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(scoring, "CELLS_AT_ONCE", 200)
    rng = np.random.default_rng(0)
    params = np.c_[rng.normal(size=3) * 0.3, np.sort(rng.normal(size=(3, curves.per_item - 1)) * 1.5, axis=1)]
    values, slopes, bends = curves.natural(params)
    natural = lambda p: curves.natural(p.reshape(params.shape))
    flat = lambda a: np.concatenate([a[i].ravel() for i in range(3)])
    jac = differences(lambda p: natural(p)[0].ravel(), params.ravel()).T
    for i in range(3):
        k = slice(i * curves.per_item, (i + 1) * curves.per_item)
        assert np.allclose(jac[k, k], slopes[i], atol=1e-8)
        assert np.allclose(differences(lambda p: natural(p)[1][i], params.ravel())[k].transpose(1, 2, 0), bends[i], atol=1e-8)
    x = rng.normal(size=(50, 2))
    at = evidence(curves, 3, some_answers(rng, 50, 3, curves.categories), x, rng.integers(1, 4, 50).astype(float))
    psi = np.r_[flat(values), 0.3, -0.4]
    _, gradient, curvature = at(psi)
    assert np.allclose(differences(lambda p: at(p)[0], psi), gradient, atol=1e-6)
    assert np.allclose(differences(lambda p: at(p)[1], psi), curvature, atol=1e-5)
    assert curves.valid(values) and not curves.valid(-values)


def monotonic_people(rng, n=900, n_items=6, cells=3, slopes=(0.5, 0.4, -0.5), shares=(0.5, 0.3, 0.2)):
    cell, level = rng.integers(0, cells, n), rng.integers(0, len(shares) + 1, n)
    steps = np.concatenate([[0], np.cumsum(shares)]) * len(shares)
    eta = rng.normal(size=n) + np.array([0.3, -0.2, 0.0])[cell] + np.array(slopes)[cell] * steps[level]
    a, b = np.exp(rng.normal(size=n_items) * 0.2 + 0.3), rng.normal(size=n_items)
    y = (rng.random((n, n_items)) < 1 / (1 + np.exp(-a * (eta[:, None] + b)))).astype(int)
    x = np.zeros((n, cells + cells * len(shares)))
    x[np.arange(n), cell] = 1
    for k in range(len(shares)):
        x[level > k, cells + cell[level > k] * len(shares) + k] = 1
    return np.stack([1 - y, y], 2).reshape(n, -1).astype(float), x, (cell, level, y)


def test_standard_errors_are_the_curvature_of_the_whole_objective():
    """In their own units, with a latent spread and a monotonic effect, by second differences."""
    rng = np.random.default_rng(2)
    answers, x, _ = monotonic_people(rng)
    k, cells, levels = 6, 3, 3
    curves = scoring.BinaryCurves()
    s = scoring.Structure(curves, 2 * k, cells, levels, cells, True, stretch=True)
    s.groups = [scoring.Group("a", np.arange(0, 2 * k, 2), 0.7, stretches=False), scoring.Group("b", np.arange(1, 2 * k, 2), 2.0, centred=True),
                scoring.Group("d", 2 * k + np.arange(cells), 1.5), scoring.Group("s", s.slope_at + 1 + np.arange(cells), 0.8),
                scoring.Group("m", np.array([s.slope_at]), 1.0)]
    at = evidence(curves, k, answers, x, np.ones(len(x)))
    fit = scoring.maximise(at, s, np.zeros(s.parameters), 1e-9, 60, lambda p: True)
    assert (fit.at.z > 0).all() and fit.passes <= 20

    def objective(own):
        """Penalised likelihood of parameters in their own units, log latent spread, and all shares but the last."""
        phi, scale = own[: s.parameters], own[s.parameters]
        z = np.r_[own[s.parameters + 1 :], 1 - own[s.parameters + 1 :].sum()]
        fixed = np.zeros(s.parameters, bool)
        fixed[: 2 * k : 2] = True
        inner = np.where(fixed, phi + scale, phi * np.exp(-scale))
        plain = -0.5 * phi @ s.precision([g.spread for g in s.groups]) @ phi
        assert np.isclose(-plain, s.penalty(inner, [g.spread for g in s.groups], scale))
        return at(s.to_coefficients(inner, z)[0])[0] + plain

    scale = fit.at.scale
    phi = np.where(np.arange(s.parameters) % 2 + (np.arange(s.parameters) >= 2 * k) == 0, fit.at.phi - scale, fit.at.phi * np.exp(scale))
    own = np.r_[phi, scale, fit.at.z[:-1]]
    assert np.abs(differences(objective, own, 1e-4)).max() < 1e-3  # stationary
    h = 1e-3
    info = -differences(lambda p: differences(objective, p, h), own, h)
    want = np.sqrt(np.diag(np.linalg.inv(info)))
    got = np.sqrt(np.diag(fit.cov))[: len(own)]
    assert np.abs(got / want - 1).max() < 0.01


def test_shares_against_brute_force():
    rng = np.random.default_rng(9)
    for n in (1, 2, 4):
        for _ in range(40):
            m = rng.normal(size=(n + 2, n))
            lhs, rhs = m.T @ m + 0.01 * np.eye(n), rng.normal(size=n) * 3
            got = scoring.simplex_programme(lhs, rhs)
            best = np.inf
            for size in range(1, n + 1):
                for on in map(list, itertools.combinations(range(n), size)):
                    kkt = np.block([[lhs[np.ix_(on, on)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
                    x = np.zeros(n)
                    x[on] = np.linalg.solve(kkt, np.r_[rhs[on], 1])[:-1]
                    if (x >= -1e-12).all():
                        best = min(best, 0.5 * x @ lhs @ x - rhs @ x)
            assert (got >= 0).all() and got.sum() == pytest.approx(1)
            assert 0.5 * got @ lhs @ got - rhs @ got == pytest.approx(best, abs=1e-8)


def test_spreads_against_a_grid():
    """Parameters summed out numerically: normal means with known errors, half-Cauchy prior."""
    rng = np.random.default_rng(4)
    values, error = rng.normal(size=14) * 0.6 + 1, 0.3
    lhs, rhs = np.eye(14) / error**2, values / error**2
    for centred in (False, True):
        got, = scoring.likeliest_spreads(lhs, rhs, [scoring.Group("g", np.arange(14), 1.0, True, centred)], [1.0], 5.0)
        grid = np.linspace(0.05, 4, 20_000)
        away = values - values.mean() if centred else values
        var = error**2 + grid**2
        value = -0.5 * (14 - centred) * np.log(var) - 0.5 * (away**2).sum() / var - np.log1p(grid**2 / 25)
        assert got == pytest.approx(grid[np.argmax(value)], abs=1e-3)
    flat, = scoring.likeliest_spreads(lhs, rhs * 0, [scoring.Group("g", np.arange(14), 1.0, True)], [1.0], 5.0)
    assert flat == pytest.approx(scoring.LEAST_SPREAD)


def long_table(spark, y, **cols):
    n, k = y.shape
    return spark.createDataFrame(pd.DataFrame(
        {"id": np.repeat(np.arange(n), k), "item": np.tile(np.arange(k), n), "y": y.ravel(), **{c: np.repeat(v, k) for c, v in cols.items()}}))


def test_slopes_vary_around_group_means(spark):
    rng = np.random.default_rng(5)
    n, k, cells = 12_000, 10, 24
    cell, x = rng.integers(0, cells, n), rng.normal(size=n)
    a, b, group = np.exp(rng.normal(size=k) * 0.3), rng.normal(size=k), np.arange(cells) % 2
    delta, slope = rng.normal(size=cells) * 0.5, np.where(group == 0, 0.6, -0.2) + rng.normal(size=cells) * 0.3
    eta = rng.normal(size=n) + delta[cell] + slope[cell] * x
    df = long_table(spark, (rng.random((n, k)) < 1 / (1 + np.exp(-a * (eta[:, None] + b)))).astype(int), kk=cell, x=x)
    fit = calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"], hierarchical=True,
                                  slope_groups={c: ("for", "against")[c % 2] for c in range(cells)})
    terms = {r.term: r.estimate for r in fit.effects.collect()}
    errors = {r.term: r.se for r in fit.effects.collect()}
    assert fit.iterations <= 15
    for g, name in enumerate(("for", "against")):
        own = slope[group == g]
        assert terms[f"b_x_{name}"] == pytest.approx(own.mean(), abs=0.05) and 0.03 < errors[f"b_x_{name}"] < 0.15
        for c in np.flatnonzero(group == g):
            assert terms[f"b_x_{name}"] + terms[f"b_x[{c}]"] == pytest.approx(slope[c], abs=0.2)
    rest = np.concatenate([slope[group == g] - slope[group == g].mean() for g in (0, 1)])
    assert terms["sd_b_x"] == pytest.approx(np.sqrt((rest**2).sum() / (cells - 2)), abs=0.05)
    assert terms["sd_delta"] == pytest.approx(delta.std(ddof=1), abs=0.05)
    with pytest.raises(ValueError, match="without a group"):
        calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"], slope_groups={0: "for"})


def test_a_cell_may_turn_a_monotonic_effect_around(spark):
    rng = np.random.default_rng(6)
    slopes, shares = (0.5, 0.4, -0.5), (0.6, 0.1, 0.3)
    _, _, (cell, level, y) = monotonic_people(rng, 9_000, 8, 3, slopes, shares)
    df = long_table(spark, y, kk=cell, sup=level + 1)
    fit = calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", ordinal="sup", slopes_by_cell=True)
    terms = {r.term: r.estimate for r in fit.effects.collect()}
    got = [terms["b_sup"] + terms[f"b_sup[{c}]"] for c in range(3)]
    assert np.abs(np.array(got) - slopes).max() < 0.06 and got[2] < -0.4 and fit.iterations <= 15
    assert np.abs(np.array([terms[f"z_sup[{i}]"] for i in (1, 2, 3)]) - shares).max() < 0.06
    assert terms["step[2]"] == pytest.approx(3 * terms["b_sup"] * terms["z_sup[1]"])
    pooled = {r.term: r.estimate for r in calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", ordinal="sup", slopes_by_cell=True,
                                                                  hierarchical=True).effects.collect()}
    assert pooled["sd_b_sup"] == pytest.approx(np.std(slopes, ddof=1), abs=0.25)


def test_both_methods_agree(spark):
    rng = np.random.default_rng(7)
    n, k = 4_000, 7
    cell, x, a, b = rng.integers(0, 3, n), rng.normal(size=n), np.exp(rng.normal(size=k) * 0.3), rng.normal(size=k)
    eta = rng.normal(size=n) + np.array([0, 0.5, -0.5])[cell] + 0.4 * x
    df = long_table(spark, (rng.random((n, k)) < 1 / (1 + np.exp(-a * (eta[:, None] + b)))).astype(int), kk=cell, x=x)
    both = [calibrate.calibrate_2pl(df, "id", "item", "y", cell="kk", covariates=["x"], estimate_sigma=True, tol=1e-8, method=m) for m in ("scoring", "em")]
    items = [f.items.orderBy("item").toPandas() for f in both]
    # The grid ends at 6, which moves items against cells by a little; nothing else depends on it.
    assert np.abs(items[0].alpha - items[1].alpha).max() < 2e-4
    assert np.abs((items[0].beta - items[0].beta.mean()) - (items[1].beta - items[1].beta.mean())).max() < 5e-4
    effects = [{r.term: r.estimate for r in f.effects.collect()} for f in both]
    assert effects[0]["b_x"] == pytest.approx(effects[1]["b_x"], abs=2e-4)
    assert effects[0]["delta[1]"] - effects[0]["delta[2]"] == pytest.approx(effects[1]["delta[1]"] - effects[1]["delta[2]"], abs=5e-4)
    assert items[0].se_alpha.between(0.05, 1).all() and items[1].se_alpha.isna().all() and both[0].iterations <= 15
    ratings = long_table(spark, 1 + (rng.random((n, k, 3)) < 1 / (1 + np.exp(-(a[:, None] * eta[:, None, None] - np.array([-1, 0.2, 1.1]))))).sum(2))
    graded = [calibrate.calibrate_grm(ratings, "id", "item", "y", 4, tol=1e-8, method=m) for m in ("scoring", "em")]
    cols = ["alpha", "beta_1", "beta_2", "beta_3"]
    found = [g.items.orderBy("item").select(*cols).toPandas().to_numpy() for g in graded]
    assert np.abs(found[0] - found[1]).max() < 1e-5 and graded[0].iterations <= 15
    with pytest.raises(ValueError, match="need method"):
        calibrate.calibrate_2pl(df, "id", "item", "y", ordinal="kk", method="em")


def test_wide_banks_stay_sparse():
    """10,000 items: a pass costs memory by answers, not by people times items."""
    rng = np.random.default_rng(8)
    n, k, own = 4_000, 10_000, 40
    at = np.sort(np.stack([rng.choice(2 * k, own, replace=False) for _ in range(n)]).ravel().reshape(n, own), axis=1)
    cells = pa.StructArray.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(rng.integers(1, 4, n * own), pa.float32())], ["at", "n"])
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * own + 1, own), pa.int32()), cells)
    table, rows = rng.normal(size=(2 * k, 41)), rng.random((n, 41))
    tracemalloc.start()
    answers = scoring.Answers.of(column)
    times, spread = answers.times(table), answers.spread_over(rows, 2 * k)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100e6
    some = slice(100, 130)
    dense = scoring.Answers.of(column.slice(100, 30)).dense(2 * k)
    assert np.allclose(times[some], dense @ table) and dense.sum() == scoring.Answers.of(column.slice(100, 30)).n.sum()
    part = scoring.Answers.of(column.slice(100, 30)).spread_over(rows[some], 2 * k)
    assert np.allclose(part, dense.T @ rows[some]) and np.isclose(spread.sum(), (times * 0 + rows * answers.n.reshape(n, own).sum(1)[:, None]).sum())


def test_too_many_parameters_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(p, i, (p + i) % 2) for p in range(30) for i in range(5)], "id int, item int, y int")
    monkeypatch.setattr(calibrate, "PARAMETERS", 9)
    with pytest.raises(ValueError, match="use method='em'"):
        calibrate.calibrate_2pl(df, "id", "item", "y")
    assert calibrate.calibrate_2pl(df, "id", "item", "y", method="em", tol=1e-4).items.count() == 5


def test_shares_without_a_single_best_place_call_for_damping():
    """A picture that bends upwards along the shares has no maximum inside: the pass is damped instead of given up."""
    lhs = np.diag([1.0, -2.0, 1.0, -3.0])
    with pytest.raises(np.linalg.LinAlgError):
        scoring.simplex_programme(lhs, np.array([0.3, 0.1, -0.2, 0.4]))


def test_discriminations_without_a_maximum_do_not_hold_up_a_pass(monkeypatch):
    """The picture puts all discriminations below zero, which they cannot reach: the scale and they would fall together for ever."""
    k, looks, local = 7, [], scoring.Picture._local
    s = scoring.Structure(scoring.BinaryCurves(), 2 * k, 1, stretch=True)
    s.groups = [scoring.Group("a", np.arange(0, 2 * k, 2), 1.0, stretches=False), scoring.Group("b", np.arange(1, 2 * k, 2), 5.0, centred=True),
                scoring.Group("means", np.array([2 * k]), 3.0)]
    psi, gradient = np.r_[np.tile([1.0, 0.0], k), 0.0], np.r_[np.tile([-1.5e6, 1e5], k), 1e5]
    picture = scoring.Picture(s, psi, gradient, -1e6 * np.eye(len(psi)), 0.0, 5.0)
    monkeypatch.setattr(scoring.Picture, "_local", lambda self, at: looks.append(1) or local(self, at))
    start = scoring.Place(np.zeros(s.parameters), np.zeros(0), [g.spread for g in s.groups], 0.0)
    at = picture.best(start)
    assert len(looks) < 1_000 and np.isfinite(at.phi).all() and (at.phi[: 2 * k : 2] < -2).all()


def test_pairs_of_answers_are_looked_at_once():
    """A pair of different answers stands for both orders; answers of one place are added up without pairs."""
    answers = scoring.Answers(np.array([0, 3, 5, 1, 2, 4]), np.ones(6), np.array([3, 0, 1, 2]))
    left, right = answers.pairs()
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 2), (4, 5)]


@pytest.mark.parametrize("answer_cost", [0, 1e9], ids=["answers", "matrices"])
def test_rows_at_the_places_of_people(answer_cost, monkeypatch):
    monkeypatch.setattr(scoring, "ANSWER_COST", answer_cost)
    monkeypatch.setattr(scoring, "CELLS_AT_ONCE", 30)
    rng = np.random.default_rng(4)
    dense, table = rng.integers(0, 3, (40, 6)).astype(float), rng.normal(size=(6, 5))
    dense[[0, 7, 39]] = 0
    assert np.allclose(compressed(dense).times(table), dense @ table)


@pytest.mark.parametrize("steep", [1.0, 8.0], ids=["products", "logarithms"])
@pytest.mark.parametrize("spread", [0.7, 0.0])
def test_slopes_with_a_grid_that_follows_people(spread, steep, monkeypatch):
    monkeypatch.setattr(scoring, "SMALLEST", 40.0)
    monkeypatch.setattr(scoring, "FOLLOWED_AT_ONCE", 500)
    rng, curves = np.random.default_rng(0), scoring.BinaryCurves()
    answers, x, weight = some_answers(rng, 50, 3, 2), rng.normal(size=(50, 2)), rng.integers(1, 4, 50).astype(float)
    answers[7] = 0
    sums = scoring.FollowingSums(3, curves, 2, len(NODE))

    def at(psi):
        total, flat = np.zeros(sums.size), np.zeros(sums.size)
        sums.add(total, compressed(answers), x, weight, psi, NODE)
        where, flat_values = sums.shipped(total)
        flat[where] = flat_values
        return sums.evidence(flat, psi, NODE)

    psi = np.r_[1.2 * steep, -0.3, 0.8 * steep, 0.4, 0.6 * steep, 0.1, 0.3, -0.4, spread]
    value, gradient, curvature = at(psi)
    assert np.allclose(differences(lambda p: at(p)[0], psi), gradient, atol=1e-6)
    assert np.allclose(differences(lambda p: at(p)[1], psi), curvature, atol=1e-5)
    if spread and steep == 1:  # the grid of all people, in units of the spread, gives the same as long as nobody comes near its ends
        units = np.r_[psi[:6] * np.tile([spread, 1], 3), psi[6:8] / spread]
        assert evidence(curves, 3, answers, x, weight, np.linspace(-12, 12, 161))(units)[0] == pytest.approx(value, abs=1e-6)
    elif not spread:
        assert gradient[-1] == pytest.approx(0, abs=1e-9) and at(psi + 1e-3 * (np.arange(9) == 8))[0] == pytest.approx(at(psi - 1e-3 * (np.arange(9) == 8))[0])


def test_coefficients_in_the_unit_of_a_pass():
    rng, z, unit = np.random.default_rng(1), np.array([0.5, 0.3, 0.2]), 0.3
    s = scoring.Structure(scoring.BinaryCurves(), 8, 3, 3, 2, True, spread=True, cells=8 + np.arange(3))
    phi, pull = rng.normal(size=s.parameters) * 0.5, rng.normal(size=s.coefficients)
    psi, _ = s.to_coefficients(phi, z, unit)
    assert s.unit(psi) == pytest.approx(unit) and psi[8:11].mean() == pytest.approx(0, abs=1e-12) and s.parameters == 15 and s.coefficients == 18
    for u in (unit, None):
        slopes = s.to_coefficients(phi, z, u)[1]
        assert np.allclose(differences(lambda p, u=u: s.to_coefficients(p, z, u)[0], phi).T, slopes, atol=1e-8)
        assert np.allclose(differences(lambda p, u=u: s.to_coefficients(p, z, u)[1].T @ pull, phi), s.bend(phi, pull, z, u), atol=1e-8)
    assert np.allclose(psi - s.to_steps(phi, unit) @ z, np.where(np.isin(np.arange(18), np.arange(11, 17)), 0, psi))
    # Neither the unit nor the origin of the latent outcome changes what a pass sees.
    other = phi.copy()
    other[0:8:2] -= 0.7
    other[1:8:2], other[8:] = (other[1:8:2] - 0.4) * np.exp(0.7), other[8:] * np.exp(0.7)
    other[8:11] += 0.4 * np.exp(0.7)
    assert np.allclose(s.to_coefficients(other, z, unit)[0], psi)


@pytest.mark.parametrize("theta", [0.0, 0.5])
def test_effects_settle_whatever_the_latent_spread(spark, theta):
    """Effects many latent spreads apart: shares by cell are the fitted ones, and a latent spread of nothing is a result."""
    rng = np.random.default_rng(11)
    n, k, delta, slope = 12_000, 7, np.array([-0.9, 0.1, 0.8]), 0.5
    cell, x, a, b = rng.integers(0, 3, n), rng.normal(size=n), np.exp(rng.normal(size=k) * 0.2), rng.normal(size=k) * 0.5
    eta = theta * rng.normal(size=n) + delta[cell] + slope * x
    y = (rng.random((n, k)) < 1 / (1 + np.exp(-a * (eta[:, None] + b)))).astype(int)
    fit = calibrate.calibrate_2pl(long_table(spark, y, kk=cell, x=x), "id", "item", "y", cell="kk", covariates=["x"], estimate_sigma=True, max_iter=40)
    terms, errors = ({r.term: r[i] for r in fit.effects.collect()} for i in (1, 2))
    items = fit.items.orderBy("item").toPandas()
    unit = np.exp(np.log(items.alpha / a).mean())  # the likelihood leaves it open
    assert fit.iterations <= 20
    assert np.abs(items.alpha / unit - a).max() < 0.1
    assert terms["b_x"] * unit == pytest.approx(slope, abs=0.03)
    for c in (1, 2):
        assert (terms[f"delta[{c}]"] - terms["delta[0]"]) * unit == pytest.approx(delta[c] - delta[0], abs=0.06)
    if theta:
        assert terms["sigma_theta"] * unit == pytest.approx(theta, abs=0.05) and 0.005 < errors["sigma_theta"] < 1
    else:
        assert terms["sigma_theta"] * unit < 0.15
    assert (terms["sigma_theta"] == 0) == (errors["sigma_theta"] is None)
    assert all(0 < errors[t] < 3 for t in ("delta[0]", "b_x"))


def test_a_spread_as_coefficient_agrees_with_parameters_in_its_units():
    """Estimates and standard errors, with a monotonic effect that differs by cell; the grid of all people is wide enough to hold them."""
    answers, x, _ = monotonic_people(np.random.default_rng(2))
    k, cells, levels, curves, wide = 6, 3, 3, scoring.BinaryCurves(), np.linspace(-9, 9, 91)
    fits = []
    for follow in (False, True):
        s = scoring.Structure(curves, 2 * k, cells, levels, cells, True, stretch=not follow, spread=follow, cells=2 * k + np.arange(cells))
        s.groups = [scoring.Group("a", np.arange(0, 2 * k, 2), 0.7, stretches=False), scoring.Group("b", np.arange(1, 2 * k, 2), 2.0, centred=True),
                    scoring.Group("d", 2 * k + np.arange(cells), 1.5), scoring.Group("s", s.slope_at + 1 + np.arange(cells), 0.8),
                    scoring.Group("m", np.array([s.slope_at]), 1.0)]
        sums = scoring.FollowingSums(k, curves, x.shape[1], 41)

        def following(psi, sums=sums):
            total, flat = np.zeros(sums.size), np.zeros(sums.size)
            sums.add(total, compressed(answers), x, np.ones(len(x)), psi, NODE)
            where, values = sums.shipped(total)
            flat[where] = values
            return sums.evidence(flat, psi, NODE)

        at, start = evidence(curves, k, answers, x, np.ones(len(x)), wide), np.zeros(s.parameters)
        start[s.parameters - follow :] = 1
        fits.append(scoring.maximise(following if follow else at, s, start, 1e-8, 60, lambda p: (p[: 2 * k : 2] > 0).all()))
    units, own = fits
    n, spread = len(units.at.phi), np.exp(units.at.scale)
    phi = np.where(np.isin(np.arange(n), np.arange(0, 2 * k, 2)), units.at.phi - units.at.scale, units.at.phi * spread)
    assert np.allclose(own.at.phi, np.r_[phi, spread], atol=1e-5) and np.allclose(own.at.z, units.at.z, atol=1e-5) and own.passes <= 20
    errors = [np.sqrt(np.diag(f.cov)) for f in fits]
    assert np.allclose(errors[1][:n], errors[0][:n], rtol=1e-4) and errors[1][n] == pytest.approx(spread * errors[0][n], rel=1e-4)
    assert np.allclose(errors[1][n + 2 :], errors[0][n + 1 :], rtol=1e-4)
