"""Measurement models with missing answers: loadings, factor scores, fit and reliability.

Full-information maximum likelihood needs the data only through, per pattern of missing answers,
the number of people, the means and the scatter of the observed answers. Spark reduces the people
to that table when a sketch shows that its numbers fit the driver (``DRIVER_CELLS``), whatever the
number of items, and the iterations run on it. With many patterns the people stay distributed and
every iteration is a Spark job that groups them by pattern inside each batch; only sums of the size items x items
or parameters x parameters reach the driver. Both ways give the same estimates.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage, ship_by_value
from .fixed_point import NotSettled, settle

ship_by_value(__name__)

DRIVER_CELLS = 4_000_000  # numbers the driver may hold; above it, iterations run as Spark jobs
_CHUNK = 1_024           # patterns handled at once, which bounds the memory of a task
_CELLS = 1 << 21         # numbers held at once of the patterns' curvatures
LEAST_UNIQUE = 1e-6      # part of an item's variance that is its own at least


def _answers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Items as doubles ``_x0 ..`` with the pattern of answered items; people without answers left out."""
    x = [F.col(c).cast("double") for c in cols]
    pattern = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in x])
    rows = df.select(pattern.alias("pattern"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    return rows.filter(F.col("pattern").contains("1"))


def pattern_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pattern of answered items: people ``n``, ``mean`` and ``cov`` (upper triangle, population)."""
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    return _answers(df, cols).groupBy("pattern").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.avg(f"_x{i}") for i in range(p)]).alias("mean"),
        F.array(*[F.covar_pop(f"_x{i}", f"_x{j}") for i, j in pairs]).alias("cov"),
    )


class Patterns:
    """Sufficient statistics of the answers: local when patterns are few, distributed otherwise."""

    def __init__(self, df: DataFrame, cols: Sequence[str], cells: int = DRIVER_CELLS) -> None:
        self.cols = list(cols)
        self.size = len(self.cols)
        self.local = self.rows = None
        answers = _answers(df, self.cols)
        kinds, *centre = answers.agg(
            F.approx_count_distinct("pattern"), *[F.avg(f"_x{i}") for i in range(self.size)]).first()
        # A pattern is one count, the means and the scatter of the items; the sketch may be off by a few percent.
        if 1.2 * kinds * (1 + self.size) * (2 + self.size) / 2 > cells:
            self.rows = cut_lineage(answers.drop("pattern")).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.local = _summed_patterns(answers.drop("pattern"), np.array(centre, dtype=float))

    def release(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()

    def total(self, statistic) -> np.ndarray:
        """Sum over all patterns; ``statistic(n, seen, mean, cov)`` sums over a stack of them."""
        if self.local is not None:
            return _in_chunks(statistic, self.local)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = _in_chunks(statistic, _group_batch(batch))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        parts = self.rows.mapInArrow(partial, "at long, v double")
        rows = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted(map(tuple, rows))])


def _summed_patterns(answers: DataFrame, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of few patterns over many items: tasks send sums around a common centre."""
    p = len(centre)
    upper = np.triu_indices(p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for n, seen, mean, cov in zip(*_group_batch(batch), strict=True):
                off = (mean - centre) * seen
                key = "".join("1" if s else "0" for s in seen)
                part = np.concatenate([[n], n * off, n * (cov + np.outer(off, off))[upper]])
                sums[key] = sums[key] + part if key in sums else part
        for key, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(part)), pa.array(np.arange(len(part))), pa.array(part)], names=["pattern", "at", "v"])

    parts = answers.mapInArrow(partial, "pattern string, at long, v double")
    flat = parts.groupBy("pattern", "at").agg(F.sum("v").alias("v")).toPandas()
    table = flat.pivot(index="pattern", columns="at", values="v")
    values = table.to_numpy()
    n, seen = values[:, 0], np.array([[c == "1" for c in k] for k in table.index], dtype=float).reshape(-1, p)
    off = values[:, 1 : p + 1] / n[:, None]
    cov = np.zeros((len(n), p, p))
    cov[:, upper[0], upper[1]] = cov[:, upper[1], upper[0]] = values[:, p + 1 :] / n[:, None]
    return n, seen, (off + centre) * seen, cov - off[:, :, None] * off[:, None, :]


def _in_chunks(statistic, stack: tuple[np.ndarray, ...]) -> np.ndarray:
    total = 0.0
    for start in range(0, len(stack[0]), _CHUNK):
        total = total + np.asarray(statistic(*[part[start : start + _CHUNK] for part in stack]))
    return np.asarray(total)


def _group_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """People of a batch reduced to their patterns."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
    seen = ~np.isnan(x)
    kinds, which = np.unique(seen, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    groups = np.split(np.nan_to_num(x)[order], np.cumsum(np.bincount(which.ravel()))[:-1])
    mean = np.stack([g.mean(0) for g in groups])
    cov = np.zeros((len(groups), x.shape[1], x.shape[1]))
    for k, g in enumerate(groups):
        if len(g) > 1:
            cov[k] = (g - mean[k]).T @ (g - mean[k]) / len(g)
    return np.array([float(len(g)) for g in groups]), kinds.astype(float), mean, cov


# -- maximum likelihood under a normal model -------------------------------------------------


def _observed_inverse(sigma: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of the observed block of every pattern, zero elsewhere, and its log-determinant."""
    both = seen[:, :, None] * seen[:, None, :]
    block = sigma * both + np.eye(seen.shape[1]) * (1 - seen)[:, :, None]
    return np.linalg.inv(block) * both, np.linalg.slogdet(block)[1]


def _log_lik(patterns: Patterns, mean: np.ndarray, sigma: np.ndarray) -> float:
    def statistic(n, seen, m, s):
        inv, logdet = _observed_inverse(sigma, seen)
        d = (m - mean) * seen
        quad = (inv * s).sum((1, 2)) + np.einsum("pi,pij,pj->p", d, inv, d)
        return np.array([-0.5 * (n * (seen.sum(1) * np.log(2 * np.pi) + logdet + quad)).sum()])

    return float(patterns.total(statistic)[0])


def _expected_moments(patterns: Patterns, mean: np.ndarray, joint: np.ndarray):
    """Expected first and second moments of answers and latents, people, and the log-likelihood.

    ``joint`` is the covariance of all answers followed by the latent variables, if any.
    """
    p, q = len(mean), joint.shape[0]
    mu = np.concatenate([mean, np.zeros(q - p)])

    def statistic(n, seen, m, s):
        inv, logdet = _observed_inverse(joint[:p, :p], seen)
        d = (m - mean) * seen
        quad = (inv * s).sum((1, 2)) + np.einsum("pi,pij,pj->p", d, inv, d)
        log_lik = -0.5 * (n * (seen.sum(1) * np.log(2 * np.pi) + logdet + quad)).sum()
        weights = joint[:, :p] @ inv
        value = mu + np.einsum("pij,pj->pi", weights, (m - mean) * seen)
        second = joint - weights @ joint[:p]
        if s.any():
            second = second + weights @ s @ weights.transpose(0, 2, 1)
        second = second + value[:, :, None] * value[:, None, :]
        return np.concatenate([n @ value, np.einsum("p,pij->ij", n, second).ravel(), [n.sum(), log_lik]])

    out = patterns.total(statistic)
    n, log_lik, second = out[-2], float(out[-1]), out[q:-2].reshape(q, q)
    # Rounding must not make the moments asymmetric: iterations would amplify it.
    return out[:q] / n, (second + second.T) / (2 * n), n, log_lik


class FactorFit(NamedTuple):
    """Estimates of a measurement model; factors have unit variance and may correlate."""

    items: list[str]
    factors: list[str]
    intercepts: np.ndarray
    loadings: np.ndarray
    uniquenesses: np.ndarray
    phi: np.ndarray
    log_lik: float
    n: float
    converged: bool = True

    @property
    def sigma(self) -> np.ndarray:
        return self.loadings @ self.phi @ self.loadings.T + np.diag(self.uniquenesses)


def _observed_moments(patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of every item over the people who answered it."""
    p = patterns.size

    def statistic(n, seen, m, s):
        squares = (np.diagonal(s, axis1=1, axis2=2) + m**2) * seen
        return np.concatenate([n @ seen, n @ (m * seen), n @ squares])

    n, first, second = patterns.total(statistic).reshape(3, p)
    mean = first / n
    return mean, np.maximum(second / n - mean**2, 1e-8)


def _correlations(angles: np.ndarray, q: int) -> np.ndarray:
    """Correlations from the angles of their triangular root, which reach the border of the valid range and stay smooth there."""
    root = np.zeros((q, q), angles.dtype)
    turns = iter(angles)
    for j in range(q):
        left = 1.0
        for k in range(j):
            turn = next(turns)
            root[j, k], left = left * np.cos(turn), left * np.sin(turn)
        root[j, j] = left
    return root @ root.T


def _likelihood(patterns: Patterns, mean: np.ndarray, load: np.ndarray, unique: np.ndarray, phi: np.ndarray, loads: np.ndarray):
    """Log-likelihood in one pass, with its gradient and curvature in means, free loadings, uniquenesses and correlations."""
    p, q = load.shape
    item, factor = np.nonzero(loads)
    one, other = np.triu_indices(q, 1)
    cross, sigma = load @ phi, load @ phi @ load.T + np.diag(unique)
    # Every parameter moves sigma along ``scale * (x y' + y x')``, with x and y among the columns of ``basis``.
    basis = np.hstack([np.eye(p), cross, load])
    x, y = np.r_[item, np.arange(p), p + q + one], np.r_[p + factor, np.arange(p), p + q + other]
    scale = np.r_[np.ones(len(item)), np.full(p, 0.5), np.ones(len(one))]
    k = len(x)

    def statistic(n, seen, m, s):
        inv, logdet = _observed_inverse(sigma, seen)
        d = (m - mean) * seen
        w = np.einsum("pij,pj->pi", inv, d)
        quad = (inv * s).sum((1, 2)) + (d * w).sum(1)
        value = -0.5 * (n * (seen.sum(1) * np.log(2 * np.pi) + logdet + quad)).sum()
        spread = inv @ s @ inv + w[:, :, None] * w[:, None, :]
        pull = 0.5 * np.einsum("p,pij->ij", n, spread - inv)
        side, along = inv @ basis, w @ basis
        left, right = basis.T @ side, n[:, None, None] * (basis.T @ (0.5 * inv - spread) @ basis)
        met, bend = (n[:, None] * along), np.zeros((k, k))
        for at in range(0, len(n), size := max(_CELLS // k**2, 1)):
            a, b = left[at : at + size], right[at : at + size]
            for u, v in ((x, y), (y, x)):
                for i, j in ((x, y), (y, x)):
                    bend += np.einsum("pab,pba->ab", a[:, v[:, None], i[None, :]], b[:, j[:, None], u[None, :]])
        mixed = np.stack([np.einsum("pi,p->i", side[:, :, i], met[:, j]) + np.einsum("pi,p->i", side[:, :, j], met[:, i])
                          for i, j in zip(x, y, strict=True)], axis=1)
        return np.concatenate([[value], n @ w, pull.ravel(), np.einsum("p,pij->ij", n, inv).ravel(), mixed.ravel(), bend.ravel()])

    value, g_mean, pull, weight, mixed, bend = np.split(patterns.total(statistic), np.cumsum([1, p, p * p, p * p, p * k]))
    pull, weight, mixed, bend = pull.reshape(p, p), weight.reshape(p, p), mixed.reshape(p, k) * scale, bend.reshape(k, k) * np.outer(scale, scale)
    pull = 0.5 * (pull + pull.T)
    gradient = np.r_[g_mean, 2 * scale * (basis.T @ pull @ basis)[x, y]]
    # Loadings meet each other and the correlations in products, so the gradient enters the curvature.
    flat, own = len(item), pull @ load
    bend[:flat, :flat] += 2 * phi[np.ix_(factor, factor)] * pull[np.ix_(item, item)]
    meet = 2 * (own[np.ix_(item, one)] * (factor[:, None] == other) + own[np.ix_(item, other)] * (factor[:, None] == one))
    bend[:flat, flat + p :] += meet
    bend[flat + p :, :flat] += meet.T
    curvature = np.block([[-weight, -mixed], [-mixed.T, bend]])
    return float(value[0]), gradient, 0.5 * (curvature + curvature.T)


def fit_factors(patterns: Patterns, model: Mapping[str, Sequence[str]], max_iter: int = 5_000,
                tol: float = 1e-7) -> FactorFit:
    """Maximum-likelihood loadings; every item loads on the factors that name it.

    Newton steps on standardised items, one pass each, until none moves a parameter by more than ``tol`` or its gain is lost
    in rounding; raises otherwise. Uniquenesses are squares above ``LEAST_UNIQUE`` of the variance and correlations cosines, so that a
    maximum on the border of the valid range, as weakly related items have it, is reached like any other.
    """
    items, factors = patterns.cols, list(model)
    p, q = len(items), len(factors)
    loads = np.array([[i in model[f] for f in factors] for i in items])
    centre, var = _observed_moments(patterns)
    unit = np.sqrt(var)
    pairs = np.triu_indices(q, 1)
    n_loads, n_pairs = int(loads.sum()), q * (q - 1) // 2
    item = np.nonzero(loads)[0]

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mean, flat, root, angles = np.split(x, [p, p + n_loads, 2 * p + n_loads])
        load = np.zeros((p, q))
        load[loads] = flat
        return centre + mean * unit, load * unit[:, None], (LEAST_UNIQUE + root**2) * var, _correlations(angles, q)

    def turned(angles: np.ndarray) -> np.ndarray:
        """Slopes of the correlations in the angles, by complex steps."""
        steps = [_correlations(angles + 1e-30j * e, q)[pairs].imag / 1e-30 for e in np.eye(n_pairs)]
        return np.array(steps).reshape(n_pairs, n_pairs).T

    def look(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, curvature = _likelihood(patterns, *unpack(x), loads)
        roots, at = np.arange(p + n_loads, 2 * p + n_loads), 2 * p + n_loads
        slopes = np.diag(np.r_[unit, unit[item], 2 * x[roots] * var, np.zeros(n_pairs)])
        slopes[at:, at:] = turned(x[at:])
        bend = slopes.T @ curvature @ slopes
        bend[roots, roots] += 2 * gradient[roots] * var
        for j, e in enumerate(np.eye(n_pairs)):
            bend[at:, at + j] += (turned(x[at:] + 1e-5 * e) - turned(x[at:] - 1e-5 * e)).T @ gradient[at:] / 2e-5
        return value, slopes.T @ gradient, 0.5 * (bend + bend.T)

    x = np.concatenate([np.zeros(p), np.full(n_loads, np.sqrt(0.5)), np.full(p, np.sqrt(0.5)), np.full(n_pairs, np.pi / 2)])
    (value, gradient, bend), passes, reach = look(x), 1, 0.5
    while True:
        values, vectors = np.linalg.eigh(-bend)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-12 * np.abs(values).max()))
        gain, far = 0.5 * gradient @ step, np.abs(step).max()
        if far <= tol or gain <= 1e-15 * abs(value):
            if values[0] > -1e-6 * values[-1]:
                break
            step, far = vectors[:, 0], 1.0  # a saddle: leave it where the likelihood bends upwards
        step = step * min(1.0, reach / far)
        while True:
            if passes >= max_iter:
                raise NotSettled(f"loadings still move by {far:.2g} after {passes} passes")
            trial, passes = look(x + step), passes + 1
            if trial[0] >= value - 1e-13 * abs(value):
                break
            step, reach = step / 4, np.abs(step).max() / 4
        x, (value, gradient, bend), reach = x + step, trial, min(2 * reach, 0.5)
    mean, load, unique, phi = unpack(x)
    sign = np.where(load.sum(0) < 0, -1.0, 1.0)
    load, phi = load * sign, phi * np.outer(sign, sign)
    sigma = load @ phi @ load.T + np.diag(unique)
    *_, n, log_lik = _expected_moments(patterns, mean, sigma)
    return FactorFit(items, factors, mean, load, unique, phi, log_lik, n)


def _saturated_log_lik(patterns: Patterns, max_iter: int = 5_000, tol: float = 1e-8) -> float:
    centre, var = _observed_moments(patterns)
    p, unit = len(centre), np.sqrt(var)
    at = np.triu_indices(p)

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sigma = np.zeros((p, p))
        sigma[at] = x[p:]
        return centre + x[:p] * unit, (sigma + np.triu(sigma, 1).T) * np.outer(unit, unit)

    def step(x: np.ndarray) -> tuple[np.ndarray, float]:
        mean, sigma = unpack(x)
        first, second, _, log_lik = _expected_moments(patterns, mean, sigma)
        new = second - np.outer(first, first)
        return np.concatenate([(first - centre) / unit, (new / np.outer(unit, unit))[at]]), log_lik

    start = np.concatenate([np.zeros(p), np.eye(p)[at]])
    _, value, _ = settle(step, start, tol, max_iter, lambda x: bool(np.linalg.eigvalsh(unpack(x)[1] / np.outer(unit, unit)).min() > 1e-9))
    return value


# -- public ----------------------------------------------------------------------------------


def _items_of(model: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(i for names in model.values() for i in names))


def fit_model(df: DataFrame, model: Mapping[str, Sequence[str]]) -> tuple[FactorFit, Patterns]:
    patterns = Patterns(df, _items_of(model))
    return fit_factors(patterns, model), patterns


def factor_scores(df: DataFrame, model: Mapping[str, Sequence[str]], fit: FactorFit | None = None) -> DataFrame:
    """Append regression factor scores; people with missing answers are scored from the rest.

    The weights depend on the missingness pattern only. They are computed in the tasks that meet
    a pattern, from the estimates, so there is no join and no limit on the number of patterns.
    People without any answer score null.
    """
    if fit is None:
        fit, patterns = fit_model(df, model)
        patterns.release()
    items, factors = fit.items, fit.factors
    sigma, cross = fit.sigma, fit.loadings @ fit.phi
    schema = T.StructType(df.schema.fields + [T.StructField(f, T.DoubleType()) for f in factors])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[bytes, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in items], axis=1)
            x = x - fit.intercepts
            out = np.full((len(x), len(factors)), np.nan)
            kinds, which = np.unique(~np.isnan(x), axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                if kind.any():
                    w = weights.get(kind.tobytes())
                    if w is None:
                        w = weights[kind.tobytes()] = np.linalg.solve(sigma[np.ix_(kind, kind)], cross[kind])
                    rows = np.flatnonzero(which.ravel() == k)
                    out[rows] = x[np.ix_(rows, np.flatnonzero(kind))] @ w
            scores = [pa.array(out[:, j], from_pandas=True) for j in range(len(factors))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], names=[*batch.schema.names, *factors])

    return df.mapInArrow(score, schema)


def factor_loadings(spark: SparkSession, fit: FactorFit) -> DataFrame:
    rows = [(f, i, float(fit.loadings[a, b]), float(fit.uniquenesses[a]), float(fit.intercepts[a]))
            for a, i in enumerate(fit.items) for b, f in enumerate(fit.factors) if fit.loadings[a, b] != 0]
    return spark.createDataFrame(rows, "factor string, item string, loading double, uniqueness double, intercept double")


def factor_fit(df: DataFrame, model: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per factor with McDonald's omega, and the chi-square, CFI, TLI and RMSEA of the model."""
    fit, patterns = fit_model(df, model)
    p, q = len(fit.items), len(fit.factors)
    params = 2 * p + int((fit.loadings != 0).sum()) + q * (q - 1) // 2
    dof, base_dof = p * (p + 3) // 2 - params, p * (p - 1) // 2
    saturated = _saturated_log_lik(patterns)
    mean, var = _observed_moments(patterns)
    chi2 = max(2 * (saturated - fit.log_lik), 0.0)
    base = max(2 * (saturated - _log_lik(patterns, mean, np.diag(var))), 0.0)
    patterns.release()
    excess, base_excess = max(chi2 - dof, 0.0), max(base - base_dof, chi2 - dof, 0.0)
    cfi = 1.0 - excess / base_excess if base_excess > 0 else 1.0
    ratio = base / base_dof if base_dof else np.nan
    tli = (ratio - chi2 / dof) / (ratio - 1) if dof and ratio != 1 else np.nan
    rmsea = float(np.sqrt(excess / (dof * fit.n))) if dof else 0.0
    rows = []
    for j, name in enumerate(fit.factors):
        own = fit.loadings[:, j] != 0
        common = fit.loadings[own, j].sum() ** 2
        rows.append((name, float(common / (common + fit.uniquenesses[own].sum())), float(fit.n), float(chi2),
                     int(dof), float(cfi), float(tli), rmsea))
    return df.sparkSession.createDataFrame(
        rows, "factor string, omega double, n double, chi2 double, df int, cfi double, tli double, rmsea double")
