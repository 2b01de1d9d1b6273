"""Item-response calibration, and person scoring.

Estimates are posterior modes under the priors named below, not posterior draws. The heavy step of
each iteration, a sum over all people, runs in Spark tasks; only sums reach the driver.
``method="scoring"`` takes second-order steps (see ``scoring``), needs few passes and gives standard
errors; its sums have the size parameters x parameters. ``method="em"`` is for wide banks: its sums have
the size items x nodes (and design x design), it needs more passes and gives no standard errors.

People are stored once with their answers as short lists, in blocks that tasks read without
conversion, so that an iteration is a narrow pass plus one small sum. People with the same answers and design count once, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.irt import inv_logit
from ..functions.scalar import case_when
from ..session import cut_lineage, ship_by_value
from .fixed_point import settle
from .graded import thresholds
from .scoring import (LEAST_SPREAD, PARAMETERS, Answers, BinaryCurves, Estimate, FollowingSums, GradedCurves, Group, Structure, Sums,
                      maximise, sigmoid as _sigmoid, softmax as _softmax)
from .shape import literal_table, lookup, seq

ship_by_value(__name__)

Batches = Iterator[pa.RecordBatch]
NUMBERS_AT_ONCE = 1 << 18  # answers and design values of people that are kept and added up together


class Calibration(NamedTuple):
    """Item table, effects on the latent outcome (or None), log-likelihood, passes over the data used.

    A calibration that has not converged is never returned: it raises.
    """

    items: DataFrame
    effects: DataFrame | None
    log_lik: float
    iterations: int
    converged: bool = True


# -- layout ----------------------------------------------------------------------------------


def answer_cells(responses: DataFrame, person: str, item: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (person, item, y, number of answers) with the person-level columns ``keep``."""
    return responses.groupBy(person, item, y).agg(
        F.count(F.lit(1)).cast("float").alias("_n"), *[F.first(c).alias(c) for c in keep])


def _known_levels(df: DataFrame, given: Sequence[tuple]) -> list[list]:
    """Levels of questionnaire dimensions (items, cells), whose size does not grow with people: as given, else found in one pass;
    empty for a column that is not used."""
    unknown = [c for c, levels in given if c is not None and levels is None]
    found = df.agg(*[F.collect_set(c) for c in unknown]).first() if unknown else []
    known = {c: sorted(levels) for c, levels in zip(unknown, found, strict=True)}
    return [[] if c is None else list(known[c] if levels is None else levels) for c, levels in given]


def person_layout(
    responses: DataFrame, person: str, item: str, y: str, items: Sequence, categories: Sequence[int],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per person: ``counts``, a sorted list of (place, number), and person-level columns.

    A place is an item and category of the questionnaire. Repeated answers add up first, in a
    partial aggregation by person, item and answer, so the list never exceeds the questionnaire, however
    many rows a person has.
    """
    return _lists(answer_cells(responses, person, item, y, keep), person, item, y, items, categories, keep)


def _lists(cells: DataFrame, person: str, item: str, y: str, items: Sequence, categories: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    # The item list is held by the driver, one row per questionnaire item: safe to broadcast.
    bank = literal_table(cells.sparkSession, ["_item", "_i"], [(v, i) for i, v in enumerate(items)])
    rows = cells.filter(F.col(y).isin(*categories)).join(F.broadcast(bank), F.col(item) == F.col("_item"))
    place = F.col("_i") * len(categories) + (F.col(y) - min(categories)).cast("int")
    return rows.groupBy(person).agg(
        F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col("_n").alias("n")))).alias("counts"),
        *[F.first(c).alias(c) for c in keep])


def _distinct_people(people: DataFrame) -> DataFrame:
    """People with the same answers and design count once, with a weight, spread over all shuffle partitions.

    A pass is arithmetic, so small tables are spread as well.
    """
    parts = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(people.repartition(parts, "counts", "x").groupBy("counts", "x").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def _packed(people: DataFrame) -> DataFrame:
    """Blocks of people as one binary value each, so that a pass need not turn rows into Arrow batches again."""
    def pack(batches: Batches) -> Batches:
        for block in _larger(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    return people.select("counts", "x", "weight").mapInArrow(pack, "block binary").persist(StorageLevel.MEMORY_AND_DISK)


def _unpacked(batches: Batches) -> Batches:
    for batch in batches:
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())


def _larger(batches: Batches) -> Batches:
    """Batches put together as long as they hold no more than ``NUMBERS_AT_ONCE`` numbers."""
    held: list[pa.RecordBatch] = []
    numbers = 0
    for batch in batches:
        size = len(batch.column("counts").flatten()) + len(batch.column("x").flatten())
        if held and numbers + size > NUMBERS_AT_ONCE:
            yield pa.concat_batches(held)
            held, numbers = [], 0
        held.append(batch)
        numbers += size
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def _sum_over_people(people: DataFrame, statistics) -> np.ndarray:
    """Sum a vector-valued statistic over all people; every task sends one partial vector."""
    def partial(batches: Batches) -> Batches:
        total = None
        for batch in _unpacked(batches):
            part = statistics(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    parts = people.mapInArrow(partial, "at int, v double")
    rows = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([v for _, v in sorted(map(tuple, rows))])


def _evidence(people: DataFrame, sums: Sums, node: np.ndarray, psi: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of all people, its gradient and its curvature."""
    def partial(batches: Batches) -> Batches:
        total = np.zeros(sums.size)
        first = sums.first(psi, node)
        for batch in _unpacked(batches):
            x, weight = _matrix(batch.column("x"), sums.width), batch.column("weight").to_numpy()
            sums.add(total, Answers.of(batch.column("counts")), x, weight, psi, node, first)
        at, values = sums.shipped(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values)], names=["at", "v"])

    parts = people.mapInArrow(partial, "at long, v double")
    table = parts.groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(sums.size)
    flat[table.column("at").to_numpy()] = table.column("v").to_numpy()
    return sums.evidence(flat, psi, node)


def _e_step(people: DataFrame, log_p: np.ndarray, nodes: np.ndarray, gamma: np.ndarray, sigma: float):
    """Expected counts (items x categories x nodes), design sums and log-likelihood."""
    rows, width = log_p.shape[0], len(gamma)

    def statistics(batch: pa.RecordBatch) -> np.ndarray:
        answers, x = Answers.of(batch.column("counts")), _matrix(batch.column("x"), width)
        prior = -0.5 * ((nodes[None, :] - (x @ gamma)[:, None]) / sigma) ** 2
        prior -= _softmax(prior)[1][:, None]
        post, norm = _softmax(answers.times(log_p) + prior)
        weight = batch.column("weight").to_numpy()
        post = post * weight[:, None]
        return np.concatenate([
            answers.spread_over(post, rows).ravel(), (x.T @ (x * weight[:, None])).ravel(), x.T @ (post @ nodes),
            [(post @ nodes**2).sum(), weight.sum(), norm @ weight],
        ])

    out = _sum_over_people(people, statistics)
    expected, out = out[: rows * len(nodes)].reshape(rows, len(nodes)), out[rows * len(nodes):]
    xtx, out = out[: width * width].reshape(width, width), out[width * width:]
    return expected, xtx, out[:width], out[width], out[width + 1], out[width + 2]


# -- binary items ----------------------------------------------------------------------------


def _fit_binary(wrong: np.ndarray, right: np.ndarray, nodes: np.ndarray, log_a: np.ndarray, b: np.ndarray,
                prior_a: float, prior_b: float, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Penalised logistic fits of all items at once: logit = exp(log_a) * (node + b)."""
    n = wrong + right
    mean_b = b.mean()
    for _ in range(steps):
        a = np.exp(log_a)
        dist = nodes[None, :] + b[:, None]
        p = _sigmoid(a[:, None] * dist)
        resid, weight = right - n * p, n * p * (1 - p)
        da, db = a[:, None] * dist, np.broadcast_to(a[:, None], p.shape)
        grad = np.stack([(resid * da).sum(1) - log_a / prior_a**2,
                         (resid * db).sum(1) - (b - mean_b) / prior_b**2], axis=1)
        info = np.stack([
            np.stack([(weight * da * da).sum(1) + 1 / prior_a**2, (weight * da * db).sum(1)], axis=1),
            np.stack([(weight * da * db).sum(1), (weight * db * db).sum(1) + 1 / prior_b**2], axis=1),
        ], axis=1)
        step = np.clip(np.linalg.solve(info, grad[:, :, None])[:, :, 0], -1.0, 1.0)
        log_a, b = log_a + step[:, 0], b + step[:, 1]
    return log_a, b


def _stretch(log_a: np.ndarray, pull: float, prior_a: float) -> float:
    """Logarithm of the factor on the latent scale that the priors like best."""
    t = 0.0
    for _ in range(50):
        grad = (t - log_a).sum() / prior_a**2 + np.exp(2 * t) * pull
        step = grad / (len(log_a) / prior_a**2 + 2 * np.exp(2 * t) * pull)
        t -= step
        if abs(step) < 1e-12:
            break
    return float(t)


def _item_table(spark, item_ids: Sequence, kind: str, alpha: np.ndarray, betas: dict[str, np.ndarray],
                errors: dict[str, np.ndarray] | None) -> DataFrame:
    """Items with their estimates and standard errors, which are null where there are none."""
    names = ["alpha", *betas]
    errors = errors or {n: [None] * len(item_ids) for n in names}
    cell = lambda v: None if v is None else float(v)
    rows = zip(item_ids, alpha, *betas.values(), *[errors[n] for n in names], strict=True)
    schema = ", ".join([f"item {kind}", *[f"{n} double" for n in names], *[f"se_{n} double" for n in names]])
    return spark.createDataFrame([(r[0], *map(cell, r[1:])) for r in rows], schema)


def _errors(cov: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(cov), 0.0))


def calibrate_2pl(
    responses: DataFrame,
    person: str,
    item: str,
    y: str,
    cell: str | None = None,
    covariates: Sequence[str] = (),
    ordinal: str | None = None,
    slopes_by_cell: bool = False,
    slope_groups: Mapping | None = None,
    hierarchical: bool = False,
    sign: int = 1,
    estimate_sigma: bool = False,
    nodes: int = 41,
    reach: float = 6.0,
    max_iter: int = 1_000,
    tol: float = 1e-6,
    prior_log_alpha: float = 1.0,
    prior_beta: float = 5.0,
    prior_effect: float = 3.0,
    items_are: Sequence | None = None,
    cells_are: Sequence | None = None,
    method: str = "scoring",
) -> Calibration:
    """Two-parameter calibration with condition effects and covariate slopes on the latent outcome.

    Model: ``P(y = 1) = inv_logit(alpha * (eta + sign * beta))`` with
    ``eta = theta + delta[cell] + sum(slope * covariate)`` and ``theta ~ N(0, 1)`` (or
    ``N(0, sigma)``). Priors: ``log alpha ~ N(0, prior_log_alpha)``, ``beta`` around its own mean
    with SD ``prior_beta``, effects ``~ N(0, prior_effect)``. People with a missing covariate are left out.

    ``slopes_by_cell`` adds a deviation of every slope per cell, ``b_<name>[cell]``. ``slope_groups`` names a group for every
    cell; the slopes of the cells of a group then vary around a mean of their own, ``b_<name>_<group>``,
    instead of ``b_<name>``.

    ``ordinal`` names a predictor with a monotonic effect: ``b_<name>`` is its mean step, ``z_<name>[i]`` is
    each step's share of the whole effect, ``step[level]`` the steps themselves. With ``slopes_by_cell``
    the cells share the shares, but each has its own deviation from the mean step, which may turn the effect around.

    ``hierarchical`` estimates the spreads of cell effects and of slope deviations instead of taking
    ``prior_effect``: two-level shrinkage, with half-Cauchy(5) priors on the spreads (``sd_...``).

    ``estimate_sigma`` estimates ``sigma`` (``sigma_theta``). Without spread left among people of equal design it is zero, without standard error.

    ``items_are`` and ``cells_are`` list the items and cells of the study; without them one pass
    over the responses finds them. ``method="em"`` knows items, cell effects and linear slopes, and gives no
    standard errors; ``method="scoring"`` raises beyond ``scoring.PARAMETERS`` parameters.
    """
    if method not in ("scoring", "em"):
        raise ValueError(f"no such method: {method}")
    if method == "em" and (ordinal or hierarchical):
        raise ValueError("monotonic effects and estimated spreads need method='scoring'")
    if estimate_sigma and hierarchical:
        raise ValueError("the spread of theta and those of the effects are not determined together")
    person_cols = [*([cell] if cell else []), *covariates, *([ordinal] if ordinal else [])]
    used = responses.dropna(subset=[person, item, y, *person_cols])
    # A column that is person-level twice over is kept once.
    answers = answer_cells(used, person, item, y, list(dict.fromkeys(person_cols)))
    item_ids, cells, grades = _known_levels(answers, [(item, items_are), (cell, cells_are), (ordinal, None)])
    by_cell = bool(cells) and (slopes_by_cell or slope_groups is not None)
    if slope_groups is not None and (missing := [c for c in cells if c not in slope_groups]):
        raise ValueError(f"cells without a group of slopes: {missing}")
    kinds = sorted({slope_groups[c] for c in cells}) if slope_groups is not None else []

    def within(col: str, among: Sequence) -> Column:
        return F.when(F.col(cell).isin(list(among)), F.col(col).cast("double")).otherwise(0.0)

    design: dict[str, Column] = {f"delta[{c}]": (F.col(cell) == F.lit(c)).cast("double") for c in cells}
    families = {"delta": list(design)} if cells else {}
    for v in covariates:
        if kinds:
            design |= {f"b_{v}_{g}": within(v, [c for c in cells if slope_groups[c] == g]) for g in kinds}
        else:
            design[f"b_{v}"] = F.col(v).cast("double")
        if by_cell:
            families[f"b_{v}"] = [f"b_{v}[{c}]" for c in cells]
            design |= {f"b_{v}[{c}]": within(v, [c]) for c in cells}
    plain = list(design)
    step_cells = cells if ordinal and by_cell else [None]
    for c in step_cells:
        for x in grades[1:]:
            above = F.col(ordinal) >= F.lit(x)
            design[f"{c}:{x}"] = (above if c is None else above & (F.col(cell) == F.lit(c))).cast("double")
    vector = F.array(*[c.cast("double") for c in design.values()]) if design else F.array().cast("array<double>")
    layout = _lists(answers, person, item, y, item_ids, (0, 1), person_cols)
    people = _packed(_distinct_people(layout.select("counts", vector.alias("x"))))
    node = np.linspace(-reach, reach, nodes)
    spark, kind = responses.sparkSession, dict(used.dtypes)[item]
    try:
        if method == "em":
            log_a, b, gamma, sigma, log_lik, done = _em_2pl(
                people, len(item_ids), len(cells), len(design), node, estimate_sigma, prior_log_alpha, prior_beta, prior_effect, tol, max_iter)
            items = _item_table(spark, item_ids, kind, np.exp(log_a), {"beta": sign * b}, None)
            terms = [(t, float(g), None) for t, g in zip(design, gamma, strict=True)] + [("sigma_theta", sigma, None)]
            return Calibration(items, spark.createDataFrame(terms, "term string, estimate double, se double"), log_lik, done)
        k, levels = len(item_ids), len(grades) - 1 if ordinal else 0
        curves = BinaryCurves()
        s = Structure(curves, 2 * k, len(plain), max(levels, 0), len(step_cells), by_cell and levels > 0, spread=estimate_sigma)
        if s.parameters > PARAMETERS:
            raise ValueError(f"{s.parameters} parameters are too many for method='scoring'; use method='em'")
        place = {t: 2 * k + i for i, t in enumerate(plain)}
        s.cells = np.array([place[t] for t in families.get("delta", [])], int)
        start_spread = (lambda prior: 1.0) if hierarchical else (lambda prior: prior)
        s.groups = [Group("sd_log_alpha", np.arange(0, 2 * k, 2), prior_log_alpha, stretches=False),
                    Group("sd_beta", np.arange(1, 2 * k, 2), prior_beta, centred=True)]
        for name, members in families.items():
            s.groups.append(Group(f"sd_{name}", np.array([place[t] for t in members]), start_spread(prior_effect), hierarchical))
        loose = [place[t] for t in plain if not any(t in members for members in families.values())]
        if levels > 0:
            loose.append(s.slope_at)
            if s.deviations:
                s.groups.append(Group(f"sd_b_{ordinal}", s.slope_at + 1 + np.arange(len(step_cells)), start_spread(prior_effect), hierarchical))
        s.groups.append(Group("means", np.array(loose, int), prior_effect))
        sums = (FollowingSums if estimate_sigma else Sums)(k, curves, len(design), nodes)
        start = np.zeros(s.parameters)
        start[s.parameters - s.spread :] = 1.0
        fit = maximise(lambda psi: _evidence(people, sums, node, psi), s, start, tol, max_iter,
                       lambda psi: curves.valid(psi[: 2 * k].reshape(k, 2)))
    finally:
        people.unpersist()
    sigma, errors = float(abs(fit.at.phi[-1])) if estimate_sigma else 1.0, _errors(fit.cov)
    if sigma < LEAST_SPREAD:  # on the border
        sigma = 0.0
    alpha, values = np.exp(fit.at.phi[0 : 2 * k : 2]), fit.at.phi
    items = _item_table(spark, item_ids, kind, alpha, {"beta": sign * values[1 : 2 * k : 2]},
                        {"alpha": alpha * errors[0 : 2 * k : 2], "beta": errors[1 : 2 * k : 2]})
    terms = [(t, values[i], errors[i]) for t, i in place.items()]
    terms.append(("sigma_theta", sigma, errors[s.parameters - 1] if estimate_sigma and sigma else None))
    if levels > 0:
        terms += _monotonic_terms(fit, s, ordinal, grades, step_cells)
    if hierarchical:
        terms += [(g.name, spread, None) for g, spread in zip(s.groups, fit.at.spreads, strict=True) if g.free]
    cast = lambda v: None if v is None else float(v)
    effects = spark.createDataFrame([(t, cast(v), cast(e)) for t, v, e in terms], "term string, estimate double, se double")
    return Calibration(items, effects, float(fit.value), fit.passes)


def _monotonic_terms(fit: Estimate, s: Structure, name: str, grades: Sequence, step_cells: Sequence) -> list[tuple]:
    """Mean step, steps, shares and deviations of a monotonic effect; a share on the border has no standard error."""
    errors, values, at = _errors(fit.cov), fit.at.phi, s.slope_at
    b, shares = values[at], s.parameters + 1 + np.arange(s.steps)
    terms = [(f"b_{name}", b, errors[at])]
    for x, z, share in zip(grades[1:], fit.at.z, shares, strict=True):
        slope = np.zeros(len(fit.cov))
        slope[at], slope[share] = s.steps * z, s.steps * b
        terms.append((f"step[{x}]", s.steps * b * z, np.sqrt(max(slope @ fit.cov @ slope, 0.0))))
    terms += [(f"z_{name}[{i}]", z, errors[share] if 0 < z < 1 else None) for i, (z, share) in enumerate(zip(fit.at.z, shares, strict=True), 1)]
    if s.deviations:
        terms += [(f"b_{name}[{c}]", values[at + 1 + i], errors[at + 1 + i]) for i, c in enumerate(step_cells)]
    return terms


def _em_2pl(people: DataFrame, k: int, cells: int, width: int, node: np.ndarray, estimate_sigma: bool, prior_log_alpha: float,
            prior_beta: float, prior_effect: float, tol: float, max_iter: int) -> tuple:
    """Items, effects, residual spread, log-likelihood and passes by accelerated EM."""

    def step(x: np.ndarray) -> tuple[np.ndarray, float]:
        log_a, b, gamma, sigma = x[:k], x[k : 2 * k], x[2 * k : 2 * k + width], float(np.exp(x[-1]))
        z = np.exp(log_a)[:, None] * (node[None, :] + b[:, None])
        log_p = np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], axis=1).reshape(-1, len(node))
        expected, xtx, xte, ee, n, log_lik = _e_step(people, log_p, node, gamma, sigma)
        counts = expected.reshape(k, 2, len(node))
        new_a, new_b = _fit_binary(counts[:, 0], counts[:, 1], node, log_a, b, prior_log_alpha, prior_beta)
        scale = sigma**2  # the ridge is on the effects themselves, whatever the residual spread
        new_gamma = np.linalg.solve(xtx + scale * np.eye(width) / prior_effect**2, xte) if width else gamma
        if estimate_sigma:
            rss = ee - 2 * new_gamma @ xte + new_gamma @ xtx @ new_gamma
            sigma = float(np.sqrt(max(rss / n, 1e-6)))
        # Two directions leave the likelihood as it is: shifting all items against all cells, and stretching
        # the latent outcome against the slopes. Only the priors settle them, which is done here at once.
        if cells:
            shift = new_gamma[:cells].mean()
            new_gamma = np.r_[new_gamma[:cells] - shift, new_gamma[cells:]]
            new_b = new_b + shift
        if estimate_sigma:
            pull = (((new_b - new_b.mean()) / prior_beta) ** 2).sum() + ((new_gamma / prior_effect) ** 2).sum()
            stretch = _stretch(new_a, pull, prior_log_alpha)
            new_a, new_b, new_gamma, sigma = new_a - stretch, new_b * np.exp(stretch), new_gamma * np.exp(stretch), sigma * np.exp(stretch)
        return np.concatenate([new_a, new_b, new_gamma, [np.log(sigma)]]), log_lik - penalty(x)

    def penalty(x: np.ndarray) -> float:
        log_a, b, gamma = x[:k], x[k : 2 * k], x[2 * k : 2 * k + width]
        return 0.5 * (((log_a / prior_log_alpha) ** 2).sum() + (((b - b.mean()) / prior_beta) ** 2).sum() + ((gamma / prior_effect) ** 2).sum())

    x, value, done = settle(step, np.zeros(2 * k + width + 1), tol, max_iter)
    return x[:k], x[k : 2 * k], x[2 * k : 2 * k + width], float(np.exp(x[-1])), float(value + penalty(x)), done


# -- graded items ----------------------------------------------------------------------------


def _graded_probs(node: np.ndarray, a: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category probabilities (items x categories x nodes) and the cumulative slopes."""
    s = _sigmoid(a[:, None, None] * node[None, None, :] - cuts[:, :, None])
    ones, zeros = np.ones_like(s[:, :1]), np.zeros_like(s[:, :1])
    probs = np.concatenate([ones, s], axis=1) - np.concatenate([s, zeros], axis=1)
    return np.maximum(probs, 1e-12), s * (1 - s)


def _fit_graded(counts: np.ndarray, node: np.ndarray, log_a: np.ndarray, cuts: np.ndarray,
                prior_a: float, prior_cut: float, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Penalised Fisher scoring of all graded items at once."""
    n_items, n_cat, _ = counts.shape
    total = counts.sum(1)

    def objective(la: np.ndarray, c: np.ndarray) -> np.ndarray:
        probs, _ = _graded_probs(node, np.exp(la), c)
        fit = (counts * np.log(probs)).sum((1, 2)) - 0.5 * (la / prior_a) ** 2 - 0.5 * ((c / prior_cut) ** 2).sum(1)
        return np.where((np.diff(c, axis=1) > 0).all(1), fit, -np.inf)

    for _ in range(steps):
        a = np.exp(log_a)
        probs, slope = _graded_probs(node, a, cuts)
        pad = np.zeros((n_items, 1, len(node)))
        jac = np.zeros((n_items, n_cat, n_cat, len(node)))  # category x parameter
        around = np.concatenate([pad, slope, pad], axis=1)
        jac[:, :, 0] = (around[:, :-1] - around[:, 1:]) * (a[:, None] * node[None, :])[:, None]
        for k in range(n_cat - 1):
            jac[:, k, k + 1] = slope[:, k]
            jac[:, k + 1, k + 1] = -slope[:, k]
        grad = np.einsum("ikq,ikpq->ip", counts / probs, jac)
        info = np.einsum("iq,ikpq,ikrq,ikq->ipr", total, jac, jac, 1 / probs)
        penalty = np.concatenate([[prior_a**-2], np.full(n_cat - 1, prior_cut**-2)])
        params = np.concatenate([log_a[:, None], cuts], axis=1)
        step = np.linalg.solve(info + np.diag(penalty)[None], (grad - penalty * params)[:, :, None])[:, :, 0]
        size, before = np.ones(n_items), objective(log_a, cuts)
        for _ in range(12):
            trial = params + size[:, None] * step
            worse = objective(trial[:, 0], trial[:, 1:]) < before
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        trial = np.where(worse[:, None], params, trial)
        log_a, cuts = trial[:, 0], trial[:, 1:]
    return log_a, cuts


def calibrate_grm(
    ratings: DataFrame,
    person: str,
    item: str,
    y: str,
    categories: int = 5,
    nodes: int = 41,
    reach: float = 6.0,
    max_iter: int = 1_000,
    tol: float = 1e-6,
    prior_log_alpha: float = 1.0,
    prior_cut: float = 5.0,
    items_are: Sequence | None = None,
    method: str = "scoring",
) -> Calibration:
    """Graded-response calibration: ``P(y > k) = inv_logit(alpha * theta - beta_k)``, theta ~ N(0, 1).

    Priors: ``log alpha ~ N(0, prior_log_alpha)``, thresholds ``~ N(0, prior_cut)`` in order.
    """
    used = ratings.dropna(subset=[person, item, y])
    answers = answer_cells(used, person, item, y)
    item_ids, = _known_levels(answers, [(item, items_are)])
    layout = _lists(answers, person, item, y, item_ids, range(1, categories + 1))
    people = _packed(_distinct_people(layout.select("counts", F.array().cast("array<double>").alias("x"))))
    node = np.linspace(-reach, reach, nodes)
    k, cuts_at = len(item_ids), np.log(np.arange(1, categories) / np.arange(categories - 1, 0, -1))
    start = np.tile(np.r_[0.0, cuts_at], (k, 1))
    curves = GradedCurves(categories)
    try:
        if method == "em":
            params, log_lik, done = _em_grm(people, start, node, prior_log_alpha, prior_cut, tol, max_iter)
            errors = None
        else:
            s = Structure(curves, k * categories, 0)
            if s.parameters > PARAMETERS:
                raise ValueError(f"{s.parameters} parameters are too many for method='scoring'; use method='em'")
            alphas = np.arange(0, s.items, categories)
            s.groups = [Group("sd_log_alpha", alphas, prior_log_alpha), Group("sd_cuts", np.setdiff1d(np.arange(s.items), alphas), prior_cut)]
            sums = Sums(k, curves, 0, nodes)
            fit = maximise(lambda psi: _evidence(people, sums, node, psi), s, start.ravel(), tol, max_iter,
                           lambda psi: curves.valid(psi.reshape(k, categories)))
            params, log_lik, done = fit.at.phi.reshape(k, categories), fit.value, fit.passes
            errors = _errors(fit.cov)[: s.items].reshape(k, categories)
    finally:
        people.unpersist()
    alpha = np.exp(params[:, 0])
    betas = {f"beta_{j}": params[:, j] for j in range(1, categories)}
    if errors is not None:
        errors = {"alpha": alpha * errors[:, 0]} | {f"beta_{j}": errors[:, j] for j in range(1, categories)}
    items = _item_table(ratings.sparkSession, item_ids, dict(used.dtypes)[item], alpha, betas, errors)
    return Calibration(items, None, float(log_lik), done)


def _em_grm(people: DataFrame, start: np.ndarray, node: np.ndarray, prior_log_alpha: float, prior_cut: float, tol: float,
            max_iter: int) -> tuple[np.ndarray, float, int]:
    """Items, log-likelihood and passes by accelerated EM."""
    k, categories = start.shape

    def penalty(x: np.ndarray) -> float:
        params = x.reshape(k, categories)
        return 0.5 * ((params[:, 0] / prior_log_alpha) ** 2).sum() + 0.5 * ((params[:, 1:] / prior_cut) ** 2).sum()

    def step(x: np.ndarray) -> tuple[np.ndarray, float]:
        params = x.reshape(k, categories)
        probs, _ = _graded_probs(node, np.exp(params[:, 0]), params[:, 1:])
        expected, *_, log_lik = _e_step(people, np.log(probs).reshape(-1, len(node)), node, np.zeros(0), 1.0)
        new = _fit_graded(expected.reshape(k, categories, len(node)), node, params[:, 0], params[:, 1:], prior_log_alpha, prior_cut)
        return np.c_[new[0], new[1]].ravel(), log_lik - penalty(x)

    x, value, done = settle(step, start.ravel(), tol, max_iter,
                            valid=lambda x: bool((np.diff(x.reshape(k, categories)[:, 1:], axis=1) > 0).all()))
    return x.reshape(k, categories), value + penalty(x), done


# -- scoring ---------------------------------------------------------------------------------


def score_eap(
    responses: DataFrame,
    items: DataFrame,
    person: str,
    item: str,
    y: str,
    nodes: Sequence[float] = tuple(seq(-4.0, 4.0, 0.4)),
    sign: int = 1,
    offset: str | None = None,
) -> DataFrame:
    """Expected a-posteriori score and posterior SD per person, from given item parameters.

    ``items`` holds binary items (``alpha, beta``) or graded ones (``alpha, beta_1, beta_2, …``).
    Each response turns into one log-likelihood column per node, summed per person: one partial
    aggregation, generated code only, and no per-person list. ``offset`` is a person-level column
    added to theta (condition effects and covariates).
    """
    cuts = thresholds(items)
    bank = items.select(F.col("item").alias("_item"), "alpha", *(cuts or ["beta"]))
    rows = lookup(responses.filter(F.col(y).isNotNull()), bank, [F.col(item)], ["_item"], "inner")
    shift = F.col(offset) if offset else F.lit(0.0)

    def binary(node: float) -> Column:
        z = F.col("alpha") * (F.lit(float(node)) + sign * F.col("beta") + shift)
        signed = F.when(F.col(y) == 1, -z).otherwise(z)
        return -(F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))

    def graded(node: float) -> Column:
        # Cut above and cut below the category given; the outer ones are certain.
        above = [inv_logit(F.col("alpha") * (F.lit(float(node)) + shift) - F.col(b)) for b in cuts]
        upper = case_when(*[(F.col(y) == k + 2, p) for k, p in enumerate(above)], default=F.lit(1.0))
        lower = case_when(*[(F.col(y) == k + 1, p) for k, p in enumerate(above)], default=F.lit(0.0))
        return F.log(F.greatest(upper - lower, F.lit(1e-300)))

    log_lik = graded if cuts else binary
    sums = rows.groupBy(person).agg(
        F.count(F.lit(1)).alias("n_items"), *[F.sum(log_lik(q)).alias(f"_l{i}") for i, q in enumerate(nodes)])
    post = [F.col(f"_l{i}") - 0.5 * q * q for i, q in enumerate(nodes)]
    top = F.greatest(*post)
    weights = sums.select(person, "n_items", *[F.exp(p - top).alias(f"_w{i}") for i, p in enumerate(post)])
    total = sum((F.col(f"_w{i}") for i in range(1, len(nodes))), F.col("_w0"))
    first = sum((F.col(f"_w{i}") * float(q) for i, q in enumerate(nodes)), F.lit(0.0)) / total
    second = sum((F.col(f"_w{i}") * float(q * q) for i, q in enumerate(nodes)), F.lit(0.0)) / total
    return weights.select(person, "n_items", first.alias("theta"),
                          F.sqrt(F.greatest(second - first * first, F.lit(0.0))).alias("theta_sd"))


def item_fit(
    responses: DataFrame,
    items: DataFrame,
    person: str,
    item: str,
    y: str,
    nodes: Sequence[float] = tuple(float(q) for q in np.linspace(-6.0, 6.0, 41)),
    sign: int = 1,
    offset: str | None = None,
) -> DataFrame:
    """Per item: answers ``n``, the share ``observed`` and the share ``expected`` under a fitted binary model.

    The expectation is over each person's posterior on the grid of the latent outcome, whose prior is N(offset, 1). At a maximum of the
    likelihood both shares agree for every item, whatever the data; a gap tells of priors at work, or of parameters from other data.
    People with the same answers and offset count once, with a weight; generated code only.
    """
    bank = items.select(F.col("item").alias("_item"), "alpha", "beta")
    shift = F.col(offset) if offset else F.lit(0.0)
    given = responses.filter(F.col(y).isNotNull() & F.col(person).isNotNull()).select(
        F.col(person).alias("_person"), F.col(item).alias("item"), F.col(y).cast("double").alias("_y"), shift.alias("_shift"))
    cells = answer_cells(given.join(bank.select("_item"), F.col("item") == F.col("_item"), "left_semi"), "_person", "item", "_y", ["_shift"])
    lists = cells.groupBy("_person").agg(F.sort_array(F.collect_list(F.struct("item", "_y", "_n"))).alias("counts"), F.max("_shift").alias("_shift"))
    kinds = lists.groupBy("counts", "_shift").agg(F.count(F.lit(1)).alias("_weight"))
    kinds = cut_lineage(kinds.withColumn("_kind", F.monotonically_increasing_id()))
    rows = kinds.select("_kind", "_shift", "_weight", F.inline("counts")).join(bank, F.col("item") == F.col("_item")).drop("_item")
    rows = cut_lineage(rows)
    z = [F.col("alpha") * (F.lit(float(q)) + sign * F.col("beta")) for q in nodes]
    signed = [F.when(F.col("_y") == 1, -v).otherwise(v) for v in z]
    log_lik = [-F.col("_n") * (F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))) for v in signed]
    sums = rows.groupBy("_kind").agg(F.max("_shift").alias("_shift"), *[F.sum(v).alias(f"_l{i}") for i, v in enumerate(log_lik)])
    post = [F.col(f"_l{i}") - 0.5 * (F.lit(float(q)) - F.col("_shift")) ** 2 for i, q in enumerate(nodes)]
    top = F.greatest(*post)
    weights = cut_lineage(sums.select("_kind", *[F.exp(p - top).alias(f"_w{i}") for i, p in enumerate(post)]))
    met = rows.join(weights, "_kind")
    total = sum((F.col(f"_w{i}") for i in range(1, len(nodes))), F.col("_w0"))
    share = sum((F.col(f"_w{i}") * inv_logit(v) for i, v in enumerate(z)), F.lit(0.0)) / total
    times = F.col("_weight") * F.col("_n").cast("double")
    return met.groupBy("item").agg(F.sum(times).cast("long").alias("n"), (F.sum(times * F.col("_y")) / F.sum(times)).alias("observed"),
                                   (F.sum(times * share) / F.sum(times)).alias("expected"))


__all__ = ["Calibration", "calibrate_2pl", "calibrate_grm", "item_fit", "person_layout", "score_eap"]
