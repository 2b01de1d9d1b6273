"""Second-order estimation of item-response models: value, gradient and curvature of the marginal likelihood in one pass.

For every person the latent outcome is summed out over a grid. With the posterior weights of the nodes at hand, the gradient of the person's
log-likelihood is the posterior mean of the complete-data score (Fisher), and its curvature is the posterior mean of the complete-data
curvature plus the posterior covariance of the score (Louis). Tasks sum both over their people, so that only
sums of the size parameters x parameters reach the driver, and a few damped Newton steps settle the estimates. The curvature at
the end gives standard errors.

Between two passes the driver maximises the quadratic picture of the likelihood that a pass has given, together with the priors.
Three things are settled there without looking at the data again:

* spreads of groups of parameters (two-level shrinkage): the parameters are summed out of the picture, and the
  spreads that are then likeliest are taken;
* the shares of a monotonic effect, which lie on a simplex, by an active-set quadratic programme;
* the slopes that multiply those shares, cell by cell, in turn with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..session import ship_by_value
from .fixed_point import NotSettled

ship_by_value(__name__)

PARAMETERS = 3_000  # curvature of more parameters is not held; estimate such banks with ``method="em"``
CELLS_AT_ONCE = 1 << 20  # numbers that a task holds of a group of people
ANSWER_COST = 40  # work of one answer's row against a cell of a matrix product
PAIRS_AT_ONCE, PAIR_COST = 1 << 20, 4  # pairs of answers held at once; work of one against a cell of a matrix product
FOLLOWED_AT_ONCE = 1 << 17  # answers x nodes held at once, where every person has a grid
SMALLEST = 600.0  # exp of minus that is held as a number; smaller ones as logarithms
REACH = 4.0  # a pass ends its steps when the logarithm of a discrimination has moved farther
LEAST_SPREAD = 1e-3  # spreads below count as none: deviations of that size are of no interest


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def softmax(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row weights that sum to one, and the logarithm of what they were divided by."""
    top = logs.max(axis=1, keepdims=True)
    weights = np.exp(logs - top)
    total = weights.sum(axis=1, keepdims=True)
    return weights / total, top[:, 0] + np.log(total[:, 0])


# -- response curves -------------------------------------------------------------------------


class BinaryCurves:
    """Items with ``P(y = 1) = inv_logit(a * node + d)``.

    A pass works with the natural values (a, d), in which the likelihood is closest to a quadratic; the parameters are (log a, b) with d = a b.
    """

    categories = per_item = 2

    def natural(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural values of items with their slopes and curvature in the parameters."""
        a, b = np.exp(params[:, 0]), params[:, 1]
        slopes, bends = np.zeros((len(a), 2, 2)), np.zeros((len(a), 2, 2, 2))
        slopes[:, 0, 0], slopes[:, 1, 0], slopes[:, 1, 1] = a, a * b, a
        bends[:, 0, 0, 0], bends[:, 1, 0, 0], bends[:, 1, 0, 1], bends[:, 1, 1, 0] = a, a * b, a, a
        return np.stack([a, a * b], axis=1), slopes, bends

    def _parts(self, values: np.ndarray, node: np.ndarray):
        z = values[:, :1] * node[None, :] + values[:, 1:]
        p = sigmoid(z)
        return z, np.stack([node, np.ones_like(node)]), np.stack([-p, 1 - p], axis=1), p * (1 - p)

    def first(self, values: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (item, category, node) and their slopes (item, category, value, node)."""
        z, dz, resid, _ = self._parts(values, node)
        return np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], axis=1), resid[:, :, None, :] * dz[None, None]

    def second(self, values: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Curvature of the log-probabilities (item, category, value, value, node)."""
        _, dz, _, weight = self._parts(values, node)
        bend = -weight[:, None, None] * (dz[:, None] * dz[None, :])[None]
        return np.broadcast_to(bend[:, None], (len(values), 2, *bend.shape[1:]))

    def valid(self, values: np.ndarray) -> bool:
        return bool(np.isfinite(values).all() and (values[:, 0] > 0).all() and np.abs(values).max(initial=0) < 1e6)


class GradedCurves:
    """Items with ``P(y > k) = inv_logit(a * node - c_k)`` and ordered thresholds; the parameters are (log a, c_1, c_2, ...)."""

    def __init__(self, categories: int):
        self.categories = self.per_item = categories

    def natural(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, c = np.exp(params[:, 0]), self.per_item
        slopes, bends = np.tile(np.eye(c), (len(a), 1, 1)), np.zeros((len(a), c, c, c))
        slopes[:, 0, 0] = bends[:, 0, 0, 0] = a
        return np.c_[a, params[:, 1:]], slopes, bends

    def _parts(self, values: np.ndarray, node: np.ndarray):
        s = sigmoid(values[:, :1, None] * node[None, None, :] - values[:, 1:, None])
        edge = np.zeros_like(s[:, :1])
        pad = lambda x, low, high: np.concatenate([low, x, high], axis=1)
        s0, s1 = pad(s, edge + 1, edge), pad(s * (1 - s), edge, edge)
        s2 = pad(s * (1 - s) * (1 - 2 * s), edge, edge)
        return np.maximum(s0[:, :-1] - s0[:, 1:], 1e-12), s1, s2

    def _slopes(self, s1: np.ndarray, node: np.ndarray) -> np.ndarray:
        c = self.categories
        out = np.zeros((len(s1), c, c, len(node)))
        out[:, :, 0] = (s1[:, :-1] - s1[:, 1:]) * node
        for k in range(1, c):  # threshold k stands between categories k - 1 and k
            out[:, k - 1, k], out[:, k, k] = s1[:, k], -s1[:, k]
        return out

    def first(self, values: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, s1, _ = self._parts(values, node)
        return np.log(p), self._slopes(s1, node) / p[:, :, None]

    def second(self, values: np.ndarray, node: np.ndarray) -> np.ndarray:
        p, s1, s2 = self._parts(values, node)
        c = self.categories
        bend = np.zeros((len(p), c, c, c, len(node)))
        bend[:, :, 0, 0] = (s2[:, :-1] - s2[:, 1:]) * node**2
        for k in range(1, c):
            for category, sign in ((k - 1, 1.0), (k, -1.0)):
                bend[:, category, 0, k] = bend[:, category, k, 0] = sign * s2[:, k] * node
                bend[:, category, k, k] = -sign * s2[:, k]
        slope = self._slopes(s1, node) / p[:, :, None]
        return bend / p[:, :, None, None] - slope[:, :, :, None] * slope[:, :, None]

    def valid(self, values: np.ndarray) -> bool:
        return bool(np.isfinite(values).all() and (values[:, 0] > 0).all() and np.abs(values).max(initial=0) < 1e6
                    and (np.diff(values[:, 1:], axis=1) > 0).all())


# -- answers of people -----------------------------------------------------------------------


def _one_in(odds: np.ndarray) -> np.ndarray:
    out = odds + 1
    return np.reciprocal(out, out=out)


class Answers:
    """Answers of some people as compressed rows: places and numbers, one person after another."""

    def __init__(self, at: np.ndarray, n: np.ndarray, lengths: np.ndarray):
        self.at, self.n, self.lengths = at, n, lengths
        self._ends = np.cumsum(lengths)

    @staticmethod
    def of(column: pa.Array) -> Answers:
        """From lists of (place, number)."""
        cells = column.flatten()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return Answers(cells.field("at").to_numpy().astype(np.int64), cells.field("n").to_numpy().astype(float), lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    @property
    def person(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths)

    def part(self, people: slice) -> Answers:
        ends = np.r_[0, self._ends]
        cells = slice(ends[people.start], ends[people.stop])
        return Answers(self.at[cells], self.n[cells], self.lengths[people])

    def slices(self, size: int, pairs: bool = False, cells: bool = False) -> Iterator[slice]:
        """Runs of people with at most ``size`` people, answers or pairs of answers, or of one person."""
        ends = np.cumsum(self.lengths**2) if pairs else self._ends if cells else np.arange(1, len(self) + 1)
        first, done = 0, 0
        while first < len(self):
            last = max(int(np.searchsorted(ends, done + size, "right")), first + 1)
            yield slice(first, last)
            first, done = last, int(ends[last - 1])

    def times(self, table: np.ndarray) -> np.ndarray:
        """People x columns: the rows of ``table`` at each person's places, multiplied by the numbers and added up."""
        out = np.zeros((len(self), table.shape[1]))
        if len(self) * len(table) <= ANSWER_COST * len(self.at):
            for people in self.slices(max(CELLS_AT_ONCE // len(table), 1)):
                out[people] = self.part(people).dense(len(table)) @ table
            return out
        starts, order = self._ends - self.lengths, np.argsort(-self.lengths, kind="stable")
        having = np.searchsorted(np.sort(-self.lengths), -np.arange(1, self.lengths.max(initial=0) + 1), "right")
        for nth, people in enumerate(having):  # the nth answer of all people with that many
            for start in range(0, people, size := max(CELLS_AT_ONCE // table.shape[1], 1)):
                who = order[start : min(start + size, people)]
                at = starts[who] + nth
                out[who] += table[self.at[at]] * self.n[at, None]
        return out

    def spread_over(self, rows: np.ndarray, places: int) -> np.ndarray:
        """Places x columns: each person's row added, times the number, at the person's places."""
        out = np.zeros((places, rows.shape[1]))
        for people in self.slices(CELLS_AT_ONCE // rows.shape[1], cells=True):
            part = self.part(people)
            order = np.argsort(part.at, kind="stable")
            at = part.at[order]
            if len(at):
                first = np.flatnonzero(np.diff(at, prepend=-1))
                out[at[first]] += np.add.reduceat(rows[people][part.person[order]] * part.n[order, None], first)
        return out

    def dense(self, places: int) -> np.ndarray:
        out = np.zeros((len(self), places))
        out[self.person, self.at] = self.n
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``at`` of all pairs of different answers of one person, the earlier one left."""
        after = np.repeat(self._ends, self.lengths) - np.arange(len(self.at)) - 1
        left = np.repeat(np.arange(len(self.at)), after)
        return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)


# -- sums over people ------------------------------------------------------------------------


class Sums:
    """What a pass adds up, as one flat vector: counts per node, slopes and curvature by blocks.

    The latent outcome of a person is normal around ``x @ effects`` with SD 1.
    """

    def __init__(self, items: int, curves, width: int, nodes: int):
        self.items, self.curves, self.width, self.nodes = items, curves, width, nodes
        p, places = items * curves.per_item, items * curves.categories
        self.shapes = {"counts": (places, nodes), "g_items": (p,), "h_items": (p, p), "h_cross": (p, width),
                       "g_effects": (width,), "h_effects": (width, width), "value": (1,)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())

    def first(self, psi: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Curves on the grid that all people share."""
        return self.curves.first(psi[: self.items * self.curves.per_item].reshape(self.items, -1), node)

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def add(self, total: np.ndarray, answers: Answers, x: np.ndarray, weight: np.ndarray, psi: np.ndarray, node: np.ndarray,
            first: tuple[np.ndarray, np.ndarray]) -> None:
        """Add people with their answers and design ``x``; ``weight`` tells how often each counts."""
        log_p, slopes = first
        sums, q = self.split(total), self.nodes
        mean = x @ psi[self.items * self.curves.per_item :] if self.width else np.zeros(1)
        log_prior = -0.5 * (node[None, :] - mean[:, None]) ** 2
        log_post = answers.times(log_p.reshape(-1, q)) + log_prior
        # The grid is finite, so its prior mean and variance are taken off.
        powers = np.stack([np.ones(q), node, node**2], axis=1)
        high, top = log_prior.max(axis=1, keepdims=True), log_post.max(axis=1, keepdims=True)
        prior, post = np.exp(log_prior - high), np.exp(log_post - top)
        before, after = prior @ powers, post @ powers
        post /= after[:, :1]
        sums["value"] += (top[:, 0] - high[:, 0] + np.log(after[:, 0] / before[:, 0])) @ weight
        at, prior_at = after[:, 1] / after[:, 0], before[:, 1] / before[:, 0]
        if self.width:
            var, prior_var = after[:, 2] / after[:, 0] - at**2, before[:, 2] / before[:, 0] - prior_at**2
            sums["g_effects"] += x.T @ ((at - prior_at) * weight)
            sums["h_effects"] += x.T @ (x * ((var - prior_var) * weight)[:, None])
        # The covariance of a person's scores, from pairs of answers or as matrix products: whichever is less work.
        places = self.items * self.curves.categories
        sparse = PAIR_COST * (answers.lengths**2).sum() < len(answers) * self.items**2
        add, size = (self._add_pairs, PAIRS_AT_ONCE) if sparse else (self._add_matrices, CELLS_AT_ONCE // max(places * self.curves.per_item, q))
        for people in answers.slices(size, pairs=sparse):
            add(sums, answers.part(people), x[people], weight[people], post[people], at[people], node, slopes)

    def _add_counts(self, sums: dict, counts: np.ndarray, slopes: np.ndarray) -> None:
        sums["counts"] += counts
        sums["g_items"] += np.einsum("icq,ickq->ik", counts.reshape(self.items, -1, self.nodes), slopes).ravel()

    def _add_matrices(self, sums: dict, answers: Answers, x: np.ndarray, weight: np.ndarray, post: np.ndarray, at: np.ndarray,
                      node: np.ndarray, slopes: np.ndarray) -> None:
        n, c, k, q = self.items, self.curves.categories, self.curves.per_item, self.nodes
        by_place, h = slopes.reshape(n * c, k, q), sums["h_items"].reshape(n, k, n, k)
        numbers = answers.dense(n * c)
        weighted = numbers * weight[:, None]
        self._add_counts(sums, weighted.T @ post, slopes)

        def scores(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), n, k))
            for category in range(c):
                out += (rows @ slopes[:, category].reshape(-1, q).T).reshape(-1, n, k) * numbers[:, category::c, None]
            return out.reshape(-1, n * k)

        g = scores(post)
        sums["h_items"] -= g.T @ (g * weight[:, None])
        if self.width:
            cross = scores(post * node) - g * at[:, None]
            sums["h_cross"] += (cross * weight[:, None]).T @ x
        for place in range(n * c):  # with all places from there on
            who = np.flatnonzero(numbers[:, place])
            if not len(who):
                continue
            met = np.zeros((n * c, q))
            met[place:] = (weighted[who, place:] * numbers[who, place, None]).T @ post[who]
            found = np.matmul(by_place[place] * met[:, None], by_place.transpose(0, 2, 1))
            i = place // c
            h[i] += found.reshape(n, c, k, k).sum(1).transpose(1, 0, 2)
            found[place] = 0.0
            h[:, :, i] += found.reshape(n, c, k, k).sum(1).transpose(0, 2, 1)

    def _add_pairs(self, sums: dict, answers: Answers, x: np.ndarray, weight: np.ndarray, post: np.ndarray, at: np.ndarray,
                   node: np.ndarray, slopes: np.ndarray) -> None:
        n, c, k, q = self.items, self.curves.categories, self.curves.per_item, self.nodes
        places, by_place, h = n * c, slopes.reshape(n * c, k, q), sums["h_items"].reshape(n, k, n, k)
        person, counts = answers.person, np.zeros((places, q))
        g, cross = np.zeros((len(person), k)), np.zeros((len(person), k))
        # Answers of one place have one score, so that theirs are matrix products.
        order = np.argsort(answers.at, kind="stable")
        bounds = np.searchsorted(answers.at[order], np.arange(places + 1))
        for place in np.flatnonzero(np.diff(bounds)):
            i, score = place // c, by_place[place]
            for start in range(bounds[place], bounds[place + 1], size := max(CELLS_AT_ONCE // q, 1)):
                rows = order[start : min(start + size, bounds[place + 1])]
                who, times = person[rows], answers.n[rows]
                held = post[who]
                counts[place] += (weight[who] * times) @ held
                mine = g[rows] = (held @ score.T) * times[:, None]
                h[i, :, i] += (score * ((weight[who] * times**2) @ held)) @ score.T - mine.T @ (mine * weight[who, None])
                if self.width:
                    cross[rows] = ((held * node) @ score.T) * times[:, None] - mine * at[who, None]
        self._add_counts(sums, counts, slopes)
        if self.width:
            item = answers.at // c
            for j in range(self.width):
                weighted = cross * (x[:, j] * weight)[person, None]
                for i in range(k):
                    sums["h_cross"][i::k, j] += np.bincount(item, weighted[:, i], minlength=n)
        # Pairs of different answers stand for both orders.
        left, right = answers.pairs()
        if not len(left):
            return
        who, both = person[left], answers.at[left] // c * n + answers.at[right] // c
        scores, weighted = np.ascontiguousarray(g.T), np.ascontiguousarray((g * weight[person, None]).T)
        scores, weighted = scores[:, right], weighted[:, left]
        for i in range(k):
            for j in range(k):
                met = np.bincount(both, weighted[i] * scores[j], minlength=n * n).reshape(n, n)
                h[:, i, :, j] -= met
                h[:, j, :, i] -= met.T
        key, times = answers.at[left] * places + answers.at[right], answers.n[left] * answers.n[right]
        by_node = np.ascontiguousarray((post * weight[:, None]).T)
        for nth in range(q):
            met = np.bincount(key, times * by_node[nth][who], minlength=places * places).reshape(n, c, places)
            d = slopes[:, :, :, nth]
            half = np.matmul(d.transpose(0, 2, 1), met).reshape(n * k, n, c)
            found = np.matmul(half.transpose(1, 0, 2), d).transpose(1, 0, 2).reshape(n * k, n * k)
            sums["h_items"] += found
            sums["h_items"] += found.T

    def shipped(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values to send: of symmetric blocks the upper half."""
        sums = self.split(total)
        for name in ("h_items", "h_effects"):
            sums[name][np.tril_indices(len(sums[name]), -1)] = 0.0
        at = np.flatnonzero(total)
        return at, total[at]

    def evidence(self, flat: np.ndarray, psi: np.ndarray, node: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and curvature at ``psi`` (items, effects) from sums with upper halves."""
        s, k = self.split(flat), self.curves.per_item
        p = self.items * k
        mirrored = lambda h: np.triu(h) + np.triu(h, 1).T
        items = mirrored(s["h_items"])
        bend = self.curves.second(psi[:p].reshape(self.items, k), node)
        own = np.einsum("icq,icklq->ikl", s["counts"].reshape(self.items, self.curves.categories, -1), bend)
        for i in range(self.items):
            items[i * k : (i + 1) * k, i * k : (i + 1) * k] += own[i]
        h = np.block([[items, s["h_cross"]], [s["h_cross"].T, mirrored(s["h_effects"])]])
        return float(s["value"][0]), np.concatenate([s["g_items"], s["g_effects"]]), 0.5 * (h + h.T)


class FollowingSums(Sums):
    """The same for binary items with the latent spread as one more coefficient, the last.

    The latent outcome of a person is normal around ``x @ effects`` with that SD, and every person has the grid in units of the
    spread around the own mean: effects may lie any number of spreads apart, and a spread of zero is a value like others. The
    likelihood is the same for a spread and its negative, so that it is smooth at zero.
    """

    def __init__(self, items: int, curves: BinaryCurves, width: int, nodes: int):
        super().__init__(items, curves, width + 1, nodes)
        del self.shapes["counts"]
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.width = width

    def first(self, psi: np.ndarray, node: np.ndarray) -> None:
        """Nothing: no two people need share a grid."""

    def add(self, total: np.ndarray, answers: Answers, x: np.ndarray, weight: np.ndarray, psi: np.ndarray, node: np.ndarray,
            first: None = None) -> None:
        sums, starts = self.split(total), np.cumsum(answers.lengths) - answers.lengths
        mean = x @ psi[self.items * 2 : -1] if self.width else np.zeros(len(answers))
        # People with equally many answers make full arrays.
        order = np.argsort(answers.lengths, kind="stable")
        lengths, bounds = np.unique(answers.lengths[order], return_index=True)
        room = np.empty(3 * max(FOLLOWED_AT_ONCE, lengths.max(initial=0) * self.nodes))
        for length, lo, hi in zip(lengths.tolist(), bounds, [*bounds[1:], len(order)], strict=True):
            size = max(FOLLOWED_AT_ONCE // (max(length, 1) * self.nodes), 1)
            for start in range(lo, hi if length else lo, size):
                who = order[start : min(start + size, hi)]
                rows = starts[who, None] + np.arange(length)
                self._add_people(sums, answers.at[rows], answers.n[rows], x[who], weight[who], mean[who], psi, node, room)

    def _add_people(self, sums: dict, at: np.ndarray, n: np.ndarray, x: np.ndarray, weight: np.ndarray, mean: np.ndarray, psi: np.ndarray,
                    node: np.ndarray, room: np.ndarray) -> None:
        """People x answers: places and numbers.

        Coefficients move an answer's argument ``z = a (mean + spread * node) + d`` by a constant and by a multiple of the node. In these
        two the curvature of a person is found, for all pairs of answers, and then carried over to the coefficients.
        """
        k, spread, length = self.items, psi[-1], at.shape[1]
        item, sign, values = at // 2, np.where(at % 2 == 1, 1.0, -1.0), psi[: 2 * k].reshape(k, 2)
        a, centre = values[item, 0], mean[:, None]
        prior = np.exp(-0.5 * node**2)
        prior /= prior.sum()
        # An answer has the probability p = 1 / (1 + exp(-z)), where z changes its sign for wrong ones.
        start = sign * (a * centre + values[item, 1])
        by_place = np.outer(np.stack([-values[:, 0], values[:, 0]], axis=1).ravel() * spread, node)
        if length * (np.abs(start).max() + np.abs(by_place).max() + 1) < SMALLEST and (n == 1).all():
            odds = np.exp(-by_place)[at]
            odds *= np.exp(-start)[:, :, None]
            p = _one_in(odds)
            post, top = p.prod(axis=1), 0.0  # no logarithms needed
        else:
            z = start[:, :, None] + by_place[at]
            odds = np.exp(-np.maximum(z, -SMALLEST))
            p = _one_in(odds)
            log_post = ((np.log(p) + np.minimum(z + SMALLEST, 0)) * n[:, :, None]).sum(axis=1)  # beyond, the logarithm is linear
            top = log_post.max(axis=1)
            post = np.exp(log_post - top[:, None])
        post *= prior
        norm = post.sum(axis=1)
        post /= norm[:, None]
        sums["value"] += (top + np.log(norm)) @ weight
        # Scores by the constant and by the node: their posterior means, and their covariance with the mean curvature taken in.
        powers = np.empty((len(at), 3, len(node)))
        powers[:, 0] = post
        np.multiply(post, node, out=powers[:, 1])
        np.multiply(post, node**2, out=powers[:, 2])
        odds *= p
        p *= odds  # p (1 - p), the curvature with its sign turned
        own = np.matmul(p, powers.transpose(0, 2, 1)) * n[:, :, None]
        odds *= (sign * n)[:, :, None]  # now the slopes
        g = np.matmul(powers[:, :2], odds.transpose(0, 2, 1))  # people, kind, answer
        each, held = np.arange(length), room[: 3 * odds.size].reshape(len(at), 3, length, -1)
        np.multiply(odds[:, None], powers[:, :, None], out=held)
        met = np.matmul(held.reshape(len(at), 3 * length, -1), odds.transpose(0, 2, 1)).reshape(len(at), 3, length, length)
        met[:, :, each, each] -= own.transpose(0, 2, 1)
        m = met[:, [[0, 1], [1, 2]]]  # people, kind, kind, answer, answer
        m -= g[:, :, None, :, None] * g[:, None, :, None, :]
        m *= weight[:, None, None, None, None]
        g *= weight[:, None, None]
        # To items: a moves the argument by mean + spread * node, d by one.
        by_item = lambda v: np.bincount(item.ravel(), v.ravel(), minlength=k)
        rows = (centre[:, None, :, None] * m[:, 0] + spread * m[:, 1], m[:, 0])  # a value of an answer: people, kind, answer, answer
        sums["g_items"][0::2] += by_item(centre * g[:, 0] + spread * g[:, 1])
        sums["g_items"][1::2] += by_item(g[:, 0])
        h, both = sums["h_items"].reshape(k, 2, k, 2), (item[:, :, None] * k + item[:, None]).ravel()
        for i, row in enumerate(rows):
            for j, met in enumerate((centre[:, :, None] * row[:, 0] + spread * row[:, 1], row[:, 0])):
                h[:, i, :, j] += np.bincount(both, met.ravel(), minlength=k * k).reshape(k, k)
        # To effects, which move the arguments of all answers by a, and the spread, which moves them by a * node.
        pulled = np.matmul(m.reshape(len(at), 4 * length, length), a[:, :, None]).reshape(len(at), 2, 2, length)
        person = np.arange(len(at))[:, None] * k + item
        for i, row in enumerate((centre[:, :, None] * pulled[:, 0] + spread * pulled[:, 1] + g, pulled[:, 0])):
            dense = np.bincount(person.ravel(), row[:, 0].ravel(), minlength=len(at) * k).reshape(-1, k)
            sums["h_cross"][i::2, :-1] += dense.T @ x
            sums["h_cross"][i::2, -1] += by_item(row[:, 1])
        total, curved = np.einsum("pv,piv->ip", a, g), np.einsum("pv,pijv->ijp", a, pulled)
        sums["g_effects"][:-1] += x.T @ total[0]
        sums["g_effects"][-1] += total[1].sum()
        sums["h_effects"][:-1, :-1] += x.T @ (x * curved[0, 0][:, None])
        sums["h_effects"][:-1, -1] += x.T @ curved[0, 1]
        sums["h_effects"][-1, -1] += curved[1, 1].sum()

    def evidence(self, flat: np.ndarray, psi: np.ndarray, node: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = self.split(flat)
        mirrored = lambda h: np.triu(h) + np.triu(h, 1).T
        h = np.block([[mirrored(s["h_items"]), s["h_cross"]], [s["h_cross"].T, mirrored(s["h_effects"])]])
        return float(s["value"][0]), np.concatenate([s["g_items"], s["g_effects"]]), h


# -- priors and structure --------------------------------------------------------------------


@dataclass
class Group:
    """Parameters with one normal prior: ``at`` their places, ``spread`` its SD, around their own mean if ``centred``.

    ``stretches`` tells whether the parameters grow with the scale of the latent outcome; logarithms of discriminations move against it.
    """

    name: str
    at: np.ndarray
    spread: float
    free: bool = False
    centred: bool = False
    stretches: bool = True

    def matrix(self) -> np.ndarray:
        n = len(self.at)
        return np.eye(n) - (np.full((n, n), 1 / n) if self.centred else 0)

    @property
    def rank(self) -> int:
        return len(self.at) - self.centred


@dataclass
class Structure:
    """How parameters make the coefficients that a pass knows, and their priors.

    Parameters are: items, plain effects, then for a monotonic effect its common slope and the slopes' deviations per cell.
    Coefficients are: natural values of the items, plain effects, a step for each cell and level.

    With ``stretch`` the latent outcome has a spread of its own. The likelihood does not know it: it only knows items and effects in units of that
    spread, which the parameters are. The spread enters through the priors, which hold for items and effects in
    their own units, so its logarithm (``scale`` below) is found there.

    With ``spread`` it is a parameter and coefficient itself, the last one, and all others are in their own units. Two ways leave the likelihood as
    it is, but are bent and would leave a quadratic picture: all items (``BinaryCurves``) move against the effects of all ``cells``, and
    discriminations grow while effects and spread shrink by the same factor. The coefficients are therefore those with a mean effect of the cells
    of zero, and the picture of a pass is looked at with coefficients in the unit of that pass: their mean logarithm
    of the discriminations is brought back to ``unit``.
    """

    curves: object
    items: int  # item parameters
    plain: int
    steps: int = 0  # levels of the monotonic effect, less one
    step_cells: int = 1  # cells with steps of their own
    deviations: bool = False
    stretch: bool = False
    spread: bool = False
    groups: list[Group] = field(default_factory=list)
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # places of effects one of which everybody has

    @property
    def slope_at(self) -> int:
        return self.items + self.plain

    @property
    def parameters(self) -> int:
        return self.slope_at + (1 + self.deviations * self.step_cells if self.steps else 0) + self.spread

    @property
    def coefficients(self) -> int:
        return self.slope_at + self.steps * self.step_cells + self.spread

    @property
    def powers(self) -> np.ndarray:
        """How coefficients change with the unit of the latent outcome: discriminations against effects and spread."""
        out = np.ones(self.coefficients)
        out[: self.items] = 0
        out[: self.items : self.curves.per_item] = -1
        return out

    def unit(self, psi: np.ndarray) -> float | None:
        """Mean logarithm of the discriminations; of no interest unless the spread is a coefficient."""
        return float(np.log(psi[: self.items : self.curves.per_item]).mean()) if self.spread else None

    def _factors(self, phi: np.ndarray, unit: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Factors that bring coefficients back to the unit, and the slopes of its logarithm."""
        slopes = np.zeros(self.parameters)
        if unit is None:
            return np.ones(self.coefficients), slopes
        log_a = phi[: self.items : self.curves.per_item]
        slopes[: self.items : self.curves.per_item] = 1 / len(log_a)
        return np.exp(self.powers * (log_a.mean() - unit)), slopes

    def _shift(self) -> tuple[np.ndarray, np.ndarray]:
        """What items and cells move by, and the mean effect of the cells, both as vectors over the parameters."""
        by, mean = np.zeros(self.parameters), np.zeros(self.parameters)
        if self.spread and len(self.cells):
            by[1 : self.items : 2], by[self.cells], mean[self.cells] = 1, -1, 1 / len(self.cells)
        return by, mean

    def to_coefficients(self, phi: np.ndarray, z: np.ndarray, unit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients, and their slopes in the parameters, for given shares."""
        by, mean = self._shift()
        phi = phi + by * (mean @ phi)
        head, k = self.slope_at, self.curves.per_item
        slopes = np.zeros((self.coefficients, self.parameters))
        slopes[np.arange(head), np.arange(head)] = 1
        if self.steps:
            slopes[head : head + self.steps * self.step_cells, head] = np.tile(self.steps * z, self.step_cells)
            for c in range(self.step_cells if self.deviations else 0):
                slopes[head + c * self.steps : head + (c + 1) * self.steps, head + 1 + c] = self.steps * z
        if self.spread:
            slopes[-1, -1] = 1
        out = slopes @ phi  # linear but for the items
        values, blocks, _ = self.curves.natural(phi[: self.items].reshape(-1, k))
        out[: self.items] = values.ravel()
        for i, block in enumerate(blocks):
            slopes[i * k : (i + 1) * k, i * k : (i + 1) * k] = block
        slopes += np.outer(slopes @ by, mean)
        if unit is not None:
            factors, turn = self._factors(phi, unit)
            out *= factors
            slopes = slopes * factors[:, None] + np.outer(self.powers * out, turn)
        return out, slopes

    def bend(self, phi: np.ndarray, pull: np.ndarray, z: np.ndarray | None = None, unit: float | None = None) -> np.ndarray:
        """Curvature, in the parameters, of the sum of ``pull`` times the coefficients."""
        if unit is not None:
            values, slopes = self.to_coefficients(phi, z)
            factors, turn = self._factors(phi, unit)
            pull = pull * factors
            cross = np.outer(slopes.T @ (self.powers * pull), turn)
            return self.bend(phi, pull) + cross + cross.T + (pull @ (self.powers**2 * values)) * np.outer(turn, turn)
        by, mean = self._shift()
        phi = phi + by * (mean @ phi)
        k, out = self.curves.per_item, np.zeros((self.parameters, self.parameters))
        _, _, bends = self.curves.natural(phi[: self.items].reshape(-1, k))
        own = np.einsum("im,imkl->ikl", pull[: self.items].reshape(-1, k), bends)
        for i, block in enumerate(own):
            out[i * k : (i + 1) * k, i * k : (i + 1) * k] = block
        out += np.outer(mean, by @ out)
        return out + np.outer(out @ by, mean)

    def slopes(self, phi: np.ndarray) -> np.ndarray:
        """Slope of the monotonic effect in every cell."""
        common = np.full(self.step_cells, phi[self.slope_at])
        return common + phi[self.slope_at + 1 : self.slope_at + 1 + self.step_cells] if self.deviations else common

    def to_steps(self, phi: np.ndarray, unit: float | None = None) -> np.ndarray:
        """Coefficients as a linear function of the shares, for given slopes."""
        out = np.zeros((self.coefficients, self.steps))
        for c, b in enumerate(self.slopes(phi) if self.steps else ()):
            out[self.slope_at + c * self.steps + np.arange(self.steps), np.arange(self.steps)] = self.steps * b
        return out * self._factors(phi, unit)[0][:, None]

    def precision(self, spreads: Sequence[float], scale: float = 0.0, fixed_only: bool = False) -> np.ndarray:
        out = np.zeros((self.parameters, self.parameters))
        for group, spread in zip(self.groups, spreads, strict=True):
            if not (fixed_only and group.free):
                out[np.ix_(group.at, group.at)] += group.matrix() * (np.exp(2 * scale * group.stretches) / spread**2)
        return out

    def prior_mean(self, scale: float) -> np.ndarray:
        out = np.zeros(self.parameters)
        for group in self.groups:
            if not group.stretches:
                out[group.at] = scale
        return out

    def penalty(self, phi: np.ndarray, spreads: Sequence[float], scale: float) -> float:
        away = phi - self.prior_mean(scale)
        return 0.5 * away @ self.precision(spreads, scale) @ away

    @property
    def unstretched(self) -> np.ndarray:
        """One for parameters that move against the scale of the latent outcome, zero for others."""
        out = np.zeros(self.parameters)
        for group in self.groups:
            out[group.at] = not group.stretches
        return out


def simplex_programme(lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimise ``x' lhs x / 2 - rhs' x`` over shares: at or above zero, summing to one."""
    n = len(rhs)
    tangent = np.eye(n)[:, 1:] - np.eye(n)[:, :1]
    _choleskied(tangent.T @ lhs @ tangent)  # without a single minimum there is nothing to find: the picture needs damping
    on = np.ones(n, bool)
    x = np.full(n, 1 / n)
    for _ in range(50 * n):
        at = np.flatnonzero(on)
        kkt = np.zeros((len(at) + 1, len(at) + 1))
        kkt[:-1, :-1], kkt[-1, :-1], kkt[:-1, -1] = lhs[np.ix_(at, at)], 1, 1
        solved = np.linalg.solve(kkt, np.r_[rhs[at], 1])
        target = np.zeros(n)
        target[at] = solved[:-1]
        if (target[at] >= -1e-12).all():
            x = np.maximum(target, 0)
            pull = lhs @ x - rhs + solved[-1]  # below zero: the share would like to grow
            if on.all() or pull[~on].min() >= -1e-9 * max(1.0, np.abs(rhs).max()):
                return x / x.sum()
            on[np.flatnonzero(~on)[np.argmin(pull[~on])]] = True
            continue
        falling = on & (target < x - 1e-15)
        length = np.where(falling, x / np.where(falling, x - target, 1), np.inf)
        length[~falling] = np.inf
        step = min(1.0, length.min())
        x = np.maximum(x + step * (target - x), 0)
        on &= ~(length <= step)
    raise NotSettled("shares of a monotonic effect have not settled")


def likeliest_spreads(lhs: np.ndarray, rhs: np.ndarray, groups: Sequence[Group], spreads: Sequence[float], scale: float) -> list[float]:
    """Spreads of groups of parameters under the quadratic ``rhs' x - x' lhs x / 2``, with half-Cauchy priors of that scale.

    The parameters, group after group, are summed out. Newton steps on the log spreads, with differences of the gradient as curvature.
    """
    bounds = np.cumsum([0, *[len(g.at) for g in groups]])
    blocks = [slice(lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    matrices, ranks = [g.matrix() for g in groups], np.array([g.rank for g in groups], float)
    floor = np.log(LEAST_SPREAD)

    def look(t: np.ndarray) -> tuple[float, np.ndarray]:
        full = lhs.copy()
        for block, m, x in zip(blocks, matrices, t, strict=True):
            full[block, block] += m * np.exp(-2 * x)
        low = np.linalg.cholesky(full)
        cov = np.linalg.inv(full)
        mode = cov @ rhs
        squares = np.array([mode[b] @ m @ mode[b] + (m * cov[b, b]).sum() for b, m in zip(blocks, matrices, strict=True)])
        value = 0.5 * rhs @ mode - np.log(np.diag(low)).sum() - ranks @ t - np.log1p(np.exp(2 * t) / scale**2).sum()
        return value, squares * np.exp(-2 * t) - ranks - 2 / (1 + scale**2 * np.exp(-2 * t))

    t = np.log(np.array(spreads, float))
    value, slope = look(t)
    for _ in range(200):
        free = np.flatnonzero((t > floor) | (slope > 0))
        if not len(free):
            break
        bend = np.array([(look(t + 1e-5 * np.eye(len(t))[i])[1] - slope) / 1e-5 for i in free])[:, free]
        values, vectors = np.linalg.eigh(-0.5 * (bend + bend.T))
        step = np.zeros(len(t))
        step[free] = np.clip(vectors @ ((vectors.T @ slope[free]) / np.maximum(np.abs(values), 0.05)), -2, 2)
        for _ in range(30):
            new = np.maximum(t + step, floor)
            new_value, new_slope = look(new)
            if new_value >= value - 1e-12 * max(1.0, abs(value)):
                break
            step = step / 2
        moved, t, value, slope = np.abs(new - t).max(), new, new_value, new_slope
        if moved < 1e-8:
            break
    return np.exp(t).tolist()


class Place(NamedTuple):
    """Parameters, shares of the monotonic effect, spreads of the groups and log spread of the latent outcome."""

    phi: np.ndarray
    z: np.ndarray
    spreads: list[float]
    scale: float


def _choleskied(matrix: np.ndarray) -> np.ndarray:
    np.linalg.cholesky(matrix)  # raises unless positive definite
    return matrix


def _bordered(matrix: np.ndarray, side: np.ndarray, corner: float) -> np.ndarray:
    return np.block([[matrix, side[:, None]], [side[None, :], np.array([[corner]])]])


class Picture:
    """The quadratic picture of the likelihood at a point, maximised with priors, spreads, scale and shares."""

    def __init__(self, structure: Structure, psi: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, damping: float,
                 spread_prior: float):
        self.s, self._prior_scale = structure, spread_prior
        self._unit = structure.unit(psi)
        bend = -curvature
        if damping:
            bend = bend + damping * np.diag(np.maximum(np.abs(np.diag(bend)), 1.0))
        self._bend, self._pull = bend, gradient + bend @ psi

    def _local(self, at: Place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value and pull of the picture at a place, with its slopes in the parameters."""
        psi, slopes = self.s.to_coefficients(at.phi, at.z, self._unit)
        return psi, slopes, self._pull - self._bend @ psi

    def _value(self, at: Place) -> float:
        psi, _ = self.s.to_coefficients(at.phi, at.z, self._unit)
        return float(self._pull @ psi - 0.5 * psi @ self._bend @ psi - self.s.penalty(at.phi, at.spreads, at.scale))

    def _parameters(self, at: Place, start: Place) -> Place:
        """Newton steps for the parameters and the scale, given all else, as long as they stay near the start of the pass."""
        n, stretch, fixed, value = self.s.parameters, self.s.stretch, self.s.unstretched, self._value(at)
        for _ in range(200):
            if self._beyond(at, start):
                break
            prior = self.s.precision(at.spreads, at.scale)
            away = at.phi - self.s.prior_mean(at.scale)
            _, slopes, pull = self._local(at)
            gradient = slopes.T @ pull - prior @ away
            plain = slopes.T @ self._bend @ slopes + prior
            full = plain - self.s.bend(at.phi, pull, at.z, self._unit)
            if stretch:
                grown = at.phi * (1 - fixed)
                gradient = np.r_[gradient, fixed @ prior @ away - grown @ prior @ grown]
                full = _bordered(full, 2 * prior @ grown - prior @ fixed, fixed @ prior @ fixed + 2 * grown @ prior @ grown)
                plain = _bordered(plain, prior @ grown - prior @ fixed, fixed @ prior @ fixed + grown @ prior @ grown)
            try:
                lhs = _choleskied(full)
            except np.linalg.LinAlgError:
                lhs = _choleskied(plain)
            step = np.linalg.solve(lhs, gradient)
            step /= max(1.0, np.abs(step[: self.s.items]).max(initial=0.0) / 2, np.abs(step[n:]).max(initial=0.0))
            for _ in range(40):
                new = at._replace(phi=at.phi + step[:n], scale=at.scale + float(step[n:].sum()))
                new_value = self._value(new)
                if new_value >= value - 1e-13 * abs(value):
                    break
                step = step / 2
            at, value = new, new_value
            if np.abs(step).max(initial=0.0) < 1e-10:
                break
        return at

    def _beyond(self, at: Place, start: Place) -> bool:
        """Whether discriminations have moved so far that the picture tells nothing: its slope dies away there, without a maximum."""
        return np.abs(at.phi - start.phi)[: self.s.items : self.s.curves.per_item].max(initial=0.0) > REACH

    def _spreads(self, at: Place) -> list[float]:
        free = [i for i, g in enumerate(self.s.groups) if g.free]
        if not free:
            return at.spreads
        _, slopes, pull = self._local(at)
        fixed = self.s.precision(at.spreads, fixed_only=True)
        data = slopes.T @ self._bend @ slopes - self.s.bend(at.phi, pull, at.z, self._unit)
        lhs, rhs = data + fixed, slopes.T @ pull + data @ at.phi
        own = np.concatenate([self.s.groups[i].at for i in free])
        rest = np.setdiff1d(np.arange(len(rhs)), own)
        small, small_rhs = lhs[np.ix_(own, own)], rhs[own]
        if len(rest):  # all other parameters are taken out once
            cross = np.linalg.solve(_choleskied(lhs[np.ix_(rest, rest)]), np.c_[lhs[np.ix_(rest, own)], rhs[rest]])
            small = small - lhs[np.ix_(own, rest)] @ cross[:, :-1]
            small_rhs = small_rhs - lhs[np.ix_(own, rest)] @ cross[:, -1]
        found = likeliest_spreads(small, small_rhs, [self.s.groups[i] for i in free], [at.spreads[i] for i in free], self._prior_scale)
        new = list(at.spreads)
        for i, spread in zip(free, found, strict=True):
            new[i] = spread
        return new

    def _shares(self, at: Place) -> np.ndarray:
        """Shares, with all other coefficients but the slopes free to follow."""
        s, others = self.s, np.r_[np.arange(self.s.slope_at), np.arange(self.s.parameters - self.s.spread, self.s.parameters)]
        psi, slopes, pull = self._local(at)
        a, b = slopes[:, others], s.to_steps(at.phi, self._unit)
        prior = s.precision(at.spreads, at.scale)[np.ix_(others, others)]
        gradient = a.T @ pull - prior @ (at.phi - s.prior_mean(at.scale))[others]
        cross = np.linalg.solve(_choleskied(a.T @ self._bend @ a + prior), np.c_[a.T @ self._bend @ b, gradient])
        inner = b.T @ self._bend @ b - (b.T @ self._bend @ a) @ cross[:, :-1]
        rhs = b.T @ pull - (b.T @ self._bend @ a) @ cross[:, -1] + inner @ at.z
        weight = 1e-9 * max(1.0, np.trace(inner))  # without any slope the shares stay where they are
        return simplex_programme(inner + weight * np.eye(s.steps), rhs + weight * at.z)

    def best(self, start: Place, near: float | None = 1.0, sweeps: int = 2_000) -> Place:
        """What is best given the rest, in turn, until nothing moves.

        Spreads move only if the mode is ``near``, in units of the log-likelihood, and at most by a factor e: farther
        away the picture does not tell deviations from distance. Without ``near`` they stay.
        """
        at = self._parameters(start, start)
        close = near is not None and self._value(at) - self._value(start) <= near
        for _ in range(sweeps):
            if self._beyond(at, start):
                break
            before = at
            if close:
                limits = [(s / np.e, s * np.e) for s in start.spreads]
                at = at._replace(spreads=[min(max(s, lo), hi) for s, (lo, hi) in zip(self._spreads(at), limits, strict=True)])
            at = self._parameters(at, start)
            if self.s.steps:
                at = at._replace(z=self._shares(at))
                at = self._parameters(at, start)
            if max(np.abs(at.phi - before.phi).max(initial=0.0), abs(at.scale - before.scale)) < 1e-8:
                break
        return at


@dataclass
class Estimate:
    """Parameters in units of the latent spread, shares, spreads of groups and log latent spread; ``cov`` is the covariance of
    parameters and log latent spread in their own units, then of the shares."""

    at: Place
    value: float  # log-likelihood
    gradient: np.ndarray  # of the log-likelihood, in coefficients
    passes: int
    cov: np.ndarray


def maximise(evidence: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], structure: Structure, start: np.ndarray, tol: float,
             max_passes: int, valid: Callable[[np.ndarray], bool], spread_prior: float = 5.0) -> Estimate:
    """Posterior mode by damped Newton steps; every step costs one pass over the data.

    A step that lowers the penalised likelihood is taken back and damped. The estimates are final when the next step
    would move no coefficient by more than ``tol`` and no spread by more than that part of it.
    """
    s = structure
    at = Place(start, np.full(s.steps, 1 / max(s.steps, 1)), [g.spread for g in s.groups], 0.0)
    psi, _ = s.to_coefficients(at.phi, at.z)
    value, gradient, curvature = evidence(psi)
    damping, passes = 0.0, 1
    lengths, last = np.ones(len(s.groups)), np.zeros(len(s.groups))
    while True:
        try:
            picture = Picture(s, psi, gradient, curvature, damping, spread_prior)
            new = picture.best(at)
            change = np.log(np.array(new.spreads) / at.spreads)
            if np.abs(change).max() > tol:
                # The curvature moves with the spreads: a secant step for each spread instead of the plain one.
                known = np.abs(last) > 0
                lengths = np.where(known, np.clip(lengths / np.where(known, 1 - change / np.where(known, last, 1), 1), 0.2, 4), 1.0)
                lengths[~np.isfinite(lengths)] = 1.0
                spreads = np.maximum(np.array(at.spreads) * np.exp(np.clip(lengths * change, -1, 1)), np.minimum(LEAST_SPREAD, at.spreads))
                new, last = picture.best(at._replace(spreads=spreads.tolist()), near=None), change
        except np.linalg.LinAlgError:
            if damping > 1e6:
                raise NotSettled("the curvature stays indefinite") from None
            damping = max(4 * damping, 1e-2)
            continue
        new_psi, _ = s.to_coefficients(new.phi, new.z)
        moved = max(np.abs(new.phi - at.phi).max(initial=0.0), np.abs(new_psi - psi).max(initial=0.0), abs(new.scale - at.scale),
                    np.abs(change).max())
        # A step is final only if the spreads could move in it, which they can near the mode.
        if moved <= tol and not damping:
            return Estimate(new, value, gradient, passes, covariance(s, new, gradient, curvature))
        if passes >= max_passes:
            raise NotSettled(f"estimates still move by {moved:.2g} after {passes} passes")
        if not valid(new_psi):
            damping = max(4 * damping, 1e-2)
            continue
        new_value, new_gradient, new_curvature = evidence(new_psi)
        passes += 1
        before = value - s.penalty(at.phi, new.spreads, at.scale)
        after = new_value - s.penalty(new.phi, new.spreads, new.scale)
        if not after >= before - 1e-9 * max(1.0, abs(before)):
            damping = max(4 * damping, 1e-2)
            continue
        at, psi, value, gradient, curvature = new, new_psi, new_value, new_gradient, new_curvature
        damping = damping / 8 if damping > 1e-3 else 0.0


def covariance(structure: Structure, at: Place, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Covariance of the parameters and the log latent spread, in their own units, and of the shares.

    From the curvature at the mode; zero for shares on the border, and for a latent spread that is not estimated.
    """
    s, n = structure, structure.parameters
    # Shares add up to one: the last one above zero gives way to the others.
    on = np.flatnonzero(at.z > 0)
    tangent = np.zeros((s.steps, max(len(on) - 1, 0)))
    if s.steps:
        tangent[on[:-1], np.arange(len(on) - 1)] = 1
        tangent[on[-1]] = -1
    free = tangent.shape[1]
    jacobian = np.c_[s.to_coefficients(at.phi, at.z)[1], s.to_steps(at.phi) @ tangent]
    info = np.zeros((n + 1 + free, n + 1 + free))
    likelihood = np.r_[np.arange(n), n + 1 + np.arange(free)]
    info[np.ix_(likelihood, likelihood)] = jacobian.T @ -curvature @ jacobian
    prior = s.precision(at.spreads, at.scale)
    info[:n, :n] += prior - s.bend(at.phi, gradient)
    fixed = s.unstretched
    if s.stretch:
        grown = at.phi * (1 - fixed)
        info[:n, n] = info[n, :n] = 2 * prior @ grown - prior @ fixed
        info[n, n] = fixed @ prior @ fixed + 2 * grown @ prior @ grown
    else:
        info[n, n] = 1.0
    # Slopes and shares multiply each other, so the gradient enters the curvature.
    if free:
        pull = s.steps * gradient[s.slope_at : s.slope_at + s.steps * s.step_cells].reshape(s.step_cells, s.steps) @ tangent
        rows = np.vstack([pull.sum(0), *([pull] if s.deviations else [])])
        info[s.slope_at : s.slope_at + len(rows), n + 1 :] -= rows
        info[n + 1 :, s.slope_at : s.slope_at + len(rows)] -= rows.T
    cov = np.linalg.inv(info)
    own_units = np.zeros((n + 1 + s.steps, n + 1 + free))
    own_units[:n, :n] = np.diag(np.where(fixed > 0, 1.0, np.exp(at.scale)))
    own_units[n + 1 :, n + 1 :] = tangent
    if s.stretch:
        own_units[n, n] = 1
        own_units[:n, n] = np.where(fixed > 0, -1.0, at.phi * np.exp(at.scale))
    return own_units @ cov @ own_units.T
