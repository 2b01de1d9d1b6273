"""Item-response expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def inv_logit(x: Column | str) -> Column:
    """Inverse logit in the form that neither overflows nor turns into NaN for large ``x``."""
    return 1.0 / (1.0 + F.exp(-_col(x)))


def irf(alpha, beta, theta=0.0, eta=0.0, sign: int = 1) -> Column:
    """Two-parameter response probability ``inv_logit(alpha * (theta + sign * beta + eta))``.

    ``sign=-1`` reads ``beta`` as difficulty, ``sign=+1`` as easiness.
    """
    return inv_logit(_col(alpha) * (_col(theta) + sign * _col(beta) + _col(eta)))


def linear_predictor(xs: Sequence, bs: Sequence) -> Column:
    """Sum of products of covariates and coefficients."""
    return reduce(lambda a, b: a + b, (_col(x) * _col(b) for x, b in zip(xs, bs, strict=True)))


def monotonic(shares: Column, x: Column | str, variant: str = "model") -> Column:
    """Monotonic transform of an ordinal predictor ``x`` (1-based) from simplex shares.

    ``model`` scales the running share by the number of steps, which is what the fitted model
    means; ``steps`` scales it by ``x - 1``, which is what some prediction scripts compute. The two
    agree at both ends of the scale only.
    """
    level = _col(x)
    done = F.aggregate(F.slice(shares, F.lit(1), level - 1), F.lit(0.0), lambda a, s: a + s)
    scale = F.size(shares) if variant == "model" else level - 1
    return scale.cast("double") * done
