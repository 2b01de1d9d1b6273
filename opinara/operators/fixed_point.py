"""Accelerated iteration of an estimation step to its fixed point."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

Step = Callable[[np.ndarray], tuple[np.ndarray, float]]


class NotSettled(RuntimeError):
    """Raised instead of handing out estimates of an unfinished iteration."""


def settle(step: Step, start: np.ndarray, tol: float, max_iter: int,
           valid: Callable[[np.ndarray], bool] = lambda x: True, depth: int = 8) -> tuple[np.ndarray, float, int]:
    """Fixed point of ``step``, the objective there, and the number of steps taken.

    ``step(x)`` gives the next estimate and the objective at ``x``. Each step costs a pass over the
    data, so the last steps are combined: the mixture of them whose remaining moves cancel best is
    tried next. A mixture that lowers the objective or leaves the valid range is dropped in favour of
    the plain step, which cannot do either. The iteration ends when a step moves no parameter by more
    than ``tol``, that is, when the gradient vanishes; otherwise it raises.
    """
    x, plain, best = start, None, -np.inf
    moves: deque[np.ndarray] = deque(maxlen=depth)
    images: deque[np.ndarray] = deque(maxlen=depth)
    for turn in range(1, max_iter + 1):
        image, value = step(x)
        if plain is not None and not value >= best - 1e-9 * max(1.0, abs(best)):
            x, plain = plain, None
            moves.clear()
            images.clear()
            continue
        move = image - x
        if np.abs(move).max(initial=0.0) <= tol:
            return image, value, turn
        best = max(best, value)
        moves.append(move)
        images.append(image)
        x, plain = image, None
        if len(moves) > 1:
            change = np.diff(np.stack(moves), axis=0).T
            mix = np.linalg.lstsq(change, move, rcond=1e-10)[0]
            mixed = image - np.diff(np.stack(images), axis=0).T @ mix
            if np.isfinite(mixed).all() and valid(mixed):
                x, plain = mixed, image
    raise NotSettled(f"estimates still move by more than {tol} after {max_iter} steps")
