"""A damped Newton search whose function values come from Spark jobs.

One call of ``evaluate`` is one job, whatever the number of points in it, so a step sends the whole
finite-difference stencil of its preferred candidate and a few shorter candidates together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

STEP = 1e-2  # finite-difference step on the (log) parameters
LONGEST = 2.0  # longest move of one parameter in one step
#: Curvatures below this share of the largest are lost in the rounding of the differences.
FLATTEST = 1e-9
#: Dampings tried beside the current one, as shares of the largest curvature. A curved ridge has
#: curvatures many powers of ten apart, so the ladder spans them all.
LADDER = tuple(10.0**k for k in range(-9, 2))


class NotConverged(RuntimeError):
    """The search used up its jobs."""


@dataclass(frozen=True)
class Optimum:
    point: np.ndarray
    value: float
    curvature: np.ndarray  # minus the Hessian at the optimum
    jobs: int


def _directions(k: int) -> np.ndarray:
    """The axes, then the sums of two of them: what a quadratic form is known by."""
    eye = np.eye(k)
    pairs = [eye[i] + eye[j] for i in range(k) for j in range(i)]
    return np.vstack([eye, *[p[None, :] for p in pairs]])


def _stencil(center: np.ndarray) -> np.ndarray:
    """The point, then one and two steps either way along every direction."""
    steps = STEP * _directions(center.size)
    return center + np.vstack([np.zeros((1, center.size)), steps, -steps, 2 * steps, -2 * steps])


def _derivatives(values: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian, to the fourth order of the step.

    On a ridge the curvatures lie a million times apart. The second-order error of a plain central
    difference is then more than the gradient along the ridge: it has its zero beside the optimum,
    and a search that promises little there gains by values that it does not go to.
    """
    base, sides = values[0], (values[1:] - values[0]).reshape(4, -1)
    up, down, far_up, far_down = sides
    slope = (8 * (up - down) - (far_up - far_down)) / (12 * STEP)
    bend = (16 * (up + down) - (far_up + far_down)) / (12 * STEP**2)
    gradient, hessian = slope[:k], np.diag(bend[:k])
    # Along the sum of two axes the bend is both their own and twice the mixed one.
    along = iter(bend[k:])
    for i in range(k):
        for j in range(i):
            hessian[i, j] = hessian[j, i] = (next(along) - bend[i] - bend[j]) / 2
    return base, gradient, hessian


def _step(gradient: np.ndarray, hessian: np.ndarray, damping: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(-hessian)
    floor = FLATTEST * (1.0 + np.abs(values).max())
    step = vectors @ ((vectors.T @ gradient) / (np.maximum(np.abs(values), floor) + damping))
    longest = np.abs(step).max()
    return step * min(1.0, LONGEST / longest) if longest > 0 else step


def maximise(
    evaluate: Callable[[np.ndarray], np.ndarray],
    start: np.ndarray,
    tolerance: float,
    most_jobs: int = 60,
) -> Optimum:
    """Maximise; stops when a full step promises less than ``tolerance``."""
    k = start.size
    center = np.asarray(start, dtype=float)
    values = evaluate(_stencil(center))
    jobs, damping = 1, 0.0
    while True:
        base, gradient, hessian = _derivatives(values, k)
        if not (np.isfinite(gradient).all() and np.isfinite(hessian).all()):
            raise NotConverged("the objective is not finite around the search point")
        scale = np.abs(np.linalg.eigvalsh(hessian)).max() + 1e-12
        promised = 0.5 * float(gradient @ _step(gradient, hessian, 0.0))
        if promised < tolerance:
            return Optimum(center, base, -hessian, jobs)
        if jobs >= most_jobs:
            raise NotConverged(f"no optimum within {most_jobs} evaluations")
        ladder = [d for d in LADDER if d != damping]
        main = center + _step(gradient, hessian, damping * scale)
        others = [center + _step(gradient, hessian, d * scale) for d in ladder]
        stencil = _stencil(main)
        got = evaluate(np.vstack([stencil, *[s[None, :] for s in others]]))
        jobs += 1
        candidates = np.concatenate([got[:1], got[len(stencil) :]])
        candidates = np.where(np.isfinite(candidates), candidates, -np.inf)
        best = int(candidates.argmax())
        if candidates[best] <= base:
            # Rounding can hide the last improvement of an already flat optimum.
            if promised < 1e3 * tolerance:
                return Optimum(center, base, -hessian, jobs)
            raise NotConverged("no step of any length improves on the search point")
        if best == 0:
            center, values = main, got[: len(stencil)]
            damping = damping / 10 if damping > LADDER[0] else 0.0
        else:
            # The damping that won is the next step's first choice.
            center, damping = others[best - 1], ladder[best - 1]
            values = evaluate(_stencil(center))
            jobs += 1
