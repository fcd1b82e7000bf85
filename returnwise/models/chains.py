"""Markov chains side by side, for targets whose every evaluation is a distributed job.

Chains are Metropolis walkers. A move adds the scaled difference of two points of an archive
(differential evolution), so scale and correlation of the steps come from the posterior itself.
Given the archive, moves do not depend on where a chain stands. A job can therefore evaluate all
points that a few moves may lead to, every sum of some of them, for all chains at once: each job
brings every chain several exact steps forward.

The archive is rebuilt from the chains while they warm up and frozen afterwards. What is kept comes
from independent chains with a fixed symmetric proposal; their agreement (R-hat over halves of
chains) and their effective size decide when to stop. Chains that do not get there are an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from returnwise.models.optimizer import NotConverged

WALKERS = 64
#: Moves whose outcomes one job evaluates: 2**MOVES - 1 points for each chain.
MOVES = 4
#: Jobs after which the archive is rebuilt, or the stop rule is looked at.
BLOCK = 6
#: Blocks before the archive may freeze, and the most there are before and after it.
LEAST_WARM_UP, MOST_WARM_UP, MOST_BLOCKS = 3, 30, 150
#: Stop rule: largest R-hat, least effective draws, autocorrelation times that chains must span.
LARGEST_RHAT = 1.05
LEAST_EFFECTIVE = 400
LEAST_SPAN = 5.0
#: Rate of moves by a whole difference, which lead from one mode to another, and of short ones,
#: which follow bent ridges.
WHOLE_MOVES, SHORT_MOVES = 0.1, 0.3
SHORT = 0.25

Target = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Sample:
    """Kept states (steps, chains, parameters) and what the stop rule saw of them."""

    states: np.ndarray
    rhat: float
    effective: float
    jobs: int
    accepted: float

    def draws(self, count: int, generator: np.random.Generator) -> np.ndarray:
        """``count`` states, spread evenly over steps and at random over chains."""
        steps, chains, _ = self.states.shape
        at = np.linspace(0, steps - 1, count).round().astype(int)
        order = np.concatenate([generator.permutation(chains) for _ in range(-(-count // chains))])
        return self.states[at, order[:count]]


def rhat(states: np.ndarray) -> float:
    """The largest split R-hat over parameters: halves of chains against each other."""
    half = len(states) // 2
    if half < 2:
        return np.inf
    parts = np.concatenate([states[:half], states[-half:]], axis=1)
    within = parts.var(axis=0, ddof=1).mean(axis=0)
    between = parts.mean(axis=0).var(axis=0, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.sqrt(np.where(within > 0, (half - 1) / half + between / within, np.inf)).max())


def autocorrelation_time(states: np.ndarray) -> float:
    """The longest integrated autocorrelation time over parameters, about the mean of all chains."""
    steps = len(states)
    centred = states - states.mean(axis=(0, 1))
    padded = np.fft.rfft(centred, n=2 * steps, axis=0)
    products = np.fft.irfft(padded * padded.conj(), axis=0)[:steps].mean(axis=1)
    variance = products[0] / steps
    longest = 1.0
    for j in range(states.shape[2]):
        if not variance[j] > 0:
            return np.inf
        rho = products[:, j] / (steps - np.arange(steps)) / variance[j]
        times = 2.0 * np.cumsum(rho) - 1.0
        # The sum stops where it has covered five times what it comes to.
        enough = np.flatnonzero(np.arange(steps) >= 5.0 * times)
        longest = max(longest, float(times[enough[0]] if enough.size else times.max()))
    return longest


def overdispersed(
    target: Target, proposals: np.ndarray, proposal_logs: np.ndarray, generator: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Starting points: proposals chosen by flattened importance weights, none twice.

    The weights are flattened until they are worth as many points as there are chains, so starts lie
    where the posterior has weight but wider than it.
    """
    values = target(proposals)
    weights = np.where(np.isfinite(values), values - proposal_logs, -np.inf)
    usable = np.isfinite(weights)
    if usable.sum() < WALKERS:
        raise ArithmeticError("too few proposals lie where the posterior has any weight")
    flat = 1.0
    while True:
        scaled = np.exp(flat * (weights - weights[usable].max()))
        worth = scaled.sum() ** 2 / (scaled**2).sum()
        if worth >= min(WALKERS, 0.5 * usable.sum()) or flat < 1e-6:
            break
        flat *= 0.8
    scaled = np.where(usable, np.maximum(scaled, 1e-12), 0.0)
    picks = generator.choice(len(values), size=WALKERS, replace=False, p=scaled / scaled.sum())
    return proposals[picks], values[picks]


def _advance(
    target: Target, points: np.ndarray, values: np.ndarray, archive: np.ndarray,
    generator: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray]:
    """``MOVES`` steps of every chain from one evaluation; returns states by step, and last values."""
    chains, size = points.shape
    pick = generator.integers(0, len(archive), (2, chains, MOVES))
    pick[1] = np.where(pick[0] == pick[1], (pick[1] + 1) % len(archive), pick[1])
    scale = 2.38 / np.sqrt(2.0 * size) * np.exp(0.3 * generator.standard_normal((chains, MOVES, 1)))
    kind = generator.random((chains, MOVES, 1))
    scale = np.where(kind < WHOLE_MOVES, 1.0, np.where(kind > 1 - SHORT_MOVES, SHORT * scale, scale))
    moves = scale * (archive[pick[0]] - archive[pick[1]])
    moves += 1e-6 * generator.standard_normal(moves.shape)
    # Every sum of some moves: the places where a chain can be after them.
    chosen = (np.arange(1 << MOVES)[:, None] >> np.arange(MOVES)) & 1
    reach = points[:, None, :] + np.einsum("sm,cmp->csp", chosen, moves)
    logs = np.empty((chains, 1 << MOVES))
    logs[:, 0] = values
    fresh = target(reach[:, 1:].reshape(-1, size)).reshape(chains, -1)
    logs[:, 1:] = np.where(np.isfinite(fresh), fresh, -np.inf)
    at, every = np.zeros(chains, dtype=int), np.arange(chains)
    states = np.empty((MOVES, chains, size))
    for step in range(MOVES):
        ahead = at | (1 << step)
        gain = logs[every, ahead] - logs[every, at]
        at = np.where(np.log(generator.random(chains)) < gain, ahead, at)
        states[step] = reach[every, at]
    return states, logs[every, at]


def sample(
    target: Target, starts: tuple[np.ndarray, np.ndarray], generator: np.random.Generator,
    least_effective: int = LEAST_EFFECTIVE,
) -> Sample:
    """Run chains from ``starts`` until they agree and are worth ``least_effective`` draws.

    Raises :class:`NotConverged` where they do not within the blocks allowed; a shorter or a
    disagreeing sample is never returned.
    """
    points, values = starts
    archive, jobs = points, 0

    def block() -> np.ndarray:
        nonlocal points, values, jobs
        made = []
        for _ in range(BLOCK):
            states, values = _advance(target, points, values, archive, generator)
            points = states[-1]
            made.append(states)
            jobs += 1
        return np.concatenate(made)

    # Warm up until the chains of a block are no longer where those before it were.
    before = None
    for number in range(MOST_WARM_UP):
        made = block()
        settled = before is not None and _alike(before, made)
        before, archive = made, made[:: MOVES].reshape(-1, points.shape[1])
        if settled and number + 1 >= LEAST_WARM_UP:
            break
    else:
        raise NotConverged(f"the chains had not settled after {jobs} evaluations")

    kept: list[np.ndarray] = []
    for _ in range(MOST_BLOCKS):
        kept.append(block())
        states = np.concatenate(kept)
        time = autocorrelation_time(states)
        effective = states.shape[0] * states.shape[1] / time
        agreement = rhat(states)
        if (
            agreement <= LARGEST_RHAT and effective >= least_effective
            and len(states) >= LEAST_SPAN * time
        ):
            moved = (np.diff(states, axis=0) != 0).any(axis=2).mean()
            return Sample(states, agreement, float(effective), jobs, float(moved))
    raise NotConverged(
        f"after {jobs} evaluations the chains are worth {effective:.0f} draws at R-hat {agreement:.3f}"
    )


def _alike(before: np.ndarray, after: np.ndarray) -> bool:
    """Whether two blocks cover the same ground: means within a third of a spread, spreads alike."""
    a, b = (x.reshape(-1, x.shape[2]) for x in (before, after))
    spread = np.maximum(a.std(axis=0), b.std(axis=0))
    if not (spread > 0).all():
        return False
    near = np.abs(a.mean(axis=0) - b.mean(axis=0)) <= spread / 3
    ratio = a.std(axis=0) / b.std(axis=0)
    return bool((near & (ratio > 0.7) & (ratio < 1.4)).all())
