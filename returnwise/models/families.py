"""The published purchase-count models, as vector functions of the customer state.

``x`` is the repeat count, ``tx`` the age at the last purchase, ``T`` the observed age. Parameter
arrays have the parameter axis first: a kernel given parameters of shape (P, 1) and states of
shape (n,) returns (P, n).

BG/NBD: Fader, Hardie and Lee (2005). MBG/NBD: Batislam, Denizel and Filiztekin (2007).
Pareto/NBD: Schmittlein, Morrison and Colombo (1987), in the form of Fader and Hardie (2005).
"""

from __future__ import annotations

import numpy as np

from returnwise.functions.numeric import gauss_one, gauss_series, log_add, log_rising

BG_NBD = "bg_nbd"
MBG_NBD = "mbg_nbd"
PARETO_NBD = "pareto_nbd"

# Parameter names of each family, in the order the vectors use.
PARAMETERS = {
    BG_NBD: ("r", "alpha", "a", "b"),
    MBG_NBD: ("r", "alpha", "a", "b"),
    PARETO_NBD: ("r", "alpha", "s", "beta"),
}


# ---- the part of ln L that depends on the repeat count alone ---------------------------------


def count_term(family: str, p: tuple, x):
    """ln L without its date-dependent factor; summed over the histogram of repeat counts.

    The powers of the scales, alpha^r and beta^s, are left to the date-dependent factor. They nearly
    cancel there: of customers who buy alike r is so large that their sums apart lose all digits.
    """
    if family == PARETO_NBD:
        r, alpha, s, beta = p
        return log_rising(r, x)
    r, alpha, a, b = p
    shared = log_rising(r, x)
    # A survivor of x purchase opportunities; the modified model also draws before the first.
    draws = x + 1.0 if family == MBG_NBD else x
    return shared + log_rising(b, draws) - log_rising(a + b, draws)


# ---- the date-dependent part ------------------------------------------------------------------


def _pareto_dropout(p: tuple, x, tx, T):
    """ln of (s / g) * A0, the term for a customer lost between the last purchase and now."""
    r, alpha, s, beta = p
    shape = np.broadcast_shapes(*(np.shape(v) for v in (x, tx, T)))
    x, tx, T = (np.broadcast_to(v, shape).ravel() for v in (x, tx, T))
    high, low = np.maximum(alpha, beta), np.minimum(alpha, beta)

    def log_f(x, u):
        g = r + s + x
        # Euler's transformation of the published series leaves one whose terms fall as n^(-s-1).
        second = np.where(alpha >= beta, s, r + x - 1.0)
        w = (high - low) / (high + u)
        # 2F1(g, m+1; g+1; w) = (1-w)^(-m) 2F1(1, g-m; g+1; w)
        series = gauss_one(g - second, g + 1.0, w)
        # (1-w)^(-m) (high + u)^(-g) by the two scales, their powers taken out as count_term says.
        powers = np.where(
            alpha >= beta, x * np.log(alpha + u), (x - 1.0) * np.log(alpha + u) + np.log(beta + u)
        )
        return np.log(series) - r * np.log1p(u / alpha) - s * np.log1p(u / beta) - powers

    # The series knows a count and one date: far fewer pairs than there are states of two dates.
    pairs, at = np.unique(np.concatenate([x + 1j * tx, x + 1j * T]), return_inverse=True)
    table = log_f(pairs.real, pairs.imag)
    early, late = table[..., at[: x.size]], table[..., at[x.size :]]
    gap = np.minimum(late - early, 0.0)
    with np.errstate(divide="ignore"):
        difference = early + np.log(-np.expm1(gap))
    lost = np.log(s / (r + s + x)) + difference
    return lost if shape else lost[..., 0]


def _alive_and_lost(family: str, p: tuple, x, tx, T):
    """ln of the two date-dependent factors: still active at T, and lost before T.

    Both with the powers of the scales that :func:`count_term` leaves out.
    """
    if family == PARETO_NBD:
        r, alpha, s, beta = p
        alive = -r * np.log1p(T / alpha) - x * np.log(alpha + T) - s * np.log1p(T / beta)
        return alive, _pareto_dropout(p, x, tx, T)
    return _alive(p, x, T), _lost(family, p, x, tx)


def _alive(p: tuple, x, T):
    """The first factor of the two families that lose customers at purchases."""
    r, alpha, a, b = p
    return -r * np.log1p(T / alpha) - x * np.log(alpha + T)


def _lost(family: str, p: tuple, x, tx):
    """The second factor of the same: lost at the last purchase."""
    r, alpha, a, b = p
    late = r * np.log1p(tx / alpha) + x * np.log(alpha + tx)
    if family == BG_NBD:
        odds = np.log(a) - np.log(np.where(x > 0, b + x - 1.0, 1.0))
        return np.where(x > 0, odds - late, -np.inf)
    return np.log(a) - np.log(b + x) - late


def state_term(family: str, p: tuple, x, tx, T):
    """ln of (alive + lost): the only part of ln L that needs the full state."""
    return log_add(*_alive_and_lost(family, p, x, tx, T))


#: Parameter rows and states whose terms are summed at a time: their tables stay in cache.
POINTS_AT_ONCE, STATES_AT_ONCE = 128, 256


def state_totals(family: str, points: np.ndarray, x, tx, T, n):
    """:func:`state_term` summed over states with counts ``n``, for every parameter row.

    Where each of the two factors knows the count and one date alone, they are worked out once per
    such pair, of which the calendar has far fewer than there are states; a state then costs one
    exponential and one logarithm.
    """
    if family == PARETO_NBD:
        return state_term(family, tuple(points[:, [j]] for j in range(points.shape[1])), x, tx, T) @ n
    ages, at_age = np.unique(np.stack([x, T]), axis=1, return_inverse=True)
    lasts, at_last = np.unique(np.stack([x, tx]), axis=1, return_inverse=True)
    at_age, at_last = at_age.ravel(), at_last.ravel()
    held = np.bincount(at_age, weights=n, minlength=ages.shape[1])
    totals = np.empty(len(points))
    with np.errstate(all="ignore"):
        for first in range(0, len(points), POINTS_AT_ONCE):
            rows = points[first : first + POINTS_AT_ONCE]
            p = tuple(rows[None, :, j] for j in range(rows.shape[1]))
            alive = _alive(p, *ages[:, :, None])
            lost = _lost(family, p, *lasts[:, :, None])
            total = held @ alive
            for start in range(0, len(x), STATES_AT_ONCE):
                own = slice(start, start + STATES_AT_ONCE)
                gap = lost[at_last[own]]
                gap -= alive[at_age[own]]
                total += n[own] @ np.maximum(gap, 0.0)
                np.abs(gap, out=gap)
                np.negative(gap, out=gap)
                np.exp(gap, out=gap)
                gap += 1.0
                total += n[own] @ np.log(gap, out=gap)
            totals[first : first + POINTS_AT_ONCE] = total
    # Where a factor vanishes the difference above has no value; its sum may have one.
    odd = np.flatnonzero(~np.isfinite(totals))
    if odd.size:
        totals[odd] = state_term(family, tuple(points[odd][:, [j]] for j in range(points.shape[1])), x, tx, T) @ n
    return totals


def once_each(kernel, *columns, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``kernel`` of the distinct rows among ``columns``, along its last axis, and each row's place there."""
    distinct, at = np.unique(np.stack(columns), axis=1, return_inverse=True)
    parts = [kernel(*distinct[:, i : i + most]) for i in range(0, distinct.shape[1], most)]
    return np.concatenate(parts, axis=-1), at.ravel()


def log_likelihood(family: str, p: tuple, x, tx, T):
    return count_term(family, p, x) + state_term(family, p, x, tx, T)


# ---- forecasts --------------------------------------------------------------------------------


def probability_alive(family: str, p: tuple, x, tx, T):
    alive, lost = _alive_and_lost(family, p, x, tx, T)
    return 1.0 / (1.0 + np.exp(np.minimum(lost - alive, 700.0)))


def _away_from_one(a):
    """``a`` moved off the removable singularity at one by less than the result's precision."""
    return np.where(np.abs(a - 1.0) < 1e-7, 1.0 + 1e-7, a)


def expected_purchases(family: str, p: tuple, x, tx, T, horizon):
    """Expected purchases in the next ``horizon`` days given the state."""
    return probability_alive(family, p, x, tx, T) * expected_if_active(family, p, x, T, horizon)


def expected_if_active(family: str, p: tuple, x, T, horizon):
    """The same of a customer known to be active, whenever the last purchase was."""
    if family == PARETO_NBD:
        r, alpha, s, beta = p
        s1 = _away_from_one(s) - 1.0
        shrink = -np.expm1(-s1 * np.log1p(horizon / (beta + T)))
        return (r + x) * (beta + T) / ((alpha + T) * s1) * shrink
    r, alpha, a, b = p
    a = _away_from_one(a)
    z = horizon / (alpha + T + horizon)
    # The modified model has one draw more behind it at every count.
    c = a + b + x - (1.0 if family == BG_NBD else 0.0)
    first = a + b - r - (1.0 if family == BG_NBD else 0.0)
    series = gauss_series(first, a - 1.0, c, z)
    return c / (a - 1.0) * (1.0 - np.power(1.0 - z, a - 1.0) * series)


def expected_new_purchases(p: tuple, age):
    """BG/NBD expected repeat purchases of a new customer over ``age`` days."""
    r, alpha, a, b = p
    a = _away_from_one(a)
    z = age / (alpha + age)
    # Euler's transformation of 2F1(r, b; a+b-1; z) (alpha / (alpha + age))^r.
    series = gauss_series(a + b - 1.0 - r, a - 1.0, a + b - 1.0, z)
    return (a + b - 1.0) / (a - 1.0) * (1.0 - np.power(1.0 - z, a - 1.0) * series)
