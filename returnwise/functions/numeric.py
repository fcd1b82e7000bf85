"""Special functions over numpy arrays: log-gamma, the Gauss series and Student's t."""

from __future__ import annotations

import math

import numpy as np

# Coefficients of the Stirling series of ln Gamma, B(2k) / (2k (2k - 1)).
STIRLING = (
    1.0 / 12.0,
    -1.0 / 360.0,
    1.0 / 1260.0,
    -1.0 / 1680.0,
    1.0 / 1188.0,
    -691.0 / 360360.0,
    1.0 / 156.0,
)


def log_gamma(x):
    """ln Gamma(x) for x > 0: shift the argument above 12, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shifts = np.maximum(0.0, np.ceil(12.0 - x))
    correction = np.zeros_like(x)
    for k in range(int(shifts.max(initial=0.0))):
        correction = correction + np.where(k < shifts, np.log(np.where(k < shifts, x + k, 1.0)), 0.0)
    y = x + shifts
    tail = np.zeros_like(y)
    inverse = 1.0 / y
    square = inverse * inverse
    power = inverse
    for coefficient in STIRLING:
        tail = tail + coefficient * power
        power = power * square
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2.0 * math.pi) + tail - correction


def log_rising(base, y):
    """ln of Gamma(base + y) / Gamma(base) for y >= 0, to the digits of the difference.

    For a large base both gammas are many times their quotient; their Stirling series are
    subtracted term by term instead.
    """
    base, y = np.broadcast_arrays(np.asarray(base, dtype=float), np.asarray(y, dtype=float))
    large = base > 12.0
    low = np.where(large, base, 13.0)
    high = low + y
    difference = (low - 0.5) * np.log1p(y / low) + y * np.log(high) - y
    powers, ratio = (1.0 / high, 1.0 / low), (1.0 / high**2, 1.0 / low**2)
    for coefficient in STIRLING:
        difference = difference + coefficient * (powers[0] - powers[1])
        powers = (powers[0] * ratio[0], powers[1] * ratio[1])
    near = np.where(large, 1.0, base)
    return np.where(large, difference, log_gamma(near + y) - log_gamma(near))


#: Above this argument the power series is too slow and the integral takes over.
NEAR_ONE = 0.95
_NODE = np.arange(-9.0, 4.5, 1.0 / 64.0)


def gauss_one(b, c, z):
    """Gauss hypergeometric 2F1(1, b; c; z) for 0 <= z < 1 and c > 1, near one by its integral.

    With u the (c-1)-th power of the distance from the end, Euler's integral is the mean of
    (1 - z + z u^(1/(c-1)))^(-b) over u in (0, 1); the double exponential rule takes its end point.
    """
    b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(b, c, z))
    out = np.empty(z.shape)
    near = z > NEAR_ONE
    out[~near] = gauss_series(1.0, b[~near], c[~near], z[~near])
    if near.any():
        # log u and the rule's weights; the far ends underflow to nothing.
        reach = np.pi * np.sinh(_NODE)
        log_u = -np.logaddexp(0.0, -reach)
        log_weight = log_u - np.logaddexp(0.0, reach) + np.log(np.pi * np.cosh(_NODE) / 64.0)
        flat_b, flat_c, flat_z = b[near], c[near], z[near]
        got = np.empty(flat_b.size)
        for i in range(0, flat_b.size, 2048):
            own = slice(i, i + 2048)
            base = np.log((1.0 - flat_z[own, None]) + flat_z[own, None] * np.exp(log_u / (flat_c[own, None] - 1.0)))
            got[own] = np.exp(log_weight - flat_b[own, None] * base).sum(axis=1)
        out[near] = got
    return out


def gauss_series(a, b, c, z, tolerance: float = 1e-14, most: int = 20_000):
    """Gauss hypergeometric 2F1(a, b; c; z) for 0 <= z < 1 by its power series.

    Entries leave the loop as soon as their own terms have become negligible; if one has not after
    ``most`` terms, that is an error.
    """
    a, b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, c, z))
    shape = z.shape
    a, b, c, z = (v.ravel() for v in (a, b, c, z))
    total = np.ones_like(z)
    live = np.arange(z.size)
    term = np.ones_like(z)
    la, lb, lc, lz = a, b, c, z
    for n in range(most):
        term = term * ((la + n) * (lb + n) / ((lc + n) * (n + 1.0)) * lz)
        total[live] += term
        # Once past the largest term the rest is a geometric tail with ratio near z.
        going = np.abs(term) > tolerance * np.abs(total[live]) * (1.0 - lz)
        if not going.all():
            live, term = live[going], term[going]
            la, lb, lc, lz = la[going], lb[going], lc[going], lz[going]
            if live.size == 0:
                break
    if live.size:
        raise ArithmeticError(f"2F1 has not converged within {most} terms at z = {lz.max()}")
    return total.reshape(shape)


def narrowest(values, mass: float):
    """Ends of the narrowest interval over each column's sorted values that spans floor(mass * n) steps."""
    ordered = np.sort(values, axis=0)
    steps = int(np.floor(len(values) * mass))
    with np.errstate(invalid="ignore"):
        widths = ordered[steps:] - ordered[: len(values) - steps]
    start = np.where(np.isnan(widths), np.inf, widths).argmin(axis=0)
    at = np.arange(values.shape[1])
    return ordered[start, at], ordered[start + steps, at]


def log_add(first, second):
    """ln(e^first + e^second), either of which may be -inf."""
    return np.logaddexp(first, second)


def _log_beta_tail(a: float, b: float, x: float) -> float:
    """ln of the regularised incomplete beta I_x(a, b), by its continued fraction (Lentz)."""
    if x <= 0.0:
        return -math.inf
    if x >= 1.0:
        return 0.0
    front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        other = math.exp(_log_beta_tail(b, a, 1.0 - x))
        return math.log1p(-other) if other < 1.0 else -math.inf
    tiny = 1e-300
    fraction, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / (c if abs(c) > tiny else tiny)
        fraction *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front - math.log(a) + math.log(fraction - 1.0)


def correlation_p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation through Student's t with n - 2 degrees of freedom."""
    if rho is None or n is None or n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    freedom = n - 2
    return math.exp(_log_beta_tail(freedom / 2.0, 0.5, 1.0 - rho * rho))
