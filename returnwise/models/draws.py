"""Parameter uncertainty: posterior draws from Markov chains and per-customer intervals.

Chains run side by side (:mod:`returnwise.models.chains`): every job over the states brings all of
them several steps forward. The intervals describe how well the parameters are pinned down, not
what a customer will do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.models import chains, families, shipping  # noqa: F401  (registers the helpers)
from returnwise.models.fit import (
    Fit,
    ModelError,
    _log_prior,
    _log_scale_sums,
    _prior_center,
    count_histogram,
    log_likelihoods,
    spend_frame,
)
from returnwise.models.families import PARAMETERS
from returnwise.models.predict import STATE, spend_source_column
from returnwise.functions.numeric import log_gamma, log_rising, narrowest
from returnwise.session import materialise

MCMC = "mcmc"
MASS = 0.94
CHUNK = 256
#: Points the chains may start from, and the tails of their distribution (Student t).
PROPOSALS = 1024
PROPOSAL_TAILS = 4.0
#: Half the width, in logarithms, of a panel of spend scales, and the nodes it is known by.
PANEL_HALF, PANEL_NODES = 1.2, 25
#: Spend scales further than this from the optimum, in logarithms, have no posterior weight here.
SCALE_REACH = 14.0


@dataclass(frozen=True)
class Draws:
    """Parameter rows of one family, one per posterior draw."""

    fit: Fit
    points: np.ndarray
    effective: float = math.nan
    rhat: float = math.nan

    def mean(self) -> Fit:
        """The fit with the posterior means as its parameters."""
        means = map(float, self.points.mean(axis=0))
        return replace(self.fit, parameters=dict(zip(self.fit.parameters, means, strict=True)))

    def rows(self, source: str) -> list[tuple]:
        """``(source, draw_id, family, parameter, value)`` rows."""
        return [
            (source, i, self.fit.family, name, float(value))
            for i, row in enumerate(self.points)
            for name, value in zip(self.fit.parameters, row, strict=True)
        ]


def given(family: str, names: tuple[str, ...], points: np.ndarray) -> Draws:
    """Draws from a table of parameter rows, in the order of ``names``."""
    points = np.asarray(points, dtype=float)
    if points.ndim != 2 or points.shape[1] != len(names) or not len(points):
        raise ModelError(f"draws of {family} need rows of {', '.join(names)}.")
    means = dict(zip(names, map(float, points.mean(axis=0)), strict=True))
    return Draws(Fit(family, MCMC, means, float("nan"), 0, 0), points)


def _proposals(fit: Fit, generator: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Heavy-tailed points around the optimum, with the logarithm of their density."""
    center = np.log(np.array(fit.vector))
    values, vectors = np.linalg.eigh((fit.covariance + fit.covariance.T) / 2)
    standard = generator.standard_normal((PROPOSALS, center.size))
    tails = np.sqrt(PROPOSAL_TAILS / generator.chisquare(PROPOSAL_TAILS, (PROPOSALS, 1)))
    steps = standard * tails
    density = -(PROPOSAL_TAILS + center.size) / 2 * np.log1p((steps**2).sum(axis=1) / PROPOSAL_TAILS)
    return center + (steps * np.sqrt(np.maximum(values, 1e-12))) @ vectors.T, density


def _sampled(fit: Fit, target: chains.Target, count: int, seed: int) -> Draws:
    generator = np.random.default_rng(seed)
    starts = chains.overdispersed(target, *_proposals(fit, generator), generator)
    found = chains.sample(target, starts, generator, least_effective=max(chains.LEAST_EFFECTIVE, count))
    points = np.exp(found.draws(count, generator))
    return Draws(replace(fit, method=MCMC), points, found.effective, found.rhat)


def purchase_draws(states: DataFrame, fit: Fit, count: int = 200, seed: int = 42) -> Draws:
    """Posterior draws of a purchase model; each likelihood job serves all chains.

    Raises ``NotConverged`` where the chains don't come to agree: there are no intervals then.
    """
    histogram = count_histogram(states)
    mean_age = states.agg(F.sum(F.col("n") * F.col("T")) / F.sum("n")).first()[0]
    center = _prior_center(PARAMETERS[fit.family], float(mean_age))

    def target(logs: np.ndarray) -> np.ndarray:
        # Parameters beyond what a double's exponent holds have no weight under the prior.
        inside = (np.abs(logs - center) < 100.0).all(axis=1)
        result = np.full(len(logs), -np.inf)
        if inside.any():
            with np.errstate(all="ignore"):
                value = log_likelihoods(states, fit.family, np.exp(logs[inside]), histogram)
            result[inside] = value + _log_prior(center, logs[inside])
        return result

    return _sampled(fit, target, count, seed)


class _ScaleSums:
    """Sums of ln(1 + x z / v) and x ln(1 + x z / v) over customers, as functions of ln v.

    Both are smooth: a panel of scales is known everywhere from one job over its nodes. Panels are
    added as chains reach them.
    """

    def __init__(self, spend: DataFrame):
        self.spend, self.panels = spend, {}

    def __call__(self, log_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.floor(log_v / (2 * PANEL_HALF)).astype(int)
        a, b = np.empty(len(log_v)), np.empty(len(log_v))
        for panel in np.unique(number):
            here = number == panel
            fit_a, fit_b = self._panel(int(panel))
            a[here], b[here] = fit_a(log_v[here]), fit_b(log_v[here])
        return a, b

    def _panel(self, number: int):
        if number not in self.panels:
            middle = (2 * number + 1) * PANEL_HALF
            angles = np.pi * (np.arange(PANEL_NODES) + 0.5) / PANEL_NODES
            nodes = middle + PANEL_HALF * np.cos(angles)
            domain = [middle - PANEL_HALF, middle + PANEL_HALF]
            self.panels[number] = tuple(
                np.polynomial.Chebyshev.fit(nodes, sums, PANEL_NODES - 1, domain=domain)
                for sums in _log_scale_sums(self.spend, np.exp(nodes))
            )
        return self.panels[number]


def spend_draws(calibration: DataFrame, fit: Fit, count: int = 200, seed: int = 43) -> Draws:
    """Posterior draws of the spend model, from a few jobs in all.

    With q at or below one the mean order value is infinite: such parameters say nothing of revenue
    and have no weight.
    """
    spend = materialise(spend_frame(calibration))
    x, n = count_histogram(spend.groupBy("frequency").agg(F.count(F.lit(1)).alias("n")))
    frequency, z = F.col("frequency").cast("double"), F.col("monetary_value")
    x_log_z = spend.agg(F.sum(frequency * F.log(z)).alias("s")).first()["s"]
    x_log_x = float((n * x * np.log(x)).sum())
    sums, best = _ScaleSums(spend), math.log(fit.vector[2])

    def target(logs: np.ndarray) -> np.ndarray:
        inside = (
            (np.abs(logs[:, 2] - best) < SCALE_REACH) & (logs[:, 1] > 0.0)
            & (np.abs(logs) < 100.0).all(axis=1)
        )
        result = np.full(len(logs), -np.inf)
        if not inside.any():
            return result
        chosen = logs[inside]
        p, q = np.exp(chosen[:, [0]]), np.exp(chosen[:, [1]])
        a, b = sums(chosen[:, 2])
        shape = (log_rising(q, p * x) - log_gamma(p * x)) @ n
        value = (
            shape + p[:, 0] * (x_log_z + x_log_x - (n * x).sum() * chosen[:, 2])
            - p[:, 0] * b - q[:, 0] * a
        )
        result[inside] = value + _log_prior(np.zeros(2), chosen[:, :2])
        return result

    return _sampled(fit, target, count, seed)


def hdi(values: Column, mass: float = MASS) -> tuple[Column, Column]:
    """Narrowest interval over an array's sorted values that spans floor(mass * n) steps."""
    ordered = F.array_sort(values)
    steps = F.floor(F.size(values) * F.lit(mass)).cast("int")
    starts = F.sequence(F.lit(1), F.size(values) - steps)
    widths = F.transform(
        starts,
        lambda i: F.struct(
            (F.element_at(ordered, i + steps) - F.element_at(ordered, i)).alias("width"),
            i.alias("start"),
        ),
    )
    # The smallest struct is the smallest width, the earliest one among equals.
    start = F.array_min(widths)["start"]
    return F.element_at(ordered, start), F.element_at(ordered, start + steps)


def hdi_rows(values: np.ndarray, mass: float = MASS) -> tuple[np.ndarray, np.ndarray]:
    """:func:`hdi` of every column of ``values``."""
    return narrowest(values, mass)


_DRAWN = (
    "struct<expected_purchases:double, probability_alive:double, expected_avg_value:double, "
    "expected_forward_revenue:double, low:double, high:double>"
)


def predict_draws(
    calibration: DataFrame, purchase: Draws, spend: Draws, horizons: list[int]
) -> DataFrame:
    """Forecasts averaged over draws, with the interval of revenue.

    Purchases and order value are multiplied draw by draw, so the interval carries both. Each
    customer's draws live in one row of one Arrow batch and are never regrouped. A row costs
    hundreds of model evaluations, so the rows are spread by count over the cores first; splits
    by byte size would leave tasks of hours. Like customers go to the same task: what an active one
    will buy depends on count, age and horizon alone, the chance of being active on the state, and
    both are worked out once where rows of a batch share them.
    """
    family = purchase.fit.family
    count = min(len(purchase.points), len(spend.points))
    parameters = tuple(purchase.points[:count, [j]] for j in range(purchase.points.shape[1]))
    p, q, v = (spend.points[:count, [j]] for j in range(3))
    ahead, active, once_each = families.expected_if_active, families.probability_alive, families.once_each
    between = narrowest  # executors get it by value, with its module

    def drawn(
        x: pd.Series, tx: pd.Series, T: pd.Series, z: pd.Series, own: pd.Series, t: pd.Series
    ) -> pd.DataFrame:
        columns = [s.to_numpy(dtype=float) for s in (x, tx, T, z, t, own)]
        counts, last, age, mean, days, fitted = columns
        if_active, at_pair = once_each(lambda *c: ahead(family, parameters, *c), counts, age, days, most=CHUNK)
        chance, at_state = once_each(lambda *c: active(family, parameters, *c), counts, last, age, most=CHUNK)
        pieces = []
        # A few hundred customers at a time: the draws of a whole batch would not stay in cache.
        for start in range(0, len(x), CHUNK):
            here = slice(start, start + CHUNK)
            counts, mean, fitted = (c[here] for c in (columns[0], columns[3], columns[5]))
            alive = chance[:, at_state[here]]
            purchases = alive * if_active[:, at_pair[here]]
            individual = p * (v + counts * mean) / (p * counts + q - 1.0)
            value = np.where(fitted > 0, individual, p * v / (q - 1.0))
            revenue = purchases * value
            low, high = between(revenue, MASS)
            pieces.append(
                pd.DataFrame(
                    {
                        "expected_purchases": purchases.mean(axis=0),
                        "probability_alive": alive.mean(axis=0),
                        "expected_avg_value": value.mean(axis=0),
                        "expected_forward_revenue": revenue.mean(axis=0),
                        "low": low,
                        "high": high,
                    }
                )
            )
        return pd.concat(pieces, ignore_index=True)

    udf = F.pandas_udf(drawn, _DRAWN)
    spark = calibration.sparkSession
    tasks = max(
        4 * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    like = ["frequency", "customer_age", "recency"]
    spread = calibration.repartitionByRange(tasks, *like, "customer_id").sortWithinPartitions(*like)
    rows = spread.select(
        "source",
        "customer_id",
        *STATE,
        F.col("monetary_value").cast("double").alias("monetary_value"),
        "is_gamma_gamma_eligible",
        F.explode(F.array(*[F.lit(int(h)) for h in sorted(set(horizons))])).alias("horizon_days"),
    )
    evaluated = rows.withColumn(
        "_d", udf(*STATE, "monetary_value", "is_gamma_gamma_eligible", "horizon_days")
    )
    return evaluated.select(
        "source",
        "customer_id",
        "horizon_days",
        F.col("_d.expected_purchases").alias("expected_purchases"),
        F.col("_d.probability_alive").alias("probability_alive"),
        F.col("_d.expected_avg_value").alias("expected_avg_value"),
        F.col("_d.expected_forward_revenue").alias("expected_forward_revenue"),
        F.col("_d.low").alias("forward_revenue_hdi_low"),
        F.col("_d.high").alias("forward_revenue_hdi_high"),
        spend_source_column().alias("spend_estimate_source"),
        "is_gamma_gamma_eligible",
        F.lit(MCMC).alias("fit_method"),
    ).select(*schemas.PREDICTIONS.names)
