"""Fitting: assumption checks, distributed likelihood sums and the search over them.

What leaves the cluster in one evaluation is one number per parameter set; the histogram of repeat
counts is the only other thing collected, and a customer cannot have more occasions than the
window has days.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.functions.numeric import log_gamma, log_rising
from returnwise.models import families, shipping  # noqa: F401  (registers the helpers)
from returnwise.models.families import BG_NBD, MBG_NBD, PARAMETERS, PARETO_NBD, count_term
from returnwise.models.optimizer import NotConverged, Optimum, maximise
from returnwise.session import materialise

GAMMA_GAMMA = "gamma_gamma"
CHALLENGERS = (MBG_NBD, PARETO_NBD)
GAMMA_GAMMA_PARAMETERS = ("p", "q", "v")

# The weak prior of a MAP fit: log parameters normal with this spread, around zero for the
# dimensionless ones and around the data's own time scale for the rates. It decides only
# directions the data leaves flat, such as the drop-out clock of customers who never drop out.
PRIOR_SPREAD = 2.5
SCALE_PARAMETERS = {"alpha", "beta"}


class ModelError(RuntimeError):
    """The calibration data cannot support a fit."""


@dataclass(frozen=True)
class Fit:
    """Fitted parameters of one family on one source."""

    family: str
    method: str
    parameters: dict[str, float]
    log_likelihood: float
    customers: int
    jobs: int
    covariance: np.ndarray | None = field(default=None, compare=False)  # of the log parameters

    @property
    def vector(self) -> tuple[float, ...]:
        return tuple(self.parameters.values())


# ---- preconditions ----------------------------------------------------------------------------


def _refusals() -> dict[str, tuple[Column, str]]:
    """By name: what makes a calibration row unusable, and how the rows are spoken of."""
    mean, count = F.col("monetary_value").cast("double"), F.col("frequency")
    rest = F.col("total_spend").cast("double") - F.col("first_occasion_spend").cast("double")
    # monetary_value carries four decimals, so its product with the count is only that exact; a
    # cent is allowed while counts are small.
    allowed = F.greatest(F.lit(0.01), count * 0.00005 + F.abs(rest) * 1e-12)
    return {
        "age_below_recency": (
            F.col("customer_age") < F.col("recency"), "last purchase after the observation ends"
        ),
        "negative_frequency": (count < 0, "repeat count below zero"),
        "no_age": (F.col("customer_age") <= 0, "not observed for a single day"),
        "inconsistent_spend": (
            F.abs(mean * count - rest) > allowed, "mean value times repeats is not the repeat spend"
        ),
        "inconsistent_eligibility": (
            F.col("is_gamma_gamma_eligible") & ((count <= 0) | (mean <= 0)),
            "in the spend model without repeat spend",
        ),
    }


def assumption_counts(calibration: DataFrame) -> DataFrame:
    """Rows breaking each assumption, and the eligible rows, in one aggregate."""
    return calibration.agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.count_if(broken).alias(name) for name, (broken, _) in _refusals().items()],
        F.count_if(F.col("is_gamma_gamma_eligible")).alias("eligible"),
    )


def check_assumptions(calibration: DataFrame) -> dict[str, int]:
    """The counts of sound calibration rows; otherwise an error that lists everything wrong."""
    counts = assumption_counts(calibration).first().asDict()
    wrong = [f"{words} ({counts[name]})" for name, (_, words) in _refusals().items() if counts[name]]
    if not wrong and not counts["eligible"]:
        wrong.append("nobody bought again, which leaves the spend model without data")
    if not counts["customers"]:
        wrong = ["there are none"]
    if wrong:
        raise ModelError(f"calibration rows refused: {'; '.join(wrong)}")
    return counts


# ---- model inputs -----------------------------------------------------------------------------


def purchase_frame(calibration: DataFrame) -> DataFrame:
    """Every customer; the observed age takes its model name ``T`` here and only here."""
    return calibration.select(
        "customer_id", "frequency", "recency", F.col("customer_age").alias("T")
    )


def spend_frame(calibration: DataFrame) -> DataFrame:
    """Customers the spend model learns from."""
    return calibration.where("is_gamma_gamma_eligible").select(
        "customer_id", F.col("monetary_value").cast("double").alias("monetary_value"), "frequency"
    )


def model_states(calibration: DataFrame) -> DataFrame:
    """Distinct (frequency, recency, T) with their customer counts.

    Combined before the shuffle, so the state most customers share is one row per task.
    """
    return (
        purchase_frame(calibration)
        .groupBy("frequency", "recency", "T")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_histogram(states: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers per repeat count; at most one row per day of the window."""
    rows = states.groupBy("frequency").agg(F.sum("n").alias("n")).collect()
    return (
        np.array([r["frequency"] for r in rows], dtype=float),
        np.array([r["n"] for r in rows], dtype=float),
    )


# ---- purchase models --------------------------------------------------------------------------


def state_sums(states: DataFrame, family: str, points: np.ndarray) -> np.ndarray:
    """Sum of the date-dependent log-likelihood term for every parameter row, in one job."""
    summed = families.state_totals

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(points))
        for batch in batches:
            if len(batch):
                columns = (batch[c].to_numpy(dtype=float) for c in ("frequency", "recency", "T", "n"))
                totals += summed(family, points, *columns)
        yield pd.DataFrame({"point": np.arange(len(points)), "total": totals})

    rows = (
        states.select("frequency", "recency", "T", "n")
        .mapInPandas(partial, "point long, total double")
        .groupBy("point")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    result = np.zeros(len(points))
    for row in rows:
        result[row["point"]] = row["total"]
    return result


def log_likelihoods(
    states: DataFrame, family: str, points: np.ndarray, histogram: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """Full log-likelihood of the population at every parameter row."""
    x, n = histogram
    vectors = tuple(points[:, [j]] for j in range(points.shape[1]))
    return count_term(family, vectors, x) @ n + state_sums(states, family, points)


def _log_prior(center: np.ndarray, logs: np.ndarray) -> np.ndarray:
    return -0.5 * (((logs - center) / PRIOR_SPREAD) ** 2).sum(axis=1)


def _prior_center(names: tuple[str, ...], mean_age: float) -> np.ndarray:
    scale = math.log(max(mean_age / 4.0, 1.0))
    return np.array([scale if name in SCALE_PARAMETERS else 0.0 for name in names])


def fit_purchase_model(
    calibration: DataFrame, family: str = BG_NBD, prior: bool = True
) -> Fit:
    """Fit a purchase-count family on every customer; maximum likelihood when ``prior`` is off."""
    if family not in PARAMETERS:
        raise ModelError(f"there is no family {family!r}; there are {', '.join(PARAMETERS)}")
    return fit_states(stored_states(calibration), family, prior)


def stored_states(calibration: DataFrame) -> DataFrame:
    """The states, written once for the whole search and split over every core.

    They are few bytes but many flops per row, so the split follows the cores rather than the
    byte size adaptive coalescing would go by. Neighbours stay together: what a likelihood needs
    per count and date is then worked out for many states at once.
    """
    states = model_states(calibration)
    spark = states.sparkSession
    parts = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    order = ["frequency", "T", "recency"]
    return materialise(states.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def fit_states(states: DataFrame, family: str, prior: bool = True) -> Fit:
    names = PARAMETERS[family]
    histogram = count_histogram(states)
    customers = float(histogram[1].sum())
    if not customers:
        raise ModelError("there are no customers to fit")
    mean_age = states.agg(F.sum(F.col("n") * F.col("T")) / F.sum("n")).first()[0]
    center = _prior_center(names, float(mean_age))

    def objective(logs: np.ndarray) -> np.ndarray:
        value = log_likelihoods(states, family, np.exp(logs), histogram)
        if prior:
            value = value + _log_prior(center, logs)
        # Per customer, so that derivatives keep their digits whatever the population.
        return value / customers

    found: Optimum = maximise(objective, center, tolerance=1e-6 / customers)
    likelihood = found.value * customers
    if prior:
        likelihood -= float(_log_prior(center, found.point[None, :])[0])
    return Fit(
        family=family,
        method="map" if prior else "ml",
        parameters=dict(zip(names, (float(v) for v in np.exp(found.point)), strict=True)),
        log_likelihood=likelihood,
        customers=int(customers),
        jobs=found.jobs,
        covariance=np.linalg.pinv(found.curvature * customers),
    )


#: What a model that does not fit these data may end in. Anything else is a fault, of the cluster or
#: of the input, and stops the run.
UNFITTED = (ModelError, NotConverged, ArithmeticError, np.linalg.LinAlgError)


@dataclass(frozen=True)
class ChallengerOutcome:
    """How an attempt at a fit ended: in a fit or in the failure that stands for it."""

    family: str
    ending: Fit | Exception
    seconds: float

    @property
    def fit(self) -> Fit | None:
        return self.ending if isinstance(self.ending, Fit) else None

    @property
    def succeeded(self) -> bool:
        return self.fit is not None

    @property
    def detail(self) -> str:
        """The parameters in order of name, or what went wrong."""
        if self.fit is None:
            return f"{type(self.ending).__name__}: {self.ending}"
        return ", ".join(f"{k} = {v:.3f}" for k, v in sorted(self.fit.parameters.items()))


def attempt(family: str, fitting: Callable[[], Fit]) -> ChallengerOutcome:
    """Run one fitting and keep how it ended, so that one model cannot stop a comparison."""
    clock = time.perf_counter()
    ending: Fit | Exception
    try:
        ending = fitting()
    except UNFITTED as failure:
        ending = failure
    return ChallengerOutcome(family, ending, time.perf_counter() - clock)


def fit_challenger(calibration: DataFrame, family: str) -> ChallengerOutcome:
    """An attempt at one of the alternative families."""
    if family not in CHALLENGERS:
        raise ModelError(f"{family!r} is no challenger; there are {' and '.join(CHALLENGERS)}")
    return attempt(family, lambda: fit_purchase_model(calibration, family))


# ---- spend model ------------------------------------------------------------------------------


def _log_scale_sums(spend: DataFrame, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ln(1 + x z / v) and x ln(1 + x z / v) over customers for every scale v, in one job.

    The sums of ln(v + x z) are these and a multiple of ln v. That multiple cancels in ln L, where
    it would be millions of times what remains once the scale is far above all spend.
    """
    x, z = F.col("frequency").cast("double"), F.col("monetary_value")
    columns = []
    for i, v in enumerate(scales):
        term = F.log1p(x * z / F.lit(float(v)))
        columns += [F.sum(term).alias(f"a{i}"), F.sum(x * term).alias(f"b{i}")]
    row = spend.agg(*columns).first()
    count = range(len(scales))
    return (
        np.array([row[f"a{i}"] for i in count]),
        np.array([row[f"b{i}"] for i in count]),
    )


#: How often the scales searched may be widened or moved before the fit gives up with an error.
WIDENINGS = 12


def _chebyshev(center: float, half_width: float, count: int) -> np.ndarray:
    return center + half_width * np.cos(np.pi * (np.arange(count) + 0.5) / count)


def fit_gamma_gamma(calibration: DataFrame, prior: bool = True) -> Fit:
    """Fit the spend model on eligible customers.

    The customers enter ln L through two sums that depend on the scale v alone, beside the
    histogram of counts. The sums are smooth in ln v, so two jobs over a grid of v (a coarse one,
    then Chebyshev nodes around the best) give them everywhere to full precision, and the search
    over (p, q, v) itself needs no further pass over the customers.
    """
    spend = materialise(spend_frame(calibration))
    x, n = count_histogram(spend.groupBy("frequency").agg(F.count(F.lit(1)).alias("n")))
    customers = float(n.sum())
    if not customers:
        raise ModelError("nobody bought again, which leaves the spend model without data")
    frequency, z = F.col("frequency").cast("double"), F.col("monetary_value")
    row = spend.agg(
        F.sum(F.log(z)).alias("log_z"),
        F.sum(frequency * F.log(z)).alias("x_log_z"),
        F.avg(z).alias("mean"),
    ).first()
    log_z, x_log_z, mean = row["log_z"], row["x_log_z"], row["mean"]
    x_log_x, repeats = float((n * x * np.log(x)).sum()), float((n * x).sum())

    def likelihood(p: float, q: float, log_v: float, a: float, b: float) -> float:
        shape = float((n * (log_rising(q, p * x) - log_gamma(p * x))).sum())
        return shape + p * (x_log_z + x_log_x - repeats * log_v) - log_z - p * b - q * a

    def penalised(p: float, q: float, log_v: float, a: float, b: float) -> float:
        value = likelihood(p, q, log_v, a, b)
        if prior:
            value -= 0.5 * ((math.log(p) / PRIOR_SPREAD) ** 2 + (math.log(q) / PRIOR_SPREAD) ** 2)
        return value / customers

    def best_shapes(log_v: float, a: float, b: float, start: np.ndarray) -> Optimum:
        def evaluate(points: np.ndarray) -> np.ndarray:
            return np.array(
                [penalised(math.exp(u), math.exp(w), log_v, a, b) for u, w in points]
            )

        return maximise(evaluate, start, tolerance=1e-8 / customers, most_jobs=40)

    # Coarse pass: the best shapes at each scale of a grid, widened until the best lies inside it.
    profile: dict[float, Optimum] = {}
    wanted, middle, passes = np.arange(-6.0, 11.0), math.log(mean), 0
    while True:
        a, b = _log_scale_sums(spend, np.exp(middle + wanted))
        passes += 1
        start = np.zeros(2)
        for offset, a_v, b_v in zip(wanted, a, b, strict=True):
            try:
                profile[float(offset)] = best_shapes(middle + offset, a_v, b_v, start)
            except NotConverged:
                continue  # a scale no customer's spend is near has no usable shapes
            start = profile[float(offset)].point
        if not profile:
            raise ModelError("the spend likelihood has no optimum on these customers.")
        top = max(profile, key=lambda offset: profile[offset].value)
        if min(profile) < top < max(profile):
            break
        if passes == WIDENINGS:
            raise NotConverged("the spend likelihood keeps rising at the end of every grid of scales")
        wanted = top + (np.arange(1.0, 9.0) if top == max(profile) else -np.arange(8.0, 0.0, -1.0))
    # Fine pass: interpolation nodes around the best scale, moved along until the optimum is inside.
    half, center, shapes = 1.2, middle + top, profile[top].point
    for _ in range(WIDENINGS):
        domain = [center - half, center + half]
        nodes = _chebyshev(center, half, 25)
        fine_a, fine_b = _log_scale_sums(spend, np.exp(nodes))
        passes += 1
        fit_a = np.polynomial.Chebyshev.fit(nodes, fine_a, 24, domain=domain)
        fit_b = np.polynomial.Chebyshev.fit(nodes, fine_b, 24, domain=domain)

        def joint(points: np.ndarray) -> np.ndarray:
            # Outside the interpolated span there is no value, so no step goes there.
            return np.array(
                [
                    penalised(math.exp(u), math.exp(w), s, float(fit_a(s)), float(fit_b(s)))
                    if domain[0] <= s <= domain[1] else -np.inf
                    for u, w, s in points
                ]
            )

        try:
            found = maximise(
                joint, np.array([*shapes, center]), tolerance=1e-8 / customers, most_jobs=400
            )
            if abs(found.point[2] - center) < 0.9 * half:
                break
            shapes, center = found.point[:2], float(found.point[2])
        except NotConverged as failure:
            # The search stands at the span's edge: look where the profile rises.
            edges = [best_shapes(s, float(fit_a(s)), float(fit_b(s)), shapes) for s in domain]
            if max(e.value for e in edges) <= profile[top].value:
                raise failure
            chosen = int(edges[1].value > edges[0].value)
            shapes, center = edges[chosen].point, domain[chosen]
    else:
        raise NotConverged("the spend likelihood has no optimum among the scales searched")
    p, q, v = (float(value) for value in np.exp(found.point))
    s = float(found.point[2])
    return Fit(
        family=GAMMA_GAMMA,
        method="map" if prior else "ml",
        parameters={"p": p, "q": q, "v": v},
        log_likelihood=likelihood(p, q, s, float(fit_a(s)), float(fit_b(s))),
        customers=int(customers),
        jobs=passes + 2,
        covariance=np.linalg.pinv(found.curvature * customers),
    )


def parameter_rows(fits: list[Fit], source: str) -> list[tuple]:
    """Rows of the ``model_parameters`` relation."""
    return [
        (source, fit.method, fit.family, name, value)
        for fit in fits
        for name, value in fit.parameters.items()
    ]
