"""Forecast columns: purchases, activity, order value and revenue per customer and horizon."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.models import families, shipping  # noqa: F401  (registers the helpers)
from returnwise.models.families import BG_NBD, MBG_NBD, PARETO_NBD
from returnwise.models.fit import Fit

STATE = ("frequency", "recency", "customer_age")


def per_state(kernel: Callable[..., np.ndarray], columns: int) -> Callable:
    """A pandas UDF evaluating ``kernel`` once per distinct input row of each Arrow batch.

    Customers are never shuffled to share a state: the state most of them have is simply computed
    once per batch.
    """

    def evaluate(*series: pd.Series) -> pd.Series:
        matrix = np.column_stack([s.to_numpy(dtype=float) for s in series])
        distinct, inverse = np.unique(matrix, axis=0, return_inverse=True)
        values = kernel(*(distinct[:, j] for j in range(distinct.shape[1])))
        return pd.Series(np.asarray(values, dtype=float)[inverse.ravel()])

    if columns == 3:
        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return evaluate(a, b, c)

        return F.pandas_udf(three, "double")

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return evaluate(a, b, c, d)

    return F.pandas_udf(four, "double")


def alive_column(fit: Fit) -> Column:
    """Probability of being active now; exactly one for a BG/NBD customer without repeats."""
    if fit.family == PARETO_NBD:
        p, kernel = fit.vector, families.probability_alive
        udf = per_state(lambda x, tx, T: kernel(PARETO_NBD, p, x, tx, T), 3)
        return udf(*STATE)
    r, alpha, a, b = (F.lit(float(v)) for v in fit.vector)
    x, tx, T = (F.col(c).cast("double") for c in STATE)
    odds = a / (b + x - 1.0) if fit.family == BG_NBD else a / (b + x)
    dropped = odds * F.exp((r + x) * F.log((alpha + T) / (alpha + tx)))
    if fit.family == MBG_NBD:
        return 1.0 / (1.0 + dropped)
    return F.when(x > 0, 1.0 / (1.0 + dropped)).otherwise(F.lit(1.0))


def purchases_column(fit: Fit, horizon: Column) -> Column:
    """Expected purchases over ``horizon`` days given the customer's state."""
    family, p, kernel = fit.family, fit.vector, families.expected_purchases
    udf = per_state(lambda x, tx, T, t: kernel(family, p, x, tx, T, t), 4)
    return udf(*STATE, horizon)


def population_spend(fit: Fit) -> float:
    """Mean order value of the population; defined for q above one."""
    p, q, v = fit.vector
    if q <= 1.0:
        raise ValueError(f"the population mean order value needs q > 1, the fit has q = {q}.")
    return p * v / (q - 1.0)


def spend_column(fit: Fit) -> Column:
    """Expected order value: individual where the spend model saw repeats, else the population's."""
    p, q, v = (F.lit(float(value)) for value in fit.vector)
    x, z = F.col("frequency").cast("double"), F.col("monetary_value").cast("double")
    own = p * (v + x * z) / (p * x + q - 1.0)
    return F.when(F.col("is_gamma_gamma_eligible"), own).otherwise(F.lit(population_spend(fit)))


def spend_source_column() -> Column:
    return F.when(F.col("is_gamma_gamma_eligible"), "conditional").otherwise("population_mean")


def resolve_horizons(windows: DataFrame, forward_horizon_days: int = 365) -> DataFrame:
    """Per source, the sorted distinct forecast lengths: the holdout window and the headline one."""
    return windows.select(
        "source",
        F.array_sort(
            F.array_distinct(
                F.array(F.col("duration_holdout"), F.lit(forward_horizon_days).cast("int"))
            )
        ).alias("horizons"),
    )


def predict(
    calibration: DataFrame, purchase: Fit, spend: Fit, horizons: Sequence[int] | Column
) -> DataFrame:
    """One row per customer and horizon; no shuffle, every column is computed where the row is."""
    lengths = (
        horizons
        if isinstance(horizons, Column)
        else F.array(*[F.lit(int(h)) for h in sorted(set(horizons))])
    )
    base = calibration.select(
        "source",
        "customer_id",
        *STATE,
        "is_gamma_gamma_eligible",
        alive_column(purchase).alias("probability_alive"),
        spend_column(spend).alias("expected_avg_value"),
        F.explode(lengths).alias("horizon_days"),
    ).withColumn("horizon_days", F.col("horizon_days").cast("int"))
    return (
        base.withColumn("expected_purchases", purchases_column(purchase, F.col("horizon_days")))
        .select(
            "source",
            "customer_id",
            "horizon_days",
            "expected_purchases",
            "probability_alive",
            "expected_avg_value",
            (F.col("expected_purchases") * F.col("expected_avg_value")).alias(
                "expected_forward_revenue"
            ),
            F.lit(None).cast("double").alias("forward_revenue_hdi_low"),
            F.lit(None).cast("double").alias("forward_revenue_hdi_high"),
            spend_source_column().alias("spend_estimate_source"),
            "is_gamma_gamma_eligible",
            F.lit(purchase.method).alias("fit_method"),
        )
        .select(*schemas.PREDICTIONS.names)
    )


def expected_over_states(
    states: DataFrame, fit: Fit, lengths: Sequence[int], new_customer: bool = False
) -> DataFrame:
    """Population totals of the expectation at each length, ``(length, expected)``.

    With ``new_customer`` the unconditional expectation over each customer's own age is summed
    instead (``lengths`` is then ignored). One pass over the distinct states; each task returns
    one number per length.
    """
    family, p = fit.family, fit.vector
    own = families.expected_new_purchases
    ahead = families.expected_purchases
    lengths = [-1] if new_customer else [int(v) for v in lengths]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(lengths))
        for batch in batches:
            x, tx, T, n = (
                batch[c].to_numpy(dtype=float) for c in ("frequency", "recency", "T", "n")
            )
            for i, length in enumerate(lengths):
                values = own(p, T) if new_customer else ahead(family, p, x, tx, T, float(length))
                totals[i] += float(values @ n)
        yield pd.DataFrame({"length": lengths, "expected": totals})

    return (
        states.select("frequency", "recency", "T", "n")
        .mapInPandas(partial, "length long, expected double")
        .groupBy("length")
        .agg(F.sum("expected").alias("expected"))
    )


def expected_over_draws(
    states: DataFrame, family: str, points: np.ndarray, lengths: Sequence[int]
) -> DataFrame:
    """Population totals of the expectation by length and draw, ``(length, draw_id, expected)``.

    A vector-valued sum over the distinct states: each task adds up a matrix of lengths by draws
    and hands on its cells, so what is shuffled is bounded by the calendar and the draws. States
    go through in chunks, since every one of them meets every draw. The date of the last purchase
    matters to the chance of being active alone, so the lengths are gone through once per count and
    age, with that chance summed over the states that share them.
    """
    lengths = [int(v) for v in lengths]
    vectors = tuple(points[:, [j]] for j in range(points.shape[1]))
    active, ahead = families.probability_alive, families.expected_if_active
    chunk = max(1, 1_000_000 // len(points))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(lengths), len(points)))
        for batch in batches:
            columns = [batch[c].to_numpy(dtype=float) for c in ("frequency", "recency", "T", "n")]
            for start in range(0, len(batch), chunk):
                x, tx, T, n = (c[start : start + chunk] for c in columns)
                order = np.lexsort((T, x))
                x, tx, T, n = x[order], tx[order], T[order], n[order]
                first = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(T) != 0)])
                weight = np.add.reduceat(active(family, vectors, x, tx, T) * n, first, axis=1)
                for i, length in enumerate(lengths):
                    each = ahead(family, vectors, x[first], T[first], float(length))
                    totals[i] += (each * weight).sum(axis=1)
        yield pd.DataFrame(
            {
                "length": np.repeat(lengths, len(points)),
                "draw_id": np.tile(np.arange(len(points)), len(lengths)),
                "expected": totals.ravel(),
            }
        )

    return (
        states.select("frequency", "recency", "T", "n")
        .mapInPandas(partial, "length long, draw_id long, expected double")
        .groupBy("length", "draw_id")
        .agg(F.sum("expected").alias("expected"))
    )
