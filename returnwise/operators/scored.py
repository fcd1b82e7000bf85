"""One row per calibration customer: features, outcome, forecast and the naive rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.operators.rfm import KEYS, customer_history
from returnwise.session import small

PREDICTION_COLUMNS = (
    "expected_purchases",
    "probability_alive",
    "expected_avg_value",
    "expected_forward_revenue",
    "forward_revenue_hdi_low",
    "forward_revenue_hdi_high",
    "spend_estimate_source",
    "fit_method",
)

BASELINES = (
    "baseline_purchases",
    "baseline_purchases_flat",
    "baseline_avg_value",
    "baseline_revenue",
    "baseline_revenue_flat",
    "baseline_carry_forward",
    "baseline_revenue_carry_forward",
    "baseline_recent",
    "baseline_revenue_recent",
    "baseline_zero",
)


def population_constants(calibration: DataFrame) -> DataFrame:
    """Pooled repeat rate per day and mean repeat order value, one row per source."""
    spend = F.when(F.col("is_gamma_gamma_eligible"), F.col("monetary_value"))
    return calibration.groupBy("source").agg(
        F.try_divide(
            F.sum("frequency").cast("double"), F.sum("customer_age").cast("double")
        ).alias("repeat_rate_per_day"),
        F.try_divide(
            F.sum(spend).cast("double"), F.count(spend).cast("double")
        ).alias("mean_repeat_order_value"),
    )


def prediction_boundary(predictions: DataFrame) -> DataFrame:
    """The stored predictions by explicit column list, so a drifted schema fails here."""
    return schemas.conform(predictions, schemas.PREDICTIONS)


def baseline_columns() -> dict[str, Column]:
    """The naive rules over customer features, windows and population constants."""
    horizon = F.col("duration_holdout")
    frequency = F.col("frequency").cast("double")
    own_rate = F.when(
        F.col("customer_age") > 0, frequency / F.col("customer_age") * horizon
    ).otherwise(F.lit(0.0))
    flat = F.col("repeat_rate_per_day") * horizon
    order_value = F.when(
        F.col("is_gamma_gamma_eligible"), F.col("monetary_value").cast("double")
    ).otherwise(F.col("mean_repeat_order_value"))
    recent = (
        F.when(
            F.col("recent_exposure_days") > 0,
            F.col("recent_repeats").cast("double") / F.col("recent_exposure_days"),
        ).otherwise(F.lit(0.0))
        * horizon
    )
    return {
        "baseline_purchases": own_rate,
        "baseline_purchases_flat": flat,
        "baseline_avg_value": order_value,
        "baseline_revenue": own_rate * order_value,
        "baseline_revenue_flat": flat * F.col("mean_repeat_order_value"),
        "baseline_carry_forward": frequency,
        "baseline_revenue_carry_forward": frequency * order_value,
        "baseline_recent": recent,
        "baseline_revenue_recent": recent * order_value,
        "baseline_zero": F.lit(0.0),
    }


def baselines(
    occasions: DataFrame,
    windows: DataFrame,
    recent_window_days: int = 91,
    calibration: DataFrame | None = None,
) -> DataFrame:
    """Features, outcome and naive rules, before any forecast is attached.

    The pooled constants come from the stored calibration summary where the caller has one;
    otherwise the occasions are aggregated a second time for them.
    """
    return baselines_of(customer_history(occasions, windows, recent_window_days), calibration)


def baselines_of(history: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """:func:`baselines` over a history already at hand."""
    pooled = population_constants(history if calibration is None else calibration)
    rules = baseline_columns()
    return history.join(small(pooled), "source").select(
        *KEYS,
        "frequency",
        "recency",
        "customer_age",
        "monetary_value",
        "is_gamma_gamma_eligible",
        "duration_holdout",
        "holdout_frequency",
        "holdout_spend",
        "holdout_monetary_value",
        *[rules[name].alias(name) for name in BASELINES],
        "recent_window_days",
    )


def scored(
    occasions: DataFrame,
    windows: DataFrame,
    predictions: DataFrame,
    recent_window_days: int = 91,
    calibration: DataFrame | None = None,
) -> DataFrame:
    """The scored relation, straight from the occasions."""
    base = baselines(occasions, windows, recent_window_days, calibration)
    return scored_of(base, windows, predictions)


def scored_of(base: DataFrame, windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach the forecasts: the population is the calibration customers and is never filtered.

    A customer without a forecast at the holdout length keeps a row with NULL forecast columns,
    so that the completeness checks can see it. Forecasts are cut to the holdout length before
    the join, which then runs on the customer key the other side is already partitioned by; only
    the forecasts shuffle.
    """
    length = windows.select("source", F.col("duration_holdout").alias("_length"))
    forecast = (
        prediction_boundary(predictions)
        .join(small(length), "source")
        .where(F.col("horizon_days") == F.col("_length"))
        .select(*KEYS, "horizon_days", *PREDICTION_COLUMNS)
    )
    return base.join(forecast, list(KEYS), "left")
