"""How the recent-rate rule's holdout total depends on its look-back window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.operators.rfm import counts_of, customer_windows
from returnwise.session import small
from returnwise.settings import SENSITIVITY_WINDOWS


def recent_window_sensitivity(
    occasions: DataFrame,
    windows: DataFrame,
    recent_window_days: int = 91,
    look_backs: Sequence[int] = SENSITIVITY_WINDOWS,
) -> DataFrame:
    """Per source and look-back: population, predicted and actual purchases, signed error."""
    days = configured(recent_window_days, look_backs)
    wide = customer_windows(occasions, windows, days)
    return sensitivity_of(counts_of(wide, days), windows, days)


def configured(
    recent_window_days: int, look_backs: Sequence[int] = SENSITIVITY_WINDOWS
) -> list[int]:
    """The look-backs of the table: the listed ones and the configured one if it is new."""
    return sorted({*look_backs, recent_window_days})


def sensitivity_of(counts: DataFrame, windows: DataFrame, days: Sequence[int]) -> DataFrame:
    """The table out of per-customer counts.

    Every look-back and the outcome are summed in one aggregate per source before the rows are
    unpivoted, so the work is one scan whatever the number of look-backs.
    """
    rates = []
    for d in days:
        exposure = F.least(F.lit(d), F.col("customer_age"))
        rate = F.when(exposure > 0, F.col(f"repeats_{d}").cast("double") / exposure)
        rates.append(F.sum(F.coalesce(rate, F.lit(0.0))).alias(f"rate_{d}"))
    totals = counts.groupBy("source").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("holdout_frequency").alias("actual_purchases"),
        *rates,
    )
    entries = [
        F.struct(F.lit(d).alias("window_days"), F.col(f"rate_{d}").alias("rate")) for d in days
    ]
    long = totals.select(
        "source", "customers", "actual_purchases", F.explode(F.array(*entries)).alias("w")
    )
    predicted = F.col("w.rate") * F.col("duration_holdout")
    return long.join(small(windows.select("source", "duration_holdout")), "source").select(
        "source",
        F.col("w.window_days").alias("window_days"),
        "customers",
        predicted.alias("predicted_purchases"),
        "actual_purchases",
        F.try_divide(
            100.0 * (predicted - F.col("actual_purchases")),
            F.col("actual_purchases").cast("double"),
        ).alias("percent_error"),
    )
