"""Sums that pin what a fit was trained on and what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.operators.ranking import customer_rank, dense_customer_rank

PINNED = (
    "expected_purchases",
    "expected_forward_revenue",
    "expected_avg_value",
    "probability_alive",
)


def calibration_fingerprint(calibration: DataFrame) -> DataFrame:
    """Per source: row count, feature sums and the same sums weighted by customer rank.

    Plain sums miss values moved between customers; the rank weights see them. Money is counted in
    whole ten-thousandths, so every sum is exact and independent of the order of the rows. Sums
    that grow with the square of the population are decimals, which do not wrap.
    """
    ranked = customer_rank(
        calibration.select(
            "source", "customer_id", "frequency", "recency", "customer_age", "monetary_value"
        )
    )
    rank = F.col("customer_rank").cast("decimal(20,0)")
    units = F.round(F.col("monetary_value") * 10000).cast("decimal(18,0)")

    def weighted(column: Column) -> Column:
        return F.sum(rank * column).cast("decimal(38,0)")

    wide = {
        name: F.col(name).cast("decimal(18,0)")
        for name in ("frequency", "recency", "customer_age")
    }
    return ranked.groupBy("source").agg(
        F.count(F.lit(1)).alias("calibration_rows"),
        *[F.sum(name).cast("long").alias(f"sum_{name}") for name in wide],
        F.sum(F.col("monetary_value").cast("decimal(18,4)")).cast("double").alias(
            "sum_monetary_value"
        ),
        *[weighted(column).alias(f"weighted_{name}") for name, column in wide.items()],
        weighted(units).alias("weighted_monetary_value_e4"),
    )


def prediction_fingerprint(predictions: DataFrame) -> DataFrame:
    """Per source, three sums of each pinned column: plain, by customer rank, by horizon.

    Scaling moves the plain sum, moving values between customers the ranked one, and swapping
    horizon labels the last.
    """
    ranked = dense_customer_rank(
        predictions.select("source", "customer_id", "horizon_days", *PINNED)
    )
    weights = {
        "sum": F.lit(1.0),
        "weighted": F.col("customer_rank").cast("double"),
        "horizon_weighted": F.col("horizon_days").cast("double"),
    }
    return ranked.groupBy("source").agg(
        *[
            F.sum(weight * F.col(column)).alias(f"{prefix}_{column}")
            for column in PINNED
            for prefix, weight in weights.items()
        ]
    )


def fit_run(
    calibration: DataFrame,
    predictions: DataFrame,
    method: str,
    horizons: list[int],
    holdout_days: int,
) -> DataFrame:
    """The provenance row of a fit: what it read and what it wrote."""
    return (
        calibration_fingerprint(calibration)
        .join(prediction_fingerprint(predictions), "source")
        .select(
            "source",
            F.lit(method).alias("fit_method"),
            F.current_timestamp().alias("fitted_at"),
            F.lit(",".join(str(h) for h in horizons)).alias("horizons"),
            F.lit(int(holdout_days)).alias("holdout_days"),
            *[
                "calibration_rows",
                *[f"sum_{c}" for c in ("frequency", "recency", "customer_age", "monetary_value")],
                *[f"weighted_{c}" for c in ("frequency", "recency", "customer_age")],
                "weighted_monetary_value_e4",
            ],
            *[
                f"{prefix}_{column}"
                for column in PINNED
                for prefix in ("sum", "weighted", "horizon_weighted")
            ],
        )
    )
