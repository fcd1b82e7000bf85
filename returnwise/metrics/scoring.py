"""The quantity by predictor score matrix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.metrics.errors import error_metrics, paired_column
from returnwise.metrics.rank import rank_correlations

CHAMPION = "bg_nbd"

# Which column predicts which quantity under which reported name.
PREDICTORS: dict[str, tuple[str, dict[str, str]]] = {
    "purchases": (
        "holdout_frequency",
        {
            CHAMPION: "expected_purchases",
            "baseline_recent": "baseline_recent",
            "baseline_carry_forward": "baseline_carry_forward",
            "baseline_rate": "baseline_purchases",
            "baseline_flat": "baseline_purchases_flat",
            "baseline_zero": "baseline_zero",
        },
    ),
    "revenue": (
        "holdout_spend",
        {
            CHAMPION: "expected_forward_revenue",
            "baseline_recent": "baseline_revenue_recent",
            "baseline_carry_forward": "baseline_revenue_carry_forward",
            "baseline_rate": "baseline_revenue",
            "baseline_flat": "baseline_revenue_flat",
            "baseline_zero": "baseline_zero",
        },
    ),
    "avg_order_value": (
        "holdout_monetary_value",
        {CHAMPION: "expected_avg_value", "baseline_rate": "baseline_avg_value"},
    ),
}
WITHOUT_MAPE = ("purchases",)
GROUPS = ("source", "quantity", "family")


def predictor_rows(scored: DataFrame, challengers: Mapping[str, str] | None = None) -> DataFrame:
    """One row per customer, quantity and predictor: ``(source, quantity, family, actual,
    predicted)``.

    Order value is scored on returners only: without a holdout purchase there is no order to have
    a value. Challengers predict counts only.
    """
    entries = []
    for quantity, (actual, families) in PREDICTORS.items():
        extra = dict(challengers or {}) if quantity == "purchases" else {}
        for family, column in {**families, **extra}.items():
            entries.append(
                F.struct(
                    F.lit(quantity).alias("quantity"),
                    F.lit(family).alias("family"),
                    F.col(actual).cast("double").alias("actual"),
                    F.col(column).cast("double").alias("predicted"),
                )
            )
    rows = scored.select("source", "holdout_frequency", F.explode(F.array(*entries)).alias("e"))
    returned = (F.col("e.quantity") != "avg_order_value") | (F.col("holdout_frequency") > 0)
    return rows.where(returned).select("source", "e.*")


def score(scored: DataFrame, quantity: str, family: str) -> DataFrame:
    """Every metric of one predictor of one quantity."""
    return score_rows(
        predictor_rows(scored).where(
            (F.col("quantity") == quantity) & (F.col("family") == family)
        )
    )


def score_all(scored: DataFrame, challengers: Mapping[str, str] | None = None) -> DataFrame:
    """Every predictor of every quantity it has a prediction for."""
    return score_rows(predictor_rows(scored, challengers))


def score_rows(rows: DataFrame) -> DataFrame:
    """Errors in one grouped aggregate and rank correlations in one global sort per side."""
    # A customer without a forecast must not leave the means unnoticed.
    paired = rows.withColumn("predicted", paired_column("actual", "predicted"))
    errors = error_metrics(paired, "actual", "predicted", GROUPS)
    ranks = rank_correlations(
        rows, "predicted", "actual", GROUPS, y_by=("source", "quantity")
    )
    reported = ~F.col("quantity").isin(*WITHOUT_MAPE)
    # Both sides are one row per source, quantity and family.
    return errors.join(F.broadcast(ranks.drop("n")), list(GROUPS)).select(
        *GROUPS,
        "population",
        "mae",
        "rmse",
        "actual_total",
        "predicted_total",
        "percent_error",
        F.col("rho").alias("spearman_rho"),
        F.when(reported, F.col("mape")).alias("mape"),
        F.when(reported, F.col("mape_included")).alias("mape_included"),
        F.when(reported, F.col("mape_excluded")).alias("mape_excluded"),
    )


# Names of the stored metrics.
METRICS = (
    "mae",
    "rmse",
    "actual_total",
    "predicted_total",
    "percent_error",
    "spearman_rho",
    "mape",
    "mape_excluded",
)


def metrics_frame(scores: DataFrame) -> DataFrame:
    """Long format: one row per metric; MAPE rows only where MAPE is reported."""
    long = scores.select(
        "source",
        F.col("family").alias("model_family"),
        "quantity",
        "population",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in METRICS
                ]
            )
        ).alias("m"),
    )
    has_mape = ~F.col("quantity").isin(*WITHOUT_MAPE)
    return long.where(~F.col("m.metric").startswith("mape") | has_mape).select(
        "source",
        "model_family",
        "quantity",
        F.col("m.metric").alias("metric"),
        F.col("m.value").alias("value"),
        "population",
    ).select(*schemas.VALIDATION_METRICS.names)
