"""Error metrics of one prediction column against one outcome column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _double(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def _ratio(numerator: Column, denominator: Column) -> Column:
    """NaN where the denominator is zero, as an undefined value rather than a failure."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(NAN))


def mae_column(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(_double(predicted) - _double(actual)))


def rmse_column(actual: str, predicted: str) -> Column:
    gap = _double(predicted) - _double(actual)
    return F.sqrt(F.avg(gap * gap))


def percent_error_column(actual_total: Column, predicted_total: Column) -> Column:
    return _ratio(100.0 * (predicted_total - actual_total), actual_total)


def require_pairs(df: DataFrame, actual: str, predicted: str) -> int:
    """Refuse an empty population or a pair with a missing side; returns the pair count."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(actual).isNull() | F.col(predicted).isNull()).alias("missing"),
    ).first()
    if row["n"] == 0:
        raise ValueError("the population to be scored is empty")
    if row["missing"]:
        raise ValueError(
            f"{row['missing']} rows lack {actual} or {predicted}: the join behind them lost rows."
        )
    return row["n"]


def paired_column(actual: str, predicted: str) -> Column:
    """The forecast, failing the job on a pair with a missing side."""
    message = F.lit(f"a row lacks {actual} or {predicted}: it would silently leave the metrics.")
    broken = F.col(actual).isNull() | F.col(predicted).isNull()
    return F.when(broken, F.raise_error(message).cast("double")).otherwise(F.col(predicted))


def error_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, totals with signed error, and MAPE with the rows it covers, in one aggregate.

    MAPE averages over non-zero outcomes only and says how many rows that leaves out.
    """
    a, p = _double(actual), _double(predicted)
    relative = F.when(a != 0, F.abs((p - a) / F.when(a != 0, a)))
    raw = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("population"),
        mae_column(actual, predicted).alias("mae"),
        rmse_column(actual, predicted).alias("rmse"),
        F.sum(a).alias("actual_total"),
        F.sum(p).alias("predicted_total"),
        (100.0 * F.avg(relative)).alias("mape"),
        F.count_if(a != 0).alias("mape_included"),
    )
    total, forecast = F.col("actual_total"), F.col("predicted_total")
    excluded = F.col("population") - F.col("mape_included")
    return raw.select(
        *by,
        "population",
        "mae",
        "rmse",
        "actual_total",
        "predicted_total",
        (forecast - total).alias("error"),
        percent_error_column(total, forecast).alias("percent_error"),
        F.coalesce("mape", F.lit(NAN)).alias("mape"),
        "mape_included",
        excluded.alias("mape_excluded"),
        _ratio(excluded.cast("double"), F.col("population").cast("double")).alias(
            "mape_excluded_share"
        ),
    )
