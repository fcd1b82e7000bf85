"""The calibration / holdout split, derived from the data once per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnwise.session import small
from returnwise.settings import Settings


def _weeks(settings: Settings, part: str) -> Column:
    value = F.lit(getattr(settings.split, part))
    for source, split in settings.by_source.items():
        value = F.when(F.col("source") == source, F.lit(getattr(split, part))).otherwise(value)
    return value


def analysis_windows(dated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per source: inclusive calibration and holdout dates plus the observed span.

    ``dated`` is any relation with ``source`` and ``order_date``; occasions give the same answer
    as line items and are far fewer rows.
    """
    observed = dated.groupBy("source").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    calibration_days = _weeks(settings, "calibration") * 7
    holdout_days = _weeks(settings, "holdout") * 7
    start = F.col("first_order_date")
    return observed.select(
        "source",
        start.alias("calibration_start"),
        F.date_add(start, calibration_days - 1).alias("calibration_end"),
        F.date_add(start, calibration_days).alias("holdout_start"),
        F.date_add(start, calibration_days + holdout_days - 1).alias("holdout_end"),
        holdout_days.cast("int").alias("duration_holdout"),
        "first_order_date",
        "last_order_date",
    )


def closed_cohort(occasions: DataFrame, windows: DataFrame, days_before_end: int = 1) -> DataFrame:
    """Occasions of customers acquired at least ``days_before_end`` days before the cutoff.

    Scoring assumes every customer was acquired inside calibration. A source that keeps acquiring
    breaks that, so later arrivals are set aside here, whole customers at a time. The running
    minimum needs no join: it shuffles on the same keys the per-customer aggregates use next.
    """
    per_customer = Window.partitionBy("source", "customer_id")
    columns = occasions.columns
    return (
        occasions.withColumn("_acquired", F.min("order_date").over(per_customer))
        .join(small(windows.select("source", "calibration_end")), "source")
        .where(F.col("_acquired") <= F.date_sub("calibration_end", days_before_end))
        .select(*columns)
    )
