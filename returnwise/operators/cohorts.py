"""Monthly views over the occasions: cohort retention and the repeat series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.operators.rfm import KEYS
from returnwise.session import small


def customer_months(occasions: DataFrame) -> DataFrame:
    """Distinct active months of each customer beside the month of the first purchase.

    The cohort month is the smallest of a customer's own months, so one aggregate per customer
    yields both: the months as a set (bounded by the calendar) and their minimum.
    """
    months = (
        occasions.select(*KEYS, F.trunc("order_date", "MM").alias("activity_month"))
        .groupBy(*KEYS)
        .agg(F.collect_set("activity_month").alias("_months"))
    )
    return months.select(
        *KEYS,
        F.array_min("_months").alias("cohort_month"),
        F.explode("_months").alias("activity_month"),
    )


def monthly_retention(occasions: DataFrame) -> DataFrame:
    """Share of each acquisition cohort active in each later month, empty cells included.

    After the first aggregate everything is cohort-by-month sized: the grid and the join that
    fills it are bounded by the square of the calendar, not by the customers.
    """
    activity = (
        customer_months(occasions)
        .groupBy("source", "cohort_month", "activity_month")
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    # A cohort is fully active in its own first month, by definition of that month.
    sizes = activity.where(F.col("activity_month") == F.col("cohort_month")).select(
        "source", "cohort_month", F.col("active_customers").alias("cohort_size")
    )
    calendar = activity.select("source", "activity_month").distinct()
    grid = sizes.join(small(calendar), "source").where(
        F.col("activity_month") >= F.col("cohort_month")
    )
    since_first = (F.year("activity_month") - F.year("cohort_month")) * 12 + (
        F.month("activity_month") - F.month("cohort_month")
    )
    active = F.coalesce("active_customers", F.lit(0)).cast("long")
    return grid.join(
        small(activity), ["source", "cohort_month", "activity_month"], "left"
    ).select(
        "source",
        "cohort_month",
        since_first.alias("months_since_first"),
        "activity_month",
        "cohort_size",
        active.alias("active_customers"),
        F.round(active.cast("double") / F.col("cohort_size"), 4)
        .cast("decimal(6,4)")
        .alias("retention_rate"),
    )


def repeat_series(occasions: DataFrame, windows: DataFrame) -> DataFrame:
    """Repeat occasions per month: each customer's very first occasion is left out.

    An occasion is first exactly when it falls on the customer's first day, and a customer has one
    such row, so the first occasions are counted per month and subtracted from all occasions per
    month. That takes one small aggregate per customer and no sort or window over them. The
    calibration flag says whether any counted day of the month falls in calibration, which is
    decided by the month's earliest repeat.
    """
    month = F.trunc("order_date", "MM")
    first_days = occasions.groupBy(*KEYS).agg(F.min("order_date").alias("order_date"))

    def daily(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy("source", "order_date").agg(
            (F.count(F.lit(1)) * sign).alias("occasions")
        )

    # Grouped by day first: one row per source and calendar day.
    repeats_by_day = (
        daily(occasions, 1)
        .unionByName(daily(first_days, -1))
        .groupBy("source", "order_date")
        .agg(F.sum("occasions").alias("occasions"))
        .where(F.col("occasions") > 0)
    )
    return (
        repeats_by_day.join(small(windows.select("source", "calibration_end")), "source")
        .groupBy("source", month.alias("month"))
        .agg(
            F.sum("occasions").alias("occasions"),
            F.bool_or(F.col("order_date") <= F.col("calibration_end")).alias("in_calibration"),
        )
    )


