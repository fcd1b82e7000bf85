"""Recency, frequency and spend per customer, and the holdout outcome beside them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.session import small

# Customer relations are grouped by these columns and nothing else (what is constant per source is
# carried as a maximum), so that joins between them find both sides partitioned alike.
KEYS = ("source", "customer_id")


def exact_mean(total: Column, count: Column) -> Column:
    """Money over a count to four decimals, halves up, zero for none.

    Decimal division: exact halves of the fourth decimal are real in money, and a double quotient
    falls on either side of them.
    """
    quotient = total.cast(schemas.MONEY) / F.when(count > 0, count).cast("decimal(10,0)")
    return F.coalesce(F.round(quotient, 4), F.lit(0)).cast(schemas.MEAN_MONEY)


def mean_repeat_spend(total: Column, first: Column, repeats: Column) -> Column:
    """Unrounded mean spend over repeat occasions, zero without repeats."""
    return F.when(
        repeats > 0, (total - first).cast("double") / repeats.cast("double")
    ).otherwise(F.lit(0.0))


def _summary_columns(
    occasions: Column, first_day: Column, last_day: Column, total: Column, first: Column,
    period_end: Column,
) -> list[Column]:
    repeats = occasions - 1
    return [
        occasions.cast("long").alias("occasions"),
        repeats.cast("long").alias("frequency"),
        F.datediff(last_day, first_day).alias("recency"),
        F.datediff(period_end, first_day).alias("customer_age"),
        first_day.alias("first_order_date"),
        last_day.alias("last_order_date"),
        total.cast(schemas.MONEY).alias("total_spend"),
        first.cast(schemas.MONEY).alias("first_occasion_spend"),
        exact_mean(total - first, repeats).alias("monetary_value"),
        ((repeats > 0) & (total - first > 0)).alias("is_gamma_gamma_eligible"),
    ]


def rfm_summary(
    occasions: DataFrame, windows: DataFrame, period_start: str, period_end: str
) -> DataFrame:
    """Summarise each customer over one window, named by two columns of ``windows``.

    ``frequency`` counts repeats, ``recency`` is the age at the last purchase, ``customer_age``
    the age when the window closes. The window filter sits below the aggregate, so only rows of
    the window are shuffled.
    """
    bounds = windows.select(
        "source", F.col(period_start).alias("_start"), F.col(period_end).alias("_end")
    )
    in_period = occasions.join(small(bounds), "source").where(
        F.col("order_date").between(F.col("_start"), F.col("_end"))
    )
    grouped = in_period.groupBy(*KEYS).agg(
        F.max("_end").alias("_end"),
        F.count(F.lit(1)).alias("_n"),
        F.min("order_date").alias("_first_day"),
        F.max("order_date").alias("_last_day"),
        schemas.sum_money(F.col("gross_amount")).alias("_total"),
        F.min_by("gross_amount", "order_date").alias("_first"),
    )
    return grouped.select(
        *KEYS,
        *_summary_columns(
            F.col("_n"), F.col("_first_day"), F.col("_last_day"), F.col("_total"),
            F.col("_first"), F.col("_end"),
        ),
    )


def rfm_calibration(occasions: DataFrame, windows: DataFrame) -> DataFrame:
    """The only input a fit may read."""
    return rfm_summary(occasions, windows, "calibration_start", "calibration_end")


def rfm_full(occasions: DataFrame, windows: DataFrame) -> DataFrame:
    """Both windows together; for reconciliation, never for fitting."""
    return rfm_summary(occasions, windows, "calibration_start", "holdout_end")


def _holdout_columns(n: Column, spend: Column) -> list[Column]:
    count = F.coalesce(n, F.lit(0)).cast("long")
    total = F.coalesce(spend, F.lit(0).cast(schemas.MONEY)).cast(schemas.MONEY)
    return [
        count.alias("holdout_frequency"),
        total.alias("holdout_spend"),
        exact_mean(total, count).alias("holdout_monetary_value"),
    ]


def holdout_actuals(occasions: DataFrame, windows: DataFrame) -> DataFrame:
    """What every calibration customer did in the holdout window, zeros kept.

    One conditional aggregate instead of a left join from the calibration customers: a customer
    belongs to the population when any of their occasions falls inside calibration.
    """
    day = F.col("order_date")
    in_calibration = day.between(F.col("calibration_start"), F.col("calibration_end"))
    in_holdout = day.between(F.col("holdout_start"), F.col("holdout_end"))
    bounds = windows.select(
        "source", "calibration_start", "calibration_end", "holdout_start", "holdout_end",
        "duration_holdout",
    )
    return (
        occasions.join(small(bounds), "source")
        .where(in_calibration | in_holdout)
        .groupBy(*KEYS)
        .agg(
            F.max("duration_holdout").alias("duration_holdout"),
            F.count_if(in_calibration).alias("_calibration"),
            F.count_if(in_holdout).alias("_n"),
            schemas.sum_money(F.when(in_holdout, F.col("gross_amount"))).alias("_spend"),
        )
        .where(F.col("_calibration") > 0)
        .select(*KEYS, *_holdout_columns(F.col("_n"), F.col("_spend")), "duration_holdout")
    )


def _recent_count(days: int) -> Column:
    """Occasions in the last ``days`` days of calibration, cutoff included."""
    before_end = F.datediff(F.col("calibration_end"), F.col("order_date"))
    return F.count_if((before_end >= 0) & (before_end < days)).alias(f"_recent_{days}")


def _repeats_within(days: int) -> Column:
    """Recent occasions without the first one, which falls inside only for young customers."""
    return (
        F.col(f"_recent_{days}") - F.when(F.col("customer_age") < days, 1).otherwise(0)
    ).cast("long")


def recent_counts(occasions: DataFrame, windows: DataFrame, days: Iterable[int]) -> DataFrame:
    """Calibration age and recent-repeat counts for many look-backs, from one scan."""
    days = sorted(set(days))
    grouped = (
        occasions.join(
            small(windows.select("source", "calibration_start", "calibration_end")), "source"
        )
        .where(F.col("order_date").between(F.col("calibration_start"), F.col("calibration_end")))
        .groupBy(*KEYS)
        .agg(
            F.max("calibration_end").alias("calibration_end"),
            F.min("order_date").alias("_first_day"),
            *[_recent_count(d) for d in days],
        )
        .withColumn("customer_age", F.datediff("calibration_end", "_first_day"))
    )
    return grouped.select(
        *KEYS, "customer_age", *[_repeats_within(d).alias(f"repeats_{d}") for d in days]
    )


def recent_repeats(occasions: DataFrame, windows: DataFrame, window_days: int) -> DataFrame:
    """Repeats in the last ``window_days`` days of calibration and the exposure behind them."""
    return recent_counts(occasions, windows, [window_days]).select(
        *KEYS,
        F.lit(window_days).alias("window_days"),
        F.col(f"repeats_{window_days}").alias("recent_repeats"),
        F.least(F.lit(window_days), F.col("customer_age")).alias("recent_exposure_days"),
    )


def customer_windows(
    occasions: DataFrame, windows: DataFrame, look_backs: Iterable[int]
) -> DataFrame:
    """Every per-customer quantity of both windows, from a single shuffle of the occasions.

    The calibration and full-period summaries, the holdout outcome and the repeats of any number of
    look-backs are projections of this relation (the ``*_of`` functions), so a run that stores it
    shuffles the occasions once for all of them. Columns a projection does not read are pruned from
    the aggregate.
    """
    day, amount = F.col("order_date"), F.col("gross_amount")
    in_calibration = day.between(F.col("calibration_start"), F.col("calibration_end"))
    in_holdout = day.between(F.col("holdout_start"), F.col("holdout_end"))
    calibration_day = F.when(in_calibration, day)
    bounds = windows.select(
        "source", "calibration_start", "calibration_end", "holdout_start", "holdout_end",
        "duration_holdout",
    )
    return (
        occasions.join(small(bounds), "source")
        .where(day.between(F.col("calibration_start"), F.col("holdout_end")))
        .groupBy(*KEYS)
        .agg(
            *[
                F.max(c).alias(c)
                for c in ("calibration_end", "holdout_end", "duration_holdout")
            ],
            F.count_if(in_calibration).alias("calibration_occasions"),
            F.min(calibration_day).alias("calibration_first_day"),
            F.max(calibration_day).alias("calibration_last_day"),
            schemas.sum_money(F.when(in_calibration, amount)).alias("calibration_spend"),
            F.min_by(amount, calibration_day).alias("calibration_first_spend"),
            F.count(F.lit(1)).alias("full_occasions"),
            F.min(day).alias("full_first_day"),
            F.max(day).alias("full_last_day"),
            schemas.sum_money(amount).alias("full_spend"),
            F.min_by(amount, day).alias("full_first_spend"),
            F.count_if(in_holdout).alias("holdout_occasions"),
            schemas.sum_money(F.when(in_holdout, amount)).alias("holdout_total"),
            *[_recent_count(d) for d in sorted(set(look_backs))],
        )
        .withColumn(
            "customer_age", F.datediff("calibration_end", "calibration_first_day")
        )
    )


def _summary_of(wide: DataFrame, part: str, period_end: str) -> list[Column]:
    names = ("occasions", "first_day", "last_day", "spend", "first_spend")
    return _summary_columns(*[F.col(f"{part}_{n}") for n in names], F.col(period_end))


def _members(wide: DataFrame) -> DataFrame:
    """Customers with an occasion in calibration: the population of everything but the full view."""
    return wide.where(F.col("calibration_occasions") > 0)


def calibration_of(wide: DataFrame) -> DataFrame:
    """The calibration summary out of :func:`customer_windows`."""
    return _members(wide).select(*KEYS, *_summary_of(wide, "calibration", "calibration_end"))


def full_of(wide: DataFrame) -> DataFrame:
    """The full-period summary out of :func:`customer_windows`."""
    return wide.select(*KEYS, *_summary_of(wide, "full", "holdout_end"))


def holdout_of(wide: DataFrame) -> DataFrame:
    """The holdout outcome out of :func:`customer_windows`."""
    return _members(wide).select(
        *KEYS,
        *_holdout_columns(F.col("holdout_occasions"), F.col("holdout_total")),
        "duration_holdout",
    )


def counts_of(wide: DataFrame, look_backs: Iterable[int]) -> DataFrame:
    """Age, recent repeats per look-back and holdout purchases out of :func:`customer_windows`."""
    return _members(wide).select(
        *KEYS,
        "customer_age",
        *[_repeats_within(d).alias(f"repeats_{d}") for d in sorted(set(look_backs))],
        F.col("holdout_occasions").alias("holdout_frequency"),
    )


def history_of(wide: DataFrame, recent_window_days: int) -> DataFrame:
    """Calibration summary, holdout outcome and recent repeats side by side."""
    return _members(wide).select(
        *KEYS,
        *_summary_of(wide, "calibration", "calibration_end"),
        *_holdout_columns(F.col("holdout_occasions"), F.col("holdout_total")),
        "duration_holdout",
        F.lit(recent_window_days).alias("recent_window_days"),
        _repeats_within(recent_window_days).alias("recent_repeats"),
        F.least(F.lit(recent_window_days), F.col("customer_age")).alias("recent_exposure_days"),
    )


def customer_history(
    occasions: DataFrame, windows: DataFrame, recent_window_days: int
) -> DataFrame:
    """:func:`history_of` straight from the occasions; what the scored relation is built on."""
    wide = customer_windows(occasions, windows, [recent_window_days])
    return history_of(wide, recent_window_days)
