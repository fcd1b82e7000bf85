"""Single-purpose diagnostics over the scored relation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnwise.metrics.errors import NAN, percent_error_column
from returnwise.metrics.rank import assign_deciles, decile_table
from returnwise.models.draws import Draws, hdi
from returnwise.models.fit import Fit
from returnwise.models.predict import expected_over_draws, expected_over_states
from returnwise.operators.ranking import exact_quantiles
from returnwise.session import small

DAYS_PER_WEEK = 7

# Table 2 of Fader, Hardie and Lee (2005), time in weeks.
PUBLISHED_BG_NBD = {"r": 0.243, "alpha": 4.414, "a": 0.793, "b": 2.426}
PUBLISHED_PARETO_NBD = {"r": 0.553, "alpha": 10.578, "s": 0.606, "beta": 11.669}
PUBLISHED_LOG_LIKELIHOOD = {"bg_nbd": -9582.4, "pareto_nbd": -9595.0}
PUBLISHED_CUMULATIVE_ERROR_PERCENT = {"bg_nbd": -4.0, "pareto_nbd": -2.0}
PUBLISHED_SAMPLE_CUSTOMERS = 2357
PUBLISHED_ZERO_CLASS = 1411
PUBLISHED_CONDITIONAL_CORRELATION = 0.626


class ReconciliationError(ValueError):
    """Two views of the same forecast disagree."""


def alive_by_construction(scored: DataFrame) -> DataFrame:
    """Customers the model calls certainly active, and the share of them that came back."""
    certain = F.col("probability_alive") >= 1.0
    returned = F.when(certain, (F.col("holdout_frequency") > 0).cast("double"))
    return scored.groupBy("source").agg(
        F.count_if(certain).alias("customers"),
        F.coalesce(F.avg(returned), F.lit(NAN)).alias("returned_share"),
    )


def interval_summary(scored: DataFrame) -> DataFrame:
    """Relative width of the revenue intervals and how often the outcome falls inside.

    No row for a source whose fit has no intervals. Rows with a zero estimate have no relative
    width but do count towards coverage.
    """
    low, high = F.col("forward_revenue_hdi_low"), F.col("forward_revenue_hdi_high")
    estimate = F.col("expected_forward_revenue")
    rows = scored.where(low.isNotNull() & high.isNotNull()).select(
        "source",
        F.when(estimate > 0, (high - low) / F.when(estimate > 0, estimate)).alias("width"),
        F.col("holdout_spend").cast("double").between(low, high).cast("double").alias("inside"),
    )
    widths = exact_quantiles(
        rows.where(F.col("width").isNotNull()),
        "width",
        {
            "median_relative_width": 0.5,
            "p5_relative_width": 0.05,
            "p95_relative_width": 0.95,
        },
        ["source"],
    )
    cover = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("inside").alias("coverage")
    )
    # One row per source on both sides.
    return cover.join(F.broadcast(widths), "source", "left").select(
        "source", "customers", "median_relative_width", "p5_relative_width",
        "p95_relative_width", "coverage",
    )


def month_edges(windows: DataFrame) -> DataFrame:
    """Per source, the holdout cut at month starts: ``(source, month, days, from_day, to_day)``.

    A window starting inside a month has a partial first month. ``month`` is the segment's first
    day; the offsets count days since the holdout start.
    """
    first_full = F.add_months(F.trunc("holdout_start", "MM"), 1)
    stop = F.date_add("holdout_end", 1)
    starts = F.when(
        first_full < stop,
        F.concat(
            F.array("holdout_start"),
            F.sequence(first_full, F.date_sub(stop, 1), F.expr("interval 1 month")),
        ),
    ).otherwise(F.array("holdout_start"))
    segments = windows.select(
        "source", "holdout_start", stop.alias("_stop"), F.explode(starts).alias("month")
    )
    following = Window.partitionBy("source").orderBy("month")
    until = F.coalesce(F.lead("month").over(following), F.col("_stop"))
    return segments.select(
        "source",
        "month",
        F.datediff(until, F.col("month")).alias("days"),
        F.datediff("month", "holdout_start").alias("from_day"),
        F.datediff(until, F.col("holdout_start")).alias("to_day"),
    )


def monthly_actuals(occasions: DataFrame, windows: DataFrame) -> DataFrame:
    """Holdout occasions of calibration customers per month segment, empty months included.

    One aggregate per customer tells who belongs; each customer brings its per-day counts along,
    at most one entry per day of the holdout.
    """
    day = F.col("order_date")
    in_calibration = day.between(F.col("calibration_start"), F.col("calibration_end"))
    in_holdout = day.between(F.col("holdout_start"), F.col("holdout_end"))
    bounds = windows.select(
        "source", "calibration_start", "calibration_end", "holdout_start", "holdout_end"
    )
    months = F.greatest(F.trunc("order_date", "MM"), F.col("holdout_start"))
    per_customer = (
        occasions.join(small(bounds), "source")
        .where(in_calibration | in_holdout)
        .groupBy("source", "customer_id")
        .agg(
            F.bool_or(in_calibration).alias("_member"),
            F.collect_list(F.when(in_holdout, months)).alias("_months"),
        )
    )
    counted = (
        per_customer.where("_member")
        .select("source", F.explode("_months").alias("month"))
        .groupBy("source", "month")
        .agg(F.count(F.lit(1)).alias("actual"))
    )
    return (
        month_edges(windows)
        .join(small(counted), ["source", "month"], "left")
        .select(
            "source", "month", "days", "from_day", "to_day",
            F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
        )
    )


def monthly_holdout(
    occasions: DataFrame, windows: DataFrame, states: DataFrame, fit: Fit | Draws, source: str
) -> DataFrame:
    """Actual and expected holdout purchases per month for one source.

    A month's expectation is the conditional expectation up to its end less that up to its start.
    Over draws it is their mean, as the forecasts are, and the narrowest interval of the draws'
    months comes with it (``expected_low``, ``expected_high``).
    """
    actual = monthly_actuals(occasions, windows).where(F.col("source") == source)
    # The month edges are calendar-sized: one per month of the holdout window.
    edges = [r["to_day"] for r in actual.select("to_day").distinct().collect()]
    drawn = isinstance(fit, Draws)
    points = fit.points if drawn else np.array([fit.vector])
    family = fit.fit.family if drawn else fit.family
    cumulative = expected_over_draws(states, family, points, edges)
    # One row for each month and draw.
    ordered = Window.partitionBy("source", "draw_id").orderBy("to_day")
    each = actual.join(small(cumulative), actual.to_day == cumulative.length).withColumn(
        "expected_in_month",
        F.col("expected") - F.coalesce(F.lag("expected").over(ordered), F.lit(0.0)),
    )
    table = each.groupBy("source", "month", "days", "actual").agg(
        F.avg("expected_in_month").alias("expected"),
        F.collect_list("expected_in_month").alias("_draws"),
    )
    low, high = hdi(F.col("_draws"))
    return table.select(
        "source",
        "month",
        "days",
        "actual",
        "expected",
        (F.col("expected") - F.col("actual")).alias("shortfall"),
        *([low.alias("expected_low"), high.alias("expected_high")] if drawn else []),
    )


def require_reconciled(monthly: DataFrame, scored: DataFrame) -> None:
    """The months must add up to the scored totals, or they describe another forecast."""
    months = monthly.agg(F.sum("actual").alias("actual"), F.sum("expected").alias("expected")).first()
    totals = scored.agg(
        F.sum("holdout_frequency").alias("actual"), F.sum("expected_purchases").alias("expected")
    ).first()
    same = months["actual"] == totals["actual"] and math.isclose(
        months["expected"], totals["expected"], rel_tol=1e-6
    )
    if not same:
        raise ReconciliationError(
            f"monthly figures give {months['actual']} actual and {months['expected']:.3f} "
            f"expected, the scored relation {totals['actual']} and {totals['expected']:.3f}."
        )


def monthly_trend(monthly: DataFrame, worst: int = 3) -> DataFrame:
    """Per-day change from the first month to the last, and the worst months' share of the miss."""
    rate = {c: F.col(c) / F.col("days") for c in ("expected", "actual")}
    ends = monthly.groupBy("source").agg(
        *[F.min_by(rate[c], "month").alias(f"first_{c}") for c in rate],
        *[F.max_by(rate[c], "month").alias(f"last_{c}") for c in rate],
        F.sum("shortfall").alias("shortfall"),
    )
    # The ranking window runs over the months of one source, a calendar-sized group.
    ranked = Window.partitionBy("source").orderBy("shortfall", "month")
    bottom = (
        monthly.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= worst)
        .groupBy("source")
        .agg(
            F.sum("shortfall").alias("worst_shortfall"),
            F.concat_ws(
                ",", F.transform(F.array_sort(F.collect_list("month")), lambda m: m.cast("string"))
            ).alias("worst_months"),
        )
    )
    change = {
        c: F.try_divide(F.col(f"last_{c}"), F.col(f"first_{c}")) - 1 for c in ("expected", "actual")
    }
    return ends.join(F.broadcast(bottom), "source").select(
        "source",
        change["expected"].alias("expected_change"),
        change["actual"].alias("actual_change"),
        "shortfall",
        "worst_months",
        F.when(F.col("shortfall") != 0, F.col("worst_shortfall") / F.col("shortfall"))
        .otherwise(F.lit(NAN))
        .alias("worst_share"),
    )


def lowest_decile(scored: DataFrame) -> DataFrame:
    """Who sits in the lowest-predicted tenth, and what they did."""
    bottom = assign_deciles(scored, "expected_forward_revenue", by=["source"])
    last = bottom.groupBy("source").agg(F.max("decile").alias("_last"))
    repeat = F.col("frequency") > 0
    spend = F.col("holdout_spend").cast("double")
    return (
        bottom.join(small(last), "source")
        .where(F.col("decile") == F.col("_last"))
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(repeat).alias("repeat_buyers"),
            F.avg(F.when(repeat, F.col("probability_alive"))).alias(
                "repeat_mean_probability_alive"
            ),
            F.avg(F.when(repeat, spend)).alias("repeat_mean_actual"),
            F.avg(F.when(~repeat, spend)).alias("one_time_mean_actual"),
        )
    )


def published_parameters(spark: SparkSession, family: str = "bg_nbd") -> DataFrame:
    """The published estimates as rows ``(parameter, published)``; rates are per week."""
    table = {"bg_nbd": PUBLISHED_BG_NBD, "pareto_nbd": PUBLISHED_PARETO_NBD}[family]
    return spark.createDataFrame(list(table.items()), "parameter string, published double")


def parameter_comparison(parameters: DataFrame, family: str = "bg_nbd") -> DataFrame:
    """Fitted parameters in days and in weeks beside the published ones.

    Only a rate's scale carries the time unit, so only ``alpha`` and ``beta`` are divided.
    """
    published = published_parameters(parameters.sparkSession, family)
    timed = F.col("parameter").isin("alpha", "beta")
    return (
        parameters.where(F.col("family") == family)
        .join(F.broadcast(published), "parameter")
        .select(
            "source",
            "parameter",
            F.col("value").alias("fitted_days"),
            F.when(timed, F.col("value") / DAYS_PER_WEEK).otherwise(F.col("value")).alias(
                "fitted_weeks"
            ),
            "published",
        )
    )


def calibration_fit(scored: DataFrame, states: DataFrame, fit: Fit) -> DataFrame:
    """In-sample, holdout and cumulative totals of one source: ``(part, actual, expected, error)``.

    The in-sample expectation is unconditional over each customer's own age. The cumulative row
    adds both windows, the basis published forecasts use.
    """
    in_sample = expected_over_states(states, fit, [], new_customer=True).agg(
        F.sum("expected").alias("fitted")
    )
    totals = scored.agg(
        F.sum("frequency").alias("repeats"),
        F.sum("holdout_frequency").alias("returned"),
        F.sum("expected_purchases").alias("forecast"),
    )
    # Two one-row relations.
    both = totals.crossJoin(F.broadcast(in_sample))
    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("part"),
                actual.cast("double").alias("actual"),
                expected.cast("double").alias("expected"),
            )
            for name, actual, expected in (
                ("calibration", F.col("repeats"), F.col("fitted")),
                ("holdout", F.col("returned"), F.col("forecast")),
                (
                    "cumulative",
                    F.col("repeats") + F.col("returned"),
                    F.col("fitted") + F.col("forecast"),
                ),
            )
        ]
    )
    rows = both.select(F.explode(parts).alias("p")).select("p.*")
    return rows.withColumn(
        "percent_error", percent_error_column(F.col("actual"), F.col("expected"))
    )


def population_summary(scored: DataFrame) -> DataFrame:
    """The counts a reader needs beside every score."""
    zero = F.col("frequency") == 0
    returned = F.col("holdout_frequency") > 0
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(~returned).alias("non_returners"),
        F.avg(F.col("customer_age").cast("double")).alias("mean_customer_age"),
        F.count_if(zero).alias("zero_repeat_customers"),
        F.avg(F.when(zero, F.col("expected_purchases"))).alias("zero_repeat_expected"),
        F.avg(F.when(zero, F.col("holdout_frequency").cast("double"))).alias("zero_repeat_actual"),
        F.count_if(zero & returned).alias("shared_order_value_estimates"),
    )


def decile_comparison(scored: DataFrame) -> DataFrame:
    """The revenue ranking of the model beside that of the naive rate rule, decile by decile."""
    model = decile_table(scored, "holdout_spend", "expected_forward_revenue", by=["source"])
    naive = decile_table(scored, "holdout_spend", "baseline_revenue", by=["source"]).select(
        "source",
        "decile",
        F.col("mean_actual").alias("naive_mean_actual"),
        F.col("share_of_actual").alias("naive_share_of_actual"),
    )
    # Ten rows per source on both sides.
    return model.join(F.broadcast(naive), ["source", "decile"]).withColumn(
        "share_gap", F.col("share_of_actual") - F.col("naive_share_of_actual")
    )
