"""Checks between relations. Each recomputes or reconciles; none reads its answer from the table
it checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.models.fingerprints import (
    PINNED,
    calibration_fingerprint,
    prediction_fingerprint,
)
from returnwise.operators.rfm import KEYS
from returnwise.schemas import sum_money
from returnwise.session import small

PRECISION = 1e-9


def _differs(left: Column, right: Column, relative: float = PRECISION) -> Column:
    """True on a difference beyond the precision, and also when either side is missing."""
    allowed = F.lit(relative) * F.greatest(F.lit(1.0), F.abs(right))
    return F.coalesce(F.abs(left - right) > allowed, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ---- transactions and windows -----------------------------------------------------------------


def implausible_amount() -> Column:
    """A sale with a negative amount, no units, or no usable unit price."""
    return ~F.col("is_return") & (
        (F.col("gross_amount") < 0)
        | (F.col("quantity") <= 0)
        | (F.col("unit_price") < 0)
        | F.col("unit_price").isNull()
    )


def transaction_profile(transactions: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """One row per source with everything the line-item checks look at, from one scan.

    Line items are by far the largest relation; the checks on them share this pass.
    """
    return transactions.groupBy("source").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("quantity").alias("transaction_quantity"),
        sum_money(F.col("gross_amount")).alias("transaction_amount"),
        F.min("order_date").alias("earliest_order"),
        F.max("order_date").alias("latest_order"),
        F.count_if(implausible_amount()).alias("implausible_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required if c != "source"],
    )


def transactions_within_windows(profile: DataFrame, windows: DataFrame) -> DataFrame:
    """Sources with a transaction before calibration or after the holdout."""
    bounds = windows.select("source", "calibration_start", "holdout_end")
    return profile.join(small(bounds), "source").where(
        (F.col("earliest_order") < F.col("calibration_start"))
        | (F.col("latest_order") > F.col("holdout_end"))
    )


def sources_with_implausible_amounts(profile: DataFrame) -> DataFrame:
    """Sources holding at least one implausible sale; :func:`amounts_plausible` lists them."""
    return profile.where(F.col("implausible_rows") > 0).select("source", "implausible_rows")


def amounts_plausible(transactions: DataFrame) -> DataFrame:
    """The implausible sales themselves."""
    return transactions.where(implausible_amount())


def windows_match(windows: DataFrame, pinned: Mapping[str, tuple[date, date, date, date]]) -> DataFrame:
    """Windows of pinned sources that differ from (cal start, cal end, holdout start, holdout end)."""
    names = ("calibration_start", "calibration_end", "holdout_start", "holdout_end")
    wrong = F.lit(False)
    for source, dates in pinned.items():
        differs = _any([~F.col(n).eqNullSafe(F.lit(d)) for n, d in zip(names, dates, strict=True)])
        wrong = wrong | ((F.col("source") == source) & differs)
    return windows.select("source", *names).where(wrong)


def known_duplicates(excess: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Sources whose excess of identical line items is not the known count."""
    known = F.lit(None).cast("long")
    for source, count in expected.items():
        known = F.when(F.col("source") == source, F.lit(count).cast("long")).otherwise(known)
    return excess.select(
        "source", "excess_rows", known.alias("expected_excess_rows")
    ).where(F.col("excess_rows") != F.col("expected_excess_rows"))


def occasions_collapsed(occasions: DataFrame, profile: DataFrame) -> DataFrame:
    """One row when the collapse lost or invented lines, units or money, or collapsed nothing."""
    after = occasions.agg(
        F.count(F.lit(1)).alias("occasion_count"),
        F.sum("line_items").alias("line_item_count"),
        F.sum("quantity").alias("occasion_quantity"),
        sum_money(F.col("gross_amount")).alias("occasion_amount"),
    )
    names = ("transaction_count", "transaction_quantity", "transaction_amount")
    before = profile.agg(*[F.sum(c).alias(c) for c in names])
    return after.crossJoin(before).where(  # one row each
        (F.col("line_item_count") != F.col("transaction_count"))
        | (F.col("occasion_count") >= F.col("line_item_count"))
        | (F.col("occasion_quantity") != F.col("transaction_quantity"))
        | (F.col("occasion_amount") != F.col("transaction_amount"))
    )


# ---- customer summaries -----------------------------------------------------------------------


def no_leakage(calibration: DataFrame, windows: DataFrame) -> DataFrame:
    """Sources whose calibration summary reaches past the cutoff."""
    latest = calibration.groupBy("source").agg(
        F.max("last_order_date").alias("latest_calibration_order")
    )
    return latest.join(small(windows.select("source", "calibration_end")), "source").where(
        F.col("latest_calibration_order") > F.col("calibration_end")
    )


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, list(KEYS))


def calibration_within_full(calibration: DataFrame, full: DataFrame) -> DataFrame:
    """Customers whose calibration summary exceeds their full-period one."""
    shared = ("frequency", "total_spend", "customer_age", "first_order_date")
    both = _beside(
        calibration.select(*KEYS, *[F.col(c).alias(f"calibration_{c}") for c in shared]),
        full.select(*KEYS, *[F.col(c).alias(f"full_{c}") for c in shared]),
    )
    grows = [F.col(f"calibration_{c}") > F.col(f"full_{c}") for c in shared[:3]]
    moved = F.col("calibration_first_order_date") != F.col("full_first_order_date")
    return both.where(_any([*grows, moved]))


def _tagged(relations: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("model_name"), *KEYS) for name, df in relations.items()],
    )


def populations_align(relations: Mapping[str, DataFrame]) -> DataFrame:
    """Customers missing from any of the relations, and where they are present."""
    return (
        _tagged(relations)
        .groupBy(*KEYS)
        .agg(
            F.count_distinct("model_name").alias("models_present"),
            F.array_join(F.array_sort(F.collect_set("model_name")), ", ").alias("present_in"),
        )
        .where(F.col("models_present") != len(relations))
    )


def one_row_per_customer(relations: Mapping[str, DataFrame]) -> DataFrame:
    """Customers on more than one row of any relation."""
    return (
        _tagged(relations)
        .groupBy("model_name", *KEYS)
        .agg(F.count(F.lit(1)).alias("rows_for_customer"))
        .where(F.col("rows_for_customer") > 1)
    )


def holdout_consistent(holdout: DataFrame) -> DataFrame:
    """Holdout rows with negatives, money without purchases, or a mean that is not the mean."""
    n, spend = F.col("holdout_frequency"), F.col("holdout_spend").cast("double")
    mean = F.col("holdout_monetary_value").cast("double")
    # Four decimals on the mean leave half a unit of the last one per purchase.
    allowed = F.greatest(F.lit(0.01), n * 0.000051)
    return holdout.where(
        (n < 0)
        | (spend < 0)
        | ((n == 0) & ((spend != 0) | (mean != 0)))
        | (F.abs(mean * n - spend) > allowed)
    ).select(*KEYS, "holdout_frequency", "holdout_spend", "holdout_monetary_value")


def holdout_reconciles(
    calibration: DataFrame, full: DataFrame, holdout: DataFrame
) -> DataFrame:
    """Customers whose calibration and holdout occasions do not add up, or who miss a relation.

    A full outer join of three relations, written as one grouping of their union: each relation
    has one row per customer, and a grouping needs one shuffle where two outer joins need three.
    """
    parts = {
        "calibration_occasions": (calibration, "occasions"),
        "holdout_frequency": (holdout, "holdout_frequency"),
        "full_occasions": (full, "occasions"),
    }
    rows = reduce(
        DataFrame.unionByName,
        [
            df.select(*KEYS, F.lit(name).alias("_part"), F.col(column).cast("long").alias("_count"))
            for name, (df, column) in parts.items()
        ],
    )
    joined = rows.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("_part") == name, F.col("_count"))).alias(name) for name in parts]
    )
    added = F.col("calibration_occasions") + F.col("holdout_frequency")
    return joined.where(~F.coalesce(added == F.col("full_occasions"), F.lit(False)))


def spend_reconciles(calibration: DataFrame, full: DataFrame, holdout: DataFrame) -> DataFrame:
    """Customers whose spend in the two windows is not their full-period spend, to the cent."""
    joined = _beside(
        _beside(
            calibration.select(*KEYS, F.col("total_spend").alias("calibration_spend")),
            full.select(*KEYS, F.col("total_spend").alias("full_spend")),
        ),
        holdout.select(*KEYS, "holdout_spend"),
    )
    return joined.where(
        F.col("calibration_spend") + F.col("holdout_spend") != F.col("full_spend")
    )


def monetary_value_matches(
    calibration: DataFrame, occasions: DataFrame, windows: DataFrame
) -> DataFrame:
    """Customers whose mean repeat value does not rebuild their repeat spend.

    Repeat spend is recomputed as the spend on days after the customer's first, not as a total
    less a first purchase.
    """
    bounds = windows.select("source", "calibration_start", "calibration_end")
    first = calibration.select(
        *KEYS, "frequency", "monetary_value", F.col("first_order_date").alias("_first")
    )
    in_calibration = occasions.join(small(bounds), "source").where(
        F.col("order_date").between(F.col("calibration_start"), F.col("calibration_end"))
    )
    later = F.col("order_date") > F.col("_first")
    rebuilt = (
        in_calibration.join(first, list(KEYS))
        .groupBy(*KEYS, "frequency", "monetary_value")
        .agg(
            F.count_if(later).alias("repeat_occasions"),
            F.coalesce(F.sum(F.when(later, F.col("gross_amount"))), F.lit(0))
            .cast("double")
            .alias("repeat_spend"),
        )
    )
    product = F.col("monetary_value").cast("double") * F.col("repeat_occasions")
    allowed = F.greatest(F.lit(0.01), F.col("repeat_occasions") * 0.000051)
    return rebuilt.where(
        (F.col("frequency") != F.col("repeat_occasions"))
        | (F.abs(product - F.col("repeat_spend")) > allowed)
    )


def rfm_invariants(calibration: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of either summary breaking what recency, frequency and spend must satisfy."""
    names = ("frequency", "recency", "customer_age", "monetary_value")
    columns = [*KEYS, "occasions", "is_gamma_gamma_eligible", *names]
    both = (
        calibration.select(F.lit("calibration").alias("window_name"), *columns)
        .unionByName(full.select(F.lit("full").alias("window_name"), *columns))
    )
    x, tx, age, mean = (F.col(c) for c in names)
    return both.where(
        (tx > age)
        | (tx < 0)
        | (age < 0)
        | (x < 0)
        | (x != F.col("occasions") - 1)
        | ((x == 0) & (mean != 0))
        | ((x > 0) & (tx <= 0))
        | (F.col("is_gamma_gamma_eligible") & ((x == 0) | (mean <= 0)))
    ).select("window_name", *KEYS, *names)


# ---- look-back sensitivity --------------------------------------------------------------------


def _recounted_repeats(
    calibration: DataFrame, occasions: DataFrame, windows: DataFrame, look_backs: DataFrame
) -> DataFrame:
    """Repeats per customer and look-back, by joining each repeat to the look-backs it falls in.

    Look-backs are a handful of rows per source; a customer has at most one occasion a day.
    """
    bounds = windows.select("source", "calibration_end", "duration_holdout")
    customers = (
        calibration.select(*KEYS, "first_order_date", "customer_age")
        .join(small(bounds), "source")
    )
    repeats = (
        occasions.select(*KEYS, "order_date")
        .join(customers.select(*KEYS, "first_order_date", "calibration_end"), list(KEYS))
        .where(
            (F.col("order_date") > F.col("first_order_date"))
            & (F.col("order_date") <= F.col("calibration_end"))
        )
        .select(*KEYS, F.datediff("calibration_end", "order_date").alias("_ago"))
        .join(small(look_backs), "source")
        .where(F.col("_ago") < F.col("window_days"))
        .groupBy(*KEYS, "window_days")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    grid = customers.join(small(look_backs), "source").select(
        *KEYS, "window_days", "duration_holdout",
        F.least("window_days", "customer_age").alias("exposure_days"),
    )
    return grid.join(repeats, [*KEYS, "window_days"], "left").select(
        *KEYS, "window_days",
        F.when(
            F.col("exposure_days") > 0,
            F.coalesce("repeats", F.lit(0)).cast("double")
            / F.col("exposure_days")
            * F.col("duration_holdout"),
        ).otherwise(F.lit(0.0)).alias("predicted"),
    )


def sensitivity_complete(sensitivity: DataFrame, calibration: DataFrame) -> DataFrame:
    """Look-backs listed twice, or not covering every calibration customer."""
    population = calibration.groupBy("source").agg(F.count(F.lit(1)).alias("population"))
    repeated = (
        sensitivity.groupBy("source", "window_days")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select("source", "window_days", F.lit("duplicate row").alias("problem"))
    )
    partial = (
        sensitivity.join(small(population), "source", "left")
        .where(~F.col("customers").eqNullSafe(F.col("population")))
        .select("source", "window_days", F.lit("population incomplete").alias("problem"))
    )
    return repeated.unionByName(partial)


def sensitivity_recomputes(
    sensitivity: DataFrame, calibration: DataFrame, occasions: DataFrame, windows: DataFrame
) -> DataFrame:
    """Look-backs whose total differs from an independent recount."""
    look_backs = sensitivity.select("source", "window_days").distinct()
    recount = (
        _recounted_repeats(calibration, occasions, windows, look_backs)
        .groupBy("source", "window_days")
        .agg(F.sum("predicted").alias("expected_predicted_purchases"))
    )
    return (
        sensitivity.select("source", "window_days", "predicted_purchases")
        .join(small(recount), ["source", "window_days"], "left")
        .where(_differs(F.col("predicted_purchases"), F.col("expected_predicted_purchases")))
    )


# ---- after a fit ------------------------------------------------------------------------------


def sensitivity_matches_scored(
    sensitivity: DataFrame, scored: DataFrame, recent_window_days: int
) -> DataFrame:
    """Sources whose configured look-back does not add up to the scored recent-rate rule."""
    totals = scored.groupBy("source").agg(
        F.sum("baseline_recent").alias("scored_predicted"),
        F.sum("holdout_frequency").alias("scored_actual"),
    )
    chosen = sensitivity.where(F.col("window_days") == recent_window_days).select(
        "source",
        F.col("predicted_purchases").alias("sensitivity_predicted"),
        F.col("actual_purchases").alias("sensitivity_actual"),
    )
    return totals.join(small(chosen), "source", "left").where(
        _differs(F.col("sensitivity_predicted"), F.col("scored_predicted"))
        | ~F.col("sensitivity_actual").eqNullSafe(F.col("scored_actual"))
    )


def baselines_recompute(
    scored: DataFrame,
    calibration: DataFrame,
    occasions: DataFrame,
    windows: DataFrame,
    recent_window_days: int,
) -> DataFrame:
    """Scored customers whose naive rules differ from a recomputation out of calibration alone."""
    look_back = windows.select("source", F.lit(recent_window_days).alias("window_days"))
    recent = _recounted_repeats(calibration, occasions, windows, look_back).select(
        *KEYS, F.col("predicted").alias("_recent")
    )
    pooled = calibration.groupBy("source").agg(
        (F.sum("frequency").cast("double") / F.sum("customer_age")).alias("_rate"),
        (
            F.sum(F.when(F.col("is_gamma_gamma_eligible"), F.col("monetary_value"))).cast("double")
            / F.count_if("is_gamma_gamma_eligible")
        ).alias("_value"),
    )
    x = F.col("frequency").cast("double")
    own = F.when(
        F.col("customer_age") > 0, x / F.col("customer_age") * F.col("_days")
    ).otherwise(F.lit(0.0))
    value = F.when(
        F.col("is_gamma_gamma_eligible"), F.col("monetary_value").cast("double")
    ).otherwise(F.col("_value"))
    flat = F.col("_rate") * F.col("_days")
    expected = {
        "baseline_purchases": own,
        "baseline_purchases_flat": flat,
        "baseline_avg_value": value,
        "baseline_revenue": own * value,
        "baseline_revenue_flat": flat * F.col("_value"),
        "baseline_carry_forward": x,
        "baseline_revenue_carry_forward": x * value,
        "baseline_recent": F.col("_recent"),
        "baseline_revenue_recent": F.col("_recent") * value,
        "baseline_zero": F.lit(0.0),
    }
    recomputed = (
        calibration.select(
            *KEYS, "frequency", "customer_age", "monetary_value", "is_gamma_gamma_eligible"
        )
        .join(small(pooled), "source")
        .join(
            small(windows.select("source", F.col("duration_holdout").alias("_days"))), "source"
        )
        .join(recent, list(KEYS))
        .select(*KEYS, *[column.alias(f"expected_{name}") for name, column in expected.items()])
    )
    return (
        scored.select(*KEYS, *expected)
        .join(recomputed, list(KEYS))
        .where(_any([_differs(F.col(name), F.col(f"expected_{name}")) for name in expected]))
    )


def scored_horizon(scored: DataFrame, windows: DataFrame) -> DataFrame:
    """Scored customers whose forecast length is not the holdout length, missing ones included."""
    bounds = windows.select("source", F.col("duration_holdout").alias("window_days"))
    return (
        scored.select(*KEYS, "horizon_days")
        .join(small(bounds), "source")
        .where(~F.col("horizon_days").eqNullSafe(F.col("window_days")))
    )


def scored_population(calibration: DataFrame, scored: DataFrame) -> DataFrame:
    """Customers not on exactly one row of both relations."""
    sides = _tagged({"calibration": calibration, "scored": scored})
    counts = sides.groupBy(*KEYS).agg(
        F.count_if(F.col("model_name") == "calibration").alias("calibration_rows"),
        F.count_if(F.col("model_name") == "scored").alias("scored_rows"),
    )
    return counts.where((F.col("calibration_rows") != 1) | (F.col("scored_rows") != 1))


def predictions_unchanged(predictions: DataFrame, fit_runs: DataFrame) -> DataFrame:
    """Sources whose stored predictions are not the ones the recorded fit wrote."""
    names = [f"{w}_{c}" for c in PINNED for w in ("sum", "weighted", "horizon_weighted")]
    recorded = fit_runs.select("source", *[F.col(n).alias(f"_{n}") for n in names])
    return (
        prediction_fingerprint(predictions)
        .join(small(recorded), "source", "left")
        .where(
            _any(
                [
                    F.coalesce(
                        F.abs(F.col(n) - F.col(f"_{n}")) > PRECISION * F.abs(F.col(f"_{n}")),
                        F.lit(True),
                    )
                    for n in names
                ]
            )
        )
        .select("source")
    )


def inputs_unchanged(calibration: DataFrame, fit_runs: DataFrame) -> DataFrame:
    """Sources whose calibration summary is no longer the one the recorded fit read."""
    exact = (
        "calibration_rows",
        "sum_frequency",
        "sum_recency",
        "sum_customer_age",
        "weighted_frequency",
        "weighted_recency",
        "weighted_customer_age",
        "weighted_monetary_value_e4",
    )
    recorded = fit_runs.select(
        "source",
        *[F.col(n).alias(f"_{n}") for n in exact],
        F.col("sum_monetary_value").alias("_sum_monetary_value"),
    )
    current = calibration_fingerprint(calibration)
    moved = [~F.col(n).eqNullSafe(F.col(f"_{n}")) for n in exact]
    money = F.coalesce(
        F.abs(F.col("sum_monetary_value") - F.col("_sum_monetary_value"))
        > F.greatest(F.lit(0.00005), F.abs(F.col("sum_monetary_value")) * 1e-15),
        F.lit(True),
    )
    return (
        current.join(small(recorded), "source", "left")
        .where(_any([*moved, money]))
        .select(
            "source",
            F.col("_calibration_rows").alias("fitted_on_rows"),
            F.col("calibration_rows").alias("current_rows"),
            F.col("_sum_monetary_value").alias("fitted_on_spend"),
            F.col("sum_monetary_value").alias("current_spend"),
        )
    )
