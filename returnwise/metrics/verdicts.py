"""Conclusions as data, computed from the score matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnwise.metrics.scoring import CHAMPION

ZERO_RULE = "baseline_zero"


def _metric(name: str) -> Column:
    return F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)


def headline(metrics: DataFrame) -> DataFrame:
    """Model against the naive rules, per source, from the long metrics relation.

    How many rules that forecast purchases land closer on the total, the closest of them, how many
    rules the model beats on MAE, its margin over predicting nobody returns, and whether any rule
    ranks customers at least as well (an undefined correlation never wins).
    """
    # One row per source, quantity and rule.
    wide = metrics.groupBy("source", "quantity", "model_family").agg(
        _metric("mae"), _metric("percent_error"), _metric("spearman_rho")
    )
    purchases = wide.where(
        (F.col("quantity") == "purchases")
        & (F.col("model_family").startswith("baseline") | (F.col("model_family") == CHAMPION))
    )
    is_model = F.col("model_family") == CHAMPION
    model = purchases.where(is_model).select(
        "source",
        F.col("mae").alias("model_mae"),
        F.col("percent_error").alias("model_percent_error"),
    )
    rules = purchases.where(~is_model).join(F.broadcast(model), "source")
    forecasts = F.col("model_family") != ZERO_RULE
    closer = forecasts & (F.abs("percent_error") < F.abs("model_percent_error"))
    beaten = F.col("model_mae") < F.col("mae")
    zero_mae = F.max(F.when(~forecasts, F.col("mae")))
    verdict = rules.groupBy("source", "model_percent_error", "model_mae").agg(
        F.count(F.lit(1)).alias("naive_rules"),
        F.count_if(closer).alias("rules_closer_on_total"),
        F.min_by(
            "model_family", F.when(forecasts, F.struct(F.abs("percent_error"), "model_family"))
        ).alias("closest_rule"),
        F.count_if(beaten).alias("rules_beaten_on_mae"),
        (100.0 * F.try_divide(zero_mae - F.col("model_mae"), zero_mae)).alias(
            "margin_over_zero_percent"
        ),
    )
    rho = F.when(F.isnan("spearman_rho"), F.lit(-1.0)).otherwise(
        F.coalesce("spearman_rho", F.lit(-1.0))
    )
    ranking = (
        wide.where(F.col("quantity") == "revenue")
        .groupBy("source")
        .agg(
            F.max(F.when(is_model, rho)).alias("model_rho"),
            F.max(F.when(~is_model, rho)).alias("best_naive_rho"),
            F.max_by("model_family", F.struct(rho, F.col("model_family"))).alias("ranking_winner"),
        )
    )
    return verdict.join(F.broadcast(ranking), "source").withColumn(
        "naive_ranks_at_least_as_well", F.col("best_naive_rho") >= F.col("model_rho")
    )


def sensitivity_verdict(sensitivity: DataFrame, model_errors: DataFrame) -> DataFrame:
    """Does the recent-rate rule beat the model at every look-back, at none, or up to a length?

    ``model_errors`` is ``(source, model_percent_error)``. The verdict is ``all``, ``none``,
    ``crossover`` (wins short, loses long, with the two look-backs around the change) or
    ``mixed``. Also names the least favourable look-back.
    """
    beats = F.abs("percent_error") < F.abs("model_percent_error")
    rows = sensitivity.join(F.broadcast(model_errors), "source").withColumn("_beats", beats)
    # Look-backs of one source: a handful of rows.
    ordered = Window.partitionBy("source").orderBy("window_days")
    rows = rows.withColumn(
        "_regained", F.col("_beats") & ~F.coalesce(F.lag("_beats").over(ordered), F.lit(True))
    )
    totals = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("look_backs"),
        F.count_if("_beats").alias("look_backs_winning"),
        F.max(F.when(F.col("_beats"), F.col("window_days"))).alias("longest_winning"),
        F.min(F.when(~F.col("_beats"), F.col("window_days"))).alias("shortest_losing"),
        F.bool_or("_regained").alias("_regained"),
        # Look-backs longer than every customer's age are one rule; the shortest stands for them,
        # whatever the last bits of their sums.
        F.max_by(
            "window_days", F.struct(F.round(F.abs("percent_error"), 9), -F.col("window_days"))
        ).alias("least_favourable"),
    )
    verdict = (
        F.when(F.col("look_backs_winning") == F.col("look_backs"), "all")
        .when(F.col("look_backs_winning") == 0, "none")
        .when(~F.col("_regained"), "crossover")
        .otherwise("mixed")
    )
    return totals.select(
        "source", "look_backs", "look_backs_winning", "longest_winning", "shortest_losing",
        "least_favourable", verdict.alias("verdict"),
    )


def top_decile_gap(comparison: DataFrame) -> DataFrame:
    """Share of revenue in the top tenth under both rankings."""
    return comparison.where(F.col("decile") == 1).select(
        "source", "share_of_actual", "naive_share_of_actual", "share_gap"
    )


def lowest_decile_inverted(deciles: DataFrame) -> DataFrame:
    """Whether the lowest tenth out-spends the weakest of deciles five to nine."""
    middle = F.when(F.col("decile").between(5, 9), F.col("mean_actual"))
    lowest = F.when(F.col("decile") == 10, F.col("mean_actual"))
    return deciles.groupBy("source").agg(
        F.max(lowest).alias("lowest_mean_actual"),
        F.min(middle).alias("middle_lowest"),
        F.max(middle).alias("middle_highest"),
        (F.max(lowest) > F.min(middle)).alias("inverted"),
    )
