"""Where the error lives: tables by calibration repeat count."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.metrics.rank import spearman
from returnwise.metrics.scoring import CHAMPION
from returnwise.settings import FREQUENCY_BUCKETS, TOP_BUCKET


def bucket_label(frequency: Column) -> Column:
    """Repeat count as a label, everything above the last bucket sharing one."""
    top = max(FREQUENCY_BUCKETS)
    return F.when(frequency <= top, frequency.cast("string")).otherwise(F.lit(TOP_BUCKET))


def bucket_order(bucket: Column) -> Column:
    """Numeric sort key of a label, the open-ended one last."""
    return F.when(bucket == TOP_BUCKET, F.lit(len(FREQUENCY_BUCKETS))).otherwise(
        bucket.try_cast("int")
    )


def bucket_table(scored: DataFrame, challengers: Mapping[str, str] | None = None) -> DataFrame:
    """Mean and total outcome per bucket beside each predictor's mean, and the model's shortfall."""
    predictors = {
        CHAMPION: "expected_purchases",
        "baseline_rate": "baseline_purchases",
        **(challengers or {}),
    }
    table = scored.groupBy("source", bucket_label(F.col("frequency")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("holdout_frequency").alias("actual"),
        F.sum("holdout_frequency").alias("actual_total"),
        *[F.avg(column).alias(name) for name, column in predictors.items()],
    )
    shortfall = (F.col(CHAMPION) - F.col("actual")) * F.col("customers")
    return table.select(
        "source",
        "bucket",
        bucket_order(F.col("bucket")).alias("bucket_order"),
        "customers",
        "actual",
        "actual_total",
        *predictors,
        shortfall.alias("shortfall"),
    ).orderBy("source", "bucket_order")


def bucket_misses(buckets: DataFrame, models: tuple[str, ...] = (CHAMPION,)) -> DataFrame:
    """Purchases each fitted model missed per bucket, net and in absolute sum.

    Negative is under-predicted. Only the absolute sum tells a model that is close everywhere
    from one whose misses offset.
    """
    labels = [str(b) for b in FREQUENCY_BUCKETS] + [TOP_BUCKET]
    long = buckets.select(
        "source",
        "bucket",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("model"),
                        ((F.col(m) - F.col("actual")) * F.col("customers")).alias("miss"),
                    )
                    for m in models
                ]
            )
        ).alias("e"),
    ).select("source", "bucket", "e.*")
    return long.groupBy("source", "model").agg(
        *[
            F.sum(F.when(F.col("bucket") == label, F.col("miss"))).alias(f"bucket_{label}")
            for label in labels
        ],
        F.sum("miss").alias("net"),
        F.sum(F.abs("miss")).alias("absolute"),
    )


def model_comparison(misses: DataFrame) -> DataFrame:
    """Which model is closest net and which bucket by bucket, and how often the champion is low."""
    labels = [c for c in misses.columns if c.startswith("bucket_")]
    is_champion = F.col("model") == CHAMPION
    low = sum((F.when(F.col(f"`{c}`") < 0, 1).otherwise(0) for c in labels), F.lit(0))
    present = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in labels), F.lit(0))
    return misses.groupBy("source").agg(
        F.min_by("model", F.struct(F.abs("net"), F.col("model"))).alias("closest_net"),
        F.min_by("model", F.struct(F.col("absolute"), F.col("model"))).alias("closest_by_bucket"),
        F.max(F.when(is_champion, low)).alias("buckets_under_predicted"),
        F.max(F.when(is_champion, present)).alias("buckets"),
    ).withColumn("same_model", F.col("closest_net") == F.col("closest_by_bucket"))


def order_value_by_bucket(scored: DataFrame) -> DataFrame:
    """Mean repeat order value of eligible customers per repeat bucket."""
    return (
        scored.where("is_gamma_gamma_eligible")
        .groupBy("source", bucket_label(F.col("frequency")).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg(F.col("monetary_value").cast("double")).alias("mean_order_value"),
        )
        .withColumn("bucket_order", bucket_order(F.col("bucket")))
        .orderBy("source", "bucket_order")
    )


def independence_check(scored: DataFrame) -> DataFrame:
    """Is order value independent of frequency among eligible customers?

    Rank correlation with its p-value, the conventional 5 % verdict, and the spread of mean order
    value between the lowest and the highest bucket.
    """
    eligible = scored.where("is_gamma_gamma_eligible")
    correlation = spearman(eligible, "frequency", "monetary_value", ["source"])
    ends = order_value_by_bucket(scored).groupBy("source").agg(
        F.min_by("mean_order_value", "bucket_order").alias("lowest_bucket_value"),
        F.max_by("mean_order_value", "bucket_order").alias("highest_bucket_value"),
    )
    # Both sides are one row per source.
    return correlation.join(F.broadcast(ends), "source").select(
        "source",
        "rho",
        "p_value",
        "n",
        (F.col("p_value") >= 0.05).alias("holds"),
        "lowest_bucket_value",
        "highest_bucket_value",
        (F.try_divide("highest_bucket_value", "lowest_bucket_value") - 1).alias("spread"),
    )
