"""Rank correlation and deciles, by sorting across the cluster."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.functions import numeric
from returnwise.metrics.errors import NAN
from returnwise.models import shipping  # noqa: F401  (registers the helpers)
from returnwise.operators.ranking import average_ranks, global_positions
from returnwise.session import materialise, small

DECILES = 10

# A value is heavy when it covers more than this share of its group's pairs; by counting there
# are at most the reciprocal of it per group.
HEAVY_SHARE = 0.001


def _attach(pairs: DataFrame, ranks: DataFrame, side: str) -> DataFrame:
    """Add ``_r<side>``, the rank of a pair's value on one side; heavy values travel by broadcast.

    A value that a third of the pairs share would put them all in one task of a shuffled join.
    Such values are at most ``1 / HEAVY_SHARE`` per group, so their ranks are small enough to
    send everywhere, and the others have no large group left.
    """
    group, value = f"_g{side}", f"_{side}"
    ours = ranks.where(F.col("_side") == side).select(
        F.col("_g").alias(group), F.col("_v").alias(value), "rank", "_is_heavy"
    )
    heavy = ours.where("_is_heavy").select(group, value, F.col("rank").alias("_heavy_rank"))
    light = ours.where(~F.col("_is_heavy")).select(
        group,
        F.col(value).alias("_key"),
        F.lit(-1).cast("long").alias("_salt"),
        F.col("rank").alias("_light_rank"),
    )
    known = F.col("_heavy_rank").isNotNull()
    # Pairs with a heavy value are done. In the shuffled join their key is NULL, which matches
    # nothing, and a hash of the pair spreads them.
    prepared = pairs.join(small(heavy), [group, value], "left").withColumns(
        {
            "_key": F.when(~known, F.col(value)),
            "_salt": F.when(known, F.pmod(F.xxhash64("_x", "_y"), F.lit(4096))).otherwise(
                F.lit(-1).cast("long")
            ),
        }
    )
    return prepared.join(light, [group, "_key", "_salt"], "left").select(
        *pairs.columns, F.coalesce("_heavy_rank", "_light_rank").alias(f"_r{side}")
    )


def rank_correlations(
    pairs: DataFrame, x: str, y: str, by: Sequence[str], x_by: Sequence[str] | None = None,
    y_by: Sequence[str] | None = None,
) -> DataFrame:
    """Spearman's rho with averaged ties for every ``by`` group: ``(by..., rho, n)``.

    Rows are first reduced to distinct pairs with counts. The value counts of both sides of every
    group are then ranked by one global sort. ``x_by`` / ``y_by`` name the subset of ``by`` that
    determines a side's population, so that an outcome shared by several predictors is ranked
    once. A constant side has no ranking: rho is NaN. ``by`` groups are few; their totals are
    broadcast.
    """
    by = list(by)
    side_keys = {"x": list(by if x_by is None else x_by), "y": list(by if y_by is None else y_by)}
    counted = materialise(
        pairs.groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *by, "_x", "_y", "n",
            *[F.to_json(F.struct(*keys)).alias(f"_g{s}") for s, keys in side_keys.items()],
        )
    )

    def side_values(side: str) -> DataFrame:
        rows, keys = counted, side_keys[side]
        spare = [c for c in by if c not in keys]
        if spare:
            # The side appears once per spare group; any one of them has all of it.
            first = counted.groupBy(f"_g{side}").agg(F.min(F.struct(*spare)).alias("_one"))
            rows = rows.join(small(first), f"_g{side}").where(F.struct(*spare) == F.col("_one"))
        return rows.select(
            F.lit(side).alias("_side"), F.col(f"_g{side}").alias("_g"),
            F.col(f"_{side}").alias("_v"), "n",
        )

    values = (
        side_values("x").unionByName(side_values("y"))
        .groupBy("_side", "_g", "_v")
        .agg(F.sum("n").alias("n"))
    )
    totals = values.groupBy("_side", "_g").agg(F.sum("n").alias("_all"))
    # Written because four joins read it: heavy and light values of either side.
    ranks = materialise(
        average_ranks(values, "_v", ["_side", "_g"])
        .join(small(totals), ["_side", "_g"])
        .select(
            "_side", "_g", "_v", "rank",
            (F.col("n") > F.col("_all") * HEAVY_SHARE).alias("_is_heavy"),
        )
    )
    both = _attach(_attach(counted, ranks, "x"), ranks, "y")

    # Ranks are centred on their known mean before squaring, which keeps the sums small.
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("_all"))
    n, mid = F.col("n").cast("double"), (F.col("_all") + 1) / 2.0
    dx, dy = (F.col("_rx") - mid) / F.col("_all"), (F.col("_ry") - mid) / F.col("_all")
    moments = both.join(small(sizes), by).groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(n * dx * dy).alias("_xy"),
        F.sum(n * dx * dx).alias("_xx"),
        F.sum(n * dy * dy).alias("_yy"),
        ((F.min("_x") == F.max("_x")) | (F.min("_y") == F.max("_y"))).alias("_flat"),
    )
    scale = F.sqrt(F.col("_xx") * F.col("_yy"))
    rho = F.when(F.col("_flat") | (scale == 0), F.lit(NAN)).otherwise(
        F.col("_xy") / F.when(scale != 0, scale)
    )
    return moments.select(*by, rho.alias("rho"), "n")


def p_value_column(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation; only ever applied to one row per group."""

    def evaluate(r: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series(
            [numeric.correlation_p_value(a, int(b)) for a, b in zip(r, count, strict=True)]
        )

    # Arrow carries an undefined result as NULL.
    return F.coalesce(F.pandas_udf(evaluate, "double")(rho, n), F.lit(NAN))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with its two-sided p-value and sample size."""
    groups = list(by) or ["_all_rows"]
    rows = df if by else df.withColumn("_all_rows", F.lit(1))
    result = rank_correlations(rows, x, y, groups)
    return result.select(
        *by, "rho", p_value_column(F.col("rho"), F.col("n")).alias("p_value"), "n"
    )


def assign_deciles(
    df: DataFrame, predicted: str, key: str = "customer_id", by: Sequence[str] = ()
) -> DataFrame:
    """Append ``decile``: ten equal-count groups by position, one holding the largest forecasts.

    Ties are ordered by ``key``, so a value many customers share is split by position like any
    other and the assignment is reproducible.
    """
    placed = global_positions(
        df, [F.col(predicted).desc(), F.col(key).asc()], by, name="_position"
    )
    totals = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    sized = placed.join(small(totals), list(by)) if by else placed.crossJoin(small(totals))
    decile = F.floor(F.col("_position") * DECILES / F.col("_rows")).cast("int") + 1
    return sized.select(*df.columns, decile.alias("decile"))


def decile_table(
    df: DataFrame, actual: str, predicted: str, key: str = "customer_id", by: Sequence[str] = ()
) -> DataFrame:
    """What each tenth of the ranking did, and its share of the realised total."""
    a = F.col("_actual")
    rows = df.select(
        *by,
        key,
        F.col(predicted).cast("double").alias("_predicted"),
        F.col(actual).cast("double").alias("_actual"),
    )
    table = (
        assign_deciles(rows, "_predicted", key, by)
        .groupBy(*by, "decile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("_predicted").alias("mean_predicted"),
            F.avg(a).alias("mean_actual"),
            F.sum(a).alias("total_actual"),
        )
    )
    total = rows.groupBy(*by).agg(F.sum(a).alias("_total"))
    joined = table.join(small(total), list(by)) if by else table.crossJoin(small(total))
    share = F.when(F.col("_total") != 0, F.col("total_actual") / F.col("_total")).otherwise(
        F.lit(NAN)
    )
    return joined.select(
        *by, "decile", "customers", "mean_predicted", "mean_actual", "total_actual",
        share.alias("share_of_actual"),
    )
