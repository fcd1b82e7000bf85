"""Column-level checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column holding NULLs, with their count; the table is read once."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
                    for c in columns
                ]
            )
        ).alias("e")
    ).select("e.*").where(F.col("nulls") > 0)


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values on more than one row; NULL keys are the business of :func:`not_null`."""
    present = df.where(~F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)))
    return (
        present.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted list with their row counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
