"""Purchase occasions: one row per customer and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise import schemas


def purchase_occasions(transactions: DataFrame) -> DataFrame:
    """Collapse line items to customer-days, keeping units, money and the line count.

    Returns are summed like any other line. A relation that already carries ``line_items`` (line
    items summed to some finer grain, such as the order) is accepted as it is.

    Partial aggregation runs before the only shuffle, so a customer holding a third of all rows
    leaves each task with at most one row per day; everything downstream is bounded by the
    calendar, not by the line count.
    """
    lines = (
        F.sum("line_items") if "line_items" in transactions.columns else F.count(F.lit(1))
    )
    collapsed = transactions.groupBy("source", "customer_id", "order_date").agg(
        F.sum(F.col("quantity").cast("long")).alias("quantity"),
        schemas.sum_money(F.col("gross_amount")).alias("gross_amount"),
        lines.cast("long").alias("line_items"),
    )
    return collapsed.select(
        F.concat_ws(
            "-",
            "source",
            F.col("customer_id").cast("string"),
            F.date_format("order_date", "yyyyMMdd"),
        ).alias("occasion_id"),
        "source",
        "customer_id",
        "order_date",
        "quantity",
        "gross_amount",
        "line_items",
    )
