"""Bindings of the retail tables to the transaction contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.operators.transactions import stage_transactions, union_sources
from returnwise.settings import Settings, SplitWeeks

ORDERS = "orders"
EVENTS = "events"

RETAIL_SETTINGS = Settings(
    by_source={ORDERS: SplitWeeks(172, 172), EVENTS: SplitWeeks(2, 3)}
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the customer and day of their order."""
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(schemas.LINE_MONEY).alias("gross_amount"),
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events, one unit each."""
    return (
        _table(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("date").alias("order_date"),
            F.lit(1).alias("quantity"),
            F.col("value").cast(schemas.LINE_MONEY).alias("gross_amount"),
        )
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources at line-item grain."""
    return union_sources(
        stage_transactions(raw_orders(spark, folder), ORDERS),
        stage_transactions(raw_events(spark, folder), EVENTS),
    )


def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources with the order lines already summed per order.

    An order has one customer and one day, so its lines may be summed before the join to the
    orders. The join then moves one row per order instead of one per line, the sum runs before
    its shuffle, and an order holding very many lines is reduced in place.
    """
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    totals = (
        _table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_quantity").cast("int")).alias("quantity"),
            schemas.sum_money(F.col("l_extendedprice").cast(schemas.LINE_MONEY)).alias(
                "gross_amount"
            ),
            F.count(F.lit(1)).alias("line_items"),
        )
    )
    from_orders = totals.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit(ORDERS).alias("source"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        "quantity",
        "gross_amount",
        "line_items",
    )
    from_events = raw_events(spark, folder).select(
        F.lit(EVENTS).alias("source"),
        F.col("customer_id").cast("long").alias("customer_id"),
        "order_date",
        F.col("quantity").cast("long").alias("quantity"),
        F.col("gross_amount").cast(schemas.MONEY).alias("gross_amount"),
        F.lit(1).cast("long").alias("line_items"),
    )
    return from_orders.unionByName(from_events)
