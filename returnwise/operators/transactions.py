"""Staging: every source is brought to one eight-column line-item contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise import schemas


def day_key(customer: Column, day: Column) -> Column:
    """``<customer>-<yyyymmdd>``: the surrogate for an order where a source has no order id."""
    return F.concat_ws("-", customer.cast("string"), F.date_format(day, "yyyyMMdd"))


def stage_transactions(raw: DataFrame, source: str) -> DataFrame:
    """Bring raw line items to the contract: casts and derivations only, no filter, no dedupe."""
    amount = F.col("gross_amount").cast(schemas.LINE_MONEY)
    quantity = F.col("quantity").cast("int")
    # Decimal division: exact halves of the fourth decimal are real here and a double quotient
    # falls on either side of them.
    units = F.nullif(quantity, F.lit(0)).cast("decimal(10,0)")
    price = F.round(amount / units, 4).cast(schemas.UNIT_PRICE)
    return raw.select(
        F.lit(source).alias("source"),
        F.col("customer_id").cast("long").alias("customer_id"),
        day_key(F.col("customer_id").cast("long"), F.col("order_date")).alias("order_id"),
        F.col("order_date").cast("date").alias("order_date"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        amount.alias("gross_amount"),
        F.lit(False).alias("is_return"),
    )


def union_sources(*staged: DataFrame) -> DataFrame:
    """The single point where sources meet; each input must meet the contract by name and type."""
    return reduce(
        DataFrame.unionByName, [schemas.conform(df, schemas.TRANSACTIONS) for df in staged]
    )


def load_summary(transactions: DataFrame) -> DataFrame:
    """Rows and distinct customers per source.

    The distinct count is taken through a grouping on the customer first, so that no task holds
    one source's whole customer set.
    """
    return (
        transactions.groupBy("source", "customer_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("source")
        .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("customers"))
    )


def duplicate_excess(transactions: DataFrame) -> DataFrame:
    """Copies beyond the first, over groups of identical line items, per source."""
    return (
        transactions.groupBy("source", "customer_id", "order_date", "quantity", "gross_amount")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("source")
        .agg(F.sum(F.col("copies") - 1).alias("excess_rows"))
    )
