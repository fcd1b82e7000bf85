"""Hand-declared contracts of every stored relation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MEAN_MONEY = T.DecimalType(18, 4)
LINE_MONEY = T.DecimalType(12, 2)
UNIT_PRICE = T.DecimalType(12, 4)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_TRANSACTIONS = _struct(
    customer_id=T.LongType(),
    order_date=T.DateType(),
    quantity=T.IntegerType(),
    gross_amount=LINE_MONEY,
    _source_file=T.StringType(),
    _line_number=T.LongType(),
    _ingested_at=T.TimestampType(),
)

TRANSACTIONS = _struct(
    source=T.StringType(),
    customer_id=T.LongType(),
    order_id=T.StringType(),
    order_date=T.DateType(),
    quantity=T.IntegerType(),
    unit_price=UNIT_PRICE,
    gross_amount=LINE_MONEY,
    is_return=T.BooleanType(),
)

PREDICTIONS = _struct(
    source=T.StringType(),
    customer_id=T.LongType(),
    horizon_days=T.IntegerType(),
    expected_purchases=T.DoubleType(),
    probability_alive=T.DoubleType(),
    expected_avg_value=T.DoubleType(),
    expected_forward_revenue=T.DoubleType(),
    forward_revenue_hdi_low=T.DoubleType(),
    forward_revenue_hdi_high=T.DoubleType(),
    spend_estimate_source=T.StringType(),
    is_gamma_gamma_eligible=T.BooleanType(),
    fit_method=T.StringType(),
)

MODEL_PARAMETERS = _struct(
    source=T.StringType(),
    fit_method=T.StringType(),
    family=T.StringType(),
    parameter=T.StringType(),
    value=T.DoubleType(),
)

MODEL_DRAWS = _struct(
    source=T.StringType(),
    fit_method=T.StringType(),
    family=T.StringType(),
    run_id=T.StringType(),
    draw_id=T.IntegerType(),
    parameter=T.StringType(),
    value=T.DoubleType(),
)

VALIDATION_METRICS = _struct(
    source=T.StringType(),
    model_family=T.StringType(),
    quantity=T.StringType(),
    metric=T.StringType(),
    value=T.DoubleType(),
    population=T.LongType(),
)


def sum_money(amount: Column) -> Column:
    """Exact sum of a two-decimal amount, added as whole cents.

    A decimal sum is wider than a machine word and leaves the fast aggregation path; whole cents
    do not, and an overflow fails instead of wrapping.
    """
    cents = F.sum((amount * 100).cast("long"))
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the contract's columns; a missing or retyped one fails by name."""
    have = {field.name: field.dataType for field in df.schema}
    missing = [field.name for field in schema if field.name not in have]
    if missing:
        raise ValueError(f"relation lacks contracted columns: {', '.join(missing)}")
    wrong = [
        f"{field.name} is {have[field.name].simpleString()}, not {field.dataType.simpleString()}"
        for field in schema
        if have[field.name] != field.dataType
    ]
    if wrong:
        raise ValueError("relation breaks its contract: " + "; ".join(wrong))
    return df.select(*schema.names)
