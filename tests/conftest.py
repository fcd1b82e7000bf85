from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from returnwise import schemas  # noqa: E402
from returnwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Keep several partitions on small data, so that what crosses them is exercised.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def lines(spark, rows):
    """Line items from ``(source, customer, day offset, quantity, amount)`` tuples."""
    start = date(1997, 1, 1)
    frame = spark.createDataFrame(
        [(s, c, start + timedelta(days=d), q, str(a)) for s, c, d, q, a in rows],
        "source string, customer_id long, order_date date, quantity int, gross_amount string",
    )
    return frame.selectExpr(
        "source",
        "customer_id",
        "concat(customer_id, '-', date_format(order_date, 'yyyyMMdd')) as order_id",
        "order_date",
        "quantity",
        "cast(gross_amount as decimal(12,2)) / quantity as unit_price",
        "cast(gross_amount as decimal(12,2)) as gross_amount",
        "false as is_return",
    ).withColumn("unit_price", _price("unit_price"))


def _price(name):
    from pyspark.sql import functions as F

    return F.col(name).cast(schemas.UNIT_PRICE)


@pytest.fixture(scope="session")
def random_lines(spark):
    """Two sources of random line items with one very busy customer, as Spark and pandas."""
    generator = np.random.default_rng(5)
    rows = []
    for source, span, customers in (("a", 560, 60), ("b", 120, 25)):
        for customer in range(customers):
            count = 400 if customer == 0 else int(generator.integers(1, 12))
            first = int(generator.integers(0, span // 3))
            for _ in range(count):
                day = int(generator.integers(first, span))
                rows.append(
                    (source, customer, day, int(generator.integers(1, 9)),
                     f"{generator.integers(0, 99999) / 100:.2f}")
                )
    frame = pd.DataFrame(rows, columns=["source", "customer_id", "day", "quantity", "amount"])
    frame["cents"] = (frame["amount"].astype(float) * 100).round().astype(int)
    return lines(spark, rows), frame
