"""Headline timings on ``$BENCH_SF_DIR``: prints one JSON line.

Each query is timed from its call to its last collected row, in the order a run of the pipeline
meets them. Stored intermediates are built by the first query that needs them and their cost is
part of that query's time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.book import book  # noqa: E402
from registry.queries import REGISTRY  # noqa: E402
from returnwise.models import fit as models  # noqa: E402
from returnwise.session import build_session  # noqa: E402
from returnwise.sources import retail  # noqa: E402

HEADLINE = (
    "c1_analysis_windows",
    "c2_purchase_occasions",
    "c4_rfm_calibration",
    "c5_rfm_full",
    "c6_holdout_actuals",
    "c8_recent_window_sensitivity",
    "c9_monthly_retention",
    "c19_repeat_series",
    "j11_predict",
    "c10_scored",
    "j17_calibration_fingerprint",
    "j18_prediction_fingerprint",
    "k8_score_all",
    "k10_bucket_table",
    "k7_decile_table",
    "k12_independence",
    "k15_monthly_holdout",
    "l26_check_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            # Small tables: let adaptive execution keep a task per core instead of one per megabyte.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.files.openCostInBytes": "65536",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads and the Python workers before the clock does.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").collect()

    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - started, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: REGISTRY[name].run(spark, folder).collect())
    b = book(spark, folder)
    orders = b.orders_calibration
    timed("fit_bg_nbd", lambda: models.fit_purchase_model(orders, models.BG_NBD))
    timed("fit_gamma_gamma", lambda: models.fit_gamma_gamma(orders))
    timed("fit_mbg_nbd", lambda: models.fit_purchase_model(orders, models.MBG_NBD))
    timed("fit_pareto_nbd", lambda: models.fit_purchase_model(orders, models.PARETO_NBD))
    print(
        json.dumps(
            {
                "metric": "customer_value_pipeline",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "source": retail.ORDERS,
            }
        )
    )


if __name__ == "__main__":
    main()
