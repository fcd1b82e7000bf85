"""Error metrics, the score matrix, buckets and verdicts on hand-computed values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from returnwise.metrics import buckets, diagnostics, errors, scoring, verdicts


def pairs(spark, actual, predicted):
    return spark.createDataFrame(list(zip(map(float, actual), map(float, predicted))),
                                 "a double, p double")


def test_errors_on_four_rows(spark):
    row = errors.error_metrics(pairs(spark, [0, 1, 2, 3], [1, 1, 4, 0]), "a", "p").first()
    assert row["mae"] == pytest.approx(1.5)
    assert row["rmse"] == pytest.approx(math.sqrt(3.5))
    assert row["error"] == 0 and row["percent_error"] == 0
    assert row["mape"] == pytest.approx(200 / 3)
    assert (row["mape_included"], row["mape_excluded"]) == (3, 1)
    assert row["mape_excluded_share"] == 0.25


@pytest.mark.parametrize("predicted,percent", [([8, 8], -20.0), ([12, 12], 20.0)])
def test_aggregate_error_keeps_its_sign(spark, predicted, percent):
    row = errors.error_metrics(pairs(spark, [10, 10], predicted), "a", "p").first()
    assert row["percent_error"] == pytest.approx(percent)


def test_undefined_values_are_nan_not_failures(spark):
    row = errors.error_metrics(pairs(spark, [0, 0], [1, 2]), "a", "p").first()
    assert math.isnan(row["percent_error"]) and math.isnan(row["mape"])
    assert (row["mape_included"], row["mape_excluded"]) == (0, 2)


def test_pairs_must_be_complete(spark):
    with pytest.raises(ValueError, match="empty"):
        errors.require_pairs(pairs(spark, [1], [1]).where("a > 5"), "a", "p")
    holed = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, p double")
    with pytest.raises(ValueError, match="1 rows lack"):
        errors.require_pairs(holed, "a", "p")


@pytest.fixture(scope="module")
def scored(spark):
    """Forty customers, about 70 % of whom never return."""
    generator = np.random.default_rng(11)
    n = 40
    frequency = generator.poisson(2, n)
    returned = generator.random(n) > 0.7
    count = np.where(returned, generator.integers(1, 6, n), 0)
    spend = np.where(returned, generator.gamma(3, 10, n).round(2) * count, 0.0)
    value = np.divide(spend, count, out=np.zeros(n), where=count > 0)
    mean = np.where(frequency > 0, generator.gamma(3, 10, n).round(4), 0.0)
    frame = pd.DataFrame(
        {
            "source": "s",
            "customer_id": np.arange(n),
            "frequency": frequency,
            "recency": generator.integers(0, 90, n),
            "customer_age": generator.integers(100, 300, n),
            "monetary_value": mean,
            "is_gamma_gamma_eligible": frequency > 0,
            "duration_holdout": 273,
            "horizon_days": 273,
            "holdout_frequency": count,
            "holdout_spend": spend,
            "holdout_monetary_value": value,
            "expected_purchases": generator.gamma(2, 0.5, n),
            "probability_alive": np.where(frequency == 0, 1.0, generator.random(n)),
            "expected_avg_value": generator.gamma(3, 10, n),
        }
    )
    frame["expected_forward_revenue"] = frame["expected_purchases"] * frame["expected_avg_value"]
    for name in ("baseline_purchases", "baseline_recent", "baseline_revenue",
                 "baseline_revenue_recent", "baseline_avg_value"):
        frame[name] = generator.gamma(2, 1.0, n)
    frame["baseline_carry_forward"] = frame["frequency"].astype(float)
    frame["baseline_revenue_carry_forward"] = frame["frequency"] * frame["baseline_avg_value"]
    frame["baseline_purchases_flat"], frame["baseline_revenue_flat"] = 1.3, 31.0
    frame["baseline_zero"], frame["recent_window_days"] = 0.0, 91
    return spark.createDataFrame(frame), frame


def test_score_matrix_has_every_predictor_once(scored):
    df, frame = scored
    got = scoring.score_all(df).toPandas().set_index(["quantity", "family"])
    assert len(got) == 14
    actual = frame["holdout_frequency"]
    for family, column in scoring.PREDICTORS["purchases"][1].items():
        row = got.loc[("purchases", family)]
        assert row["mae"] == pytest.approx((frame[column] - actual).abs().mean())
        assert row["population"] == 40
        assert math.isnan(row["mape"])
    zero = got.loc[("revenue", "baseline_zero")]
    assert zero["percent_error"] == pytest.approx(-100) and zero["mape"] == pytest.approx(100)
    assert math.isnan(zero["spearman_rho"])
    returned = int((actual > 0).sum())
    assert got.loc[("avg_order_value", "bg_nbd")]["population"] == returned
    assert got.loc[("avg_order_value", "bg_nbd")]["mape_excluded"] == 0
    one = scoring.score(df, "revenue", "baseline_rate").first()
    assert one["mae"] == pytest.approx(got.loc[("revenue", "baseline_rate")]["mae"])


def test_challengers_are_scored_on_counts_only(scored):
    df, _ = scored
    got = scoring.score_all(df.withColumn("mbg_nbd", F.lit(0.5)), {"mbg_nbd": "mbg_nbd"}).toPandas()
    assert got[got["family"] == "mbg_nbd"]["quantity"].tolist() == ["purchases"]


def test_metrics_frame_is_long_and_leaves_out_purchase_mape(scored):
    df, _ = scored
    got = scoring.metrics_frame(scoring.score_all(df)).toPandas()
    assert len(got) == 6 * 6 + 8 * 8
    assert not got[got["quantity"] == "purchases"]["metric"].str.startswith("mape").any()


def test_bucket_labels_and_order(spark):
    df = spark.createDataFrame([(f,) for f in (0, 1, 6, 7, 12)], "f int").select(
        buckets.bucket_label(F.col("f")).alias("b")
    ).withColumn("o", buckets.bucket_order(F.col("b")))
    assert [tuple(r) for r in df.collect()] == [
        ("0", 0), ("1", 1), ("6", 6), ("7+", 7), ("7+", 7)
    ]


def test_bucket_table_adds_up(scored):
    df, frame = scored
    got = buckets.bucket_table(df).toPandas()
    assert got["customers"].sum() == 40
    assert got["actual_total"].sum() == frame["holdout_frequency"].sum()
    want = (frame["expected_purchases"] - frame["holdout_frequency"]).sum()
    assert got["shortfall"].sum() == pytest.approx(want)
    assert got["bucket_order"].is_monotonic_increasing


def test_offsetting_misses_show_in_the_absolute_sum(spark):
    table = spark.createDataFrame(
        [("s", "0", 10, 1.0, 2.0, 0.7), ("s", "1", 10, 1.0, 0.0, 0.7)],
        "source string, bucket string, customers long, actual double, bg_nbd double, "
        "mbg_nbd double",
    )
    misses = buckets.bucket_misses(table, ("bg_nbd", "mbg_nbd"))
    got = misses.toPandas().set_index("model")
    assert got.loc["bg_nbd", "net"] == pytest.approx(0)
    assert got.loc["bg_nbd", "absolute"] == pytest.approx(20)
    assert got.loc["mbg_nbd", "net"] == pytest.approx(-6)
    verdict = buckets.model_comparison(misses).first()
    assert verdict["closest_net"] == "bg_nbd" and verdict["closest_by_bucket"] == "mbg_nbd"
    assert not verdict["same_model"]
    assert (verdict["buckets_under_predicted"], verdict["buckets"]) == (1, 2)


def test_independence_reports_rho_p_and_spread(scored):
    df, frame = scored
    row = buckets.independence_check(df).first()
    eligible = frame[frame["frequency"] > 0]
    want = eligible["frequency"].rank().corr(eligible["monetary_value"].rank())
    assert row["rho"] == pytest.approx(want) and row["n"] == len(eligible)
    assert row["holds"] == (row["p_value"] >= 0.05)


def test_alive_by_construction_counts_certainties(scored):
    df, frame = scored
    row = diagnostics.alive_by_construction(df).first()
    certain = frame[frame["probability_alive"] >= 1]
    assert row["customers"] == len(certain)
    assert row["returned_share"] == pytest.approx((certain["holdout_frequency"] > 0).mean())


def test_intervals_cover_and_width(spark):
    df = spark.createDataFrame(
        [("s", 100.0, 90.0, 110.0, v) for v in (0.0, 95.0, 110.0, 200.0)],
        "source string, expected_forward_revenue double, forward_revenue_hdi_low double, "
        "forward_revenue_hdi_high double, holdout_spend double",
    )
    row = diagnostics.interval_summary(df).first()
    assert row["coverage"] == 0.5
    assert row["median_relative_width"] == pytest.approx(0.2)
    none = df.withColumn("forward_revenue_hdi_low", F.lit(None).cast("double"))
    assert diagnostics.interval_summary(none).count() == 0


def test_lowest_decile_describes_the_bottom_tenth(scored):
    df, frame = scored
    row = diagnostics.lowest_decile(df).first()
    bottom = frame.sort_values("expected_forward_revenue").head(4)
    assert row["customers"] == 4
    assert row["repeat_buyers"] == (bottom["frequency"] > 0).sum()


def metric_rows(spark, values):
    rows = [
        ("s", family, quantity, metric, float(value), 10)
        for (family, quantity), metrics in values.items()
        for metric, value in metrics.items()
    ]
    return spark.createDataFrame(
        rows, "source string, model_family string, quantity string, metric string, value double, "
        "population long"
    )


def test_headline_counts_rules_and_never_lets_nan_win(spark):
    def p(mae, error):
        return {"mae": mae, "percent_error": error, "spearman_rho": 0.1}

    def r(rho):
        return {"mae": 1, "percent_error": 1, "spearman_rho": rho}

    values = {
        ("bg_nbd", "purchases"): p(0.8, -14), ("baseline_recent", "purchases"): p(0.9, 9),
        ("baseline_rate", "purchases"): p(1.0, 47), ("baseline_carry_forward", "purchases"):
        p(0.7, -11), ("baseline_flat", "purchases"): p(1.4, 47),
        ("baseline_zero", "purchases"): p(1.0, -100),
        ("bg_nbd", "revenue"): r(0.42), ("baseline_rate", "revenue"): r(0.48),
        ("baseline_flat", "revenue"): r(float("nan")),
    }
    row = verdicts.headline(metric_rows(spark, values)).first()
    assert row["rules_closer_on_total"] == 2 and row["closest_rule"] == "baseline_recent"
    assert row["rules_beaten_on_mae"] == 4 and row["naive_rules"] == 5
    assert row["margin_over_zero_percent"] == pytest.approx(20)
    assert row["ranking_winner"] == "baseline_rate" and row["naive_ranks_at_least_as_well"]


@pytest.mark.parametrize(
    "percents,verdict,longest,shortest",
    [
        ((1, 2, 3), "all", 91, None),
        ((20, 30, 40), "none", None, 30),
        ((1, 2, 30), "crossover", 61, 91),
        ((1, 30, 2), "mixed", 91, 61),
        ((30, 1, 2), "mixed", 91, 30),
    ],
)
def test_sensitivity_verdict_finds_the_crossover(spark, percents, verdict, longest, shortest):
    rows = spark.createDataFrame(
        [("s", w, float(v)) for w, v in zip((30, 61, 91), percents)],
        "source string, window_days int, percent_error double",
    )
    model = spark.createDataFrame([("s", -14.0)], "source string, model_percent_error double")
    row = verdicts.sensitivity_verdict(rows, model).first()
    assert (row["verdict"], row["longest_winning"], row["shortest_losing"]) == (
        verdict, longest, shortest
    )


def test_months_cut_the_holdout_without_gaps(spark):
    windows = spark.sql(
        "select 's' as source, date '1997-01-01' as calibration_start, "
        "date '1997-09-14' as calibration_end, date '1997-09-15' as holdout_start, "
        "date '1997-12-10' as holdout_end"
    )
    got = diagnostics.month_edges(windows).orderBy("month").collect()
    assert [str(r["month"]) for r in got] == [
        "1997-09-15", "1997-10-01", "1997-11-01", "1997-12-01"
    ]
    assert [r["days"] for r in got] == [16, 31, 30, 10]
    assert [r["from_day"] for r in got][1:] == [r["to_day"] for r in got][:-1]
    assert got[-1]["to_day"] == 87


def test_monthly_trend_is_per_day_and_names_the_worst(spark):
    monthly = spark.sql(
        """select 's' as source, month, days, expected, actual, expected - actual as shortfall from
        values (date '1998-01-01', 31, 31.0D, 62L), (date '1998-02-01', 28, 14.0D, 28L),
        (date '1998-03-01', 31, 15.5D, 15L), (date '1998-04-01', 30, 15.0D, 90L)
        as t(month, days, expected, actual)"""
    )
    row = diagnostics.monthly_trend(monthly).first()
    assert row["expected_change"] == pytest.approx(-0.5)
    assert row["actual_change"] == pytest.approx(0.5)
    assert row["worst_months"] == "1998-01-01,1998-02-01,1998-04-01"
    assert row["worst_share"] == pytest.approx((-31 - 14 - 75) / (75.5 - 195))


def test_parameter_comparison_converts_only_the_rate(spark):
    rows = [("s", "bg_nbd", n, 7.0) for n in ("r", "alpha", "a", "b")]
    df = spark.createDataFrame(rows, "source string, family string, parameter string, value double")
    got = diagnostics.parameter_comparison(df).toPandas().set_index("parameter")
    assert got.loc["alpha", "fitted_weeks"] == 1.0
    assert (got.drop("alpha")["fitted_weeks"] == 7.0).all()
    assert got.loc["alpha", "published"] == 4.414
