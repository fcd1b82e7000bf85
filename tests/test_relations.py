"""Windows, occasions, summaries, baselines and cohorts against pandas recomputations."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import lines
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.operators import cohorts, rfm, scored, sensitivity, transactions, windows
from returnwise.operators.occasions import purchase_occasions
from returnwise.settings import SENSITIVITY_WINDOWS, Settings, SplitWeeks

SETTINGS = Settings(by_source={"a": SplitWeeks(39, 39), "b": SplitWeeks(8, 10)})
START = date(1997, 1, 1)


@pytest.fixture(scope="module")
def world(random_lines):
    tx, frame = random_lines
    occ = purchase_occasions(tx)
    return tx, occ, windows.analysis_windows(occ, SETTINGS), frame


def as_pandas(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def day_of(frame):
    return frame.groupby("source")["day"].min()


def test_windows_are_inclusive_and_adjacent(spark):
    tx = lines(spark, [("a", 1, 0, 1, 5), ("a", 1, 400, 1, 5)])
    row = windows.analysis_windows(tx).first()
    assert row["calibration_start"] == START
    assert row["calibration_end"] == date(1997, 9, 30)
    assert row["holdout_start"] == date(1997, 10, 1)
    assert row["holdout_end"] == date(1998, 6, 30)
    assert row["duration_holdout"] == 273
    assert row["last_order_date"] == START + timedelta(days=400)


def test_occasions_collapse_days_and_lose_nothing(world):
    tx, occ, _, frame = world
    want = (
        frame.groupby(["source", "customer_id", "day"])
        .agg(quantity=("quantity", "sum"), cents=("cents", "sum"), line_items=("day", "size"))
        .reset_index()
    )
    got = as_pandas(occ, "source", "customer_id", "order_date")
    assert len(got) == len(want)
    assert (got["quantity"].to_numpy() == want["quantity"].to_numpy()).all()
    assert ([int(v * 100) for v in got["gross_amount"]] == want["cents"]).all()
    assert (got["line_items"].to_numpy() == want["line_items"].to_numpy()).all()
    assert got["occasion_id"].is_unique


def recompute(frame, source, start, end):
    rows = frame[(frame["source"] == source) & frame["day"].between(start, end)]
    days = rows.groupby(["customer_id", "day"])["cents"].sum().reset_index()
    out = []
    for customer, group in days.groupby("customer_id"):
        n, total, first = len(group), group["cents"].sum(), group["cents"].iloc[0]
        out.append(
            (customer, n, n - 1, group["day"].max() - group["day"].min(),
             end - group["day"].min(), total, first,
             (total - first) / (n - 1) / 100 if n > 1 else 0.0)
        )
    columns = ["customer_id", "occasions", "frequency", "recency", "customer_age", "total",
               "first", "value"]
    return pd.DataFrame(out, columns=columns)


@pytest.mark.parametrize("source,weeks", [("a", (39, 39)), ("b", (8, 10))])
@pytest.mark.parametrize("full", [False, True])
def test_rfm_matches_an_independent_recomputation(world, source, weeks, full):
    _, occ, win, frame = world
    summary = rfm.rfm_full(occ, win) if full else rfm.rfm_calibration(occ, win)
    start = int(day_of(frame)[source])
    end = start + 7 * (sum(weeks) if full else weeks[0]) - 1
    want = recompute(frame, source, start, end)
    got = as_pandas(summary.where(F.col("source") == source), "customer_id")
    for column in ("customer_id", "occasions", "frequency", "recency", "customer_age"):
        assert (got[column].to_numpy() == want[column].to_numpy()).all(), column
    assert ([int(v * 100) for v in got["total_spend"]] == want["total"]).all()
    assert ([int(v * 100) for v in got["first_occasion_spend"]] == want["first"]).all()
    assert np.abs(got["monetary_value"].astype(float) - want["value"]).max() <= 0.00005001
    eligible = (want["frequency"] > 0) & (want["total"] > want["first"])
    assert (got["is_gamma_gamma_eligible"].to_numpy() == eligible.to_numpy()).all()


def test_zero_spend_repeats_are_flagged_not_dropped(spark):
    tx = lines(spark, [("a", 1, 0, 1, 0), ("a", 1, 9, 1, 0), ("a", 2, 0, 1, 5)])
    occ = purchase_occasions(tx)
    got = as_pandas(rfm.rfm_calibration(occ, windows.analysis_windows(occ)), "customer_id")
    assert got["frequency"].tolist() == [1, 0]
    assert got["is_gamma_gamma_eligible"].tolist() == [False, False]


def test_holdout_keeps_customers_who_never_returned(spark):
    tx = lines(
        spark,
        [("a", 1, 0, 1, 5), ("a", 2, 0, 1, 5), ("a", 2, 273, 1, 7), ("a", 2, 545, 1, 8),
         ("a", 3, 300, 1, 9), ("a", 2, 272, 1, 1)],
    )
    occ = purchase_occasions(tx)
    got = as_pandas(rfm.holdout_actuals(occ, windows.analysis_windows(occ)), "customer_id")
    assert got["customer_id"].tolist() == [1, 2]
    assert got["holdout_frequency"].tolist() == [0, 2]
    assert [float(v) for v in got["holdout_spend"]] == [0.0, 15.0]
    assert [float(v) for v in got["holdout_monetary_value"]] == [0.0, 7.5]


@pytest.mark.parametrize("days", [1, 30, 91, 273, 400])
def test_recent_repeats_count_days_after_the_first_in_the_last_window(world, days):
    _, occ, win, frame = world
    got = as_pandas(rfm.recent_repeats(occ, win, days), "source", "customer_id")
    for source, length in (("a", 273), ("b", 56)):
        start = int(day_of(frame)[source])
        end = start + length - 1
        rows = frame[(frame["source"] == source) & frame["day"].between(start, end)]
        want = []
        for customer, group in rows.groupby("customer_id"):
            active = sorted(set(group["day"]))
            count = sum(1 for d in active[1:] if end - days < d <= end)
            want.append((customer, count, min(days, end - active[0])))
        mine = got[got["source"] == source]
        found = zip(mine["customer_id"], mine["recent_repeats"], mine["recent_exposure_days"])
        assert [tuple(map(int, r)) for r in found] == [tuple(map(int, r)) for r in want]


def test_the_fused_history_equals_the_separate_relations(world):
    _, occ, win, _ = world
    keys = ["source", "customer_id"]
    fused = as_pandas(rfm.customer_history(occ, win, 91), *keys)
    for separate in (
        rfm.rfm_calibration(occ, win),
        rfm.holdout_actuals(occ, win),
        rfm.recent_repeats(occ, win, 91).drop("window_days"),
    ):
        other = as_pandas(separate, *keys)
        assert len(other) == len(fused)
        for column in other.columns:
            assert (other[column].to_numpy() == fused[column].to_numpy()).all(), column


def test_projections_of_the_wide_relation_equal_the_separate_relations(world):
    _, occ, win, _ = world
    keys = ["source", "customer_id"]
    wide = rfm.customer_windows(occ, win, [30, 91])
    counts = rfm.recent_counts(occ, win, [30, 91])
    for projected, separate in (
        (rfm.calibration_of(wide), rfm.rfm_calibration(occ, win)),
        (rfm.full_of(wide), rfm.rfm_full(occ, win)),
        (rfm.holdout_of(wide), rfm.holdout_actuals(occ, win)),
        (rfm.counts_of(wide, [30, 91]).drop("holdout_frequency"), counts),
    ):
        assert projected.schema.simpleString() == separate.schema.simpleString()
        left, right = as_pandas(projected, *keys), as_pandas(separate, *keys)
        assert len(left) == len(right)
        for column in left.columns:
            assert (left[column].to_numpy() == right[column].to_numpy()).all(), column


def test_sensitivity_sums_the_recent_rule_at_every_window(world):
    _, occ, win, _ = world
    got = sensitivity.recent_window_sensitivity(occ, win, 77).toPandas()
    assert sorted(got["window_days"].unique()) == sorted({*SENSITIVITY_WINDOWS, 77})
    actual = rfm.holdout_actuals(occ, win).toPandas()
    for days in (30, 77, 273):
        recent = rfm.recent_repeats(occ, win, days).toPandas()
        for source, horizon in (("a", 273), ("b", 70)):
            part = recent[recent["source"] == source]
            exposure = part["recent_exposure_days"].to_numpy(dtype=float)
            rate = np.divide(part["recent_repeats"], exposure, out=np.zeros(len(part)),
                             where=exposure > 0)
            row = got[(got["source"] == source) & (got["window_days"] == days)].iloc[0]
            assert row["customers"] == len(part)
            assert row["predicted_purchases"] == pytest.approx(rate.sum() * horizon)
            total = actual[actual["source"] == source]["holdout_frequency"].sum()
            assert row["actual_purchases"] == total
            error = 100 * (rate.sum() * horizon - total) / total
            assert row["percent_error"] == pytest.approx(error)


def test_retention_grid_is_complete_and_starts_full(world):
    _, occ, _, frame = world
    got = cohorts.monthly_retention(occ).toPandas()
    month = frame["day"].map(lambda d: (START + timedelta(days=int(d))).replace(day=1))
    data = frame.assign(month=month)
    first = data.groupby(["source", "customer_id"])["month"].min().rename("cohort")
    data = data.join(first, on=["source", "customer_id"])
    active = data.groupby(["source", "cohort", "month"])["customer_id"].nunique()
    for source, part in got.groupby("source"):
        months = sorted(data[data["source"] == source]["month"].unique())
        starts = sorted(part["cohort_month"].unique())
        assert len(part) == sum(1 for c in starts for m in months if m >= c)
        for row in part.itertuples():
            want = active.get((source, row.cohort_month, row.activity_month), 0)
            assert row.active_customers == want
        zero = part[part["months_since_first"] == 0]
        assert (zero["active_customers"] == zero["cohort_size"]).all()


def test_repeat_series_leaves_out_each_first_occasion(world):
    _, occ, win, frame = world
    got = cohorts.repeat_series(occ, win).toPandas()
    days = frame.groupby(["source", "customer_id"])["day"].apply(lambda d: sorted(set(d))[1:])
    for source in ("a", "b"):
        total = sum(len(v) for (s, _), v in days.items() if s == source)
        assert got[got["source"] == source]["occasions"].sum() == total
    flagged = got[(got["source"] == "b") & got["in_calibration"]]["month"].max()
    assert flagged <= START + timedelta(days=int(day_of(frame)["b"]) + 55)


def test_baselines_follow_their_definitions(world):
    _, occ, win, _ = world
    got = scored.baselines(occ, win, 91).toPandas()
    for _, part in got.groupby("source"):
        days = part["duration_holdout"].iloc[0]
        rate = part["frequency"].sum() / part["customer_age"].sum()
        eligible = part[part["is_gamma_gamma_eligible"]]
        mean = eligible["monetary_value"].astype(float).mean()
        age = part["customer_age"].to_numpy(dtype=float)
        own = np.divide(part["frequency"], age, out=np.zeros(len(part)), where=age > 0) * days
        value = np.where(
            part["is_gamma_gamma_eligible"], part["monetary_value"].astype(float), mean
        )
        assert np.allclose(part["baseline_purchases"], own)
        assert np.allclose(part["baseline_purchases_flat"], rate * days)
        assert np.allclose(part["baseline_avg_value"], value)
        assert np.allclose(part["baseline_revenue"], own * value)
        assert np.allclose(part["baseline_revenue_flat"], rate * days * mean)
        assert np.allclose(part["baseline_carry_forward"], part["frequency"])
        assert np.allclose(part["baseline_revenue_carry_forward"], part["frequency"] * value)
        assert (part["baseline_zero"] == 0).all()


def test_closed_cohort_keeps_whole_customers(world):
    _, occ, win, _ = world
    kept = windows.closed_cohort(occ, win, 1)
    ends = {r["source"]: r["calibration_end"] for r in win.collect()}
    before = occ.groupBy("source", "customer_id").agg(
        F.min("order_date").alias("first"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    after = kept.groupBy("source", "customer_id").agg(F.count(F.lit(1)).alias("n")).toPandas()
    want = {
        (r.source, r.customer_id): r.n for r in before.itertuples()
        if r.first <= ends[r.source] - timedelta(days=1)
    }
    assert {(r.source, r.customer_id): r.n for r in after.itertuples()} == want


def test_staging_keeps_every_row_and_guards_zero_quantity(spark):
    raw = spark.createDataFrame(
        [(7, date(1997, 1, 1), 0, "0.00"), (7, date(1997, 1, 1), 0, "0.00"),
         (7, date(1997, 1, 2), 4, "0.03")],
        "customer_id int, order_date date, quantity int, gross_amount string",
    )
    staged = transactions.stage_transactions(raw, "shop")
    assert staged.count() == 3
    assert [f.dataType for f in staged.schema] == [f.dataType for f in schemas.TRANSACTIONS]
    rows = staged.orderBy("order_date", "unit_price").collect()
    assert rows[0]["unit_price"] is None
    assert str(rows[2]["unit_price"]) == "0.0075"
    assert rows[2]["order_id"] == "7-19970102"
    assert transactions.duplicate_excess(staged).first()["excess_rows"] == 1


def test_union_refuses_a_source_that_breaks_the_contract(spark, random_lines):
    tx, _ = random_lines
    with pytest.raises(ValueError, match="unit_price"):
        transactions.union_sources(tx, tx.drop("unit_price"))
    with pytest.raises(ValueError, match="quantity is bigint"):
        transactions.union_sources(tx.withColumn("quantity", F.col("quantity").cast("long")))
    assert transactions.union_sources(tx, tx).count() == 2 * tx.count()


def test_load_summary_counts_rows_and_customers(random_lines):
    tx, frame = random_lines
    got = {r["source"]: (r["rows"], r["customers"]) for r in transactions.load_summary(tx).collect()}
    for source, part in frame.groupby("source"):
        assert got[source] == (len(part), part["customer_id"].nunique())
