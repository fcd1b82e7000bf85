"""The stages end to end, and the checks on sound and on damaged relations."""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import lines
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.checks import engine, generic, relations, suite
from returnwise.checks.suite import Expected
from returnwise.models import draws
from returnwise.operators import rfm
from returnwise.plans import stages
from returnwise.session import materialise
from returnwise.settings import Settings, SplitWeeks
from returnwise.sources import store as stored
from returnwise.sources.checksum import ChecksumMismatch
from returnwise.sources.store import Store

SETTINGS = Settings(split=SplitWeeks(20, 20), forward_horizon_days=365, recent_window_days=45)


def shop(spark, seed=4, customers=400):
    """Customers of a falling purchase rate, acquired over two months, some days with many lines."""
    generator = np.random.default_rng(seed)
    rows = []
    for customer in range(customers):
        day, rate, level = float(generator.integers(0, 60)), generator.gamma(0.9, 1 / 25), \
            generator.gamma(5, 8)
        if customer == 0:
            day = 0.0
        while day < 280:
            for _ in range(int(generator.integers(1, 4))):
                rows.append(("s", customer, int(day), 1, f"{level * generator.gamma(4, 0.25):.2f}"))
            if generator.random() < 0.2:
                break
            day += max(generator.exponential(1 / rate), 1.0)
        if customer == 1:
            rows += [rows[-1]] * 2
    return lines(spark, rows)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store(spark, str(tmp_path_factory.mktemp("warehouse")))


@pytest.fixture(scope="module")
def tables(spark, store):
    return stages.transform(
        store, shop(spark), SETTINGS,
        Expected(sources=["s"], windows={"s": tuple(
            date(1997, 1, 1) + timedelta(days=d) for d in (0, 139, 140, 279))}),
    )


@pytest.fixture(scope="module")
def fitted(store, tables):
    return stages.fit(store, "s", SETTINGS)


@pytest.fixture(scope="module")
def validation(store, fitted):
    return stages.validate(
        store, "s", SETTINGS, compare_models=True, expected=Expected(recent_window_days=45)
    )


def test_transform_stores_every_relation(store, tables):
    assert set(tables) == {*stages._MAIN, "transactions"}
    assert tables["rfm_calibration"].count() == 400
    assert store.exists("main.repeat_series")


def test_fit_writes_predictions_then_provenance(store, fitted):
    assert fitted.horizons == [140, 365] and fitted.rows_written == 800
    run = store.read(stored.FIT_RUNS).first()
    assert run["calibration_rows"] == 400 and run["horizons"] == "140,365"
    row = fitted.summary(store).first()
    assert row["customers"] == 400
    assert row["spend_customers"] + row["excluded_customers"] == 400
    stored_fit = stages.load_purchase_fit(store, "s", "map")
    assert stored_fit.parameters == pytest.approx(fitted.purchase.parameters)


def test_validate_scores_and_reconciles(store, validation):
    scores = validation.scores.toPandas()
    assert set(scores["family"]) >= {"bg_nbd", "mbg_nbd", "pareto_nbd", "baseline_zero"}
    assert validation.metrics_written == validation.metrics.count()
    monthly = validation.tables["monthly"].toPandas()
    model = scores[(scores["quantity"] == "purchases") & (scores["family"] == "bg_nbd")].iloc[0]
    assert monthly["actual"].sum() == model["actual_total"]
    assert monthly["expected"].sum() == pytest.approx(model["predicted_total"], rel=1e-6)
    fit_row = validation.tables["calibration_fit"].toPandas().set_index("part")
    assert abs(fit_row.loc["calibration", "percent_error"]) < 10
    for name, df in validation.tables.items():
        assert df.columns, name
        df.limit(1).collect()
    assert validation.tables["challengers"].count() == 2
    assert validation.tables["intervals"].count() == 0


def test_full_bayes_brings_intervals(spark, store, tables, validation, tmp_path_factory):
    other = Store(spark, str(tmp_path_factory.mktemp("bayes")))
    stages.transform(other, shop(spark), SETTINGS, check=False)
    outcome = stages.fit(other, "s", SETTINGS, full_bayes=True)
    assert outcome.method == draws.MCMC
    kept = stored.read_parameters(other, "s", draws.MCMC, outcome.purchase.family)
    assert kept == outcome.purchase.parameters
    result = stages.validate(other, "s", SETTINGS, expected=Expected(recent_window_days=45))
    row = result.tables["intervals"].first()
    assert row["customers"] == 400 and row["median_relative_width"] > 0
    # The months are averaged over the stored draws, and add up to the stored forecasts.
    monthly = result.tables["monthly"].toPandas()
    total = other.read(stored.PREDICTIONS).where("horizon_days = 140").agg(F.sum("expected_purchases")).first()[0]
    assert monthly["expected"].sum() == pytest.approx(total, rel=1e-6)
    assert (monthly["expected_low"] < monthly["expected_high"]).all()
    for family in (outcome.purchase.family, outcome.spend.family):
        reloaded = stages.load_draws(other, "s", family)
        assert len(reloaded.points) == 200
    # Draws of another fit, or other parameters than their means, are refused.
    rows = stages.load_draws(other, "s").rows("s")
    stored.write_draws(other, "s", draws.MCMC, [(*r[:4], r[4] * 1.01) for r in rows])
    with pytest.raises(stored.StaleDraws, match="mean"):
        stages.load_draws(other, "s")
    stored.write_draws(other, "s", draws.MCMC, rows)
    assert np.allclose(stages.load_draws(other, "s").rows("s")[0][4], rows[0][4])
    runs = other.read(stored.FIT_RUNS, "s").withColumn("calibration_rows", F.lit(401).cast("long"))
    stored.write_fit_run(other, materialise(runs))
    with pytest.raises(stored.StaleDraws, match="another fit"):
        stages.load_draws(other, "s")


def test_validate_refuses_edited_predictions(spark, store, validation, tmp_path_factory):
    kept = store.read(stored.PREDICTIONS).select(*schemas.PREDICTIONS.names)
    copy = Store(spark, str(tmp_path_factory.mktemp("edited")))
    for name in (*[f"main.{n}" for n in stages._MAIN], stored.PARAMETERS, stored.FIT_RUNS):
        copy.overwrite(name, store.read(name))
    stored.write_predictions(
        copy, kept.withColumn("expected_purchases", F.col("expected_purchases") * 1.167)
    )
    with pytest.raises(suite.CheckFailed, match="predictions_unchanged: 1 rows"):
        stages.validate(copy, "s", SETTINGS, expected=Expected(recent_window_days=45))


def test_close_cohort_makes_an_open_source_reconcile(spark, tmp_path):
    rows = [("s", c, d, 1, 5) for c in range(6) for d in (c, c + 40, c + 150)]
    rows += [("s", 9, 200, 1, 5), ("s", 1, 1, 2, 4)]
    tx = lines(spark, rows)
    opened = Store(spark, str(tmp_path / "open"))
    with pytest.raises(suite.CheckFailed, match="populations_align"):
        stages.transform(opened, tx, SETTINGS)
    closed = Store(spark, str(tmp_path / "closed"))
    tables = stages.transform(closed, tx, SETTINGS, close_cohort=True)
    assert tables["rfm_full"].count() == 6
    assert tables["transactions"].count() == 19


def run(tables, name, **expected):
    check = next(c for c in suite.all_checks() if c.name == name)
    return check.run(tables, Expected(**expected)).count()


@pytest.fixture(scope="module")
def sound(store, tables, validation):
    return {
        **tables,
        "predictions": store.read(stored.PREDICTIONS).select(*schemas.PREDICTIONS.names),
        "scored": store.read(stored.SCORED),
        "fit_runs": store.read(stored.FIT_RUNS),
    }


def test_sound_relations_pass_every_check(sound):
    expected = Expected(sources=["s"], recent_window_days=45)
    for stage in (suite.TRANSFORM, suite.POST_FIT):
        report = suite.run_checks(sound, stage, expected)
        suite.require_clean(report)
        assert report.count() == sum(c.stage == stage for c in suite.all_checks())


DAMAGE = {
    # One single-edit defect per guard.
    "holdout population by inner join": (
        "populations_align", "holdout_actuals", lambda d: d.where("holdout_frequency > 0")),
    "holdout spend halved": (
        "spend_reconciles", "holdout_actuals",
        lambda d: d.withColumn("holdout_spend", (F.col("holdout_spend") / 2).cast(schemas.MONEY))),
    "one line per occasion": (
        "occasions_collapsed", "purchase_occasions", lambda d: d.withColumn("line_items", F.lit(1))),
    "largest amount kept": (
        "occasions_collapsed", "purchase_occasions",
        lambda d: d.withColumn("gross_amount", (F.col("gross_amount") * 0.9).cast(schemas.MONEY))),
    "mean over occasions": (
        "monetary_value_matches", "rfm_calibration",
        lambda d: d.withColumn("monetary_value", (
            F.col("monetary_value") * F.col("frequency") / F.col("occasions")
        ).cast(schemas.MEAN_MONEY))),
    "holdout frequency off": (
        "holdout_reconciles", "holdout_actuals",
        lambda d: d.withColumn("holdout_frequency", F.col("holdout_frequency") + 1)),
    "negative holdout": (
        "holdout_consistent", "holdout_actuals",
        lambda d: d.withColumn("holdout_frequency", F.lit(-1))),
    "window moved by a day": (
        "windows_match", "analysis_windows",
        lambda d: d.withColumn("calibration_end", F.date_add("calibration_end", 1))),
    "leaking calibration": (
        "no_leakage", "rfm_calibration",
        lambda d: d.withColumn("last_order_date", F.date_add("last_order_date", 150))),
    "calibration beyond full": (
        "calibration_within_full", "rfm_calibration",
        lambda d: d.withColumn("frequency", F.col("frequency") + 99)),
    "frequency of occasions": (
        "rfm_invariants", "rfm_calibration",
        lambda d: d.withColumn("frequency", F.col("occasions"))),
    "customer twice": (
        "one_row_per_customer", "rfm_full", lambda d: d.unionByName(d.limit(1))),
    "sensitivity of part of the customers": (
        "sensitivity_complete", "recent_window_sensitivity",
        lambda d: d.withColumn("customers", F.col("customers") - 1)),
    "sensitivity row twice": (
        "sensitivity_complete", "recent_window_sensitivity", lambda d: d.unionByName(d)),
    "sensitivity scaled elsewhere": (
        "sensitivity_recomputes", "recent_window_sensitivity",
        lambda d: d.withColumn("predicted_purchases", F.expr(
            "predicted_purchases * if(window_days = 45, 1, 0.8)"))),
    "sensitivity scaled here": (
        "sensitivity_matches_scored", "recent_window_sensitivity",
        lambda d: d.withColumn("predicted_purchases", F.col("predicted_purchases") * 1.5)),
    "scored population cut": (
        "scored_population", "scored", lambda d: d.where("is_gamma_gamma_eligible")),
    "scored at the long horizon": (
        "scored_horizon", "scored", lambda d: d.withColumn("horizon_days", F.lit(365))),
    "horizon missing": (
        "scored_horizon", "scored",
        lambda d: d.withColumn("horizon_days", F.lit(None).cast("int"))),
    "zero rule not zero": (
        "baselines_recompute", "scored", lambda d: d.withColumn("baseline_zero", F.lit(999.0))),
    "rule nulled": (
        "baselines_recompute", "scored",
        lambda d: d.withColumn("baseline_revenue_recent", F.lit(None).cast("double"))),
    "carry forward inflated": (
        "baselines_recompute", "scored",
        lambda d: d.withColumn("baseline_carry_forward", F.col("baseline_carry_forward") * 1.5)),
    "predictions scaled": (
        "predictions_unchanged", "predictions",
        lambda d: d.withColumn("expected_purchases", F.col("expected_purchases") * 1.167)),
    "horizons swapped": (
        "predictions_unchanged", "predictions",
        lambda d: d.withColumn("horizon_days", 505 - F.col("horizon_days"))),
    "certainly alive": (
        "predictions_unchanged", "predictions",
        lambda d: d.withColumn("probability_alive", F.lit(1.0))),
    "no record of the fit": (
        "predictions_unchanged", "fit_runs", lambda d: d.limit(0)),
    "stale rows": (
        "inputs_unchanged", "fit_runs", lambda d: d.withColumn("calibration_rows", F.lit(0))),
    "weighted sum not recorded": (
        "inputs_unchanged", "fit_runs",
        lambda d: d.withColumn("weighted_frequency", F.col("sum_frequency"))),
    "unknown method": (
        "accepted_fit_method", "predictions", lambda d: d.withColumn("fit_method", F.lit("guess"))),
    "a NULL in the summary": (
        "not_null_rfm_calibration", "rfm_calibration",
        lambda d: d.withColumn("recency", F.lit(None).cast("int"))),
    "occasion id repeated": (
        "unique_purchase_occasions", "purchase_occasions", lambda d: d.unionByName(d.limit(2))),
    "order outside the windows": (
        "transactions_within_windows", "transactions",
        lambda d: d.withColumn("order_date", F.date_add("order_date", 400))),
    "negative sale": (
        "amounts_plausible", "transactions",
        lambda d: d.withColumn("gross_amount", -F.col("gross_amount"))),
    "duplicate count": (
        "known_duplicates", "transactions", lambda d: d.unionByName(d.limit(3))),
    "unknown source": (
        "accepted_sources", "transactions", lambda d: d.withColumn("source", F.lit("other"))),
}


@pytest.mark.parametrize("defect", DAMAGE)
def test_each_planted_defect_is_caught(sound, defect):
    name, table, change = DAMAGE[defect]
    expected = {
        "sources": ["s"],
        "recent_window_days": 45,
        "windows": {"s": tuple(date(1997, 1, 1) + timedelta(days=d) for d in (0, 139, 140, 279))},
        "duplicates": {"s": 2},
    }
    assert run(sound, name, **expected) == 0
    assert run({**sound, table: change(sound[table])}, name, **expected) > 0


def test_one_scan_counts_what_the_listing_checks_list(sound):
    listing = {c.name: c for c in suite.all_checks()}
    scans = engine.transform_checks(suite.REQUIRED)
    assert {c.name for c in scans} <= set(listing)
    profiled = {**sound, "transaction_profile": suite._profile(sound)}
    compared = 0
    for name, table, change in DAMAGE.values():
        if name not in {c.name for c in scans}:
            continue
        damaged = {**profiled, table: change(sound[table])}
        if table == "transactions":
            damaged["transaction_profile"] = relations.transaction_profile(
                damaged[table], suite.REQUIRED["transactions"])
        got = {r["check_name"]: r["violations"] for r in engine.report(scans, damaged, "transform").collect()}
        assert len(got) == len(scans) and got[name] > 0
        assert got[name] == listing[name].run(damaged, Expected()).count(), name
        compared += 1
    assert compared >= 10


def test_a_relation_is_scanned_once_whatever_the_checks(sound):
    scans = engine.transform_checks(suite.REQUIRED)
    tables = {**sound, "transaction_profile": sound["analysis_windows"].limit(0)}
    only = [c for c in scans if set(c.measures) <= {"rfm_calibration", "rfm_full", "holdout_actuals"}]
    plan = engine.report(only, tables, "transform")._jdf.queryExecution().executedPlan().toString()
    assert len(only) >= 5 and plan.count("FileScan parquet") == 3 and "hashpartitioning" not in plan


def test_ledger_keeps_customers_of_any_relation(sound):
    tables = {**sound, "holdout_actuals": sound["holdout_actuals"].where("customer_id < 10"),
              "rfm_full": sound["rfm_full"].where("customer_id >= 5")}
    rows = {r["customer_id"]: r for r in engine.ledger(tables).collect()}
    assert len(rows) == 400
    assert rows[2]["rows_rfm_full"] == 0 and rows[2]["rfm_full_occasions"] is None
    assert rows[7]["rows_holdout_actuals"] == 1 and rows[20]["holdout_actuals_holdout_spend"] is None


def test_recent_rule_reading_the_holdout_is_caught(sound):
    windows = sound["analysis_windows"]
    leaked = windows.withColumn("calibration_end", F.col("holdout_end"))
    peeking = rfm.recent_repeats(sound["purchase_occasions"], leaked, 45).select(
        "customer_id", F.col("recent_repeats").alias("peeked")
    )
    scored = sound["scored"].join(peeking, "customer_id").withColumn(
        "baseline_recent", F.col("peeked") * 3.0
    )
    assert run({**sound, "scored": scored}, "baselines_recompute", recent_window_days=45) > 0


def test_generic_checks(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", None), (None, 2), (None, 2)], "k string, v int"
    )
    assert {r["column_name"]: r["nulls"] for r in generic.not_null(df, ["k", "v"]).collect()} == {
        "k": 2, "v": 1
    }
    assert [tuple(r) for r in generic.unique(df, ["k"]).collect()] == [("a", 2)]
    assert [tuple(r) for r in generic.accepted_values(df, "k", ["a"]).collect()] == [("b", 1)]


def test_fixed_width_file_to_calibration(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text(" 00001 19970101  1   11.77\n 00001 19970301  2   20.00\n")
    store = Store(spark, str(tmp_path / "store"))
    assert stages.ingest(store, str(path)).first()["rows"] == 2
    assert stages.ingest(store, str(path)).first()["rows"] == 2
    assert store.read("raw.transactions").count() == 2


def test_ingest_accepts_only_pinned_content(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text(" 00001 19970101  1   11.77\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    store = Store(spark, str(tmp_path / "store"))
    assert stages.ingest(store, str(path), manifest={"lines.txt": digest}).first()["rows"] == 1
    path.write_text(" 00001 19970101  1   11.77\n 00001 19970301  2   20.00\n")
    with pytest.raises(ChecksumMismatch):
        stages.ingest(store, str(path), manifest={"lines.txt": digest})
    assert store.read("raw.transactions").count() == 1
