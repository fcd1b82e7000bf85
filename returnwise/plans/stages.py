"""The stages: transform, fit and validate, each reading what the one before has stored.

Every stage writes its relations before the next thing reads them, so a lost executor never costs
more than the current stage.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise import schemas
from returnwise.checks import suite
from returnwise.checks.suite import Expected
from returnwise.metrics import buckets, diagnostics, scoring, verdicts
from returnwise.metrics.rank import decile_table
from returnwise.models import draws as posterior
from returnwise.models import fit as models
from returnwise.models.fingerprints import fit_run
from returnwise.models.predict import predict, purchases_column, resolve_horizons
from returnwise.operators import rfm
from returnwise.operators.cohorts import monthly_retention, repeat_series
from returnwise.operators.occasions import purchase_occasions
from returnwise.operators.scored import baselines_of, scored_of
from returnwise.operators.sensitivity import configured, sensitivity_of
from returnwise.operators.transactions import load_summary
from returnwise.operators.windows import analysis_windows, closed_cohort
from returnwise.session import materialise
from returnwise.settings import Settings
from returnwise.sources import store as stored
from returnwise.sources.checksum import require_pinned
from returnwise.sources.fixed_width import raw_transactions, read_transactions
from returnwise.sources.publication import Publication
from returnwise.sources.store import Store

_MAIN = (
    "analysis_windows", "purchase_occasions", "customer_windows", "rfm_calibration", "rfm_full",
    "holdout_actuals", "monthly_retention", "recent_window_sensitivity",
)


def ingest(
    store: Store,
    path: str,
    relation: str = "raw.transactions",
    manifest: Mapping[str, str] | None = None,
) -> DataFrame:
    """Strict load of a fixed-width file into the raw relation; a repeat load replaces it.

    With ``manifest`` (file name to SHA-256) nothing is replaced unless every file is the pinned
    one. Returns the load summary.
    """
    if manifest is not None:
        require_pinned(store.spark, path, manifest)
    store.overwrite(relation, raw_transactions(read_transactions(store.spark, path)))
    return load_summary(store.read(relation).withColumn("source", F.lit(relation)))


def transform(
    store: Store,
    transactions: DataFrame,
    settings: Settings = Settings(),
    expected: Expected = Expected(),
    close_cohort: bool = False,
    check: bool = True,
) -> dict[str, DataFrame]:
    """Build every relation that needs no fit, then check them.

    The line items are collapsed once and the occasions written: they are all the customer
    relations need, and they hold at most a calendar's worth of rows per customer. One shuffle of
    them then gives the wide customer relation, of which the summaries, the outcome and the
    look-backs are projections.
    The line items themselves are never copied; the returned ``transactions`` is a view. With
    ``close_cohort`` later arrivals are set aside, in that view as well, so that the reconciling
    checks speak about one population.
    """
    occasions = materialise(purchase_occasions(transactions))
    store.overwrite(stored.WINDOWS, analysis_windows(occasions, settings))
    windows = store.read(stored.WINDOWS)
    if close_cohort:
        occasions = closed_cohort(occasions, windows)
    store.overwrite(stored.OCCASIONS, occasions)
    occasions = store.read(stored.OCCASIONS)
    if close_cohort:
        kept = occasions.select("source", "customer_id").distinct()
        transactions = transactions.join(kept, ["source", "customer_id"], "left_semi")
    days = configured(settings.recent_window_days)
    store.overwrite("main.customer_windows", rfm.customer_windows(occasions, windows, days))
    wide = store.read("main.customer_windows")
    store.overwrite(stored.CALIBRATION, rfm.calibration_of(wide))
    store.overwrite("main.rfm_full", rfm.full_of(wide))
    store.overwrite("main.holdout_actuals", rfm.holdout_of(wide))
    store.overwrite(
        stored.SENSITIVITY, sensitivity_of(rfm.counts_of(wide, days), windows, days)
    )
    store.overwrite("main.monthly_retention", monthly_retention(occasions))
    store.overwrite("main.repeat_series", repeat_series(occasions, windows))
    tables = {**main_tables(store), "transactions": transactions}
    if check:
        suite.require_clean(suite.run_checks(tables, suite.TRANSFORM, expected))
    return tables


def main_tables(store: Store) -> dict[str, DataFrame]:
    store.require("transform", *[f"main.{name}" for name in _MAIN])
    return {name: store.read(f"main.{name}") for name in _MAIN}


@dataclass(frozen=True)
class FitOutcome:
    """What a fit produced."""

    source: str
    method: str
    purchase: models.Fit
    spend: models.Fit
    horizons: list[int]
    rows_written: int

    def summary(self, store: Store) -> DataFrame:
        """The stage counts as one row."""
        return store.spark.createDataFrame(
            [
                (
                    self.source,
                    self.method,
                    self.purchase.customers,
                    self.spend.customers,
                    self.purchase.customers - self.spend.customers,
                    ",".join(str(h) for h in self.horizons),
                    self.rows_written,
                )
            ],
            "source string, method string, customers long, spend_customers long, "
            "excluded_customers long, horizons string, rows_written long",
        )


def fit(
    store: Store, source: str, settings: Settings = Settings(), full_bayes: bool = False
) -> FitOutcome:
    """Fit both models on one source's calibration customers and store the forecasts.

    Predictions are written first and provenance after them, computed from what was written, so a
    provenance row never speaks for a write that failed. With ``full_bayes`` the posterior draws
    behind the forecasts come last, marked with that provenance. All of it becomes visible at once;
    a fit that fails on the way leaves the earlier one whole.
    """
    calibration = stored.load_calibration(store, source)
    models.check_assumptions(calibration)
    purchase = models.fit_purchase_model(calibration)
    spend = models.fit_gamma_gamma(calibration)
    window = store.read(stored.WINDOWS).where(F.col("source") == source)
    lengths = resolve_horizons(window, settings.forward_horizon_days).first()["horizons"]
    holdout_days = window.first()["duration_holdout"]

    method, drawn = purchase.method, ()
    if full_bayes:
        states = models.stored_states(calibration)
        seed = settings.random_seed
        purchase_posterior = posterior.purchase_draws(states, purchase, seed=seed)
        spend_posterior = posterior.spend_draws(calibration, spend, seed=seed + 1)
        predictions = posterior.predict_draws(
            calibration, purchase_posterior, spend_posterior, lengths
        )
        method = posterior.MCMC
        purchase, spend = purchase_posterior.mean(), spend_posterior.mean()
        drawn = (purchase_posterior, spend_posterior)
    else:
        predictions = predict(calibration, purchase, spend, lengths)
    parameters = store.spark.createDataFrame(
        [
            (source, method, family, name, value)
            for source, _, family, name, value in models.parameter_rows([purchase, spend], source)
        ],
        schemas.MODEL_PARAMETERS,
    )
    with Publication(store) as made:
        rows = stored.write_predictions(store, predictions, made)
        kept = made.read(stored.PREDICTIONS, source)
        run = fit_run(store.read(stored.CALIBRATION, source), kept, method, lengths, holdout_days)
        stored.write_fit_run(store, run, made)
        stored.write_parameters(store, parameters, made)
        if drawn:
            rows_drawn = [row for one in drawn for row in one.rows(source)]
            stored.write_draws(store, source, method, rows_drawn, made)
    return FitOutcome(source, method, purchase, spend, lengths, rows)


def load_purchase_fit(store: Store, source: str, method: str) -> models.Fit:
    """The fit behind the stored predictions, rebuilt from its parameters."""
    family = models.BG_NBD
    values = stored.read_parameters(store, source, method, family)
    ordered = {name: values[name] for name in models.PARAMETERS[family]}
    return models.Fit(family, method, ordered, float("nan"), 0, 0)


def load_draws(store: Store, source: str, family: str = models.BG_NBD) -> posterior.Draws:
    """The posterior draws behind the stored predictions; nothing is drawn or fitted anew.

    Bounded by the number of draws, whatever the population.
    """
    names = models.GAMMA_GAMMA_PARAMETERS if family == models.GAMMA_GAMMA else models.PARAMETERS[family]
    rows = stored.read_draws(store, source, posterior.MCMC, family)
    table = rows.groupBy("draw_id").pivot("parameter", list(names)).agg(F.first("value"))
    points = table.orderBy("draw_id").select(*names).toPandas().to_numpy(dtype=float)
    return posterior.given(family, names, points)


@dataclass(frozen=True)
class Validation:
    """Result relations of a validation run; the metrics relation is also stored."""

    scores: DataFrame
    metrics: DataFrame
    metrics_written: int
    tables: dict[str, DataFrame]
    challengers: tuple[models.ChallengerOutcome, ...]


def with_challengers(
    frame: DataFrame, outcomes: tuple[models.ChallengerOutcome, ...]
) -> tuple[DataFrame, dict[str, str]]:
    """Attach each fitted challenger's forecast at the holdout length as a column of its name.

    The forecast is a column of the customer's own row, so there is nothing to align.
    """
    names = {}
    for outcome in outcomes:
        if outcome.succeeded:
            column = purchases_column(outcome.fit, F.col("duration_holdout"))
            frame = frame.withColumn(outcome.family, column)
            names[outcome.family] = outcome.family
    return frame, names


def challenger_status(store: Store, outcomes: tuple[models.ChallengerOutcome, ...]) -> DataFrame:
    """One row per challenger: fitted with its parameters, or the reason it was not."""
    return store.spark.createDataFrame(
        [
            (o.family, "fitted" if o.succeeded else "did not fit", o.detail)
            for o in outcomes
        ],
        "family string, status string, detail string",
    )


def validate(
    store: Store,
    source: str,
    settings: Settings = Settings(),
    compare_models: bool = False,
    expected: Expected = Expected(),
) -> Validation:
    """Rebuild the scored relation, check it, and only then score it."""
    stored.require_predictions(store)
    tables = main_tables(store)
    windows, occasions = tables["analysis_windows"], tables["purchase_occasions"]
    predictions = store.read(stored.PREDICTIONS).select(*schemas.PREDICTIONS.names)
    store.overwrite(
        stored.SCORED,
        scored_of(
            baselines_of(
                rfm.history_of(tables["customer_windows"], settings.recent_window_days),
                tables["rfm_calibration"],
            ),
            windows,
            predictions,
        ),
    )
    # Only the validated source is checked: another one may not have been fitted yet.
    one = {
        **{name: df.where(F.col("source") == source) for name, df in tables.items()},
        "predictions": predictions.where(F.col("source") == source),
        "fit_runs": store.read(stored.FIT_RUNS, source),
        "scored": store.read(stored.SCORED, source),
    }
    suite.require_clean(suite.run_checks(one, suite.POST_FIT, expected))

    frame = stored.load_scored(store, source)
    calibration = stored.load_calibration(store, source)
    outcomes: tuple[models.ChallengerOutcome, ...] = ()
    extra: dict[str, str] = {}
    if compare_models:
        outcomes = tuple(models.fit_challenger(calibration, f) for f in models.CHALLENGERS)
        frame, extra = with_challengers(frame, outcomes)

    scores = scoring.score_all(frame, extra)
    written = stored.write_validation_metrics(store, scoring.metrics_frame(scores))
    metrics = store.read(stored.METRICS, source).select(*schemas.VALIDATION_METRICS.names)

    method = frame.select("fit_method").first()["fit_method"]
    purchase = load_purchase_fit(store, source, method)
    states = models.stored_states(calibration)
    window = windows.where(F.col("source") == source)
    one_occasions = occasions.where(F.col("source") == source)
    # A draw-averaged forecast is not the forecast at the averaged parameters: the months are
    # averaged over the same draws.
    behind = load_draws(store, source) if method == posterior.MCMC else purchase
    monthly = materialise(
        diagnostics.monthly_holdout(one_occasions, window, states, behind, source)
    )
    diagnostics.require_reconciled(monthly, frame)

    bucket_rows = buckets.bucket_table(frame, extra)
    misses = buckets.bucket_misses(bucket_rows, (scoring.CHAMPION, *extra))
    deciles = diagnostics.decile_comparison(frame)
    sensitivity = tables["recent_window_sensitivity"].where(F.col("source") == source)
    headline = verdicts.headline(metrics)
    result = {
        "buckets": bucket_rows,
        "bucket_misses": misses,
        "model_comparison": buckets.model_comparison(misses),
        "deciles": decile_table(
            frame, "holdout_spend", "expected_forward_revenue", by=["source"]
        ),
        "decile_comparison": deciles,
        "top_decile": verdicts.top_decile_gap(deciles),
        "lowest_decile": diagnostics.lowest_decile(frame),
        "independence": buckets.independence_check(frame),
        "order_value_by_bucket": buckets.order_value_by_bucket(frame),
        "alive_by_construction": diagnostics.alive_by_construction(frame),
        "intervals": diagnostics.interval_summary(frame),
        "monthly": monthly,
        "monthly_trend": diagnostics.monthly_trend(monthly),
        "parameter_comparison": diagnostics.parameter_comparison(
            store.read(stored.PARAMETERS, source).where(F.col("fit_method") == method)
        ),
        "calibration_fit": diagnostics.calibration_fit(frame, states, purchase),
        "population": diagnostics.population_summary(frame),
        "headline": headline,
        "sensitivity_verdict": verdicts.sensitivity_verdict(
            sensitivity, headline.select("source", "model_percent_error")
        ),
    }
    if outcomes:
        result["challengers"] = challenger_status(store, outcomes)
    return Validation(scores, metrics, written, result, outcomes)
