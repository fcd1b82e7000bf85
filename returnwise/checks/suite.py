"""The checks by stage, and the report a run of them gives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnwise.checks import engine, generic, relations
from returnwise.operators.scored import BASELINES
from returnwise.operators.transactions import duplicate_excess
from returnwise.session import materialise

TRANSFORM = "transform"
POST_FIT = "post_fit"
FIT_METHODS = ("map", "ml", "mcmc")

Tables = Mapping[str, DataFrame]


class CheckFailed(RuntimeError):
    """At least one integrity check found offending rows."""


@dataclass(frozen=True)
class Expected:
    """What a caller knows about the data beforehand; checks without a value are left out."""

    sources: Sequence[str] = ()
    windows: Mapping[str, tuple[date, date, date, date]] = field(default_factory=dict)
    duplicates: Mapping[str, int] = field(default_factory=dict)
    recent_window_days: int = 91


@dataclass(frozen=True)
class Check:
    name: str
    stage: str
    run: Callable[[Tables, Expected], DataFrame]


_SUMMARIES = ("rfm_calibration", "rfm_full", "holdout_actuals")

# Columns that may never be NULL, per relation.
REQUIRED = {
    "transactions": ("source", "customer_id", "order_id", "order_date", "quantity",
                     "gross_amount", "is_return"),
    "analysis_windows": ("source", "calibration_start", "calibration_end", "holdout_start",
                         "holdout_end", "duration_holdout"),
    "purchase_occasions": ("occasion_id", "source", "customer_id", "order_date", "gross_amount",
                           "line_items"),
    "rfm_calibration": ("source", "customer_id", "frequency", "recency", "customer_age",
                        "total_spend", "first_occasion_spend", "monetary_value",
                        "is_gamma_gamma_eligible"),
    "rfm_full": ("source", "customer_id", "frequency", "recency", "customer_age",
                 "monetary_value"),
    "holdout_actuals": ("source", "customer_id", "holdout_frequency", "holdout_spend",
                        "holdout_monetary_value", "duration_holdout"),
    "monthly_retention": ("source", "cohort_month", "months_since_first", "activity_month",
                          "cohort_size", "active_customers", "retention_rate"),
    "recent_window_sensitivity": ("source", "window_days", "customers", "predicted_purchases",
                                  "actual_purchases", "percent_error"),
    "predictions": ("source", "customer_id", "horizon_days", "expected_purchases",
                    "probability_alive", "expected_avg_value", "expected_forward_revenue",
                    "spend_estimate_source", "is_gamma_gamma_eligible", "fit_method"),
    "scored": ("source", "customer_id", "horizon_days", "holdout_frequency", "holdout_spend",
               "expected_purchases", "expected_forward_revenue", *BASELINES,
               "recent_window_days"),
}
_POST_FIT_TABLES = ("predictions", "scored")
KEYS_OF = {"analysis_windows": ("source",), "purchase_occasions": ("occasion_id",)}


def _some(tables: Tables, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: tables[name] for name in names}


def _profile(tables: Tables) -> DataFrame:
    """The shared pass over the line items, where a run has one already."""
    if "transaction_profile" in tables:
        return tables["transaction_profile"]
    return relations.transaction_profile(tables["transactions"], REQUIRED["transactions"])


def _none(tables: Tables) -> DataFrame:
    """No violations, for a check nothing is expected of: one that reads no data."""
    return tables["analysis_windows"].limit(0)


def _null_transactions(tables: Tables) -> DataFrame:
    """Sources with NULLs in a required line-item column."""
    names = [f"null_{c}" for c in REQUIRED["transactions"] if c != "source"]
    found = reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names])
    return _profile(tables).where(found | F.col("source").isNull()).select("source", *names)


def all_checks() -> list[Check]:
    """Every check with the stage it belongs to."""
    checks = [
        Check("transactions_within_windows", TRANSFORM, lambda t, e:
              relations.transactions_within_windows(_profile(t), t["analysis_windows"])),
        Check("amounts_plausible", TRANSFORM, lambda t, e:
              relations.sources_with_implausible_amounts(_profile(t))),
        Check("no_leakage", TRANSFORM, lambda t, e:
              relations.no_leakage(t["rfm_calibration"], t["analysis_windows"])),
        Check("calibration_within_full", TRANSFORM, lambda t, e:
              relations.calibration_within_full(t["rfm_calibration"], t["rfm_full"])),
        Check("windows_match", TRANSFORM, lambda t, e:
              relations.windows_match(t["analysis_windows"], e.windows)),
        Check("populations_align", TRANSFORM, lambda t, e:
              relations.populations_align(_some(t, _SUMMARIES))),
        Check("holdout_consistent", TRANSFORM, lambda t, e:
              relations.holdout_consistent(t["holdout_actuals"])),
        Check("holdout_reconciles", TRANSFORM, lambda t, e:
              relations.holdout_reconciles(
                  t["rfm_calibration"], t["rfm_full"], t["holdout_actuals"])),
        Check("known_duplicates", TRANSFORM, lambda t, e:
              relations.known_duplicates(duplicate_excess(t["transactions"]), e.duplicates)
              if e.duplicates else _none(t)),
        Check("monetary_value_matches", TRANSFORM, lambda t, e:
              relations.monetary_value_matches(
                  t["rfm_calibration"], t["purchase_occasions"], t["analysis_windows"])),
        Check("occasions_collapsed", TRANSFORM, lambda t, e:
              relations.occasions_collapsed(t["purchase_occasions"], _profile(t))),
        Check("one_row_per_customer", TRANSFORM, lambda t, e:
              relations.one_row_per_customer(_some(t, _SUMMARIES))),
        Check("sensitivity_complete", TRANSFORM, lambda t, e:
              relations.sensitivity_complete(
                  t["recent_window_sensitivity"], t["rfm_calibration"])),
        Check("sensitivity_recomputes", TRANSFORM, lambda t, e:
              relations.sensitivity_recomputes(
                  t["recent_window_sensitivity"], t["rfm_calibration"],
                  t["purchase_occasions"], t["analysis_windows"])),
        Check("rfm_invariants", TRANSFORM, lambda t, e:
              relations.rfm_invariants(t["rfm_calibration"], t["rfm_full"])),
        Check("spend_reconciles", TRANSFORM, lambda t, e:
              relations.spend_reconciles(
                  t["rfm_calibration"], t["rfm_full"], t["holdout_actuals"])),
        Check("baselines_recompute", POST_FIT, lambda t, e:
              relations.baselines_recompute(
                  t["scored"], t["rfm_calibration"], t["purchase_occasions"],
                  t["analysis_windows"], e.recent_window_days)),
        Check("predictions_unchanged", POST_FIT, lambda t, e:
              relations.predictions_unchanged(t["predictions"], t["fit_runs"])),
        Check("inputs_unchanged", POST_FIT, lambda t, e:
              relations.inputs_unchanged(t["rfm_calibration"], t["fit_runs"])),
        Check("sensitivity_matches_scored", POST_FIT, lambda t, e:
              relations.sensitivity_matches_scored(
                  t["recent_window_sensitivity"], t["scored"], e.recent_window_days)),
        Check("scored_horizon", POST_FIT, lambda t, e:
              relations.scored_horizon(t["scored"], t["analysis_windows"])),
        Check("scored_population", POST_FIT, lambda t, e:
              relations.scored_population(t["rfm_calibration"], t["scored"])),
        Check("accepted_fit_method", POST_FIT, lambda t, e:
              generic.accepted_values(t["predictions"], "fit_method", FIT_METHODS)),
        Check("accepted_sources", TRANSFORM, lambda t, e:
              generic.accepted_values(_profile(t), "source", e.sources)
              if e.sources else _none(t)),
        Check("not_null_transactions", TRANSFORM, lambda t, e: _null_transactions(t)),
    ]
    for table, columns in REQUIRED.items():
        if table == "transactions":
            continue
        stage = POST_FIT if table in _POST_FIT_TABLES else TRANSFORM
        checks.append(
            Check(f"not_null_{table}", stage,
                  lambda t, e, table=table, columns=columns: generic.not_null(t[table], columns))
        )
    for table, columns in KEYS_OF.items():
        checks.append(
            Check(f"unique_{table}", TRANSFORM,
                  lambda t, e, table=table, columns=columns: generic.unique(t[table], columns))
        )
    return checks


def run_checks(
    tables: Tables, stage: str, expected: Expected = Expected(), only: Sequence[str] = ()
) -> DataFrame:
    """Report of one stage: ``(check_name, stage, violations)``.

    Checks on single rows and on totals are measures of one scan of each relation
    (:mod:`returnwise.checks.engine`); the others, which join or group, are counted beside them in
    one union. The line items are profiled once beforehand.
    """
    if stage == TRANSFORM and "transaction_profile" not in tables:
        tables = {**tables, "transaction_profile": materialise(_profile(tables))}

    def chosen(name: str) -> bool:
        return not only or name in only

    of_stage = engine.transform_checks if stage == TRANSFORM else engine.post_fit_checks
    scans = [c for c in of_stage(REQUIRED) if chosen(c.name)]
    scanned = {c.name for c in scans}
    counts = [engine.report(scans, tables, stage)] if scans else []
    counts += [
        check.run(tables, expected)
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(
            F.lit(check.name).alias("check_name"), F.lit(check.stage).alias("stage"), "violations"
        )
        for check in all_checks()
        if check.stage == stage and chosen(check.name) and check.name not in scanned
    ]
    return reduce(DataFrame.unionByName, counts)


def require_clean(report: DataFrame) -> None:
    """Raise naming every failed check and its violation count."""
    failed = report.where(F.col("violations") > 0).orderBy("check_name").collect()
    if failed:
        raise CheckFailed(
            "; ".join(f"{r['check_name']}: {r['violations']} rows" for r in failed)
        )
