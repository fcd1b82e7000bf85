"""Many checks from one scan of each relation.

A check that looks at single rows, or at totals, is a set of measures: aggregates over relations,
and an expression over their values that says how many violations there are. All measures of a
relation go into one aggregate, whatever the number of checks, so a relation is read once. The
relations are the stored ones and two derived once for all checks: the line items' profile, with a
row for each source, and the ledger, which puts a customer's rows of the three summaries side by
side with one shuffle and partial aggregation before it.

The results are one row for each relation. They are joined as single rows and turned into the
report. Functions in ``relations`` list the offending rows; the counts here are theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnwise.checks.relations import KEYS
from returnwise.schemas import sum_money

LEDGER = "customer_ledger"
PROFILE = "transaction_profile"
SUMMARIES = ("rfm_calibration", "rfm_full", "holdout_actuals")


@dataclass(frozen=True)
class ScanCheck:
    """``measures`` by relation and name, and the violations that follow from their values."""

    name: str
    measures: Mapping[str, Mapping[str, Column]]
    violations: Callable[[Callable[[str, str], Column]], Column]


def total(name: str, *parts: tuple[str, Column]) -> ScanCheck:
    """A check whose violations are the sum of one measure from each of some relations."""
    return ScanCheck(
        name,
        {relation: {"violations": measure} for relation, measure in parts},
        lambda value: reduce(lambda a, b: a + b, [value(r, "violations") for r, _ in parts]),
    )


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ledger(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per customer with what its rows in the three summaries say, and how many there are.

    A customer without a row in a summary has NULLs there. Where a summary repeats a customer its
    largest values stand for it; the repetition itself is counted.
    """
    values = {
        "rfm_calibration": ("occasions", "frequency", "total_spend", "customer_age", "first_order_date"),
        "rfm_full": ("occasions", "frequency", "total_spend", "customer_age", "first_order_date"),
        "holdout_actuals": ("holdout_frequency", "holdout_spend"),
    }
    types = {f.name: f.dataType for n in values for f in tables[n].schema}
    names = sorted({c for columns in values.values() for c in columns})
    rows = [
        tables[relation].select(
            *KEYS, F.lit(relation).alias("_relation"),
            *[(F.col(c) if c in columns else F.lit(None).cast(types[c])).alias(c) for c in names],
        )
        for relation, columns in values.items()
    ]
    own = {n: F.col("_relation") == n for n in values}
    return reduce(DataFrame.unionByName, rows).groupBy(*KEYS).agg(
        *[F.count_if(own[n]).alias(f"rows_{n}") for n in values],
        *[
            F.max(F.when(own[n], F.col(c))).alias(f"{n}_{c}")
            for n, columns in values.items() for c in columns
        ],
    )


def not_null(relation: str, columns: Sequence[str]) -> ScanCheck:
    """Columns of a relation that hold NULLs."""
    return ScanCheck(
        f"not_null_{relation}",
        {relation: {c: F.count_if(F.col(c).isNull()) for c in columns}},
        lambda value: reduce(
            lambda a, b: a + b, [(value(relation, c) > 0).cast("long") for c in columns]
        ),
    )


def _rfm_broken() -> Column:
    x, tx, age, mean = (F.col(c) for c in ("frequency", "recency", "customer_age", "monetary_value"))
    return (
        (tx > age) | (tx < 0) | (age < 0) | (x < 0) | (x != F.col("occasions") - 1)
        | ((x == 0) & (mean != 0)) | ((x > 0) & (tx <= 0))
        | (F.col("is_gamma_gamma_eligible") & ((x == 0) | (mean <= 0)))
    )


def _holdout_broken() -> Column:
    n, spend = F.col("holdout_frequency"), F.col("holdout_spend").cast("double")
    mean = F.col("holdout_monetary_value").cast("double")
    allowed = F.greatest(F.lit(0.01), n * 0.000051)
    return (
        (n < 0) | (spend < 0) | ((n == 0) & ((spend != 0) | (mean != 0)))
        | (F.abs(mean * n - spend) > allowed)
    )


def _collapse() -> ScanCheck:
    after = {
        "occasions": F.count(F.lit(1)), "lines": F.sum("line_items"),
        "units": F.sum("quantity"), "money": sum_money(F.col("gross_amount")),
    }
    before = {
        "lines": F.sum("transaction_count"), "units": F.sum("transaction_quantity"),
        "money": F.sum("transaction_amount"),
    }

    def broken(value) -> Column:
        now = {c: value("purchase_occasions", c) for c in after}
        then = {c: value(PROFILE, c) for c in before}
        differs = reduce(lambda a, b: a | b, [now[c] != then[c] for c in before])
        return F.coalesce(differs | (now["occasions"] >= now["lines"]), F.lit(False)).cast("long")

    return ScanCheck("occasions_collapsed", {"purchase_occasions": after, PROFILE: before}, broken)


def transform_checks(required: Mapping[str, Sequence[str]]) -> list[ScanCheck]:
    """The checks of the transform stage that need no more than a scan."""
    in_all = [F.col(f"rows_{n}") > 0 for n in SUMMARIES]
    has = dict(zip(SUMMARIES, in_all, strict=True))
    grown = [
        F.col(f"rfm_calibration_{c}") > F.col(f"rfm_full_{c}")
        for c in ("frequency", "total_spend", "customer_age")
    ]
    moved = F.col("rfm_calibration_first_order_date") != F.col("rfm_full_first_order_date")
    added = F.col("rfm_calibration_occasions") + F.col("holdout_actuals_holdout_frequency")
    spent = F.col("rfm_calibration_total_spend") + F.col("holdout_actuals_holdout_spend")
    nulls = reduce(
        lambda a, b: a | b,
        [F.col(f"null_{c}") > 0 for c in required["transactions"] if c != "source"],
        F.col("source").isNull(),
    )
    return [
        total("amounts_plausible", (PROFILE, _count(F.col("implausible_rows") > 0))),
        total("not_null_transactions", (PROFILE, _count(nulls))),
        total("holdout_consistent", ("holdout_actuals", _count(_holdout_broken()))),
        total(
            "rfm_invariants",
            ("rfm_calibration", _count(_rfm_broken())), ("rfm_full", _count(_rfm_broken())),
        ),
        total("populations_align", (LEDGER, _count(~(in_all[0] & in_all[1] & in_all[2])))),
        total(
            "one_row_per_customer",
            (LEDGER, F.sum(reduce(lambda a, b: a + b, [(F.col(f"rows_{n}") > 1).cast("long") for n in SUMMARIES]))),
        ),
        total(
            "calibration_within_full",
            (LEDGER, _count(has["rfm_calibration"] & has["rfm_full"]
                            & (reduce(lambda a, b: a | b, grown) | moved))),
        ),
        total(
            "holdout_reconciles",
            (LEDGER, _count(~F.coalesce(added == F.col("rfm_full_occasions"), F.lit(False)))),
        ),
        total("spend_reconciles", (LEDGER, _count(spent != F.col("rfm_full_total_spend")))),
        _collapse(),
        *[not_null(r, c) for r, c in required.items() if r not in ("transactions", "predictions", "scored")],
    ]


def post_fit_checks(required: Mapping[str, Sequence[str]]) -> list[ScanCheck]:
    return [not_null(r, required[r]) for r in ("predictions", "scored")]


def report(checks: Sequence[ScanCheck], tables: Mapping[str, DataFrame], stage: str) -> DataFrame:
    """``(check_name, stage, violations)`` of all checks, each relation read once."""
    wanted: dict[str, dict[str, Column]] = {}
    for check in checks:
        for relation, measures in check.measures.items():
            for name, measure in measures.items():
                wanted.setdefault(relation, {})[f"{relation}.{check.name}.{name}"] = measure
    sources = dict(tables)
    if LEDGER in wanted and LEDGER not in sources:
        sources[LEDGER] = ledger(tables)
    rows = [
        sources[relation].agg(
            *[F.coalesce(m, F.lit(0)).alias(name) for name, m in measures.items()]
        )
        for relation, measures in wanted.items()
    ]
    # One row from each relation.
    together = reduce(lambda a, b: a.crossJoin(b), rows)

    def values(check: ScanCheck) -> Callable[[str, str], Column]:
        return lambda relation, name: F.col(f"`{relation}.{check.name}.{name}`")

    entries = [
        F.struct(
            F.lit(c.name).alias("check_name"), F.lit(stage).alias("stage"),
            c.violations(values(c)).cast("long").alias("violations"),
        )
        for c in checks
    ]
    return together.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
