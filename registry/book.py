"""Relations the registered queries share, built from the tables of one folder."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.oracles import BG, BG_DRAWS, FORWARD_DAYS, GG, GG_DRAWS, LOOK_BACKS, RECENT_DAYS
from returnwise.models import draws
from returnwise.models import fit as models
from returnwise.models.fingerprints import fit_run
from returnwise.models.fit import Fit
from returnwise.models.predict import predict
from returnwise.operators import rfm
from returnwise.operators.occasions import purchase_occasions
from returnwise.operators.scored import baselines_of, scored_of
from returnwise.operators.sensitivity import configured, sensitivity_of
from returnwise.operators.windows import analysis_windows, closed_cohort
from returnwise.session import checkpoint_root, materialise
from returnwise.sources import retail
from returnwise.sources.store import Store

LITERAL_PURCHASE = Fit(models.BG_NBD, "map", dict(BG), float("nan"), 0, 0)
LITERAL_SPEND = Fit(models.GAMMA_GAMMA, "map", dict(GG), float("nan"), 0, 0)
GIVEN_PURCHASE = draws.given(models.BG_NBD, models.PARAMETERS[models.BG_NBD], BG_DRAWS)
GIVEN_SPEND = draws.given(models.GAMMA_GAMMA, models.GAMMA_GAMMA_PARAMETERS, GG_DRAWS)
SOURCES = (retail.ORDERS, retail.EVENTS)


class Book:
    """Lazily built relations over one folder; the expensive ones are written once per session.

    ``transactions``, ``plan_occasions`` and ``plan_windows`` are plans over the tables.
    ``occasions`` and everything after it are stored, as the stages store them, so the line items
    are collapsed once however many queries run. From ``cohort`` on, the relations describe
    customers acquired before the cutoff.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def transactions(self) -> DataFrame:
        return retail.transactions(self.spark, self.folder)

    @cached_property
    def plan_occasions(self) -> DataFrame:
        return purchase_occasions(retail.order_totals(self.spark, self.folder))

    @cached_property
    def plan_windows(self) -> DataFrame:
        return analysis_windows(self.plan_occasions, retail.RETAIL_SETTINGS)

    @cached_property
    def occasions(self) -> DataFrame:
        return materialise(self.plan_occasions)

    @cached_property
    def windows(self) -> DataFrame:
        return materialise(analysis_windows(self.occasions, retail.RETAIL_SETTINGS))

    @cached_property
    def cohort(self) -> DataFrame:
        return materialise(closed_cohort(self.occasions, self.windows))

    @cached_property
    def wide(self) -> DataFrame:
        return materialise(rfm.customer_windows(self.cohort, self.windows, LOOK_BACKS))

    @cached_property
    def calibration(self) -> DataFrame:
        return materialise(rfm.calibration_of(self.wide))

    @cached_property
    def full(self) -> DataFrame:
        return rfm.full_of(self.wide)

    @cached_property
    def holdout(self) -> DataFrame:
        return rfm.holdout_of(self.wide)

    @cached_property
    def sensitivity(self) -> DataFrame:
        days = configured(RECENT_DAYS)
        return materialise(
            sensitivity_of(rfm.counts_of(self.wide, days), self.windows, days)
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Forecasts with literal parameters at the holdout length and one year ahead."""
        lengths = self.windows.select(
            "source",
            F.array("duration_holdout", F.lit(FORWARD_DAYS)).alias("_horizons"),
        )
        calibration = self.calibration.join(F.broadcast(lengths), "source")
        return materialise(
            predict(calibration, LITERAL_PURCHASE, LITERAL_SPEND, F.col("_horizons"))
        )

    @cached_property
    def scored(self) -> DataFrame:
        base = baselines_of(rfm.history_of(self.wide, RECENT_DAYS), self.calibration)
        return materialise(scored_of(base, self.windows, self.predictions))

    @cached_property
    def open_wide(self) -> DataFrame:
        """Every customer, whenever acquired: the relation as a source that still grows has it."""
        return materialise(rfm.customer_windows(self.occasions, self.windows, LOOK_BACKS))

    @cached_property
    def open_calibration(self) -> DataFrame:
        return materialise(rfm.calibration_of(self.open_wide))

    @cached_property
    def open_scored(self) -> DataFrame:
        """The scored relation of all calibration customers, those of the last day included."""
        lengths = self.windows.select("source", F.array("duration_holdout").alias("_horizons"))
        forecasts = predict(
            self.open_calibration.join(F.broadcast(lengths), "source"),
            LITERAL_PURCHASE, LITERAL_SPEND, F.col("_horizons"),
        )
        base = baselines_of(rfm.history_of(self.open_wide, RECENT_DAYS), self.open_calibration)
        return materialise(scored_of(base, self.windows, forecasts))

    @cached_property
    def fit_runs(self) -> DataFrame:
        return materialise(
            fit_run(self.calibration, self.predictions, "map", [FORWARD_DAYS], 0)
        )

    @cached_property
    def orders_calibration(self) -> DataFrame:
        return self.calibration.where(F.col("source") == retail.ORDERS)

    @cached_property
    def orders_states(self) -> DataFrame:
        return models.stored_states(self.orders_calibration)

    def states_of(self, source: str) -> DataFrame:
        """The states of one source, written once."""
        if source == retail.ORDERS:
            return self.orders_states
        memo = self.__dict__.setdefault("_states", {})
        if source not in memo:
            memo[source] = models.stored_states(self.calibration.where(F.col("source") == source))
        return memo[source]

    @cached_property
    def posterior(self) -> tuple[draws.Draws, draws.Draws]:
        """Draws of both models on the orders source, once per session."""
        return (
            draws.purchase_draws(self.orders_states, self.fitted(models.BG_NBD)),
            draws.spend_draws(self.orders_calibration, self.fitted(models.GAMMA_GAMMA)),
        )

    def fitted(self, family: str) -> Fit:
        """A purchase model fitted on the orders source, once per session."""
        memo = self.__dict__.setdefault("_fits", {})
        if family not in memo:
            memo[family] = (
                models.fit_gamma_gamma(self.orders_calibration)
                if family == models.GAMMA_GAMMA
                else models.fit_states(self.orders_states, family)
            )
        return memo[family]

    def new_store(self) -> Store:
        """A store under a fresh folder of the shared root."""
        root = f"{checkpoint_root(self.spark)}/store-{uuid.uuid4().hex}"
        return Store(self.spark, root)


_books: dict[tuple[str, str], Book] = {}


def book(spark: SparkSession, folder: str) -> Book:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _books:
        _books[key] = Book(spark, folder)
    return _books[key]
