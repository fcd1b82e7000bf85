"""The stored relations: parquet roots partitioned by ``source``.

A write replaces exactly the sources it carries. Partition overwrite is asked for on the write
itself, so a session with other defaults cannot turn a refit of one source into the loss of the
others. What a fit leaves behind is published in versions (``publication``): predictions,
provenance, parameters and draws change together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnwise import schemas
from returnwise.sources import publication
from returnwise.sources.publication import Publication


class MissingStage(RuntimeError):
    """A relation is absent because an earlier stage has not run."""


class StaleDraws(RuntimeError):
    """Stored draws belong to another fit than the stored predictions or parameters."""


@dataclass(frozen=True)
class Store:
    """Relation paths under one root: ``raw``, ``main`` and ``model`` schemas."""

    spark: SparkSession
    root: str

    def path(self, relation: str) -> str:
        schema, _, name = relation.partition(".")
        return f"{self.root.rstrip('/')}/{schema}/{name}"

    def exists(self, relation: str) -> bool:
        if relation in PUBLISHED:
            return publication.read(self, relation) is not None
        try:
            self.spark.read.parquet(self.path(relation))
        except AnalysisException:
            return False
        return True

    def require(self, stage: str, *relations: str) -> None:
        """Fail naming the stage to run when any relation is missing."""
        missing = [r for r in relations if not self.exists(r)]
        if missing:
            raise MissingStage(
                f"{', '.join(missing)} not found under {self.root}: run the {stage} stage first."
            )

    def read(self, relation: str, source: str | None = None) -> DataFrame:
        """A stored relation, or only one source's folder of it."""
        df = self._stored(relation)
        return df if source is None else df.where(F.col("source") == source)

    def _stored(self, relation: str) -> DataFrame:
        """The relation with folder names read as text: ``007`` and ``7`` are different sources."""
        if relation in PUBLISHED:
            rows = publication.read(self, relation)
            if rows is None:
                raise MissingStage(f"{relation} not found under {self.root}: run the fit stage first.")
            return rows
        path = self.path(relation)
        found = self.spark.read.parquet(path).schema
        folders = {"source", "fit_method", "family"}
        text = [T.StructField(f.name, T.StringType()) if f.name in folders else f for f in found]
        return self.spark.read.schema(T.StructType(text)).parquet(path)

    def overwrite(self, relation: str, df: DataFrame) -> None:
        """Full refresh of a relation that is rebuilt as a whole, in one folder per source."""
        if relation in PUBLISHED:
            with Publication(self) as made:
                made.stage_whole(relation, df, PUBLISHED[relation])
            return
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if "source" in df.columns:
            writer = writer.partitionBy("source")
        writer.parquet(self.path(relation))

    def replace_sources(self, relation: str, df: DataFrame) -> int:
        """Replace the rows of the sources in ``df``; returns the rows now held for them.

        A frame whose columns differ from what is stored is refused before anything is written.
        """
        if relation in PUBLISHED:
            return _stage(self, None, relation, df)
        if self.exists(relation):
            stored = self.read(relation).schema
            if publication.shape(stored) != publication.shape(df.schema):
                raise ValueError(
                    f"{relation} is stored as {stored.simpleString()}, "
                    f"the frame is {df.schema.simpleString()}"
                )
        # Counted while written: a second pass could mean fitting or scoring twice.
        written = Observation()
        (
            df.observe(written, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("source")
            .parquet(self.path(relation))
        )
        return written.get["rows"]


PREDICTIONS = "model.customer_predictions"
FIT_RUNS = "model.fit_runs"
PARAMETERS = "model.model_parameters"
DRAWS = "model.draws"
METRICS = "model.validation_metrics"
CALIBRATION = "main.rfm_calibration"
WINDOWS = "main.analysis_windows"
OCCASIONS = "main.purchase_occasions"
SCORED = "main.scored"
SENSITIVITY = "main.recent_window_sensitivity"

#: What a fit leaves behind, held in versions, and the columns that tell its parts apart.
PUBLISHED = {
    PREDICTIONS: ("source",), FIT_RUNS: ("source",), PARAMETERS: publication.PART, DRAWS: publication.PART,
}


def _stage(store: Store, made: Publication | None, relation: str, df: DataFrame) -> int:
    """Stage rows in ``made``, or publish them at once where there is none."""
    if made is not None:
        return made.stage(relation, df, PUBLISHED[relation])
    with Publication(store) as alone:
        return alone.stage(relation, df, PUBLISHED[relation])


def write_predictions(store: Store, predictions: DataFrame, made: Publication | None = None) -> int:
    return _stage(store, made, PREDICTIONS, schemas.conform(predictions, schemas.PREDICTIONS))


def write_fit_run(store: Store, run: DataFrame, made: Publication | None = None) -> int:
    """Provenance of a fit; refused unless that fit's predictions are already stored."""
    if made is None or not made.holds(PREDICTIONS):
        store.require("fit", PREDICTIONS)
    return _stage(store, made, FIT_RUNS, run)


def write_validation_metrics(store: Store, metrics: DataFrame) -> int:
    return store.replace_sources(METRICS, schemas.conform(metrics, schemas.VALIDATION_METRICS))


def write_parameters(store: Store, parameters: DataFrame, made: Publication | None = None) -> None:
    """Parameters keyed by (source, fit method, family): one method never overwrites another."""
    rows = schemas.conform(parameters, schemas.MODEL_PARAMETERS)
    _stage(store, made, PARAMETERS, rows)


def read_parameters(store: Store, source: str, method: str, family: str) -> dict[str, float]:
    """The fitted parameters behind the stored predictions; absent means the fit has not run."""
    store.require("fit", PARAMETERS)
    rows = (
        store.read(PARAMETERS, source)
        .where((F.col("fit_method") == method) & (F.col("family") == family))
        .select("parameter", "value")
        .collect()
    )
    if not rows:
        raise MissingStage(
            f"no stored {family} parameters for source {source!r} by {method!r}: run the fit stage."
        )
    return {r["parameter"]: r["value"] for r in rows}


def run_id(store: Store, source: str, made: Publication | None = None) -> str:
    """What tells one fit of a source from another: a digest of its provenance row.

    The row pins what the fit read and wrote, so the same predictions on the same data have the
    same id wherever they were made; the time of the fit is no part of it.
    """
    if made is not None and made.holds(FIT_RUNS):
        runs = made.read(FIT_RUNS, source)
    else:
        store.require("fit", FIT_RUNS)
        runs = store.read(FIT_RUNS, source)
    parts = [
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(runs.columns) if c != "fitted_at"
    ]
    rows = runs.select(F.sha2(F.concat_ws("|", *parts), 256).alias("id")).collect()
    if len(rows) != 1:
        raise MissingStage(f"{len(rows)} provenance rows for source {source!r}: run the fit stage.")
    return rows[0]["id"]


def write_draws(
    store: Store, source: str, method: str, rows: list[tuple], made: Publication | None = None
) -> None:
    """Posterior draws ``(source, draw_id, family, parameter, value)`` of the stored fit.

    Written after its provenance and marked with it; the draws of a family replace its earlier ones.
    """
    version = run_id(store, source, made)
    table = store.spark.createDataFrame(
        [(s, method, family, version, draw, name, value) for s, draw, family, name, value in rows],
        schemas.MODEL_DRAWS,
    )
    _stage(store, made, DRAWS, table)


def read_draws(store: Store, source: str, method: str, family: str) -> DataFrame:
    """``(draw_id, parameter, value)`` of the fit behind the stored predictions.

    Refused where they were drawn for another fit, or where their means are not the stored
    parameters: draws, parameters and predictions speak about one posterior or not at all.
    """
    store.require("fit", DRAWS)
    stored = store.read(DRAWS, source).where(
        (F.col("fit_method") == method) & (F.col("family") == family)
    )
    means = stored.groupBy("parameter").agg(
        F.avg("value").alias("mean"), F.min("run_id").alias("first"), F.max("run_id").alias("last")
    ).collect()
    if not means:
        raise MissingStage(
            f"no stored {family} draws for source {source!r} by {method!r}: run the fit stage."
        )
    version = run_id(store, source)
    if any(r["first"] != version or r["last"] != version for r in means):
        raise StaleDraws(f"the {family} draws of source {source!r} belong to another fit.")
    held = read_parameters(store, source, method, family)
    for row in means:
        if not math.isclose(row["mean"], held.get(row["parameter"], math.nan), rel_tol=1e-9):
            raise StaleDraws(f"{family} {row['parameter']} of source {source!r} is not its draws' mean.")
    return stored.select("draw_id", "parameter", "value")


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise MissingStage(f"no {what} rows: run the stage that builds it first.")
    return df


def calibration_frame(calibration: DataFrame, source: str) -> DataFrame:
    """One source's model input; money becomes double here and nowhere else."""
    columns = ["monetary_value", "total_spend", "first_occasion_spend"]
    return calibration.where(F.col("source") == source).select(
        "source",
        "customer_id",
        "frequency",
        "recency",
        "customer_age",
        *[F.col(c).cast("double").alias(c) for c in columns],
        "is_gamma_gamma_eligible",
    )


def scored_frame(scored: DataFrame, source: str) -> DataFrame:
    """One source's scored rows with money as double."""
    money = {"monetary_value", "holdout_spend", "holdout_monetary_value"}
    return scored.where(F.col("source") == source).select(
        *[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in scored.columns]
    )


def sensitivity_frame(sensitivity: DataFrame, source: str) -> DataFrame:
    """One source's look-backs, shortest first."""
    return (
        sensitivity.where(F.col("source") == source)
        .select("window_days", "predicted_purchases", "percent_error")
        .orderBy("window_days")
    )


def load_calibration(store: Store, source: str) -> DataFrame:
    store.require("transform", CALIBRATION, WINDOWS)
    return _not_empty(
        calibration_frame(store.read(CALIBRATION), source), f"calibration ({source})"
    )


def load_scored(store: Store, source: str) -> DataFrame:
    store.require("validate", SCORED)
    return _not_empty(scored_frame(store.read(SCORED), source), f"scored ({source})")


def load_sensitivity(store: Store, source: str) -> DataFrame:
    store.require("transform", SENSITIVITY)
    return sensitivity_frame(store.read(SENSITIVITY), source)


def require_predictions(store: Store) -> None:
    store.require("fit", PREDICTIONS, FIT_RUNS)
