"""Every registered query beside its SQL twin.

A query names its result columns once, with how each is compared: ``s`` text (dates as ISO text),
``i`` whole number, ``w`` whole number that may grow past 64 bits, ``b`` boolean, ``fN`` double to
N places. The same list shapes the
Spark result and the SQL statement, so the two cannot drift apart in names or types. Undefined
values (NaN) compare as NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.book import GIVEN_PURCHASE, GIVEN_SPEND, LITERAL_PURCHASE, LITERAL_SPEND, SOURCES, Book, book
from registry.oracles import (

    BG,
    FORWARD_DAYS,
    LOOK_BACKS,
    RECENT_DAYS,

    _ranked,
    statement,
)
from returnwise.checks import generic, relations, suite
from returnwise.metrics import buckets, diagnostics, errors, rank, scoring, verdicts
from returnwise.models import draws, fit as models, fingerprints
from returnwise.models.predict import (
    alive_column,
    expected_over_draws,
    expected_over_states,
    resolve_horizons,
    spend_column,
)
from returnwise.operators import (
    cohorts,
    occasions as occasion_ops,
    ranking,
    rfm,
    scored as scored_ops,
    sensitivity as sensitivity_ops,
    transactions as transaction_ops,
    windows as window_ops,
)
from returnwise.plans.stages import challenger_status, load_draws, with_challengers
from returnwise.session import checkpoint_root, materialise
from returnwise.settings import Settings
from returnwise.sources import checksum, fixed_width, retail, store as stored
from returnwise.sources.fixed_width import Field, Layout
from returnwise.sources.publication import Publication

import uuid

# ---- shaping ----------------------------------------------------------------------------------


def _shift(places: int) -> float:
    """A hundredth of the last place kept.

    Money times a simple fraction often ends exactly on a half of that place, where two engines
    round apart; the shift moves the edge to where no such value lies.
    """
    return 0.01234567 * 10.0**-places


def _spark_column(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    if kind == "s":
        shaped = column.cast("string")
    elif kind == "i":
        shaped = column.cast("long")
    elif kind == "w":
        shaped = column.cast("decimal(38,0)")
    elif kind == "b":
        shaped = column.cast("boolean")
    else:
        number = column.cast("double")
        places = int(kind[1:])
        shaped = F.when(
            ~F.isnan(number), F.round(number + F.lit(_shift(places)), places) + F.lit(0.0)
        )
    return shaped.alias(name)


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "s":
        return f"{quoted}::varchar as {quoted}"
    if kind in "iw":
        return f"{quoted}::bigint as {quoted}"
    if kind == "b":
        return f"{quoted}::boolean as {quoted}"
    places = int(kind[1:])
    return (
        f"case when not isnan({quoted}::double) "
        f"then round({quoted}::double + {_shift(places)!r}::double, {places}) + 0.0 end"
        f"::double as {quoted}"
    )


def _narrowed(
    result: DataFrame, columns: tuple[tuple[str, str], ...]
) -> tuple[DataFrame, tuple[tuple[str, str], ...]]:
    """``result``, evaluated once, and its columns with every ``w`` that fits 64 bits as an ``i``.

    The SQL twins have 64 bits. Where a sum is larger its exact digits stay, as a decimal.
    """
    fixed = materialise(result)
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    fits = fixed.agg(
        *[F.bool_and(F.col(f"`{n}`").between(low, high)).alias(n) for n, k in columns if k == "w"]
    ).first().asDict()
    return fixed, tuple((n, "i" if k == "w" and fits[n] is not False else k) for n, k in columns)


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Book], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        result = self.build(book(spark, folder))
        if any(k == "w" for _, k in self.columns):
            result, kinds = _narrowed(result, self.columns)
        else:
            kinds = self.columns
        return result.select(*[_spark_column(n, k) for n, k in kinds])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        listed = ", ".join(_sql_column(n, k) for n, k in self.columns)
        return f"select {listed} from ({self.sql}) as answer"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, **ctes: str):
    """Register a builder under ``name``; ``columns`` is ``"name:kind name:kind ..."``."""
    shape = tuple(tuple(entry.split(":")) for entry in columns.split())

    def register(build: Callable[[Book], DataFrame]) -> Callable[[Book], DataFrame]:
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(
            name, shape, build, statement(sql, **ctes) if sql is not None else None
        )
        return build

    return register


KEYS = "source:s customer_id:i"

# ---- A: sources and sinks ---------------------------------------------------------------------

# The retail amounts need more characters than the published file's layout gives them.
WIDE = Layout(
    width=40,
    separators=(0, 13, 22, 27),
    fields=(
        Field("customer_id", 1, 13, "int"),
        Field("order_date", 14, 22, "date"),
        Field("quantity", 23, 27, "int"),
        Field("gross_amount", 28, 40, "decimal"),
    ),
)


def _text_file(b: Book, layout: Layout) -> str:
    """The line items of both sources as fixed-width text, written by Spark."""
    path = f"{checkpoint_root(b.spark)}/lines-{uuid.uuid4().hex}"
    fixed_width.render_lines(b.transactions, layout).write.text(path)
    return path


@query(
    "a1_fixed_width_permissive",
    "outcome:s lines:i amount:f2",
    """select case when width = 26 then 'accepted'
         else 'width ' || width || ' instead of 26' end as outcome,
       count(*) as lines, sum(case when width = 26 then gross_amount end)::double as amount
     from (select gross_amount, 4 + greatest(5, length(customer_id::varchar)) + 8
         + greatest(2, length(quantity::varchar)) + greatest(7, length(gross_amount::varchar))
         as width from tx)
     group by 1""",
)
def _(b: Book) -> DataFrame:
    good, rejects = fixed_width.read_transactions_permissive(
        b.spark, _text_file(b, fixed_width.TRANSACTION_LAYOUT)
    )
    return (
        good.select(F.lit("accepted").alias("outcome"), "gross_amount")
        .unionByName(
            rejects.select(
                F.col("error").alias("outcome"),
                F.lit(None).cast("decimal(12,2)").alias("gross_amount"),
            )
        )
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("gross_amount").alias("amount"))
    )


@query(
    "a2_fixed_width_custom_layout",
    "customer_id:i order_date:s quantity:i gross_amount:f2 copies:i",
    """select customer_id, order_date, quantity, gross_amount, count(*) as copies
       from tx group by 1, 2, 3, 4""",
)
def _(b: Book) -> DataFrame:
    parsed = fixed_width.read_transactions(b.spark, _text_file(b, WIDE), WIDE)
    return parsed.groupBy("customer_id", "order_date", "quantity", "gross_amount").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    "a3_raw_load_audit",
    "rows:i customers:i amount:f2 numbered_rows:i unstamped:i",
    """select count(*) as rows, count(distinct customer_id) as customers,
         sum(gross_amount)::double as amount, count(*) as numbered_rows, 0 as unstamped
       from tx""",
)
def _(b: Book) -> DataFrame:
    store = b.new_store()
    parsed = fixed_width.read_transactions(b.spark, _text_file(b, WIDE), WIDE)
    store.overwrite("raw.transactions", fixed_width.raw_transactions(parsed))
    raw = store.read("raw.transactions")
    # Line numbers run from one to the line count of each file without a gap.
    numbered = raw.groupBy("_source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("_line_number").alias("low"),
        F.max("_line_number").alias("high"),
    ).agg(F.sum(F.when((F.col("low") == 1) & (F.col("high") == F.col("n")), F.col("n"))).alias(
        "numbered_rows"
    ))
    totals = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.sum("gross_amount").alias("amount"),
        F.count_if(F.col("_ingested_at").isNull()).alias("unstamped"),
    )
    return totals.crossJoin(numbered)  # one row each


@query(
    "a4_load_summary",
    "source:s rows:i customers:i",
    "select source, count(*) as rows, count(distinct customer_id) as customers from tx group by 1",
)
def _(b: Book) -> DataFrame:
    return transaction_ops.load_summary(b.transactions)


@query("a5_file_checksums", "file_name:s size_bytes:i sha256:s")
def _(b: Book) -> DataFrame:
    return checksum.file_checksums(b.spark, f"{b.folder}/*.parquet")


@query(
    "a6_replace_sources",
    "source:s rows:i purchases:f4",
    """select source, count(*) as rows,
         sum(case when source = 'events' then 2 else 1 end * expected_purchases) as purchases
       from pred group by 1""",
)
def _(b: Book) -> DataFrame:
    store = b.new_store()
    stored.write_predictions(store, b.predictions)
    events = b.predictions.where(F.col("source") == retail.EVENTS)
    stored.write_predictions(
        store, events.withColumn("expected_purchases", F.col("expected_purchases") * 2)
    )
    return store.read(stored.PREDICTIONS).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("expected_purchases").alias("purchases")
    )


@query(
    "a8_fit_provenance_round_trip",
    "source:s calibration_rows:i sum_frequency:i horizons:s",
    f"""select source, count(*) as calibration_rows, sum(frequency) as sum_frequency,
         '{FORWARD_DAYS}' as horizons from ccal group by 1""",
)
def _(b: Book) -> DataFrame:
    store = b.new_store()
    stored.write_predictions(store, b.predictions)
    stored.write_fit_run(store, b.fit_runs)
    stored.require_predictions(store)
    return store.read(stored.FIT_RUNS)


@query(
    "a8_publication",
    "source:s rows:i calibration_rows:i after_failure:f4 purchases:f4",
    """select source, rows, calibration_rows, after_failure,
         case when source = 'events' then 3 else 1 end * after_failure as purchases
       from (select source, count(*) as rows, sum(expected_purchases) as after_failure from pred group by 1)
       join (select source, count(*) as calibration_rows from ccal group by 1) using (source)""",
)
def _(b: Book) -> DataFrame:
    """A refit that fails half-way changes nothing; one that ends changes all relations at once."""
    store = b.new_store()
    events = b.predictions.where(F.col("source") == retail.EVENTS)

    def times(n: int) -> DataFrame:
        return events.withColumn("expected_purchases", F.col("expected_purchases") * n)

    def purchases(name: str) -> DataFrame:
        held = store.read(stored.PREDICTIONS).groupBy("source")
        return held.agg(F.count(F.lit(1)).alias("rows"), F.sum("expected_purchases").alias(name))

    with Publication(store) as made:
        stored.write_predictions(store, b.predictions, made)
        stored.write_fit_run(store, b.fit_runs, made)
    try:
        with Publication(store) as made:
            stored.write_predictions(store, times(2), made)
            raise InterruptedError("the fit ends before its provenance is written")
    except InterruptedError:
        after_failure = materialise(purchases("after_failure"))
    with Publication(store) as made:
        stored.write_predictions(store, times(3), made)
        stored.write_fit_run(store, b.fit_runs.where(F.col("source") == retail.EVENTS), made)
    runs = store.read(stored.FIT_RUNS).select("source", "calibration_rows")
    return after_failure.drop("rows").join(purchases("purchases"), "source").join(runs, "source")


@query(
    "a9_validation_metrics_round_trip",
    "source:s rows:i population:i",
    """select source, count(*) as rows, sum(population)::bigint as population from long_metrics
       where not (metric like 'mape%' and quantity = 'purchases') group by 1""",
)
def _(b: Book) -> DataFrame:
    store = b.new_store()
    stored.write_validation_metrics(store, scoring.metrics_frame(scoring.score_all(b.scored)))
    return store.read(stored.METRICS).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("population").alias("population")
    )


@query(
    "a10_calibration_frame",
    "customer_id:i frequency:i recency:i customer_age:i monetary_value:f4 total_spend:f2 "
    "first_occasion_spend:f2 is_gamma_gamma_eligible:b",
    "select * from ccal where source = 'orders'",
)
def _(b: Book) -> DataFrame:
    return stored.calibration_frame(b.calibration, retail.ORDERS)


@query(
    "a11_scored_frame",
    f"{KEYS} holdout_spend:f2 holdout_monetary_value:f4 monetary_value:f4 horizon_days:i",
    "select * from scored where source = 'events'",
)
def _(b: Book) -> DataFrame:
    return stored.scored_frame(b.scored, retail.EVENTS)


@query(
    "a12_sensitivity_frame",
    "window_days:i predicted_purchases:f6 percent_error:f6",
    "select * from csens where source = 'orders'",
)
def _(b: Book) -> DataFrame:
    return stored.sensitivity_frame(b.sensitivity, retail.ORDERS)


@query(
    "a13_prediction_boundary",
    f"{KEYS} horizon_days:i expected_purchases:f6 probability_alive:f6 expected_avg_value:f4 "
    "expected_forward_revenue:f1 spend_estimate_source:s is_gamma_gamma_eligible:b",
    "select * from pred",
)
def _(b: Book) -> DataFrame:
    return scored_ops.prediction_boundary(b.predictions)


@query("a15_model_parameters", "source:s fit_method:s family:s parameter:s value:f3")
def _(b: Book) -> DataFrame:
    store = b.new_store()
    fits = [b.fitted(models.BG_NBD), b.fitted(models.GAMMA_GAMMA)]
    rows = b.spark.createDataFrame(
        models.parameter_rows(fits, retail.ORDERS), stored.schemas.MODEL_PARAMETERS
    )
    stored.write_parameters(store, rows)
    return store.read(stored.PARAMETERS)


@query(
    "a15_draws_round_trip",
    "source:s draw_id:i parameters:i expected:f3",
    """select source, draw_id, 7 as parameters, sum(purchases) as expected
       from drawn_forecasts group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    # A fit's predictions, provenance, parameters and draws, stored; then only what is read back.
    store = b.new_store()
    stored.write_predictions(store, b.predictions)
    stored.write_fit_run(store, b.fit_runs)
    results = []
    for source in SOURCES:
        means = models.parameter_rows([GIVEN_PURCHASE.mean(), GIVEN_SPEND.mean()], source)
        stored.write_parameters(
            store, b.spark.createDataFrame(means, stored.schemas.MODEL_PARAMETERS)
        )
        rows = GIVEN_PURCHASE.rows(source) + GIVEN_SPEND.rows(source)
        stored.write_draws(store, source, draws.MCMC, rows)
        days = b.windows.where(F.col("source") == source).first()["duration_holdout"]
        kept = load_draws(store, source)
        held = len(kept.fit.parameters) + len(load_draws(store, source, models.GAMMA_GAMMA).fit.parameters)
        results.append(
            expected_over_draws(b.states_of(source), kept.fit.family, kept.points, [days]).select(
                F.lit(source).alias("source"), "draw_id", F.lit(held).alias("parameters"), "expected"
            )
        )
    return results[0].unionByName(results[1])


# ---- B: projections and predicates ------------------------------------------------------------


@query(
    "b1_staged_transactions",
    f"{KEYS} order_id:s order_date:s quantity:i unit_price:f4 gross_amount:f2 is_return:b copies:i",
    """select source, customer_id, customer_id || '-' || strftime(order_date, '%Y%m%d') as order_id,
         order_date, quantity,
         case when quantity <> 0 then ((2 * (gross_amount * 100)::bigint * 100 + quantity)
           // (2 * quantity))::double / 10000 end as unit_price,
         gross_amount, false as is_return, count(*) as copies
       from tx group by all""",
)
def _(b: Book) -> DataFrame:
    staged = transaction_ops.stage_transactions(
        retail.raw_orders(b.spark, b.folder), retail.ORDERS
    ).unionByName(
        transaction_ops.stage_transactions(retail.raw_events(b.spark, b.folder), retail.EVENTS)
    )
    return staged.groupBy(*staged.columns).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "b2_unioned_transactions",
    "source:s rows:i units:i amount:f2 days:i",
    """select source, count(*) as rows, sum(quantity) as units, sum(gross_amount)::double as amount,
         count(distinct order_date) as days from tx group by 1""",
)
def _(b: Book) -> DataFrame:
    return b.transactions.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("quantity").alias("units"),
        F.sum("gross_amount").alias("amount"),
        F.count_distinct("order_date").alias("days"),
    )


@query(
    "b3_eligibility_flag",
    "source:s is_gamma_gamma_eligible:b customers:i spend:f2",
    """select source, is_gamma_gamma_eligible, count(*) as customers,
         sum(total_spend)::double as spend from cal group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    return rfm.rfm_calibration(b.occasions, b.windows).groupBy(
        "source", "is_gamma_gamma_eligible"
    ).agg(F.count(F.lit(1)).alias("customers"), F.sum("total_spend").alias("spend"))


@query(
    "b5_model_inputs",
    "part:s customer_id:i frequency:i recency:i T:i monetary_value:f4",
    """select 'purchases' as part, customer_id, frequency, recency, customer_age as "T",
         null::double as monetary_value from ccal where source = 'orders'
       union all
       select 'spend', customer_id, frequency, null, null, monetary_value
       from ccal where source = 'orders' and is_gamma_gamma_eligible""",
)
def _(b: Book) -> DataFrame:
    purchases = models.purchase_frame(b.orders_calibration)
    spend = models.spend_frame(b.orders_calibration)
    return purchases.select(F.lit("purchases").alias("part"), "*").unionByName(
        spend.select(F.lit("spend").alias("part"), "*"), allowMissingColumns=True
    )


# ---- C: domain relations ----------------------------------------------------------------------


@query(
    "c1_analysis_windows",
    "source:s calibration_start:s calibration_end:s holdout_start:s holdout_end:s "
    "duration_holdout:i first_order_date:s last_order_date:s",
    "select * from win",
)
def _(b: Book) -> DataFrame:
    return b.plan_windows


@query(
    "c1_analysis_windows_default_split",
    "source:s calibration_end:s holdout_start:s holdout_end:s duration_holdout:i",
    """select source, min(order_date) + 272 as calibration_end,
         min(order_date) + 273 as holdout_start, min(order_date) + 545 as holdout_end,
         273 as duration_holdout from tx group by 1""",
)
def _(b: Book) -> DataFrame:
    return window_ops.analysis_windows(b.transactions)


@query(
    "c1_closed_cohort",
    f"{KEYS} occasions:i first_day:s",
    """select source, customer_id, count(*) as occasions, min(order_date) as first_day
       from cocc group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    return window_ops.closed_cohort(b.plan_occasions, b.plan_windows).groupBy("source", "customer_id").agg(
        F.count(F.lit(1)).alias("occasions"), F.min("order_date").alias("first_day")
    )


@query(
    "c2_purchase_occasions",
    f"occasion_id:s {KEYS} order_date:s quantity:i gross_amount:f2 line_items:i",
    """select source || '-' || customer_id || '-' || strftime(order_date, '%Y%m%d') as occasion_id,
         * from occ""",
)
def _(b: Book) -> DataFrame:
    return b.plan_occasions


@query(
    "c2_purchase_occasions_from_lines",
    "source:s occasions:i quantity:i gross_amount:f2 line_items:i",
    """select source, count(*) as occasions, sum(quantity) as quantity,
         sum(gross_amount)::double as gross_amount, sum(line_items) as line_items
       from occ group by 1""",
)
def _(b: Book) -> DataFrame:
    return occasion_ops.purchase_occasions(b.transactions).groupBy("source").agg(
        F.count(F.lit(1)).alias("occasions"),
        *[F.sum(c).alias(c) for c in ("quantity", "gross_amount", "line_items")],
    )


# The unrounded mean is compared: four decimals have exact halves that engines round apart.
_RFM = (
    f"{KEYS} occasions:i frequency:i recency:i customer_age:i first_order_date:s "
    "last_order_date:s total_spend:f2 first_occasion_spend:f2 exact_value:f6 monetary_value:f4 "
    "is_gamma_gamma_eligible:b"
)


def _with_exact_value(summary: DataFrame) -> DataFrame:
    return summary.withColumn(
        "exact_value",
        rfm.mean_repeat_spend(
            F.col("total_spend"), F.col("first_occasion_spend"), F.col("frequency")
        ),
    )


@query("c3_rfm_holdout_only", _RFM, "select * from rfm_hold",
       rfm_hold="""select *, case when frequency > 0
           then (total_spend - first_occasion_spend)::double / frequency else 0.0 end
           as exact_value,
           case when frequency > 0 then ((200 * ((total_spend - first_occasion_spend)
             * 100)::hugeint + frequency) // (2 * frequency))::double / 10000 else 0.0 end
           as monetary_value,
           frequency > 0 and total_spend > first_occasion_spend as is_gamma_gamma_eligible
         from (select source, customer_id, count(*) as occasions, count(*) - 1 as frequency,
           max(order_date) - min(order_date) as recency,
           any_value(holdout_end) - min(order_date) as customer_age,
           min(order_date) as first_order_date, max(order_date) as last_order_date,
           sum(gross_amount) as total_spend,
           arg_min(gross_amount, order_date) as first_occasion_spend
         from occ join win using (source)
         where order_date between holdout_start and holdout_end group by 1, 2)""")
def _(b: Book) -> DataFrame:
    return _with_exact_value(
        rfm.rfm_summary(b.occasions, b.windows, "holdout_start", "holdout_end")
    )


@query("c4_rfm_calibration", _RFM, "select * from cal")
def _(b: Book) -> DataFrame:
    return _with_exact_value(rfm.rfm_calibration(b.plan_occasions, b.plan_windows))


@query("c5_rfm_full", _RFM, "select * from full_rfm")
def _(b: Book) -> DataFrame:
    return _with_exact_value(rfm.rfm_full(b.occasions, b.windows))


@query(
    "c6_holdout_actuals",
    f"{KEYS} holdout_frequency:i holdout_spend:f2 holdout_monetary_value:f4 exact_holdout_value:f6 "
    "duration_holdout:i",
    "select * from hold",
)
def _(b: Book) -> DataFrame:
    return rfm.holdout_actuals(b.occasions, b.windows).withColumn(
        "exact_holdout_value",
        F.when(
            F.col("holdout_frequency") > 0,
            F.col("holdout_spend").cast("double") / F.col("holdout_frequency"),
        ).otherwise(F.lit(0.0)),
    )


@query(
    "c7_recent_repeats",
    f"{KEYS} window_days:i recent_repeats:i recent_exposure_days:i",
    f"select * from recent where window_days = {RECENT_DAYS}",
)
def _(b: Book) -> DataFrame:
    return rfm.recent_repeats(b.occasions, b.windows, RECENT_DAYS)


@query(
    "c7_customer_windows",
    f"{KEYS} calibration_occasions:i calibration_spend:f2 full_occasions:i full_spend:f2 "
    "holdout_occasions:i holdout_total:f2 repeats_91:i",
    f"""select f.source, f.customer_id, coalesce(c.occasions, 0) as calibration_occasions,
          c.total_spend as calibration_spend, f.occasions as full_occasions,
          f.total_spend as full_spend, f.occasions - coalesce(c.occasions, 0) as holdout_occasions,
          case when f.occasions > coalesce(c.occasions, 0)
            then f.total_spend - coalesce(c.total_spend, 0) end as holdout_total,
          recent_repeats as repeats_91
        from full_rfm f left join cal c using (source, customer_id)
        left join recent r on r.source = f.source and r.customer_id = f.customer_id
          and r.window_days = {RECENT_DAYS}""",
)
def _(b: Book) -> DataFrame:
    wide = rfm.customer_windows(b.occasions, b.windows, [RECENT_DAYS])
    repeats = rfm.counts_of(wide, [RECENT_DAYS]).select("source", "customer_id", "repeats_91")
    return wide.join(repeats, ["source", "customer_id"], "left")


@query(
    "c8_recent_window_sensitivity",
    "source:s window_days:i customers:i predicted_purchases:f6 actual_purchases:i percent_error:f6",
    "select * from sens",
)
def _(b: Book) -> DataFrame:
    return sensitivity_ops.recent_window_sensitivity(b.occasions, b.windows, RECENT_DAYS)


@query(
    "c9_monthly_retention",
    "source:s cohort_month:s months_since_first:i activity_month:s cohort_size:i "
    "active_customers:i exact_rate:f6",
    """select g.source, g.cohort_month, g.activity_month, g.cohort_size,
         date_diff('month', g.cohort_month, g.activity_month) as months_since_first,
         coalesce(n, 0) as active_customers, coalesce(n, 0)::double / g.cohort_size as exact_rate
       from (select s.*, c.activity_month
         from (select source, cohort_month, count(*) as cohort_size from first_month group by 1, 2) s
         join (select distinct source, date_trunc('month', order_date)::date as activity_month
           from occ) c using (source) where c.activity_month >= s.cohort_month) g
       left join (select o.source, cohort_month,
           date_trunc('month', order_date)::date as activity_month,
           count(distinct customer_id) as n
         from occ o join first_month using (source, customer_id) group by 1, 2, 3) a
       using (source, cohort_month, activity_month)""",
    first_month="""select source, customer_id,
        date_trunc('month', min(order_date))::date as cohort_month from occ group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    return cohorts.monthly_retention(b.occasions).withColumn(
        "exact_rate", F.col("active_customers").cast("double") / F.col("cohort_size")
    )


_SCORED = (
    f"{KEYS} frequency:i recency:i customer_age:i monetary_value:f4 is_gamma_gamma_eligible:b "
    "duration_holdout:i holdout_frequency:i holdout_spend:f2 holdout_monetary_value:f4 "
    "horizon_days:i expected_purchases:f6 probability_alive:f6 expected_avg_value:f4 "
    "expected_forward_revenue:f1 spend_estimate_source:s baseline_purchases:f6 "
    "baseline_purchases_flat:f6 baseline_avg_value:f6 baseline_revenue:f4 "
    "baseline_revenue_flat:f4 baseline_carry_forward:f6 baseline_revenue_carry_forward:f4 "
    "baseline_recent:f6 baseline_revenue_recent:f4 baseline_zero:f6 recent_window_days:i"
)


@query("c10_scored", _SCORED, "select * from scored")
def _(b: Book) -> DataFrame:
    return scored_ops.scored(b.cohort, b.windows, b.predictions, RECENT_DAYS)


@query(
    "c11_population_constants",
    "source:s repeat_rate_per_day:f9 mean_repeat_order_value:f4",
    "select * from pop",
)
def _(b: Book) -> DataFrame:
    return scored_ops.population_constants(b.calibration)


@query(
    "c12_naive_rules",
    f"{KEYS} baseline_purchases:f6 baseline_purchases_flat:f6 baseline_avg_value:f6 "
    "baseline_revenue:f4 baseline_revenue_flat:f4 baseline_carry_forward:f6 "
    "baseline_revenue_carry_forward:f4 baseline_recent:f6 baseline_revenue_recent:f4 "
    "baseline_zero:f6",
    "select * from base",
)
def _(b: Book) -> DataFrame:
    return scored_ops.baselines(b.cohort, b.windows, RECENT_DAYS)


@query("c10_scored_open", _SCORED, "select * from open_scored")
def _(b: Book) -> DataFrame:
    return b.open_scored


@query(
    "c11_population_constants_open",
    "source:s repeat_rate_per_day:f9 mean_repeat_order_value:f4",
    "select * from open_pop",
)
def _(b: Book) -> DataFrame:
    return scored_ops.population_constants(b.open_calibration)


@query(
    "c12_naive_rules_open",
    f"{KEYS} baseline_purchases:f6 baseline_purchases_flat:f6 baseline_avg_value:f6 "
    "baseline_revenue:f4 baseline_revenue_flat:f4 baseline_carry_forward:f6 "
    "baseline_revenue_carry_forward:f4 baseline_recent:f6 baseline_revenue_recent:f4 "
    "baseline_zero:f6",
    "select * from open_base",
)
def _(b: Book) -> DataFrame:
    return scored_ops.baselines(b.occasions, b.windows, RECENT_DAYS)


@query(
    "c19_repeat_series",
    "source:s month:s occasions:i in_calibration:b",
    """select source, date_trunc('month', order_date)::date as month, count(*) as occasions,
         bool_or(order_date <= calibration_end) as in_calibration
       from (select o.*, calibration_end, row_number() over (
           partition by o.source, o.customer_id order by order_date) as nth
         from occ o join win using (source))
       where nth > 1 group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    return cohorts.repeat_series(b.occasions, b.windows)


# ---- E, F, G: aggregates, ranks and order -----------------------------------------------------


@query(
    "e7_exact_quantiles",
    "source:s median:f2 p5:f2 p95:f2",
    """select source, quantile_cont(gross_amount::double, 0.5) as median,
         quantile_cont(gross_amount::double, 0.05) as p5,
         quantile_cont(gross_amount::double, 0.95) as p95 from occ group by 1""",
)
def _(b: Book) -> DataFrame:
    amounts = b.occasions.select("source", F.col("gross_amount").cast("double").alias("amount"))
    return ranking.exact_quantiles(
        amounts, "amount", {"median": 0.5, "p5": 0.05, "p95": 0.95}, ["source"]
    )


@query(
    "e10_duplicate_excess",
    "source:s excess_rows:i",
    """select source, sum(copies - 1) as excess_rows from (
         select source, count(*) as copies from tx
         group by source, customer_id, order_date, quantity, gross_amount) group by 1""",
)
def _(b: Book) -> DataFrame:
    return transaction_ops.duplicate_excess(b.transactions)


@query(
    "f2_customer_rank",
    f"{KEYS} customer_rank:i",
    """select source, customer_id,
         row_number() over (partition by source order by customer_id) as customer_rank from cal""",
)
def _(b: Book) -> DataFrame:
    return ranking.customer_rank(rfm.rfm_calibration(b.occasions, b.windows))


@query(
    "f3_dense_customer_rank",
    f"{KEYS} horizon_days:i customer_rank:i",
    """select source, customer_id, horizon_days,
         dense_rank() over (partition by source order by customer_id) as customer_rank from pred""",
)
def _(b: Book) -> DataFrame:
    return ranking.dense_customer_rank(
        b.predictions.select("source", "customer_id", "horizon_days")
    )


@query(
    "f4_average_ranks",
    "source:s line_items:i n:i rank:f1",
    """select source, line_items, count(*) as n, any_value(r) as rank
       from (select *, rank() over (partition by source order by line_items)
           + (count(*) over (partition by source, line_items) - 1) / 2.0 as r from occ)
       group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    counts = b.occasions.groupBy("source", "line_items").agg(F.count(F.lit(1)).alias("n"))
    return ranking.average_ranks(counts, "line_items", ["source"])


@query(
    "f5_deciles_by_position",
    f"{KEYS} decile:i",
    """select source, customer_id, (row_number() over (
           partition by source order by gross_total desc, customer_id) - 1) * 10
         // count(*) over (partition by source) + 1 as decile
       from (select source, customer_id, sum(gross_amount) as gross_total from occ group by 1, 2)""",
)
def _(b: Book) -> DataFrame:
    totals = b.occasions.groupBy("source", "customer_id").agg(
        F.sum("gross_amount").alias("gross_total")
    )
    return rank.assign_deciles(totals, "gross_total", by=["source"])


@query(
    "g4_global_positions",
    "occasion_id:s position:i",
    """select source || '-' || customer_id || '-' || strftime(order_date, '%Y%m%d') as occasion_id,
         row_number() over (order by gross_amount desc, source, customer_id, order_date) - 1
         as position from occ""",
)
def _(b: Book) -> DataFrame:
    return ranking.global_positions(
        b.occasions,
        [F.col("gross_amount").desc(), F.col("source"), F.col("customer_id"), F.col("order_date")],
    )


# ---- J: models --------------------------------------------------------------------------------


@query(
    "j1_assumption_counts",
    "customers:i age_below_recency:i negative_frequency:i no_age:i inconsistent_spend:i "
    "inconsistent_eligibility:i eligible:i",
    """select count(*) as customers, count(*) filter (customer_age < recency) as age_below_recency,
         count(*) filter (frequency < 0) as negative_frequency,
         count(*) filter (customer_age <= 0) as no_age, 0 as inconsistent_spend,
         0 as inconsistent_eligibility, count(*) filter (is_gamma_gamma_eligible) as eligible
       from cal""",
)
def _(b: Book) -> DataFrame:
    # The open population: customers acquired on the last day are what the age check exists for.
    return models.assumption_counts(rfm.rfm_calibration(b.occasions, b.windows))


_PARAMETERS = "source:s family:s parameter:s value:f3 customers:i"


def _parameter_frame(b: Book, *families: str) -> DataFrame:
    rows = [
        (retail.ORDERS, family, name, value, b.fitted(family).customers)
        for family in families
        for name, value in b.fitted(family).parameters.items()
    ]
    return b.spark.createDataFrame(
        rows, "source string, family string, parameter string, value double, customers long"
    )


@query("j2_fit_bg_nbd", _PARAMETERS)
def _(b: Book) -> DataFrame:
    return _parameter_frame(b, models.BG_NBD)


@query("j3_fit_gamma_gamma", _PARAMETERS)
def _(b: Book) -> DataFrame:
    return _parameter_frame(b, models.GAMMA_GAMMA)


@query("j4_fit_mbg_nbd", _PARAMETERS)
def _(b: Book) -> DataFrame:
    return _parameter_frame(b, models.MBG_NBD)


@query("j5_fit_pareto_nbd", _PARAMETERS)
def _(b: Book) -> DataFrame:
    return _parameter_frame(b, models.PARETO_NBD)


def _outcomes(b: Book) -> tuple[models.ChallengerOutcome, ...]:
    return tuple(
        models.attempt(f, lambda f=f: b.fitted(f)) for f in models.CHALLENGERS
    )


@query("j6_challenger_status", "family:s status:s detail:s")
def _(b: Book) -> DataFrame:
    return challenger_status(b.new_store(), _outcomes(b))


def _checked(rows: DataFrame, family: str) -> models.Fit:
    models.check_assumptions(rows)
    return models.fit_purchase_model(rows, family)


@query(
    "j6_planted_failures",
    "source:s family:s status:s detail:s",
    """select source, unnest(['mbg_nbd', 'pareto_nbd']) as family, 'did not fit' as status,
         'ModelError: calibration rows refused: ' || case source
           when 'orders' then 'last purchase after the observation ends (' || late || ')'
           else 'repeat count below zero (' || negative || '); mean value times repeats is not '
             || 'the repeat spend (' || apart || '); in the spend model without repeat spend ('
             || eligible || ')' end as detail
       from (select source, count(*) filter (customer_id % 7 = 0) as late,
           count(*) filter (customer_id % 5 = 0) as negative,
           count(*) filter (customer_id % 5 = 0 and (is_gamma_gamma_eligible)) as eligible,
           count(*) filter (customer_id % 5 = 0 and abs(-monetary_value
             - (total_spend - first_occasion_spend)::double) > 0.01) as apart
         from ccal group by 1)""",
)
def _(b: Book) -> DataFrame:
    # Each source's customers with a defect no model can be fitted through.
    late = F.when(F.col("customer_id") % 7 == 0, F.col("customer_age") + 1)
    negative = F.when(F.col("customer_id") % 5 == 0, F.lit(-1))
    parts = []
    for source, column, change in (
        (retail.ORDERS, "recency", late), (retail.EVENTS, "frequency", negative),
    ):
        rows = b.calibration.where(F.col("source") == source)
        kept = b.calibration.schema[column].dataType
        planted = rows.withColumn(column, F.coalesce(change, F.col(column)).cast(kept))
        outcomes = tuple(
            models.attempt(f, lambda f=f, planted=planted: _checked(planted, f)) for f in models.CHALLENGERS
        )
        status = challenger_status(b.new_store(), outcomes)
        parts.append(status.withColumn("source", F.lit(source)))
    return parts[0].unionByName(parts[1])


@query("j2_log_likelihood_literal", "source:s log_likelihood:f4",
       f"""select source, sum(lgamma({BG['r']} + frequency) - lgamma({BG['r']}::double)
             + {BG['r']} * ln({BG['alpha']}) + lgamma({BG['b']} + frequency)
             - lgamma({BG['b']}::double) - lgamma({BG['a']} + {BG['b']} + frequency)
             + lgamma({BG['a']}::double + {BG['b']})
             + ln(exp(-({BG['r']} + frequency) * ln({BG['alpha']} + customer_age))
               + case when frequency > 0 then {BG['a']} / ({BG['b']} + frequency - 1)
                   * exp(-({BG['r']} + frequency) * ln({BG['alpha']} + recency)) else 0 end))
             as log_likelihood
           from ccal where source = 'orders' group by 1""")
def _(b: Book) -> DataFrame:
    import numpy as np

    states = b.orders_states
    value = models.log_likelihoods(
        states, models.BG_NBD, np.array([list(BG.values())]), models.count_histogram(states)
    )[0]
    return b.spark.createDataFrame(
        [(retail.ORDERS, float(value))], "source string, log_likelihood double"
    )


_MBG = {"r": 0.589, "alpha": 47.954, "a": 0.835, "b": 1.354}


@query("j4_log_likelihood_literal", "source:s log_likelihood:f3",
       f"""select source, sum(lgamma({_MBG['r']} + frequency) - lgamma({_MBG['r']}::double)
             + {_MBG['r']} * ln({_MBG['alpha']}) + lgamma({_MBG['b']} + frequency + 1)
             - lgamma({_MBG['b']}::double) - lgamma({_MBG['a']} + {_MBG['b']} + frequency + 1)
             + lgamma({_MBG['a']}::double + {_MBG['b']})
             + ln(exp(-({_MBG['r']} + frequency) * ln({_MBG['alpha']} + customer_age))
               + {_MBG['a']} / ({_MBG['b']} + frequency)
                 * exp(-({_MBG['r']} + frequency) * ln({_MBG['alpha']} + recency))))
             as log_likelihood
           from ccal group by 1""")
def _(b: Book) -> DataFrame:
    import numpy as np

    point = np.array([list(_MBG.values())])
    rows = []
    for source in SOURCES:
        states = b.states_of(source)
        value = models.log_likelihoods(states, models.MBG_NBD, point, models.count_histogram(states))[0]
        rows.append((source, float(value)))
    return b.spark.createDataFrame(rows, "source string, log_likelihood double")


@query(
    "j2_model_states",
    "frequency:i recency:i T:i n:i",
    """select frequency, recency, customer_age as "T", count(*) as n from ccal group by 1, 2, 3""",
)
def _(b: Book) -> DataFrame:
    return models.model_states(b.calibration)


@query(
    "j8_probability_alive",
    f"{KEYS} probability_alive:f9",
    "select source, customer_id, alive as probability_alive from state",
)
def _(b: Book) -> DataFrame:
    return b.calibration.select(
        "source", "customer_id", alive_column(LITERAL_PURCHASE).alias("probability_alive")
    )


@query(
    "j9_conditional_spend",
    f"{KEYS} expected_avg_value:f4",
    "select source, customer_id, value as expected_avg_value from state",
)
def _(b: Book) -> DataFrame:
    return b.calibration.select(
        "source", "customer_id", spend_column(LITERAL_SPEND).alias("expected_avg_value")
    )


@query(
    "j11_predict",
    f"{KEYS} horizon_days:i expected_purchases:f6 probability_alive:f6 expected_avg_value:f4 "
    "expected_forward_revenue:f1 spend_estimate_source:s is_gamma_gamma_eligible:b",
    "select * from pred",
)
def _(b: Book) -> DataFrame:
    lengths = b.windows.select(
        "source", F.array("duration_holdout", F.lit(FORWARD_DAYS)).alias("_horizons")
    )
    from returnwise.models.predict import predict

    return predict(
        b.calibration.join(F.broadcast(lengths), "source"),
        LITERAL_PURCHASE,
        LITERAL_SPEND,
        F.col("_horizons"),
    )


@query("j11_predict_fitted", f"{KEYS} horizon_days:i expected_purchases:f4 "
       "expected_forward_revenue:f0 fit_method:s")
def _(b: Book) -> DataFrame:
    from returnwise.models.predict import predict

    return predict(
        b.orders_calibration, b.fitted(models.BG_NBD), b.fitted(models.GAMMA_GAMMA), [365, 1204]
    )


@query(
    "j12_horizons",
    "source:s horizons:s",
    f"""select source, array_to_string(list_sort(list_distinct(
          [duration_holdout, {FORWARD_DAYS}])), ',') as horizons from win""",
)
def _(b: Book) -> DataFrame:
    return resolve_horizons(b.windows, FORWARD_DAYS).select(
        "source", F.concat_ws(",", F.col("horizons").cast("array<string>")).alias("horizons")
    )


@query(
    "j13_unconditional_expectation",
    "expected:f4",
    "select fitted as expected from new_fit where source = 'orders'",
)
def _(b: Book) -> DataFrame:
    return expected_over_states(b.orders_states, LITERAL_PURCHASE, [], new_customer=True)


@query(
    "j15_hdi_of_customer_amounts",
    f"{KEYS} n:i low:f2 high:f2",
    """select source, customer_id, n, v[start] as low, v[start + steps] as high
       from (select *, list_sort(list_transform(range(1, n - steps + 1),
             lambda i: {'width': v[i + steps] - v[i], 'start': i}))[1]['start'] as start
         from (select source, customer_id, count(*) as n,
             list_sort(list(gross_amount)) as v,
             floor(count(*) * 0.94::double)::integer as steps from occ group by 1, 2))""",
)
def _(b: Book) -> DataFrame:
    # A customer has at most one amount per day, so the arrays are bounded by the calendar.
    amounts = b.occasions.groupBy("source", "customer_id").agg(
        F.collect_list("gross_amount").alias("amounts")
    )
    low, high = draws.hdi(F.col("amounts"))
    return amounts.select(
        "source", "customer_id", F.size("amounts").alias("n"), low.alias("low"), high.alias("high")
    )


@query("j16_posterior_draws", "family:s parameter:s draws:i mean:f3")
def _(b: Book) -> DataFrame:
    rows = [row for d in b.posterior for row in d.rows(retail.ORDERS)]
    table = b.spark.createDataFrame(
        rows, "source string, draw_id int, family string, parameter string, value double"
    )
    return table.groupBy("family", "parameter").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("value").alias("mean")
    )


def _bayes(b: Book) -> DataFrame:
    memo = b.__dict__
    if "_bayes_rows" not in memo:
        memo["_bayes_rows"] = materialise(
            draws.predict_draws(b.orders_calibration, *b.posterior, [1204])
        )
    return memo["_bayes_rows"]


@query("j15_predict_with_intervals", f"{KEYS} horizon_days:i expected_purchases:f3 "
       "forward_revenue_hdi_low:f0 forward_revenue_hdi_high:f0 fit_method:s")
def _(b: Book) -> DataFrame:
    return _bayes(b)


@query(
    "j16_forecasts_from_draws",
    f"{KEYS} horizon_days:i expected_purchases:f5 probability_alive:f8 expected_avg_value:f4 "
    "expected_forward_revenue:f1 forward_revenue_hdi_low:f1 forward_revenue_hdi_high:f1",
    """select source, customer_id, horizon_days, avg(purchases) as expected_purchases,
         avg(alive) as probability_alive, avg(value) as expected_avg_value,
         avg(revenue) as expected_forward_revenue, min(revenue) as forward_revenue_hdi_low,
         max(revenue) as forward_revenue_hdi_high
       from drawn_forecasts group by 1, 2, 3""",
)
def _(b: Book) -> DataFrame:
    # Three given draws: an interval of 94 % steps over two of them, from the least to the largest.
    parts = []
    for source in SOURCES:
        days = b.windows.where(F.col("source") == source).first()["duration_holdout"]
        rows = b.calibration.where(F.col("source") == source)
        parts.append(draws.predict_draws(rows, GIVEN_PURCHASE, GIVEN_SPEND, [days]))
    return parts[0].unionByName(parts[1])


_CAL_PRINT = (
    "source:s calibration_rows:i sum_frequency:i sum_recency:i sum_customer_age:i "
    "sum_monetary_value:f4 weighted_frequency:w weighted_recency:w weighted_customer_age:w "
    "weighted_monetary_value_e4:w"
)
_CAL_PRINT_SQL = """select source, count(*) as calibration_rows, sum(frequency) as sum_frequency,
    sum(recency) as sum_recency, sum(customer_age) as sum_customer_age,
    sum(monetary_value::decimal(18, 4))::double as sum_monetary_value,
    sum(k * frequency) as weighted_frequency, sum(k * recency) as weighted_recency,
    sum(k * customer_age) as weighted_customer_age,
    sum(k * (monetary_value * 10000)::decimal(18, 0)) as weighted_monetary_value_e4
  from (select *, row_number() over (partition by source order by customer_id) as k from ccal)
  group by 1"""


@query("j17_calibration_fingerprint", _CAL_PRINT, _CAL_PRINT_SQL)
def _(b: Book) -> DataFrame:
    return fingerprints.calibration_fingerprint(b.calibration)


@query(
    "j18_prediction_fingerprint",
    "source:s "
    + " ".join(
        f"{w}_{c}:f4" for c in fingerprints.PINNED for w in ("sum", "weighted", "horizon_weighted")
    ),
    "select source, "
    + ", ".join(
        f"sum({weight} * {c}) / 1e6 as {w}_{c}"
        for c in fingerprints.PINNED
        for w, weight in (("sum", "1"), ("weighted", "k"), ("horizon_weighted", "horizon_days"))
    )
    + """ from (select *, dense_rank() over (partition by source order by customer_id) as k
          from pred) group by 1""",
)
def _(b: Book) -> DataFrame:
    table = fingerprints.prediction_fingerprint(b.predictions)
    # In millions: the weighted sums are large and their last digits depend on the order of adding.
    return table.select(
        "source", *[(F.col(c) / 1e6).alias(c) for c in table.columns if c != "source"]
    )


@query(
    "j19_fit_counts",
    "source:s customers:i spend_customers:i excluded_customers:i rows_written:i",
    """select source, count(*) as customers,
         count(*) filter (is_gamma_gamma_eligible) as spend_customers,
         count(*) filter (not is_gamma_gamma_eligible) as excluded_customers,
         2 * count(*) as rows_written from ccal group by 1""",
)
def _(b: Book) -> DataFrame:
    counts = b.calibration.groupBy("source").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if("is_gamma_gamma_eligible").alias("spend_customers"),
        F.count_if(~F.col("is_gamma_gamma_eligible")).alias("excluded_customers"),
    )
    written = b.predictions.groupBy("source").agg(F.count(F.lit(1)).alias("rows_written"))
    return counts.join(F.broadcast(written), "source")


# ---- K: scores and diagnostics ----------------------------------------------------------------


@query(
    "k1_error_metrics",
    "source:s population:i mae:f6 rmse:f6 actual_total:f2 predicted_total:f4 error:f4 "
    "percent_error:f6 mape:f6 mape_included:i mape_excluded:i mape_excluded_share:f6",
    """select source, count(*) as population, avg(abs(baseline_purchases - holdout_frequency)) as mae,
         sqrt(avg(power(baseline_purchases - holdout_frequency, 2))) as rmse,
         sum(holdout_frequency) as actual_total, sum(baseline_purchases) as predicted_total,
         sum(baseline_purchases) - sum(holdout_frequency) as error,
         100 * (sum(baseline_purchases) - sum(holdout_frequency)) / sum(holdout_frequency)
           as percent_error,
         100 * avg(abs((baseline_purchases - holdout_frequency) / holdout_frequency))
           filter (holdout_frequency <> 0) as mape,
         count(*) filter (holdout_frequency <> 0) as mape_included,
         count(*) filter (holdout_frequency = 0) as mape_excluded,
         count(*) filter (holdout_frequency = 0)::double / count(*) as mape_excluded_share
       from base group by 1""",
)
def _(b: Book) -> DataFrame:
    rows = scored_ops.baselines(b.cohort, b.windows, RECENT_DAYS)
    return errors.error_metrics(rows, "holdout_frequency", "baseline_purchases", ["source"])


@query(
    "k6_spearman",
    "source:s rho:f6 n:i",
    f"""select source, corr(rx, ry) as rho, count(*) as n
        from (select source, {_ranked('frequency', 'source')} as rx,
            {_ranked('holdout_frequency', 'source')} as ry
          from ccal join chold using (source, customer_id)) group by 1""",
)
def _(b: Book) -> DataFrame:
    rows = scored_ops.baselines(b.cohort, b.windows, RECENT_DAYS)
    return rank.spearman(rows, "frequency", "holdout_frequency", ["source"])


@query(
    "k6_spearman_p_value",
    "source:s rho:f6 p_value:f9 n:i",
    # Student's t by Simpson's rule from zero to the statistic.
    f"""select source, rho, n, greatest(0.0, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0))
           / sqrt((n - 2) * pi()) * t / 60000 * list_sum(list_transform(range(0, 20001),
             lambda i: (case when i = 0 or i = 20000 then 1 when i % 2 = 1 then 4 else 2 end)
               * pow(1 + pow(i * t / 20000, 2) / (n - 2), -(n - 1) / 2.0)))) as p_value
         from (select *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) as t
           from (select source, corr(rx, ry) as rho, count(*)::double as n
             from (select source, {_ranked('baseline_revenue', 'source')} as rx,
                 {_ranked('holdout_spend', 'source')} as ry from scored) group by 1))""",
)
def _(b: Book) -> DataFrame:
    return rank.spearman(b.scored, "baseline_revenue", "holdout_spend", ["source"])


@query(
    "k7_decile_table",
    "source:s decile:i customers:i mean_predicted:f2 mean_actual:f2 total_actual:f2 "
    "share_of_actual:f6",
    "select * from decile_rows",
)
def _(b: Book) -> DataFrame:
    return rank.decile_table(b.scored, "holdout_spend", "expected_forward_revenue", by=["source"])


@query(
    "k8_score_all",
    "source:s quantity:s family:s population:i mae:f4 rmse:f4 actual_total:f2 predicted_total:f2 "
    "percent_error:f6 spearman_rho:f6 mape:f6 mape_included:i mape_excluded:i",
    "select * from scores",
)
def _(b: Book) -> DataFrame:
    return scoring.score_all(b.scored)


@query(
    "k8_score_one",
    "source:s quantity:s family:s mae:f6 rmse:f6 percent_error:f6 spearman_rho:f6",
    "select * from scores where quantity = 'purchases' and family = 'baseline_recent'",
)
def _(b: Book) -> DataFrame:
    return scoring.score(b.scored, "purchases", "baseline_recent")


@query(
    "k9_metrics_frame",
    "source:s model_family:s quantity:s metric:s value:f2 population:i",
    "select * from long_metrics where not (metric like 'mape%' and quantity = 'purchases')",
)
def _(b: Book) -> DataFrame:
    return scoring.metrics_frame(scoring.score_all(b.scored))


@query(
    "k10_bucket_table",
    "source:s bucket:s bucket_order:i customers:i actual:f6 actual_total:i bg_nbd:f6 "
    "baseline_rate:f6 shortfall:f4",
    "select * from buckets",
)
def _(b: Book) -> DataFrame:
    return buckets.bucket_table(b.scored)


_BUCKETS = [*(str(i) for i in range(7)), "7+"]
_MISSES = """select source, model, """ + ", ".join(
    f"""sum(miss) filter (bucket = '{label}') as "bucket_{label}\"""" for label in _BUCKETS
) + """, sum(miss) as net, sum(abs(miss)) as absolute
  from (select source, bucket, unnest(['bg_nbd', 'baseline_rate']) as model,
      unnest([bg_nbd - actual, baseline_rate - actual]) * customers as miss from buckets)
  group by 1, 2"""


@query(
    "k11_bucket_misses",
    "source:s model:s " + " ".join(f"bucket_{label}:f4" for label in _BUCKETS)
    + " net:f4 absolute:f4",
    _MISSES,
)
def _(b: Book) -> DataFrame:
    return buckets.bucket_misses(buckets.bucket_table(b.scored), ("bg_nbd", "baseline_rate"))


@query("k11_bucket_misses_challengers", "source:s model:s net:f2 absolute:f2")
def _(b: Book) -> DataFrame:
    frame, names = with_challengers(
        b.scored.where(F.col("source") == retail.ORDERS), _outcomes(b)
    )
    return buckets.bucket_misses(buckets.bucket_table(frame, names), ("bg_nbd", *names))


@query(
    "k12_independence",
    "source:s rho:f6 n:i lowest_bucket_value:f2 highest_bucket_value:f2 spread:f6",
    f"""select r.*, lowest_bucket_value, highest_bucket_value,
          highest_bucket_value / lowest_bucket_value - 1 as spread
        from (select source, corr(rx, ry) as rho, count(*) as n from (
            select source, {_ranked('frequency', 'source')} as rx,
              {_ranked('monetary_value', 'source')} as ry from ccal where is_gamma_gamma_eligible)
          group by 1) r
        join (select source, arg_min(v, o) as lowest_bucket_value,
            arg_max(v, o) as highest_bucket_value
          from (select source, least(frequency, 7) as o, avg(monetary_value) as v
            from ccal where is_gamma_gamma_eligible group by 1, 2) group by 1) using (source)""",
)
def _(b: Book) -> DataFrame:
    return buckets.independence_check(b.scored)


@query(
    "k12_order_value_by_bucket",
    "source:s bucket:s customers:i mean_order_value:f2",
    """select source, case when frequency <= 6 then frequency::varchar else '7+' end as bucket,
         count(*) as customers, avg(monetary_value) as mean_order_value
       from ccal where is_gamma_gamma_eligible group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    return buckets.order_value_by_bucket(b.scored)


@query(
    "k13_alive_by_construction",
    "source:s customers:i returned_share:f6",
    """select source, count(*) filter (probability_alive >= 1) as customers,
         avg((holdout_frequency > 0)::integer) filter (probability_alive >= 1) as returned_share
       from scored group by 1""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.alive_by_construction(b.scored)


@query(
    "k14_interval_summary",
    "source:s customers:i median_relative_width:f6 p5_relative_width:f6 p95_relative_width:f6 "
    "coverage:f6",
    """select source, count(*) as customers,
         quantile_cont(width, 0.5) filter (estimate > 0) as median_relative_width,
         quantile_cont(width, 0.05) filter (estimate > 0) as p5_relative_width,
         quantile_cont(width, 0.95) filter (estimate > 0) as p95_relative_width,
         avg((holdout_spend::double between low and high)::integer) as coverage
       from (select *, (high - low) / case when estimate > 0 then estimate end as width
         from (select source, holdout_spend, baseline_revenue as estimate,
             least(baseline_revenue, baseline_revenue_recent) as low,
             greatest(baseline_revenue, baseline_revenue_recent) as high from base))
       group by 1""",
)
def _(b: Book) -> DataFrame:
    # Intervals spanned by two naive rules, so that the summary is checkable without a sampler.
    rows = scored_ops.baselines(b.cohort, b.windows, RECENT_DAYS).select(
        "source",
        "holdout_spend",
        F.col("baseline_revenue").alias("expected_forward_revenue"),
        F.least("baseline_revenue", "baseline_revenue_recent").alias("forward_revenue_hdi_low"),
        F.greatest("baseline_revenue", "baseline_revenue_recent").alias("forward_revenue_hdi_high"),
    )
    return diagnostics.interval_summary(rows)


@query("k14_interval_summary_fitted", "source:s customers:i median_relative_width:f4 coverage:f4")
def _(b: Book) -> DataFrame:
    rows = b.scored.where(F.col("source") == retail.ORDERS).select(
        "source", "customer_id", "holdout_spend"
    )
    return diagnostics.interval_summary(
        rows.join(_bayes(b).drop("source"), "customer_id")
    )


@query(
    "k15_monthly_actuals",
    "source:s month:s days:i actual:i",
    "select * from months",
)
def _(b: Book) -> DataFrame:
    return diagnostics.monthly_actuals(b.cohort, b.windows)


def _monthly(b: Book, fit) -> DataFrame:
    parts = []
    for source in SOURCES:
        one = F.col("source") == source
        parts.append(
            diagnostics.monthly_holdout(
                b.cohort.where(one), b.windows.where(one), b.states_of(source), fit, source
            )
        )
    return materialise(parts[0].unionByName(parts[1]))


@query(
    "k15_monthly_holdout",
    "source:s month:s days:i actual:i expected:f3 shortfall:f3",
    """select source, month, days, actual, expected, expected - actual as shortfall
       from drawn_months where draw_id = 0""",
)
def _(b: Book) -> DataFrame:
    monthly = _monthly(b, LITERAL_PURCHASE)
    for source in SOURCES:
        one = F.col("source") == source
        diagnostics.require_reconciled(monthly.where(one), b.scored.where(one))
    return monthly


@query(
    "k15_monthly_over_draws",
    "source:s month:s days:i actual:i expected:f3 shortfall:f3 expected_low:f3 expected_high:f3",
    """select source, month, days, actual, avg(expected) as expected,
         avg(expected) - actual as shortfall, min(expected) as expected_low,
         max(expected) as expected_high
       from drawn_months group by 1, 2, 3, 4""",
)
def _(b: Book) -> DataFrame:
    return _monthly(b, GIVEN_PURCHASE)


@query(
    "k16_monthly_trend",
    "source:s expected_change:f4 actual_change:f6 worst_months:s worst_share:f4",
    """select source, last_expected / first_expected - 1 as expected_change,
         last_actual / first_actual - 1 as actual_change, worst_months,
         worst / shortfall as worst_share
       from (select source, arg_min(expected / days, month) as first_expected,
           arg_max(expected / days, month) as last_expected,
           arg_min(actual / days::double, month) as first_actual,
           arg_max(actual / days::double, month) as last_actual, sum(expected - actual) as shortfall
         from drawn_months where draw_id = 0 group by 1)
       join (select source, sum(expected - actual) as worst,
           string_agg(month::varchar, ',' order by month) as worst_months
         from (select *, row_number() over (
             partition by source order by expected - actual, month) as k
           from drawn_months where draw_id = 0) where k <= 3 group by 1) using (source)""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.monthly_trend(_monthly(b, LITERAL_PURCHASE))


@query(
    "g3_worst_months",
    "source:s actual_change:f6 shortfall:f4 worst_months:s worst_share:f6",
    """select source, last_rate / first_rate - 1 as actual_change, shortfall,
         worst_months, worst / shortfall as worst_share
       from (select source, arg_min(actual / days::double, month) as first_rate,
           arg_max(actual / days::double, month) as last_rate, sum(-actual) as shortfall
         from months group by 1)
       join (select source, sum(-actual) as worst,
           string_agg(month::varchar, ',' order by month) as worst_months
         from (select *, row_number() over (partition by source order by -actual, month) as k
           from months) where k <= 3 group by 1) using (source)""",
)
def _(b: Book) -> DataFrame:
    # Against a forecast of nothing, so the ranking of months is checkable in SQL.
    monthly = diagnostics.monthly_actuals(b.cohort, b.windows).select(
        "source", "month", "days", "actual",
        F.lit(0.0).alias("expected"), (-F.col("actual")).alias("shortfall"),
    )
    return diagnostics.monthly_trend(monthly).withColumn("shortfall", F.col("shortfall"))


@query(
    "k17_lowest_decile",
    "source:s customers:i repeat_buyers:i repeat_mean_probability_alive:f6 repeat_mean_actual:f2 "
    "one_time_mean_actual:f2",
    """select source, count(*) as customers, count(*) filter (frequency > 0) as repeat_buyers,
         avg(probability_alive) filter (frequency > 0) as repeat_mean_probability_alive,
         avg(holdout_spend::double) filter (frequency > 0) as repeat_mean_actual,
         avg(holdout_spend::double) filter (frequency = 0) as one_time_mean_actual
       from deciles where decile = 10 group by 1""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.lowest_decile(b.scored)


@query(
    "k18_given_parameter_comparison",
    "source:s parameter:s fitted_days:f6 fitted_weeks:f6 published:f3",
    """select source, parameter, avg(value) as fitted_days,
         avg(value) / case parameter when 'alpha' then 7 else 1 end as fitted_weeks,
         case parameter when 'r' then 0.243 when 'alpha' then 4.414 when 'a' then 0.793
           else 2.426 end as published
       from (select source from win) cross join (
         select unnest(['r', 'alpha', 'a', 'b']) as parameter, unnest([r, alpha, a, b]) as value
         from given_draws)
       group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    # The posterior means of given draws, as a fit stores them for every source.
    store = b.new_store()
    for row in b.windows.select("source").collect():
        means = models.parameter_rows([GIVEN_PURCHASE.mean()], row["source"])
        stored.write_parameters(store, b.spark.createDataFrame(means, stored.schemas.MODEL_PARAMETERS))
    return diagnostics.parameter_comparison(store.read(stored.PARAMETERS))


@query(
    "j14_posterior_mean_parameters",
    "source:s fit_method:s family:s parameter:s value:f6",
    """select source, 'mcmc' as fit_method, family, parameter, avg(value) as value
       from (select source from win) cross join (
         select unnest(['bg_nbd', 'bg_nbd', 'bg_nbd', 'bg_nbd', 'gamma_gamma', 'gamma_gamma',
             'gamma_gamma']) as family,
           unnest(['r', 'alpha', 'a', 'b', 'p', 'q', 'v']) as parameter,
           unnest([r, alpha, a, b, p, q, v]) as value from given_draws)
       group by 1, 3, 4""",
)
def _(b: Book) -> DataFrame:
    store = b.new_store()
    for row in b.windows.select("source").collect():
        means = models.parameter_rows([GIVEN_PURCHASE.mean(), GIVEN_SPEND.mean()], row["source"])
        stored.write_parameters(store, b.spark.createDataFrame(means, stored.schemas.MODEL_PARAMETERS))
    return store.read(stored.PARAMETERS)


@query(
    "a14_preconditions",
    "stage:s outcome:s rows:i",
    """select 'transform' as stage, 'present' as outcome, count(*) as rows from ccal
       union all
       select 'fit', 'present', count(*) from pred
       union all
       select 'validate', 'scored not found: run the validate stage first', 0""",
)
def _(b: Book) -> DataFrame:
    # A store in which two stages have run and one has not.
    store = b.new_store()
    store.overwrite(stored.CALIBRATION, b.calibration)
    store.overwrite(stored.WINDOWS, b.windows)
    stored.write_predictions(store, b.predictions)
    stored.write_fit_run(store, b.fit_runs)
    stored.require_predictions(store)
    found = []
    for stage, relation in (
        ("transform", stored.CALIBRATION), ("fit", stored.PREDICTIONS), ("validate", stored.SCORED),
    ):
        try:
            store.require(stage, relation)
            found.append((stage, "present", store.read(relation).count()))
        except stored.MissingStage as missing:
            said = str(missing).replace(f" under {store.root}", "").replace("main.", "").rstrip(".")
            found.append((stage, said, 0))
    return b.spark.createDataFrame(found, "stage string, outcome string, rows long")


@query("k18_parameter_comparison", "source:s parameter:s fitted_days:f3 fitted_weeks:f3 "
       "published:f3")
def _(b: Book) -> DataFrame:
    rows = _parameter_frame(b, models.BG_NBD).withColumnRenamed("value", "value")
    return diagnostics.parameter_comparison(rows)


@query(
    "k19_in_sample_and_holdout",
    "part:s actual:f2 expected:f3 percent_error:f6",
    """select part, actual, expected, 100 * (expected - actual) / actual as percent_error
       from (select unnest(['calibration', 'holdout', 'cumulative']) as part,
           unnest([repeats, returned, repeats + returned])::double as actual,
           unnest([fitted, forecast, fitted + forecast]) as expected
         from (select source, sum(frequency) as repeats, sum(holdout_frequency) as returned,
             sum(expected_purchases) as forecast from scored group by 1)
         join new_fit using (source) where source = 'orders')""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.calibration_fit(
        b.scored.where(F.col("source") == retail.ORDERS), b.orders_states, LITERAL_PURCHASE
    )


_HEADLINE = """select source, model_percent_error, model_mae, naive_rules, rules_closer_on_total,
    closest_rule, rules_beaten_on_mae, margin_over_zero_percent, model_rho, best_naive_rho,
    best_naive_rho >= model_rho as naive_ranks_at_least_as_well
  from (
    select source, any_value(m.percent_error) as model_percent_error,
      any_value(m.mae) as model_mae, count(*) as naive_rules,
      count(*) filter (family <> 'baseline_zero' and abs(r.percent_error) < abs(m.percent_error))
        as rules_closer_on_total,
      arg_min(family, abs(r.percent_error)) filter (family <> 'baseline_zero') as closest_rule,
      count(*) filter (m.mae < r.mae) as rules_beaten_on_mae,
      100 * (max(r.mae) filter (family = 'baseline_zero') - any_value(m.mae))
        / max(r.mae) filter (family = 'baseline_zero') as margin_over_zero_percent
    from (select * from scores where quantity = 'purchases' and family <> 'bg_nbd') r
    join (select source, percent_error, mae from scores
      where quantity = 'purchases' and family = 'bg_nbd') m using (source) group by 1)
  join (select source, max(coalesce(spearman_rho, -1)) filter (family = 'bg_nbd') as model_rho,
      max(coalesce(spearman_rho, -1)) filter (family <> 'bg_nbd') as best_naive_rho
    from scores where quantity = 'revenue' group by 1) using (source)"""


@query(
    "k20_headline",
    "source:s model_percent_error:f6 model_mae:f6 naive_rules:i rules_closer_on_total:i "
    "closest_rule:s rules_beaten_on_mae:i margin_over_zero_percent:f6 model_rho:f6 "
    "best_naive_rho:f6 naive_ranks_at_least_as_well:b",
    _HEADLINE,
)
def _(b: Book) -> DataFrame:
    return verdicts.headline(scoring.metrics_frame(scoring.score_all(b.scored)))


@query(
    "k21_sensitivity_verdict",
    "source:s look_backs:i look_backs_winning:i longest_winning:i shortest_losing:i "
    "least_favourable:i verdict:s",
    """select source, count(*) as look_backs, count(*) filter (beats) as look_backs_winning,
         max(window_days) filter (beats) as longest_winning,
         min(window_days) filter (not beats) as shortest_losing,
         (list(window_days order by round(abs(percent_error), 9) desc, window_days))[1]
           as least_favourable,
         case when bool_and(beats) then 'all' when not bool_or(beats) then 'none'
           when max(window_days) filter (beats) < min(window_days) filter (not beats)
             then 'crossover' else 'mixed' end as verdict
       from (select s.*, abs(s.percent_error) < abs(m.percent_error) as beats from csens s
         join (select source, percent_error from scores
           where quantity = 'purchases' and family = 'bg_nbd') m using (source)) group by 1""",
)
def _(b: Book) -> DataFrame:
    totals = errors.error_metrics(
        b.scored, "holdout_frequency", "expected_purchases", ["source"]
    ).select("source", F.col("percent_error").alias("model_percent_error"))
    return verdicts.sensitivity_verdict(b.sensitivity, totals)


@query(
    "k22_population_summary",
    "source:s customers:i non_returners:i mean_customer_age:f6 zero_repeat_customers:i "
    "zero_repeat_expected:f6 zero_repeat_actual:f6 shared_order_value_estimates:i",
    """select source, count(*) as customers, count(*) filter (holdout_frequency = 0) as non_returners,
         avg(customer_age) as mean_customer_age,
         count(*) filter (frequency = 0) as zero_repeat_customers,
         avg(expected_purchases) filter (frequency = 0) as zero_repeat_expected,
         avg(holdout_frequency) filter (frequency = 0) as zero_repeat_actual,
         count(*) filter (frequency = 0 and holdout_frequency > 0) as shared_order_value_estimates
       from scored group by 1""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.population_summary(b.scored)


@query(
    "k23_decile_comparison",
    "source:s decile:i mean_actual:f2 share_of_actual:f6 naive_mean_actual:f2 "
    "naive_share_of_actual:f6 share_gap:f6",
    """select *, share_of_actual - naive_share_of_actual as share_gap
       from decile_rows join naive_rows using (source, decile)""",
)
def _(b: Book) -> DataFrame:
    return diagnostics.decile_comparison(b.scored)


@query(
    "k23_lowest_decile_inverted",
    "source:s lowest_mean_actual:f2 middle_lowest:f2 middle_highest:f2 inverted:b",
    """select source, max(mean_actual) filter (decile = 10) as lowest_mean_actual,
         min(mean_actual) filter (decile between 5 and 9) as middle_lowest,
         max(mean_actual) filter (decile between 5 and 9) as middle_highest,
         max(mean_actual) filter (decile = 10) > min(mean_actual) filter (decile between 5 and 9)
           as inverted from decile_rows group by 1""",
)
def _(b: Book) -> DataFrame:
    table = rank.decile_table(b.scored, "holdout_spend", "expected_forward_revenue", by=["source"])
    return verdicts.lowest_decile_inverted(table)


@query(
    "k24_model_comparison",
    "source:s closest_net:s closest_by_bucket:s buckets_under_predicted:i buckets:i same_model:b",
    f"""select source, arg_min(model, abs(net)) as closest_net,
          arg_min(model, absolute) as closest_by_bucket,
          max(low) filter (model = 'bg_nbd') as buckets_under_predicted,
          max(present) filter (model = 'bg_nbd') as buckets,
          arg_min(model, abs(net)) = arg_min(model, absolute) as same_model
        from misses join (select source, count(*) as present,
            count(*) filter (bg_nbd < actual) as low from buckets group by 1) using (source)
        group by 1""",
    misses=_MISSES,
)
def _(b: Book) -> DataFrame:
    misses = buckets.bucket_misses(buckets.bucket_table(b.scored), ("bg_nbd", "baseline_rate"))
    return buckets.model_comparison(misses)


# ---- L: integrity checks, each run on a relation with a planted defect ------------------------


@query(
    "l1_transactions_within_windows",
    "source:s earliest_order:s latest_order:s calibration_start:s holdout_end:s",
    """select source, min(order_date) as earliest_order, max(order_date) as latest_order,
         min(order_date) as calibration_start, min(order_date) + 545 as holdout_end
       from tx group by 1 having max(order_date) > min(order_date) + 545""",
)
def _(b: Book) -> DataFrame:
    # The default split is far shorter than the orders' span.
    short = window_ops.analysis_windows(b.transactions, Settings())
    return relations.transactions_within_windows(
        relations.transaction_profile(b.transactions), short
    )


@query(
    "l2_amounts_plausible",
    "source:s quantity:i rows:i amount:f2",
    """select source, quantity, count(*) as rows, -sum(gross_amount)::double as amount from tx
       where quantity = 1 and gross_amount > 0 group by 1, 2""",
)
def _(b: Book) -> DataFrame:
    amount = F.when(F.col("quantity") == 1, -F.col("gross_amount")).otherwise(F.col("gross_amount"))
    broken = b.transactions.withColumn("gross_amount", amount.cast("decimal(12,2)"))
    return relations.amounts_plausible(broken).groupBy("source", "quantity").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("gross_amount").alias("amount")
    )


@query(
    "l1_transaction_profile",
    "source:s transaction_count:i transaction_quantity:i transaction_amount:f2 earliest_order:s "
    "latest_order:s implausible_rows:i",
    """select source, count(*) as transaction_count, sum(quantity) as transaction_quantity,
         sum(gross_amount) as transaction_amount, min(order_date) as earliest_order,
         max(order_date) as latest_order, count(*) filter (gross_amount < 0) as implausible_rows
       from tx group by 1""",
)
def _(b: Book) -> DataFrame:
    return relations.transaction_profile(b.transactions)


@query(
    "l3_baselines_recompute",
    KEYS,
    "select source, customer_id from base where frequency > 0 and customer_age > 0",
)
def _(b: Book) -> DataFrame:
    inflated = b.scored.withColumn("baseline_purchases", F.col("baseline_purchases") * 1.5)
    return relations.baselines_recompute(
        inflated, b.calibration, b.cohort, b.windows, RECENT_DAYS
    )


@query(
    "l4_no_leakage",
    "source:s latest_calibration_order:s calibration_end:s",
    """select source, max(r.last_order_date) as latest_calibration_order,
         any_value(calibration_end) as calibration_end
       from cfull r join win using (source) group by 1""",
)
def _(b: Book) -> DataFrame:
    return relations.no_leakage(b.full, b.windows)


@query(
    "l5_calibration_within_full",
    f"{KEYS} calibration_frequency:i full_frequency:i calibration_total_spend:f2 "
    "full_total_spend:f2",
    """select f.source, f.customer_id, f.frequency as calibration_frequency,
         c.frequency as full_frequency, f.total_spend as calibration_total_spend,
         c.total_spend as full_total_spend
       from cfull f join ccal c using (source, customer_id)""",
)
def _(b: Book) -> DataFrame:
    # With the two relations swapped every customer's age is too large.
    return relations.calibration_within_full(b.full, b.calibration)


@query(
    "l6_windows_match",
    "source:s calibration_start:s calibration_end:s holdout_start:s holdout_end:s",
    "select * from win where source = 'orders'",
)
def _(b: Book) -> DataFrame:
    pinned = {
        # One day late: the defect a shifted window has.
        "orders": (date(1995, 1, 1), date(1998, 4, 19), date(1998, 4, 20), date(2001, 8, 5)),
        "events": (date(2024, 1, 1), date(2024, 1, 14), date(2024, 1, 15), date(2024, 2, 4)),
    }
    return relations.windows_match(b.windows, pinned)


@query(
    "l7_populations_align",
    f"{KEYS} models_present:i present_in:s",
    """select source, customer_id, 1 as models_present, 'rfm_full' as present_in from full_rfm
       where (source, customer_id) not in (select (source, customer_id) from cal)""",
)
def _(b: Book) -> DataFrame:
    # The open population: customers first seen in the holdout are in one relation only.
    return relations.populations_align(
        {
            "rfm_calibration": rfm.rfm_calibration(b.occasions, b.windows),
            "rfm_full": rfm.rfm_full(b.occasions, b.windows),
            "holdout_actuals": rfm.holdout_actuals(b.occasions, b.windows),
        }
    )


def _halved(b: Book) -> DataFrame:
    return b.holdout.withColumn("holdout_spend", (F.col("holdout_spend") / 2).cast("decimal(18,2)"))


@query(
    "l8_holdout_consistent",
    f"{KEYS} holdout_frequency:i",
    """select source, customer_id, holdout_frequency
       from (select *, ((round(holdout_spend * 100)::bigint + 1) // 2)::double / 100 as half from chold)
       where abs(holdout_monetary_value::double * holdout_frequency - half)
         > greatest(0.01, holdout_frequency * 0.000051)""",
)
def _(b: Book) -> DataFrame:
    return relations.holdout_consistent(_halved(b))


@query(
    "l9_holdout_reconciles",
    f"{KEYS} calibration_occasions:i holdout_frequency:i full_occasions:i",
    """select source, customer_id, null as calibration_occasions, null as holdout_frequency,
         occasions as full_occasions
       from full_rfm where (source, customer_id) not in (select (source, customer_id) from cal)""",
)
def _(b: Book) -> DataFrame:
    return relations.holdout_reconciles(
        rfm.rfm_calibration(b.occasions, b.windows),
        rfm.rfm_full(b.occasions, b.windows),
        rfm.holdout_actuals(b.occasions, b.windows),
    )


@query(
    "l10_known_duplicates",
    "source:s excess_rows:i expected_excess_rows:i",
    """select source, sum(copies - 1) as excess_rows, 0 as expected_excess_rows
       from (select source, (1 + (quantity = 50)::integer) * count(*) as copies from tx
         group by source, customer_id, order_date, quantity, gross_amount)
       group by 1 having sum(copies - 1) <> 0""",
)
def _(b: Book) -> DataFrame:
    doubled = b.transactions.unionByName(b.transactions.where(F.col("quantity") == 50))
    return relations.known_duplicates(
        transaction_ops.duplicate_excess(doubled), {"orders": 0, "events": 0}
    )


@query(
    "l11_monetary_value_matches",
    f"{KEYS} frequency:i repeat_occasions:i repeat_spend:f2",
    """select source, customer_id, frequency, frequency as repeat_occasions,
         total_spend - first_occasion_spend as repeat_spend
       from ccal where frequency > 0
         and abs(round(total_spend::double / frequency, 4) * frequency - (total_spend - first_occasion_spend)::double)
           > greatest(0.01, frequency * 0.000051)""",
)
def _(b: Book) -> DataFrame:
    # The first purchase leaks into the mean.
    leaked = b.calibration.withColumn(
        "monetary_value",
        F.when(F.col("frequency") > 0, F.try_divide("total_spend", "frequency"))
        .otherwise(F.lit(0))
        .cast("decimal(18,4)"),
    )
    return relations.monetary_value_matches(leaked, b.cohort, b.windows)


@query(
    "l12_occasions_collapsed",
    "occasion_count:i line_item_count:i transaction_count:i occasion_quantity:i "
    "transaction_quantity:i occasion_amount:f2 transaction_amount:f2",
    """select count(*) as occasion_count, sum(n) as line_item_count, sum(n) as transaction_count,
         sum(q) as occasion_quantity, sum(q) as transaction_quantity,
         sum(largest)::double as occasion_amount, sum(total)::double as transaction_amount
       from (select count(*) as n, sum(quantity) as q, max(gross_amount) as largest,
           sum(gross_amount) as total from tx group by source, customer_id, order_date)""",
)
def _(b: Book) -> DataFrame:
    # The largest line kept instead of the sum: the counts reconcile, the money does not.
    wrong = b.transactions.groupBy("source", "customer_id", "order_date").agg(
        F.sum("quantity").alias("quantity"),
        F.max("gross_amount").alias("gross_amount"),
        F.count(F.lit(1)).alias("line_items"),
    )
    return relations.occasions_collapsed(wrong, relations.transaction_profile(b.transactions))


@query(
    "l13_one_row_per_customer",
    f"model_name:s {KEYS} rows_for_customer:i",
    """select 'rfm_calibration' as model_name, source, customer_id, 2 as rows_for_customer
       from ccal where frequency = 0""",
)
def _(b: Book) -> DataFrame:
    repeated = b.calibration.unionByName(b.calibration.where(F.col("frequency") == 0))
    return relations.one_row_per_customer(
        {"rfm_calibration": repeated, "rfm_full": b.full, "holdout_actuals": b.holdout}
    )


@query("l14_predictions_unchanged", "source:s", "select distinct source from ccal")
def _(b: Book) -> DataFrame:
    scaled = b.predictions.withColumn("expected_purchases", F.col("expected_purchases") * 1.167)
    return relations.predictions_unchanged(scaled, b.fit_runs)


@query(
    "l15_inputs_unchanged",
    "source:s fitted_on_rows:i current_rows:i fitted_on_spend:f4 current_spend:f4",
    """select source, count(*) as fitted_on_rows, count(*) as current_rows,
         sum(monetary_value::decimal(18, 4))::double as fitted_on_spend,
         sum(monetary_value::decimal(18, 4))::double as current_spend from ccal group by 1""",
)
def _(b: Book) -> DataFrame:
    # Every customer's rank weight changes, no plain sum does: the ids run the other way.
    mirrored = b.calibration.withColumn("customer_id", -F.col("customer_id"))
    return relations.inputs_unchanged(mirrored, b.fit_runs)


@query(
    "l16_sensitivity_complete",
    "source:s window_days:i problem:s",
    """select source, window_days, 'population incomplete' as problem
       from (select source, window_days, count(*) as customers,
           count(*) filter (recent_repeats > 0) as buying from crecent group by 1, 2)
       where buying <> customers""",
)
def _(b: Book) -> DataFrame:
    # Customers without a recent repeat dropped, as an inner join would.
    counts = rfm.recent_counts(b.cohort, b.windows, LOOK_BACKS)
    buying = counts.groupBy("source").agg(
        *[F.count_if(F.col(f"repeats_{d}") > 0).alias(f"n_{d}") for d in LOOK_BACKS]
    )
    long = buying.select(
        "source",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(d).alias("window_days"), F.col(f"n_{d}").alias("customers"))
                    for d in LOOK_BACKS
                ]
            )
        ).alias("e"),
    ).select("source", "e.*")
    return relations.sensitivity_complete(long, b.calibration)


@query(
    "l17_sensitivity_matches_scored",
    "source:s sensitivity_predicted:f4 scored_predicted:f4 sensitivity_actual:i scored_actual:i",
    f"""select source, 1.5 * predicted_purchases as sensitivity_predicted,
          predicted_purchases as scored_predicted, actual_purchases as sensitivity_actual,
          actual_purchases as scored_actual from csens where window_days = {RECENT_DAYS}""",
)
def _(b: Book) -> DataFrame:
    scaled = b.sensitivity.withColumn("predicted_purchases", F.col("predicted_purchases") * 1.5)
    return relations.sensitivity_matches_scored(scaled, b.scored, RECENT_DAYS)


@query(
    "l18_sensitivity_recomputes",
    "source:s window_days:i predicted_purchases:f4 expected_predicted_purchases:f4",
    f"""select source, window_days, 0.8::double * predicted_purchases as predicted_purchases,
          predicted_purchases as expected_predicted_purchases
        from csens where window_days <> {RECENT_DAYS}""",
)
def _(b: Book) -> DataFrame:
    # Every look-back but the configured one, which the scored rule already guards.
    scale = F.when(F.col("window_days") == RECENT_DAYS, 1.0).otherwise(0.8)
    scaled = b.sensitivity.withColumn("predicted_purchases", F.col("predicted_purchases") * scale)
    return relations.sensitivity_recomputes(scaled, b.calibration, b.cohort, b.windows)


@query(
    "l19_rfm_invariants",
    f"window_name:s {KEYS} frequency:i recency:i customer_age:i",
    """select 'calibration' as window_name, source, customer_id, frequency,
         customer_age as recency, recency as customer_age
       from ccal where customer_age > recency or (frequency > 0 and customer_age <= 0)""",
)
def _(b: Book) -> DataFrame:
    swapped = b.calibration.withColumns(
        {"recency": F.col("customer_age"), "customer_age": F.col("recency")}
    )
    return relations.rfm_invariants(swapped, b.full)


@query(
    "l20_scored_horizon",
    f"{KEYS} horizon_days:i window_days:i",
    f"""select source, customer_id, {FORWARD_DAYS} as horizon_days,
          duration_holdout as window_days from ccal join win using (source)""",
)
def _(b: Book) -> DataFrame:
    wrong = b.scored.withColumn("horizon_days", F.lit(FORWARD_DAYS))
    return relations.scored_horizon(wrong, b.windows)


@query(
    "l21_scored_population",
    f"{KEYS} calibration_rows:i scored_rows:i",
    """select source, customer_id, 1 as calibration_rows, 0 as scored_rows
       from ccal where not is_gamma_gamma_eligible""",
)
def _(b: Book) -> DataFrame:
    return relations.scored_population(b.calibration, b.scored.where("is_gamma_gamma_eligible"))


@query(
    "l22_spend_reconciles",
    f"{KEYS} calibration_spend:f2 full_spend:f2",
    """select source, customer_id, c.total_spend as calibration_spend, f.total_spend as full_spend
       from ccal c join cfull f using (source, customer_id) join chold h using (source, customer_id)
       where round(holdout_spend * 100)::bigint > 1""",
)
def _(b: Book) -> DataFrame:
    # Half of a cent rounds up to the cent, so only more than one cent goes missing.
    return relations.spend_reconciles(b.calibration, b.full, _halved(b))


@query(
    "l23_not_null",
    "column_name:s nulls:i",
    """select 'monetary_value' as column_name, count(*) as nulls from ccal where frequency = 0
       having count(*) > 0""",
)
def _(b: Book) -> DataFrame:
    holed = b.calibration.withColumn(
        "monetary_value", F.when(F.col("frequency") > 0, F.col("monetary_value"))
    )
    return generic.not_null(holed, suite.REQUIRED["rfm_calibration"])


@query(
    "l24_unique",
    "order_id:s copies:i",
    """select customer_id || '-' || strftime(order_date, '%Y%m%d') as order_id, count(*) as copies
       from tx group by 1 having count(*) > 1""",
)
def _(b: Book) -> DataFrame:
    # At line-item grain the order surrogate repeats; the occasion grain is what makes it unique.
    return generic.unique(b.transactions, ["order_id"])


@query(
    "l25_accepted_values",
    "value:s copies:i",
    "select source as value, count(*) as copies from tx where source = 'events' group by 1",
)
def _(b: Book) -> DataFrame:
    return generic.accepted_values(b.transactions, "source", ["orders"])


@query(
    "l26_check_report",
    "check_name:s stage:s violations:i",
    "select unnest(["
    + ", ".join(f"'{c.name}'" for c in sorted(suite.all_checks(), key=lambda c: c.name)
                if c.stage == suite.POST_FIT)
    + "]) as check_name, 'post_fit' as stage, 0 as violations",
)
def _(b: Book) -> DataFrame:
    tables = {
        "analysis_windows": b.windows,
        "purchase_occasions": b.cohort,
        "rfm_calibration": b.calibration,
        "recent_window_sensitivity": b.sensitivity,
        "predictions": b.predictions,
        "scored": b.scored,
        "fit_runs": b.fit_runs,
    }
    return suite.run_checks(tables, suite.POST_FIT)


def _planted(b: Book) -> dict[str, DataFrame]:
    """The transform stage's relations with a defect in each of several of them."""
    members = b.cohort.select("source", "customer_id").distinct()
    amount = F.col("gross_amount")
    full = b.full.where(F.col("customer_id") % 10 != 3)
    full = full.unionByName(full.where("frequency >= 5"))
    late = F.when(F.col("frequency") == 1, F.col("customer_age") + 1).otherwise(F.col("recency"))
    return {
        "transactions": b.transactions.join(members, ["source", "customer_id"], "left_semi").withColumn(
            "gross_amount",
            F.when(F.col("customer_id") % 97 == 0, -amount).otherwise(amount).cast(stored.schemas.LINE_MONEY),
        ),
        "analysis_windows": b.windows,
        "purchase_occasions": b.cohort,
        "rfm_calibration": b.calibration.withColumn(
            "monetary_value", F.when(F.col("frequency") > 0, F.col("monetary_value"))
        ),
        "rfm_full": full.withColumn("recency", late.cast("int")),
        "holdout_actuals": _halved(b),
        "monthly_retention": cohorts.monthly_retention(b.cohort),
        "recent_window_sensitivity": b.sensitivity,
    }


@query(
    "l26_transform_report",
    "check_name:s stage:s violations:i",
    "select check_name, 'transform' as stage, coalesce(v, 0) as violations from (select unnest(["
    + ", ".join(f"'{c.name}'" for c in suite.all_checks() if c.stage == suite.TRANSFORM)
    + """]) as check_name) left join (
        select 'amounts_plausible' as check_name, count(distinct source) as v
          from ctx where customer_id % 97 = 0 and gross_amount > 0
        union all
        select 'transactions_within_windows', count(*) from (
          select source from ctx join win using (source) group by source
          having min(order_date) < any_value(calibration_start) or max(order_date) > any_value(holdout_end))
        union all
        select 'occasions_collapsed', ((select sum(case when customer_id % 97 = 0 then -gross_amount
            else gross_amount end) from ctx) <> (select sum(gross_amount) from cocc)
          or (select count(*) from cocc) >= (select count(*) from ctx))::int
        union all
        select 'not_null_rfm_calibration', (count(*) > 0)::int from ccal where frequency = 0
        union all
        select 'rfm_invariants', count(*) from bad_full where frequency = 1
        union all
        select 'one_row_per_customer', count(*) from bad_full where frequency >= 5
        union all
        select 'populations_align', count(*) from ccal where customer_id % 10 = 3
        union all
        select 'holdout_reconciles', count(*) from ccal where customer_id % 10 = 3
        union all
        select 'spend_reconciles', count(*) from chold join bad_full using (source, customer_id)
          where holdout_spend > 0
        union all
        select 'holdout_consistent', count(*)
          from (select *, ((round(holdout_spend * 100)::bigint + 1) // 2)::double / 100 as half from chold)
          where abs(holdout_monetary_value::double * holdout_frequency - half)
            > greatest(0.01, holdout_frequency * 0.000051)) using (check_name)""",
    ctx="select * from tx where (source, customer_id) in (select (source, customer_id) from cocc)",
    bad_full="select * from cfull where customer_id % 10 <> 3",
)
def _(b: Book) -> DataFrame:
    return suite.run_checks(_planted(b), suite.TRANSFORM)
