"""Global positions, ranks and exact quantiles without a single-partition window."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnwise.session import materialise, small

# Executors run the functions here without having the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _starts(columns: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where the values of ``columns`` differ from the row before, and the last row's values."""
    rows = len(columns[0])
    starts = np.zeros(rows, dtype=bool)
    for column in columns:
        codes = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    starts[0] = last is None or tuple(c[0].as_py() for c in columns) != last
    return starts, tuple(c[rows - 1].as_py() for c in columns)


def _running(by: Sequence[str], weight: str | None, runs: Sequence[str]) -> Callable:
    """Adds up weights over a sorted partition, a batch at a time.

    Appends the partition's number, the row's own weight, and the weights of the rows before it in
    its group. Without ``weight`` a row weighs one where ``runs`` change and nothing elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group_last = run_last = None
        carried = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            groups = [batch.column(c) for c in by]
            if groups:
                starts, group_last = _starts(groups, group_last)
            else:
                starts = np.zeros(rows, dtype=bool)
            if weight is None:
                leads, run_last = _starts([*groups, *(batch.column(c) for c in runs)], run_last)
                own = leads.astype(np.int64)
            else:
                own = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(own) - own
            at = np.maximum.accumulate(np.where(starts, np.arange(rows), -1))
            within = before - np.where(at >= 0, before[at], 0) + np.where(at >= 0, 0, carried)
            carried = int(within[-1] + own[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(rows, part, dtype=np.int32)), pa.array(own), pa.array(within)],
                names=[*batch.schema.names, "_part", "_own", "_within"],
            )

    return run


def _numbered(
    ranged: DataFrame, by: Sequence[str], weight: str | None = None, runs: Sequence[str] = ()
) -> DataFrame:
    """``ranged``, sorted in its partitions, with ``_own`` and ``_before``: the weight of a row and of
    all rows before it in its group.

    The rows are shuffled once, by the range partitioning; their sums are taken in the same pass
    and written with them, since the offsets must come from the partitioning they belong to.
    """
    fields = [
        T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType()),
        T.StructField("_within", T.LongType()),
    ]
    schema = T.StructType([*ranged.schema.fields, *fields])
    numbered = materialise(ranged.mapInArrow(_running(list(by), weight, list(runs)), schema))
    # One row per partition and group boundary inside it.
    parts = numbered.groupBy("_part", *by).agg(F.sum("_own").alias("_amount"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = parts.select(
        "_part", *by, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).cast("long").alias("_offset")
    )
    return numbered.join(small(offsets), ["_part", *by]).withColumn(
        "_before", F.col("_offset") + F.col("_within")
    )


def global_positions(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    weight: str | None = None,
    name: str = "position",
) -> DataFrame:
    """Append each row's zero-based position in the order ``(by, order)``, counted within ``by``.

    With ``weight``, a whole number, the position is the sum of that column over the rows before,
    which turns a table of value counts into ranks. Rows are range-partitioned on the whole
    ordering, so a value held by a third of the rows is spread over partitions by the remaining
    order columns, and each partition numbers its own rows. The numbered rows are written once: the
    offsets and the rows they are added to must come from the same partitioning.
    """
    keys = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    if weight:
        placed = _numbered(ranged, by, weight)
        return placed.select(*df.columns, F.col("_before").alias(name))
    numbered = materialise(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_slot", _PARTITION_BITS))

    groups = ["_part", *by]
    # One row per partition and group boundary inside it.
    parts = numbered.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_amount"), F.min("_slot").alias("_first_slot")
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *groups,
        "_first_slot",
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).cast("long").alias("_offset"),
    )
    placed = numbered.join(small(offsets), groups)
    within = F.col("_slot") - F.col("_first_slot")
    return placed.select(
        *df.columns, (F.col("_offset") + within).cast("long").alias(name)
    )


def customer_rank(df: DataFrame, key: str = "customer_id", by: str = "source") -> DataFrame:
    """Append ``customer_rank``: one-based row number by ``key`` inside each ``by``."""
    ranked = global_positions(df, [F.col(key)], [by], name="customer_rank")
    return ranked.withColumn("customer_rank", F.col("customer_rank") + 1)


def dense_customer_rank(
    df: DataFrame, key: str = "customer_id", by: str = "source", repeats: str = "horizon_days"
) -> DataFrame:
    """Append ``customer_rank`` counting distinct customers when each has one row per ``repeats``.

    Rows are range-partitioned by the customer alone, so that a customer's few rows stay together
    and the partition can count where customers change, in the pass that numbers them.
    """
    ranged = df.repartitionByRange(by, key).sortWithinPartitions(by, key, repeats)
    placed = _numbered(ranged, [by], runs=[key])
    # The customer's first row counts itself; later rows already have it behind them.
    return placed.select(*df.columns, (F.col("_before") + F.col("_own")).alias("customer_rank"))


def average_ranks(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rank of each distinct value with ties averaged, from a table of ``(by, value, n)`` counts.

    Returns ``(by, value, n, rank)``.
    """
    placed = global_positions(values, [F.col(value)], by, weight="n", name="_before")
    return placed.select(
        *by, value, "n", (F.col("_before") + (F.col("n") + 1) / 2.0).alias("rank")
    )


#: Parts that a pass of the selection cuts each range of values into.
SELECTION_PARTS = 1024
#: Passes after which a selection cannot still be going on: every one cuts a double's range further.
MOST_PASSES = 64


def _magnitude(v: Column) -> Column:
    """The logarithm of a value's size with its sign: in the values' order, zero in the middle."""
    # The smallest double's logarithm is above -745.
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746.0))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per name, one row per ``by`` group.

    Nothing is sorted. A quantile lies between two ranks, and the value at a rank is found by
    histograms: each pass counts the values of a rank's range in equal parts, with partial sums in
    every task, and goes on with the part that holds the rank, from its smallest value to its
    largest. What is shuffled in a pass is bounded by groups, ranks and parts, whatever the number of
    rows; a value shared by most rows ends its search at once. NULLs don't count; NaN is above all
    other values.
    """
    by = list(by)
    group = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = materialise(
        rows.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    spans = counts.groupBy(*group).agg(
        F.sum("_n").alias("_rows"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
    )
    at = {name: (F.col("_rows") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), F.lit(step).alias("_step"),
                     (F.floor(at[name]) + step).cast("long").alias("_rank"))
            for name in probabilities for step in (0, 1)
        ]
    )
    # The rank above the last one is the last one; its share in the quantile is zero.
    state = materialise(
        spans.select(*group, "_rows", "_lo", "_hi", F.explode(wanted).alias("_w")).select(
            *group, "_rows", "_lo", "_hi", "_w._name", "_w._step",
            F.least("_w._rank", F.col("_rows") - 1).alias("_rank"),
        )
    )
    target = [*group, "_name", "_step"]
    ordered = Window.partitionBy(*target).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def part(scale: Callable[[Column], Column]) -> Column:
        low, high, here = (scale(F.col(c)) for c in ("_lo", "_hi", "_value"))
        along = F.coalesce(F.try_divide(here - low, high - low), F.lit(float("nan")))
        return (
            F.when(F.col("_value") == F.col("_lo"), 0)
            .when(F.col("_value") == F.col("_hi"), SELECTION_PARTS - 1)
            .when(F.isnan(along), SELECTION_PARTS // 2)
            .otherwise(F.least(F.floor(along * SELECTION_PARTS), F.lit(SELECTION_PARTS - 1)))
            .cast("int")
        )

    # Equal parts of the values and of their magnitudes, in turn: the former end a search among
    # near values, the latter one over many orders of magnitude.
    parts = (part(lambda v: v / 2), part(_magnitude))
    found = None
    for number in range(MOST_PASSES):
        ready = state.where(F.col("_lo") == F.col("_hi"))
        found = ready if found is None else found.unionByName(ready)
        state = state.where(F.col("_lo") != F.col("_hi"))
        if state.isEmpty():
            break
        inside = counts.join(state, group).where(F.col("_value").between(F.col("_lo"), F.col("_hi")))
        histogram = (
            inside.withColumn("_part", parts[number % 2])
            .groupBy(*target, "_rows", "_rank", "_part")
            .agg(F.sum("_n").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
        )
        before = F.coalesce(F.sum("_n").over(ordered), F.lit(0))
        state = materialise(
            histogram.withColumn("_before", before)
            .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
            .select(
                *group, "_rows", "_lo", "_hi", "_name", "_step",
                (F.col("_rank") - F.col("_before")).cast("long").alias("_rank"),
            )
        )
    else:
        raise ArithmeticError("the ranges of a selection do not shrink")
    columns = []
    for name in probabilities:
        fraction = at[name] - F.floor(at[name])
        own = F.col("_name") == name
        columns.append(
            F.sum(
                F.when(own & (F.col("_step") == 0), (1 - fraction) * F.col("_lo"))
                .when(own & (fraction > 0), fraction * F.col("_lo"))
            ).alias(name)
        )
    result = found.groupBy(*group).agg(*columns)
    return result if by else result.drop("_all")
