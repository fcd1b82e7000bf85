"""Global positions, ranks, quantiles, correlations and deciles against pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from returnwise.metrics import rank
from returnwise.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """5,000 rows, two groups, a third of all rows sharing one value."""
    generator = np.random.default_rng(11)
    n = 5000
    value = np.where(generator.random(n) < 0.34, 0.0, generator.normal(size=n).round(2))
    other = np.where(generator.random(n) < 0.34, 0.0, value + generator.normal(size=n)).round(3)
    frame = pd.DataFrame(
        {"g": np.where(np.arange(n) % 5 == 0, "x", "y"), "id": generator.permutation(n),
         "v": value, "w": other}
    )
    return spark.createDataFrame(frame).repartition(7), frame


def test_positions_number_every_row_once_in_order(skewed):
    df, frame = skewed
    got = ranking.global_positions(df, [F.col("v").desc(), F.col("id")]).toPandas()
    want = frame.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert got.sort_values("position")["id"].tolist() == want
    assert sorted(got["position"]) == list(range(len(frame)))


def test_positions_restart_in_each_group(skewed):
    df, frame = skewed
    got = ranking.global_positions(df, [F.col("v"), F.col("id")], ["g"]).toPandas()
    for g, part in got.groupby("g"):
        want = frame[frame["g"] == g].sort_values(["v", "id"])["id"].tolist()
        assert part.sort_values("position")["id"].tolist() == want
        assert sorted(part["position"]) == list(range(len(part)))


def test_weighted_positions_are_prefix_sums(skewed):
    df, frame = skewed
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.average_ranks(counts, "v", ["g"]).toPandas().set_index(["g", "v"])["rank"]
    frame = frame.assign(r=frame.groupby("g")["v"].rank(method="average"))
    for row in frame.itertuples():
        assert got[(row.g, row.v)] == row.r


def test_dense_rank_gives_all_rows_of_a_customer_one_rank(spark):
    rows = [("s", c, h) for c in (3, 9, 12, 40, 41) for h in (273, 365)]
    rows += [("t", c, 30) for c in (5, 2)]
    df = spark.createDataFrame(rows, "source string, customer_id long, horizon_days int")
    got = ranking.dense_customer_rank(df.repartition(5)).toPandas()
    want = pd.DataFrame(rows, columns=["source", "customer_id", "horizon_days"])
    want["r"] = want.groupby("source")["customer_id"].rank(method="dense").astype(int)
    merged = got.merge(want, on=["source", "customer_id", "horizon_days"])
    assert len(merged) == len(rows)
    assert (merged["customer_rank"] == merged["r"]).all()


def test_quantiles_interpolate_like_pandas(skewed):
    df, frame = skewed
    wanted = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}
    got = ranking.exact_quantiles(df, "w", wanted, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        for name, p in wanted.items():
            assert got.loc[g, name] == pytest.approx(part["w"].quantile(p), abs=1e-12)
    whole = ranking.exact_quantiles(df, "w", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(frame["w"].median())


def test_spearman_matches_average_rank_correlation(skewed):
    df, frame = skewed
    got = rank.spearman(df, "v", "w", ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        want = part["v"].rank().corr(part["w"].rank())
        assert got.loc[g, "rho"] == pytest.approx(want, abs=1e-12)
        assert got.loc[g, "n"] == len(part)
    whole = rank.spearman(df, "v", "w").first()
    assert whole["rho"] == pytest.approx(frame["v"].rank().corr(frame["w"].rank()), abs=1e-12)


def test_a_shared_outcome_is_ranked_once_for_all_its_predictors(skewed):
    df, frame = skewed
    rows = df.select(
        "g",
        F.explode(F.array(
            F.struct(F.lit("one").alias("f"), F.col("v").alias("p")),
            F.struct(F.lit("two").alias("f"), (F.col("v") * F.col("v")).alias("p")),
            F.struct(F.lit("flat").alias("f"), F.lit(1.0).alias("p")),
        )).alias("e"),
        "w",
    ).select("g", "e.f", "e.p", "w")
    got = rank.rank_correlations(rows, "p", "w", ["g", "f"], y_by=["g"]).toPandas()
    got = got.set_index(["g", "f"])["rho"]
    for g, part in frame.groupby("g"):
        ranked = part["w"].rank()
        assert got[(g, "one")] == pytest.approx(part["v"].rank().corr(ranked), abs=1e-12)
        assert got[(g, "two")] == pytest.approx((part["v"] ** 2).rank().corr(ranked), abs=1e-12)
        assert math.isnan(got[(g, "flat")])


@pytest.mark.parametrize(
    "x,y,rho",
    [([1, 2, 3, 4, 5], [1, 4, 9, 16, 25], 1.0), ([1, 2, 3, 4], [4, 3, 2, 1], -1.0)],
)
def test_monotone_relations_are_perfect(spark, x, y, rho):
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    row = rank.spearman(df, "x", "y").first()
    assert row["rho"] == pytest.approx(rho)
    assert row["p_value"] == pytest.approx(0.0, abs=1e-9)


def test_a_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7)], "x int, y int")
    row = rank.spearman(df, "x", "y").first()
    assert math.isnan(row["rho"]) and math.isnan(row["p_value"]) and row["n"] == 4


def test_deciles_are_equal_counts_by_position(spark):
    n = 23
    df = spark.createDataFrame([(i, 1.0) for i in range(n)], "customer_id int, p double")
    got = rank.assign_deciles(df.repartition(3), "p").toPandas().sort_values("customer_id")
    # All forecasts tie, so the key decides.
    assert got["decile"].tolist() == [i * 10 // n + 1 for i in range(n)]


def test_decile_table_reports_each_tenth(spark):
    df = spark.createDataFrame(
        [(i, float(i), float(2 * i)) for i in range(20)], "customer_id int, p double, a double"
    )
    table = rank.decile_table(df, "a", "p").toPandas().sort_values("decile")
    assert table["decile"].tolist() == list(range(1, 11))
    assert (table["customers"] == 2).all()
    assert table["mean_predicted"].iloc[0] == 18.5
    assert table["mean_actual"].iloc[0] == 37.0
    assert table["share_of_actual"].sum() == pytest.approx(1.0)
    assert table["total_actual"].sum() == sum(2 * i for i in range(20))


def test_decile_shares_are_undefined_without_an_outcome(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)],
                               "customer_id int, p double, a double")
    shares = rank.decile_table(df, "a", "p").toPandas()["share_of_actual"]
    assert shares.isna().all()


def test_intermediate_tables_can_be_released(spark, monkeypatch):
    import os

    from returnwise import session
    from returnwise.session import materialise, release_intermediate

    # Only what this test writes: other tests' tables stay.
    monkeypatch.setattr(session, "_written", {})
    df = materialise(spark.range(5).toDF("id"))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert release_intermediate(spark) == 1
    assert not os.path.exists(folder)


def test_weighted_positions_shuffle_the_rows_once(skewed, monkeypatch):
    df, frame = skewed
    seen = []
    monkeypatch.setattr(ranking, "materialise", lambda d: seen.append(d) or d)
    ranking.global_positions(df, [F.col("v"), F.col("id")], ["g"], weight="id").count()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0


def test_running_sums_across_batches_groups_and_nulls(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        generator = np.random.default_rng(8)
        rows = [
            (None if g == 0 else f"g{g}", int(k), int(w))
            for g in (0, 0, 1, 2, 3, 3, 3) for k, w in zip(generator.integers(0, 40, 60), generator.integers(0, 9, 60))
        ]
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, k long, w long, i long")
        got = ranking.global_positions(
            df.where("g is not null"), [F.col("k"), F.col("i")], ["g"], weight="w"
        ).toPandas()
        for g, part in got.groupby("g"):
            part = part.sort_values(["k", "i"])
            assert part["position"].tolist() == (part["w"].cumsum() - part["w"]).tolist()
        whole = ranking.global_positions(df, [F.col("k"), F.col("i")], weight="w").toPandas().sort_values(["k", "i"])
        assert whole["position"].tolist() == (whole["w"].cumsum() - whole["w"]).tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quantiles_of_awkward_values(spark):
    inf, nan = float("inf"), float("nan")
    cases = {
        "one": [3.5], "ties": [1.0] * 50 + [2.0] * 3, "wide": [-1.7e308, -1.0, 0.0, 5e-324, 1.7e308],
        "tiny": [5e-324, 1e-323, 1.5e-323], "signs": [-3.0, -2.0, 0.0, 0.0, 9.0, 11.0],
        "ends": [-inf, 1.0, 2.0, 3.0, inf], "skew": [10.0**k for k in range(-300, 300, 7)],
    }
    rows = [(g, v) for g, values in cases.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in ranking.exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}, ["g"]).collect()}
    assert set(got) == set(cases)
    for g, values in cases.items():
        ordered = sorted(values)
        for name, p in (("a", 0.0), ("b", 0.5), ("c", 0.9), ("d", 1.0)):
            at = (len(ordered) - 1) * p
            low = int(at)
            want = ordered[low] if at == low else (1 - (at - low)) * ordered[low] + (at - low) * ordered[low + 1]
            assert got[g][name] == want or math.isclose(got[g][name], want), (g, name)
    assert ranking.exact_quantiles(df.limit(0), "v", {"a": 0.5}, ["g"]).collect() == []
    with_nan = spark.createDataFrame([(x,) for x in (1.0, 2.0, nan)], "v double")
    assert ranking.exact_quantiles(with_nan, "v", {"m": 0.5}).first()["m"] == 2.0


def test_quantiles_sort_nothing(skewed, monkeypatch):
    df, _ = skewed
    seen = []
    keep = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda d: seen.append(d) or keep(d))
    ranking.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert len(plans) >= 3 and not any("rangepartitioning" in p for p in plans)
