"""Kernels against closed-form anchors, fits against simulated customers, forecast properties."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from returnwise.functions.numeric import correlation_p_value, gauss_series, log_gamma
from returnwise.models import chains, draws, families, fingerprints
from returnwise.models import fit as models
from returnwise.models.optimizer import NotConverged
from returnwise.models.predict import (
    alive_column,
    expected_over_draws,
    expected_over_states,
    predict,
    spend_column,
)

# Rounded estimates printed for the full public file, in days.
BG = (0.250, 33.011, 0.717, 2.125)
MBG = (0.589, 47.954, 0.835, 1.354)
PARETO = (0.589, 77.123, 0.403, 37.186)


def test_log_gamma_matches_the_standard_library():
    x = np.array([1e-3, 0.5, 1, 3.5, 11.99, 12, 50, 1e5])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(log_gamma(x), want, rtol=1e-13, atol=1e-13)


def test_gauss_series_closed_forms():
    z = np.array([0.0, 0.3, 0.9, 0.99])
    assert np.allclose(gauss_series(1, 1, 2, z)[1:], -np.log1p(-z[1:]) / z[1:], rtol=1e-12)
    assert np.allclose(gauss_series(2.5, 3.0, 3.0, z), (1 - z) ** -2.5, rtol=1e-11)


def test_p_values_reach_far_tails():
    assert correlation_p_value(0.198, 9450) == pytest.approx(3.7e-84, rel=0.02)
    assert correlation_p_value(0.9, 5) == pytest.approx(0.03738607, rel=1e-6)
    assert correlation_p_value(0.0, 50) == pytest.approx(1.0)
    assert math.isnan(correlation_p_value(float("nan"), 9))


@pytest.mark.parametrize(
    "family,p,want",
    [(families.BG_NBD, BG, 0.228), (families.MBG_NBD, MBG, 0.180),
     (families.PARETO_NBD, PARETO, 0.148)],
)
def test_zero_repeat_forecasts_hit_the_published_bucket(family, p, want):
    got = families.expected_purchases(family, p, 0.0, 0.0, 229.0, 273.0)
    assert float(got) == pytest.approx(want, abs=6e-4)


def test_in_sample_expectation_is_near_the_published_total():
    assert 23570 * float(families.expected_new_purchases(BG, 229.0)) == pytest.approx(24578, abs=2)


@pytest.mark.parametrize("family,p", [
    (families.BG_NBD, BG), (families.MBG_NBD, MBG), (families.PARETO_NBD, PARETO),
    (families.PARETO_NBD, (0.6, 30.0, 0.5, 70.0)),
])
def test_forecasts_grow_with_the_horizon_and_stay_in_range(family, p):
    x = np.array([0, 1, 3, 8.0])
    tx, T = np.array([0, 30, 100, 200.0]), np.full(4, 220.0)
    alive = families.probability_alive(family, p, x, tx, T)
    assert ((alive > 0) & (alive <= 1)).all()
    values = [families.expected_purchases(family, p, x, tx, T, h) for h in (1.0, 90.0, 273.0, 2e3)]
    assert all((b > a).all() for a, b in zip(values, values[1:]))
    if family == families.BG_NBD:
        assert alive[0] == 1.0


@pytest.mark.parametrize("family,p", [
    (families.BG_NBD, (0.8, 40.0, 1.0, 2.5)), (families.PARETO_NBD, (0.8, 40.0, 1.0, 60.0)),
])
def test_forecast_is_smooth_through_the_removable_singularity(family, p):
    def at(third):
        q = (p[0], p[1], third, p[3])
        return float(families.expected_purchases(family, q, 2.0, 50.0, 200.0, 273.0))

    assert at(1.0) == pytest.approx((at(1 - 1e-4) + at(1 + 1e-4)) / 2, rel=1e-5)


def test_pareto_likelihood_integrates_the_process():
    p = (2.5, 20.0, 2.2, 12.0)
    for r, alpha, s, beta in (p, (2.5, 12.0, 2.2, 20.0)):
        lam = mu = np.linspace(1e-6, 2.5, 3001)
        L, M = np.meshgrid(lam, mu, indexing="ij")
        x, tx, T = 3, 20.0, 30.0
        seen = L**x * M / (L + M) * np.exp(-(L + M) * tx)
        seen += L ** (x + 1) / (L + M) * np.exp(-(L + M) * T)
        mix = alpha**r * L ** (r - 1) * np.exp(-alpha * L) / math.gamma(r)
        mix *= beta**s * M ** (s - 1) * np.exp(-beta * M) / math.gamma(s)
        want = math.log(np.trapezoid(np.trapezoid(seen * mix, mu, axis=1), lam))
        got = families.log_likelihood(families.PARETO_NBD, (r, alpha, s, beta), 3.0, tx, T)
        assert float(got) == pytest.approx(want, abs=1e-4)


def simulate(n, seed, r=0.8, alpha=40.0, a=0.8, b=2.5, p=6.2, q=3.7, v=15.0):
    """Customers of the BG/NBD process with Gamma-Gamma spend."""
    generator = np.random.default_rng(seed)
    rate, drop = generator.gamma(r, 1 / alpha, n), generator.beta(a, b, n)
    age = generator.integers(150, 400, n)
    count, last = np.zeros(n, dtype=int), np.zeros(n)
    for i in range(n):
        t = 0.0
        while True:
            t += generator.exponential(1 / rate[i])
            if t > age[i]:
                break
            count[i], last[i] = count[i] + 1, t
            if generator.random() < drop[i]:
                break
    scale = generator.gamma(q, 1 / v, n)
    mean = np.where(count > 0, generator.gamma(np.maximum(p * count, 1)) /
                    (scale * np.maximum(count, 1)), 0.0)
    first = generator.gamma(3, 10, n)
    return pd.DataFrame(
        {"source": "s", "customer_id": np.arange(n), "frequency": count,
         "recency": np.floor(last).astype(int), "customer_age": age, "monetary_value": mean,
         "first_occasion_spend": first, "total_spend": mean * count + first,
         "is_gamma_gamma_eligible": count > 0}
    )


@pytest.fixture(scope="module")
def customers(spark):
    frame = simulate(8000, 3)
    return spark.createDataFrame(frame), frame


@pytest.fixture(scope="module")
def fits(customers):
    df, _ = customers
    return models.fit_purchase_model(df), models.fit_gamma_gamma(df)


def test_purchase_parameters_are_recovered(fits):
    got = fits[0].parameters
    assert got["r"] == pytest.approx(0.8, rel=0.1) and got["alpha"] == pytest.approx(40, rel=0.12)
    assert got["a"] / (got["a"] + got["b"]) == pytest.approx(0.8 / 3.3, rel=0.1)
    assert fits[0].jobs < 25 and fits[0].customers == 8000


def test_spend_parameters_are_recovered(fits, customers):
    p, q, v = fits[1].vector
    assert p * v / (q - 1) == pytest.approx(6.2 * 15 / 2.7, rel=0.05)
    assert p == pytest.approx(6.2, rel=0.2) and q == pytest.approx(3.7, rel=0.2)
    assert fits[1].customers == int((customers[1]["frequency"] > 0).sum())


def test_maximum_likelihood_has_no_better_neighbour(customers):
    df, frame = customers
    fit = models.fit_purchase_model(df, prior=False)
    x, tx, T = (frame[c].to_numpy(float) for c in ("frequency", "recency", "customer_age"))

    def value(vector):
        return float(families.log_likelihood(families.BG_NBD, tuple(vector), x, tx, T).sum())

    best = value(fit.vector)
    assert fit.log_likelihood == pytest.approx(best, abs=1e-5)
    for i in range(4):
        for factor in (0.99, 1.01):
            moved = list(fit.vector)
            moved[i] *= factor
            assert value(moved) < best


@pytest.mark.parametrize("family", models.CHALLENGERS)
def test_challengers_fit_the_same_customers(customers, family):
    outcome = models.fit_challenger(customers[0], family)
    assert outcome.succeeded and outcome.fit.customers == 8000
    assert all(v > 0 for v in outcome.fit.vector)


def test_a_failing_challenger_is_a_result_and_an_unknown_one_a_mistake(customers):
    # Recency beyond the age leaves the likelihood without a finite value.
    broken = customers[0].withColumn("recency", F.expr("customer_age * 1e6")).withColumn(
        "frequency", F.lit(-5)
    )
    outcome = models.fit_challenger(broken, families.MBG_NBD)
    assert not outcome.succeeded and outcome.fit is None and outcome.detail
    with pytest.raises(AnalysisException):  # a fault of the input is not a result
        models.fit_challenger(customers[0].drop("recency"), families.MBG_NBD)
    with pytest.raises(models.ModelError, match="is no challenger"):
        models.fit_challenger(customers[0], "bg_bb")


@pytest.mark.parametrize(
    "change,message",
    [
        ({"recency": "customer_age + 1"}, "after the observation ends"),
        ({"frequency": "case when customer_id = 3 then -1 else frequency end"}, "below zero .1."),
        ({"customer_age": "0", "recency": "0"}, "not observed for a single day"),
        ({"monetary_value": "monetary_value * frequency / (frequency + 1)"}, "is not the repeat spend"),
        ({"is_gamma_gamma_eligible": "true"}, "without repeat spend"),
        ({"is_gamma_gamma_eligible": "false"}, "nobody bought again"),
    ],
)
def test_broken_assumptions_are_named(customers, change, message):
    df = customers[0]
    for column, expression in change.items():
        df = df.withColumn(column, F.expr(expression))
    with pytest.raises(models.ModelError, match=message):
        models.check_assumptions(df)


def test_sound_customers_pass(customers):
    assert models.check_assumptions(customers[0])["customers"] == 8000


def test_model_inputs_rename_age_and_select_eligible(customers):
    df, frame = customers
    inputs = models.purchase_frame(df).toPandas().sort_values("customer_id")
    assert (inputs["T"].to_numpy() == frame["customer_age"].to_numpy()).all()
    assert (inputs["recency"].to_numpy() == frame["recency"].to_numpy()).all()
    assert models.spend_frame(df).count() == (frame["frequency"] > 0).sum()


def test_predictions_cover_every_customer_at_every_horizon(customers, fits):
    df, frame = customers
    got = predict(df, *fits, [365, 273, 365]).toPandas()
    assert len(got) == 2 * len(frame) and sorted(got["horizon_days"].unique()) == [273, 365]
    assert np.allclose(
        got["expected_forward_revenue"], got["expected_purchases"] * got["expected_avg_value"]
    )
    wide = got.pivot(index="customer_id", columns="horizon_days", values="expected_purchases")
    assert (wide[365] > wide[273]).all()
    assert got["probability_alive"].between(0, 1).all()
    assert got["forward_revenue_hdi_low"].isna().all()
    fallback = got[got["spend_estimate_source"] == "population_mean"]
    assert fallback["expected_avg_value"].nunique() == 1
    assert set(fallback["customer_id"]) == set(frame[frame["frequency"] == 0]["customer_id"])


def test_native_columns_equal_the_kernels(customers, fits):
    df, frame = customers
    x, tx, T = (frame[c].to_numpy(float) for c in ("frequency", "recency", "customer_age"))
    for family, p in ((families.BG_NBD, BG), (families.MBG_NBD, MBG), (families.PARETO_NBD, PARETO)):
        fit = models.Fit(family, "map", dict(zip(families.PARAMETERS[family], p)), 0.0, 0, 0)
        got = df.select("customer_id", alive_column(fit).alias("p")).toPandas()
        want = families.probability_alive(family, p, x, tx, T)
        assert np.allclose(got.sort_values("customer_id")["p"], want, atol=1e-12)
    assert df.select(F.min(spend_column(fits[1]))).first()[0] > 0


def test_state_totals_equal_customer_totals(customers, fits):
    df, frame = customers
    states = models.stored_states(df)
    got = {r["length"]: r["expected"] for r in
           expected_over_states(states, fits[0], [100, 273]).collect()}
    x, tx, T = (frame[c].to_numpy(float) for c in ("frequency", "recency", "customer_age"))
    for length, value in got.items():
        want = families.expected_purchases(families.BG_NBD, fits[0].vector, x, tx, T, float(length))
        assert value == pytest.approx(want.sum())
    own = expected_over_states(states, fits[0], [], new_customer=True).first()["expected"]
    assert own == pytest.approx(float(frame["frequency"].sum()), rel=0.03)


def test_draws_are_seeded_and_bracket_the_optimum(customers, fits):
    df, _ = customers
    states = models.stored_states(df)
    first = draws.purchase_draws(states, fits[0], 100, seed=7)
    again = draws.purchase_draws(states, fits[0], 100, seed=7)
    assert np.allclose(first.points, again.points)
    spend = draws.spend_draws(df, fits[1], 100, seed=8)
    for sampled, fit in ((first, fits[0]), (spend, fits[1])):
        low, high = np.quantile(sampled.points, [0.01, 0.99], axis=0)
        assert ((low < np.array(fit.vector)) & (np.array(fit.vector) < high)).all()
    got = draws.predict_draws(df.where("customer_id < 300"), first, spend, [273]).toPandas()
    assert (got["forward_revenue_hdi_low"] < got["forward_revenue_hdi_high"]).all()
    assert got["expected_forward_revenue"].between(
        got["forward_revenue_hdi_low"] * 0.8, got["forward_revenue_hdi_high"] * 1.2
    ).all()
    assert (got["fit_method"] == draws.MCMC).all()


def test_hdi_is_the_narrowest_window(spark):
    generator = np.random.default_rng(2)
    values = [sorted(generator.gamma(2, 3, 200).tolist()) for _ in range(5)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    low, high = draws.hdi(F.col("v"))
    for row in df.select("i", low.alias("low"), high.alias("high")).collect():
        v = np.array(values[row["i"]])
        k = int(0.94 * len(v))
        best = int(np.argmin(v[k:] - v[: len(v) - k]))
        assert (row["low"], row["high"]) == (v[best], v[best + k])
        unordered = generator.permutation(v)[:, None]
        assert draws.hdi_rows(unordered) == (row["low"], row["high"])


def summary(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("monetary_value", F.round("monetary_value", 4).cast("decimal(18,4)"))


def test_calibration_fingerprint_sees_rotation(spark):
    frame = simulate(200, 9)
    plain = fingerprints.calibration_fingerprint(summary(spark, frame)).first().asDict()
    shuffled = fingerprints.calibration_fingerprint(
        summary(spark, frame.sample(frac=1, random_state=1)).repartition(5)
    ).first().asDict()
    assert plain == shuffled
    turned = frame.copy()
    turned["frequency"] = np.roll(turned["frequency"], 1)
    moved = fingerprints.calibration_fingerprint(summary(spark, turned)).first().asDict()
    assert moved["sum_frequency"] == plain["sum_frequency"]
    assert moved["weighted_frequency"] != plain["weighted_frequency"]
    rank = np.arange(1, 201)
    assert int(plain["weighted_recency"]) == int((rank * frame["recency"]).sum())


@pytest.mark.parametrize(
    "edit,changed",
    [
        ("expected_purchases * 1.167", "sum_expected_purchases"),
        (None, "weighted_expected_purchases"),
    ],
)
def test_prediction_fingerprint_sees_edits(spark, edit, changed):
    rows = [("s", c, h, float(c % 7 + h / 100), 0.5, 20.0, 3.0 * c) for c in range(30)
            for h in (273, 365)]
    columns = ("source string, customer_id long, horizon_days int, expected_purchases double, "
               "probability_alive double, expected_avg_value double, "
               "expected_forward_revenue double")
    df = spark.createDataFrame(rows, columns)
    plain = fingerprints.prediction_fingerprint(df).first().asDict()
    if edit:
        other = df.withColumn("expected_purchases", F.expr(edit))
    else:
        other = df.withColumn("customer_id", 29 - F.col("customer_id"))
        assert fingerprints.prediction_fingerprint(other).first()[
            "sum_expected_purchases"] == pytest.approx(plain["sum_expected_purchases"])
    assert fingerprints.prediction_fingerprint(other).first()[changed] != pytest.approx(
        plain[changed], rel=1e-9
    )
    swapped = df.withColumn("horizon_days", F.lit(638) - F.col("horizon_days"))
    after = fingerprints.prediction_fingerprint(swapped).first()
    assert after["horizon_weighted_expected_purchases"] != pytest.approx(
        plain["horizon_weighted_expected_purchases"], rel=1e-6
    )


def banana(points):
    """A bent ridge: the second coordinate follows the square of the first."""
    u, w = points[:, 0], points[:, 1]
    return -0.5 * (u**2 / 4 + (w - u**2 / 4) ** 2 / 0.25)


def test_chains_cover_a_bent_ridge_and_two_modes():
    generator = np.random.default_rng(3)
    proposals = generator.standard_normal((600, 2)) * 3
    logs = -0.5 * (proposals**2).sum(axis=1) / 9
    found = chains.sample(banana, chains.overdispersed(banana, proposals, logs, generator), generator)
    flat = found.states.reshape(-1, 2)
    assert found.rhat <= chains.LARGEST_RHAT and found.effective >= chains.LEAST_EFFECTIVE
    assert flat[:, 0].mean() == pytest.approx(0.0, abs=0.35)
    assert flat[:, 0].std() == pytest.approx(2.0, rel=0.15)
    assert flat[:, 1].mean() == pytest.approx(1.0, rel=0.25)
    residual = flat[:, 1] - flat[:, 0] ** 2 / 4
    assert residual.std() == pytest.approx(0.5, rel=0.1)

    def modes(points):
        return np.logaddexp(np.log(0.3) - 0.5 * ((points + 3) ** 2).sum(axis=1),
                            np.log(0.7) - 0.5 * ((points - 3) ** 2).sum(axis=1))

    proposals = generator.standard_normal((600, 2)) * 4
    logs = -0.5 * (proposals**2).sum(axis=1) / 16
    found = chains.sample(modes, chains.overdispersed(modes, proposals, logs, generator), generator)
    assert (found.states[:, :, 0] > 0).mean() == pytest.approx(0.7, abs=0.08)
    drawn = found.draws(500, generator)
    assert (drawn[:, 0] > 0).mean() == pytest.approx(0.7, abs=0.12)


def test_steps_from_one_evaluation_equal_steps_one_by_one(monkeypatch):
    """Evaluating ahead changes how often the target is asked, not the law of the chains."""
    generator = np.random.default_rng(0)
    starts = generator.standard_normal((chains.WALKERS, 1))
    means = []
    for moves in (1, 4):
        monkeypatch.setattr(chains, "MOVES", moves)
        rng, points = np.random.default_rng(5), starts
        values, seen = -0.5 * points[:, 0] ** 2, []
        for _ in range(2400 // moves):
            states, values = chains._advance(lambda x: -0.5 * x[:, 0] ** 2, points, values, starts, rng)
            points = states[-1]
            assert np.allclose(values, -0.5 * points[:, 0] ** 2)
            seen.append(states)
        flat = np.concatenate(seen)
        means.append((flat.mean(), flat.std(), (np.diff(flat[..., 0], axis=0) != 0).mean()))
    assert np.allclose(means[0], means[1], atol=0.03)
    assert means[1][0] == pytest.approx(0.0, abs=0.03) and means[1][1] == pytest.approx(1.0, abs=0.03)


def test_chains_that_cannot_agree_are_an_error(monkeypatch):
    monkeypatch.setattr(chains, "MOST_BLOCKS", 4)
    generator = np.random.default_rng(1)

    def apart(points):
        # Two islands with nothing between them, further apart than any step from one to the other.
        return np.where(np.abs(np.abs(points[:, 0]) - 1e3) < 1, 0.0, -np.inf)

    starts = np.where(np.arange(chains.WALKERS) % 2, 1e3, -1e3)[:, None] + generator.uniform(-1, 1, (chains.WALKERS, 1))
    monkeypatch.setattr(chains, "WHOLE_MOVES", 0.0)
    with pytest.raises(NotConverged):
        chains.sample(apart, (starts, apart(starts)), generator)
    with pytest.raises(ArithmeticError):
        chains.overdispersed(lambda x: np.full(len(x), -np.inf), starts, np.zeros(len(starts)), generator)


def test_diagnostics_of_known_chains():
    generator = np.random.default_rng(2)
    free = generator.standard_normal((400, 64, 1))
    assert chains.rhat(free) < 1.01 and chains.autocorrelation_time(free) < 1.3
    assert chains.rhat(free + 3 * (np.arange(64) % 2)[None, :, None]) > 1.3
    slow = np.empty((4000, 64, 1))
    slow[0] = generator.standard_normal((64, 1))
    for i in range(1, 4000):
        slow[i] = 0.9 * slow[i - 1] + np.sqrt(1 - 0.81) * generator.standard_normal((64, 1))
    assert chains.autocorrelation_time(slow) == pytest.approx(19.0, rel=0.1)


def test_draws_agree_between_seeds_and_with_a_long_run(customers, fits):
    df, frame = customers
    states = models.stored_states(df)
    first, second = (draws.purchase_draws(states, fits[0], 400, seed=s) for s in (1, 2))
    assert first.effective >= 400 and first.rhat <= chains.LARGEST_RHAT
    x, tx, T = (frame[c].to_numpy(float) for c in ("frequency", "recency", "customer_age"))
    distinct, n = np.unique(np.column_stack([x, tx, T]), axis=0, return_counts=True)
    center = models._prior_center(families.PARAMETERS[families.BG_NBD], float(T.mean()))

    def posterior(logs):
        p = tuple(np.exp(logs)[:, [j]] for j in range(4))
        value = families.log_likelihood(families.BG_NBD, p, *distinct.T) @ n
        return value + models._log_prior(center, logs)

    # A plain random walk, one chain, many steps.
    generator, at = np.random.default_rng(9), np.log(np.array(fits[0].vector))[None, :]
    root = np.linalg.cholesky(fits[0].covariance + 1e-12 * np.eye(4))
    value, seen = posterior(at)[0], []
    for _ in range(6000):
        ahead = at + 1.1 * generator.standard_normal((1, 4)) @ root.T
        fresh = posterior(ahead)[0]
        if np.log(generator.random()) < fresh - value:
            at, value = ahead, fresh
        seen.append(at[0])
    long = np.array(seen[500:])
    spread = long.std(axis=0)
    for sampled in (first, second):
        logs = np.log(sampled.points)
        assert (np.abs(logs.mean(axis=0) - long.mean(axis=0)) < 0.35 * spread).all()
        for level in (0.03, 0.97):
            assert (np.abs(np.quantile(logs, level, axis=0) - np.quantile(long, level, axis=0)) < 0.6 * spread).all()


def test_expectations_over_draws_are_sums_over_customers(customers, fits):
    df, frame = customers
    states = models.stored_states(df)
    points = np.array([fits[0].vector, BG, (0.9, 20.0, 0.4, 3.0)])
    got = {(r["length"], r["draw_id"]): r["expected"] for r in
           expected_over_draws(states, families.BG_NBD, points, [31, 90]).collect()}
    x, tx, T = (frame[c].to_numpy(float) for c in ("frequency", "recency", "customer_age"))
    assert len(got) == 6
    for (length, draw), value in got.items():
        want = families.expected_purchases(families.BG_NBD, tuple(points[draw]), x, tx, T, float(length))
        assert value == pytest.approx(want.sum())


def test_lengths_are_worked_out_per_count_and_age(spark, monkeypatch):
    # Forty states of two counts and one age, last bought on twenty days each.
    rows = [(x, day, 200, 1 + day % 3) for x in (1, 4) for day in range(100, 120)]
    states = spark.createDataFrame(rows, "frequency long, recency int, T int, n long").coalesce(1)
    points = np.array([BG, tuple(1.1 * v for v in BG)])
    kernel = families.expected_if_active

    def narrow(family, p, x, T, horizon):
        assert len(x) == 2, "a length was worked out per state"
        return kernel(family, p, x, T, horizon)

    x, tx, T, n = (np.array(c, dtype=float) for c in zip(*rows))
    want = {
        (t, i): float(families.expected_purchases(families.BG_NBD, tuple(q), x, tx, T, t) @ n)
        for t in (30, 60) for i, q in enumerate(points)
    }
    monkeypatch.setattr(families, "expected_if_active", narrow)
    got = expected_over_draws(states, families.BG_NBD, points, [30, 60]).collect()
    assert {(r["length"], r["draw_id"]): r["expected"] for r in got} == pytest.approx(want, rel=1e-12)


def test_likelihood_terms_are_worked_out_once_per_count_and_date(monkeypatch):
    generator = np.random.default_rng(6)
    x = generator.integers(0, 5, 3000).astype(float)
    T = generator.integers(50, 60, 3000).astype(float)
    tx = np.where(x > 0, np.floor(T * generator.random(3000)), 0.0)
    n = generator.integers(1, 9, 3000).astype(float)
    points = np.exp(generator.normal([1, 3, -1, 1], 2.0, (300, 4)))
    points[:3] = [[500.0, 1e5, 1e-8, 40.0], [1e-9, 1e-6, 2.0, 3.0], [1e306, 1e-300, 2.0, 3.0]]
    lost, seen = families._lost, []
    for family in families.PARAMETERS:
        some = points[:40] if family == families.PARETO_NBD else points
        with np.errstate(all="ignore"):
            expected = families.state_term(family, tuple(some[:, [j]] for j in range(4)), x, tx, T) @ n
        monkeypatch.setattr(
            families, "_lost", lambda f, p, x, tx: seen.append(np.broadcast(x, tx).size) or lost(f, p, x, tx)
        )
        got = families.state_totals(family, some, x, tx, T, n)
        monkeypatch.undo()
        sound = np.isfinite(expected)
        assert sound.sum() >= len(some) - 1 and np.allclose(got[sound], expected[sound], rtol=1e-13)
        assert not np.isfinite(got[~sound]).any()
    pairs = len(np.unique(np.column_stack([x, tx]), axis=0))
    # Three blocks of points for either family, and the sum over all states for a point without value.
    assert pairs < 300 and sorted(set(seen)) in ([pairs], [pairs, 3000]) and seen.count(pairs) == 6


def test_draw_forecasts_of_like_customers_are_worked_out_once(spark, monkeypatch):
    captured, original = [], F.pandas_udf
    monkeypatch.setattr(draws.F, "pandas_udf", lambda f, kind: captured.append(f) or original(f, kind))
    points = np.array([[0.4, 40.0, 0.8, 2.5], [0.6, 60.0, 0.5, 2.0], [0.5, 50.0, 0.7, 2.2]])
    purchase = draws.given(families.BG_NBD, families.PARAMETERS[families.BG_NBD], points)
    spend = draws.given(models.GAMMA_GAMMA, models.GAMMA_GAMMA_PARAMETERS, np.array([[6.0, 4.0, 15.0]] * 3))
    rows = [("s", i, i % 4, 10 * (i % 4), 90 + i % 5, 20.0, i % 4 > 0) for i in range(600)]
    frame = spark.createDataFrame(
        rows, "source string, customer_id long, frequency int, recency int, customer_age int, "
        "monetary_value double, is_gamma_gamma_eligible boolean",
    )
    forecasts = draws.predict_draws(frame, purchase, spend, [30, 60])
    got = {(r.customer_id, r.horizon_days): r for r in forecasts.collect()}
    assert len(got) == 1200
    for i, h in ((0, 30), (7, 60), (599, 30)):
        state = [np.array([float(v)]) for v in (rows[i][2], rows[i][3], rows[i][4])]
        expected = families.expected_purchases(families.BG_NBD, tuple(points.T[:, :, None]), *state, float(h)).mean()
        assert got[i, h].expected_purchases == pytest.approx(expected, rel=1e-12)
    # In one batch of all rows: a column of draws for each count, age and horizon.
    counted, ahead = [], families.expected_if_active
    drawn = captured[0]
    cell = drawn.__code__.co_freevars.index("ahead")
    monkeypatch.setattr(
        drawn.__closure__[cell], "cell_contents",
        lambda family, p, x, T, t: counted.append(np.size(x)) or ahead(family, p, x, T, t),
    )
    columns = frame.toPandas()
    series = [columns[c] for c in ("frequency", "recency", "customer_age", "monetary_value", "is_gamma_gamma_eligible")]
    assert len(drawn(*series, pd.Series([30] * 600))) == 600 and sum(counted) == 20


def test_draw_forecasts_run_where_the_package_is_not_installed(spark, monkeypatch, tmp_path):
    captured, original = [], F.pandas_udf
    monkeypatch.setattr(draws.F, "pandas_udf", lambda f, kind: captured.append(f) or original(f, kind))
    purchase = draws.given(families.BG_NBD, families.PARAMETERS[families.BG_NBD], np.full((3, 4), 0.5))
    spend = draws.given(models.GAMMA_GAMMA, models.GAMMA_GAMMA_PARAMETERS, np.full((3, 3), 4.0))
    frame = spark.createDataFrame([], "source string, customer_id long, frequency int, recency int, "
                                  "customer_age int, monetary_value double, is_gamma_gamma_eligible boolean")
    draws.predict_draws(frame, purchase, spend, [30])
    shipped = tmp_path / "drawn.pickle"
    shipped.write_bytes(cloudpickle.dumps(captured[0]))
    code = f"import pickle; pickle.load(open({str(shipped)!r}, 'rb'))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
