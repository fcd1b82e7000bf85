"""What the fits rest on: the series near one, the spend fit on ordinary data, exact source names."""

from __future__ import annotations

import numpy as np
import pytest

from returnwise.functions.numeric import gauss_one, gauss_series, log_rising
from returnwise.models import families
from returnwise.models.fit import fit_gamma_gamma, fit_states
from returnwise.models.optimizer import maximise
from returnwise.sources.store import Store


@pytest.mark.parametrize("z", [0.5, 0.94, 0.96, 0.999, 0.99999, 1 - 1e-9])
def test_series_and_integral_agree_with_the_logarithm(z):
    # 2F1(1, 1; 2; z) = -ln(1 - z) / z
    got = gauss_one(np.array([1.0]), np.array([2.0]), np.array([z]))[0]
    assert got == pytest.approx(-np.log1p(-z) / z, rel=1e-9)


def test_integral_meets_the_series_where_both_converge():
    b, c = np.array([0.3, 1.7, 4.0, 11.5]), np.array([1.9, 3.2, 5.5, 13.0])
    assert gauss_one(b, c, 0.97) == pytest.approx(gauss_series(1.0, b, c, 0.97), rel=1e-9)


def test_a_series_that_has_not_converged_is_an_error():
    with pytest.raises(ArithmeticError):
        gauss_series(1.0, 1.0, 2.0, 0.99999)


@pytest.mark.parametrize("count", [2000, 8000])
@pytest.mark.parametrize("seed", [1, 2])
def test_spend_fit_recovers_ordinary_data(spark, count, seed):
    p, q, v = 6.25, 3.74, 15.44
    generator = np.random.default_rng(seed)
    x = 1 + generator.poisson(3, count)
    rate = generator.gamma(q, 1 / v, count)
    z = generator.gamma(p * x, 1 / (rate * x))
    frame = spark.createDataFrame(
        [("s", i, int(a), float(b), True) for i, (a, b) in enumerate(zip(x, z))],
        "source string, customer_id long, frequency int, monetary_value double, is_gamma_gamma_eligible boolean",
    )
    fit = fit_gamma_gamma(frame)
    got = fit.parameters
    assert got["p"] * got["v"] / (got["q"] - 1) == pytest.approx(p * v / (q - 1), rel=0.06)
    assert got["q"] == pytest.approx(q, rel=0.2)


def test_source_names_are_kept_exactly(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = ["007", "7", "1e3", "2024-01-01", "a"]
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, n int")
    store.overwrite("main.names", frame)
    store.replace_sources("main.names", frame.where("source = '7'").selectExpr("source", "n + 10 as n"))
    got = {r.source: r.n for r in store.read("main.names").collect()}
    assert got == {"007": 0, "7": 11, "1e3": 2, "2024-01-01": 3, "a": 4}
    assert [r.n for r in store.read("main.names", "007").collect()] == [0]


def test_a_search_reaches_the_end_of_a_ridge_that_only_a_weak_prior_ends():
    # Curvatures as large populations have them: a prior's share of one customer in a million.
    curvature = np.array([8.0, 2e-5, 1.6e-7])
    top = np.array([1.0, -2.0, 4.0])

    def evaluate(points):
        return -25.0 - 0.5 * ((points - top) ** 2) @ curvature

    found = maximise(evaluate, np.zeros(3), tolerance=1e-12)
    assert found.point == pytest.approx(top, abs=0.01)
    assert found.jobs <= 30


def test_a_quotient_of_gammas_keeps_its_digits():
    for base in (0.3, 11.0, 12.5, 455.0, 185_000.0, 1e9):
        steps = np.arange(16.0)
        want = np.concatenate([[0.0], np.cumsum(np.log(base + steps[:-1]))])
        assert log_rising(base, steps) == pytest.approx(want, rel=1e-13, abs=1e-13)


@pytest.mark.parametrize("family", [families.BG_NBD, families.MBG_NBD, families.PARETO_NBD])
def test_regular_buyers_are_fitted_however_many_there_are(spark, family):
    # Nobody drops out and all buy alike, so the parameters run along a ridge to the prior's hold.
    counts = {0: 7, 1: 34, 2: 84, 3: 140, 4: 175, 5: 175, 6: 146, 7: 104, 8: 65, 9: 36, 10: 18}
    rows = [
        (x, T * x // (x + 1), T, n * 1000) for x, n in counts.items() for T in (900, 1000, 1100)
    ]
    states = spark.createDataFrame(rows, "frequency long, recency int, T int, n long")
    fit = fit_states(states, family)
    assert fit.customers == sum(counts.values()) * 3000
    assert fit.parameters["r"] / fit.parameters["alpha"] == pytest.approx(0.005, rel=0.05)


@pytest.mark.parametrize("count", [200_000])
def test_spend_of_customers_who_all_spend_alike_is_fitted(spark, count):
    # Their order values differ by less than any population's would: the scale runs far above them.
    rows = spark.range(count).selectExpr(
        "id as customer_id", "true as is_gamma_gamma_eligible", "1 + id % 9 as frequency",
        "250000 + (pmod(id * 7919, 1001) - 500) * 400 / sqrt(1 + id % 9) as monetary_value",
    )
    fit = fit_gamma_gamma(rows)
    p, q, v = fit.vector
    assert p * v / (q - 1) == pytest.approx(250_000, rel=0.01)
