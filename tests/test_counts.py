"""Count models on simulated data with known parameters, and against Spark ML."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression

from fieldtally.operators.counts import fit_poisson, fit_zip


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 2))
    mu = np.exp(1.0 + 0.5 * x[:, 0] - 0.3 * x[:, 1])
    y = rng.poisson(mu)
    z = np.where(rng.random(4000) < 0.6, y, 0)
    rows = [(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, y, z)]
    return spark.createDataFrame([*rows, (None, 1.0, 3, 3)], "a double, b double, y int, z int").cache()


def test_poisson_equals_spark_ml(simulated):
    model = fit_poisson(simulated, ["a", "b"], "y", prior_sd=None)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(simulated.na.drop())
    glr = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", tol=1e-10, maxIter=50).fit(data)
    assert model.rows == 4000
    assert [model.alpha, *model.betas] == pytest.approx([glr.intercept, *glr.coefficients], abs=1e-6)
    errors = glr.summary.coefficientStandardErrors
    assert model.sds == pytest.approx((errors[-1], *errors[:-1]), rel=1e-4)


def test_prior_shrinks(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 3), (1.0, 9), (1.0, 11)], "x double, y int")
    free, tight = fit_poisson(df, ["x"], "y", None), fit_poisson(df, ["x"], "y", 0.1)
    assert free.alpha == pytest.approx(math.log(2)) and free.betas[0] == pytest.approx(math.log(5))
    assert abs(tight.betas[0]) < 0.5 * free.betas[0]


def test_zip_recovers(spark, simulated):
    model = fit_zip(simulated, ["a", "b"], "z")
    truth = [1.0, 0.5, -0.3]
    for estimate, sd, true in zip((model.alpha, *model.betas), model.sds, truth):
        assert abs(estimate - true) < 4 * sd and sd < 0.05
    assert model.psi == pytest.approx(0.6, abs=0.03)
    rows = {r.parameter: r for r in model.summary(spark).collect()}
    assert list(rows) == ["alpha", "betas[0]", "betas[1]", "psi"]
    assert all(r["hdi_3%"] < r["mean"] < r["hdi_97%"] for r in rows.values())
    assert 0 < rows["psi"]["hdi_3%"] and rows["psi"]["hdi_97%"] < 1
    got = model.predict(simulated.na.drop().limit(5)).collect()
    for r in got:
        mu = math.exp(model.alpha + model.betas[0] * r.a + model.betas[1] * r.b)
        assert (r.mu, r.prediction) == pytest.approx((mu, model.psi * mu))


def test_zip_is_a_stationary_point(simulated):
    """No small move in any direction raises the posterior, computed here with numpy."""
    model = fit_zip(simulated, ["a", "b"], "z")
    data = np.array([(r.a, r.b, r.z) for r in simulated.na.drop().collect()])

    def log_posterior(theta):
        psi = 1 / (1 + math.exp(-theta[3]))
        eta = theta[0] + data[:, :2] @ theta[1:3]
        mu, y = np.exp(eta), data[:, 2]
        ll = np.where(y > 0, math.log(psi) + y * eta - mu, np.log(1 - psi + psi * np.exp(-mu))).sum()
        return ll - 0.5 * (theta[:3] ** 2).sum() + math.log(psi) + math.log(1 - psi)

    best = np.array([model.alpha, *model.betas, math.log(model.psi / (1 - model.psi))])
    for i in range(4):
        for h in (-1e-3, 1e-3):
            moved = best.copy()
            moved[i] += h
            assert log_posterior(moved) < log_posterior(best)


def test_without_zeros_psi_is_near_one(spark):
    df = spark.createDataFrame([(float(i % 3), 1 + i % 4) for i in range(998)], "x double, y int")
    model = fit_zip(df, ["x"], "y")
    assert 0.98 < model.psi < 1


def test_bad_targets(spark):
    df = spark.createDataFrame([(1.0, -1), (2.0, 1)], "x double, y int")
    with pytest.raises(ValueError, match="negative"):
        fit_poisson(df, ["x"], "y")
    with pytest.raises(ValueError, match="complete"):
        fit_poisson(df.where("x > 9"), ["x"], "y")
    with pytest.raises(ValueError, match="zero"):
        fit_poisson(df.selectExpr("x", "0 as y"), ["x"], "y", prior_sd=None)


def test_zip_without_zeros_is_a_poisson_fit(spark):
    df = spark.createDataFrame([(float(i % 3), 1 + i % 4) for i in range(60)], "x double, count long")
    plain, inflated = fit_poisson(df, ["x"], prior_sd=None), fit_zip(df, ["x"], prior_sd=None)
    assert inflated.psi == 1.0 and inflated.alpha == plain.alpha and inflated.betas == plain.betas
    rows = {r.parameter: r for r in inflated.summary(spark).collect()}
    assert (rows["psi"]["mean"], rows["psi"]["sd"]) == (1.0, 0.0)


@pytest.mark.parametrize("tolerance", [1.0, 1e-8])
def test_deviations_are_those_at_the_estimate(simulated, tolerance):
    model = fit_poisson(simulated, ["a", "b"], "y", prior_sd=None, tolerance=tolerance)
    data = np.array([(1.0, r.a, r.b) for r in simulated.na.drop().collect()])
    mu = np.exp(data @ [model.alpha, *model.betas])
    expected = np.sqrt(np.diag(np.linalg.inv(data.T @ (data * mu[:, None]))))
    assert model.sds == pytest.approx(tuple(expected), rel=1e-3 if tolerance == 1.0 else 1e-10)


def test_large_counts_and_small_predictors_converge(spark):
    """What is known of a predictor may be little against the sum of all counts."""
    rows = [(1e-4 * (i % 2), 10**9 * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, count long")
    model = fit_zip(df, ["x"])
    assert model.alpha == pytest.approx(math.log(1.5e9), abs=1e-3) and model.psi == pytest.approx(9 / 14, abs=1e-6)
