"""Posterior draws against quadrature."""

import math

import numpy as np
import pytest

from fieldtally.operators import posterior as po
from fieldtally.operators.counts import fit_poisson, fit_zip


@pytest.fixture(scope="module")
def few(spark):
    """Few, mostly positive counts: psi is close to 1 and its posterior is skewed."""
    counts = [0] + [1, 2, 2, 3, 4, 2, 1, 3, 5, 2, 3]
    return spark.createDataFrame([(c,) for c in counts], "count int").repartition(3), np.array(counts)


def quadrature(counts):
    """psi's mean, sd and narrowest 94 % interval by summing the posterior over a grid."""
    alpha, psi = np.linspace(-2, 3, 800)[:, None], np.linspace(0.0005, 0.9995, 1000)[None, :]
    mu = np.exp(alpha)
    ll = -0.5 * alpha**2 + 0 * psi
    for y in counts:
        ll = ll + (np.log(psi) + y * alpha - mu if y else np.log(1 - psi + psi * np.exp(-mu)))
    share = np.exp(ll - ll.max()).sum(axis=0)
    share, grid = share / share.sum(), psi[0]
    mean = (share * grid).sum()
    order = np.argsort(-share)
    held = grid[order[: np.searchsorted(np.cumsum(share[order]), 0.94) + 1]]
    return mean, math.sqrt((share * (grid - mean) ** 2).sum()), held.min(), held.max()


def test_skewed_share_as_by_quadrature(spark, few):
    df, counts = few
    model = fit_zip(df, [], "count")
    draws = po.draw_posterior(df, model, draws=4000, chains=2, proposals=8000, seed=1)
    assert max(draws.pareto_k) < 0.7 and min(draws.effective) > 2000
    row = {r.parameter: r for r in draws.summary(spark).collect()}["psi"]
    mean, sd, low, high = quadrature(counts)
    assert (row["mean"], row["sd"], row["hdi_3%"], row["hdi_97%"]) == pytest.approx((mean, sd, low, high), abs=0.015)
    assert abs(row["r_hat"] - 1) < 0.01 and row["mcse_mean"] < 0.005
    normal = {r.parameter: r for r in model.summary(spark).collect()}["psi"]
    assert abs(normal["hdi_97%"] - high) > 0.015 or abs(normal["hdi_3%"] - low) > 0.03  # what the normal form misses


def test_many_rows_agree_with_the_normal_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000).round(1)
    y = rng.poisson(np.exp(0.7 + 0.4 * x))
    df = spark.createDataFrame([*[(float(a), int(b)) for a, b in zip(x, y)], (None, 1)], "x double, count int")
    model = fit_poisson(df, ["x"])
    draws = po.draw_posterior(df, model, draws=2000, seed=2)
    rows = {r.parameter: r for r in draws.summary(spark).collect()}
    for name, estimate, sd in zip(("alpha", "betas[0]"), (model.alpha, *model.betas), model.sds):
        assert rows[name]["mean"] == pytest.approx(estimate, abs=0.15 * sd) and rows[name]["sd"] == pytest.approx(sd, rel=0.08)
    got = draws.predict(df.limit(20)).collect()
    for r in got:
        assert r.prediction is None if r.x is None else r.prediction_low < math.exp(model.alpha + model.betas[0] * r.x) < r.prediction_high


def test_log_likelihoods_add_up(spark, few):
    df, counts = few
    rng = np.random.default_rng(4)
    theta = rng.normal(size=(5, 2))
    frame = df.selectExpr("cast(count as double) as _y").groupBy("_y").count().withColumnRenamed("count", "_times")
    got = po.log_likelihoods(frame, [], theta, True)
    for t, ll in zip(theta, got):
        psi, mu = 1 / (1 + math.exp(-t[1])), math.exp(t[0])
        assert ll == pytest.approx(sum(math.log(psi) + y * t[0] - mu if y else math.log(1 - psi + psi * math.exp(-mu)) for y in counts))


def test_pareto_shape_is_found():
    rng = np.random.default_rng(5)
    for shape in (0.2, 0.6, 0.9):
        sample = np.sort(np.expm1(-shape * np.log1p(-rng.random(20000))) / shape)
        assert po.pareto_fit(sample)[0] == pytest.approx(shape, abs=0.04)
    weights, k = po.smoothed(rng.normal(size=4000))
    assert weights.sum() == pytest.approx(1) and k < 0.7


def test_summary_of_draws(spark):
    rng = np.random.default_rng(6)
    rows = [(c, i, "a", float(rng.gamma(2))) for c in range(2) for i in range(500)]
    rows += [(c, i, "b", float(c * 5 + rng.normal())) for c in range(2) for i in range(500)]  # chains that disagree
    rows += [(0, 0, "c", 1.0), (0, 1, "c", None), (0, 0, "d", 2.0)]
    got = {r.p: r for r in po.summarise_draws(spark.createDataFrame(rows, "chain int, draw int, p string, value double"), ["p"]).collect()}
    x = np.sort([r[3] for r in rows if r[2] == "a"])
    inside = int(0.94 * len(x))
    first = int(np.argmin(x[inside:] - x[: len(x) - inside]))
    assert (got["a"]["hdi_3%"], got["a"]["hdi_97%"]) == (x[first], x[first + inside])
    assert got["a"]["r_hat"] < 1.02 < 2 < got["b"]["r_hat"]
    assert got["c"]["mean"] == 1.0 and got["c"]["r_hat"] is None and got["d"]["mean"] == 2.0
