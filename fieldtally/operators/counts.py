"""Poisson and zero-inflated Poisson regression with normal priors.

The fit maximises the posterior by damped Newton steps. Each step is one
aggregate over the frame whose result is one row: the log posterior, its
gradient and its curvature. Only those sums, a few dozen numbers, reach the
driver. The curvature at the end gives the standard deviations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reusable

# Half width of a central 94% normal interval, in standard deviations.
_Z94 = 1.880793608151251


@dataclass(frozen=True)
class CountModel:
    """A fitted model: log mean = alpha + sum(beta * x).

    ``psi`` of the zero-inflated form is the share of the Poisson part, so an
    excess zero has probability ``1 - psi``. It is None for the plain form.
    """

    predictors: tuple[str, ...]
    alpha: float
    betas: tuple[float, ...]
    psi: float | None
    sds: tuple[float, ...]
    iterations: int
    log_posterior: float
    rows: int

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row per parameter: estimate, standard deviation, 3% and 97% bounds.

        The bounds are those of the normal approximation, for ``psi`` on the
        logit scale.
        """
        names = ["alpha", *[f"betas[{i}]" for i in range(len(self.betas))]]
        rows = [
            (name, i, label, est, sd, est - _Z94 * sd, est + _Z94 * sd)
            for i, (name, label, est, sd) in enumerate(
                zip(names, ("intercept", *self.predictors), (self.alpha, *self.betas), self.sds)
            )
        ]
        if self.psi is not None and self.psi >= 1.0:
            rows.append(("psi", len(rows), "poisson share", self.psi, 0.0, self.psi, self.psi))
        elif self.psi is not None:
            t, sd = math.log(self.psi / (1.0 - self.psi)), self.sds[-1]
            lo, hi = (1.0 / (1.0 + math.exp(-(t + s * _Z94 * sd))) for s in (-1, 1))
            rows.append(("psi", len(rows), "poisson share", self.psi, self.psi * (1.0 - self.psi) * sd, lo, hi))
        schema = "parameter string, position int, label string, mean double, sd double, `hdi_3%` double, `hdi_97%` double"
        return spark.createDataFrame(rows, schema)

    def linear_predictor(self) -> Column:
        return _linear(self.alpha, self.betas, self.predictors)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add ``mu``, the mean of the Poisson part, and the expected count."""
        share = 1.0 if self.psi is None else self.psi
        return df.withColumn("mu", F.exp(self.linear_predictor())).withColumn(name, F.lit(share) * F.col("mu"))


def _linear(alpha: float, betas, predictors) -> Column:
    out = F.lit(float(alpha))
    for b, p in zip(betas, predictors):
        out = out + F.lit(float(b)) * F.col(p)
    return out


def _moments(frame: DataFrame, predictors: list[str], theta: np.ndarray, zero_inflated: bool):
    """Log likelihood, gradient and Hessian at ``theta`` = (alpha, betas..., logit psi)."""
    p = len(predictors) + 1
    rows = frame.withColumn("_eta", _linear(theta[0], theta[1:p], predictors)).withColumn("_mu", F.exp("_eta"))
    y, eta, mu = F.col("_y"), F.col("_eta"), F.col("_mu")
    if zero_inflated:
        psi = 1.0 / (1.0 + math.exp(-theta[p]))
        # chance that a zero comes from the Poisson part
        poisson_zero = F.lit(psi) * F.exp(-mu)
        rows = rows.withColumn("_p0", F.lit(1.0 - psi) + poisson_zero).withColumn(
            "_r", F.when(y > 0, F.lit(1.0)).otherwise(poisson_zero / F.col("_p0"))
        )
        r = F.col("_r")
        rows = rows.withColumn("_v", r * (F.lit(1.0) - r))
        v = F.col("_v")
        loglik = F.when(y > 0, F.lit(math.log(psi)) + y * eta - mu).otherwise(F.log("_p0"))
        slope, curve = y - r * mu, v * mu * mu - r * mu
    else:
        loglik, slope, curve = y * eta - mu, y - mu, -mu
    rows = rows.withColumn("_slope", slope).withColumn("_curve", curve)

    def x(i: int) -> Column | None:
        return F.col(predictors[i - 1]) if i else None

    def times(c: Column, *factors: Column | None) -> Column:
        for f in factors:
            c = c if f is None else c * f
        return c

    sums = {"ll": loglik}
    for i in range(p):
        sums[f"g{i}"] = times(F.col("_slope"), x(i))
        for j in range(i + 1):
            sums[f"h{i}_{j}"] = times(F.col("_curve"), x(i), x(j))
    if zero_inflated:
        sums[f"g{p}"] = r - F.lit(psi)
        sums[f"h{p}_{p}"] = v - F.lit(psi * (1.0 - psi))
        for j in range(p):
            sums[f"h{p}_{j}"] = times(-mu * v, x(j))
    row = rows.agg(*[F.sum(c).alias(k) for k, c in sums.items()]).first()

    size = p + int(zero_inflated)
    gradient = np.array([row[f"g{i}"] for i in range(size)], dtype=float)
    hessian = np.zeros((size, size))
    for i in range(size):
        for j in range(i + 1):
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
    return float(row["ll"]), gradient, hessian


def _add_prior(ll, gradient, hessian, theta, prior_sd, zero_inflated):
    if prior_sd is None:
        return ll, gradient, hessian
    p = len(theta) - int(zero_inflated)
    precision = 1.0 / prior_sd**2
    ll = ll - 0.5 * precision * float(theta[:p] @ theta[:p])
    gradient, hessian = gradient.copy(), hessian.copy()
    gradient[:p] -= precision * theta[:p]
    hessian[np.arange(p), np.arange(p)] -= precision
    if zero_inflated:
        # a uniform psi, seen on the logit scale
        psi = 1.0 / (1.0 + math.exp(-theta[p]))
        ll += math.log(psi) + math.log1p(-psi)
        gradient[p] += 1.0 - 2.0 * psi
        hessian[p, p] -= 2.0 * psi * (1.0 - psi)
    return ll, gradient, hessian


def _fit(
    df: DataFrame,
    predictors: list[str],
    target: str,
    prior_sd: float | None,
    zero_inflated: bool,
    max_iterations: int,
    tolerance: float,
) -> CountModel:
    frame = reusable(
        df.select(*[F.col(c).cast("double").alias(c) for c in predictors], F.col(target).cast("double").alias("_y"))
        .na.drop()
    )
    try:
        start = frame.agg(
            F.count("*").alias("n"), F.avg("_y").alias("mean"), F.avg(F.when(F.col("_y") > 0, F.col("_y"))).alias("positive"),
            F.avg((F.col("_y") > 0).cast("double")).alias("share"), F.min("_y").alias("least"),
        ).first()
        if not start["n"]:
            raise ValueError("no complete rows to fit")
        if start["least"] < 0:
            raise ValueError("counts must not be negative")
        if not start["positive"] and prior_sd is None:
            raise ValueError("all counts are zero, so the mean has no finite estimate without a prior")
        if zero_inflated and prior_sd is None and start["share"] == 1.0:
            # without zeros the likelihood rises up to psi = 1, where the rest is a Poisson regression
            plain = _fit(df, predictors, target, None, False, max_iterations, tolerance)
            return replace(plain, psi=1.0, sds=(*plain.sds, 0.0))
        level = (start["positive"] if zero_inflated else start["mean"]) or 1e-3
        theta = np.zeros(len(predictors) + 1 + int(zero_inflated))
        theta[0] = math.log(level)
        if zero_inflated:
            share = min(max(start["share"], 0.05), 0.95)
            theta[-1] = math.log(share / (1.0 - share))

        def evaluate(t):
            return _add_prior(*_moments(frame, predictors, t, zero_inflated), t, prior_sd, zero_inflated)

        ll, gradient, hessian = evaluate(theta)
        damping = 0.0
        for iteration in range(1, max_iterations + 1):
            # judged in units of each parameter's own curvature, so neither rows nor scales of predictors count
            unit = np.abs(np.diag(hessian))
            unit = np.sqrt(np.where(unit > 0, unit, 1.0))
            information = -hessian / np.outer(unit, unit)
            least = float(np.linalg.eigvalsh(information)[0])
            shift = max(damping, 1e-8 - least if least < 1e-12 else 0.0)
            step = np.linalg.solve(information + shift * np.eye(len(theta)), gradient / unit) / unit
            gain = float(gradient @ step)
            if gain < tolerance and shift == 0.0:
                # the deviations are those at the estimate, not at the point before it
                theta = theta + step
                ll, gradient, hessian = evaluate(theta)
                theta = theta + np.linalg.solve(-hessian, gradient)
                break
            candidate = theta + step * min(1.0, 5.0 / float(np.max(np.abs(step))))
            new_ll, new_gradient, new_hessian = evaluate(candidate)
            if math.isfinite(new_ll) and np.all(np.isfinite(new_hessian)) and new_ll >= ll - 1e-9 * abs(ll):
                theta, ll, gradient, hessian = candidate, new_ll, new_gradient, new_hessian
                damping = 0.0 if damping < 1e-8 else damping / 10.0
            else:
                damping = max(10.0 * damping, 1e-7)
        else:
            raise RuntimeError(f"no convergence after {max_iterations} steps")
        sds = np.sqrt(np.diag(np.linalg.inv(-hessian)))
    finally:
        frame.unpersist()
    p = len(predictors) + 1
    return CountModel(
        predictors=tuple(predictors),
        alpha=float(theta[0]),
        betas=tuple(float(b) for b in theta[1:p]),
        psi=1.0 / (1.0 + math.exp(-theta[p])) if zero_inflated else None,
        sds=tuple(float(s) for s in sds),
        iterations=iteration,
        log_posterior=ll,
        rows=int(start["n"]),
    )


def fit_poisson(
    df: DataFrame, predictors: list[str], target: str = "count", prior_sd: float | None = 1.0,
    max_iterations: int = 50, tolerance: float = 1e-8,
) -> CountModel:
    """Poisson regression with log link; ``prior_sd`` None for plain maximum likelihood."""
    return _fit(df, predictors, target, prior_sd, False, max_iterations, tolerance)


def fit_zip(
    df: DataFrame, predictors: list[str], target: str = "count", prior_sd: float | None = 1.0,
    max_iterations: int = 100, tolerance: float = 1e-8,
) -> CountModel:
    """Zero-inflated Poisson regression; with a prior, ``psi`` is uniform beforehand.

    Rows with zero counts must be present for ``psi`` to mean anything: fill
    cell-day counts with :func:`fieldtally.operators.cells.fill_cell_days` first.
    """
    return _fit(df, predictors, target, prior_sd, True, max_iterations, tolerance)
