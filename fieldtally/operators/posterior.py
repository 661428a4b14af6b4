"""Draws from the posterior of a count model, and summaries of draws.

The fitted mode and its curvature give a proposal: a Student t distribution, whose tails are wider than
the posterior's. One aggregate over the frame gives the log posterior at all proposals: rows
with equal counts and predictors are one beforehand, each task adds up its part for all proposals, and sums by proposal are all that
reaches the driver (``chains * proposals`` numbers, however many rows the frame has). Importance weights are
smoothed by a generalised Pareto distribution fitted to the largest of them, whose shape ``pareto_k`` tells whether the
proposal fits (below 0.7 it does). Chains are proposed, weighted and drawn apart from each other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reusable
from .counts import CountModel, _add_prior, _moments

FREEDOM = 7  # degrees of freedom of the proposal
PROBABILITY = 0.94  # that the narrowest interval holds
CELLS = 2_000_000  # rows times proposals that a task works on at once


@dataclass(frozen=True)
class Draws:
    """values: [chain][draw][parameter], psi as a share; pareto_k and effective (draws that the weights are worth) by chain."""

    model: CountModel
    values: np.ndarray
    pareto_k: tuple[float, ...]
    effective: tuple[float, ...]

    def names(self) -> list[tuple[str, str]]:
        names = [("alpha", "intercept"), *[(f"betas[{i}]", label) for i, label in enumerate(self.model.predictors)]]
        return names if self.model.psi is None else [*names, ("psi", "poisson share")]

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per chain, draw and parameter."""
        rows = [
            (chain, draw, i, name, label, float(self.values[chain, draw, i]))
            for chain in range(self.values.shape[0])
            for draw in range(self.values.shape[1])
            for i, (name, label) in enumerate(self.names())
        ]
        return spark.createDataFrame(rows, "chain int, draw int, position int, parameter string, label string, value double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row per parameter: mean, sd, narrowest interval, r_hat, effective size and the error of the mean."""
        out = summarise_draws(self.frame(spark), ["parameter", "position", "label"])
        size = min(sum(self.effective), float(self.values.shape[0] * self.values.shape[1]))
        return out.withColumn("mcse_mean", F.col("sd") / math.sqrt(size)).withColumn("ess_bulk", F.lit(size))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the expected count averaged over draws, and the bounds of the middle 94 % of them."""
        flat = self.values.reshape(-1, self.values.shape[2])
        p = len(self.model.predictors) + 1
        share = flat[:, p] if self.model.psi is not None else np.ones(len(flat))
        columns = list(self.model.predictors)
        low, high = (1 - PROBABILITY) / 2, (1 + PROBABILITY) / 2

        def run(batches):
            for whole in batches:
                step = max(1, CELLS // len(flat))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    x = _matrix(batch, columns)
                    counts = np.exp(flat[:, 0] + x @ flat[:, 1:p].T) * share
                    bounds = np.quantile(counts, [low, high], axis=1)
                    found = [pa.array(v, mask=np.isnan(v)) for v in (counts.mean(axis=1), *bounds)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *found], schema.names)

        schema = T.StructType([*df.schema, *(T.StructField(n, T.DoubleType()) for n in ("prediction", "prediction_low", "prediction_high"))])
        return df.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(values, 1) if values else np.empty((batch.num_rows, 0))


def log_likelihoods(frame: DataFrame, predictors: list[str], theta: np.ndarray, zero_inflated: bool) -> np.ndarray:
    """The log likelihood at each row of ``theta`` = (alpha, betas..., logit psi), without the counts' own constant.

    ``frame``: the predictors, ``_y`` and ``_times``, how many rows are alike.
    """
    p = len(predictors) + 1

    def run(batches):
        total = np.zeros(len(theta))
        for whole in batches:
            step = max(1, CELLS // len(theta))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                y, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_y", "_times"))
                eta = theta[:, 0] + _matrix(batch, predictors) @ theta[:, 1:p].T
                with np.errstate(over="ignore"):
                    mu = np.exp(eta)
                ll = y[:, None] * eta - mu
                if zero_inflated:
                    psi = 1 / (1 + np.exp(-theta[:, p]))
                    ll = np.where(y[:, None] > 0, np.log(psi) + ll, np.log(1 - psi + psi * np.exp(-mu)))
                total += times @ ll
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(theta), dtype=np.int32)), pa.array(total)], ["proposal", "ll"])

    sums = frame.mapInArrow(run, "proposal int, ll double").groupBy("proposal").agg(F.sum("ll").alias("ll")).collect()
    out = np.zeros(len(theta))
    for proposal, ll in sums:
        out[proposal] = ll if math.isfinite(ll) else -math.inf
    return out


def draw_posterior(
    df: DataFrame, model: CountModel, target: str = "count", prior_sd: float | None = 1.0,
    draws: int = 500, chains: int = 2, proposals: int = 4000, seed: int = 0,
) -> Draws:
    """Draws from the posterior of ``model``, fitted to ``df`` with the same target and prior."""
    predictors, zero_inflated = list(model.predictors), model.psi is not None
    if zero_inflated and model.psi >= 1.0:
        raise ValueError("without zeros and prior the share of zeros is not known; draw from a Poisson fit")
    columns = [F.col(c).cast("double").alias(c) for c in predictors]
    rows = df.select(*columns, F.col(target).cast("double").alias("_y")).na.drop()
    frame = reusable(rows.groupBy(*predictors, "_y").agg(F.count("*").alias("_times")))
    try:
        mode = np.array([model.alpha, *model.betas, *([math.log(model.psi / (1 - model.psi))] if zero_inflated else [])])
        spread = frame.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("col")
        curvature = _add_prior(*_moments(spread, predictors, mode, zero_inflated), mode, prior_sd, zero_inflated)[2]
        scale = np.linalg.cholesky(np.linalg.inv(-curvature))
        random = np.random.default_rng(seed)
        normal = random.standard_normal((chains, proposals, len(mode)))
        chi = random.chisquare(FREEDOM, (chains, proposals)) / FREEDOM
        step = normal / np.sqrt(chi)[..., None]
        theta = mode + step @ scale.T
        proposed = -0.5 * (FREEDOM + len(mode)) * np.log1p((step**2).sum(axis=2) / FREEDOM)
        found = log_likelihoods(frame, predictors, theta.reshape(-1, len(mode)), zero_inflated)
    finally:
        frame.unpersist()
    prior = [_add_prior(0.0, np.zeros(len(mode)), -curvature, t, prior_sd, zero_inflated)[0] for t in theta.reshape(-1, len(mode))]
    ratio = (found + np.array(prior)).reshape(chains, proposals) - proposed
    if zero_inflated:
        theta[..., -1] = 1 / (1 + np.exp(-theta[..., -1]))
    values, shapes, sizes = [], [], []
    for chain in range(chains):
        weights, k = smoothed(ratio[chain])
        ladder = (random.random() + np.arange(draws)) / draws
        chosen = np.minimum(np.searchsorted(np.cumsum(weights), ladder), proposals - 1)
        values.append(theta[chain][random.permutation(chosen)])
        shapes.append(k)
        sizes.append(float(1 / (weights**2).sum()))
    return Draws(model, np.array(values), tuple(shapes), tuple(sizes))


def smoothed(log_weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that add up to 1, the largest replaced by the expected order statistics of a generalised Pareto distribution, and its shape."""
    weights = np.exp(log_weights - log_weights.max())
    order = np.argsort(weights, kind="stable")
    tail = order[-int(min(0.2 * len(weights), 3 * math.sqrt(len(weights)))) :]
    k = math.nan
    if len(tail) >= 5:
        cut = weights[order[-len(tail) - 1]]
        k, sigma = pareto_fit(weights[tail] - cut)
        if math.isfinite(k):
            chance = (np.arange(len(tail)) + 0.5) / len(tail)
            expected = sigma * np.expm1(-k * np.log1p(-chance)) / k if abs(k) > 1e-9 else -sigma * np.log1p(-chance)
            weights[tail] = np.minimum(cut + expected, 1.0)
    return weights / weights.sum(), k


def pareto_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution (Zhang and Stephens 2009), the shape drawn towards one half by ten observations."""
    n = len(excess)
    x = np.maximum(excess, 1e-300)
    steps = np.arange(1, 30 + int(math.sqrt(n)) + 1)
    b = 1 / x[-1] + (1 - np.sqrt(len(steps) / (steps - 0.5))) / (3 * x[max(0, int(n / 4 + 0.5) - 1)])
    b = b[(np.abs(b) > 1e-12) & np.isfinite(b)]
    k = np.log1p(-b[:, None] * x).mean(axis=1)
    gain = n * (np.log(-b / k) - k - 1)
    weight = 1 / np.exp(np.clip(gain[None, :] - gain[:, None], -700, 700)).sum(axis=1)
    best = float((b * weight).sum() / weight.sum())
    shape = float(np.log1p(-best * x).mean())
    return (shape * n + 5) / (n + 10), -shape / best


def summarise_draws(draws: DataFrame, keys: list[str], probability: float = PROBABILITY) -> DataFrame:
    """Per group of ``keys``: mean, sd, the narrowest interval that holds the probability, and r_hat of half chains.

    ``draws`` has chain, draw and value; a group's draws are sorted in one place, which a sampler's few thousand allow.
    r_hat is null where chains are too short or do not vary.
    """
    whole = draws.where(F.col("value").isNotNull())
    values = whole.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sort_array(F.collect_list("value")).alias("_sorted")
    )
    inside = F.floor(F.size("_sorted") * F.lit(probability)).cast("int")
    starts = F.sequence(F.lit(1), F.size("_sorted") - inside)
    value_at = lambda i: F.element_at("_sorted", i)
    widths = F.transform(starts, lambda i: F.struct((value_at(i + inside) - value_at(i)).alias("width"), i.alias("i")))
    values = values.withColumn("_first", F.when(inside < F.size("_sorted"), F.array_min(widths)["i"]))
    half = F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("draw", "value")) * 2 > F.count("*").over(Window.partitionBy(*keys, "chain"))
    parts = whole.withColumn("_half", half).groupBy(*keys, "chain", "_half")
    parts = parts.agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    across = parts.groupBy(*keys).agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    r_hat = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within"))
    across = across.select(*keys, F.when(F.col("within") > 0, r_hat).alias("r_hat"))
    return values.join(across, keys).select(
        *keys, "mean", "sd", value_at(F.col("_first")).alias("hdi_3%"), value_at(F.col("_first") + inside).alias("hdi_97%"), "r_hat"
    )
