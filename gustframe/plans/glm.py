"""Logistic regression by Fisher scoring, with the summary of the fit.

Every step is one map-side aggregation of the rows: log-likelihood, score and
information at the current coefficients, p * (p + 3) / 2 + 1 sums for p features.
Only these reach the driver, which solves a p x p system.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = "intercept"
Z95 = 1.959963984540054  # normal quantile of 0.975


@dataclass(frozen=True)
class LogitFit:
    """Coefficients with their covariance (the inverse information)."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    covariance: np.ndarray
    n: int
    log_likelihood: float
    null_log_likelihood: float
    iterations: int
    converged: bool

    @property
    def std_errors(self) -> tuple[float, ...]:
        return tuple(float(x) for x in np.sqrt(np.diag(self.covariance)))

    def summary(self, spark: SparkSession) -> DataFrame:
        """feature, coefficient, std_error, z, p_value, low, high (95 %), one row a feature."""
        rows = []
        for f, b, s in zip(self.features, self.coefficients, self.std_errors, strict=True):
            z = b / s
            rows.append((f, b, s, z, math.erfc(abs(z) / math.sqrt(2)), b - Z95 * s, b + Z95 * s))
        return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, z double, p_value double, low double, high double")

    def statistics(self, spark: SparkSession) -> DataFrame:
        """One row: n, both log-likelihoods, McFadden's pseudo R2, AIC, BIC, iterations, converged."""
        p, ll = len(self.features), self.log_likelihood
        r2 = 1 - ll / self.null_log_likelihood if self.null_log_likelihood else None
        row = (self.n, ll, self.null_log_likelihood, r2, 2 * p - 2 * ll, p * math.log(self.n) - 2 * ll, self.iterations, self.converged)
        return spark.createDataFrame([row], "n long, log_likelihood double, null_log_likelihood double, pseudo_r2 double, aic double, "
                                            "bic double, iterations int, converged boolean")

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the probability of label 1; NULL if a feature is NULL."""
        eta = F.lit(0.0)
        for f, b in zip(self.features, self.coefficients, strict=True):
            eta = eta + (F.lit(b) if f == INTERCEPT else F.col(f"`{f}`").cast("double") * F.lit(b))
        return df.withColumn(out, 1 / (1 + F.exp(-eta)))


def fit_logit(df: DataFrame, label: str, features, intercept: bool = False, max_iter: int = 50, tolerance: float = 1e-12) -> LogitFit:
    """Maximum-likelihood fit of label (0 / 1) on ``features``.

    Rows with a NULL or NaN in the label or a feature take no part.  A step that
    lowers the likelihood is halved.  ``converged`` is False if the likelihood still
    rose at the end, as for classes that a plane separates.  No rows, or features of
    which one is a combination of others, raise ValueError.
    """
    features = list(features)
    names = [*features, INTERCEPT] if intercept else features
    real = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    rows = df.select(real(label).alias("y"), *[real(c).alias(f"x{i}") for i, c in enumerate(features)]).dropna()
    if intercept:
        rows = rows.withColumn(f"x{len(features)}", F.lit(1.0))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(rows, names, intercept, max_iter, tolerance)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, names: list[str], intercept: bool, max_iter: int, tolerance: float) -> LogitFit:
    p = len(names)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[F.max(F.abs(f"x{i}")).alias(f"m{i}") for i in range(p)]).first()
    n = first["n"]
    if n == 0:
        raise ValueError("no rows without NULLs to fit")
    scale = np.array([first[f"m{i}"] or 1.0 for i in range(p)])  # features between -1 and 1
    x = [F.col(f"x{i}") / F.lit(float(s)) for i, s in enumerate(scale)]
    cells = [(i, j) for i in range(p) for j in range(i, p)]

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-F.col("eta")))
        weighed = rows.select("*", eta.alias("eta")).withColumns({"r": F.col("y") - mu, "w": mu * (1 - mu)})
        gain = F.col("y") * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))
        got = weighed.agg(F.sum(gain), *[F.sum(F.col("r") * c) for c in x], *[F.sum(F.col("w") * x[i] * x[j]) for i, j in cells]).first()
        info = np.zeros((p, p))
        for (i, j), v in zip(cells, got[1 + p:], strict=True):
            info[i, j] = info[j, i] = v
        return got[0], np.array(got[1:1 + p]), info

    beta = np.zeros(p)
    ll, score, info = at(beta)
    if np.linalg.cond(info) > 1e13:
        raise ValueError(f"features are combinations of each other: {names}")
    done, steps = False, 0
    while not done and steps < max_iter and np.linalg.cond(info) < 1e13:
        step = np.linalg.solve(info, score)
        done = float(score @ step) <= tolerance * (1 + abs(ll))
        for _ in range(30):
            new = at(beta + step)
            if new[0] >= ll - 1e-12 * abs(ll):
                break
            step = step / 2
        beta, (ll, score, info), steps = beta + step, new, steps + 1
    share = first["ones"] / n
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share) if 0 < share < 1 else 0.0) if intercept else -n * math.log(2)
    covariance = np.linalg.pinv(info) / np.outer(scale, scale)
    return LogitFit(tuple(names), tuple(float(b) for b in beta / scale), covariance, n, ll, null, steps, done)
