"""Logistic regression: coefficients and errors against numpy, and edge tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gustframe.plans import glm


def brute(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (m * (1 - m))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (y - m))
    m = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (m * (1 - m))[:, None])))), float(np.sum(y * np.log(m) + (1 - y) * np.log(1 - m)))


def sample(n: int = 500):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=n), 1000 * rng.normal(size=n) + 300, rng.exponential(size=n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.8, 0.001, -0.5])))).astype(float)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")


@pytest.mark.parametrize("intercept", [False, True])
def test_fit_equals_brute_force(spark, intercept):
    x, y = sample()
    df = frame(spark, x, y).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, math.nan, 1.0, 0.0), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double"))
    fit = glm.fit_logit(df, "y", ["a", "b", "c"], intercept)
    beta, errors, ll = brute(np.column_stack([x, np.ones(len(x))]) if intercept else x, y)
    assert fit.converged and fit.n == len(x)
    assert np.allclose(fit.coefficients, beta, rtol=1e-8) and np.allclose(fit.std_errors, errors, rtol=1e-7) and math.isclose(fit.log_likelihood, ll, rel_tol=1e-10)
    rows = fit.summary(spark).collect()
    assert [r.feature for r in rows] == ["a", "b", "c"] + ["intercept"] * intercept
    assert all(math.isclose(r.z, r.coefficient / r.std_error) and 0 <= r.p_value <= 1 and r.low < r.coefficient < r.high for r in rows)
    st = fit.statistics(spark).first()
    assert st.n == len(x) and 0 < st.pseudo_r2 < 1 and st.converged
    scored = fit.score(df).collect()
    assert sum(r.score is None for r in scored) == 1  # the NULL feature


def test_separated_combined_and_empty(spark):
    apart = spark.createDataFrame([(float(i), float(i > 0)) for i in range(-20, 21) if i], "a double, y double")
    assert not glm.fit_logit(apart, "y", ["a"], max_iter=8).converged
    x, y = sample(50)
    df = frame(spark, x, y)
    with pytest.raises(ValueError, match="combinations"):
        glm.fit_logit(df.selectExpr("*", "a + b as d"), "y", ["a", "b", "d"])
    with pytest.raises(ValueError, match="no rows"):
        glm.fit_logit(df.limit(0), "y", ["a"])
