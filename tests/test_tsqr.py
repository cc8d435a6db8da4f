"""Least squares by QR against numpy, equal columns, edge tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gustframe.plans import tsqr


def frame(spark, x, y, parts=7):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts), names


def sample(n=400):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=n), 1e6 + rng.normal(size=n), 1e-4 * rng.exponential(size=n)])
    return x, x @ [2.0, -0.5, 3e3] + 4 + rng.normal(size=n)


@pytest.mark.parametrize("slots", [(4096, 64), (3, 2)])
def test_fit_equals_numpy(spark, monkeypatch, slots):
    monkeypatch.setattr(tsqr, "SLOTS", slots)
    x, y = sample()
    df, names = frame(spark, x, y)
    extra = spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, math.nan, 1.0, 1.0), (1.0, 1.0, 1.0, None)], df.schema)
    fit = tsqr.fit_linear(df.unionByName(extra), "y", names)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert fit.n == len(x) and fit.rank == 3
    assert np.allclose(fit.coefficients, beta, rtol=1e-6)
    assert math.isclose(fit.intercept, y.mean() - x.mean(0) @ beta, rel_tol=1e-6)
    assert math.isclose(fit.residual_ss, float(((yc - xc @ beta) ** 2).sum()), rel_tol=1e-6)
    assert math.isclose(fit.r2, 1 - ((yc - xc @ beta) ** 2).sum() / (yc @ yc), rel_tol=1e-6)
    got = np.array([r.prediction for r in fit.score(df).select("prediction").collect()])
    assert math.isclose(got.mean(), y.mean(), rel_tol=1e-9)


def test_equal_columns_share_their_weight(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    x = np.column_stack([a, a, 2 * np.ones(300)])  # two equal columns and a constant one
    df, names = frame(spark, x, 6 * a + 1 + 0.01 * rng.normal(size=300))
    fit = tsqr.fit_linear(df, "y", names)
    assert fit.rank == 1 and fit.coefficients[0] == pytest.approx(fit.coefficients[1], rel=1e-9)
    assert fit.coefficients[0] == pytest.approx(3, abs=0.01) and fit.coefficients[2] == pytest.approx(0, abs=1e-9)
    assert fit.intercept == pytest.approx(1, abs=0.01)


def test_few_rows_no_features_and_empty(spark):
    df, names = frame(spark, np.array([[1.0, 2.0], [2.0, 1.0]]), np.array([3.0, 5.0]))
    fit = tsqr.fit_linear(df, "y", names)  # two rows, three unknowns: the least norm
    assert fit.rank == 1 and np.allclose(fit.coefficients, [1, -1]) and fit.residual_ss == pytest.approx(0, abs=1e-20)
    assert tsqr.fit_linear(df, "y", []).intercept == pytest.approx(4)
    with pytest.raises(ValueError, match="no rows"):
        tsqr.fit_linear(df.limit(0), "y", names)
    assert [r.feature for r in fit.table(spark).collect()] == ["c1", "c0", "intercept"]
