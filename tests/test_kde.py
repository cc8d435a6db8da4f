"""Kernel density by cells against the direct sum over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gustframe.operators import bins


def direct(v: np.ndarray, n_grid: int) -> np.ndarray:
    h, span = v.std(ddof=1) * len(v) ** -0.2, v.max() - v.min()
    g = v.min() - span / 2 + np.arange(n_grid) * 2 * span / (n_grid - 1)
    return np.exp(-0.5 * ((g[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
def test_density_equals_direct_sum(spark, scale):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=700), "outlier": np.append(rng.normal(size=500), 400.0), "ties": rng.integers(0, 3, 300).astype(float),
              "two": np.array([0.0, 1.0]), "hot": np.append(np.zeros(900), rng.exponential(size=300))}
    rows = [(k, float(x * scale)) for k, v in groups.items() for x in v]
    rows += [("flat", 2.0)] * 5 + [("one", 1.0), ("normal", None), ("normal", math.nan), (None, 3.0), ("wild", math.inf), ("wild", 1.0)]
    got = bins.kde(spark.createDataFrame(rows, "k string, v double"), "v", "k", 40).collect()
    assert {r.k for r in got} == set(groups) and len(got) == 40 * len(groups)
    for k, v in groups.items():
        have = np.array([r.density for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)])
        h = v.std(ddof=1) * len(v) ** -0.2 * scale
        assert np.abs(have - direct(v * scale, 40)).max() < 2e-12 / h


def test_no_row_meets_the_grid(spark):
    df = spark.range(1000).selectExpr("'a' as k", "cast(id % 97 as double) as v")
    plan = bins.kde(df, "v", "k")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("Aggregate" in x and "_cell" in x for x in lines[at:])
    empty = df.limit(0)
    assert bins.kde(empty, "v", "k").collect() == [] and bins.kde(empty, "v").collect() == []
    assert len(bins.kde(df, "v").collect()) == 50
