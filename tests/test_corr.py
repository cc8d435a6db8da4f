"""Rank correlation: values against pandas, and shuffles that don't grow with the columns."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest

from gustframe.operators import corr


def table(n: int = 400) -> pd.DataFrame:
    rng = random.Random(8)
    rows = []
    for i in range(n):
        a = 7.0 if i % 3 == 0 else rng.gauss(0, 1)  # a value on a third of the rows
        rows.append((a, None if i % 4 == 1 else round(a + rng.gauss(0, 1), 1), None if i % 5 < 2 else rng.choice([0.0, -0.0, 1.0]),
                     rng.random(), 3.0, None, math.nan if i % 2 else float(i)))
    return pd.DataFrame(rows, columns=[*"abcdefg"])


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_spearman_equals_pandas(spark, rows_per_bucket):
    data = table()
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in data.astype(object).itertuples(index=False)],
                               ", ".join(f"{c} double" for c in data))
    got = {(r.col_a, r.col_b): (r.rho, r.n) for r in corr.spearman_matrix(df, list("abcdefg"), rows_per_bucket=rows_per_bucket).collect()}
    for i, a in enumerate("abcdefg"):
        for b in "abcdefg"[i + 1:]:
            both = data[[a, b]].astype(float).dropna()
            assert ((a, b) in got) == (len(both) > 0)
            if len(both):
                rho, n = got[a, b]
                want = both.rank().corr().iloc[0, 1]
                assert n == len(both) and (math.isclose(rho, want, abs_tol=1e-12) if want == want else rho is None or rho != rho)
    assert corr.spearman_matrix(df.limit(0), ["a", "b"]).collect() == []


def test_shuffles_do_not_grow_with_columns(spark):
    df = spark.range(100).selectExpr("id", *[f"id * {i} % 13 as c{i}" for i in range(1, 9)])
    plans = []
    for k in (2, 8):
        got = corr.spearman_matrix(df, [f"c{i}" for i in range(1, k + 1)])
        plans.append(got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert plans[0] == plans[1]


@pytest.mark.parametrize("most", [20_000, 60, 2])
def test_few_and_many_values(spark, monkeypatch, most):
    """A column of many values, columns of few: looked up, mixed, or put together by row; the same rho."""
    monkeypatch.setattr(corr.pos, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    data = pd.DataFrame([(rng.random(), None if i % 6 == 0 else float(rng.randrange(9)), float(i % 5), None if i % 7 == 0 else rng.choice([0.0, 1.0])) for i in range(500)],
                        columns=[*"rabc"])
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in data.itertuples(index=False)], ", ".join(f"{c} double" for c in data))
    made = corr.error_correlation(df, "r", [*"abc"])
    got = {r.feature: (r.rho, r.n) for r in made.collect()}
    for c in "abc":
        both = data[["r", c]].dropna()
        assert got[c][1] == len(both) and math.isclose(got[c][0], both.rank().corr().iloc[0, 1], abs_tol=1e-12)
    by_row = "Aggregate [_row#" in made._jdf.queryExecution().optimizedPlan().toString()
    assert by_row == (most == 2)
