"""Sketches: error bounds, merge against one pass, edge tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustframe.operators import profile, sketches as sk
from gustframe.session import scratch_table


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(60_000).select((i % 7).alias("day"), F.when(i % 11 > 0, i % 20_000).alias("many"), (i % 5).cast("string").alias("few"),
                                      F.lit(None).cast("int").alias("none"), F.when(i % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"),
                                      (F.pmod(F.xxhash64(i), F.lit(100_003)) / 7.0).alias("x")).cache()


COLS = ["many", "few", "none", "zero", "x"]


def test_distinct_within_bound_and_merge_equals_one_pass(spark, rows):
    daily = scratch_table(sk.distinct_sketches(rows, COLS, ["day"]), "hll")
    got = {r.column: r.n_distinct for r in sk.distinct_counts(daily).collect()}
    once = {r.column: r.n_distinct for r in sk.distinct_counts(sk.distinct_sketches(rows, COLS)).collect()}
    assert got == once
    exact = {r.column: r.n_distinct for r in profile.nunique(rows, COLS).collect()}
    for c in COLS:
        assert abs(got[c] - exact.get(c, 0)) <= 3 * sk.distinct_error() * exact.get(c, 0), c
    assert {r.column: r.n_distinct for r in profile.nunique(rows, COLS, approx=True).collect()} == once
    per_day = sk.distinct_counts(daily, ["day"]).where("column = 'few'").collect()
    assert len(per_day) == 7 and {r.n_distinct for r in per_day} == {5}


def test_quantiles_within_rank_bound_whole_and_merged(spark, rows):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    values = np.sort([r.x for r in rows.select("x").collect()])
    daily = scratch_table(sk.quantile_sketches(rows, "x", ["day"]), "kll")
    for got in (sk.sketched_quantiles(daily, probs), sk.sketched_quantiles(sk.quantile_sketches(rows, "x"), probs)):
        for r in got.collect():
            low, high = (np.searchsorted(values, r.value, s) / len(values) for s in ("left", "right"))
            assert r.n == len(values) and low - 2 * sk.rank_error() <= r.q <= high + 2 * sk.rank_error()
    assert sk.sketched_quantiles(daily, [0.5], ["day"]).count() == 7


def test_empty_and_nulls_only(spark, rows):
    none = rows.where("id is null") if "id" in rows.columns else rows.limit(0)
    assert {r.n_distinct for r in sk.distinct_counts(sk.distinct_sketches(none, COLS)).collect()} == {0}
    assert sk.sketched_quantiles(sk.quantile_sketches(none, "x"), [0.5]).collect() == []
    assert sk.sketched_quantiles(sk.quantile_sketches(rows, "none"), [0.5]).collect() == []
    nan = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x double")
    assert [(r.value, r.n) for r in sk.sketched_quantiles(sk.quantile_sketches(nan, "x"), [0.5]).collect()] == [(2.0, 1)]
