"""Distributed positions / ranks / quantiles against brute force (pandas),
with tiny buckets so that the multi-bucket paths run, and one hot group
holding about a third of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gustframe.operators import positions as pos
from gustframe.operators import windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    grp = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    val = np.round(rng.normal(0, 10, n), 1)          # many ties
    val[rng.random(n) < 0.3] = 0.0                     # one hot value
    pdf = pd.DataFrame({"ID": np.arange(n, dtype="int64"), "g": grp, "v": val,
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n) * 60, unit="s")})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("rpb", [50, 10_000])
def test_quantiles_grouped(skewed, rpb):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {(r.g, round(r.q, 2)): r.value for r in pos.exact_quantiles(df, "v", probs, ["g"], rows_per_bucket=rpb).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, round(p, 2))] == pytest.approx(part.v.quantile(p), abs=1e-9)


@pytest.mark.parametrize("rpb", [40, 10_000])
def test_average_rank_grouped(skewed, rpb):
    pdf, df = skewed
    got = {(r.g, r.v): r._rank for r in pos.average_rank(df, "v", ["g"], rows_per_bucket=rpb).collect()}
    for g, part in pdf.groupby("g"):
        ranks = part.v.rank(method="average")
        for v, rk in zip(part.v, ranks):
            assert got[(g, v)] == pytest.approx(rk)


@pytest.mark.parametrize("rpb", [100, 10_000])
def test_row_number_hash_order(skewed, rpb):
    pdf, df = skewed
    out = pos.row_number_global(df.withColumns(pos.hash_order_key("ID", 3)), "_hnum", tie_cols=["_h", "ID"],
                                group_cols=["g"], rows_per_bucket=rpb)
    got = {r.ID: r._rn for r in out.select("ID", "_rn").collect()}
    import hashlib
    pdf = pdf.assign(h=[hashlib.md5(f"3:{i}".encode()).hexdigest() for i in pdf.ID])
    pdf = pdf.sort_values(["g", "h", "ID"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    assert all(got[i] == rn for i, rn in zip(pdf.ID, pdf.rn))


def test_folds_sizes_and_split_quotas(skewed):
    pdf, df = skewed
    folds = windows.kfold_shuffled(df, 7, rows_per_bucket=100).groupBy("fold").count().collect()
    sizes = sorted(r["count"] for r in folds)
    assert len(sizes) == 7 and sizes[-1] - sizes[0] <= 1 and sum(sizes) == len(pdf)
    strat = windows.split_stratified(df, "g", 0.2, rows_per_bucket=100)
    got = {r.g: r.n for r in strat.filter("is_test").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == int(np.ceil(0.2 * len(part)))
    hold = windows.split_holdout(df, 0.2, rows_per_bucket=100)
    assert hold.filter("is_test").count() == int(np.ceil(0.2 * len(pdf)))


@pytest.mark.parametrize("rpb", [64, 10_000])
def test_lag_by_unit_many_buckets(skewed, rpb):
    pdf, df = skewed
    out = windows.lag_diff(df, "v", unit="g", order=("ts", "ID"), rows_per_bucket=rpb)
    got = {r.ID: r.v_before for r in out.select("ID", "v_before").collect()}
    pdf = pdf.sort_values(["g", "ts", "ID"])
    pdf["exp"] = pdf.groupby("g").v.shift(1) - pdf.v
    for i, e in zip(pdf.ID, pdf.exp):
        assert (got[i] is None) if pd.isna(e) else got[i] == pytest.approx(e)


def test_kfold_blocks_matches_ntile(spark):
    df = spark.range(13).withColumnRenamed("id", "ID")
    got = sorted((r.ID, r.fold) for r in windows.kfold_blocks(df, 5, rows_per_bucket=3).collect())
    sizes = [sum(1 for _, f in got if f == k) for k in range(1, 6)]
    assert sizes == [3, 3, 3, 2, 2]
    assert [f for _, f in got] == sorted(f for _, f in got)


@pytest.fixture(scope="module")
def awkward(spark):
    """A NULL unit, infinite values, a hot group, a value on a third of the rows,
    and enough rows for more buckets than one cut makes."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        g = ["hot", "b", None][0 if i % 3 else (1 if i % 2 else 2)]
        v = 7.5 if i % 3 == 1 else float(rng.normal())
        rows.append((i, g, float("inf") if i == 10 else float("-inf") if i == 20 else None if i % 50 == 7 else v, i // 3))
    return spark.createDataFrame(rows, "ID long, g string, v double, ts long").cache()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_rows_at_any_bucket_size(awkward):
    both = lambda f: (_rows(f(60)), _rows(f(1_000_000)))
    for f in (
        lambda n: windows.split_stratified(awkward, "g", 0.2, rows_per_bucket=n),
        lambda n: windows.rank_average(awkward, "v", rows_per_bucket=n),
        lambda n: windows.rank_average(awkward, "v", group_cols=["g"], rows_per_bucket=n),
        lambda n: windows.lag_diff(awkward.withColumn("w", F.col("ID") * 2), "w", unit="g", order=("ts", "ID"), rows_per_bucket=n),
        lambda n: pos.exact_quantiles(awkward, "v", [0.1, 0.5, 0.9], ["g"], rows_per_bucket=n),
        lambda n: pos.exact_quantiles(awkward, "v", [0.1, 0.5, 0.9], rows_per_bucket=n),
        lambda n: windows.kfold_shuffled(awkward, 4, rows_per_bucket=n),
    ):
        small, large = both(f)
        assert small == large and small
    assert windows.split_stratified(awkward, "g", 0.2, rows_per_bucket=5).count() == 900
    parts = windows.split_stratified(awkward, "g", 0.2, rows_per_bucket=5).groupBy("g").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == -(-r.n // 5) for r in parts) and {r.g for r in parts} == {"hot", "b", None}


@pytest.fixture(scope="module")
def hot(spark):
    """One order key on a third of the rows, a third of the ids null, and rows
    repeated in full."""
    rows = [(None if i % 3 == 0 else i, ["a", "b"][i % 10 == 0], 50 if i % 3 == 1 else i, float(i % 7)) for i in range(1200)]
    rows += [(None, "a", 50, 1.0)] * 400
    return spark.createDataFrame(rows, "ID long, g string, ts long, v double").cache()


@pytest.mark.parametrize("keys", [["ID"], ["g", "ID"], ["v"], ["g", "ts", "ID"]])
def test_no_range_is_far_above_its_target(awkward, hot, keys):
    for df in (awkward, hot):
        if not set(keys) <= set(df.columns):
            continue
        n = df.count()
        for target in (30, 100):
            b, cut = pos.in_ranges(df, keys, target)
            sizes = [r["count"] for r in b.groupBy("_bkt").count().collect()]
            assert cut and sum(sizes) == n and max(sizes) <= 2 * target
            place = F.row_number().over(Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys], "_bkt"))
            falls = b.withColumn("p", place).withColumn("d", F.col("_bkt") - F.lag("_bkt").over(Window.orderBy("p")))
            assert falls.where("d < 0").count() == 0


def test_hot_keys_give_the_same_rows(hot):
    for f in (
        lambda n: windows.kfold_shuffled(hot, 5, rows_per_bucket=n),
        lambda n: windows.kfold_blocks(hot, 5, rows_per_bucket=n),
        lambda n: windows.split_holdout(hot, 0.2, rows_per_bucket=n),
        lambda n: windows.split_stratified(hot, "g", 0.2, rows_per_bucket=n),
        lambda n: windows.lag_diff(hot, "v", unit="g", order=("ts", "ID"), rows_per_bucket=n),
        lambda n: windows.lag_diff(hot.withColumn("ts", F.lit(1)), "v", unit="g", order=("ts", "ID"), rows_per_bucket=n),
        lambda n: pos.row_number_global(hot.withColumn("k", F.lit("one")), "k", rows_per_bucket=n),
    ):
        small, mid, large = (_rows(f(n)) for n in (90, 400, 1_000_000))
        assert small == mid == large and len(small) == 1600
    numbers = pos.row_number_global(hot.withColumn("k", F.lit(1)), "k", rows_per_bucket=70).select("_rn").collect()
    assert sorted(r._rn for r in numbers) == list(range(1, 1601))


def test_order_keys_of_any_type(spark):
    """Strings and fractions of seconds are ordered as they are."""
    rows = [(i, f"k{i % 37:02d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "ID long, s string, us long").withColumn("t", F.timestamp_micros("us"))
    for key, want in (("s", sorted(rows, key=lambda r: (r[1], r[0]))), ("t", rows)):
        got = pos.row_number_global(df, key, tie_cols=["ID"], rows_per_bucket=31).orderBy("_rn").collect()
        assert [r.ID for r in got] == [r[0] for r in want]


def test_quantiles_read_only_brackets(spark):
    """A large group is bracketed, and the result is still exact."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=40_000)
    df = spark.createDataFrame([(float(x), "a" if i % 4 else None) for i, x in enumerate(v)], "v double, g string")
    got = {(r.g, r.q): r.value for r in pos.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], ["g"], accuracy=500).collect()}
    for g, part in (("a", [x for i, x in enumerate(v) if i % 4]), (None, v[::4])):
        for q in (0.0, 0.25, 0.5, 1.0):
            assert got[(g, q)] == pytest.approx(float(np.quantile(part, q)))


def test_spearman_wide(spark):
    from gustframe.operators import corr
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 40)).round(1)
    pdf = pd.DataFrame(base, columns=[f"c{i}" for i in range(40)])
    pdf.loc[::7, "c3"] = None
    pdf.loc[::5, "c9"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(x) else float(x) for x in r) for r in pdf.to_numpy()], ", ".join(f"c{i} double" for i in range(40)))
    got = {(r.col_a, r.col_b): r.rho for r in corr.spearman_matrix(df, list(pdf.columns)).collect()}
    want = lambda a, b: pdf[[a, b]].dropna().rank().corr().iloc[0, 1]
    assert len(got) == 780
    for k in [("c0", "c1"), ("c3", "c9"), ("c2", "c3"), ("c9", "c30"), ("c38", "c39")]:
        assert got[k] == pytest.approx(want(*k))


def test_ranges_are_bounded_whatever_the_bucket(spark):
    """The driver samples rows per range: small buckets on many rows must not make many ranges."""
    df = spark.range(60_000).selectExpr("id as ID", "if(id % 3 = 0, null, concat('u', id % 4)) as u")
    ranged, cut = pos.in_ranges(df, ["ID"], 20)
    n = ranged.select("_bkt").distinct().count()
    assert cut and 200 <= n <= pos.MOST_RANGES and ranged.count() == 60_000
    small, large = (windows.split_stratified(df, "u", 0.2, rows_per_bucket=b).where("is_test").select("ID").collect() for b in (20, 1_000_000))
    assert {r.ID for r in small} == {r.ID for r in large} and len(small) == len(large)
