"""Expected values on the hand-made edge table (computed independently of Spark)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustframe.functions import nullsafe as ns
from gustframe.functions import scalars as sc
from gustframe.operators import bins, corr, evaluate, filters, positions, profile, windows
from gustframe.plans import features as fx


def by_id(df, col):
    return {r["ID"]: r[col] for r in df.select("ID", col).collect()}


def test_null_count_by_column(edge):
    got = {r["column"]: r["n_null"] for r in profile.null_count_by_column(edge).collect()}
    assert got == {"MAC_CODE": 1, "Rotor_speed": 1, "Rotor_speed_min": 1, "Rotor_speed_max": 1,
                   "Rotor_speed_std": 2, "Pitch_angle": 1, "Pitch_angle_std": 1, "Grid_voltage": 7,
                   "Nacelle_angle": 2, "TARGET": 1, "ID": 0, "t": 0}


def test_null_count_per_row(edge):
    got = {r["n_null"]: r["n_rows"] for r in profile.null_count_per_row(edge).collect()}
    assert got == {0: 14, 1: 8, 5: 2}


def test_split_regime2_keeps_null_speed_low(edge):
    hi, lo = filters.split_regime2(edge, cut=15.0)
    assert hi.count() == 4 and lo.count() == 20
    assert 12 in {r.ID for r in lo.select("ID").collect()}


def test_split_regime3(edge):
    got = {r["regime3"]: r["count"] for r in filters.with_regime3(edge).groupBy("regime3").count().collect()}
    assert got == {"low": 9, "med": 10, "high": 4, None: 1}


def test_impute_median_by_regime(edge):
    t = fx.RegimeColumn().transform(edge)
    model = fx.ImputeMedian(inputCols=["Grid_voltage", "Rotor_speed_std"], groupCol="regime").fit(t)
    med = model.getOrDefault(model.medians)
    assert med["low"]["Grid_voltage"] == 390.0 and med["high"]["Grid_voltage"] == 400.0
    assert med["low"]["Rotor_speed_std"] == pytest.approx(0.3) and med["high"]["Rotor_speed_std"] == pytest.approx(0.2)
    filled = model.transform(t)
    assert filled.filter(F.col("Grid_voltage").isNull()).count() == 0


EXPECTED_LAG = {1: None, 2: -45, 3: 1, 4: 45, 5: 0, 6: -0.5, 7: None, 8: -0.1, 9: -0.8, 10: -1, 11: -4, 12: 3,
                13: None, 14: 0, 15: 0, 16: 0, 17: 0, 18: None, 19: -238, 20: 118.5, 21: -89.5,
                22: None, 23: None, 24: None}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 3])
def test_lag_diff(edge, rows_per_bucket):
    """Same answer with one bucket and with many (the carry across buckets)."""
    out = windows.lag_diff(edge, "Pitch_angle", order=("t", "ID"), rows_per_bucket=rows_per_bucket)
    got = by_id(out, "Pitch_angle_before")
    for k, v in EXPECTED_LAG.items():
        assert (got[k] is None) if v is None else got[k] == pytest.approx(v), k


def test_cut_edges(edge):
    got = {r["b"]: r["count"] for r in edge.select(sc.cut_edges("Nacelle_angle").alias("b")).groupBy("b").count().collect()}
    assert got == {0: 6, 1: 3, 2: 2, 5: 2, 6: 3, 8: 2, 9: 1, 10: 1, None: 4}


def test_cut_equal(edge):
    st = edge.agg(F.min("Rotor_speed").alias("mn"), F.max("Rotor_speed").alias("mx")).first()
    got = {r["b"]: r["count"] for r in edge.select(sc.cut_equal("Rotor_speed", 4, st.mn, st.mx).alias("b"))
           .groupBy("b").count().collect()}
    assert got == {0: 5, 1: 3, 2: 10, 3: 5, None: 1}


def test_histogram(edge):
    rows = sorted(bins.histogram(edge, "Rotor_speed", 4).collect(), key=lambda r: r.bin)
    assert [r.n for r in rows] == [5, 3, 10, 5]
    assert [round(r.lo, 6) for r in rows] + [round(rows[-1].hi, 6)] == [-0.1, 4.175, 8.45, 12.725, 17.0]


def test_round_even(edge):
    got = by_id(edge.withColumn("r", sc.round_even("Rotor_speed")), "r")
    assert (got[3], got[4], got[5]) == (2.0, 4.0, 8.0)


def test_bounds_checks(edge):
    flags = profile.bounds_flags(["Rotor_speed"])
    out = {r.ID for r in edge.filter(flags["Rotor_speed_oob"]).select("ID").collect()}
    assert out == {13, 14, 15}
    assert {r.sensor: r.n for r in profile.check_max_lt_min(edge, ["Rotor_speed"]).collect()} == {"Rotor_speed": 1}
    c = profile.check_constant(edge, ["Rotor_speed"]).first()
    assert (c.n_minmax_equal, c.n_std_zero) == (3, 2)


def test_outliers(edge):
    r3 = filters.with_regime3(edge)
    low = r3.filter(F.col("regime3") == "low").filter(filters.outlier_exponential(curve=sc.EXP_CURVE_LOW))
    med = r3.filter(F.col("regime3") == "med").filter(filters.outlier_exponential(curve=sc.EXP_CURVE_MED))
    hi = r3.filter(F.col("regime3") == "high").filter(filters.outlier_polynomial())
    assert low.count() == 0
    assert {r.ID for r in med.collect()} == {14}
    assert {r.ID for r in hi.collect()} == {10, 11}


def test_share_where(edge):
    r = profile.share_where(edge, F.col("TARGET") < 0).first()
    assert r.share == pytest.approx(0.125) and r.n_true == 3


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 2])
def test_quantiles(edge, rows_per_bucket):
    q = positions.exact_quantiles(edge, "TARGET", [.1, .25, .5, .75, .9], rows_per_bucket=rows_per_bucket)
    got = {r.q: r.value for r in q.collect()}
    assert [round(got[p], 6) for p in (.1, .25, .5, .75, .9)] == [-2.4, 6.05, 150.0, 300.5, 940.0]


def test_safe_ratio(edge):
    e = edge.withColumn("r", sc.ratio_inf_as_minus_one("Pitch_angle", "Rotor_speed"))
    med = positions.exact_median(e, "r").first()["median"]
    assert med == pytest.approx(-0.083333, abs=1e-6)
    filled = by_id(e.withColumn("f", F.coalesce("r", F.lit(med))), "f")
    assert filled[2] == -1.0 and filled[1] == pytest.approx(-0.083333, abs=1e-6)


def test_log_target(edge):
    got = by_id(edge.withColumn("l", sc.log_target()), "l")
    assert {k for k, v in got.items() if v is None} == {18, 19, 24}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 2])
def test_spearman(edge, rows_per_bucket):
    r = corr.spearman_pairs(edge, [("Rotor_speed", "TARGET"), ("Grid_voltage", "TARGET")], rows_per_bucket)
    got = {r.col_a: r.rho for r in r.collect()}
    assert got["Rotor_speed"] == pytest.approx(0.949581, abs=1e-6)
    assert got["Grid_voltage"] == pytest.approx(0.853921, abs=1e-6)


def test_null_rate_by_group(edge):
    got = {r.MAC_CODE: round(r.null_rate, 4) for r in profile.null_rate_by_group(edge, "Grid_voltage").collect()}
    assert got == {"WT1": 0.3333, "WT2": 0.3333, "WT3": 0.3333, "WT4": 0.25, "WTx": 0.0}


def _unit_median_predictions(edge):
    src = edge.filter(F.col("MAC_CODE").isNotNull() & F.col("TARGET").isNotNull())
    med = positions.exact_median(src, "TARGET", ["MAC_CODE"], out="prediction")
    return src.join(med, "MAC_CODE")


def test_mae_and_mape(edge):
    p = _unit_median_predictions(edge)
    m = evaluate.mae(p).first()
    assert m.n == 22 and m.mae == pytest.approx(147.129545, abs=1e-6)
    r = evaluate.mape(p).first()
    assert r.n == 21 and r.mape == pytest.approx(9.350978, abs=1e-6)


def test_unit_flags_and_shift(edge):
    flags = edge.withColumns(sc.unit_flags())
    got = {r.ID: (r.WT13, r.WT24, r.eolCombi) for r in flags.collect()}
    assert got[22] == (0, 0, 0) and got[23] == (0, 0, 0) and got[1] == (1, 0, -1) and got[7] == (0, 1, 1)
    mn = edge.agg(F.min("Pitch_angle")).first()[0]
    shifted = by_id(edge.withColumn("s", sc.shift_by_unit("Pitch_angle", mn)), "s")
    assert shifted[22] is None and shifted[23] is None and shifted[18] == -119.0 + 119.0 * 4


def test_null_safe_complement(edge):
    cond = F.col("Rotor_speed") >= 15
    assert edge.filter(ns.keep(cond)).count() + edge.filter(ns.reject(cond)).count() == edge.count()
    assert edge.filter(~cond).count() < edge.filter(ns.reject(cond)).count()
