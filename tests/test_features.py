"""Feature stages on the edge table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gustframe.plans import features as fx
from test_edge_rows import EXPECTED_LAG, by_id


def test_minmax_constant_column_maps_to_low_end(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "ID long, c double, v double")
    out = fx.MinMaxTo(inputCols=["c", "v"], low=-1.0, high=1.0).fit(df).transform(df)
    assert by_id(out, "c") == {1: -1.0, 2: -1.0}
    assert by_id(out, "v") == {1: -1.0, 2: 1.0}


def test_one_hot_sorted_int_columns(edge):
    m = fx.OneHot(inputCols=["MAC_CODE"]).fit(edge)
    out = m.transform(edge)
    cols = [c for c in out.columns if c.startswith("MAC_CODE_")]
    assert cols == ["MAC_CODE_WT1", "MAC_CODE_WT2", "MAC_CODE_WT3", "MAC_CODE_WT4", "MAC_CODE_WTx"]
    assert dict(out.dtypes)["MAC_CODE_WT1"] == "int"
    assert by_id(out, "MAC_CODE_WT1")[22] == 0


def test_interaction_features_distinct_products_only(edge):
    out = fx.InteractionFeatures(inputCols=["Rotor_speed", "Pitch_angle", "TARGET"]).transform(edge)
    new = [c for c in out.columns if "^1" in c]
    assert len(new) == 6 and "Rotor_speed^1xPitch_angle^1" in new and "Rotor_speed^1xRotor_speed^1" not in new


def test_add_features_fit_on_train_applies_to_new_rows(edge):
    edge = edge.withColumns({"Generator_stator_temperature_min": F.lit(30.0),
                             "Pitch_angle_max": F.col("Pitch_angle") + 1, "Pitch_angle_min": F.col("Pitch_angle") - 1})
    train = edge.filter(F.col("ID") <= 20)
    model = fx.AddFeatures(orderCols=["t", "ID"]).fit(train)
    assert model.getOrDefault(model.minima)["Rotor_speed"] == 0.0  # row 21 (-0.1) is not in the fit rows
    out = model.transform(edge)
    got = by_id(out, "Pitch_Before")
    for k, v in EXPECTED_LAG.items():
        assert (got[k] is None) if v is None else got[k] == pytest.approx(v)
    flags = {r.ID: (r.WT13, r.WT24, r.eolCombi) for r in out.select("ID", "WT13", "WT24", "eolCombi").collect()}
    assert flags[1] == (1, 0, -1) and flags[22] == (0, 0, 0)
    assert by_id(out, "Speed_div_Pitch")[1] is None  # 0 / 0


def test_log1p10_flags(edge):
    out = fx.Log1p10Columns(columns=["Rotor_speed", "Pitch_angle"]).transform(edge)
    got = {r.ID: (r.haveRotor_speed, r.havePitch_angle, r.haveAny) for r in out.collect()}
    assert got[1] == (0, 0, 0) and got[3] == (1, 1, 1) and got[12] == (0, 1, 1)
    assert by_id(out, "Rotor_speed")[21] == pytest.approx(-0.0457574906, abs=1e-9)  # log10(0.9)


def test_keep_high_regime_null_safe(edge):
    hi = fx.KeepHighRegime(keepHigh=True).transform(edge).count()
    lo = fx.KeepHighRegime(keepHigh=False).transform(edge).count()
    assert (hi, lo) == (4, 20)


def test_null_group_is_filled_with_its_own_median(spark):
    from gustframe.plans import features as fx
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, None, None), (4, "a", 10.0), (5, "a", None), (6, "None", 7.0), (7, "None", None)],
                               "ID long, g string, v double")
    got = {r.ID: r.v for r in fx.ImputeMedian(inputCols=["v"], groupCol="g").fit(df).transform(df).collect()}
    assert got[3] == 2.0 and got[5] == 10.0 and got[7] == 7.0
