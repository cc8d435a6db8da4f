"""Queries for the scalar functions (one projection each, whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions import scalars as sc
from gustframe.operators import positions as pos
from gustframe.operators.joins import attach_stats
from gustframe.plans.catalog import query
from gustframe.plans.q_frames import _poly_sql, d
from gustframe.plans.q_profile import SECTOR_SQL, SECTOR_W
from gustframe.sources import driver_views as V


@query("log_target", views=("signed",), dbl={"LogTARGET": 9},
       sql="select ID, case when TARGET + 20 > 0 then log10(TARGET + 20) end as LogTARGET from signed")
def log_target_q(spark, sf):
    return V.signed(spark, sf).select("ID", sc.log_target().alias("LogTARGET"))


@query("turbulence", views=("turbine",), dbl={"Turbulence": 9},
       sql="select ID, case when Rotor_speed_std / nullif(Rotor_speed + m.mn + 0.1, 0) + 0.1 > 0 then "
           "log10(Rotor_speed_std / nullif(Rotor_speed + m.mn + 0.1, 0) + 0.1) end as Turbulence "
           "from turbine, (select min(Rotor_speed) as mn from turbine) m")
def turbulence_q(spark, sf):
    t = V.turbine(spark, sf)
    t = attach_stats(t, t.agg(F.min("Rotor_speed").alias("_mn")))
    return t.select("ID", sc.turbulence("Rotor_speed_std", "Rotor_speed", F.col("_mn")).alias("Turbulence"))


@query("cube", views=("turbine",), dbl={"Rotor_speed3": 6},
       sql="select ID, Rotor_speed * Rotor_speed * Rotor_speed as Rotor_speed3 from turbine")
def cube_q(spark, sf):
    return V.turbine(spark, sf).select("ID", sc.cube("Rotor_speed").alias("Rotor_speed3"))


@query("round_even", views=("turbine",), dbl=["IntRotor_speed"],
       sql="select ID, round_even(Rotor_speed * 2, 0) as IntRotor_speed from turbine")
def round_even_q(spark, sf):
    """Half-to-even rounding (speeds doubled so that .5 ties occur)."""
    return V.turbine(spark, sf).select("ID", sc.round_even(F.col("Rotor_speed") * 2).alias("IntRotor_speed"))


_INTER = {"Pitch_angle_x_Rotor_speedStd": ("Pitch_angle", "Rotor_speed_std"),
          "Pitch_angleStd_x_Rotor_speed": ("Pitch_angle_std", "Rotor_speed"),
          "Generator_stator_temperatureMin_x_Pitch_angleStd": ("Generator_stator_temperature_min", "Pitch_angle_std"),
          "Pitch_angleMax_x_Pitch_angleMin": ("Pitch_angle_max", "Pitch_angle_min")}


@query("interact", views=("turbine",), dbl=list(_INTER),
       sql="select ID, " + ", ".join(f"{a} * {b} as {n}" for n, (a, b) in _INTER.items()) + " from turbine")
def interact_q(spark, sf):
    return V.turbine(spark, sf).select("ID", *[sc.interact(a, b).alias(n) for n, (a, b) in _INTER.items()])


@query("speed_over_pitch", views=("turbine",), dbl={"Speed_div_Pitch": 9},
       sql="select ID, Rotor_speed / nullif(Pitch_angle, 0) as Speed_div_Pitch from turbine")
def speed_over_pitch_q(spark, sf):
    return V.turbine(spark, sf).select("ID", sc.safe_div("Rotor_speed", "Pitch_angle").alias("Speed_div_Pitch"))


_RATIO_SQL = "case when Pitch_angle = 0 and Grid_voltage <> 0 then -1.0 else Grid_voltage / nullif(Pitch_angle, 0) end"


@query("safe_ratio", views=("wide_keyed",), dbl={"ratio": 9},
       sql=f"select okey, line, coalesce({_RATIO_SQL}, (select median({_RATIO_SQL}) from wide_keyed)) as ratio "
           "from wide_keyed")
def safe_ratio_q(spark, sf):
    """Ratio with +-inf -> -1, then NULL (0/0 or missing) -> median of the ratio."""
    w = V.wide_keyed(spark, sf).withColumn("_r", sc.ratio_inf_as_minus_one("Grid_voltage", "Pitch_angle"))
    med = pos.exact_median(w, "_r", out="_med")
    return attach_stats(w, med).select("okey", "line", F.coalesce("_r", "_med").alias("ratio"))


@query("inf_to_null", views=("wide_keyed",), dbl={"cv": 9},
       sql="select okey, line, Rotor_speed_std / nullif(Pitch_angle, 0) as cv from wide_keyed")
def inf_to_null_q(spark, sf):
    return V.wide_keyed(spark, sf).select("okey", "line", sc.safe_div("Rotor_speed_std", "Pitch_angle").alias("cv"))


@query("shift_by_unit", views=("turbine",), dbl=["PitchAng_re"],
       sql="select ID, Pitch_angle + abs(m.mn) * try_cast(right(MAC_CODE, 1) as int) as PitchAng_re "
           "from turbine, (select min(Pitch_angle) as mn from turbine) m")
def shift_by_unit_q(spark, sf):
    t = V.turbine(spark, sf)
    t = attach_stats(t, t.agg(F.min("Pitch_angle").alias("_mn")))
    return t.select("ID", sc.shift_by_unit("Pitch_angle", F.col("_mn")).alias("PitchAng_re"))


_FLAGS_SQL = ("cast(coalesce(MAC_CODE in ('WT1', 'WT3'), false) as int) as WT13, "
              "cast(coalesce(MAC_CODE in ('WT2', 'WT4'), false) as int) as WT24")


@query("unit_flags", views=("turbine",),
       sql=f"select ID, WT13, WT24, WT24 - WT13 as eolCombi from (select ID, {_FLAGS_SQL} from turbine) t")
def unit_flags_q(spark, sf):
    return V.turbine(spark, sf).select("ID", *[c.alias(n) for n, c in sc.unit_flags().items()])


@query("sign_expand", views=("turbine",), dbl=["Rotor_speed_eolCombi", "Pitch_angle_eolCombi"],
       sql=f"select ID, Rotor_speed * (WT24 - WT13) as Rotor_speed_eolCombi, Pitch_angle * (WT24 - WT13) "
           f"as Pitch_angle_eolCombi from (select *, {_FLAGS_SQL} from turbine) t")
def sign_expand_q(spark, sf):
    combi = sc.unit_flags()["eolCombi"]
    return V.turbine(spark, sf).select("ID", *[(F.col(c) * combi).alias(f"{c}_eolCombi")
                                               for c in ("Rotor_speed", "Pitch_angle")])


@query("threshold_flag", views=("signed",),
       sql="select ID, TARGET <= 0.1 as TNeg, TARGET >= 600 as TargetSup600 from signed")
def threshold_flag_q(spark, sf):
    return V.signed(spark, sf).select("ID", (F.col("TARGET") <= 0.1).alias("TNeg"),
                                      (F.col("TARGET") >= 600).alias("TargetSup600"))


@query("zscore", views=("signed",), dbl={"z": 9},
       sql="select ID, (TARGET - s.m) / nullif(s.sd, 0) as z from signed, "
           "(select avg(TARGET) as m, stddev_samp(TARGET) as sd from signed) s")
def zscore_q(spark, sf):
    s = V.signed(spark, sf)
    s = attach_stats(s, s.agg(F.avg("TARGET").alias("_m"), F.stddev_samp("TARGET").alias("_sd")))
    return s.select("ID", sc.zscore("TARGET", F.col("_m"), F.col("_sd")).alias("z"))


@query("minmax_scale", views=("signed",), dbl={"scaled01": 9, "scaled11": 9},
       sql="select ID, coalesce((TARGET - s.mn) / nullif(s.mx - s.mn, 0), 0.0) as scaled01, "
           "coalesce((TARGET - s.mn) / nullif(s.mx - s.mn, 0), 0.0) * 2 - 1 as scaled11 from signed, "
           "(select min(TARGET) as mn, max(TARGET) as mx from signed) s")
def minmax_scale_q(spark, sf):
    s = V.signed(spark, sf)
    s = attach_stats(s, s.agg(F.min("TARGET").alias("_mn"), F.max("TARGET").alias("_mx")))
    return s.select("ID", sc.minmax_scale("TARGET", F.col("_mn"), F.col("_mx")).alias("scaled01"),
                    sc.minmax_scale("TARGET", F.col("_mn"), F.col("_mx"), -1.0, 1.0).alias("scaled11"))


@query("combined_scaled", views=("turbine",), dbl={"Combi_RotorSp_PitchAng": 9},
       sql="select ID, power(coalesce((Rotor_speed - s.a) / nullif(s.b - s.a, 0), 0.0) * 9 + 1, 2) + "
           "power(coalesce((Pitch_angle - s.c) / nullif(s.e - s.c, 0), 0.0) * 9 + 1, 2) as Combi_RotorSp_PitchAng "
           "from turbine, (select min(Rotor_speed) as a, max(Rotor_speed) as b, min(Pitch_angle) as c, "
           "max(Pitch_angle) as e from turbine) s")
def combined_scaled_q(spark, sf):
    t = V.turbine(spark, sf)
    t = attach_stats(t, t.agg(F.min("Rotor_speed").alias("_a"), F.max("Rotor_speed").alias("_b"),
                              F.min("Pitch_angle").alias("_c"), F.max("Pitch_angle").alias("_e")))
    r = sc.minmax_scale("Rotor_speed", F.col("_a"), F.col("_b"), 1.0, 10.0)
    p = sc.minmax_scale("Pitch_angle", F.col("_c"), F.col("_e"), 1.0, 10.0)
    return t.select("ID", (F.pow(r, 2) + F.pow(p, 2)).alias("Combi_RotorSp_PitchAng"))


@query("exp10_curve", views=("turbine",), dbl={"curve_low": 2, "curve_tag": 2},
       sql=f"select ID, pow(10.0, {d(0.112)} * Rotor_speed + {d(1.11)}) as curve_low, "
           f"pow(10.0, {d(0.115)} * Rotor_speed + {d(1.34)}) as curve_tag from turbine")
def exp10_curve_q(spark, sf):
    t = V.turbine(spark, sf)
    return t.select("ID", sc.exp10_curve("Rotor_speed", *sc.EXP_CURVE_LOW).alias("curve_low"),
                    sc.exp10_curve("Rotor_speed", *sc.EXP_CURVE_TAG).alias("curve_tag"))


@query("poly_curve", views=("turbine",), dbl={"curve": 4},
       sql=f"select ID, {_poly_sql()} as curve from turbine")
def poly_curve_q(spark, sf):
    return V.turbine(spark, sf).select("ID", sc.poly_curve("Rotor_speed").alias("curve"))


@query("affine_curve", views=("turbine",), dbl=["lo", "hi"],
       sql="select ID, 975.0 * Rotor_speed + -14500.0 as lo, 975.0 * Rotor_speed + -14430.0 as hi from turbine")
def affine_curve_q(spark, sf):
    t = V.turbine(spark, sf)
    return t.select("ID", sc.affine_curve("Rotor_speed", sc.AFFINE_BAND[0]).alias("lo"),
                    sc.affine_curve("Rotor_speed", sc.AFFINE_BAND[1]).alias("hi"))


@query("grid", views=("turbine",), dbl=["x"],
       sql="select cast(g.i as int) as i, s.mn + g.i * (s.mx - s.mn) / 49.0 as x from "
           "(select min(Rotor_speed) as mn, max(Rotor_speed) as mx from turbine) s cross join range(0, 50) g(i)")
def grid_q(spark, sf):
    """50 evenly spaced points over the observed speed range (built in the plan)."""
    s = V.turbine(spark, sf).agg(F.min("Rotor_speed").alias("_mn"), F.max("Rotor_speed").alias("_mx"))
    g = s.select("_mn", "_mx", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"))
    return g.select(F.col("i").cast("int").alias("i"),
                    (F.col("_mn") + F.col("i") * (F.col("_mx") - F.col("_mn")) / 49.0).alias("x"))


@query("deg_to_rad", views=("direction",), dbl={"rad": 9},
       sql="select ID, radians(Nacelle_angle) as rad from direction")
def deg_to_rad_q(spark, sf):
    return V.direction(spark, sf).select("ID", F.radians("Nacelle_angle").alias("rad"))


@query("cut_edges", views=("direction",), dbl=["mid_deg"],
       sql=f"select ID, {SECTOR_SQL} as sector, ({SECTOR_SQL} + 0.5) * {d(SECTOR_W)} as mid_deg from direction")
def cut_edges_q(spark, sf):
    return V.direction(spark, sf).select("ID", sc.cut_edges("Nacelle_angle").alias("sector"),
                                         sc.cut_edges_mid("Nacelle_angle").alias("mid_deg"))


@query("cut_equal", views=("wide",),
       sql="select case when Rotor_speed is not null then cast(greatest(ceil((Rotor_speed - s.mn) / ((s.mx - s.mn) / 4.0)) - 1, 0) "
           "as int) end as bin, count(*) as n from wide, (select min(Rotor_speed) as mn, max(Rotor_speed) as mx from wide) s "
           "group by 1")
def cut_equal_q(spark, sf):
    w = V.wide(spark, sf)
    w = attach_stats(w, w.agg(F.min("Rotor_speed").alias("_mn"), F.max("Rotor_speed").alias("_mx")))
    return w.select(sc.cut_equal("Rotor_speed", 4, F.col("_mn"), F.col("_mx")).alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("shifted_log", views=("signed",), dbl={"v": 9},
       sql="select ID, case when TARGET + abs(s.mn) + 0.1 > 0 then log10(TARGET + abs(s.mn) + 0.1) end as v "
           "from signed, (select min(TARGET) as mn from signed) s")
def shifted_log_q(spark, sf):
    s = V.signed(spark, sf)
    s = attach_stats(s, s.agg(F.min("TARGET").alias("_mn")))
    return s.select("ID", sc.shifted_log("TARGET", F.col("_mn")).alias("v"))


@query("log1p10_columns", views=("wide_keyed",), dbl={"Rotor_speed": 9, "Grid_voltage": 9},
       sql="select okey, line, case when Rotor_speed + 1 > 0 then log10(Rotor_speed + 1) end as Rotor_speed, "
           "case when Grid_voltage + 1 > 0 then log10(Grid_voltage + 1) end as Grid_voltage, "
           "cast(coalesce(Rotor_speed <> 0, false) as int) as haveRotor_speed, "
           "cast(coalesce(Grid_voltage <> 0, false) as int) as haveGrid_voltage, "
           "cast(coalesce(Rotor_speed <> 0, false) or coalesce(Grid_voltage <> 0, false) as int) as haveAny "
           "from wide_keyed")
def log1p10_columns_q(spark, sf):
    from gustframe.plans.features import Log1p10Columns
    w = V.wide_keyed(spark, sf).select("okey", "line", "Rotor_speed", "Grid_voltage")
    return Log1p10Columns(columns=["Rotor_speed", "Grid_voltage"]).transform(w)


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", views=("direction",),
       sql="select ID, " + ", ".join(f"cast(coalesce(MAC_CODE = '{p}', false) as int) as \"MAC_CODE_{p}\""
                                     for p in _PRIOS) + " from direction")
def one_hot_q(spark, sf):
    from gustframe.plans.features import OneHot
    return OneHot(inputCols=["MAC_CODE"]).fit(V.direction(spark, sf).select("ID", "MAC_CODE")).transform(
        V.direction(spark, sf).select("ID", "MAC_CODE")).drop("MAC_CODE")


@query("impute_constant", views=("wide_keyed",), dbl=["Rotor_speed", "Rotor_speed_std", "Grid_voltage"],
       sql="select okey, line, coalesce(Rotor_speed, 0.0) as Rotor_speed, coalesce(Rotor_speed_std, 0.0) as Rotor_speed_std, "
           "coalesce(Grid_voltage, 0.0) as Grid_voltage from wide_keyed")
def impute_constant_q(spark, sf):
    return V.wide_keyed(spark, sf).select("okey", "line", "Rotor_speed", "Rotor_speed_std", "Grid_voltage").na.fill(0.0)
