"""Queries for sources, projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustframe.functions import nullsafe as ns
from gustframe.functions import scalars as sc
from gustframe.operators import corr, filters, joins, profile
from gustframe.operators import positions as pos
from gustframe.operators import select as sel
from gustframe.plans.catalog import query
from gustframe.session import scratch_path
from gustframe.sources import delimited as io
from gustframe.sources import driver_views as V


def d(v: float) -> str:
    """A DOUBLE literal for the oracle text."""
    return f"cast('{float(v)!r}' as double)"


HOURLY_DBL = ["value", "value_min", "value_max", "value_std", "k", "k_min", "k_max", "k_std"]
TURBINE_DBL = ["Rotor_speed", "Rotor_speed_min", "Rotor_speed_max", "Rotor_speed_std", "Pitch_angle",
               "Pitch_angle_min", "Pitch_angle_max", "Pitch_angle_std", "Generator_stator_temperature_min"]

# ---------------------------------------------------------------- 2.1 sources and sinks


@query("read_features", views=("hourly",), dbl=HOURLY_DBL,
       sql="select ID, MAC_CODE, cast(Date_time as varchar) as Date_time, " + ", ".join(HOURLY_DBL) + " from hourly")
def read_features_q(spark, sf):
    """Write the quadruple table as ';' text, read it back with the features reader."""
    schema = io.features_schema(["value", "k"])
    h = V.hourly(spark, sf).select(*schema.fieldNames())
    path = scratch_path(spark, "features")
    io.write_delimited(h, path)
    return io.read_features(spark, path, schema).withColumn("Date_time", F.col("Date_time").cast("string"))


@query("read_labels", views=("sig",), dbl=["TARGET"], sql="select ID, value as TARGET from sig")
def read_labels_q(spark, sf):
    path = scratch_path(spark, "labels")
    io.write_delimited(V.sig(spark, sf).select("ID", F.col("value").alias("TARGET")), path)
    return io.read_labels(spark, path)


@query("read_scoring", views=("turbine",), dbl=TURBINE_DBL,
       sql="select ID, MAC_CODE, " + ", ".join(TURBINE_DBL) + " from turbine")
def read_scoring_q(spark, sf):
    schema = io.features_schema(["Rotor_speed", "Pitch_angle"], extra_doubles=["Generator_stator_temperature_min"])
    path = scratch_path(spark, "scoring")
    io.write_delimited(V.turbine(spark, sf).select(*schema.fieldNames()), path)
    return io.read_scoring(spark, path, schema).drop("Date_time")


@query("read_training_joined", dbl=["n_chars"],
       sql="select d.doc_id as ID, d.lang as MAC_CODE, cast(d.n_chars as double) as n_chars, "
           "cast(l.quality as double) as TARGET from documents d left join labels l on d.doc_id = l.doc_id")
def read_training_joined_q(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), F.col("lang").alias("MAC_CODE"),
                                                  F.col("n_chars").cast("double").alias("n_chars"))
    labs = V.table(spark, sf, "labels").select(F.col("doc_id").alias("ID"),
                                               F.col("quality").cast("double").alias("TARGET"))
    fpath, lpath = scratch_path(spark, "train-features"), scratch_path(spark, "train-labels")
    io.write_delimited(docs, fpath)
    io.write_delimited(labs, lpath)
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("MAC_CODE", T.StringType()),
                           T.StructField("n_chars", T.DoubleType())])
    return io.read_training_joined(spark, fpath, lpath, schema)


@query("read_projection", dbl=["dim0", "dim1"],
       sql="select vec_id as ID, cast(embedding[1] as double) as dim0, cast(embedding[2] as double) as dim1 "
           "from embeddings")
def read_projection_q(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ID"),
                                                F.col("embedding")[0].cast("double").alias("dim0"),
                                                F.col("embedding")[1].cast("double").alias("dim1"))
    path = scratch_path(spark, "projection")
    io.write_delimited(e, path)
    return io.read_projection(spark, path)


@query("write_predictions", views=("direction",), dbl=["TARGET"], sql="select ID, TARGET from direction")
def write_predictions_q(spark, sf):
    """Write (ID, TARGET) in key order and read the files back."""
    path = scratch_path(spark, "predictions")
    io.write_predictions(V.direction(spark, sf), path)
    return io.read_labels(spark, path)


# ---------------------------------------------------------------- 2.2 projections

@query("with_columns", views=("wide_keyed",), dbl={"LogTARGET": 9, "Rotor_speed3": 6, "IntRotor_speed": 6},
       sql="select okey, line, case when TARGET + 20 > 0 then log10(TARGET + 20) end as LogTARGET, "
           "TARGET >= 30000 as TargetSup600, Rotor_speed * Rotor_speed * Rotor_speed as Rotor_speed3, "
           "round_even(Rotor_speed, 0) as IntRotor_speed from wide_keyed")
def with_columns_q(spark, sf):
    w = V.wide_keyed(spark, sf)
    out = sel.with_columns(w, {"LogTARGET": sc.log_target(), "TargetSup600": F.col("TARGET") >= 30000,
                               "Rotor_speed3": sc.cube("Rotor_speed"), "IntRotor_speed": sc.round_even("Rotor_speed")})
    return out.select("okey", "line", "LogTARGET", "TargetSup600", "Rotor_speed3", "IntRotor_speed")


@query("select_columns", views=("hourly",), dbl=["value_max", "k"],
       sql="select MAC_CODE, ID, value_max, k from hourly")
def select_columns_q(spark, sf):
    return sel.select_columns(V.hourly(spark, sf), ["MAC_CODE", "ID", "value_max", "k"])


@query("select_by_dtype", views=("turbine",), dbl=TURBINE_DBL + ["TARGET"],
       sql="select " + ", ".join(TURBINE_DBL + ["TARGET"]) + " from turbine")
def select_by_dtype_q(spark, sf):
    return sel.select_by_dtype(V.turbine(spark, sf), "double")


@query("select_base_sensors", views=("hourly",), dbl=["k", "value"], sql="select ID, k, n, value from hourly")
def select_base_sensors_q(spark, sf):
    return sel.select_base_sensors(V.hourly(spark, sf))


_NULL_FREE = ["ID", "MAC_CODE", "Rotor_speed", "Rotor_speed_min", "Rotor_speed_max", "Pitch_angle",
              "Pitch_angle_min", "Pitch_angle_max", "Generator_stator_temperature_min", "TARGET"]


@query("select_null_free", views=("turbine",),
       dbl=[c for c in _NULL_FREE if c not in ("ID", "MAC_CODE")],
       sql="select cast(Date_time as varchar) as Date_time, " + ", ".join(_NULL_FREE) + " from turbine")
def select_null_free_q(spark, sf):
    out = sel.select_null_free(V.turbine(spark, sf))
    return out.withColumn("Date_time", F.col("Date_time").cast("string"))


@query("drop_columns", views=("hourly",), dbl=["value", "value_std", "k", "k_std"],
       sql="select ID, MAC_CODE, value, value_std, k, k_std, n from hourly")
def drop_columns_q(spark, sf):
    return sel.drop_columns(V.hourly(spark, sf), ["Date_time", "value_min", "value_max", "k_min", "k_max"])


@query("drop_null_columns", views=("wide",), dbl=["Pitch_angle", "TARGET"],
       sql="select MAC_CODE, grp, Pitch_angle, TARGET from wide")
def drop_null_columns_q(spark, sf):
    return sel.drop_null_columns(V.wide(spark, sf))


@query("rename_columns", views=("turbine",), dbl=["TargetMean", "TargetStd"],
       sql="select MAC_CODE, avg(TARGET) as TargetMean, stddev_samp(TARGET) as TargetStd from turbine group by MAC_CODE")
def rename_columns_q(spark, sf):
    agg = V.turbine(spark, sf).groupBy("MAC_CODE").agg(F.avg("TARGET").alias("mean"), F.stddev_samp("TARGET").alias("std"))
    return sel.rename_columns(agg, {"mean": "TargetMean", "std": "TargetStd"})


@query("distinct_units", views=("sig",), sql="select distinct MAC_CODE from sig where MAC_CODE is not null")
def distinct_units_q(spark, sf):
    return sel.distinct_units(V.sig(spark, sf))


@query("columns_except", views=("hourly",), dbl=HOURLY_DBL, sql="select ID, " + ", ".join(HOURLY_DBL) + " from hourly")
def columns_except_q(spark, sf):
    return sel.columns_except(V.hourly(spark, sf), ["Date_time", "MAC_CODE", "n"])


# ---------------------------------------------------------------- 2.3 filters

@query("filter_range", views=("signed",), dbl=["TARGET"],
       sql="select ID, TARGET from signed where TARGET > 0 and TARGET <= 1000")
def filter_range_q(spark, sf):
    return filters.filter_range(V.signed(spark, sf), "TARGET", 0, 1000).select("ID", "TARGET")


@query("filter_in", views=("direction",), dbl=["TARGET"],
       sql="select ID, MAC_CODE, TARGET from direction where MAC_CODE in ('1-URGENT', '2-HIGH')")
def filter_in_q(spark, sf):
    return filters.filter_in(V.direction(spark, sf), "MAC_CODE", ["1-URGENT", "2-HIGH"]).select("ID", "MAC_CODE", "TARGET")


@query("filter_null", views=("wide_keyed",), dbl=["TARGET"],
       sql="select okey, line, MAC_CODE, TARGET from wide_keyed where Grid_voltage is null")
def filter_null_q(spark, sf):
    nulls, _ = filters.split_null(V.wide_keyed(spark, sf), "Grid_voltage")
    return nulls.select("okey", "line", "MAC_CODE", "TARGET")


@query("filter_compound", views=("wide",), dbl={"sum_target": 2},
       sql="select MAC_CODE, count(*) as n, sum(TARGET) as sum_target from wide where not coalesce("
           f"Pitch_angle < {d(-0.035)} or Rotor_speed_std > {d(0.09)} or Grid_voltage >= {d(0.07)}, false) "
           "group by MAC_CODE")
def filter_compound_q(spark, sf):
    noise = ns.any_of(F.col("Pitch_angle") < -0.035, F.col("Rotor_speed_std") > 0.09, F.col("Grid_voltage") >= 0.07)
    _, clean = filters.split_mask(V.wide(spark, sf), noise)
    return clean.groupBy("MAC_CODE").agg(F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("sum_target"))


@query("split_regime2", views=("wide",), dbl={"sum_target": 2},
       sql="select case when coalesce(Rotor_speed * Rotor_speed * Rotor_speed >= 3375.0, false) then 'high' else 'low' end "
           "as regime, count(*) as n, sum(TARGET) as sum_target from wide group by 1")
def split_regime2_q(spark, sf):
    w = filters.with_regime(V.wide(spark, sf))
    return w.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.sum("TARGET").alias("sum_target"))


@query("keep_high_regime", views=("wide_keyed",), dbl=["Rotor_speed", "TARGET"],
       sql="select okey, line, Rotor_speed, TARGET from wide_keyed where Rotor_speed >= 15")
def keep_high_regime_q(spark, sf):
    return filters.keep_high_regime(V.wide_keyed(spark, sf)).select("okey", "line", "Rotor_speed", "TARGET")


@query("split_regime3", views=("wide",),
       sql="select case when Rotor_speed < 8.6 then 'low' when Rotor_speed < 15 then 'med' "
           "when Rotor_speed >= 15 then 'high' end as regime3, count(*) as n from wide group by 1")
def split_regime3_q(spark, sf):
    return filters.with_regime3(V.wide(spark, sf)).groupBy("regime3").agg(F.count(F.lit(1)).alias("n"))


@query("filter_band", views=("wide_keyed",), dbl=["Rotor_speed", "TARGET"],
       sql="select okey, line, Rotor_speed, TARGET from wide_keyed "
           "where TARGET >= 1500.0 * Rotor_speed - 1000.0 and TARGET <= 1500.0 * Rotor_speed + 1000.0")
def filter_band_q(spark, sf):
    return filters.filter_band(V.wide_keyed(spark, sf), "Rotor_speed", "TARGET", -1000.0, 1000.0, slope=1500.0) \
        .select("okey", "line", "Rotor_speed", "TARGET")


@query("drop_null_rows", views=("wide_keyed",), dbl=["Rotor_speed", "Grid_voltage"],
       sql="select okey, line, Rotor_speed, Grid_voltage from wide_keyed "
           "where Rotor_speed is not null and Grid_voltage is not null")
def drop_null_rows_q(spark, sf):
    return filters.drop_null_rows(V.wide_keyed(spark, sf).select("okey", "line", "Rotor_speed", "Grid_voltage"))


def _exp_sql(curve) -> str:
    a, b = curve
    return f"coalesce(TARGET > pow(10.0, {d(a)} * Rotor_speed + {d(b)}), false)"


def _poly_sql(x: str = "Rotor_speed") -> str:
    out = d(sc.POLY_COEFS_CENTRED[0])
    for c in sc.POLY_COEFS_CENTRED[1:]:
        out = f"({out} * ({x} - {d(sc.POLY_CENTRE)}) + {d(c)})"
    return out


REGIME3_SQL = ("case when Rotor_speed < 8.6 then 'low' when Rotor_speed < 15 then 'med' "
               "when Rotor_speed >= 15 then 'high' end")


@query("outlier_exponential", views=("wide",), bigint=("n_low_curve", "n_med_curve", "n_tag_curve"),
       sql=f"select {REGIME3_SQL} as regime3, count(*) as n, "
           f"count_if({_exp_sql(sc.EXP_CURVE_LOW)}) as n_low_curve, count_if({_exp_sql(sc.EXP_CURVE_MED)}) as n_med_curve, "
           f"count_if({_exp_sql(sc.EXP_CURVE_TAG)}) as n_tag_curve from wide group by 1")
def outlier_exponential_q(spark, sf):
    w = filters.with_regime3(V.wide(spark, sf))
    return w.groupBy("regime3").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(filters.outlier_exponential(curve=sc.EXP_CURVE_LOW)).alias("n_low_curve"),
        F.count_if(filters.outlier_exponential(curve=sc.EXP_CURVE_MED)).alias("n_med_curve"),
        F.count_if(filters.outlier_exponential(curve=sc.EXP_CURVE_TAG)).alias("n_tag_curve"))


@query("outlier_polynomial", views=("wide_keyed",), dbl=["Rotor_speed", "TARGET"],
       sql=f"select okey, line, Rotor_speed, TARGET from wide_keyed where Rotor_speed >= 15 "
           f"and coalesce(TARGET > {_poly_sql()}, false)")
def outlier_polynomial_q(spark, sf):
    w = filters.keep_high_regime(V.wide_keyed(spark, sf))
    return w.filter(filters.outlier_polynomial()).select("okey", "line", "Rotor_speed", "TARGET")


@query("partition_outliers", views=("wide",),
       sql=f"select {REGIME3_SQL} as regime3, case "
           f"when Rotor_speed < 8.6 then {_exp_sql(sc.EXP_CURVE_LOW)} "
           f"when Rotor_speed < 15 then {_exp_sql(sc.EXP_CURVE_MED)} "
           f"when Rotor_speed >= 15 then coalesce(TARGET > {_poly_sql()}, false) else false end as outlier, "
           "count(*) as n from wide group by 1, 2")
def partition_outliers_q(spark, sf):
    w = filters.partition_outliers(V.wide(spark, sf))
    return w.groupBy("regime3", "outlier").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- 2.4 joins

@query("join_left_key",
       sql="select d.doc_id as ID, d.lang, d.n_chars, l.quality, l.toxic from documents d "
           "left join labels l on d.doc_id = l.doc_id")
def join_left_key_q(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "lang", "n_chars")
    labs = V.table(spark, sf, "labels").select(F.col("doc_id").alias("ID"), "quality", "toxic")
    return joins.join_left_key(docs, labs, "ID")


@query("join_computed_columns", views=("quads",), dbl=["Rotor_speed_cv", "Pitch_angle_cv", "TARGET"],
       sql="select MAC_CODE, TARGET, Rotor_speed_std / nullif(Rotor_speed, 0) as Rotor_speed_cv, "
           "Pitch_angle_std / nullif(Pitch_angle, 0) as Pitch_angle_cv from quads")
def join_computed_columns_q(spark, sf):
    q = profile.coef_variation(V.quads(spark, sf), ["Rotor_speed", "Pitch_angle"])
    return q.select("MAC_CODE", "TARGET", "Rotor_speed_cv", "Pitch_angle_cv")


@query("join_aggregates_wide", views=("turbine",),
       dbl=["TargetMean", "TargetStd", "Rotor_speedMean", "Pitch_angleMean"],
       sql="select MAC_CODE, avg(TARGET) as TargetMean, stddev_samp(TARGET) as TargetStd, "
           "avg(Rotor_speed) as Rotor_speedMean, avg(Pitch_angle) as Pitch_angleMean from turbine group by MAC_CODE")
def join_aggregates_wide_q(spark, sf):
    return joins.aggregates_side_by_side(V.turbine(spark, sf), "MAC_CODE", {
        "TargetMean": F.avg("TARGET"), "TargetStd": F.stddev_samp("TARGET"),
        "Rotor_speedMean": F.avg("Rotor_speed"), "Pitch_angleMean": F.avg("Pitch_angle")})


@query("semi_join_keys", dbl=["TARGET"],
       sql="select l_orderkey as ID, l_linenumber as line, l_extendedprice as TARGET from lineitem "
           "where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def semi_join_keys_q(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ID"), F.col("l_linenumber").alias("line"),
                                               F.col("l_extendedprice").alias("TARGET"))
    keys = V.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("ID"))
    return joins.semi_join_keys(li, keys, "ID")


@query("anti_keys", sql="select doc_id as ID from documents where doc_id not in (select doc_id from labels)")
def anti_keys_q(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"))
    labs = V.table(spark, sf, "labels").select(F.col("doc_id").alias("ID"))
    return joins.anti_keys(docs, labs, "ID")


@query("broadcast_fit_stats", views=("turbine",), dbl=["Rotor_speed_std", "speed_shift"],
       sql="select ID, coalesce(Rotor_speed_std, (select median(Rotor_speed_std) from turbine)) as Rotor_speed_std, "
           "Rotor_speed - (select min(Rotor_speed) from turbine) as speed_shift from turbine")
def broadcast_fit_stats_q(spark, sf):
    t = V.turbine(spark, sf)
    med = pos.exact_median(t, "Rotor_speed_std", out="Rotor_speed_std")
    out = joins.fill_from_stats(joins.attach_stats(t, t.agg(F.min("Rotor_speed").alias("_min_speed"))),
                                med, ["Rotor_speed_std"])
    return out.select("ID", "Rotor_speed_std", (F.col("Rotor_speed") - F.col("_min_speed")).alias("speed_shift"))


@query("threshold_grid_join", views=("wide",), dbl={"accuracy": 9}, bigint=("tp", "tn"),
       sql="select g.i / 100 as threshold, "
           "count_if(coalesce((Pitch_angle + 0.04) * 10 > g.i / 100, false) and TARGET <= 20000) as tp, "
           "count_if(not coalesce((Pitch_angle + 0.04) * 10 > g.i / 100, false) and not (TARGET <= 20000)) as tn, "
           "count(*) as n, (count_if(coalesce((Pitch_angle + 0.04) * 10 > g.i / 100, false) and TARGET <= 20000) "
           "+ count_if(not coalesce((Pitch_angle + 0.04) * 10 > g.i / 100, false) and not (TARGET <= 20000))) "
           "/ count(*) as accuracy from wide, range(10, 96, 5) g(i) group by g.i")
def threshold_grid_join_q(spark, sf):
    w = V.wide(spark, sf).withColumn("score", (F.col("Pitch_angle") + 0.04) * 10)
    return corr.threshold_sweep(w, "score", F.col("TARGET") <= 20000)


# ---------------------------------------------------------------- 2.7 sorts, 2.8 set operations

@query("sort_by_key", views=("direction",), dbl=["TARGET"], sql="select ID, TARGET from direction order by ID")
def sort_by_key_q(spark, sf):
    return V.direction(spark, sf).select("ID", "TARGET").orderBy("ID")


@query("sort_by_value", views=("direction",),
       sql="select MAC_CODE, count(*) as n from direction group by MAC_CODE order by n desc, MAC_CODE")
def sort_by_value_q(spark, sf):
    return profile.value_counts(V.direction(spark, sf), "MAC_CODE").orderBy(F.desc("n"), "MAC_CODE")


@query("first_n", views=("direction",), dbl=["TARGET"],
       sql="select ID, TARGET from direction order by TARGET desc, ID limit 30")
def first_n_q(spark, sf):
    """Top-30 report: the limit is the feature."""
    return V.direction(spark, sf).select("ID", "TARGET").orderBy(F.desc("TARGET"), "ID").limit(30)


@query("union_regimes", views=("sig",), dbl=["TARGET"],
       sql="select r.ID, m.med as TARGET from (select ID, MAC_CODE, k, case when value >= 75 then 'high' else 'low' end "
           "as regime from sig) r join (select MAC_CODE, case when value >= 75 then 'high' else 'low' end as regime, "
           "median(k) as med from sig group by all) m on r.MAC_CODE is not distinct from m.MAC_CODE and r.regime = m.regime order by r.ID")
def union_regimes_q(spark, sf):
    """Per-regime predictions (regime median of k per unit) stacked and sorted by key."""
    s = V.sig(spark, sf)
    hi, lo = filters.split_mask(s, F.col("value") >= 75)
    parts = []
    for part in (hi, lo):
        med = pos.exact_median(part, "k", ["MAC_CODE"], out="TARGET")
        parts.append(pos.join_null_safe(part, med, ["MAC_CODE"]).select("ID", "TARGET"))
    return parts[0].unionByName(parts[1]).orderBy("ID")
