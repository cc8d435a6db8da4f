"""Queries for aggregations, profiles, binned summaries, correlation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustframe.functions import scalars as sc
from gustframe.operators import bins, corr, profile, sketches, windows
from gustframe.operators import positions as pos
from gustframe.plans.catalog import query
from gustframe.plans.q_frames import d
from gustframe.session import scratch_table
from gustframe.sources import driver_views as V

WIDE_NUM = ["Rotor_speed", "Rotor_speed_std", "Grid_voltage", "Pitch_angle", "TARGET"]
WIDE_ALL = ["MAC_CODE", "grp"] + WIDE_NUM
QUANTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
SECTOR_W = sc.sector_width()
SECTOR_SQL = (f"case when Nacelle_angle >= 0 and Nacelle_angle <= 360 then "
              f"cast(greatest(ceil(Nacelle_angle / {d(SECTOR_W)}) - 1, 0) as int) end")
LOGT_SQL = "case when TARGET + 20 > 0 then log10(TARGET + 20) end"


def union_sql(parts) -> str:
    return " union all ".join(parts)


def q_sql(value: str, src: str, probs, group: str | None = None, where: str = "") -> str:
    """Long-form exact quantiles in DuckDB text."""
    g = f"{group}, " if group else ""
    gb = f" group by {group}" if group else ""
    return union_sql(f"select {g}{d(p)} as q, quantile_cont({value}, {p}) as value from {src}{where}{gb}" for p in probs)


# ---------------------------------------------------------------- 2.5 aggregations

@query("row_column_count", views=("wide",), sql="select count(*) as n_rows, 7 as n_cols from wide")
def row_column_count_q(spark, sf):
    return profile.row_column_count(V.wide(spark, sf))


_DESC = ["mean", "std", "min", "max", "q25", "q50", "q75"]
_DESC_SQL = ("count(TARGET) as count, avg(TARGET) as mean, stddev_samp(TARGET) as std, min(TARGET) as min, "
             "max(TARGET) as max, quantile_cont(TARGET, 0.25) as q25, quantile_cont(TARGET, 0.5) as q50, "
             "quantile_cont(TARGET, 0.75) as q75")


@query("describe", views=("signed",), dbl=_DESC, sql=f"select {_DESC_SQL} from signed")
def describe_q(spark, sf):
    return profile.describe(V.signed(spark, sf), "TARGET")


@query("describe_by_group", views=("signed",), dbl=_DESC, sql=f"select MAC_CODE, {_DESC_SQL} from signed group by MAC_CODE")
def describe_by_group_q(spark, sf):
    return profile.describe(V.signed(spark, sf), "TARGET", ["MAC_CODE"])


@query("quantiles", views=("signed",), dbl=["value"], sql=q_sql("TARGET", "signed", QUANTS))
def quantiles_q(spark, sf):
    return profile.quantiles(V.signed(spark, sf), "TARGET", QUANTS)


_QG = [0.1, 0.25, 0.5, 0.75, 0.9]
_DIR_BINNED = f"(select MAC_CODE, {SECTOR_SQL} as sector, {LOGT_SQL} as LogTARGET, TARGET from direction) b"


def _dir_binned(spark, sf):
    return V.direction(spark, sf).select("MAC_CODE", sc.cut_edges("Nacelle_angle").alias("sector"),
                                         sc.log_target().alias("LogTARGET"), "TARGET")


@query("quantiles_by_group", views=("direction",), dbl=["value"],
       sql=q_sql("LogTARGET", _DIR_BINNED, _QG, group="MAC_CODE, sector", where=" where sector is not null"))
def quantiles_by_group_q(spark, sf):
    return profile.quantiles(_dir_binned(spark, sf), "LogTARGET", _QG, ["MAC_CODE", "sector"])


@query("median_by_bin", views=("direction",), dbl=["median"],
       sql=f"select MAC_CODE, sector, median(TARGET) as median from {_DIR_BINNED} where sector is not null "
           "group by MAC_CODE, sector")
def median_by_bin_q(spark, sf):
    return profile.median_by(_dir_binned(spark, sf), "TARGET", ["MAC_CODE", "sector"])


@query("slice_group_level", views=("direction",), dbl=["value"],
       sql=f"select sector, quantile_cont(LogTARGET, 0.5) as value from {_DIR_BINNED} "
           "where sector is not null and MAC_CODE = '1-URGENT' group by sector")
def slice_group_level_q(spark, sf):
    qs = profile.quantiles(_dir_binned(spark, sf), "LogTARGET", _QG, ["MAC_CODE", "sector"])
    return profile.slice_level(qs, MAC_CODE="1-URGENT", q=0.5).select("sector", "value")


@query("share_where", views=("signed",), dbl={"share": 9}, bigint=("n_true",),
       sql="select avg(case when TARGET < 0 then 1.0 else 0.0 end) as share, count_if(TARGET < 0) as n_true, "
           "count(*) as n_rows from signed")
def share_where_q(spark, sf):
    return profile.share_where(V.signed(spark, sf), F.col("TARGET") < 0)


@query("value_counts", views=("wide",),
       sql="select Rotor_speed, count(*) as n from wide where Rotor_speed is not null group by Rotor_speed")
def value_counts_q(spark, sf):
    return profile.value_counts(V.wide(spark, sf), "Rotor_speed")


@query("value_counts_share", views=("direction",), dbl={"share": 9},
       sql="select MAC_CODE, count(*) as n, count(*) / (select count(*) from direction) as share "
           "from direction group by MAC_CODE")
def value_counts_share_q(spark, sf):
    return profile.value_counts_share(V.direction(spark, sf), "MAC_CODE")


def _nulls_sql(src: str, cols, where: str = "") -> str:
    return union_sql(f"select '{c}' as \"column\", count_if({c} is null) as n_null from {src}{where}" for c in cols)


@query("null_count_by_column", views=("wide",), bigint=("n_null",), sql=_nulls_sql("wide", WIDE_ALL))
def null_count_by_column_q(spark, sf):
    return profile.null_count_by_column(V.wide(spark, sf))


_NPR = " + ".join(f"cast({c} is null as int)" for c in WIDE_ALL)


@query("null_count_per_row", views=("wide",), dbl={"share": 9},
       sql=f"select {_NPR} as n_null, count(*) as n_rows, count(*) / (select count(*) from wide) as share "
           "from wide group by 1")
def null_count_per_row_q(spark, sf):
    return profile.null_count_per_row(V.wide(spark, sf))


@query("null_pattern", views=("wide",), bigint=("n_null",), sql=_nulls_sql("wide", WIDE_ALL, f" where {_NPR} = 2"))
def null_pattern_q(spark, sf):
    return profile.null_pattern(V.wide(spark, sf), 2)


@query("null_rate_by_group", views=("wide",), dbl={"null_rate": 9},
       sql="select MAC_CODE, avg(case when Grid_voltage is null then 1.0 else 0.0 end) as null_rate, count(*) as n "
           "from wide where MAC_CODE is not null group by MAC_CODE")
def null_rate_by_group_q(spark, sf):
    return profile.null_rate_by_group(V.wide(spark, sf), "Grid_voltage")


@query("zero_count", views=("wide",), bigint=("n_zero",),
       sql=union_sql(f"select '{c}' as \"column\", count_if({c} = 0) as n_zero from wide" for c in WIDE_NUM))
def zero_count_q(spark, sf):
    return profile.zero_count(V.wide(spark, sf), WIDE_NUM)


_ZPR = " + ".join(f"cast(coalesce({c} = 0, false) as int)" for c in WIDE_NUM)


@query("zero_count_rows", views=("wide",), dbl={"share": 9},
       sql=f"select {_ZPR} as n_zero, count(*) as n_rows, count(*) / (select count(*) from wide) as share "
           "from wide group by 1")
def zero_count_rows_q(spark, sf):
    return profile.zero_count_per_row(V.wide(spark, sf), WIDE_NUM)


QUAD_SENSORS = ["Rotor_speed", "Pitch_angle"]


def _oob_sql(s: str) -> str:
    return f"(coalesce({s} > {s}_max, false) or coalesce({s} < {s}_min, false))"


@query("flag_bounds", views=("quads",), bigint=("n_out",),
       sql=union_sql(f"select '{s}' as sensor, count_if({_oob_sql(s)}) as n_out from quads" for s in QUAD_SENSORS))
def flag_bounds_q(spark, sf):
    return profile.flag_bounds(V.quads(spark, sf), QUAD_SENSORS)


@query("flag_bounds_rows", views=("quads",), dbl={"share": 9},
       sql="select " + " + ".join(f"cast({_oob_sql(s)} as int)" for s in QUAD_SENSORS) +
           " as n_out, count(*) as n_rows, count(*) / (select count(*) from quads) as share from quads group by 1")
def flag_bounds_rows_q(spark, sf):
    return profile.flag_bounds_per_row(V.quads(spark, sf), QUAD_SENSORS)


@query("check_max_lt_min", views=("quads",), bigint=("n",),
       sql="select * from (" + union_sql(f"select '{s}' as sensor, count_if({s}_max < {s}_min) as n from quads"
                                          for s in QUAD_SENSORS) + ") t where n > 0")
def check_max_lt_min_q(spark, sf):
    return profile.check_max_lt_min(V.quads(spark, sf), QUAD_SENSORS)


@query("check_constant", views=("quads",), bigint=("n_minmax_equal", "n_std_zero"),
       sql=union_sql(f"select '{s}' as sensor, count_if({s}_min = {s}_max) as n_minmax_equal, "
                     f"count_if({s}_std = 0) as n_std_zero from quads" for s in QUAD_SENSORS))
def check_constant_q(spark, sf):
    return profile.check_constant(V.quads(spark, sf), QUAD_SENSORS)


@query("coef_variation", views=("hourly",), dbl=["value_cv", "k_cv"],
       sql="select ID, value_std / nullif(value, 0) as value_cv, k_std / nullif(k, 0) as k_cv from hourly")
def coef_variation_q(spark, sf):
    return profile.coef_variation(V.hourly(spark, sf), ["value", "k"]).select("ID", "value_cv", "k_cv")


_EXT = [f"{c}_{m}" for c in WIDE_NUM for m in ("gmin", "gmax")]


@query("global_extrema", views=("wide",), dbl=_EXT,
       sql="select " + ", ".join(f"min({c}) as {c}_gmin, max({c}) as {c}_gmax" for c in WIDE_NUM) + " from wide")
def global_extrema_q(spark, sf):
    return profile.global_extrema(V.wide(spark, sf), WIDE_NUM)


@query("nunique", views=("wide",),
       sql=union_sql(f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from wide" for c in WIDE_ALL))
def nunique_q(spark, sf):
    return profile.nunique(V.wide(spark, sf), WIDE_ALL)


@query("nunique_sketch", views=("wide",),
       sql=union_sql(f"select '{c}' as \"column\", count(distinct {c}) as n_distinct, true as within_bound from wide" for c in WIDE_ALL))
def nunique_sketch_q(spark, sf):
    """Exact distinct counts, and whether the estimate from stored sketches per unit,
    merged, keeps within three standard errors."""
    w = V.wide(spark, sf)
    units = scratch_table(sketches.distinct_sketches(w, WIDE_ALL, ["MAC_CODE"]), "hll")
    est = sketches.distinct_counts(units).withColumnRenamed("n_distinct", "estimate")
    off = F.abs(F.col("estimate") - F.col("n_distinct"))
    return (profile.nunique(w, WIDE_ALL).join(est, "column")
            .select("column", "n_distinct", (off <= 3 * sketches.distinct_error() * F.col("n_distinct")).alias("within_bound")))


_SKETCH_Q = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("quantile_sketch", views=("wide",), sql=union_sql(f"select {d(p)} as q, count(TARGET) as n, true as within_bound from wide" for p in _SKETCH_Q), dbl={"q": 6})
def quantile_sketch_q(spark, sf):
    """Quantiles from stored sketches per unit, merged: the rows behind each and
    whether its true rank keeps within twice the rank error."""
    w = V.wide(spark, sf)
    units = scratch_table(sketches.quantile_sketches(w, "TARGET", ["MAC_CODE"]), "kll")
    got = sketches.sketched_quantiles(units, _SKETCH_Q).collect()  # a row a probability
    below = w.agg(*[F.count_if(F.col("TARGET") < r.value).alias(f"lo{i}") for i, r in enumerate(got)],
                  *[F.count_if(F.col("TARGET") <= r.value).alias(f"hi{i}") for i, r in enumerate(got)]).first()
    slack = 2 * sketches.rank_error()
    rows = [(r.q, r.n, below[f"lo{i}"] / r.n - slack <= r.q <= below[f"hi{i}"] / r.n + slack) for i, r in enumerate(got)]
    return spark.createDataFrame(rows, "q double, n long, within_bound boolean")


_PIV_BINS = 5


def _pivot_sql() -> str:
    binned = ("(select cast(greatest(ceil((Rotor_speed - s.xmin) / ((s.xmax - s.xmin) / 5.0)) - 1, 0) as int) as bx, "
              "cast(greatest(ceil((Pitch_angle - s.ymin) / ((s.ymax - s.ymin) / 5.0)) - 1, 0) as int) as by_, TARGET "
              "from wide, (select min(Rotor_speed) as xmin, max(Rotor_speed) as xmax, min(Pitch_angle) as ymin, "
              "max(Pitch_angle) as ymax from wide) s where Rotor_speed is not null and Pitch_angle is not null) b")
    cells = ", ".join(f"median(case when by_ = {i} then TARGET end) as \"{i}\"" for i in range(_PIV_BINS))
    return f"select bx, {cells} from {binned} group by bx"


@query("pivot_median_2d", views=("wide",), dbl=[str(i) for i in range(_PIV_BINS)], sql=_pivot_sql())
def pivot_median_2d_q(spark, sf):
    return bins.pivot_median_2d(V.wide(spark, sf), "Rotor_speed", "Pitch_angle", "TARGET", _PIV_BINS, _PIV_BINS)


@query("group_multi_agg", views=("wide",), dbl=["median", "mean", "std"],
       sql="select grp, avg(TARGET) as mean, stddev_samp(TARGET) as std, count(*) as size, median(TARGET) as median "
           "from wide where grp is not null group by grp")
def group_multi_agg_q(spark, sf):
    return profile.group_multi_agg(V.wide(spark, sf), "TARGET", "grp")


_PROF = ["Rotor_speed", "Pitch_angle", "Generator_stator_temperature_min"]


@query("group_profile_wide", views=("turbine",), dbl=["TargetMean", "TargetStd"] + [f"{s}Mean" for s in _PROF],
       sql="select MAC_CODE, avg(TARGET) as TargetMean, stddev_samp(TARGET) as TargetStd, " +
           ", ".join(f"avg({s}) as {s}Mean" for s in _PROF) + " from turbine group by MAC_CODE")
def group_profile_wide_q(spark, sf):
    return profile.group_profile_wide(V.turbine(spark, sf), "TARGET", _PROF, "MAC_CODE")


# ---------------------------------------------------------------- rank correlation

def spearman_sql(src: str, pairs, a_name: str = "col_a", b_name: str = "col_b") -> str:
    parts = []
    for a, b in pairs:
        parts.append(
            f"select '{a}' as {a_name}, '{b}' as {b_name}, corr(rx, ry) as rho, count(*) as n from ("
            f"select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, "
            f"rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from ("
            f"select cast({a} as double) as x, cast({b} as double) as y from {src} "
            f"where {a} is not null and {b} is not null) p) r")
    return union_sql(parts)


_SP_COLS = WIDE_NUM
_SP_PAIRS = [(a, b) for i, a in enumerate(_SP_COLS) for b in _SP_COLS[i + 1:]]


@query("spearman_matrix", views=("wide",), dbl={"rho": 9}, sql=spearman_sql("wide", _SP_PAIRS))
def spearman_matrix_q(spark, sf):
    return corr.spearman_matrix(V.wide(spark, sf, spread=True), _SP_COLS)


_RES_SRC = ("(select w.*, w.TARGET - m.med as residual from wide w join "
            "(select MAC_CODE, median(TARGET) as med from wide group by MAC_CODE) m on w.MAC_CODE is not distinct from m.MAC_CODE) r")


def _residual_wide(spark, sf):
    w = V.wide(spark, sf, spread=True)
    med = scratch_table(pos.exact_median(w, "TARGET", ["MAC_CODE"], out="_med"), "medians")
    return pos.join_null_safe(w, pos.counted_side(med), ["MAC_CODE"]).withColumn("residual", F.col("TARGET") - F.col("_med"))


_ERR_FEATS = ["Rotor_speed", "Rotor_speed_std", "Grid_voltage", "Pitch_angle"]


@query("error_correlation", views=("wide",), dbl={"rho": 9},
       sql="select col_b as feature, rho, n from (" + spearman_sql(_RES_SRC, [("residual", f) for f in _ERR_FEATS]) + ") t")
def error_correlation_q(spark, sf):
    return corr.error_correlation(_residual_wide(spark, sf), "residual", _ERR_FEATS)


@query("crosstab", views=("wide",), bigint=("high", "low"),
       sql="select MAC_CODE, count_if(regime = 'high') as high, count_if(regime = 'low') as low from ("
           "select MAC_CODE, case when coalesce(Rotor_speed >= 15, false) then 'high' else 'low' end as regime "
           "from wide) t where MAC_CODE is not null group by MAC_CODE")
def crosstab_q(spark, sf):
    from gustframe.operators import filters
    w = filters.with_regime(V.wide(spark, sf), by_cube=False)
    return corr.crosstab(w, "MAC_CODE", "regime", ["high", "low"])


@query("confusion_accuracy", views=("wide",), dbl={"accuracy": 9}, bigint=("tn", "fp", "fn", "tp"),
       sql="select count_if(not y and not p) as tn, count_if(not y and p) as fp, count_if(y and not p) as fn, "
           "count_if(y and p) as tp, count(*) as n, (count_if(not y and not p) + count_if(y and p)) / count(*) as accuracy "
           "from (select coalesce(TARGET <= 20000, false) as y, coalesce(Pitch_angle > 0, false) as p from wide) t")
def confusion_accuracy_q(spark, sf):
    return corr.confusion_accuracy(V.wide(spark, sf), F.col("TARGET") <= 20000, F.col("Pitch_angle") > 0)


# ---------------------------------------------------------------- binned summaries

_H = 20


@query("histogram", views=("wide",), dbl=["lo", "hi"],
       sql=f"select cast(g.i as int) as bin, s.lo + g.i * s.w as lo, s.lo + (g.i + 1) * s.w as hi, "
           f"coalesce(c.n, 0) as n from (select min(Rotor_speed) as lo, (max(Rotor_speed) - min(Rotor_speed)) / {_H}.0 as w "
           f"from wide) s cross join range(0, {_H}) g(i) left join (select cast(least(floor((Rotor_speed - s2.lo) / s2.w), "
           f"{_H - 1}) as int) as b, count(*) as n from wide, (select min(Rotor_speed) as lo, "
           f"(max(Rotor_speed) - min(Rotor_speed)) / {_H}.0 as w from wide) s2 where Rotor_speed is not null group by 1) c "
           f"on c.b = g.i")
def histogram_q(spark, sf):
    return bins.histogram(V.wide(spark, sf), "Rotor_speed", _H)


_OV = ["Rotor_speed", "Pitch_angle", "Rotor_speed_std"]


def _overlay_sql() -> str:
    longs = union_sql(f"select case when TARGET >= 30000 then 'high' else 'low' end as subset, '{s}' as sensor, "
                      f"{s} as v from wide where {s} is not null" for s in _OV)
    return ("select subset, l.sensor, cast(least(floor((v - s.mn) / ((s.mx - s.mn) / 10.0)), 9) as int) as bin, "
            f"count(*) as n from ({longs}) l join (select sensor, min(v) as mn, max(v) as mx from ({longs}) t "
            "group by sensor) s on l.sensor = s.sensor group by 1, 2, 3")


@query("histogram_overlay", views=("wide",), sql=_overlay_sql())
def histogram_overlay_q(spark, sf):
    w = V.wide(spark, sf, spread=True).withColumn("subset", F.when(F.col("TARGET") >= 30000, "high").otherwise("low"))
    return bins.histogram_overlay(w, _OV, "subset", 10)


@query("box_stats", views=("direction",), dbl=["q1", "median", "q3", "whisker_lo", "whisker_hi"], bigint=("n_outliers",),
       sql="select q.MAC_CODE, q1, median, q3, min(case when TARGET between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) "
           "then TARGET end) as whisker_lo, max(case when TARGET between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) "
           "then TARGET end) as whisker_hi, count_if(not (TARGET between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) "
           "as n_outliers, count(*) as n from direction d join (select MAC_CODE, quantile_cont(TARGET, 0.25) as q1, "
           "quantile_cont(TARGET, 0.5) as median, quantile_cont(TARGET, 0.75) as q3 from direction group by MAC_CODE) q "
           "on d.MAC_CODE = q.MAC_CODE group by q.MAC_CODE, q1, median, q3")
def box_stats_q(spark, sf):
    return bins.box_stats(V.direction(spark, sf), "TARGET", "MAC_CODE")


_KG = 40


@query("kde", views=("direction",), dbl={"g": 9, "density": 8},
       sql=f"select s.MAC_CODE, cast(g.i as int) as i, (s.mn - 0.5 * (s.mx - s.mn)) + g.i * (2.0 * (s.mx - s.mn)) / {_KG - 1}.0 "
           f"as g, sum(exp(-0.5 * power(((s.mn - 0.5 * (s.mx - s.mn)) + g.i * (2.0 * (s.mx - s.mn)) / {_KG - 1}.0 - v.x) / s.h, 2))) "
           f"/ (s.n * s.h * sqrt(2 * pi())) as density from (select MAC_CODE, {LOGT_SQL} as x from direction) v "
           f"join (select MAC_CODE, count(x) as n, min(x) as mn, max(x) as mx, stddev_samp(x) * pow(count(x), -0.2) as h "
           f"from (select MAC_CODE, {LOGT_SQL} as x from direction) t where x is not null group by MAC_CODE) s "
           f"on v.MAC_CODE = s.MAC_CODE cross join range(0, {_KG}) g(i) where v.x is not null "
           f"group by s.MAC_CODE, g.i, s.mn, s.mx, s.n, s.h")
def kde_q(spark, sf):
    src = V.direction(spark, sf).select("MAC_CODE", sc.log_target().alias("x"))
    return bins.kde(src, "x", "MAC_CODE", _KG)


_D2_PAIRS = [("Rotor_speed", "TARGET"), ("Pitch_angle", "TARGET")]


def _density_sql() -> str:
    longs = union_sql(f"select '{a}' as x_col, '{b}' as y_col, cast({a} as double) as x, cast({b} as double) as y, "
                      f"TARGET as _t from wide where {a} is not null and {b} is not null" for a, b in _D2_PAIRS)
    return ("select l.x_col, l.y_col, cast(least(floor((x - xmn) / ((xmx - xmn) / 10.0)), 9) as int) as bx, "
            "cast(least(floor((y - ymn) / ((ymx - ymn) / 10.0)), 9) as int) as by, count(*) as n, sum(_t) as target_sum "
            f"from ({longs}) l join (select x_col, y_col, min(x) as xmn, max(x) as xmx, min(y) as ymn, max(y) as ymx "
            f"from ({longs}) t group by 1, 2) s on l.x_col = s.x_col and l.y_col = s.y_col group by 1, 2, 3, 4")


@query("density_2d", views=("wide",), dbl={"target_sum": 2}, sql=_density_sql())
def density_2d_q(spark, sf):
    """Counts and target sums per cell (sums of cent values round exactly;
    the mean is target_sum / n)."""
    d2 = bins.density_2d(V.wide(spark, sf, spread=True), _D2_PAIRS, target="TARGET")
    return d2.drop("target_mean")


@query("polar_profile", views=("direction",), dbl=["mid_deg", "mid_rad", "median"],
       sql=f"select sector, (sector + 0.5) * {d(SECTOR_W)} as mid_deg, radians((sector + 0.5) * {d(SECTOR_W)}) as mid_rad, "
           f"median(TARGET) as median from {_DIR_BINNED} where sector is not null group by sector")
def polar_profile_q(spark, sf):
    return bins.polar_profile(V.direction(spark, sf), "Nacelle_angle", "TARGET")


# ---------------------------------------------------------------- 2.6 windows

@query("lag_diff", views=("sig",), dbl=["value_before", "k_before"],
       sql="select ID, lag(value) over w - value as value_before, lag(k) over w - k as k_before from sig "
           "window w as (partition by MAC_CODE order by Date_time, ID)")
def lag_diff_q(spark, sf):
    return windows.lag_diff(V.sig(spark, sf), ["value", "k"]).select("ID", "value_before", "k_before")


@query("kfold_blocks", views=("sig",), sql="select ID, cast(ntile(5) over (order by ID) as int) as fold from sig")
def kfold_blocks_q(spark, sf):
    return windows.kfold_blocks(V.sig(spark, sf), 5).select("ID", "fold")


@query("kfold_shuffled", views=("sig",),
       sql="select ID, cast(ntile(5) over (order by md5('7:' || cast(ID as varchar)), ID) as int) as fold from sig")
def kfold_shuffled_q(spark, sf):
    return windows.kfold_shuffled(V.sig(spark, sf), 5, seed=7).select("ID", "fold")


@query("split_holdout", views=("sig",),
       sql="select ID, row_number() over (order by md5('345:' || cast(ID as varchar)), ID) "
           "<= ceil(0.2 * (select count(*) from sig)) as is_test from sig")
def split_holdout_q(spark, sf):
    return windows.split_holdout(V.sig(spark, sf), 0.2, seed=345).select("ID", "is_test")


@query("split_stratified", views=("sig",),
       sql="select ID, row_number() over (partition by MAC_CODE order by md5('345:' || cast(ID as varchar)), ID) "
           "<= ceil(0.2 * count(*) over (partition by MAC_CODE)) as is_test from sig")
def split_stratified_q(spark, sf):
    return windows.split_stratified(V.sig(spark, sf), "MAC_CODE", 0.2, seed=345).select("ID", "is_test")


@query("split_stratified_null_units", views=("sig",),
       sql="select ID, row_number() over (partition by u order by md5('345:' || cast(ID as varchar)), ID) "
           "<= ceil(0.2 * count(*) over (partition by u)) as is_test from (select *, nullif(MAC_CODE, 'click') as u from sig) s")
def split_stratified_null_units_q(spark, sf):
    """Rows without a unit are a stratum of their own; small buckets, so that the
    bucketed path runs on every table."""
    s = V.sig(spark, sf).withColumn("u", F.expr("nullif(MAC_CODE, 'click')"))
    return windows.split_stratified(s, "u", 0.2, seed=345, rows_per_bucket=500).select("ID", "is_test")


@query("quantiles_null_units", views=("sig",), dbl=["value"],
       sql=" union all ".join(f"select u, cast({q} as double) as q, quantile_cont(value, {q}) as value from "
                              "(select nullif(MAC_CODE, 'click') as u, value from sig) s group by u" for q in (0.1, 0.5, 0.9)))
def quantiles_null_units_q(spark, sf):
    s = V.sig(spark, sf).withColumn("u", F.expr("nullif(MAC_CODE, 'click')"))
    return pos.exact_quantiles(s, "value", [0.1, 0.5, 0.9], ["u"], rows_per_bucket=500)


@query("rank_average", views=("wide_keyed",), dbl={"rank": 3},
       sql="select okey, line, Rotor_speed, case when Rotor_speed is not null then rank() over (order by Rotor_speed) + "
           "(count(*) over (partition by Rotor_speed) - 1) / 2.0 end as rank from wide_keyed")
def rank_average_q(spark, sf):
    w = V.wide_keyed(spark, sf).select("okey", "line", "Rotor_speed")
    return windows.rank_average(w, "Rotor_speed", "rank")
