"""Data profiles: sizes, describe, quantiles, null / zero / bounds checks.

Checks over many sensors are generated as a *single* aggregation and then
unpivoted to long form, instead of one pass per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import nullsafe as ns
from gustframe.operators import positions as pos
from gustframe.operators import sketches

DESCRIBE_PROBS = [0.25, 0.5, 0.75]
DEFAULT_QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _long(row_df: DataFrame, names, var: str = "column", val: str = "n") -> DataFrame:
    """Unpivot a one-row aggregate to (var, val)."""
    return row_df.unpivot([], list(names), var, val)


def row_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def describe(df: DataFrame, x: str, group_cols=()) -> DataFrame:
    """count, mean, sample std, min, q25, median, q75, max (exact quantiles)."""
    group_cols = list(group_cols)
    src = df
    for g in group_cols:
        src = src.filter(F.col(g).isNotNull())
    base = src.groupBy(*group_cols).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    qs = pos.exact_quantiles_wide(src, x, DESCRIBE_PROBS, group_cols, names=["q25", "q50", "q75"])
    if group_cols:
        return base.join(qs, group_cols, "left")
    from gustframe.operators.joins import with_scalars
    return with_scalars(base, qs)


def quantiles(df: DataFrame, x: str, probs=DEFAULT_QUANTILES, group_cols=(), approx: bool = False,
              accuracy: int = 10_000) -> DataFrame:
    """Long-form quantiles (group..., q, value): exact linear interpolation by
    default; ``approx=True`` uses one ``percentile_approx`` pass (rank error
    about n / accuracy) when exactness is not needed."""
    group_cols = list(group_cols)
    src = df
    for g in group_cols:
        src = src.filter(F.col(g).isNotNull())
    if not approx:
        return pos.exact_quantiles(src, x, probs, group_cols)
    probs = [float(p) for p in probs]
    arr = src.groupBy(*group_cols).agg(F.percentile_approx(x, probs, accuracy).alias("_qs"))
    return arr.select(*group_cols, F.posexplode("_qs").alias("_i", "value")).select(
        *group_cols, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("q"),
        F.col("value").cast("double").alias("value"))


def median_by(df: DataFrame, x: str, group_cols, out: str = "median") -> DataFrame:
    src = df
    for g in group_cols:
        src = src.filter(F.col(g).isNotNull())
    return pos.exact_median(src, x, group_cols, out=out)


def slice_level(df: DataFrame, **levels) -> DataFrame:
    """Pick one value of one or more group keys out of a multi-key aggregate."""
    cond = F.lit(True)
    for k, v in levels.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def share_where(df: DataFrame, cond: Column, out: str = "share") -> DataFrame:
    """Share of all rows where ``cond`` holds (NULL counts as not holding)."""
    return df.agg(F.avg(ns.keep(cond).cast("double")).alias(out),
                  F.count_if(ns.keep(cond)).alias("n_true"), F.count(F.lit(1)).alias("n_rows"))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """Frequency per value, NULL excluded, ordered by value."""
    return df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n")).orderBy(x)


def value_counts_share(df: DataFrame, x: str) -> DataFrame:
    """Frequency per value as a share of *all* rows (the total is one row)."""
    total = df.count()
    counts = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(x, "n", (F.col("n") / F.lit(float(total) if total else None)).alias("share")).orderBy(x)


def null_count_by_column(df: DataFrame, columns=None) -> DataFrame:
    """(column, n_null), most nulls first, ties by name."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _long(row, columns, "column", "n_null").orderBy(F.desc("n_null"), "column")


def nulls_per_row(columns) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def null_count_per_row(df: DataFrame, columns=None) -> DataFrame:
    """Distribution of the number of NULL columns per row: (n_null, n_rows, share)."""
    columns = list(columns or df.columns)
    return value_counts_share(df.select(nulls_per_row(columns).alias("n_null")), "n_null") \
        .withColumnRenamed("n", "n_rows")


def null_pattern(df: DataFrame, k: int, columns=None) -> DataFrame:
    """Among rows with exactly ``k`` NULLs, NULL count per column."""
    columns = list(columns or df.columns)
    return null_count_by_column(df.filter(nulls_per_row(columns) == k), columns)


def null_rate_by_group(df: DataFrame, x: str, group: str = "MAC_CODE") -> DataFrame:
    return (df.filter(F.col(group).isNotNull()).groupBy(group)
            .agg(F.avg(F.col(x).isNull().cast("double")).alias("null_rate"),
                 F.count(F.lit(1)).alias("n")))


def zero_count(df: DataFrame, columns) -> DataFrame:
    """(column, n_zero) for the listed columns, fewest first as in the profile."""
    columns = list(columns)
    row = df.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    return _long(row, columns, "column", "n_zero").orderBy("n_zero", "column")


def zero_count_per_row(df: DataFrame, columns) -> DataFrame:
    zeros = sum((ns.keep(F.col(c) == 0).cast("int") for c in columns), F.lit(0))
    return value_counts_share(df.select(zeros.alias("n_zero")), "n_zero").withColumnRenamed("n", "n_rows")


def bounds_flags(sensors) -> dict[str, Column]:
    """Per sensor: mean above its max or below its min (NULL -> False)."""
    return {f"{s}_oob": ns.any_of(F.col(s) > F.col(f"{s}_max"), F.col(s) < F.col(f"{s}_min")) for s in sensors}


def flag_bounds(df: DataFrame, sensors) -> DataFrame:
    """(sensor, n_out) for every sensor, one aggregation."""
    flags = bounds_flags(sensors)
    row = df.agg(*[F.count_if(v).alias(s) for s, v in zip(sensors, flags.values())])
    return _long(row, sensors, "sensor", "n_out")


def flag_bounds_per_row(df: DataFrame, sensors) -> DataFrame:
    """Distribution of the number of out-of-bounds sensors per row."""
    flags = bounds_flags(sensors)
    total = sum((v.cast("int") for v in flags.values()), F.lit(0))
    return value_counts_share(df.select(total.alias("n_out")), "n_out").withColumnRenamed("n", "n_rows")


def check_max_lt_min(df: DataFrame, sensors) -> DataFrame:
    """(sensor, n) for sensors where some row has max < min."""
    row = df.agg(*[F.count_if(F.col(f"{s}_max") < F.col(f"{s}_min")).alias(s) for s in sensors])
    return _long(row, sensors, "sensor", "n").filter(F.col("n") > 0)


def check_constant(df: DataFrame, sensors) -> DataFrame:
    """(sensor, n_minmax_equal, n_std_zero), one aggregation for all sensors."""
    aggs = []
    for s in sensors:
        aggs += [F.count_if(F.col(f"{s}_min") == F.col(f"{s}_max")).alias(f"{s}__mm"),
                 F.count_if(F.col(f"{s}_std") == 0).alias(f"{s}__sd")]
    row = df.agg(*aggs)
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(f"{s}__mm").alias("n_minmax_equal"),
                 F.col(f"{s}__sd").alias("n_std_zero")) for s in sensors])).alias("r"))
    return stacked.select("r.*")


def coef_variation(df: DataFrame, sensors) -> DataFrame:
    """Add ``<s>_cv = <s>_std / <s>``; a zero mean gives NULL (no infinities)."""
    return df.withColumns({f"{s}_cv": F.try_divide(F.col(f"{s}_std"), F.col(s)) for s in sensors})


def global_extrema(df: DataFrame, columns) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_gmin"), F.max(c).alias(f"{c}_gmax")]
    return df.agg(*aggs)


def nunique(df: DataFrame, columns, approx: bool = False) -> DataFrame:
    """Exact distinct count per column: per column type, unpivot, de-duplicate
    (column, value), count per column.  A value shared by many rows is collapsed
    map-side; -0.0 is 0.0, and values stay in their own type.  ``approx=True`` counts
    by sketches in one pass without a shuffle of the values (``operators/sketches.py``)."""
    if approx:
        return sketches.distinct_counts(sketches.distinct_sketches(df, columns))
    types = dict(df.dtypes)
    columns, out = list(columns), None
    for t in dict.fromkeys(types[c] for c in columns):
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns if types[c] == t])).alias("cv"))
        value = F.col("v") + F.lit(0).cast(t) if t in ("double", "float") else F.col("v")
        part = (long.select("cv.column", "cv.v").filter(F.col("v").isNotNull()).select("column", value.alias("v")).distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
        out = part if out is None else out.unionByName(part)
    return out


def group_multi_agg(df: DataFrame, x: str, group: str) -> DataFrame:
    """median, mean, std, size per group, ordered by median."""
    src = df.filter(F.col(group).isNotNull())
    base = src.groupBy(group).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                                  F.count(F.lit(1)).alias("size"))
    med = pos.exact_median(src, x, [group])
    return base.join(med, [group], "left").orderBy("median", group)


def group_profile_wide(df: DataFrame, target: str, sensors, group: str) -> DataFrame:
    """TargetMean, TargetStd and the mean of every sensor per group: one aggregation."""
    src = df.filter(F.col(group).isNotNull())
    return src.groupBy(group).agg(F.avg(target).alias("TargetMean"), F.stddev_samp(target).alias("TargetStd"),
                                  *[F.avg(s).alias(f"{s}Mean") for s in sensors])
