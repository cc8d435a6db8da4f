"""Filters, regime splits and outlier flags (all null-safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import nullsafe as ns
from gustframe.functions import scalars as sc


def range_mask(x, lo=None, hi=None, lo_closed: bool = False, hi_closed: bool = True) -> Column:
    """Range predicate; NULL x does not satisfy it (filter form, pushable)."""
    x = ns.col(x)
    parts = []
    if lo is not None:
        parts.append((x >= lo) if lo_closed else (x > lo))
    if hi is not None:
        parts.append((x <= hi) if hi_closed else (x < hi))
    cond = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        cond = cond & p
    return cond


def filter_range(df: DataFrame, x, lo=None, hi=None, lo_closed: bool = False, hi_closed: bool = True) -> DataFrame:
    return df.filter(range_mask(x, lo, hi, lo_closed, hi_closed))


def filter_in(df: DataFrame, x, values) -> DataFrame:
    return df.filter(ns.holds(ns.col(x).isin(*values)))


def split_null(df: DataFrame, x) -> tuple[DataFrame, DataFrame]:
    """(rows where x is NULL, rows where it is not)."""
    return df.filter(ns.col(x).isNull()), df.filter(ns.col(x).isNotNull())


def split_mask(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where cond holds, the null-safe complement)."""
    return df.filter(ns.holds(cond)), df.filter(ns.fails(cond))


def with_regime(df: DataFrame, speed: str = "Rotor_speed", cut: float = ns.HIGH_CUT, by_cube: bool = True,
                out: str = "regime") -> DataFrame:
    """Add 'high'/'low' (NULL speed -> 'low'); one column instead of two copies."""
    return df.withColumn(out, ns.regime2(speed, cut, by_cube))


def split_regime2(df: DataFrame, speed: str = "Rotor_speed", cut: float = ns.HIGH_CUT,
                  by_cube: bool = True) -> tuple[DataFrame, DataFrame]:
    """(high, low) with the same null-safe mask for every table it is applied to."""
    return split_mask(df, ns.high_condition(speed, cut, by_cube))


def keep_high_regime(df: DataFrame, keep_high: bool = True, speed: str = "Rotor_speed",
                     cut: float = ns.HIGH_CUT) -> DataFrame:
    cond = ns.col(speed) >= cut
    return df.filter(ns.holds(cond) if keep_high else ns.fails(cond))


def with_regime3(df: DataFrame, speed: str = "Rotor_speed", out: str = "regime3") -> DataFrame:
    return df.withColumn(out, ns.regime3(speed))


def filter_band(df: DataFrame, x: str, y: str, intercept_lo: float = sc.AFFINE_BAND[0],
                intercept_hi: float = sc.AFFINE_BAND[1], slope: float = sc.AFFINE_SLOPE) -> DataFrame:
    """Rows with slope*x + lo <= y <= slope*x + hi (plain arithmetic, no UDF)."""
    yv = F.col(y)
    return df.filter((yv >= sc.affine_curve(x, intercept_lo, slope)) & (yv <= sc.affine_curve(x, intercept_hi, slope)))


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def outlier_exponential(x="Rotor_speed", target="TARGET", curve=sc.EXP_CURVE_LOW) -> Column:
    """TARGET > 10**(a*x + b); NULL inputs -> False."""
    a, b = curve
    return ns.keep(ns.col(target) > sc.exp10_curve(x, a, b))


def outlier_polynomial(x="Rotor_speed", target="TARGET") -> Column:
    """TARGET above the high-speed least-squares curve; NULL -> False."""
    return ns.keep(ns.col(target) > sc.poly_curve(x))


def outlier_by_regime(speed: str = "Rotor_speed", target: str = "TARGET") -> Column:
    """Outlier flag with the curve of each 3-way regime; no regime -> False."""
    r = ns.regime3(speed)
    return (F.when(r == "low", outlier_exponential(speed, target, sc.EXP_CURVE_LOW))
            .when(r == "med", outlier_exponential(speed, target, sc.EXP_CURVE_MED))
            .when(r == "high", outlier_polynomial(speed, target))
            .otherwise(F.lit(False)))


def partition_outliers(df: DataFrame, speed: str = "Rotor_speed", target: str = "TARGET") -> DataFrame:
    """One pass: add ``regime3`` and ``outlier`` columns for all three regimes."""
    return df.withColumns({"regime3": ns.regime3(speed), "outlier": outlier_by_regime(speed, target)})
