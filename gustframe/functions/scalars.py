"""Scalar column expressions (built-in functions only, no UDF).

Rules that decide correctness across engines:

* division goes through ``try_divide`` (NULL on a zero divisor, also -0.0);
* ``log10`` is guarded so that ``x <= 0`` gives NULL;
* bin formulas are wrapped in ``when(x is not null)`` because ``greatest`` /
  ``least`` skip NULLs;
* bin indices are INT.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gustframe.functions.nullsafe import col, keep

# ---------------------------------------------------------------------------
# Fixed values (must equal the analysis they reproduce).
# Target offset before the log: log10(TARGET + 20).
LOG_TARGET_OFFSET = 20.0
# Exponential outlier curves TARGET > 10**(a*x + b), as (a, b).
EXP_CURVE_LOW = (0.112, 1.11)
EXP_CURVE_MED = (0.115, 1.15)
EXP_CURVE_TAG = (0.115, 1.34)
# High-speed outlier curve: degree-4 least squares through these knots.
POLY_KNOTS_X = [15.0, 15.25, 15.5, 15.75, 16.0, 16.25, 16.5, 16.75, 17.0, 17.25]
POLY_KNOTS_Y = [750, 810, 880, 900, 1000, 1100, 1200, 1400, 1700, 3000]
POLY_DEGREE = 4
# Affine band around the linear part of the high-speed cloud.
AFFINE_SLOPE = 975.0
AFFINE_BAND = (-14500.0, -14430.0)
# Direction sectors: 12 edges over 0..360 degrees -> 11 sectors.
SECTOR_RANGE = (0.0, 360.0)
SECTOR_EDGES = 12
# Unit groups of the sign feature.
UNITS_13 = ["WT1", "WT3"]
UNITS_24 = ["WT2", "WT4"]
# ---------------------------------------------------------------------------

# Centre of the knots: the fit is done in powers of (x - centre) so that the
# terms do not cancel (the raw-power coefficients reach 4e7).
POLY_CENTRE = 16.0
POLY_COEFS_CENTRED = [float(c) for c in
                      np.polyfit(np.array(POLY_KNOTS_X) - POLY_CENTRE,
                                 np.array(POLY_KNOTS_Y, dtype=float), POLY_DEGREE)]


def safe_div(num, den) -> Column:
    return F.try_divide(col(num), col(den))


def safe_log10(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.log10(x))


def log_target(target="TARGET", offset: float = LOG_TARGET_OFFSET) -> Column:
    return safe_log10(col(target) + F.lit(offset))


def turbulence(std="Rotor_speed_std", speed="Rotor_speed", min_speed=0.0) -> Column:
    """log10(std / (speed + fitted minimum speed + 0.1) + 0.1)."""
    m = min_speed if isinstance(min_speed, Column) else F.lit(float(min_speed))
    return safe_log10(safe_div(col(std), col(speed) + m + F.lit(0.1)) + F.lit(0.1))


def cube(x) -> Column:
    x = col(x)
    return x * x * x


def round_even(x) -> Column:
    """Round half to even (``rint``); ``round`` would give 3 for 2.5."""
    return F.rint(col(x))


def interact(a, b) -> Column:
    return col(a) * col(b)


def ratio_inf_as_minus_one(num, den) -> Column:
    """num/den with +-inf (non-zero / zero) mapped to -1 and 0/0 to NULL."""
    n, d = col(num), col(den)
    return F.when((d == 0) & (n != 0), F.lit(-1.0)).otherwise(safe_div(n, d))


def unit_number(unit="MAC_CODE") -> Column:
    """Last character of the unit code as INT; NULL when not a digit."""
    return F.expr(f"try_cast(right({unit}, 1) as int)") if isinstance(unit, str) else \
        F.right(unit, F.lit(1)).try_cast("int")


def shift_by_unit(x="Pitch_angle", min_x=0.0, unit="MAC_CODE") -> Column:
    m = min_x if isinstance(min_x, Column) else F.lit(float(min_x))
    return col(x) + F.abs(m) * unit_number(unit)


def unit_flags(unit="MAC_CODE") -> dict[str, Column]:
    u = col(unit)
    wt13 = keep(u.isin(*UNITS_13)).cast("int")
    wt24 = keep(u.isin(*UNITS_24)).cast("int")
    return {"WT13": wt13, "WT24": wt24, "eolCombi": wt24 - wt13}


def exp10_curve(x, a: float, b: float) -> Column:
    return F.pow(F.lit(10.0), F.lit(a) * col(x) + F.lit(b))


def horner(x, coefs, centre: float = 0.0) -> Column:
    """Evaluate sum(c_i (x-centre)^(deg-i)), coefficients highest power first."""
    t = col(x) - F.lit(centre) if centre else col(x)
    out = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        out = out * t + F.lit(float(c))
    return out


def poly_curve(x) -> Column:
    """The high-speed outlier curve."""
    return horner(x, POLY_COEFS_CENTRED, POLY_CENTRE)


def affine_curve(x, intercept: float, slope: float = AFFINE_SLOPE) -> Column:
    return F.lit(slope) * col(x) + F.lit(intercept)


def sector_width(lo: float = SECTOR_RANGE[0], hi: float = SECTOR_RANGE[1], n_edges: int = SECTOR_EDGES) -> float:
    return (hi - lo) / (n_edges - 1)


def cut_edges(x, lo: float = SECTOR_RANGE[0], hi: float = SECTOR_RANGE[1], n_edges: int = SECTOR_EDGES) -> Column:
    """Right-closed fixed-edge bin, lowest edge included; outside -> NULL."""
    x = col(x)
    w = sector_width(lo, hi, n_edges)
    idx = F.greatest(F.ceil((x - F.lit(lo)) / F.lit(w)) - 1, F.lit(0))
    return F.when((x >= lo) & (x <= hi), idx.cast("int"))


def cut_edges_mid(x, lo: float = SECTOR_RANGE[0], hi: float = SECTOR_RANGE[1], n_edges: int = SECTOR_EDGES) -> Column:
    w = sector_width(lo, hi, n_edges)
    return F.lit(lo) + (cut_edges(x, lo, hi, n_edges) + F.lit(0.5)) * F.lit(w)


def cut_equal(x, n: int, xmin, xmax) -> Column:
    """n right-closed equal bins over the observed [min, max]; min is in bin 0."""
    x = col(x)
    lo = xmin if isinstance(xmin, Column) else F.lit(float(xmin))
    hi = xmax if isinstance(xmax, Column) else F.lit(float(xmax))
    w = (hi - lo) / F.lit(float(n))
    idx = F.greatest(F.ceil(F.try_divide(x - lo, w)) - 1, F.lit(0))
    return F.when(x.isNotNull(), F.when(w == 0, F.lit(0)).otherwise(idx).cast("int"))


def hist_bin(x, n: int, xmin, xmax) -> Column:
    """Left-closed equal-width bin, last bin closed on both ends.

    A constant column spans [x - .5, x + .5] like ``numpy.histogram``.
    """
    x = col(x)
    lo = xmin if isinstance(xmin, Column) else F.lit(float(xmin))
    hi = xmax if isinstance(xmax, Column) else F.lit(float(xmax))
    lo2 = F.when(hi == lo, lo - 0.5).otherwise(lo)
    w = F.when(hi == lo, F.lit(1.0 / n)).otherwise((hi - lo) / F.lit(float(n)))
    idx = F.least(F.floor((x - lo2) / w), F.lit(n - 1))
    return F.when(x.isNotNull() & (x >= lo2), idx.cast("int"))


def hist_edges(n: int, xmin: float, xmax: float) -> list[float]:
    if xmin == xmax:
        xmin, xmax = xmin - 0.5, xmax + 0.5
    w = (xmax - xmin) / n
    return [xmin + i * w for i in range(n + 1)]


def shifted_log(x, xmin, offset: float = 0.1) -> Column:
    m = xmin if isinstance(xmin, Column) else F.lit(float(xmin))
    return safe_log10(col(x) + F.abs(m) + F.lit(offset))


def minmax_scale(x, xmin, xmax, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Scale to [lo, hi]; a constant column maps to ``lo``."""
    x = col(x)
    mn = xmin if isinstance(xmin, Column) else F.lit(float(xmin))
    mx = xmax if isinstance(xmax, Column) else F.lit(float(xmax))
    unit = F.coalesce(F.try_divide(x - mn, mx - mn), F.when(x.isNotNull(), F.lit(0.0)))
    return unit * F.lit(hi - lo) + F.lit(lo)


def zscore(x, mean, std) -> Column:
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = std if isinstance(std, Column) else F.lit(float(std))
    return F.try_divide(col(x) - m, s)


def log1p10(x) -> Column:
    return safe_log10(col(x) + F.lit(1.0))
