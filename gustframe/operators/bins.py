"""Binned summaries: the tables behind histograms, box plots, densities,
2-D heat maps and polar charts.

Edges come from a one-row (or one-row-per-group) aggregate that is joined
back with a broadcast; nothing is collected per row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.functions import scalars as sc
from gustframe.operators import positions as pos

def _edges(stats: DataFrame, n: int, lo: str = "_min", hi: str = "_max") -> dict:
    const = F.col(hi) == F.col(lo)
    start = F.when(const, F.col(lo) - 0.5).otherwise(F.col(lo))
    width = F.when(const, F.lit(1.0 / n)).otherwise((F.col(hi) - F.col(lo)) / F.lit(float(n)))
    return {"start": start, "width": width}


def histogram(df: DataFrame, x: str, n: int = 10) -> DataFrame:
    """Equal-width histogram over min..max: (bin, lo, hi, n), empty bins included."""
    from gustframe.operators.joins import scalars
    st = scalars(df.agg(F.min(x).alias("_min"), F.max(x).alias("_max")))
    spark = df.sparkSession
    if st["_min"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    edges = sc.hist_edges(n, float(st["_min"]), float(st["_max"]))
    counts = (df.select(sc.hist_bin(x, n, st["_min"], st["_max"]).alias("bin"))
              .filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    start, width = edges[0], edges[1] - edges[0]
    all_bins = spark.range(n).select(F.col("id").cast("int").alias("bin"))  # n rows, a parameter
    return (all_bins.join(F.broadcast(counts), "bin", "left")  # at most n rows
            .select("bin", (F.lit(start) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(start) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def histogram_overlay(df: DataFrame, sensors, subset: str, n: int = 10, shared_edges: bool = True) -> DataFrame:
    """Histograms of many sensors for several row subsets in one job:
    (subset, sensor, bin, n).  ``shared_edges=False`` bins each subset over
    its own range."""
    from gustframe.operators.joins import scalars, small_table
    ends = [f(F.col(s).cast("double")).alias(f"{k}{i}") for i, s in enumerate(sensors) for k, f in (("_lo", F.min), ("_hi", F.max))]
    if shared_edges:  # one aggregate; its numbers become literals
        st = scalars(df.agg(*ends))
        rows, edge = df, lambda k, i: F.lit(st[f"{k}{i}"]).cast("double")
    else:  # one row per subset, broadcast only after a count check
        stats, small = small_table(df.groupBy(F.col(subset).alias("_subset")).agg(*ends))
        rows = df.join(F.broadcast(stats) if small else stats, F.col(subset).eqNullSafe(F.col("_subset")), "left")
        edge = lambda k, i: F.col(f"{k}{i}")
    binned = rows.select(F.col(subset).alias("subset"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("sensor"), sc.hist_bin(F.col(s).cast("double"), n, edge("_lo", i), edge("_hi", i)).alias("bin"))
        for i, s in enumerate(sensors)])).alias("sv")).select("subset", "sv.*").filter(F.col("bin").isNotNull())
    return binned.groupBy("subset", "sensor", "bin").agg(F.count(F.lit(1)).alias("n"))


def density_2d(df: DataFrame, pairs, target: str | None = None, nx: int = 10, ny: int = 10) -> DataFrame:
    """Joint 2-D bin counts (and mean target) for many column pairs at once:
    (x_col, y_col, bx, by, n[, target_mean, target_sum])."""
    from gustframe.operators.joins import scalars
    pairs = list(pairs)
    val = lambda c: F.col(c).cast("double")
    both = [val(a).isNotNull() & val(b).isNotNull() for a, b in pairs]
    st = scalars(df.agg(*[f(F.when(both[i], val(c))).alias(f"{k}{i}") for i, (a, b) in enumerate(pairs)
                          for k, f, c in (("x0_", F.min, a), ("x1_", F.max, a), ("y0_", F.min, b), ("y1_", F.max, b))]))
    lit = lambda k, i: F.lit(st[f"{k}{i}"]).cast("double")
    binned = df.select(*([F.col(target).alias("_t")] if target else []), F.explode(F.array(*[
        F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), both[i].alias("ok"),
                 sc.hist_bin(val(a), nx, lit("x0_", i), lit("x1_", i)).alias("bx"),
                 sc.hist_bin(val(b), ny, lit("y0_", i), lit("y1_", i)).alias("by")) for i, (a, b) in enumerate(pairs)])).alias("p"))
    binned = binned.select(*(["_t"] if target else []), "p.*").filter("ok")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.avg("_t").alias("target_mean"), F.sum("_t").alias("target_sum")]
                                              if target else [])
    return binned.groupBy("x_col", "y_col", "bx", "by").agg(*aggs)


def box_stats(df: DataFrame, x: str, group: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group."""
    from gustframe.operators.joins import small_table
    src = df.filter(F.col(group).isNotNull() & F.col(x).isNotNull())
    q = pos.exact_quantiles_wide(src, x, [0.25, 0.5, 0.75], [group], names=["q1", "median", "q3"])
    fences = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                            "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    fences, small = small_table(fences)  # one row per group, computed once
    inside = (F.col(x) >= F.col("_lo")) & (F.col(x) <= F.col("_hi"))
    joined = src.join(F.broadcast(fences) if small else fences, [group])
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(x))).alias("whisker_lo"), F.max(F.when(inside, F.col(x))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


KDE_CELL = 0.5  # width of a cell in bandwidths
KDE_TERMS = 12  # of the Hermite sum


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients, by power, of the polynomials He_0, He_1, ... (He_m+1 = u He_m - m He_m-1)."""
    rows = [[1], [0, 1]]
    for m in range(1, terms - 1):
        up, back = [0, *rows[m]], [*rows[m - 1], 0, 0]
        rows.append([x - m * y for x, y in zip(up, back, strict=True)])
    return rows[:terms]


def kde(df: DataFrame, x: str, group: str | None = None, n_grid: int = 50) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth h) on an evenly spaced grid
    spanning [min - range/2, max + range/2]: (group, i, g, density).

    A fast Gauss transform: a row adds the powers of its distance t (in h) from the
    centre of its cell to the cell's 12 sums, map-side; no row meets the grid.  Then
    each cell that holds rows gives its sum to each grid point at distance u as
    exp(-u^2 / 2) * sum over m of He_m(u) * sum(t^m) / m!.  As |t| <= 1/4, and
    |He_m(u)| exp(-u^2 / 4) < 1.09 sqrt(m!), the terms left out are less than 4e-12
    of the kernel's peak a row, so the density is off by less than 2e-12 / h.

    NULL and NaN values, and rows of the NULL group, take no part; a group without
    spread, or with an infinite value, has no rows.  Per-group bandwidths come from a
    small statistics table (size checked, broadcast)."""
    from gustframe.operators.joins import attach_stats
    gcols = [group] if group else []
    src = df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    if group:
        src = src.filter(F.col(group).isNotNull())
    stats = src.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"),
                                     F.min(x).alias("_min"), F.max(x).alias("_max"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    known = ["_n", "_h", "_min", "_max"]
    rows = attach_stats(src.select(*gcols, F.col(x).cast("double").alias("_x")), stats, gcols).filter((F.col("_h") > 0) & ~F.isnan("_h"))
    rows = rows.withColumn("_cell", F.floor((F.col("_x") - F.col("_min")) / (F.col("_h") * KDE_CELL)))
    centre = F.col("_min") + (F.col("_cell") + 0.5) * (F.col("_h") * KDE_CELL)
    rows = rows.withColumn("_t", (F.col("_x") - centre) / F.col("_h"))
    power, powers = F.lit(1.0), []
    for m in range(KDE_TERMS):
        powers.append(F.sum(power).alias(f"_m{m}"))
        power = power * F.col("_t")
    cells = rows.groupBy(*gcols, *known, "_cell").agg(*powers)
    # the sum over m as one polynomial in u
    table = _hermite(KDE_TERMS)
    poly = [sum((F.col(f"_m{m}") * F.lit(float(table[m][k]) / math.factorial(m)) for m in range(k, KDE_TERMS) if table[m][k]), F.lit(0.0)).alias(f"_a{k}")
            for k in range(KDE_TERMS)]
    span = F.col("_max") - F.col("_min")
    terms = cells.select(*gcols, *known, centre.alias("_centre"), *poly, F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i"))
    terms = terms.withColumn("g", (F.col("_min") - 0.5 * span) + F.col("i") * (2.0 * span) / F.lit(float(n_grid - 1)))
    terms = terms.withColumn("_u", (F.col("g") - F.col("_centre")) / F.col("_h"))
    value = F.lit(0.0)
    for k in reversed(range(KDE_TERMS)):
        value = value * F.col("_u") + F.col(f"_a{k}")
    return (terms.groupBy(*gcols, "i", "g", "_n", "_h")
            .agg(F.sum(F.exp(-0.5 * F.col("_u") * F.col("_u")) * value).alias("_s"))
            .select(*gcols, F.col("i").cast("int").alias("i"), "g",
                    (F.col("_s") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density")))


def pivot_median_2d(df: DataFrame, x: str, y: str, target: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """Bin x and y into equal right-closed bins over their observed ranges and
    pivot the median target per cell: one row per x bin, one column per y bin."""
    from gustframe.operators.joins import scalars
    st = scalars(df.agg(F.min(x).alias("_xmin"), F.max(x).alias("_xmax"), F.min(y).alias("_ymin"),
                        F.max(y).alias("_ymax")))
    binned = df.select(sc.cut_equal(x, nx, st["_xmin"], st["_xmax"]).alias("bx"),
                       sc.cut_equal(y, ny, st["_ymin"], st["_ymax"]).alias("by"), target)
    binned = binned.filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
    med = pos.exact_median(binned, target, ["bx", "by"])
    return med.groupBy("bx").pivot("by", list(range(ny))).agg(F.first("median"))


def polar_profile(df: DataFrame, angle: str, target: str, group: str | None = None,
                  stat: str = "median") -> DataFrame:
    """Target median per direction sector (optionally per unit) with the
    sector midpoint in degrees and radians."""
    gcols = [group] if group else []
    binned = df.select(*gcols, target, sc.cut_edges(angle).alias("sector"))
    binned = binned.filter(F.col("sector").isNotNull())
    for g in gcols:
        binned = binned.filter(F.col(g).isNotNull())
    med = pos.exact_median(binned, target, [*gcols, "sector"], out=stat)
    w = sc.sector_width()
    mid = (F.col("sector") + 0.5) * F.lit(w)
    return med.select(*gcols, "sector", mid.alias("mid_deg"), F.radians(mid).alias("mid_rad"), stat)
