"""Mergeable sketches: distinct counts (HLL) and quantiles (KLL).

A sketch table has a row per key (a day, a file, a unit) and column, is written
once, and is merged later for any coarser key without reading the rows again.
Both sketches are JVM aggregates with map-side partials; their size does not
depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 400


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """Rank error, as a share of the rows, that a quantile keeps with 99 % probability."""
    return 2.296 / k ** 0.9723


def _hashed(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if dict(df.dtypes)[c] in ("double", "float"):
        col = col + F.lit(0.0)  # -0.0 is 0.0
    return F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(col))


def distinct_sketches(df: DataFrame, columns, by=(), lg_k: int = LG_K) -> DataFrame:
    """by..., column, sketch: one aggregation for all columns; NULL is no value (a
    column without values has an empty sketch)."""
    columns, by = list(columns), list(by)
    made = df.groupBy(*by).agg(*[F.hll_sketch_agg(_hashed(df, c), lg_k).alias(f"_s{i}") for i, c in enumerate(columns)])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)]))
    return made.select(*by, long.alias("_c")).select(*by, "_c.column", "_c.sketch")


def merge_distinct(sketches: DataFrame, by=()) -> DataFrame:
    """by..., column, sketch of a coarser key: the same registers as one pass gives."""
    return sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame, by=()) -> DataFrame:
    """by..., column, n_distinct: merged and estimated."""
    return merge_distinct(sketches, by).select(*by, "column", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def quantile_sketches(df: DataFrame, x: str, by=(), k: int = KLL_K) -> DataFrame:
    """by..., sketch of the values of ``x`` that are neither NULL nor NaN; a key without
    such values has no row."""
    value = F.nanvl(F.col(f"`{x}`").cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, value.alias("_x")).where(F.col("_x").isNotNull())
    made = rows.groupBy(*by).agg(F.kll_sketch_agg_double("_x", k).alias("sketch"), F.count("*").alias("_n"))
    return made.where(F.col("_n") > 0).drop("_n")


def merge_quantiles(sketches: DataFrame, by=()) -> DataFrame:
    made = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.count("*").alias("_n"))
    return made.where(F.col("_n") > 0).drop("_n")


def sketched_quantiles(sketches: DataFrame, probs, by=()) -> DataFrame:
    """by..., q, value, n: merged, then read at each rank."""
    probs = [float(p) for p in probs]
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in probs]))
    return (merge_quantiles(sketches, by).select(*by, at.alias("_q"), F.kll_sketch_get_n_double("sketch").alias("n"))
            .select(*by, "_q.q", "_q.value", "n"))
