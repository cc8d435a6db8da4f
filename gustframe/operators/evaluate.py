"""Evaluation of predictions: errors, MAE, MAPE, residual tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.operators import bins, corr
from gustframe.operators import positions as pos


def signed_error(y="TARGET", p="prediction") -> Column:
    """prediction - truth."""
    return F.col(p) - F.col(y)


def abs_error(y="TARGET", p="prediction") -> Column:
    return F.abs(F.col(y) - F.col(p))


def mae(df: DataFrame, y: str = "TARGET", p: str = "prediction", group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(abs_error(y, p)).alias("mae"), F.count(F.lit(1)).alias("n"))


def mape(df: DataFrame, y: str = "TARGET", p: str = "prediction", abs_denominator: bool = False,
         group_cols=()) -> DataFrame:
    """Mean of |y - p| / y with the sign of y kept (``abs_denominator`` to drop
    it).  Rows with y = 0 give NULL terms and are counted in ``n_zero``."""
    den = F.abs(F.col(y)) if abs_denominator else F.col(y)
    return df.groupBy(*group_cols).agg(
        F.avg(F.try_divide(abs_error(y, p), den)).alias("mape"),
        F.count(F.try_divide(abs_error(y, p), den)).alias("n"),
        F.count_if(F.col(y) == 0).alias("n_zero"))


def residual_table(df: DataFrame, y: str = "TARGET", p: str = "prediction", key: str = "ID",
                   set_col: str | None = None) -> DataFrame:
    """Truth, prediction, signed and absolute error per row."""
    extra = [set_col] if set_col else []
    return df.select(key, *extra, F.col(y).alias("y"), F.col(p).alias("p"),
                     signed_error(y, p).alias("error"), abs_error(y, p).alias("abs_error"))


def mae_by_set(residuals: DataFrame, set_col: str = "set") -> DataFrame:
    """MAE per set (train / test) rounded to 2 digits, as shown above the plots."""
    return residuals.groupBy(set_col).agg(F.round(F.avg("abs_error"), 2).alias("mae"),
                                          F.count(F.lit(1)).alias("n"))


def error_histogram(residuals: DataFrame, n: int = 80) -> DataFrame:
    return bins.histogram(residuals, "error", n)


def error_quantiles(residuals: DataFrame, probs=(0.5, 0.75, 0.9)) -> DataFrame:
    return pos.exact_quantiles(residuals, "error", list(probs))


def worst_predictions(residuals: DataFrame, original: DataFrame, key: str = "ID", q: float = 0.75) -> DataFrame:
    """Original rows whose error exceeds its q-quantile (semi-join on the key)."""
    cut = pos.exact_quantiles(residuals, "error", [q]).first()  # no row: no errors, nothing exceeds it
    keys = residuals.filter(F.col("error") > F.lit(cut["value"] if cut else None).cast("double")).select(key)
    return original.join(keys, key, "left_semi")


def residual_trend(df: DataFrame, residual: str, columns) -> DataFrame:
    """Pearson and Spearman correlation of the residual with each column."""
    pear = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f"),
        F.col(residual).alias("_r")).select("f.*", "_r")
    pear = pear.groupBy("feature").agg(F.corr("_r", "v").alias("pearson"))
    spear = corr.error_correlation(df, residual, columns).select("feature", F.col("rho").alias("spearman"))
    return pear.join(spear, "feature", "left")
