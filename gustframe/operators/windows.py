"""Window operators: per-unit lag, folds, hold-out and stratified splits.

A plain ``Window.partitionBy(unit)`` puts each unit in one task; with four or
five units (one of which may hold a third of the rows) that caps parallelism
at the unit count.  ``lag_diff`` cuts each unit's timeline into ranges,
lags inside the (unit, bucket) windows and carries the last row of the
previous non-empty bucket across the boundary.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustframe.operators import positions as pos


def lag_diff(df: DataFrame, cols, unit: str = "MAC_CODE", order=("Date_time", "ID"), suffix: str = "_before",
             names: dict | None = None, rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET,
             n_rows: int | None = None) -> DataFrame:
    """Add ``previous - current`` of each column in ``cols`` per unit, in the
    order of ``order`` (the last entries break ties, then a hash of the row).  The first row of a unit
    and rows without a unit get NULL."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = names or {c: f"{c}{suffix}" for c in cols}
    order = list(order)
    b, bucketed = pos.in_ranges(df, [unit, *order], rows_per_bucket, n_rows)
    b = b.withColumnRenamed("_bkt", "_lbkt")
    row = pos.row_hash(df)
    ordering = [F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy(unit, "_lbkt").orderBy(*ordering, row)
    payload = F.struct(*[F.col(c).alias(c) for c in cols])
    b = b.withColumn("_prev", F.lag(payload).over(inside))
    if bucketed:
        # last row of every (unit, bucket): max of a struct ordered like the window
        last = b.groupBy(unit, "_lbkt").agg(
            F.max(F.struct(*[F.col(c) for c in order], row.alias("_h"), payload.alias("_p"))).alias("_last"))
        carry = last.select(unit, "_lbkt", F.lag("_last._p").over(
            Window.partitionBy(unit).orderBy("_lbkt")).alias("_carry"))
        # carry has units x buckets rows: small, but the unit count is not
        # bounded by construction, so AQE picks the join from its run-time size
        b = (pos.join_null_safe(b, carry, [unit, "_lbkt"])
             .withColumn("_prev", F.coalesce("_prev", "_carry")).drop("_carry"))
    out = {names[c]: F.when(F.col(unit).isNotNull(), F.col(f"_prev.{c}") - F.col(c)) for c in cols}
    return b.withColumns(out).drop("_prev", "_lbkt")


def kfold_blocks(df: DataFrame, k: int = 5, order: str = "ID", out: str = "fold",
                 rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """k contiguous blocks in key order (``ntile(k)``): the first ``n mod k``
    blocks are one row larger.  Fold numbers are 1..k."""
    n = df.count()
    ranked = pos.row_number_global(df, order, rows_per_bucket=rows_per_bucket, n_rows=n)
    return ranked.withColumn(out, pos.ntile_from_rank(F.col("_rn"), F.lit(n), k)).drop("_rn")


def _hashed(df: DataFrame, id_col: str, seed) -> DataFrame:
    return df.withColumns(pos.hash_order_key(id_col, seed))


def kfold_shuffled(df: DataFrame, k: int = 5, id_col: str = "ID", seed=7, out: str = "fold",
                   rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """k folds in the order of md5('<seed>:<id>'): reproducible on any engine."""
    n = df.count()
    ranked = pos.row_number_global(_hashed(df, id_col, seed), "_hnum", tie_cols=["_h", id_col],
                                   rows_per_bucket=rows_per_bucket, n_rows=n)
    return ranked.withColumn(out, pos.ntile_from_rank(F.col("_rn"), F.lit(n), k)).drop("_rn", "_h", "_hnum")


def split_holdout(df: DataFrame, test_size: float = 0.2, id_col: str = "ID", seed=345, out: str = "is_test",
                  rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Exact-size random hold-out: the first ceil(test_size * n) rows in hash order."""
    n = df.count()
    n_test = math.ceil(test_size * n)
    ranked = pos.row_number_global(_hashed(df, id_col, seed), "_hnum", tie_cols=["_h", id_col],
                                   rows_per_bucket=rows_per_bucket, n_rows=n)
    return ranked.withColumn(out, F.col("_rn") <= n_test).drop("_rn", "_h", "_hnum")


def split_stratified(df: DataFrame, strata: str = "MAC_CODE", test_size: float = 0.2, id_col: str = "ID", seed=345,
                     out: str = "is_test", rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Hold-out keeping stratum proportions: in every stratum the first
    ceil(test_size * n_stratum) rows in hash order.  A hot stratum is split
    over many tasks."""
    sizes = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_ns"))  # NULL is a stratum of its own
    ranked = pos.row_number_global(_hashed(df, id_col, seed), "_hnum", tie_cols=["_h", id_col],
                                   group_cols=[strata], rows_per_bucket=rows_per_bucket)
    quota = F.ceil(F.col("_ns") * F.lit(test_size))
    return (pos.join_null_safe(ranked, sizes, [strata])
            .withColumn(out, F.col("_rn") <= quota).drop("_rn", "_h", "_hnum", "_ns"))


def rank_average(df: DataFrame, x: str, out: str = "rank", group_cols=(),
                 rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Attach the average rank of ``x`` (ties share the mean position)."""
    r = pos.average_rank(df, x, group_cols, out=out, rows_per_bucket=rows_per_bucket).drop("_cnt")
    if not list(group_cols):
        return pos.join_by_value(df, r, x)
    present = df.filter(F.col(x).isNotNull())
    return pos.join_null_safe(present, r, [*group_cols, x], "inner").unionByName(
        df.filter(F.col(x).isNull()).withColumn(out, F.lit(None).cast("double")))
