"""Key joins and the application of fitted statistics.

Only equi-joins on the row key occur.  The fitted-statistics helpers join a
one-row (or one-row-per-group) aggregate back with a broadcast; that side's
size is bounded by the number of groups, which is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.session import scratch_table

# Broadcast a per-group statistics table only up to this many groups.
MAX_BROADCAST_GROUPS = 20_000


def join_left_key(left: DataFrame, right: DataFrame, key: str = "ID") -> DataFrame:
    """Left equi-join on the key; AQE picks broadcast or sort-merge at run time."""
    return left.join(right, key, "left")


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str = "ID") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def anti_keys(df: DataFrame, keys: DataFrame, key: str = "ID") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def scalars(agg_row_df: DataFrame) -> dict:
    """The single row of a global aggregate as a dict (a few numbers)."""
    row = agg_row_df.first()
    return row.asDict() if row is not None else {c: None for c in agg_row_df.columns}


def with_scalars(df: DataFrame, agg_row_df: DataFrame) -> DataFrame:
    """Attach the values of a one-row aggregate to every row as literals
    (computed first, then inlined: no join)."""
    vals = scalars(agg_row_df)
    types = dict(agg_row_df.dtypes)
    return df.withColumns({k: F.lit(v).cast(types[k]) for k, v in vals.items()})


def small_table(df: DataFrame, max_rows: int = MAX_BROADCAST_GROUPS) -> tuple[DataFrame, bool]:
    """A per-group result, written once to the shared folder, and whether it has
    at most ``max_rows`` rows (then it may be broadcast; larger ones are joined by
    shuffle).  It never passes through the driver."""
    table = scratch_table(df, "stats")
    return table, table.limit(max_rows + 1).count() <= max_rows


def attach_stats(df: DataFrame, stats: DataFrame, group_cols=()) -> DataFrame:
    """Attach fitted statistics (one row, or one row per group) to every row."""
    group_cols = list(group_cols)
    if not group_cols:
        return with_scalars(df, stats)
    side, small = small_table(stats)
    return df.join(F.broadcast(side) if small else side, group_cols, "left")


def fill_from_stats(df: DataFrame, stats: DataFrame, columns, group_cols=(), suffix: str = "__fit") -> DataFrame:
    """Fill NULLs of ``columns`` from same-named columns of a fitted stats table."""
    group_cols = list(group_cols)
    renamed = stats.select(*group_cols, *[F.col(c).alias(c + suffix) for c in columns])
    j = attach_stats(df, renamed, group_cols)
    return j.withColumns({c: F.coalesce(F.col(c), F.col(c + suffix)) for c in columns}) \
        .drop(*[c + suffix for c in columns])


def aggregates_side_by_side(df: DataFrame, group: str, aggs: dict) -> DataFrame:
    """Per-group aggregates side by side: one ``groupBy().agg()``, no join.
    NULL group keys are dropped, as a grouped frame would."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(*[expr.alias(name) for name, expr in aggs.items()])
