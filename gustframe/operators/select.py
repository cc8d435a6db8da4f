"""Projections and column selection (column lists resolve from the schema)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import naming


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add derived columns in a single projection."""
    return df.withColumns(exprs)


def select_columns(df: DataFrame, names) -> DataFrame:
    """Keep the listed columns in that order; a missing name raises."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*names)


def select_by_dtype(df: DataFrame, family: str) -> DataFrame:
    return df.select(*naming.columns_of_type(df, family))


def select_base_sensors(df: DataFrame, stop_list=None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Base sensor columns sorted by name, with an optional positional slice."""
    cols = naming.base_sensors(df.columns, stop_list)[start:stop]
    return df.select(*cols)


def null_counts_row(df: DataFrame, columns=None) -> DataFrame:
    """One row: number of NULLs per column (one aggregation pass)."""
    columns = list(columns or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def null_free_columns(df: DataFrame, columns=None) -> list[str]:
    """Names of the columns without any NULL (one aggregation, one row back)."""
    columns = list(columns or df.columns)
    row = null_counts_row(df, columns).first()
    return [c for c in columns if row[c] == 0]


def select_null_free(df: DataFrame, exclude=()) -> DataFrame:
    cols = [c for c in null_free_columns(df) if c not in set(exclude)]
    return df.select(*cols)


def drop_columns(df: DataFrame, names) -> DataFrame:
    return df.drop(*names)


def drop_null_columns(df: DataFrame) -> DataFrame:
    keep = set(null_free_columns(df))
    return df.select(*[c for c in df.columns if c in keep])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def distinct_units(df: DataFrame, unit: str = "MAC_CODE") -> DataFrame:
    """Sorted distinct unit codes (NULL excluded, as a groupby key would)."""
    return df.select(unit).filter(F.col(unit).isNotNull()).distinct().orderBy(unit)


def columns_except(df: DataFrame, excluded) -> DataFrame:
    return df.select(*naming.columns_except(df.columns, excluded))
