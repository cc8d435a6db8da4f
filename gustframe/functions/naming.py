"""Column-name rules of the sensor tables (pure schema logic, no data pass).

Every sensor ``X`` comes as a quadruple ``X, X_min, X_max, X_std``; corrected
channels end in ``_c``.  Column lists resolve on the driver from ``df.schema``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Suffixes that mark a non-base column.
DERIVED_SUFFIXES = ("_min", "_max", "_std", "_c")
# Columns never used as sensors in the profiles.
DEFAULT_STOP_LIST = ["TARGET", "LogTARGET", "MAC_CODE", "Date_time",
                     "Absolute_wind_direction", "Nacelle_angle"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def base_sensors(columns, stop_list=None) -> list[str]:
    """Names not ending in a derived suffix, minus the stop list, sorted by name."""
    stop = set(DEFAULT_STOP_LIST if stop_list is None else stop_list)
    return sorted(c for c in columns if not c.endswith(DERIVED_SUFFIXES) and c not in stop)



def columns_of_type(df: DataFrame, family: str) -> list[str]:
    """Columns of one type family: 'numeric', 'string', 'boolean', 'timestamp'."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if family == "numeric" and isinstance(t, NUMERIC_TYPES):
            out.append(f.name)
        elif family == "double" and isinstance(t, (T.DoubleType, T.FloatType)):
            out.append(f.name)
        elif family == "string" and isinstance(t, T.StringType):
            out.append(f.name)
        elif family == "boolean" and isinstance(t, T.BooleanType):
            out.append(f.name)
        elif family == "timestamp" and isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(f.name)
    return out


def columns_except(columns, excluded) -> list[str]:
    ex = set(excluded)
    return [c for c in columns if c not in ex]
