"""Delimited (``;``) readers and the prediction writer.

Types are explicit (no inference pass over 100 TB) and columns are found by
header name, in any order and among others; a missing one is an error, and so
is a file of the same folder with another header.  A cell that does not parse
fails the read (``mode="PERMISSIVE"`` makes it NULL).  NaN is turned into NULL
on ingest so that no NaN reaches an operator.  Timestamps are read with any
fraction of a second and written with microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = ";"


def nan_to_null(df: DataFrame) -> DataFrame:
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fl}) if fl else df


def features_schema(sensors, key: str = "ID", unit: str = "MAC_CODE", time: str = "Date_time",
                    extra_doubles=()) -> T.StructType:
    """Key, unit, time and the sensor quadruples ``X, X_min, X_max, X_std``."""
    fields = [T.StructField(key, T.LongType()), T.StructField(unit, T.StringType()),
              T.StructField(time, T.TimestampNTZType())]
    for s in sensors:
        fields += [T.StructField(n, T.DoubleType()) for n in (s, f"{s}_min", f"{s}_max", f"{s}_std")]
    fields += [T.StructField(c, T.DoubleType()) for c in extra_doubles]
    return T.StructType(fields)


def labels_schema(key: str = "ID", target: str = "TARGET") -> T.StructType:
    return T.StructType([T.StructField(key, T.LongType()), T.StructField(target, T.DoubleType())])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = SEP,
                   mode: str = "FAILFAST") -> DataFrame:
    """The columns of ``schema`` by header name; a missing file raises Spark's
    AnalysisException, a missing column a ValueError."""
    header = spark.read.option("sep", sep).option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(header)}")
    wanted = {f.name: f for f in schema.fields}
    in_file = T.StructType([wanted.get(h, T.StructField(h, T.StringType())) for h in header])
    df = (spark.read.schema(in_file).option("sep", sep).option("header", True).option("enforceSchema", False)
          .option("mode", mode).csv(path))
    return nan_to_null(df.select(*schema.fieldNames()))


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_delimited(spark, path, schema)


def read_labels(spark: SparkSession, path: str, key: str = "ID", target: str = "TARGET") -> DataFrame:
    return read_delimited(spark, path, labels_schema(key, target))


def read_scoring(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_delimited(spark, path, schema)


def read_training_joined(spark: SparkSession, features_path: str, labels_path: str, schema: T.StructType,
                         key: str = "ID") -> DataFrame:
    """Features left-joined to labels on the key."""
    return read_features(spark, features_path, schema).join(read_labels(spark, labels_path, key), key, "left")


def read_projection(spark: SparkSession, path: str, key: str = "ID", dims=("dim0", "dim1")) -> DataFrame:
    """Saved low-dimensional coordinates: first column is the key."""
    schema = T.StructType([T.StructField(key, T.LongType())] + [T.StructField(d, T.DoubleType()) for d in dims])
    return read_delimited(spark, path, schema)


def write_delimited(df: DataFrame, path: str, sep: str = SEP, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("sep", sep).option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def write_predictions(pred: DataFrame, path: str, key: str = "ID", target: str = "TARGET",
                      sep: str = SEP) -> None:
    """(key, target) in key order: range-partitioned, sorted inside each file,
    so part files concatenated in name order are globally sorted."""
    out = pred.select(key, target).repartitionByRange(key).sortWithinPartitions(key)
    write_delimited(out, path, sep)
