"""Delimited readers and the prediction writer."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from gustframe.session import scratch_path
from gustframe.sources import delimited as io
from gustframe.sources import driver_views as V

SF = "/root/testdata/sf0.001"


def test_nan_becomes_null_on_ingest(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "ID long, TARGET double")
    path = scratch_path(spark, "nan")
    io.write_delimited(df, path)
    back = {r.ID: r.TARGET for r in io.read_labels(spark, path).collect()}
    assert back == {1: None, 2: 1.5}


def test_predictions_written_in_key_order(spark):
    d = V.direction(spark, SF)
    path = scratch_path(spark, "pred")
    io.write_predictions(d, path)
    keys = []
    for f in sorted(glob.glob(path.replace("file:", "") + "/part-*.csv")):
        with open(f) as fh:
            lines = fh.read().splitlines()
        assert lines[0] == "ID;TARGET"
        keys += [int(x.split(";")[0]) for x in lines[1:]]
    assert keys == sorted(keys) and len(keys) == d.count()


def test_training_join_keeps_unlabelled_rows(spark):
    docs = V.table(spark, SF, "documents").select(F.col("doc_id").alias("ID"), F.col("lang").alias("MAC_CODE"))
    labs = V.table(spark, SF, "labels").select(F.col("doc_id").alias("ID"), F.col("quality").cast("double").alias("TARGET"))
    fp, lp = scratch_path(spark, "f"), scratch_path(spark, "l")
    io.write_delimited(docs, fp)
    io.write_delimited(labs, lp)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("MAC_CODE", T.StringType())])
    joined = io.read_training_joined(spark, fp, lp, schema)
    assert joined.count() == docs.count()
    assert joined.filter(F.col("TARGET").isNull()).count() == docs.count() - docs.join(labs, "ID", "left_semi").count()


def test_columns_by_header_name_bad_cells_and_fractions(spark, tmp_path):
    import datetime as dt

    import pytest
    from pyspark.sql import types as T

    from gustframe.sources import delimited as io
    (tmp_path / "a.csv").write_text("TARGET;extra;ID\n9.5;x;1\n")
    assert [tuple(r) for r in io.read_labels(spark, str(tmp_path / "a.csv")).collect()] == [(1, 9.5)]
    (tmp_path / "b.csv").write_text("ID;TARGET\n2;abc\n")
    with pytest.raises(Exception, match="abc"):
        io.read_labels(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("ID;OTHER\n2;1\n")
    with pytest.raises(ValueError, match="TARGET"):
        io.read_labels(spark, str(tmp_path / "c.csv"))
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("Date_time", T.TimestampNTZType())])
    when = [dt.datetime(2024, 1, 2, 3, 4, 5, 750000), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 1), None]
    df = spark.createDataFrame(list(enumerate(when)), schema)
    io.write_delimited(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in io.read_delimited(spark, str(tmp_path / "t"), schema).collect()) == list(enumerate(when))
