"""Role views over the driver tables (FIXTURES.md section 2).

Each view has a Spark builder ``(spark, sf_dir) -> DataFrame`` and the same
text for DuckDB (``SQL_VIEWS``), which oracle queries inline as CTEs.

* ``sig``       ordered signal per unit (events)
* ``hourly``    sensor quadruples: hourly mean/min/max/std of two channels
* ``turbine``   ``hourly`` under sensor names (Rotor_speed, Pitch_angle, ...)
* ``wide``      volume table from lineitem with three nullable channels
* ``signed``    targets of both signs (customer)
* ``quads``     exact sensor quadruples from lineitem (bounds checks)
* ``direction`` angles 0..360 (orders)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types that are units of ``hourly``; the table holds no others.
UNITS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table.  ``spread=True`` repartitions the scan over all cores
    when its file has fewer splits than cores (for fan-out stages and model
    fits on small files); the check is free on a bare scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        from gustframe.session import spread as spread_scan
        df = spread_scan(df)
    return df


def sig(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events", spread)
    return e.select(F.col("event_id").alias("ID"), F.col("event_type").alias("MAC_CODE"),
                    F.col("ts").alias("Date_time"), "value",
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sig(spark, sf_dir)
    t = F.col("Date_time")
    # hour start without a time-zone round trip (date_trunc would return a
    # session-zone TIMESTAMP)
    hour = F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))
    agg = (s.groupBy(hour.alias("Date_time"), "MAC_CODE")
           .agg(F.avg("value").alias("value"), F.min("value").alias("value_min"),
                F.max("value").alias("value_max"), F.stddev_samp("value").alias("value_std"),
                F.avg("k").alias("k"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
                F.stddev_samp("k").alias("k_std"), F.count(F.lit(1)).alias("n")))
    # the key is hour number x 8 + unit number: no window and no action
    hours = F.datediff("Date_time", F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("Date_time")
    unit = F.lit(0)
    for i, u in enumerate(UNITS):
        unit = F.when(F.col("MAC_CODE") == u, i + 1).otherwise(unit)
    with_id = agg.withColumn("ID", hours * 8 + unit)
    return with_id.select("ID", "Date_time", "MAC_CODE", "value", "value_min", "value_max", "value_std",
                          "k", "k_min", "k_max", "k_std", "n")


def turbine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` under turbine sensor names, units mapped to WT1..WT5."""
    h = hourly(spark, sf_dir)
    unit = (F.when(F.col("MAC_CODE") == "click", "WT1").when(F.col("MAC_CODE") == "error", "WT2")
            .when(F.col("MAC_CODE") == "purchase", "WT3").when(F.col("MAC_CODE") == "signup", "WT4")
            .otherwise("WT5"))
    return h.select(
        "ID", "Date_time", unit.alias("MAC_CODE"),
        (F.col("value") / 5).alias("Rotor_speed"), (F.col("value_min") / 5).alias("Rotor_speed_min"),
        (F.col("value_max") / 5).alias("Rotor_speed_max"), (F.col("value_std") / 5).alias("Rotor_speed_std"),
        (F.col("k") - 50).alias("Pitch_angle"), (F.col("k_min") - 50).alias("Pitch_angle_min"),
        (F.col("k_max") - 50).alias("Pitch_angle_max"), F.col("k_std").alias("Pitch_angle_std"),
        (F.col("value_min") + 20).alias("Generator_stator_temperature_min"),
        (F.col("value") * F.col("n")).alias("TARGET"))


def wide(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", spread)
    return li.select(
        F.col("l_returnflag").alias("MAC_CODE"), F.col("l_suppkey").alias("grp"),
        F.when(F.col("l_quantity") == 50, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("Rotor_speed"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("Rotor_speed_std"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("Grid_voltage"),
        (F.col("l_tax") - 0.04).alias("Pitch_angle"),
        F.col("l_extendedprice").alias("TARGET"))


def wide_keyed(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``wide`` plus the order key and line number, for row-level outputs."""
    li = table(spark, sf_dir, "lineitem", spread)
    return li.select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("MAC_CODE"), F.col("l_suppkey").alias("grp"),
        F.when(F.col("l_quantity") == 50, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("Rotor_speed"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("Rotor_speed_std"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("Grid_voltage"),
        (F.col("l_tax") - 0.04).alias("Pitch_angle"),
        F.col("l_extendedprice").alias("TARGET"))


def quads(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Sensor quadruples with exact arithmetic (bounds sometimes violated)."""
    li = table(spark, sf_dir, "lineitem", spread)
    q, n, d, t = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        F.col("l_returnflag").alias("MAC_CODE"), q.alias("Rotor_speed"), (q - 4 + n).alias("Rotor_speed_min"),
        (q + 4 - n).alias("Rotor_speed_max"), d.alias("Rotor_speed_std"), (t * 100).alias("Pitch_angle"),
        (d * 100).alias("Pitch_angle_min"), (t * 100 + 2).alias("Pitch_angle_max"), t.alias("Pitch_angle_std"),
        F.col("l_extendedprice").alias("TARGET"))


def signed(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "customer", spread)
    return c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("MAC_CODE"),
                    F.col("c_acctbal").alias("TARGET"))


def direction(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders", spread)
    return o.select(F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("MAC_CODE"),
                    (F.col("o_custkey") % 361).cast("double").alias("Nacelle_angle"),
                    F.col("o_totalprice").alias("TARGET"))


BUILDERS = {"sig": sig, "hourly": hourly, "turbine": turbine, "wide": wide, "wide_keyed": wide_keyed,
            "quads": quads, "signed": signed, "direction": direction}

# --- DuckDB text of the same views --------------------------------------------------------
SQL_VIEWS = {
    "sig": "select event_id as ID, event_type as MAC_CODE, ts as Date_time, value, "
           "cast(json_extract_string(props, '$.k') as double) as k from events",
    "hourly": "select (datediff('day', date '1970-01-01', h) * 24 + hour(h)) * 8 + case MAC_CODE " +
              " ".join(f"when '{u}' then {i + 1}" for i, u in enumerate(UNITS)) + " else 0 end as ID, h as Date_time, MAC_CODE, "
              "value, value_min, value_max, value_std, k, k_min, k_max, k_std, n from ("
              "select date_trunc('hour', Date_time) as h, MAC_CODE, avg(value) as value, min(value) as value_min, "
              "max(value) as value_max, stddev_samp(value) as value_std, avg(k) as k, min(k) as k_min, "
              "max(k) as k_max, stddev_samp(k) as k_std, count(*) as n from sig "
              "group by date_trunc('hour', Date_time), MAC_CODE) t",
    "turbine": "select ID, Date_time, case MAC_CODE when 'click' then 'WT1' when 'error' then 'WT2' "
               "when 'purchase' then 'WT3' when 'signup' then 'WT4' else 'WT5' end as MAC_CODE, "
               "value / 5 as Rotor_speed, value_min / 5 as Rotor_speed_min, value_max / 5 as Rotor_speed_max, "
               "value_std / 5 as Rotor_speed_std, k - 50 as Pitch_angle, k_min - 50 as Pitch_angle_min, "
               "k_max - 50 as Pitch_angle_max, k_std as Pitch_angle_std, "
               "value_min + 20 as Generator_stator_temperature_min, value * n as TARGET from hourly",
    "wide": "select l_returnflag as MAC_CODE, l_suppkey as grp, "
            "case when l_quantity = 50 then null else l_quantity end as Rotor_speed, "
            "nullif(l_discount, 0.0) as Rotor_speed_std, nullif(l_tax, 0.0) as Grid_voltage, "
            "l_tax - 0.04 as Pitch_angle, l_extendedprice as TARGET from lineitem",
    "wide_keyed": "select l_orderkey as okey, l_linenumber as line, l_returnflag as MAC_CODE, l_suppkey as grp, "
                  "case when l_quantity = 50 then null else l_quantity end as Rotor_speed, "
                  "nullif(l_discount, 0.0) as Rotor_speed_std, nullif(l_tax, 0.0) as Grid_voltage, "
                  "l_tax - 0.04 as Pitch_angle, l_extendedprice as TARGET from lineitem",
    "quads": "select l_returnflag as MAC_CODE, l_quantity as Rotor_speed, l_quantity - 4 + l_linenumber as Rotor_speed_min, "
             "l_quantity + 4 - l_linenumber as Rotor_speed_max, l_discount as Rotor_speed_std, l_tax * 100 as Pitch_angle, "
             "l_discount * 100 as Pitch_angle_min, l_tax * 100 + 2 as Pitch_angle_max, l_tax as Pitch_angle_std, "
             "l_extendedprice as TARGET from lineitem",
    "signed": "select c_custkey as ID, c_mktsegment as MAC_CODE, c_acctbal as TARGET from customer",
    "direction": "select o_orderkey as ID, o_orderpriority as MAC_CODE, "
                 "cast(o_custkey % 361 as double) as Nacelle_angle, o_totalprice as TARGET from orders",
}
# Views that other views are built from.
SQL_DEPENDS = {"hourly": ["sig"], "turbine": ["sig", "hourly"]}
