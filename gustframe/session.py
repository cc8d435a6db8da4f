"""Session helpers: one place for configuration and the checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "gustframe", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given session."""
    cores = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    conf["spark.driver.memory"] = os.environ.get("GUSTFRAME_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins; a private folder under the system temp dir is
    created only when nothing is configured on a one-process master (local
    tests); elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="gustframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/gustframe-{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write a small derived table to the shared folder and read it back: it is
    computed once, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}  # by application; kept until the driver ends


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, so that
    functions run in tasks can import it wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    kept = _SHIPPED[sc.applicationId] = tempfile.TemporaryDirectory()
    sc.addPyFile(shutil.make_archive(os.path.join(kept.name, "gustframe"), "zip", os.path.dirname(root), os.path.basename(root)))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Repartition a freshly read table that has fewer splits than the
    cluster has cores (a small file with few row groups); a no-op for large
    inputs, whose scans already have many splits.

    Call it on scans only: for a scan the partition count comes from the file
    splits without running anything (on a plan with shuffles, adaptive
    execution would have to run them to answer).  Filters and column pruning
    still reach the scan through the repartition."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
