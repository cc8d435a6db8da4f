"""Least squares by a tall-skinny QR, so that collinear features are no error.

Each partition reduces its rows ``[1, x, y]`` to one triangle, batch by batch;
triangles of the same hashed slot are stacked and reduced again, twice, and at most
``SLOTS[-1]`` triangles of (p + 2)^2 numbers reach the driver.  Nothing is squared on
the way, unlike with normal equations, so a small column beside a large one
keeps its digits.  The column of ones comes first: the rest of the triangle is
then that of the centred columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = "intercept"
SLOTS = (4096, 64)  # triangles left after each round of stacking
RANK_TOLERANCE = 1e-12  # singular values below this share of the largest are 0


@dataclass(frozen=True)
class LinearFit:
    """Coefficients of least squares; of all solutions the one of least norm."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    n: int
    rank: int
    residual_ss: float
    total_ss: float

    @property
    def r2(self) -> float | None:
        return 1 - self.residual_ss / self.total_ss if self.total_ss else None

    def table(self, spark: SparkSession) -> DataFrame:
        """feature, coefficient (the intercept is a row), by coefficient and name."""
        rows = [*zip(self.features, self.coefficients, strict=True), (INTERCEPT, self.intercept)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy("coefficient", "feature")

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the fitted value; NULL if a feature is NULL."""
        value = F.lit(self.intercept)
        for f, b in zip(self.features, self.coefficients, strict=True):
            value = value + F.col(f"`{f}`").cast("double") * F.lit(b)
        return df.withColumn(out, value)


def _reduce(rows: np.ndarray) -> np.ndarray:
    """The triangle of a block of rows, as a full square."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))])


def _triangles(batches):
    """One row per partition: its triangle, and the number of rows in it."""
    r, n = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        r, n = _reduce(block if r is None else np.vstack([r, block])), n + len(block)
    if r is not None:
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "r"])


def _stack(rows: pd.DataFrame) -> pd.DataFrame:
    width = round(len(rows["r"].iloc[0]) ** 0.5)
    r = _reduce(np.vstack([np.asarray(x).reshape(width, width) for x in rows["r"]]))
    return pd.DataFrame({"slot": rows["slot"].iloc[:1], "n": [int(rows["n"].sum())], "r": [r.ravel().tolist()]})


def fit_linear(df: DataFrame, label: str, features) -> LinearFit:
    """Least squares with an intercept of ``label`` on ``features``.

    Rows with a NULL or NaN in the label or a feature take no part.  Features that are
    combinations of others get the solution of least norm (two equal columns share
    their weight).  No rows raise ValueError.
    """
    features = list(features)
    real = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.lit(1.0).alias("one"), *[real(c).alias(f"x{i}") for i, c in enumerate(features)], real(label).alias("y")).dropna()
    tri = rows.mapInArrow(_triangles, "n long, r array<double>").withColumn("slot", F.spark_partition_id())
    for slots in SLOTS:
        tri = tri.withColumn("slot", F.col("slot") % slots).groupBy("slot").applyInPandas(_stack, "slot int, n long, r array<double>")
    got = tri.collect()  # at most SLOTS[-1] triangles
    if not got:
        raise ValueError("no rows without NULLs to fit")
    width, p, n = len(features) + 2, len(features), sum(t.n for t in got)
    r = _reduce(np.vstack([np.asarray(t.r).reshape(width, width) for t in sorted(got, key=lambda t: t.slot)]))
    means, centred, target = r[0, 1:] / r[0, 0], r[1:-1, 1:-1], r[1:-1, -1]
    beta, _, rank, _ = np.linalg.lstsq(centred, target, rcond=RANK_TOLERANCE) if p else (np.zeros(0), None, 0, None)
    rest = target - centred @ beta
    residual = float(rest @ rest + r[-1, -1] ** 2)
    return LinearFit(tuple(features), tuple(float(b) for b in beta), float(means[-1] - means[:-1] @ beta), n, int(rank), residual,
                     float(target @ target + r[-1, -1] ** 2))
