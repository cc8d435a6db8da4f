"""Histogram gradient boosting of squared error, with second-order gains, an L2
penalty on leaf values and columns and rows drawn per tree.

Features are quantised once to at most 256 bins (all values of a column with few
of them, else quantiles) and kept as written blocks of bytes. A tree grows level
by level: the sums of the gradients and the row counts per (node, column, bin)
decide all splits of a level. Gradients are fixed-point numbers whose sums stay
below 2^53, so that sums are exact in any order and the same trees come out
wherever the histograms are added up:

* beyond ``LOCAL_CELLS`` quantised values, every level is a Spark job: tasks add up
  the histograms of their blocks, one aggregation adds up those, and the driver
  sees one row per (node, column, bin), whatever the number of rows.  Predictions
  are written anew every ``REFRESH`` trees; in between, tasks apply the trees since.
* below, all trees grow in one task that holds the blocks (16 MB of bins at most),
  since a job per level would cost more than the level.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.plans.features import _p, _Stage
from gustframe.session import scratch_table, ship_package

BINS, BLOCK_ROWS, REFRESH = 256, 8192, 25
#: Quantised values (rows x features) up to which one task grows all trees.
LOCAL_CELLS = 1 << 24
_BLOCK = "id long, n int, bins binary, label binary, pred binary"


class _Rows:
    """Some rows while trees grow: bins by feature, label, prediction, node."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, pred: np.ndarray, ids: np.ndarray, params: dict):
        self.bins, self.label, self.pred, self.ids, self.p = bins, label, pred, ids, params

    @classmethod
    def of(cls, blocks: list, params: dict) -> "_Rows":
        k = params["features"]
        return cls(np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(k, -1) for b in blocks], axis=1),
                   np.concatenate([np.frombuffer(b["label"]) for b in blocks]), np.concatenate([np.frombuffer(b["pred"]) for b in blocks]),
                   np.concatenate([b["id"] + np.arange(b["n"]) for b in blocks]), params)

    def start(self, t: int) -> None:
        """Gradients of the rows drawn for tree ``t``, all in the root."""
        self.node = np.zeros(len(self.label), np.int64)
        self.grad = np.rint((self.pred - self.label) * self.p["scale"])
        self.drawn = None
        if self.p["rows"] < 1:
            h = (self.ids.astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 + self.p["seed"] & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            self.drawn = (h >> np.uint64(11)) < np.uint64(self.p["rows"] * (1 << 53))

    def split(self, feature: np.ndarray, cut: np.ndarray, level: int) -> None:
        """Move the rows of ``level`` to the nodes below."""
        for i in range((1 << level) - 1, (2 << level) - 1):
            if feature[i] >= 0:
                at = np.flatnonzero(self.node == i)
                self.node[at] = 2 * i + 1 + (self.bins[feature[i], at] > cut[i])

    def finish(self, value: np.ndarray) -> None:
        self.pred = self.pred + value[self.node]

    def histogram(self, columns: list[int], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and counts by (node of ``level``, column, bin)."""
        first, nodes = (1 << level) - 1, 1 << level
        here = self.node >= first
        if self.drawn is not None:
            here &= self.drawn
        at = slice(None) if here.all() else np.flatnonzero(here)
        base, grad = (self.node[at] - first) * BINS, self.grad[at]
        g, n = np.zeros((nodes, len(columns), BINS)), np.zeros((nodes, len(columns), BINS))
        for j, c in enumerate(columns):
            place = base + self.bins[c, at]
            g[:, j] = np.bincount(place, grad, nodes * BINS).reshape(nodes, BINS)
            n[:, j] = np.bincount(place, minlength=nodes * BINS).reshape(nodes, BINS)
        return g, n


def grow(t: int, p: dict, histogram) -> dict:
    """Tree ``t``: node i has the children 2 i + 1 and 2 i + 2.
    ``histogram(feature, cut, columns, level)`` gives the sums of a level."""
    size = (2 << p["depth"]) - 1
    feature, cut, value, gain, count = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size)
    rng = np.random.default_rng([p["seed"], t])
    columns = sorted(rng.choice(p["features"], max(1, round(p["columns"] * p["features"])), replace=False).tolist())
    worth = lambda g, n: g * g / (n + p["l2"])
    for level in range(p["depth"]):
        first = (1 << level) - 1
        g, n = histogram(feature, cut, columns, level)
        g = g / p["scale"]
        all_g, all_n = g[:, 0].sum(axis=1)[:, None, None], n[:, 0].sum(axis=1)[:, None, None]
        if not level:
            value[0], count[0] = -p["rate"] * all_g[0, 0, 0] / (all_n[0, 0, 0] + p["l2"]) if all_n[0, 0, 0] else 0.0, all_n[0, 0, 0]
        left_g, left_n = g.cumsum(axis=2), n.cumsum(axis=2)
        right_g, right_n = all_g - left_g, all_n - left_n
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = worth(left_g, left_n) + worth(right_g, right_n) - worth(all_g, all_n)
        gains = np.where((left_n > 0) & (right_n > 0), gains, -1.0).reshape(len(g), -1)
        best = gains.argmax(axis=1)
        for i, b in enumerate(best.tolist()):
            node, j, k = first + i, b // BINS, b % BINS
            if gains[i, b] <= 1e-9:
                continue
            feature[node], cut[node], gain[node] = columns[j], k, gains[i, b] / 2
            for child, sg, sn in ((2 * node + 1, left_g[i, j, k], left_n[i, j, k]), (2 * node + 2, right_g[i, j, k], right_n[i, j, k])):
                value[child], count[child] = -p["rate"] * sg / (sn + p["l2"]), sn
        if not (feature[first:first + (1 << level)] >= 0).any():
            break
    return {"feature": feature, "cut": cut, "value": value, "gain": gain, "count": count}


def _replay(rows: _Rows, trees: list[dict], t: int) -> None:
    for i, tree in enumerate(trees):
        rows.start(t + i)
        for level in range(rows.p["depth"]):
            rows.split(tree["feature"], tree["cut"], level)
        rows.finish(tree["value"])


def _batches(batches):
    for b in batches:
        yield from b.to_pylist()


def _grow_in_one_task(blocks: DataFrame, p: dict) -> list[dict]:
    def run(batches):
        rows = _Rows.of(list(_batches(batches)), p)
        for t in range(p["trees"]):
            rows.start(t)

            def histogram(feature, cut, columns, level):
                if level:
                    rows.split(feature, cut, level - 1)
                return rows.histogram(columns, level)

            tree = grow(t, p, histogram)
            rows.node[:] = 0
            for level in range(p["depth"]):
                rows.split(tree["feature"], tree["cut"], level)
            rows.finish(tree["value"])
            yield pa.RecordBatch.from_pylist([{"t": t, **{k: tree[k].tolist() for k in ("feature", "cut", "value", "gain", "count")}}], schema=out)

    out = pa.schema([("t", pa.int32()), ("feature", pa.list_(pa.int64())), ("cut", pa.list_(pa.int64())),
                     *[(k, pa.list_(pa.float64())) for k in ("value", "gain", "count")]])
    found = blocks.coalesce(1).mapInArrow(run, "t int, feature array<long>, cut array<long>, value array<double>, gain array<double>, count array<double>")
    return [{k: np.array(r[k]) for k in ("feature", "cut", "value", "gain", "count")} for r in sorted(found.collect(), key=lambda r: r.t)]


def _grow_by_jobs(blocks: DataFrame, p: dict) -> list[dict]:
    trees, done = [], 0

    def refreshed(batches, since, t):
        for b in _batches(batches):
            rows = _Rows.of([b], p)
            _replay(rows, since, t)
            yield pa.RecordBatch.from_pydict({**{k: [b[k]] for k in ("id", "n", "bins", "label")}, "pred": [rows.pred.tobytes()]},
                                             schema=pa.schema([("id", pa.int64()), ("n", pa.int32()), *[(k, pa.binary()) for k in ("bins", "label", "pred")]]))

    for t in range(p["trees"]):
        if t - done >= REFRESH:
            blocks = scratch_table(blocks.mapInArrow(lambda b, s=trees[done:], d=done: refreshed(b, s, d), _BLOCK), "boosting-blocks")
            done = t

        def histogram(feature, cut, columns, level, since=trees[done:], first=done, t=t, blocks=blocks):
            def run(batches):
                g, n = np.zeros((1 << level, len(columns), BINS)), np.zeros((1 << level, len(columns), BINS))
                for b in _batches(batches):
                    rows = _Rows.of([b], p)
                    _replay(rows, since, first)
                    rows.start(t)
                    for above in range(level):
                        rows.split(feature, cut, above)
                    sums = rows.histogram(columns, level)
                    g, n = g + sums[0], n + sums[1]
                place = np.flatnonzero(n.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(g.ravel()[place]), pa.array(n.ravel()[place])], names=["place", "g", "n"])

            sums = blocks.mapInArrow(run, "place long, g double, n double").groupBy("place").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect()
            shape = (1 << level, len(columns), BINS)  # rows: at most its cells
            g, n = np.zeros(math.prod(shape)), np.zeros(math.prod(shape))
            at = [r.place for r in sums]
            g[at], n[at] = [r.g for r in sums], [r.n for r in sums]
            return g.reshape(shape), n.reshape(shape)

        trees = [*trees, grow(t, p, histogram)]
    return trees


def bin_edges(df: DataFrame, k: int, values: str) -> list[list[float]]:
    """Ascending edges of each feature; bin b holds x with edge b - 1 < x <= edge b,
    NaN comes last."""
    cols = [F.nanvl(F.col(values)[i], F.lit(None).cast("double")) for i in range(k)]
    few = df.agg(*[F.approx_count_distinct(c, 0.02).alias(str(i)) for i, c in enumerate(cols)]).first()
    probs = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = df.agg(*[(F.collect_set(c) if few[i] < BINS * 3 // 4 else F.percentile_approx(c, probs, 10_000)).alias(str(i)) for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [sorted({float(x) for x in row[i] or [] if x < row[k + i]})[:BINS - 2] for i in range(k)]


class HistBoostedRegressor(Estimator, _Stage):
    """Boosted trees on a vector column; rows without a label take no part."""
    maxIter = _p("maxIter", "trees", TypeConverters.toInt)
    maxDepth = _p("maxDepth", "levels of splits", TypeConverters.toInt)
    stepSize = _p("stepSize", "learning rate", TypeConverters.toFloat)
    l2 = _p("l2", "penalty on squared leaf values", TypeConverters.toFloat)
    subsamplingRate = _p("subsamplingRate", "share of the rows of a tree", TypeConverters.toFloat)
    columnShare = _p("columnShare", "share of the columns of a tree", TypeConverters.toFloat)
    seed = _p("seed", "seed of the draws", TypeConverters.toInt)
    featuresCol = _p("featuresCol", "vector column", TypeConverters.toString)
    labelCol = _p("labelCol", "label column", TypeConverters.toString)
    predictionCol = _p("predictionCol", "prediction column", TypeConverters.toString)

    @keyword_only
    def __init__(self, maxIter=100, maxDepth=6, stepSize=0.3, l2=1.0, subsamplingRate=1.0, columnShare=1.0, seed=7,
                 featuresCol="features", labelCol="TARGET", predictionCol="prediction"):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=6, stepSize=0.3, l2=1.0, subsamplingRate=1.0, columnShare=1.0, seed=7,
                         featuresCol="features", labelCol="TARGET", predictionCol="prediction")
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> "HistBoostedRegressorModel":
        label = F.col(self.get("labelCol")).cast("double")
        rows = df.select(vector_to_array(self.get("featuresCol")).alias("x"), label.alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
        rows = scratch_table(rows, "boosting-rows")
        n, k, base, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.avg("y"), F.min("y"), F.max("y")).first()
        if not n:
            raise ValueError("no rows with a label")
        base = float(np.float32(base))
        edges = bin_edges(rows, k, "x")
        # a power of two that keeps n gradients of twice the labels' spread exact in a double
        scale = 2.0 ** (52 - math.ceil(math.log2(n * 2.0 * (high - low)))) if high > low else 1.0
        p = {"trees": self.get("maxIter"), "depth": self.get("maxDepth"), "rate": self.get("stepSize"), "l2": self.get("l2"), "features": k,
             "rows": self.get("subsamplingRate"), "columns": self.get("columnShare"), "seed": self.get("seed"), "scale": scale}

        def run(batches):
            at = TaskContext.get().partitionId() << 33
            for whole in batches:
                for lo in range(0, whole.num_rows, BLOCK_ROWS):
                    b = whole.slice(lo, BLOCK_ROWS)
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    bins = np.array([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at]), pa.array([b.num_rows], pa.int32()), pa.array([bins.tobytes()]),
                         pa.array([b.column(1).to_numpy().tobytes()]), pa.array([np.full(b.num_rows, base).tobytes()])], names=["id", "n", "bins", "label", "pred"])
                    at += b.num_rows

        ship_package(df.sparkSession)
        blocks = scratch_table(rows.mapInArrow(run, _BLOCK), "boosting-blocks")
        trees = (_grow_in_one_task if n * k <= LOCAL_CELLS else _grow_by_jobs)(blocks, p)
        nodes = [(t, i, int(f), edges[f][c] if f >= 0 else None, float(v), float(g), float(m)) for t, tree in enumerate(trees)
                 for i, (f, c, v, g, m) in enumerate(zip(*(tree[x] for x in ("feature", "cut", "value", "gain", "count")), strict=True))
                 if i == 0 or m]
        return HistBoostedRegressorModel(nodes=json.dumps(nodes), base=base, depth=p["depth"], features=k,
                                         featuresCol=self.get("featuresCol"), predictionCol=self.get("predictionCol"))


class HistBoostedRegressorModel(Model, _Stage):
    """Scores by walking the trees; ``node_table`` has the trees as rows."""
    nodes = _p("nodes", "nodes as JSON: tree, node, feature, threshold, value, gain, rows", TypeConverters.toString)
    base = _p("base", "prediction before the first tree", TypeConverters.toFloat)
    depth = _p("depth", "levels of splits", TypeConverters.toInt)
    features = _p("features", "number of features", TypeConverters.toInt)
    featuresCol = _p("featuresCol", "vector column", TypeConverters.toString)
    predictionCol = _p("predictionCol", "prediction column", TypeConverters.toString)

    @keyword_only
    def __init__(self, nodes="[]", base=0.0, depth=0, features=0, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._init(self._input_kwargs)

    def rows(self) -> list:
        return json.loads(self.get("nodes"))

    @property
    def featureImportances(self):
        """Gain of a feature's splits, as shares of all gains."""
        total = np.zeros(self.get("features"))
        for _, _, f, _, _, gain, _ in self.rows():
            if f >= 0:
                total[f] += gain
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """tree, node, left, right, feature, threshold, value, gain, n_rows; leaves
        have no children and no feature."""
        rows = [(t, i, *((2 * i + 1, 2 * i + 2, f, c) if f >= 0 else (None,) * 4), v, g, int(m)) for t, i, f, c, v, g, m in self.rows()]
        return spark.createDataFrame(rows, "tree int, node int, left int, right int, feature int, threshold double, value double, gain double, n_rows long")

    def _transform(self, df: DataFrame) -> DataFrame:
        rows, depth, base = self.rows(), self.get("depth"), self.get("base")
        size = (2 << depth) - 1
        shape = (max((r[0] for r in rows), default=-1) + 1, size)
        feature, threshold, value = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        for t, i, f, c, v, _, _ in rows:
            feature[t, i], threshold[t, i], value[t, i] = f, 0.0 if c is None else c, v

        def walk(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            m, every = np.stack(x.to_numpy()), np.arange(len(x))
            out = np.full(len(x), base)
            for f, c, v in zip(feature, threshold, value, strict=True):
                node = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    own = f[node]
                    right = ~(m[every, np.maximum(own, 0)] <= c[node])  # NaN goes right
                    node = np.where(own >= 0, 2 * node + 1 + right, node)
                out += v[node]
            return pd.Series(out)

        ship_package(df.sparkSession)
        return df.withColumn(self.get("predictionCol"), F.pandas_udf(walk, "double")(vector_to_array(self.get("featuresCol"))))
