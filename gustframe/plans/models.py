"""Distributed model training, validation, tuning and reporting.

Forests, linear models, PCA and the seedings of k-means are Spark ML estimators:
every level of a tree, every iteration of a solver is a distributed aggregation.  What lives
here is the composition: per-regime models stacked by key, fold loops with
train and test scores, a model-guided parameter search, importance tables.
Boosted trees are grown from histograms (``plans/boosting.py``).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustframe.functions import naming
from gustframe.operators import windows
from gustframe.plans.boosting import BLOCK_ROWS, HistBoostedRegressor
from gustframe.plans.features import ImputeMedian, RegimeColumn, _p, _Stage
from gustframe.session import scratch_path, scratch_table, ship_package

def forest(numTrees: int = 100, maxDepth: int = 12, seed: int = 7, label: str = "TARGET") -> RandomForestRegressor:
    """Random forest; every node considers all features (no feature subsampling)."""
    return RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, featureSubsetStrategy="all", seed=seed,
                                 labelCol=label, featuresCol="features")


def boosted(maxIter: int = 1500, maxDepth: int = 4, stepSize: float = 0.1, subsamplingRate: float = 1.0,
            columnShare: float = 1.0, l2: float = 1.0, seed: int = 7, label: str = "TARGET") -> HistBoostedRegressor:
    """Gradient-boosted trees; the defaults are the published numbers."""
    return HistBoostedRegressor(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, subsamplingRate=subsamplingRate,
                                columnShare=columnShare, l2=l2, seed=seed, labelCol=label)


def regression_pipeline(features, estimator, impute: bool = True) -> Pipeline:
    """[median imputation] -> assembler -> estimator."""
    stages = [ImputeMedian(inputCols=list(features))] if impute else []
    stages += [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), estimator]
    return Pipeline(stages=stages)


class AssembleNullFree(Estimator, _Stage):
    """Fit: the numeric columns without a NULL, but for ``stop`` and the label.
    The model is the ``VectorAssembler`` of these columns."""
    stop = _p("stop", "columns never taken", TypeConverters.toListString)
    labelCol = _p("labelCol", "label column", TypeConverters.toString)
    outputCol = _p("outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, stop=None, labelCol="TARGET", outputCol="features"):
        super().__init__()
        self._setDefault(stop=[], labelCol="TARGET", outputCol="features")
        self._init(self._input_kwargs)

    def _fit(self, df: DataFrame) -> VectorAssembler:
        out = {*self.get("stop"), self.get("labelCol")}
        cols = [c for c in naming.columns_of_type(df, "numeric") if c not in out]
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        return VectorAssembler(inputCols=[c for c in cols if row[c] == 0], outputCol=self.get("outputCol"), handleInvalid="keep")


class RegimeRegressor(Estimator, _Stage):
    """One pipeline per regime (speed cube >= cut^3, NULL speed -> low), each
    with its own imputation medians and feature list.  A regime without a labelled
    row gets a pipeline of no stages, and its rows the prediction NULL.

    ``features``: regime -> columns; ``estimators``: regime -> regressor."""
    features = _p("features", "feature columns per regime")
    speedCol = _p("speedCol", "speed column", TypeConverters.toString)
    cut = _p("cut", "speed cut", TypeConverters.toFloat)
    regimeCol = _p("regimeCol", "regime column", TypeConverters.toString)

    @keyword_only
    def __init__(self, features=None, estimators=None, speedCol="Rotor_speed", cut=15.0, regimeCol="regime"):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        self.estimators = kwargs.pop("estimators", None) or {}
        self._setDefault(speedCol="Rotor_speed", cut=15.0, regimeCol="regime")
        self._init(kwargs)

    def _fit(self, df: DataFrame) -> "RegimeRegressorModel":
        regime = RegimeColumn(speedCol=self.get("speedCol"), cut=self.get("cut"), outputCol=self.get("regimeCol"))
        tagged = regime.transform(df)

        def one(item):
            name, cols = item
            part = tagged.filter(F.col(self.get("regimeCol")) == name).cache()
            estimator = self.estimators[name]
            known = has_label(part, estimator.getOrDefault("labelCol"))
            model = regression_pipeline(cols, estimator).fit(part) if known else PipelineModel([])
            part.unpersist()
            return name, model

        with ThreadPoolExecutor(max_workers=4) as pool:  # each fit is a chain of distributed jobs
            models = dict(pool.map(one, self.get("features").items()))
        return RegimeRegressorModel(models, regime)


class RegimeRegressorModel(Model):
    """All input columns, the regime and ``prediction``; regimes are stacked with
    ``unionByName``."""

    def __init__(self, models: dict[str, PipelineModel], regime: RegimeColumn):
        super().__init__()
        self.models, self.regime = models, regime

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.regime.get("outputCol")
        tagged = self.regime.transform(df)
        tagged = tagged.withColumn("_row", F.struct(*tagged.columns))  # imputation leaves the given columns as they are
        unknown = F.lit(None).cast("double").alias("prediction")
        parts = [m.transform(tagged.filter(F.col(col) == name)).select("_row.*", "prediction" if m.stages else unknown)
                 for name, m in self.models.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def save(self, path: str) -> None:
        root = path.rstrip("/")
        self.regime.write().overwrite().save(f"{root}/regime-stage")
        for name, model in self.models.items():
            model.write().overwrite().save(f"{root}/models/{name}")

    @classmethod
    def load(cls, path: str, regimes=("low", "high")) -> "RegimeRegressorModel":
        root = path.rstrip("/")
        return cls({r: PipelineModel.load(f"{root}/models/{r}") for r in regimes}, RegimeColumn.load(f"{root}/regime-stage"))


class CentresModel(Model, _Stage):
    """Rows to their nearest centre (squared distance; of equal ones the first)."""
    centres = _p("centres", "centre vectors")
    inertia = _p("inertia", "sum of the squared distances to the own centres", TypeConverters.toFloat)
    featuresCol = _p("featuresCol", "vector column", TypeConverters.toString)
    predictionCol = _p("predictionCol", "centre number", TypeConverters.toString)

    @keyword_only
    def __init__(self, centres=None, inertia=0.0, featuresCol="features", predictionCol="cluster"):
        super().__init__()
        self._init(self._input_kwargs)

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.get("centres")]

    @property
    def summary(self) -> SimpleNamespace:
        return SimpleNamespace(trainingCost=self.get("inertia"), k=len(self.get("centres")))

    def _transform(self, df: DataFrame) -> DataFrame:
        centres = np.array(self.get("centres"))

        def nearest(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="int32")
            return pd.Series(_nearest(np.stack(x.to_numpy()), centres)[0].astype(np.int32))

        ship_package(df.sparkSession)
        return df.withColumn(self.get("predictionCol"), F.pandas_udf(nearest, "int")(vector_to_array(self.get("featuresCol"))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centre."""
    far = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        far += (x[:, d, None] - centres[None, :, d]) ** 2
    own = far.argmin(axis=1)
    return own, far[np.arange(len(x)), own]


def _means_of_nearest(blocks: DataFrame, starts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One step of k-means for all ``starts`` in one job: the means of the rows that
    have a centre as their nearest (a centre without rows stays), and the inertia of
    the given centres.  Tasks send sums of their blocks, one row per (start, centre)."""
    d = next(iter(starts.values())).shape[1]

    def run(batches):
        total = {i: np.zeros((len(c), d + 2)) for i, c in starts.items()}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                whole = np.frombuffer(raw).reshape(-1, d)
                for lo in range(0, len(whole), 2048):  # distances that fit a core's cache
                    x = whole[lo:lo + 2048]
                    for i, c in starts.items():
                        own, far = _nearest(x, c)
                        for j, w in enumerate((None, far, *x.T)):
                            total[i][:, j] += np.bincount(own, w, len(c))
        for i, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i)), pa.array(np.arange(len(t))), *[pa.array(t[:, j]) for j in range(d + 2)]],
                                             names=["start", "centre", *[f"s{j}" for j in range(d + 2)]])

    sums = [f"s{j}" for j in range(d + 2)]
    parts = blocks.mapInArrow(run, "start long, centre long, " + ", ".join(f"{s} double" for s in sums))
    # few rows: a handful of tasks adds them up, whatever the number of shuffle partitions
    rows = parts.repartition(4, "start", "centre").groupBy("start", "centre").agg(*[F.sum(s).alias(s) for s in sums]).collect()
    out = {i: (c.copy(), 0.0) for i, c in starts.items()}
    for r in sorted(rows):
        means, cost = out[r.start]
        if r.s0:
            means[r.centre] = np.array([r[s] for s in sums[2:]]) / r.s0
        out[r.start] = means, cost + r.s1
    return out


def best_kmeans(rows: DataFrame, k: int, starts: int = 10, seed: int = 7, tol: float = 1e-9, max_iter: int = 300,
                features: str = "features", out: str = "cluster", parallelism: int = 4) -> CentresModel:
    """k-means from several weighted seedings (k-means||); the fit of the least inertia
    is kept, of equal ones the first seed.  Iterations go on until no centre moves by
    more than ``tol``, so a centre is the mean of its rows.

    Spark ML draws the seedings.  The iterations of all of them share their jobs: the
    rows are packed once into blocks of numbers, and each job goes over the blocks for
    every seeding whose centres still move, so that there are at most ``max_iter`` jobs."""
    rows = rows.select(features).persist(StorageLevel.MEMORY_AND_DISK)

    def seeded(i: int) -> np.ndarray:
        return np.array(KMeans(k=k, seed=seed + i, tol=tol, maxIter=0, initSteps=5, featuresCol=features, predictionCol=out).fit(rows).clusterCenters())

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                x = b.column(0).slice(lo, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([x.flatten().to_numpy(zero_copy_only=False).tobytes()])], names=["x"])

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:  # each seeding is a chain of distributed jobs
            moving = dict(enumerate(pool.map(seeded, range(starts))))
        blocks = scratch_table(rows.select(vector_to_array(features).alias("x")).mapInArrow(pack, "x binary"), "kmeans-blocks")
    finally:
        rows.unpersist()
    ship_package(rows.sparkSession)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits: dict[int, tuple[np.ndarray, float]] = {}
        for step in range(max_iter):
            for i, (means, cost) in _means_of_nearest(blocks, moving).items():
                moved = ((means - moving[i]) ** 2).sum(axis=1).max() > tol * tol
                moving[i] = means
                if not moved or step == max_iter - 1:
                    fits[i] = moving.pop(i), cost
            if not moving:
                break
    finally:
        blocks.unpersist()
    best = min(fits, key=lambda i: (fits[i][1], i))
    return CentresModel(centres=fits[best][0].tolist(), inertia=fits[best][1], featuresCol=features, predictionCol=out)


def fit_pca(df: DataFrame, columns, k: int, nulls: str = "zero") -> tuple[PipelineModel, DataFrame]:
    """Min-max scaling, centring, ``k`` components; the fitted pipeline and the rows it was
    fitted on.  ``nulls``: "zero" reads NULL as 0, "drop" leaves out rows with a NULL."""
    if nulls not in ("zero", "drop"):
        raise ValueError(f"nulls is zero or drop, not {nulls}")
    columns = list(columns)
    rows = df.na.fill(0.0, columns) if nulls == "zero" else df.na.drop(subset=columns)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"),
                            MinMaxScaler(inputCol="raw", outputCol="scaled"),
                            StandardScaler(inputCol="scaled", outputCol="centred", withMean=True, withStd=False),
                            PCA(k=k, inputCol="centred", outputCol="scores")])
    return pipe.fit(rows), rows


def has_label(df: DataFrame, label: str) -> bool:
    """Whether a model can be fitted: a row has a label."""
    y = F.col(label).cast("double")
    return not df.filter(y.isNotNull() & ~F.isnan(y)).isEmpty()


def mae_of(pred: DataFrame, label: str = "TARGET") -> float:
    return pred.agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]


def cross_validate(make_pipeline, df: DataFrame, k: int = 5, key: str = "ID", seed: int = 7,
                   label: str = "TARGET", parallelism: int = 2, train_scores: bool = True) -> DataFrame:
    """k-fold MAE, train and test, one row per fold.  Folds come from the hash
    order of the key (reproducible); fits run in parallel driver threads, each
    a distributed job.  A fold whose training rows have no label has no model: its
    scores are NULL."""
    folded = windows.kfold_shuffled(df, k, key, seed).cache()

    def one(fold: int):
        train = folded.filter(F.col("fold") != fold)
        if not has_label(train, label):
            return fold, None, None
        test = folded.filter(F.col("fold") == fold)
        model = make_pipeline().fit(train)
        te = mae_of(model.transform(test), label)
        tr = mae_of(model.transform(train), label) if train_scores else None
        return fold, tr, te

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, range(1, k + 1)))
    folded.unpersist()
    spark = df.sparkSession
    return spark.createDataFrame(rows, "fold int, train_mae double, test_mae double")


def propose(points: np.ndarray, scores: np.ndarray, rng: np.random.Generator, candidates: int = 2000) -> np.ndarray:
    """The next point of the unit cube to try for a lower score: the largest
    expected improvement under a Gaussian process (RBF kernel, scaled scores, the
    length scale of the highest likelihood) over random candidates."""
    spread = scores.std() or 1.0
    y = (scores - scores.mean()) / spread
    dist = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    best = None
    for length in (0.1, 0.2, 0.4, 0.8, 1.6):
        k = np.exp(-dist / (2 * length * length)) + 1e-4 * np.eye(len(y))
        low = np.linalg.cholesky(k)
        a = np.linalg.solve(low.T, np.linalg.solve(low, y))
        fit = -0.5 * y @ a - np.log(np.diag(low)).sum()
        if best is None or fit > best[0]:
            best = fit, length, low, a
    _, length, low, a = best
    near = points[scores.argmin()] + rng.normal(0, 0.1, (candidates // 4, points.shape[1]))
    x = np.concatenate((rng.random((candidates, points.shape[1])), np.clip(near, 0, 1)))
    cross = np.exp(-((x[:, None] - points[None]) ** 2).sum(axis=2) / (2 * length * length))
    mean = cross @ a
    sd = np.sqrt(np.maximum(1 - (np.linalg.solve(low, cross.T) ** 2).sum(axis=0), 1e-12))
    z = (y.min() - mean) / sd
    erf = np.array([math.erf(v / math.sqrt(2)) for v in z])
    gain = (y.min() - mean) * 0.5 * (1 + erf) + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return x[gain.argmax()]


def search(score, bounds: dict, given: list[dict], n_random: int, n_guided: int, seed: int, integer_params=()) -> list[tuple[str, dict, float]]:
    """(kind, point, score) of the given points, of seeded random ones and of those
    that a surrogate of all scores so far proposes, one after the other.  Every
    call of ``score(points)`` takes a list of points and returns their scores."""
    names = list(bounds)
    low, high = (np.array([float(bounds[n][i]) for n in names]) for i in (0, 1))
    span = np.where(high > low, high - low, 1.0)
    point = lambda u: {n: round(v) if n in integer_params else float(v) for n, v in zip(names, low + u * (high - low), strict=True)}
    rng = np.random.default_rng(seed)
    points = [dict(p) for p in given] + [point(rng.random(len(names))) for _ in range(n_random)]
    kinds = ["given"] * len(given) + ["random"] * n_random
    scores = list(score(points)) if points else []
    for _ in range(n_guided):
        unit = np.array([(np.array([float(p[n]) for n in names]) - low) / span for p in points]).reshape(-1, len(names))
        new = point(propose(unit, np.array(scores), rng) if scores else rng.random(len(names)))
        points, kinds, scores = [*points, new], [*kinds, "guided"], [*scores, *score([new])]
    return list(zip(kinds, points, scores, strict=True))


def search_params(pipeline: Pipeline, estimator, df: DataFrame, bounds: dict, given: list[dict],
                  n_random: int = 3, n_guided: int = 5, seed: int = 11, k: int = 2, key: str = "ID", label: str = "TARGET",
                  integer_params=("maxIter", "maxDepth"), parallelism: int = 4) -> DataFrame:
    """Mean k-fold MAE of the given points, of seeded random draws inside the bounds
    and of ``n_guided`` points chosen one after the other by a surrogate model of
    all trials so far (``propose``); the trials table, best (lowest MAE) first.
    Folds come from the hash order of the key; fits run in parallel driver threads,
    each a chain of distributed jobs."""
    folded = windows.kfold_shuffled(df, k, key, seed).cache()

    def one(task):
        p, fold = task
        params = {getattr(estimator, name): int(v) if name in integer_params else float(v) for name, v in p.items()}
        model = pipeline.copy(params).fit(folded.filter(F.col("fold") != fold))
        return mae_of(model.transform(folded.filter(F.col("fold") == fold)), label)

    def score(points):
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            maes = list(pool.map(one, [(p, f) for p in points for f in range(1, k + 1)]))
        return [sum(maes[i * k:(i + 1) * k]) / k for i in range(len(points))]

    trials = search(score, bounds, given, n_random, n_guided, seed, integer_params)
    folded.unpersist()
    rows = [(i, kind, str(sorted(p.items())), float(s)) for i, (kind, p, s) in enumerate(trials)]
    return df.sparkSession.createDataFrame(rows, "trial int, kind string, params string, cv_mae double").orderBy("cv_mae", "trial")


def importance_table(spark: SparkSession, names, model) -> DataFrame:
    """(feature, importance) ordered by importance, from a bare tree model or
    the last stage of a fitted pipeline."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    vals = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def importance_over_splits(make_pipeline, df: DataFrame, names, seeds=(1, 2, 3), key: str = "ID") -> DataFrame:
    """Importances summed over several hold-out splits, ranked."""
    spark = df.sparkSession
    tables = []
    for s in seeds:
        train = windows.split_holdout(df, 0.2, key, seed=s).filter(~F.col("is_test"))
        tables.append(importance_table(spark, names, make_pipeline().fit(train)).withColumn("split", F.lit(s)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def node_table(spark: SparkSession, model) -> DataFrame:
    """Nodes of a fitted tree model: tree, node, left, right, feature, threshold
    (a value up to it goes left), value, gain, n_rows.  Leaves have no children.
    Spark's trees are read from the node data that the model's writer saves."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if hasattr(model, "node_table"):
        return model.node_table(spark)
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data.select(F.col("treeID").alias("tree"), "nodeData.*") if "treeID" in data.columns else data.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    return data.select("tree", F.col("id").alias("node"), F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
                       F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
                       F.col("prediction").alias("value"), F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("n_rows"))


def importance_from_nodes(nodes: DataFrame, names) -> DataFrame:
    """(feature, importance) of a forest from its node table: gains weighted by
    rows, as shares within each tree, then of all trees."""
    share = F.sum("w") / F.sum(F.sum("w")).over(Window.partitionBy("tree"))
    per_tree = (nodes.where("left is not null").withColumn("w", F.col("gain") * F.col("n_rows"))
                .groupBy("tree", "feature").agg(share.alias("share")))
    total = per_tree.agg(F.sum("share")).first()[0]
    names = spark_names(nodes.sparkSession, names)
    return (names.join(per_tree.groupBy("feature").agg((F.sum("share") / F.lit(total)).alias("importance")), names["i"] == F.col("feature"), "left")
            .select("name", F.coalesce("importance", F.lit(0.0)).alias("importance")).withColumnRenamed("name", "feature")
            .orderBy(F.desc("importance"), "feature"))


def spark_names(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "i int, name string")
