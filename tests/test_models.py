"""Models on a table with a known signal (FIXTURES.md section 4), generated
with ``spark.range`` and hash-based noise; plus determinism and save/load."""

from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gustframe.plans import features as fx
from gustframe.plans import models as M


def u(i: int):
    return F.pmod(F.xxhash64(F.col("ID"), F.lit(i)), F.lit(1000003)) / 1000003.0


@pytest.fixture(scope="module")
def signal(spark):
    n = 20_000
    df = spark.range(n).withColumnRenamed("id", "ID")
    speed = 17 * u(1)
    pitch = -1 + 91 * (u(2) < 0.2).cast("double")
    noise = 10 * (u(4) + u(5) + u(6) - 1.5)
    target = (F.when(pitch > 45, F.lit(-5.0)).when(speed < 15, 0.3 * speed * speed * speed)
              .otherwise(1000 + 500 * (speed - 15))) + noise
    out = df.select(
        "ID", F.concat(F.lit("WT"), (F.col("ID") % 4 + 1).cast("string")).alias("MAC_CODE"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), (F.floor(F.col("ID") / 4) * 10).cast("int"), F.lit(0))).alias("Date_time"),
        speed.alias("Rotor_speed"), (speed - u(7)).alias("Rotor_speed_min"), (speed + u(8)).alias("Rotor_speed_max"),
        u(3).alias("Rotor_speed_std"), pitch.alias("Pitch_angle"), (pitch - 1).alias("Pitch_angle_min"),
        (pitch + 1).alias("Pitch_angle_max"), u(9).alias("Pitch_angle_std"),
        (30 + 2 * speed + noise / 5).alias("Generator_stator_temperature_min"),
        F.when(u(10) < 0.05, F.lit(None)).otherwise(380 + u(11)).alias("Grid_voltage"), target.alias("TARGET"))
    return out.cache()


def _median_mae(train, test):
    med = train.approxQuantile("TARGET", [0.5], 0.0)[0]
    return test.agg(F.avg(F.abs(F.col("TARGET") - F.lit(med)))).first()[0]


def test_boosted_beats_median_and_ranks_speed(spark, signal):
    from gustframe.operators import windows
    s = windows.split_holdout(signal, 0.2)
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    feats = ["Rotor_speed", "Pitch_angle"]
    model = M.regression_pipeline(feats, M.boosted(maxIter=20, maxDepth=4, stepSize=0.3)).fit(train)
    mae = M.mae_of(model.transform(test))
    assert mae < 0.2 * _median_mae(train, test)
    imp = M.importance_table(spark, feats, model).collect()
    assert imp[0].feature == "Rotor_speed"
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    again = M.regression_pipeline(feats, M.boosted(maxIter=20, maxDepth=4, stepSize=0.3)).fit(train)
    a = model.transform(test).select("ID", "prediction").orderBy("ID").limit(50).collect()
    b = again.transform(test).select("ID", "prediction").orderBy("ID").limit(50).collect()
    assert a == b


def test_regime_model_not_worse_than_single(spark, signal, tmp_path):
    from gustframe.operators import windows
    feat = fx.AddFeatures().fit(signal).transform(signal)
    s = windows.split_holdout(feat, 0.2)
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    cols = ["Rotor_speed3", "Pitch_angle", "Rotor_speed_std"]
    single = M.regression_pipeline(cols, M.boosted(maxIter=15, maxDepth=4, stepSize=0.3)).fit(train)
    reg = M.RegimeRegressor(features={"low": cols, "high": cols},
                            estimators={"low": M.boosted(maxIter=15, maxDepth=4, stepSize=0.3),
                                        "high": M.boosted(maxIter=15, maxDepth=4, stepSize=0.3)}).fit(train)
    m_single = M.mae_of(single.transform(test))
    pred = reg.transform(test)
    assert pred.count() == test.count()
    m_reg = M.mae_of(pred)
    assert m_reg <= m_single * 1.1
    path = str(tmp_path / "regime")
    reg.save(path)
    back = M.RegimeRegressorModel.load(path)
    assert [c for c in pred.columns if c not in test.columns] == ["regime", "prediction"]
    assert M.mae_of(back.transform(test)) == pytest.approx(m_reg)


def test_cross_validate_and_feature_stage_persistence(spark, signal, tmp_path):
    cv = M.cross_validate(lambda: M.regression_pipeline(["Rotor_speed"], M.boosted(maxIter=5, maxDepth=3)),
                          signal.limit(4000), k=3, parallelism=2).collect()
    assert len(cv) == 3 and all(r.test_mae > 0 and r.train_mae > 0 for r in cv)
    model = fx.ImputeMedian(inputCols=["Grid_voltage"]).fit(signal)
    path = str(tmp_path / "imp")
    model.write().overwrite().save(path)
    back = fx.ImputeMedianModel.load(path)
    assert back.getOrDefault(back.medians) == model.getOrDefault(model.medians)


def test_search_params(spark, signal):
    gbt = M.boosted(maxIter=3, maxDepth=2)
    pipe = M.regression_pipeline(["Rotor_speed", "Pitch_angle"], gbt, impute=False)
    trials = M.search_params(pipe, gbt, signal.limit(3000), {"maxIter": (2, 6), "maxDepth": (2, 4)},
                             [{"maxIter": 3, "maxDepth": 2}], n_random=1, n_guided=1, k=2).collect()
    assert len(trials) == 3 and {t.kind for t in trials} == {"given", "random", "guided"}
    assert trials[0].cv_mae <= trials[1].cv_mae and all(t.cv_mae > 0 for t in trials)


def test_null_free_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5.0, 2.0), (2, 2.0, 3.0, 6.0, 4.0)], "ID long, a double, b double, c double, TARGET double")
    va = M.AssembleNullFree(stop=["ID", "c"]).fit(df)
    assert va.getInputCols() == ["a"]


def test_published_sizes_are_the_defaults():
    gbt = M.boosted()
    assert (gbt.getOrDefault("maxIter"), gbt.getOrDefault("maxDepth"), gbt.getOrDefault("stepSize")) == (1500, 4, 0.1)
    assert M.forest().getNumTrees() == 100 and M.forest().getMaxDepth() == 12


def test_registered_models_keep_every_row(spark):
    """Model queries return each row once, in the set of the exact split, and beat
    the median predictor."""
    import __spark_entry__ as entry
    from gustframe.operators import windows
    from gustframe.sources import driver_views as V
    sf = "/root/testdata/sf0.001"
    split = {r.ID: ("test" if r.is_test else "train", r.TARGET) for r in windows.split_holdout(V.turbine(spark, sf), 0.2, "ID", seed=345).collect()}
    for name in ("forest_regressor", "regime_pipeline", "single_pipeline"):
        rows = entry.queries()[name](spark, sf).collect()
        assert {r.ID: (r.set, r.TARGET) for r in rows} == split and len(rows) == len(split)
        med = sorted(t for s, t in split.values() if s == "train")[len([1 for s, _ in split.values() if s == "train"]) // 2]
        err = sum(abs(r.TARGET - r.prediction) for r in rows) / len(rows)
        assert err < sum(abs(r.TARGET - med) for r in rows) / len(rows)
    labels = entry.queries()["kmeans_labels"](spark, sf)
    assert labels.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_best_kmeans_keeps_the_least_inertia(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(2)
    at = np.array([(10 * i, 10 * j) for i in range(4) for j in range(3)], dtype=float)
    xy = np.concatenate([c + rng.normal(size=(40, 2)) * 0.3 for c in at])
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(xy.tolist(), "a double, b double"))
    model = M.best_kmeans(rows, k=12, starts=6)
    costs = [KMeans(k=12, seed=7 + i, tol=1e-9, maxIter=300, initSteps=5).fit(rows).summary.trainingCost for i in range(6)]
    assert model.summary.trainingCost == pytest.approx(min(costs))
    centres = np.array(model.clusterCenters())
    own = ((xy[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert [r.cluster for r in model.transform(rows).collect()] == own.tolist()
    assert np.allclose(centres, [xy[own == i].mean(0) for i in range(12)])
    assert all(np.abs(centres - c).sum(1).min() < 0.5 for c in at)  # every planted group has its centre


def test_pca_drop_leaves_out_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, None), (3, 3.0, 1.0), (4, None, 9.0), (5, 0.0, 0.5)], "ID int, a double, b double")
    model, rows = M.fit_pca(df, ["a", "b"], 2, "drop")
    assert [r.ID for r in rows.orderBy("ID").collect()] == [1, 3, 5]
    same, _ = M.fit_pca(rows, ["a", "b"], 2)
    assert model.stages[-1].pc.toArray().tolist() == same.stages[-1].pc.toArray().tolist()
    assert M.fit_pca(df, ["a", "b"], 2)[1].count() == 5
    with pytest.raises(ValueError, match="zero or drop"):
        M.fit_pca(df, ["a", "b"], 2, "other")


def test_regime_without_rows_keeps_its_folds_and_rows(spark, tmp_path):
    """Hourly means of many events are all below the cut: the high regime has no row to learn from."""
    rows = [(i, 5.0 + i % 7, float(i % 11), 3.0 * (i % 7)) for i in range(60)]
    slow = spark.createDataFrame(rows, "ID long, Rotor_speed double, Pitch_angle double, TARGET double")
    cols = ["Rotor_speed", "Pitch_angle"]
    small = lambda: M.boosted(maxIter=3, maxDepth=2)
    model = M.RegimeRegressor(features={"low": cols, "high": cols}, estimators={"low": small(), "high": small()}).fit(slow)
    fast = spark.createDataFrame([(100, 16.0, 1.0, 9.0)], slow.schema)
    model.save(str(tmp_path / "regime"))
    for m in (model, M.RegimeRegressorModel.load(str(tmp_path / "regime"))):
        got = {r.ID: r for r in m.transform(slow.unionByName(fast)).collect()}
        assert len(got) == 61 and got[100].regime == "high" and got[100].prediction is None
        assert all(got[i].regime == "low" and got[i].prediction is not None for i in range(60))
    for make in (lambda: M.regression_pipeline(cols, M.forest(2, 3), impute=False), lambda: M.regression_pipeline(cols, small(), impute=False)):
        none = M.cross_validate(make, slow.filter("Rotor_speed >= 15"), k=5).orderBy("fold").collect()
        assert [tuple(r) for r in none] == [(f, None, None) for f in range(1, 6)]
        one = M.cross_validate(make, fast, k=3).orderBy("fold").collect()
        assert [(r.train_mae is None, r.test_mae is None) for r in one] == [(True, True), (False, True), (False, True)]


def test_kmeans_jobs_do_not_grow_with_the_seedings_iterations(spark):
    """The iterations of all seedings share their jobs."""
    import numpy as np
    xy = np.random.default_rng(5).random((3000, 2))
    rows = spark.createDataFrame([(Vectors.dense(x),) for x in xy.tolist()], ["features"]).repartition(3)
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    before = last_job()
    model = M.best_kmeans(rows, k=10, starts=8)
    assert last_job() - before < 320  # 252; with iterations of their own, the seedings took 381
    centres = np.array(model.clusterCenters())
    own = ((xy[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(centres, [xy[own == i].mean(0) for i in range(10)])
    assert model.summary.trainingCost == pytest.approx(((xy - centres[own]) ** 2).sum())
