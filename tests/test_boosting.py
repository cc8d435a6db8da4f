"""Histogram boosting: one task and jobs per level grow the same trees, depth-1
trees against SQL, scores against a recursive walk in SQL, the guided search."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gustframe.plans import boosting as B
from gustframe.plans import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack((rng.integers(0, 12, 3000), rng.normal(size=3000), rng.integers(0, 3, 3000))).astype(float)
    y = 3.0 * (x[:, 0] > 6) - 2.0 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(0, 0.1, 3000)
    data = [(i, float(a), None if i % 40 == 5 else float(b), float(c), None if i % 97 == 3 else float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "ID long, a double, b double, c double, TARGET double").repartition(3, "ID")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(df).cache()


def _nodes(model):
    return model.getOrDefault(model.nodes)


def test_same_trees_in_one_task_and_by_jobs(rows, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    make = lambda: B.HistBoostedRegressor(maxIter=5, maxDepth=2, columnShare=0.7, subsamplingRate=0.8, l2=0.5)
    one = make().fit(rows)
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    monkeypatch.setattr(B, "REFRESH", 2)
    jobs = make().fit(rows)
    assert _nodes(one) == _nodes(jobs) and len({r[0] for r in one.rows()}) == 5
    per_tree = {}
    for t, _, f, *_ in one.rows():
        per_tree.setdefault(t, set()).add(f)
    assert all(len(s - {-1}) <= 2 for s in per_tree.values()) and len(set().union(*per_tree.values())) == 4


def test_depth_one_tree_by_sql(rows):
    model = B.HistBoostedRegressor(maxIter=1, maxDepth=1, stepSize=0.5, l2=2.0).fit(rows)
    table = rows.select("a", "c", "TARGET").toPandas()  # b has too many values for exact cuts
    con = duckdb.connect()
    con.register("t", table)
    root = [r for r in model.rows() if r[1] == 0][0]
    want = con.sql("""
        with u as (select * from t where TARGET is not null and not isnan(TARGET)), m as (select cast(avg(TARGET) as float) as base from u),
        l as (select 0 as f, a as x, base - TARGET as g from u, m union all select 2, c, base - TARGET from u, m),
        v as (select f, x, sum(g) as g, count(*) as n from l group by f, x),
        s as (select f, x, sum(g) over w as gl, sum(n) over w as nl, sum(g) over (partition by f) as g, sum(n) over (partition by f) as n
              from v window w as (partition by f order by x))
        select f, x, gl, nl, (gl * gl / (nl + 2) + (g - gl) * (g - gl) / (n - nl + 2) - g * g / (n + 2)) / 2 as gain, g, n
        from s where nl < n order by gain desc, f, x limit 1""").fetchall()[0]
    assert root[2] in (0, 1, 2)
    if root[2] != 1:
        assert (root[2], root[3]) == want[:2] and root[5] == pytest.approx(want[4])
        left, right = ([r for r in model.rows() if r[1] == i][0] for i in (1, 2))
        assert left[4] == pytest.approx(-0.5 * want[2] / (want[3] + 2)) and left[6] == want[3]
        assert right[4] == pytest.approx(-0.5 * (want[5] - want[2]) / (want[6] - want[3] + 2)) and right[6] == want[6] - want[3]
    else:
        assert root[5] >= want[4]


def test_recursive_sql_scores_the_same(spark, rows):
    model = B.HistBoostedRegressor(maxIter=8, maxDepth=3, l2=0.05).fit(rows)
    con = duckdb.connect()
    con.register("nodes", model.node_table(spark).toPandas())
    con.register("x", rows.select(F.col("ID").alias("id"), "a", "b", "c").toPandas())
    got = dict(con.sql(f"""
        with recursive long as (select id, 0 as f, a as v from x union all select id, 1, b from x union all select id, 2, c from x),
        walk as (select id, tree, 0 as node from x, (select distinct tree from nodes)
                 union all
                 select w.id, w.tree, cast(case when l.v <= n.threshold and not isnan(l.v) then n."left" else n."right" end as integer)
                 from walk w join nodes n on n.tree = w.tree and n.node = w.node join long l on l.id = w.id and l.f = n.feature
                 where n."left" is not null)
        select id, {model.getOrDefault(model.base)} + sum(n.value) from walk w join nodes n using (tree, node) where n."left" is null or isnan(n."left") group by id""").fetchall())
    for r in model.transform(rows).select("ID", "prediction").collect():
        assert got[r.ID] == pytest.approx(r.prediction)


def test_persistence_and_errors(spark, rows, tmp_path):
    model = B.HistBoostedRegressor(maxIter=3, maxDepth=2).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = B.HistBoostedRegressorModel.load(str(tmp_path / "m"))
    assert [r.prediction for r in back.transform(rows).orderBy("ID").collect()] == [r.prediction for r in model.transform(rows).orderBy("ID").collect()]
    with pytest.raises(ValueError, match="no rows"):
        B.HistBoostedRegressor().fit(rows.where("TARGET is null"))
    flat = rows.withColumn("TARGET", F.lit(2.5))
    assert {r.prediction for r in B.HistBoostedRegressor(maxIter=2).fit(flat).transform(flat).select("prediction").collect()} == {2.5}
    assert json.loads(_nodes(B.HistBoostedRegressor(maxIter=2).fit(flat)))[0][2] == -1


def test_search_is_guided_by_scores():
    goal = {"x": 0.31, "n": 7}
    bounds = {"x": (0.0, 1.0), "n": (2, 20)}

    def score(points, sign=1):
        return [sign * ((p["x"] - goal["x"]) ** 2 + ((p["n"] - goal["n"]) / 18) ** 2) for p in points]

    found = M.search(score, bounds, [{"x": 0.9, "n": 18}], 4, 12, 3, ("n",))
    assert [k for k, _, _ in found] == ["given"] + ["random"] * 4 + ["guided"] * 12
    best = min(found, key=lambda t: t[2])
    assert best[0] == "guided" and abs(best[1]["x"] - 0.31) < 0.1 and abs(best[1]["n"] - 7) <= 2
    other = M.search(lambda ps: score(ps, -1), bounds, [{"x": 0.9, "n": 18}], 4, 12, 3, ("n",))
    assert [p for _, p, _ in other[:5]] == [p for _, p, _ in found[:5]] and other[5][1] != found[5][1]
    assert all(0 <= p["x"] <= 1 and 2 <= p["n"] <= 20 and isinstance(p["n"], int) for _, p, _ in found)


def test_forest_node_table_by_recursive_sql(spark, rows):
    """Predictions and importances of a forest and the classes of a tree follow
    from their node tables."""
    from pyspark.ml.classification import DecisionTreeClassifier
    full = rows.where("TARGET is not null and b is not null").withColumn("label", (F.col("TARGET") > 1).cast("double"))
    forest = M.forest(5, 4).fit(full)
    tree = DecisionTreeClassifier(maxDepth=4, labelCol="label", seed=7).fit(full)
    con = duckdb.connect()
    con.register("x", full.select(F.col("ID").alias("id"), "a", "b", "c").toPandas())
    for model, data in ((forest, M.node_table(spark, forest)), (tree, M.node_table(spark, tree))):
        con.register("nodes", data.selectExpr("tree", "node", "coalesce(left, -1) as l", "coalesce(right, -1) as r", "coalesce(feature, -1) as f",
                                              "coalesce(threshold, 0.0) as cut", "value").toPandas())
        got = dict(con.sql("""
            with recursive long as (select id, 0 as f, a as v from x union all select id, 1, b from x union all select id, 2, c from x),
            walk as (select id, tree, 0 as node from x, (select distinct tree from nodes)
                     union all select w.id, w.tree, case when y.v <= n.cut then n.l else n.r end
                     from walk w join nodes n using (tree, node) join long y on y.id = w.id and y.f = n.f)
            select id, avg(value) from walk join nodes using (tree, node) where l < 0 group by id""").fetchall())
        for r in model.transform(full).select("ID", "prediction").collect():
            assert got[r.ID] == pytest.approx(r.prediction)
    names = ["a", "b", "c"]
    want = {r.feature: r.importance for r in M.importance_table(spark, names, forest).collect()}
    assert {r.feature: r.importance for r in M.importance_from_nodes(M.node_table(spark, forest), names).collect()} == pytest.approx(want)
