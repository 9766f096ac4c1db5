"""k nearest neighbours over the k-d partition against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllo.operators import kdtree, spatial


def _table(spark, clouds, kind="long"):
    rows = [(uid, i, *map(float, p)) for uid, points in clouds.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"uid string, vid {kind}, x double, y double, z double").repartition(4)


def _plain(src, dst, k, drop_self=False, within=float("inf")):
    out = {}
    for uid, points in src.items():
        for i, p in enumerate(points):
            far = [(float(np.sqrt(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) + (p[2] - q[2]) ** 2)), j) for j, q in enumerate(dst.get(uid, ())) if not (drop_self and i == j)]
            out[uid, i] = sorted(x for x in far if x[0] <= within)[:k]
    return {key: v for key, v in out.items() if v}


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["uid"], r["src"]), []).append((r["rank"], r["d"], r["dst"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {key: [(d, j) for _, d, j in sorted(v)] for key, v in out.items()}


def _clouds(seed):
    r = np.random.default_rng(seed)
    far = np.concatenate([r.normal(size=(250, 3)), r.normal(size=(6, 3)) * 4000])
    grid = np.array([(i % 7, i // 7 % 7, i // 49) for i in range(343)], float)
    tied = np.concatenate([np.zeros((150, 3)), r.normal(size=(40, 3))])
    flat = np.column_stack([np.repeat(r.normal(size=20), 9), np.zeros(180), r.integers(0, 3, 180)])
    return {"far": far, "grid": grid, "tied": tied, "flat": flat, "one": np.zeros((1, 3)), "few": r.normal(size=(4, 3))}


@pytest.mark.parametrize(("leaf", "k"), [(16, 1), (24, 3), (1024, 5)])
def test_neighbours_equal_all_distances(spark, leaf, k):
    clouds = _clouds(leaf)
    df = _table(spark, clouds)
    assert _got(spatial.knn_join(df, df, k, drop_self=True, leaf=leaf)) == _plain(clouds, clouds, k, True)


def test_neighbours_in_another_cloud_and_within_a_distance(spark):
    a, b = _clouds(1), _clouds(2)
    del b["few"]
    b["only"] = a["few"]
    assert _got(spatial.knn_join(_table(spark, a), _table(spark, b), 2, leaf=16)) == _plain(a, b, 2)
    assert _got(spatial.knn_join(_table(spark, a), _table(spark, b), 2, max_distance=0.7, leaf=16)) == _plain(a, b, 2, within=0.7)


def test_crowded_leaves_are_searched_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SEARCHING", 20)
    a = {"u": np.random.default_rng(3).normal(size=(300, 3))}
    b = {"u": np.random.default_rng(4).normal(size=(30, 3))}
    assert _got(spatial.knn_join(_table(spark, a), _table(spark, b), 3)) == _plain(a, b, 3)


def test_leaves_stay_small_and_far_points_cost_no_pairs(spark):
    """No leaf is over its bound, and a few points far out don't raise the leaves that balls cut."""
    r = np.random.default_rng(5)
    near = r.random((20_000, 3))
    far = near.copy()
    far[:8] += 5000 * r.normal(size=(8, 3))
    cuts = []
    for points in (near, far):
        names = ["c0", "c1", "c2"]
        rows = spark.createDataFrame([(0, 0, False, i, *map(float, p)) for i, p in enumerate(points)], "gid long, path long, asks boolean, vid long, c0 double, c1 double, c2 double")
        boxes = kdtree._boxes(rows, names)
        dealt, nodes = kdtree._split_round(rows, boxes, names, 1024, 0)
        leaves = kdtree._boxes(dealt, names).withColumn("base", F.col("path") - F.pmod("path", F.lit(64))).join(nodes.withColumnRenamed("path", "_up"), ["gid", "base"]).withColumn("open", F.lit(False))
        assert leaves.agg(F.max("n")).first()[0] <= 1024
        balls = dealt.select("gid", F.col("path").alias("home"), F.lit(0).cast("long").alias("path"), "vid", F.when(F.col("vid") < 8, F.lit(10.0)).otherwise(F.lit(0.045)).alias("reach"), *names)
        cuts.append(kdtree._cut_leaves(balls, [leaves], names).count())
    assert cuts[1] <= 1.2 * cuts[0]


def test_reach_of_points_is_not_broadcast(spark, monkeypatch):
    plans = []
    real = kdtree.cut
    monkeypatch.setattr(kdtree, "cut", lambda df, name="cut": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    df = spark.range(3000).selectExpr("'a' AS uid", "id AS vid", "rand(1) AS x", "rand(2) AS y", "rand(3) AS z")
    assert kdtree.nearest(df, df, 4, ("uid",), ("x", "y", "z"), leaf=200).count() == 12000
    joins = [line for name, plan in plans if name == "knn-across" for line in plan.splitlines() if "LeftOuter" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
