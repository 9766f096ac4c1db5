"""Projection through frustum culling against projecting every point into every view."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllo.operators import kdtree, views


def _scene(spark, n=3000, n_views=12):
    r = np.random.default_rng(7)
    p = np.concatenate([r.normal(size=(n, 3)) * (4, 2, 1), r.normal(size=(5, 3)) * 3000])
    rows = [("a", i, *map(float, x)) for i, x in enumerate(p)] + [("b", 0, float("nan"), 0.0, 0.0), ("b", 1, None, 0.0, 1.0), ("b", 2, float("inf"), 0.0, 1.0)]
    points = spark.createDataFrame(rows, "uid string, vid long, x double, y double, z double").repartition(3)
    shots = []
    for v in range(n_views):
        q = r.normal(size=4)
        q /= np.linalg.norm(q)
        shots.append((v, *map(float, q), *map(float, r.normal(size=3) * (1, 1, 3)), (90.0 + v, 80.0, 32.0, 24.0), 64, 48))
    view = spark.createDataFrame(shots, "view_id int, q0 double, q1 double, q2 double, q3 double, t0 double, t1 double, t2 double, k struct<fx:double,fy:double,cx:double,cy:double>, width int, height int")
    return p, points, view, shots


def _plain(p, shots, rounding, near, margin):
    out = set()
    for v, w, x, y, z, t0, t1, t2, (fx, fy, cx, cy), width, height in shots:
        rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        cam = p @ rot.T + (t0, t1, t2)
        with np.errstate(divide="ignore", invalid="ignore"):
            u, s = fx * cam[:, 0] / cam[:, 2] + cx, fy * cam[:, 1] / cam[:, 2] + cy
        u, s = (np.rint(u), np.rint(s)) if rounding == "rint" else (np.trunc(u), np.trunc(s))
        for i in np.flatnonzero((cam[:, 2] > near) & (u >= 0) & (s >= 0) & (u < width - margin) & (s < height - margin)):
            out.add(("a", int(i), v, int(u[i]), int(s[i])))
    return out


@pytest.mark.parametrize(("rounding", "near", "margin", "cell"), [("rint", 1e-6, 0, 64), ("trunc", 0.0, 1, 64), ("rint", 0.5, 0, 1 << 20)])
def test_projection_equals_all_points_in_all_views(spark, rounding, near, margin, cell):
    p, points, view, shots = _scene(spark)
    got = {(r["uid"], r["vid"], r["view_id"], r["u"], r["v"]) for r in views.project_points(points, view, rounding, near, margin, cell=cell).collect()}
    assert got == _plain(p, shots, rounding, near, margin) and len(got) > 100
    few = {(r["uid"], r["vid"], r["view_id"], r["u"], r["v"]) for r in views.project_points(points, view.where("view_id < 5"), rounding, near, margin).collect()}
    assert few == {r for r in got if r[2] < 5}


def test_points_are_projected_only_where_they_may_be_seen(spark):
    p, points, view, _ = _scene(spark)
    names = ["c0", "c1", "c2"]
    rows = points.where("uid = 'a'").select(F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("path"), F.lit(False).alias("asks"), "vid", *[F.col(c).alias(n) for c, n in zip("xyz", names, strict=True)])
    dealt, roots, rounds = kdtree.deal(rows, names, 64)
    projected = dealt.join(views.seen_cells(view, roots, rounds), ["gid", "path"]).count()
    assert projected < 0.3 * len(p) * 12
    narrow = view.withColumn("k", F.struct((F.col("k.fx") * 6).alias("fx"), (F.col("k.fy") * 6).alias("fy"), "k.cx", "k.cy"))
    assert dealt.join(views.seen_cells(narrow, roots, rounds), ["gid", "path"]).count() < 0.75 * projected
    assert views.project_points(points.limit(0), view).count() == 0 and views.project_points(points, view.limit(0)).count() == 0


def test_rotations_are_taken_once_a_view_and_points_are_not_broadcast(spark):
    """Each pair took its view's rotation anew, several times over: 33 s for 100,000 points in 25 views."""
    _, points, view, _ = _scene(spark)
    for shots, join in ((view, "SortMergeJoin"), (view.where("view_id < 5"), "BroadcastNestedLoopJoin")):
        plan = views.project_points(points, shots, cell=256)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join Inner", 1)
        assert "Generate inline" in above and "q0#" not in above.split("Generate inline")[0] and "r00#" in above
        assert join in views.project_points(points, shots, cell=256)._jdf.queryExecution().executedPlan().toString()
