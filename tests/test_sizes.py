"""Plans whose tasks don't grow with their tables."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from phyllo.operators import features, images, refine, spatial, views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_meet_their_skeleton_as_groups(spark):
    pixels = spark.createDataFrame([(1, 1, v, u) for v in range(5) for u in range(5)], "view_id long, rank long, v long, u long")
    sizes = spark.createDataFrame([(1, 60, 60)], "view_id long, height int, width int")
    more = spark.createDataFrame([(1, v, 50) for v in range(60)] + [(2, 0, 0)], "view_id long, v long, u long")
    out = refine.paint_leaves(pixels, pixels.select("view_id", "v", "u").unionByName(more), sizes)
    assert "FlatMapCoGroups" in _plan(out) and out.count() == 25


def test_drawn_pixels_are_not_dealt_by_view(spark):
    hits = spark.createDataFrame([("a", i, i % 3, 5 + i, 7, 1.0) for i in range(9)], "uid string, vid long, view_id int, u long, v long, depth double")
    points = hits.select("uid", "vid", *[F.lit(1).alias(c) for c in ("red", "green", "blue")])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        canvas, _ = views.render(points, hits, hits.select("view_id").distinct().withColumns({"width": F.lit(99), "height": F.lit(99)}), 1)
        plan = _plan(canvas)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and not any(re.search(r"\[view_id#\d+L?\]", j) for j in joins)


def test_tasks_of_overlaps_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(refine, "OVERLAP_ROWS", 10)
    cells = spark.createDataFrame([("a", m, v) for m in range(4) for v in range(m, m + 30)], "uid string, mask_id long, vid long")
    out = refine.mask_overlaps(cells)
    assert ", 12), REPARTITION_BY_NUM" in _plan(out)
    assert {(r["a"], r["b"]): round(r["iou"], 9) for r in out.collect()} == {(a, b): round((30 - b + a) / (30 + b - a), 9) for a in range(4) for b in range(a + 1, 4)}


def test_squares_by_spans_equal_whole_squares():
    mask = np.random.default_rng(0).random((23, 31)) < 0.4
    for size in (1, 3, 5, 15):
        for largest in (True, False):
            view = np.lib.stride_tricks.sliding_window_view(np.pad(mask, size // 2, constant_values=not largest), (size, size))
            assert (images._window(mask, size, largest) == (view.max(axis=(2, 3)) if largest else view.min(axis=(2, 3)))).all()


def test_crowded_cells_of_radius_joins_are_many_tasks(spark, monkeypatch):
    for name, value in (("COPIES", 16), ("SPOTS", 4), ("BLOCK", 16), ("PAIRS", 1000)):
        monkeypatch.setattr(spatial, name, value)
    r = np.random.default_rng(5)
    p = np.concatenate([np.repeat([[0.1, 0.1, 0.1], [0.9, 0.5, 0.5], [1.2, 0.5, 0.5]], 40, axis=0), r.random((60, 3)), [[9.0, 9.0, 9.0]]])
    rows = [("a", i, *map(float, x)) for i, x in enumerate(p)] + [(None, 500, 0.0, 0.0, 0.0), (None, None, -0.0, 0.0, 0.1), ("b", 600, None, 0.0, 0.0), ("b", 601, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "uid string, vid long, x double, y double, z double")
    out = spatial.radius_join(df, df, 1.0)
    d = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2))
    want = Counter(("a", int(i), int(j)) for i, j in zip(*np.nonzero(d <= 1.0), strict=True)) + Counter((None, i, j) for i in (500, None) for j in (500, None))
    got = out.collect()
    assert Counter((x["uid"], x["src"], x["dst"]) for x in got) == want and all(abs(x["d"] - d[x["src"], x["dst"]]) < 1e-12 for x in got if x["uid"])
    tasks = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 20 and max(tasks) < len(got) / 10
    assert {x["d"] for x in spatial.radius_join(df, df, 1.0, digits=1).collect()} == {round(x["d"], 1) for x in got}


def test_close_superpoints_are_never_dealt_as_pairs(spark, monkeypatch):
    """All pairs went through ``distinct`` and two joins before: the disk had them three times."""
    for name, value in (("COPIES", 3), ("SPOTS", 4), ("BLOCK", 16), ("HANDFUL", 4), ("PAIRS", 1000)):
        monkeypatch.setattr(spatial, name, value)
    r = np.random.default_rng(8)
    p = np.concatenate([r.random((150, 3)), np.repeat(r.random((5, 3)), 10, axis=0), r.random((20, 3)) * 9]).round(3)
    low, views = r.choice([0.1, 0.9], len(p)), [{v: int(r.integers(2)) for v in range(3) if r.random() < 0.6} for _ in p]
    stats = spark.createDataFrame([(i, float(low[i]), *map(float, x)) for i, x in enumerate(p)], "sp long, confidence double, x double, y double, z double")
    seen = spark.createDataFrame([(i, v, k) for i, x in enumerate(views) for v, k in x.items()], "sp long, view_id int, label int")
    out = features.superpoint_distances(stats, seen, within=0.4)
    plan = _plan(out.where("distance > 99"))
    assert plan.count("Exchange") <= 3 and "HashAggregate" not in plan  # blocks to their cells, and pairs of blocks to tasks

    def apart(i, j):
        both = [views[i][v] == views[j][v] for v in set(views[i]) & set(views[j])]
        agree = sum(both) / len(both) if both else None
        return (2.0 if min(low[i], low[j]) < 0.25 else 0.25) if agree is None else 0.02 * (1 - agree) if agree >= 0.65 else 50.0

    near = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2)) < 0.4
    want = {(i, j): apart(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if near[i, j]}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) > 2000 and all(abs(d - want[a, b]) < 1e-12 for a, b, d in got)
    listed = spark.createDataFrame(list(want), "a long, b long")
    assert sorted(got) == sorted(map(tuple, features.superpoint_distances(stats, seen, pairs=listed).collect()))


def test_copies_meet_in_few_blocks_and_by_handfuls(spark, monkeypatch):
    """Blocks of 256 points before: twelve for 3,000 copies, so 144 pairs of them were dealt; 10 points of their own are one block, too."""
    kept, real = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df, name="cut": kept.append(real(df, name)) or kept[-1])
    points = spark.range(3010).select(F.lit("a").alias("uid"), F.col("id").alias("vid"), *[F.when(F.col("id") < 3000, 0.5).otherwise(20.0 + F.col("id") % 10 / 100).alias(c) for c in "xyz"])
    assert spatial.radius_join(points, points, 1.0).count() == 3000 * 3000 + 100
    blocks = kept[0]
    assert blocks.count() <= 4 and blocks.where("_c0 >= 20").count() == 1
    sizes = blocks.select("_c0", spatial._handfuls("_spots", "_n").alias("h")).selectExpr("_c0", "aggregate(h, 0, (t, s) -> t + size(s._vids)) AS n").toPandas()
    assert sizes[sizes._c0 < 20].n.max() < 200 and sizes[sizes._c0 >= 20].n.max() <= spatial.HANDFUL and sizes.n.sum() == 3010
