"""Spatial, clustering, metric and refinement operators against brute force and the fixtures."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phyllo.operators import aggregates, clustering, components, features, filters, fusion, images, metrics, phenotype, refine, spatial, views
from phyllo.plans import pipelines

POINT = "uid string, vid long, x double, y double, z double"


def cloud(spark, xyz, uid="a"):
    return spark.createDataFrame([(uid, i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def random_cloud(n, seed, far=20):
    r = np.random.default_rng(seed)
    p = np.round(np.concatenate([r.normal(size=(n, 3)), r.normal(size=(n // 8, 3)) * far]), 2)
    p[:5] = p[5:10]  # repeated points
    return p


def dist(p):
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(500, 500), (None, 3)]
    up = {n: n for e in edges for n in e if None not in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: top(n) for n in up}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("k,drop", [(4, True), (3, False)])
def test_knn(spark, k, drop):
    p = random_cloud(120, 2)
    d = dist(p)
    got = {}
    for x in spatial.knn_join(cloud(spark, p), cloud(spark, p), k, drop_self=drop).collect():
        got.setdefault(x["src"], []).append((x["rank"], x["dst"], x["d"]))
    for i in range(len(p)):
        want = sorted((d[i, j], j) for j in range(len(p)) if j != i or not drop)[:k]
        assert [w[1] for w in want] == [g[1] for g in sorted(got[i])]


def test_knn_of_few_points_and_no_keys(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (5, 5, 5)])
    assert spatial.knn_join(p, p, 10, drop_self=True).count() == 6
    assert spatial.knn_join(p, p, 1, (), drop_self=True).count() == 3
    assert spatial.knn_join(p, p.limit(0), 1).count() == 0


def test_radius(spark):
    p = random_cloud(150, 3, 3)
    want = {(i, j) for i, j in zip(*np.nonzero(dist(p) <= 0.5), strict=True)}
    assert {(x["src"], x["dst"]) for x in spatial.radius_join(cloud(spark, p), cloud(spark, p), 0.5).collect()} == want
    assert spatial.close_pairs(cloud(spark, p), 0.5, ("uid",)).count() == sum(1 for i, j in want if i < j and dist(p)[i, j] < 0.5)


def test_nearest_and_labels(spark):
    a, b = cloud(spark, [(0, 0, 0), (10, 0, 0), (3, 0, 0)]), cloud(spark, [(1, 0, 0), (4, 0, 0)]).withColumn("label", F.col("vid") + 5)
    got = {r["vid"]: (r["near_vid"], r["d"], r["label"]) for r in spatial.transfer_labels(a, b, max_distance=2.0).collect()}
    assert got == {0: (0, 1.0, 5), 1: (None, float("inf"), 0), 2: (1, 1.0, 6)}
    far = {r["vid"]: r["near_vid"] for r in spatial.match_within(a, b, 6.0).collect()}
    assert far == {0: 0, 1: 1, 2: 1}
    assert {r["near_vid"] for r in spatial.match_within(a, b, -1.0).collect()} == {None}


def test_quantised_match(spark):
    full = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)])
    part = cloud(spark, [(2, 0, 0), (0, 0, 0)])
    matched, counts = spatial.quantised_match(full, part)
    assert [r["matched"] for r in matched.sort("vid").collect()] == [True, False, True, False]
    assert counts.first().asDict() == {"uid": "a", "full": 4, "part": 2, "matched": 2, "unmatched": 0, "duplicate_full_keys": 0, "duplicate_part_hits": 0}


def test_ray_and_centroids(spark):
    p = cloud(spark, [(0, 0, 5), (0.01, 0, 2), (0.001, 0, 8)])
    assert spatial.pick_on_ray(p, (0, 0, 0), (0, 0, 1)).first()["vid"] == 0
    s = spark.createDataFrame([("a", 1, 9, 0.0, 0.0, 0.0)], "uid string, label int, part long, x double, y double, z double")
    big = spark.createDataFrame([("a", 1, 1, 5.0, 0.0, 0.0), ("a", 1, 2, 1.0, 0.0, 0.0), ("a", 2, 3, 0.0, 0.0, 0.0)], s.schema)
    assert spatial.nearest_centroid(s, big, "label").first()["near_part"] == 2


GRID = [(i * 0.01, j * 0.01, 0.0) for i in range(4) for j in range(4)] + [(1, 1, 1), (1.01, 1, 1), (5, 5, 5)]


def test_outlier_removal_then_clusters(spark):
    got = clustering.plant_keep(cloud(spark, GRID), 4, 3.0, 0.05, 3, 4).sort("vid").collect()
    assert [r["keep"] for r in got] == [True] * 16 + [False] * 3


def _dbscan(p, eps, least):
    near = dist(p) <= eps
    core = near.sum(1) >= least
    label, found = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            label[i], stack = found, [i]
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if label[j] < 0:
                        label[j] = found
                        if core[j]:
                            stack.append(j)
            found += 1
    return label, core


@pytest.mark.parametrize("seed", [5, 6])
def test_dbscan(spark, seed):
    p = random_cloud(120, seed, 3)
    label, core = _dbscan(p, 0.6, 5)
    got = clustering.dbscan(cloud(spark, p), 0.6, 5).sort("vid").collect()
    assert [r["label"] for r in got] == label.tolist() and [r["is_core"] for r in got] == core.tolist()
    ratio = metrics.main_component_ratio(cloud(spark, p)).first()["main_component_ratio"]
    box = p.max(0) - p.min(0)
    label, _ = _dbscan(p, max(0.02 * np.sqrt((box**2).sum()), 1e-6), 10)
    assert ratio == pytest.approx((np.bincount(label[label >= 0]).max() if (label >= 0).any() else 0) / len(p))


def test_cloud_metrics(spark):
    p = random_cloud(100, 7, 3)
    d = np.sort(dist(p), axis=1)
    score = d[:, 1:17].mean(1)
    med = np.median(score)
    mad = np.median(np.abs(score - med))
    got = metrics.geometry_metrics(cloud(spark, p)).first()
    assert got["outlier_ratio"] == pytest.approx((score > med + 3 * mad).mean()) and got["point_count"] == len(p)
    thick = [np.sqrt(max(np.linalg.eigvalsh(np.cov(p[np.argsort(row, kind="stable")[:16]].T))[0], 0)) for row in dist(p)]
    assert got["local_thickness_median"] == pytest.approx(np.median(thick), rel=1e-6)
    assert got["bbox_volume"] == pytest.approx(np.prod(p.max(0) - p.min(0)))
    few = metrics.geometry_metrics(cloud(spark, p[:3])).first()
    assert few["outlier_ratio"] == 0 and np.isnan(few["local_thickness_median"])
    assert clustering.point_spacing(cloud(spark, p)).first()["spacing"] == pytest.approx(np.median(d[:, 8]))
    assert clustering.auto_eps(cloud(spark, p), 2.0).first()["eps"] == pytest.approx(2 * np.median(d[:, 1:9]))
    assert clustering.auto_eps(cloud(spark, p[:4]), 2.0).first()["eps"] == 1e-6


def test_sor_std_and_denoise(spark):
    p = random_cloud(100, 8, 30)
    score = np.sort(dist(p), axis=1)[:, 1:9].mean(1)
    kept = {r["vid"] for r in clustering.sor_std(cloud(spark, p), 8, 1.0).collect()}
    assert kept == set(np.flatnonzero(score <= score.mean() + score.std()).tolist())
    assert 0 < pipelines.denoise_cloud(cloud(spark, p), most=1000).count() <= len(kept) + 30


def test_components_of_labels(spark):
    line = [(i * 0.01, 0, 0) for i in range(30)] + [(5 + i * 0.01, 0, 0) for i in range(10)] + [(9, 0, 0)]
    df = cloud(spark, line).withColumn("label", F.lit(1))
    big = clustering.largest_component(df, 0.03, least=5).sort("vid").collect()
    assert [r["label"] for r in big] == [1] * 30 + [0] * 11
    parts = clustering.split_labels(df, 0.03, 10).sort("vid").collect()
    assert [r["label"] for r in parts] == [1] * 30 + [2] * 11
    scan = clustering.scan_components(df, 0.03, 4, ordered=True).sort("vid").collect()
    assert [r["part"] for r in scan] == [0] * 30 + [30] * 10 + [40]
    assert clustering.prompt_component(df, (5.2, 0, 0), 0.03).count() == 10


def test_filters(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i % 7), 0.0, float(i)) for i in range(100)] + [("a", 100, float("nan"), 0.0, 0.0, 1.0)], POINT + ", opacity double")
    fine = filters.finite_rows(df)
    assert fine.count() == 100 and filters.above_quantile(fine, q=0.35).count() == 65
    assert filters.crop_box(fine, 0.05, 0.95).count() == 90
    votes = spark.createDataFrame([(1, 3, 2), (2, 3, 1), (3, 2, 2)], "vid long, visible long, foreground long")
    assert [r["vid"] for r in filters.vote_filter(votes).collect()] == [1]
    full = cloud(spark, [(i, 0, 0) for i in range(5)])
    plant, kept = full.where("vid in (2, 3, 4)"), full.where("vid in (2, 4)")
    assert sorted(r["vid"] for r in filters.reject_plant_points(full, plant, kept).collect()) == [0, 1, 2, 4]
    names = spark.createDataFrame([(f"{i:03d}.png",) for i in range(10)], "name string")
    assert [r["name"] for r in filters.holdout_split(names, 4).where("is_test").sort("name").collect()] == ["000.png", "004.png", "008.png"]
    ev = spark.createDataFrame([(3, 100), (1, 3), (0, 0), (1, 4)], "hit_count int, view_count int")
    assert [r[0] for r in ev.select(filters.evidence()).collect()] == [True, True, False, False]
    sized = spark.createDataFrame([("a", 1, i) for i in range(5)] + [("a", 2, 0)], "uid string, mask_id int, vid int")
    assert [r["mask_id"] for r in filters.masks_of_size(sized, spark.createDataFrame([("a", 10)], "uid string, n_points int"), 2, 0.5).collect()] == [1]
    small = spark.createDataFrame([("a", 1)] * 3 + [("a", 2)], "uid string, label int")
    assert sorted(r["label"] for r in filters.drop_small_labels(small, 3).collect()) == [0, 1, 1, 1]
    assert sorted(r["label"] for r in filters.drop_small_labels(small, 3, strict=True).collect()) == [0] * 4


def test_aggregates(spark):
    p = random_cloud(80, 9, 2)
    df = cloud(spark, p).withColumn("opacity", F.col("x") * 0 + F.col("vid") % 5)
    keys = np.floor((p - p.min(0)) / 1.0).astype(int)
    best = {}
    for i, k in enumerate(map(tuple, keys)):
        best[k] = min(best.get(k, (1, 1)), (-(i % 5), i))
    assert {r["vid"] for r in aggregates.voxel_top1(df, 1.0).collect()} == {i for _, i in best.values()}
    assert aggregates.voxel_downsample(df, 1.0).count() == len(best) and aggregates.voxel_downsample(df, 0).count() == len(p)
    assert 0 < aggregates.adaptive_thin(df, 20).count() <= 20
    r = np.random.default_rng(9)
    many = [(uid, i, *map(float, r.normal(size=3) * size), float(r.integers(0, 50))) for uid, n, size in (("big", 400, 5), ("dense", 300, 0.01), ("few", 15, 1), ("edge", 20, 1)) for i in range(n)]
    clouds = spark.createDataFrame(many, POINT + ", opacity double").repartition(3)
    both = {(x["uid"], x["vid"]) for x in aggregates.adaptive_thin(clouds, 20).collect()}
    alone = {(x["uid"], x["vid"]) for u in ("big", "dense", "few", "edge") for x in aggregates.adaptive_thin(clouds.where(F.col("uid") == u), 20).collect()}
    assert both == alone and sum(u == "few" for u, _ in both) == 15 and all(0 < sum(u == c for u, _ in both) <= 20 for c in ("big", "dense", "edge"))
    assert aggregates.adaptive_thin(clouds.where("uid = 'big'").drop("uid"), 20, keys=()).count() <= 20
    assert aggregates.bounding_box(df.limit(0), ()).first()["bbox_volume"] == 0
    picked = sorted(r["vid"] for r in aggregates.sample_rows(df, 10, 3).collect())
    assert picked == sorted(np.random.default_rng(3).choice(len(p), 10, replace=False).tolist())
    shuffled = spark.range(1000).select((F.col("id") * 7919 % 1000 * 3).alias("k")).repartition(7)
    assert all(r["position"] * 3 == r["k"] for r in aggregates.numbered(shuffled, "k").collect())
    rows = spark.createDataFrame([("a", 1.0, "x", None), ("b", 3.0, "2", 4.0)], "uid string, m double, t string, n double")
    assert [tuple(r) for r in aggregates.mean_row(rows).where("uid = 'MEAN'").collect()] == [("MEAN", "2.0", "", "")]
    labels = spark.createDataFrame([("a", i, v) for i, v in enumerate([0] * 200 + [1] * 50 + [2] + [-1] * 20)] + [("b", 0, -1)], "uid string, vid int, label int")
    kept = aggregates.largest_clusters(labels)
    assert kept.groupBy("uid", "label").count().count() == 3 and kept.where("uid = 'b'").count() == 1
    status = spark.createDataFrame([("a", "e1", "e2"), ("a", None, None), (None, "", None)], "ply string, x string, y string")
    assert [tuple(r)[-2:] for r in aggregates.run_status(status, ["ply"], ["x", "y"]).select("errors", "status").collect()] == [("e1; e2", "failed"), ("", "ok"), ("", "pending")]
    scores = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.7)], "k int, score double")
    assert aggregates.best_k(scores).first()["best_k"] == 3
    assert aggregates.mask_union(scores, scores).count() == 3 and aggregates.mask_intersection(scores, scores.limit(1)).count() == 1


def test_segmentation_metrics(spark):
    r = np.random.default_rng(4)
    gt, pred = r.integers(0, 5, 300), r.integers(0, 6, 300)
    pred = np.where(r.random(300) < 0.8, gt, pred)
    df = spark.createDataFrame([("a", int(g), int(q)) for g, q in zip(gt, pred, strict=True)], "uid string, gt long, pred long")
    extra = spark.createDataFrame([("a", 2), ("a", 9)], "uid string, pred long")
    iou = {}
    allpred = np.append(pred, [2, 9])
    for g, q in itertools.product(range(1, 5), sorted(set(allpred[allpred > 0]))):
        n = ((gt == g) & (pred == q)).sum()
        iou[g, q] = n / ((gt == g).sum() + (allpred == q).sum() - n)
    got = {(x["gt"], x["pred"]): x["iou"] for x in metrics.iou_matrix(df, extra=extra).collect()}
    assert got == pytest.approx(iou)
    leaf = {q for (g, q), v in iou.items() if v >= 0.1}
    g1, p1 = np.append(gt, [0, 0]) > 0, np.isin(allpred, list(leaf))
    sem = metrics.semantic_metrics(df, extra=extra).first()
    assert (sem["tp"], sem["fp"], sem["fn"], sem["tn"]) == ((g1 & p1).sum(), (~g1 & p1).sum(), (g1 & ~p1).sum(), (~g1 & ~p1).sum())
    ids = sorted(leaf)
    best = max((sum(iou[g, q] for g, q in zip(range(1, 5), order, strict=False)), order) for order in itertools.permutations(ids, min(4, len(ids)))) if len(ids) >= 4 else None
    inst = metrics.instance_metrics(df, extra=extra).first()
    if best:
        tp = sum(iou[g, q] >= 0.5 for g, q in zip(range(1, 5), best[1], strict=False))
        assert inst["f1_50"] == pytest.approx(2 * tp / (4 + len(ids)))
        assert inst["pq"] == pytest.approx(sum(v for g, q in zip(range(1, 5), best[1], strict=False) if (v := iou[g, q]) >= 0.5) / ((4 + len(ids)) / 2))
    same = metrics.adjusted_rand(df.withColumn("pred", F.col("gt"))).first()["ari"]
    assert same == 1 and 0 < metrics.leaf_rand(df, extra=extra).first()["ari"] < 1
    assert metrics.matrix_csv(metrics.iou_matrix(df)).count() == 4


def test_hungarian_against_all_orders():
    r = np.random.default_rng(0)
    for _ in range(100):
        n, m = (int(v) for v in r.integers(1, 6, 2))
        cost = -np.round(r.random((n, m)), 2)
        pairs = metrics.hungarian(cost)
        small = cost if n <= m else cost.T
        want = min(sum(small[i, o[i]] for i in range(len(small))) for o in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(want) and len(pairs) == min(n, m)


def test_refinement(spark):
    labels = spark.createDataFrame([("a", i, v) for i, v in enumerate((1, 1, 1, 2, 2, 0))], "uid string, vid long, label int")
    edges = spark.createDataFrame([("a", i, j, 1.0, r) for i in range(6) for r, j in enumerate([x for x in range(6) if x != i], 1)], "uid string, src long, dst long, d double, rank int")
    adj = refine.label_edges(labels, edges).collect()
    assert [(r["a"], r["b"], r["n"]) for r in adj] == [(1, 2, 12)]
    assert {r["label"] for r in refine.merge_adjacent(labels, edges, 0.5, 5).collect()} == {0, 1}
    assert {r["label"] for r in refine.merge_adjacent(labels, edges, 99, 5).collect()} == {0, 1, 2}
    assert [r["label"] for r in refine.smooth_once(labels, edges, 3).sort("vid").collect()] == [1, 1, 1, 1, 1, 1]  # ties go to the nearest
    two = np.concatenate([np.random.default_rng(1).normal(size=(40, 3)) * 0.1, np.random.default_rng(2).normal(size=(40, 3)) * 0.1 + 5])
    df = cloud(spark, two).withColumn("label", F.when(F.col("vid") < 40, 4).otherwise(9)).withColumn("label", F.when(F.col("vid") % 13 == 0, 0).otherwise(F.col("label")))
    out = refine.refine_instances(df, 8, 5, 0.9, 100, 1, 3).sort("vid").collect()
    assert [r["label"] for r in out] == [1] * 40 + [2] * 40


def test_masks(spark):
    cells = spark.createDataFrame([("a", m, v) for m, vs in ((0, range(10)), (1, range(1, 10)), (2, range(20, 25))) for v in vs], "uid string, mask_id int, vid int")
    scores = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.1)], "uid string, mask_id int, score double")
    assert [(r["mask_id"], r["rank"]) for r in refine.nms_masks(cells, scores, 0.5).sort("rank").collect()] == [(1, 0), (2, 1)]
    votes = spark.createDataFrame([("a", 1, 0, 0.5), ("a", 1, 1, 0.9), ("a", 1, 2, 0.9)], "uid string, vid int, rank int, score double")
    assert refine.assign_instances(votes).first()["instance_id"] == 2 and refine.assign_instances(votes, "order").first()["instance_id"] == 1
    clicks = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("a", 2, 3)], "uid string, vid int, click int")
    assert {m: [r["instance_id"] for r in refine.merge_clicks(clicks, m).sort("vid").collect()] for m in ("later", "earlier", "background")} == {"later": [2, 3], "earlier": [1, 1], "background": [0, 3]}
    cand = spark.createDataFrame([(1, 1, 0, 0.9, 100, 5), (1, 1, 1, 0.1, 50, 40), (1, 2, 0, 0.2, 10, 0), (1, 2, 1, 0.3, 10, 1)], "view_id int, box_id int, mask_id int, score double, n_pixels int, n_green int")
    assert sorted((r["box_id"], r["mask_id"]) for r in refine.choose_masks(cand).collect()) == [(1, 1), (2, 1)]


def test_painting(spark):
    def square(rank, v0, u0, n=5):
        return [(1, rank, v0 + i, u0 + j) for i in range(n) for j in range(n)]

    pixels = spark.createDataFrame(square(0, 0, 0) + square(1, 1, 1) + square(2, 20, 20) + square(3, 40, 40, 3), "view_id int, rank int, v long, u long")
    skeleton = spark.createDataFrame([(1, v, u) for v in range(60) for u in range(60)], "view_id int, v long, u long")
    sizes = spark.createDataFrame([(1, 60, 60)], "view_id int, height int, width int")
    got = refine.paint_leaves(pixels, skeleton, sizes).toPandas()
    assert set(got.leaf_id) == {1, 2} and len(got) == 25 + 9 + 25  # the second square is part of the first leaf
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 100, 100, 111, 110)], "view_id int, box_id int, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r["px"], r["py"]) for r in refine.prompt_points(boxes, skeleton).collect()) == [(4.5, 4.5), (105.0, 105.0)]


def test_features(spark):
    r = np.random.default_rng(3)
    f = np.concatenate([r.normal(size=(20, 4)) * 0.05 + c for c in np.eye(4)[:3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "vid long, feat array<double>")
    k, scores, labelled = features.auto_k(df, 2, 5)
    assert k == 3 and scores.count() == 4 and labelled.select("cluster_id").distinct().count() == 3
    lab = np.repeat([0, 1, 2], 20)
    d = dist(f)
    a = np.array([d[i][(lab == lab[i]) & (np.arange(60) != i)].mean() for i in range(60)])
    b = np.array([min(d[i][lab == c].mean() for c in range(3) if c != lab[i]) for i in range(60)])
    tagged = df.withColumn("label", F.floor(F.col("vid") / 20))
    assert features.silhouette(tagged).first()["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (0, 10, 0)])
    ranks = {x["rank"]: x["vid"] for x in features.farthest_points(pts, 3, 0).collect()}
    assert len(set(ranks.values())) == 3 and {2, 3} & set(ranks.values())


def test_farthest_points_of_more_rows_than_a_sample_holds(spark):
    """The farthest point of a large cloud is one row among all; before, a sample of 20,000 rows was searched."""
    rows = spark.range(30_000).select(F.lit("a").alias("uid"), F.col("id").alias("vid"), *[F.when(F.col("id") == 29_000 + i, 50.0).otherwise((F.col("id") * p % 101) / 101).alias(c) for i, (c, p) in enumerate(zip("xyz", (7, 11, 13), strict=True))])
    small = spark.createDataFrame([("b", 5, 1.0, 1.0, 1.0), ("b", 6, 1.0, 1.0, 1.0)], "uid string, vid long, x double, y double, z double")
    got = {(x["uid"], x["rank"]): x["vid"] for x in features.farthest_points(rows.unionByName(small), 4, None).collect()}
    assert {got["a", i] for i in (1, 2, 3)} == {29_000, 29_001, 29_002} and got["a", 0] == 0
    assert [got.get(("b", i)) for i in range(3)] == [5, 5, None]


def test_superpoints(spark):
    stats = spark.createDataFrame([(0, 0.9, 0.0, 0.0, 0.0), (1, 0.9, 0.01, 0.0, 0.0), (2, 0.1, 0.02, 0.0, 0.0), (3, 0.9, 9.0, 0.0, 0.0)], "sp long, confidence double, x double, y double, z double")
    seen = spark.createDataFrame([(0, 1, 5), (1, 1, 5), (2, 2, 7), (3, 1, 5)], "sp long, view_id int, label int")
    d = {(r["a"], r["b"]): r["distance"] for r in features.superpoint_distances(stats, seen).collect()}
    assert d[0, 1] == 0 and d[0, 2] == 2.0 and d[1, 3] == 0
    got = {r["sp"]: r["cluster"] for r in features.agglomerate(stats, features.superpoint_distances(stats, seen)).collect()}
    assert got[0] == got[1] != got[2] and got[3] not in (got[0], got[2])


def test_superpoint_pairs_are_not_dealt_by_views(spark, monkeypatch):
    """Pairs were written, then met once for every view of both; rows without a view or label count nothing."""
    written, real = [], features.cut
    monkeypatch.setattr(features, "cut", lambda df, name="cut": written.append(name) or real(df, name))
    stats = spark.createDataFrame([(0, 0.9), (1, 0.9), (2, 0.1), (3, 0.9)], "sp long, confidence double")
    seen = spark.createDataFrame([(s, v, s * v % 3 if s < 2 else 1) for s in range(3) for v in range(9)] + [(0, None, 1), (3, 4, None)], "sp long, view_id int, label int")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 3)], "a long, b long")
    got = sorted(tuple(r) for r in features.superpoint_distances(stats, seen, pairs=pairs).collect())
    assert got == [(0, 1, 50.0), (0, 2, 50.0), (0, 3, 0.25)] and written == ["superpoint-seen"]


def test_fusion(spark):
    schema = POINT + ", opacity float, rot_0 float, rot_1 float, rot_2 float, rot_3 float"
    main = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0), ("a", 1, 10.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0)], schema)
    fill = spark.createDataFrame([("a", 0, 0.1, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0), ("a", 1, 20.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0)], schema)
    out, counts = fusion.fuse(main, fill, 1.0, 0.5, 10, 7)
    assert sorted((r["source"], r["source_index"], r["opacity"]) for r in out.collect()) == [("gof", 1, 2.0), ("radegs", 0, 1.0), ("radegs", 1, 1.0)]
    assert counts == {"kept": 2, "added": 1, "nonfinite_opacity_replaced": 0}
    bad = fill.withColumn("opacity", F.when(F.col("vid") == 1, F.lit(float("inf"))).otherwise(F.col("opacity")).cast("float"))
    out, counts = fusion.fuse(main.where("vid = 0"), bad, 1.0, 0.5, 10, 7)
    assert counts["nonfinite_opacity_replaced"] == 1 and all(np.isfinite(r["opacity"]) for r in out.collect())
    assert fusion.fuse(main.limit(0), fill)[1]["added"] == 2 and fusion.fuse(main, fill, 1.0, 0.0, 0)[1]["added"] == 0
    with pytest.raises(ValueError):
        fusion.fuse(main, fill.drop("opacity"))


def _view(spark):
    im = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "a.png", [(float(i), float(2 * i), 1) for i in range(50)] + [(900.0, 900.0, -1)])], "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x: double, y: double, point3d_id: bigint>>")
    cam = spark.createDataFrame([(1, 1, 100, 120, [10.0, 10.0, 50.0, 60.0])], "camera_id int, model_id int, width long, height long, params array<double>")
    return im, cam


def test_views(spark):
    im, cam = _view(spark)
    view = views.views(im, cam)
    pts = cloud(spark, [(0, 0, 1), (0, 0, 2), (0.1, 0, 1), (0, 0, -1), (1000, 0, 1)]).withColumns({c: F.lit(v) for c, v in (("red", 10), ("green", 20), ("blue", 30))})
    hits = views.project_points(pts, view)
    assert sorted((r["vid"], r["u"], r["v"]) for r in hits.collect()) == [(0, 50, 60), (1, 50, 60), (2, 51, 60)]
    mask = spark.createDataFrame([(1, 60, 50, 7)], "view_id int, v long, u long, val int")
    votes = {r["vid"]: (r["visible"], r["foreground"]) for r in views.foreground_votes(hits, mask).collect()}
    assert votes == {0: (1, 1), 1: (1, 1), 2: (1, 0)}
    counts, labels = views.instance_votes(hits, mask)
    assert {r["vid"]: (r["view_count"], r["hit_count"]) for r in counts.collect()} == {0: (1, 1), 1: (1, 0), 2: (1, 0)} and labels.count() == 1
    pixels = spark.createDataFrame([(1, 60, 50, 100, 101, 102)], "view_id int, v long, u long, red int, green int, blue int")
    assert {r["vid"]: r["red"] for r in views.colourise(pts, hits, pixels).collect()} == {0: 100, 1: 100, 2: 180, 3: 180, 4: 180}
    canvas, written = views.render(pts, hits, view, 1)
    assert canvas.count() == 8 and {(r["v"], r["u"]): r["depth"] for r in canvas.collect()}[60, 50] == 1 and written.first()["hit_count"] >= 8
    names = spark.createDataFrame([("/m/A_mask.png",)], "path string")
    assert views.masks_of_images(im, names).first()["image_id"] == 1 and views.masks_of_images(im, names, "contains").count() == 1


def test_crops(spark):
    im, cam = _view(spark)
    sized = im.withColumns({"width": F.lit(100), "height": F.lit(120)})
    crop = views.roi_crop(sized, 1.0, 0.0, 30, 10)
    x = np.arange(50)
    lo, hi = np.percentile(x, 1), np.percentile(x, 99)
    got = crop.first()
    assert (got["left"], got["top"], got["right"], got["bottom"], got["valid_points"]) == (int(np.floor(lo)), int(np.floor(2 * lo)), int(np.ceil(hi)), int(np.ceil(2 * hi)), 50)
    with pytest.raises(Exception, match="no crop"):
        views.roi_crop(sized, least_points=60).collect()
    green = spark.createDataFrame([(1, None, None, None, None, "too small")], "image_id int, left long, top long, right long, bottom long, reason string")
    chosen = views.roi_driver(green, crop)
    assert (chosen.first()["crop_driver"], chosen.first()["fallback_reason"], chosen.first()["left"]) == ("colmap", "too small", got["left"])
    ims, cams, manifest = views.shift_to_crop(im, cam, chosen)
    assert ims.first()["points2d"][5]["x"] == 5 - got["left"] and cams.first()["params"] == [10.0, 10.0, 50.0 - got["left"], 60.0 - got["top"]] and manifest.first()["new_camera_id"] == 1
    assert len(filters.valid_observations(im).first()["points2d"]) == 50


def test_images(spark):
    rgb = np.full((100, 120, 3), 200, np.uint8)
    rgb[30:70, 40:90] = (40, 160, 40)
    box, reason = images.green_crop(rgb, margin=0.0, least_size=10)
    assert reason == "" and box == (33, 23, 97, 77)
    assert images.green_crop(np.full((50, 50, 3), 200, np.uint8))[0] is None
    df = spark.createDataFrame([(1, "a", 100, 120, bytearray(rgb.tobytes()))], "image_id long, name string, height int, width int, pixels binary")
    assert images.green_crops(df, margin=0.0, least_size=10).first()["right"] == 97
    assert images.edge_metrics(df).first()["render_edge_strength"] > 0 and images.sharp_frames(df, 1.0).count() == 1
    assert images.ssim_by_name(df, df).first()["ssim"] == pytest.approx(1)
    px = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.1)], "image_id int, render double, gt double")
    assert {r["image_id"]: r["psnr"] for r in images.psnr(px).collect()} == pytest.approx({1: 100, 2: 20})
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)
    assert images.components8(mask).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 0], [2, 2, 0]]


def test_phenotype(spark):
    flat = [(i * 0.1, j * 0.1, 0.0) for i in range(40) for j in range(10)]
    df = cloud(spark, flat).withColumn("instance_id", F.lit(1))
    leaf = phenotype.leaf_parameters(df, 0.1).first()
    assert leaf["length"] == pytest.approx(3.9, abs=1e-6) and leaf["width"] == pytest.approx(0.9, abs=1e-6) and leaf["inclination"] == pytest.approx(0, abs=1e-6)
    assert leaf["area"] == pytest.approx(4.0, rel=0.1) and abs(leaf["a0"]) == pytest.approx(1)
    r = np.random.default_rng(5)
    p = r.normal(size=(60, 3)) * [3, 2, 1] @ np.linalg.qr(r.normal(size=(3, 3)))[0]
    axes = phenotype.principal_axes(cloud(spark, p), ("uid",)).first()
    values, vecs = np.linalg.eigh(np.cov(p.T, bias=True))
    assert [axes[f"l{i}"] for i in (3, 2, 1)] == pytest.approx(values.tolist())
    assert abs(np.dot([axes[f"a{k}"] for k in range(3)], vecs[:, 2])) == pytest.approx(1, abs=1e-6)
    assert phenotype.plant_size(df).first()["height"] == 0 and phenotype.drop_stems(phenotype.leaf_parameters(df, 0.1), 2.0).count() == 0
    summary = phenotype.plant_summary(phenotype.leaf_parameters(df, 0.1), phenotype.plant_size(df)).first()
    assert summary["instance_count"] == 1 and summary["mean_length"] == pytest.approx(3.9)
    err = spark.range(1).select(phenotype.relative_error(F.lit(90043.25), F.lit(46148.09)), phenotype.relative_error(F.lit(52770.20), F.lit(46148.09))).first()
    assert [round(100 * e, 2) for e in err] == [95.12, 14.35]


def test_evaluation_flow(spark):
    src = cloud(spark, [(i, 0, 0) for i in range(12)])
    gt = src.withColumn("gt", F.when(F.col("vid") < 5, 1).when(F.col("vid") < 10, 2).otherwise(0))
    pred = src.select("uid", "vid", F.when(F.col("vid") < 5, 0).otherwise(1).alias("label0"))
    rows = {r["uid"]: r.asDict() for r in pipelines.evaluate(gt, src, pred, 0.5).collect()}
    assert rows["a"]["tp"] == rows["MEAN"]["tp"].split(".")[0] == "10" and float(rows["a"]["leaf_iou"]) == pytest.approx(10 / 12)
    assert float(rows["a"]["f1_50"]) == 1.0 and float(rows["a"]["match_rate"]) == 1.0


def test_leaf_instance_flow(spark):
    im, cam = _view(spark)
    r = np.random.default_rng(6)
    p = np.concatenate([r.normal(size=(200, 3)) * 0.005 + c for c in ((-0.5, 0, 1), (0.5, 0, 1))])
    pts = cloud(spark, p)
    view = views.views(im, cam)
    hits = views.project_points(pts, view, "trunc")
    mask = hits.select("view_id", "v", "u", F.when(F.col("u") < 50, 1).otherwise(2).alias("val")).distinct()
    out = pipelines.leaf_instances(pts, view, mask, 6, 20, 0.03).toPandas()
    seen = out[out.label > 0]
    left = seen.vid < 200
    assert len(seen) and set(seen[left].label).isdisjoint(seen[~left].label)
    assert pipelines.clean_cloud(pts.withColumn("opacity", F.rand(1)), most=50).count() <= 50
    masks = hits.select("view_id", "v", "u", F.lit(1).alias("val")).distinct()
    assert pipelines.foreground_from_masks(pts, view, masks).count() == 0  # one view is too few
    assert isinstance(out, pd.DataFrame)
