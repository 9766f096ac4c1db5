"""Mini-batch k-means against full passes and plain steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllo.operators import features, kmeans


def _frame(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vid long, feat array<double>").repartition(4)


def test_searches_equal_scans_and_skip_far_centres():
    r = np.random.default_rng(1)
    for width in (1, 3, 12):
        centres = kmeans.Centres(np.concatenate([r.normal(size=(540, width)) * 5, np.zeros((10, width))]), np.zeros(550))
        points = np.concatenate([r.normal(size=(3000, width)) * 5, np.zeros((5, width))])
        place, least = centres.nearest(points)
        d = kmeans.squared(points, centres.values)
        assert (place == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and place[-1] == 540
        if width <= 3:
            assert centres.looked < 0.4 * d.size
    same = kmeans.Centres(np.ones((7, 2)), np.zeros(7))
    assert same.nearest(np.zeros((4, 2)))[0].tolist() == [0] * 4 and len(same.nearest(np.zeros((0, 2)))[0]) == 0


def test_a_step_moves_centres_by_counts(spark):
    r = np.random.default_rng(2)
    points, values, counts = r.normal(size=(500, 4)), r.normal(size=(9, 4)), np.arange(9.0)
    moved, error = kmeans.step(_frame(spark, points), kmeans.Centres(values, counts))
    d = ((points[:, None] - values) ** 2).sum(axis=2)
    home = d.argmin(axis=1)
    for c in range(9):
        n = (home == c).sum()
        want = (counts[c] * values[c] + points[home == c].sum(axis=0)) / (counts[c] + n) if n else values[c]
        assert moved.values[c] == pytest.approx(want) and moved.counts[c] == counts[c] + n
    assert error == pytest.approx(d.min(axis=1).sum())


def test_mini_batches_come_near_full_passes_at_550(spark):
    r = np.random.default_rng(3)
    df = _frame(spark, np.concatenate([r.random((9000, 3)) * (4, 2, 1), r.normal(size=(3000, 3)) * 0.1 + 2])).cache()
    centres = kmeans.fit(df, 550, batch_rows=3000, steps=40)
    full = features.kmeans_labels(df, 550, normalise=False)
    means = np.array([[x[f"m{i}"] for i in range(3)] for x in full.groupBy("cluster_id").agg(*[F.avg(F.col("feat")[i]).alias(f"m{i}") for i in range(3)]).collect()])
    assert kmeans.error(df, centres) <= 1.05 * kmeans.error(df, kmeans.Centres(means, np.zeros(len(means))))
    again = kmeans.fit(df.repartition(7), 550, batch_rows=3000, steps=2)
    assert again.values == pytest.approx(kmeans.fit(df, 550, batch_rows=3000, steps=2).values)


def test_labels_of_odd_rows(spark):
    rows = [(i, [float(i % 3) * 10, 0.0]) for i in range(90)] + [(90, None), (91, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vid long, feat array<double>").withColumn("cluster_id", F.lit("old"))
    got = features.minibatch_labels(df, 3, normalise=False, batch_rows=50, steps=10).collect()
    assert {r["vid"]: r["cluster_id"] for r in got}[90] is None and len(got) == 92
    homes = {r["vid"]: r["cluster_id"] for r in got if r["vid"] < 90}
    assert len(set(homes.values())) == 3 and all(homes[i] == homes[i % 3] for i in homes)
    assert kmeans.fit(df.where("vid < 2"), 4, steps=2).values.shape == (4, 2)
    with pytest.raises(ValueError):
        kmeans.fit(df.limit(0), 3)
    cloud = spark.createDataFrame([(i, float(i % 5), 0.0, 1.0) for i in range(100)], "vid long, x double, y double, z double")
    assert features.superpoints(cloud, 5, minibatch=True).select("sp").distinct().count() == 5
