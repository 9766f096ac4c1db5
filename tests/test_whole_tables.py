"""Samples of clouds with gaps."""

import numpy as np
import pytest

from phyllo.operators import aggregates, clustering


def test_sampled_dbscan_draws_from_rows_with_gaps_in_their_ids(spark):
    rows = [("a", i if i < 200 else i + 1000, i * 0.1, 0.0, 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "uid string, vid long, x double, y double, z double")
    assert clustering.sampled_dbscan_filter(df, 2.0, 3, 200).count() == 400


def _plain_dbscan(p, eps, least):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    label, found = np.full(len(p), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], found
        while stack:
            for j in np.flatnonzero((d[stack.pop()] <= eps) & core & (label < 0)):
                label[j] = found
                stack.append(j)
        found += 1
    for i in np.flatnonzero(~core):
        near = label[(d[i] <= eps) & core]
        label[i] = near.min() if len(near) else -1
    return label.tolist(), core.tolist()


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.4), (2, 0.8), (3, 2.0)])
def test_dense_clouds_cluster_as_by_all_pairs(spark, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.uniform(0, 12, (8, 3))
    p = np.concatenate([c + r.normal(0, spread, (60, 3)) for c in centres] + [r.uniform(0, 12, (60, 3)), np.repeat([[20.0, 20.0, 20.0]], 30, axis=0), [[21.0, 20.0, 20.0]]])
    df = spark.createDataFrame([("a", i, *map(float, row)) for i, row in enumerate(p)] + [("b", 0, 0.0, 0.0, 0.0), ("b", 1, float("nan"), 0.0, 0.0)], "uid string, vid long, x double, y double, z double")
    got = clustering.dbscan(df.repartition(3), 1.0, 6).sort("uid", "vid").collect()
    label, core = _plain_dbscan(p, 1.0, 6)
    assert [x["label"] for x in got if x["uid"] == "a"] == label and [x["is_core"] for x in got if x["uid"] == "a"] == core
    assert [x["label"] for x in got if x["uid"] == "b"] == [-1, -1]


def test_dense_cells_that_only_their_nearest_points_join(spark):
    """Two clouds of dense cells, side by side, of which one pair of points alone lies within the reach."""
    r = np.random.default_rng(0)
    left, right = r.uniform(0, 0.5, (200, 3)), r.uniform(0, 0.5, (200, 3)) + [1.45, 0, 0]
    left[:, 0] = np.minimum(left[:, 0], 0.4)
    for bridge, labels in (([[0.4, 0.0, 0.25], [1.4, 0.0, 0.25]], {0}), ([[0.4, 0.0, 0.25], [1.41, 0.0, 0.25]], {0, 1})):
        p = np.concatenate([left, right + [0.05, 0, 0], bridge])
        df = spark.createDataFrame([("a", i, *map(float, row)) for i, row in enumerate(p)], "uid string, vid long, x double, y double, z double")
        got = [x["label"] for x in clustering.dbscan(df, 1.0, 5).sort("vid").collect()]
        assert got == _plain_dbscan(p, 1.0, 5)[0] and set(got) == labels


def test_samples_are_drawn_from_each_cloud_by_place(spark):
    rows = [("a", 60 + 3 * i) for i in range(40)] + [("b", i) for i in range(50)] + [("c", i) for i in range(4)]
    df = spark.createDataFrame(rows, "uid string, vid long").repartition(3)
    got = aggregates.sample_rows(df, 10, 3, keys=("uid",)).collect()
    assert {u: sorted(x["vid"] for x in got if x["uid"] == u) for u in "abc"} == {
        "a": sorted(60 + 3 * int(i) for i in np.random.default_rng(3).choice(40, 10, replace=False)),
        "b": sorted(int(i) for i in np.random.default_rng(3).choice(50, 10, replace=False)),
        "c": [0, 1, 2, 3],
    }
    assert len(aggregates.sample_rows(df, 10, 3).collect()) == 10 and aggregates.sample_rows(df.limit(0), 10, keys=("uid",)).count() == 0
