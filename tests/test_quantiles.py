"""Exact quantiles by narrowing down, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phyllo.operators import aggregates, quantiles

QS = [0.0, 0.005, 0.35, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("keys", [("uid",), ()])
def test_quantiles_of_crowded_groups(spark, keys):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(size=3000), "b": r.integers(0, 5, 2500).astype(float), "c": r.exponential(size=900) ** 6, "d": np.full(700, 2.5), "e": np.array([1.0, 4.0]), None: r.normal(size=40)}
    rows = pd.DataFrame([(k, v) for k, vs in groups.items() for v in vs], columns=["uid", "v"])
    df = spark.createDataFrame(rows, "uid string, v double").unionByName(spark.createDataFrame([("a", None), ("f", None)], "uid string, v double")).repartition(3)
    got = quantiles.group_quantiles(df, {"q": (F.col("v"), QS), "half": (-F.col("v"), [0.5])}, keys, most=100).collect()
    if not keys:
        assert got[0]["q"] == pytest.approx(np.quantile(rows["v"], QS)) and got[0]["half"] == pytest.approx([-rows["v"].median()])
        return
    assert {x["uid"] for x in got} == {*groups, "f"}
    for x in got:
        if x["uid"] == "f":
            assert x["q"] is None
        else:
            assert x["q"] == pytest.approx(np.quantile(groups[x["uid"]], QS)) and x["half"] == pytest.approx([-np.median(groups[x["uid"]])])


def test_quantiles_beside_rows(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(201)] + [(None, 7.0)], "uid string, v double")
    got = quantiles.with_quantiles(df, {"q": (F.col("v"), [0.5])}, most=20).groupBy("uid").agg(F.first("q").alias("q"), F.count("q").alias("n")).collect()
    assert {x["uid"]: (x["q"], x["n"]) for x in got} == {"a": ([100.0], 201), None: ([7.0], 1)}
    stats = {x["uid"]: (x["median"], x["mad"], x["n"]) for x in aggregates.mad_stats(df, "v").collect()}
    assert stats == {"a": (100.0, 50.0, 201), None: (7.0, 0.0, 1)}


@pytest.mark.parametrize("odd", [[float("nan")], [float("inf")] * 7, [float("-inf")] * 9, [float("nan"), float("inf"), float("-inf")] * 5, [1.7e308, -1.7e308, 5e-324, 0.0, -0.0]])
def test_values_that_no_bin_takes(spark, odd):
    """Groups on both sides of the buffer's bound give what Spark's percentile gives, whatever the values."""
    rows = [("a", float(i % 37)) for i in range(100)] + [("a", v) for v in odd] + [("b", v) for v in odd * 20] + [("c", None)] * 30 + [("d", 4.0)] * 30
    df = spark.createDataFrame(rows, "uid string, v double").repartition(3)
    qs = [0.0, 0.03, 0.25, 0.5, 0.77, 0.99, 1.0]
    want = {r["uid"]: r["q"] for r in df.groupBy("uid").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    got = {r["uid"]: r["q"] for r in quantiles.group_quantiles(df, {"q": (F.col("v"), qs)}, most=10).collect()}
    plain = lambda found: {k: v and [repr(x + 0.0) for x in v] for k, v in found.items()}  # noqa: E731  zeros have no sign
    assert plain(got) == plain(want)
