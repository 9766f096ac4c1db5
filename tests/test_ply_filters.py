"""Filters that the PLY reader decides itself, and the ranges that it skips by them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

from phyllo.sources import ply


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("clouds")
    r = np.random.default_rng(1)
    for stem, n in (("a", 1000), ("b", 130)):
        x = np.sort(r.normal(size=n)).astype(np.float32)
        x[-3:] = np.nan
        rows = [(i, float(x[i]), float(i % 7), i % 200) for i in range(n)]
        df = spark.createDataFrame(rows, "vid long, x float, y float, tag int")
        ply.write_ply(df, f"{path}/{stem}.ply")
    return str(path)


def _filters():
    x, y, v, tag = F.col("x"), F.col("y"), F.col("vid"), F.col("tag")
    return [x > 0.5, x >= -0.25, x < -1.5, (x <= 0) & (v >= 400), v == 77, (v > 900) & (y == 3.0), tag < 5, F.isnan(x), x.isNull(), (x > 0.1) | (v < 3), (F.col("uid") == "b") & (v < 20), x == F.lit(float("nan")), tag.isin(3, 4)]


@pytest.mark.parametrize("ranges", [False, True])
def test_filters_give_the_same_rows_with_and_without_pushdown(spark, folder, ranges):
    if ranges:
        assert ply.write_ranges(spark, folder, 100) == 12
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plain = ply.read_ply(spark, folder)
    whole = spark.createDataFrame(plain.collect(), plain.schema)
    for f in _filters():
        want = sorted(map(repr, whole.where(f).collect()))
        assert sorted(map(repr, ply.read_ply(spark, folder, range_rows="100", pushdown="true").where(f).collect())) == want, f
    for keep, said in (('[["x", ">", 0.5]]', "x > 0.5"), ('[["vid", ">=", 120], ["x", "<", 0]]', "vid >= 120 AND x < 0"), ('[["tag", "=", 7]]', "tag = 7"), ('[["x", "<=", -9]]', "x <= -9")):
        kept = ply.read_ply(spark, folder, range_rows="100", keep=keep)
        for _ in range(2):  # a frame may be used again
            assert sorted(map(repr, kept.collect())) == sorted(map(repr, whole.where(said).collect()))
            assert kept.where("isnan(x)").count() == whole.where(said).where("isnan(x)").count()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pushed_filters_leave_the_plan(spark, folder):
    """Spark's plan of a Python source doesn't name pushed filters, but has no filter of its own left."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plan = lambda pushdown: ply.read_ply(spark, folder, pushdown=pushdown).where("vid > 100 AND x > 0.5")._jdf.queryExecution().executedPlan().toString()
    with_, without = plan("true"), plan("false")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert "Filter (" not in with_ and "Filter (" in without and "BatchScan ply" in with_


def test_ranges_are_skipped(spark, folder):
    names = ["x", "y", "tag"]
    ply.write_ranges(spark, folder, 100)

    def read(*filters):
        reader = ply.FilteredPlyReader(ply.files_of(folder, ".ply"), {"range_rows": "100"}, names)
        left = list(reader.pushFilters(filters))
        return [(p.path[-5:], p.first) for p in reader.partitions()], left

    assert len(read()[0]) == 12
    assert read(GreaterThan(("vid",), 850))[0] == [("a.ply", 800), ("a.ply", 900)]
    assert read(EqualTo(("vid",), 120))[0] == [("a.ply", 100), ("b.ply", 100)]
    low = read(LessThan(("x",), -1.3), IsNotNull(("x",)))
    assert low[1] == [] and {p for p, _ in low[0]} == {"a.ply", "b.ply"} and len(low[0]) <= 3
    assert len(read(GreaterThan(("x",), 5.0))[0]) == 2  # only where NaN is
    assert read(EqualTo(("other",), 1.0))[1] != []
    with pytest.raises(ply.PlyError):
        ply.PlyReader([], {"keep": '[["other", "=", 1]]'}, names)
    b = f"{folder}/b.ply"
    raw = open(b, "rb").read()
    open(b, "wb").write(raw)  # its table is of an older file now
    assert len([p for p, _ in read(LessThan(("x",), -1.3))[0] if p == "b.ply"]) == 2
