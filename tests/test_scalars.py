"""Scalar and colour functions against known values."""

import colorsys
import math

import pytest
from pyspark.sql import functions as F

from phyllo.functions import colors, scalars


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_harmonics_to_colours(spark):
    got = one(spark, *[f(F.lit(v)) for v in (-10.0, 0.0, 10.0) for f in (scalars.sh_to_rgb_rint, scalars.sh_to_rgb_trunc)])
    assert got == (0, 0, 128, 127, 255, 255)


def test_clamp_and_sigmoid(spark):
    assert one(spark, *[scalars.clamp_color(F.lit(v)) for v in (-3.0, 0.5, 1.5, 2.5, 300.0)]) == (0, 0, 2, 2, 255)
    assert one(spark, scalars.sigmoid(F.lit(-1e9)))[0] == pytest.approx(math.exp(-60), rel=1e-6)


def test_is_finite_and_safe_div(spark):
    bad = [F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None)]
    assert one(spark, *[scalars.is_finite(c) for c in [*bad, F.lit(1.0)]]) == (False, False, False, False, True)
    assert one(spark, scalars.safe_div(F.lit(1), F.lit(0)), scalars.safe_div(F.lit(1), F.lit(4)), scalars.safe_div(F.lit(1), F.lit(None))) == (0.0, 0.25, 0.0)
    assert one(spark, scalars.label_from_float(F.lit(float("nan"))), scalars.label_from_float(F.lit(2.9))) == (0, 2)


def test_quaternions(spark):
    rows = [(0.0, 0.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "rot_0 float, rot_1 float, rot_2 float, rot_3 float")
    assert [tuple(r) for r in scalars.normalise_quaternion(df).collect()] == [(0, 0, 0, 1), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert scalars.normalise_quaternion(df.drop("rot_3")).columns == ["rot_0", "rot_1", "rot_2"]


def test_opacity_and_repair(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", float("inf"), float("nan")), ("a", 3.0, 7.0), ("b", float("nan"), 1.0)], "uid string, opacity double, rot_0 double")
    got = scalars.sanitise_opacity(df).collect()
    assert sorted((r["uid"], round(r["opacity"], 3), r["opacity_replaced"]) for r in got) == [("a", 1.0, 1), ("a", 2.998, 1), ("a", 3.0, 1), ("b", 0.0, 1)]
    fixed = scalars.repair_non_finite(df).collect()
    assert sorted((r["uid"], r["opacity"], r["rot_0"]) for r in fixed) == [("a", 1.0, 5.0), ("a", 2.0, 6.0), ("a", 3.0, 7.0), ("b", 0.0, 1.0)]


def test_intrinsics(spark):
    df = spark.createDataFrame([(0, [500.0, 400.0, 300.0]), (1, [510.0, 520.0, 401.0, 302.0])], "m int, p array<double>")
    assert [tuple(r[0]) for r in df.select(scalars.intrinsics("m", "p")).collect()] == [(500, 500, 400, 300), (510, 520, 401, 302)]
    with pytest.raises(Exception, match="unsupported camera model"):
        df.select(scalars.intrinsics(F.lit(9), "p")).collect()
    moved = df.select(scalars.shift_camera("m", "p", F.lit(10), F.lit(20))).collect()
    assert [r[0] for r in moved] == [[500, 390, 280], [510, 520, 391, 282]]


def test_projection_turns_with_the_quaternion(spark):
    half = math.sqrt(0.5)
    k = F.struct(F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(40.0).alias("cy"))
    u, v, d = scalars.project([F.lit(1.0), F.lit(2.0), F.lit(4.0)], [F.lit(half), F.lit(0.0), F.lit(0.0), F.lit(half)], [F.lit(0.0)] * 3, k)
    assert one(spark, u, v, d) == pytest.approx((0.0, 65.0, 4.0))
    assert one(spark, *[scalars.to_pixel(F.lit(x), r) for x in (-0.5, 0.5, 1.5) for r in ("rint", "trunc")]) == (0, 0, 0, 0, 2, 1)


def test_text_functions(spark):
    assert one(spark, scalars.plant_uid(F.lit("/a/plant_012_labeled.ply")), scalars.plant_uid(F.lit("x_plant_1.ply"))) == ("plant_012", None)
    assert one(spark, scalars.parse_id_list(F.lit("1，2, ,3,")))[0] == [1, 2, 3]
    assert tuple(one(spark, scalars.parse_item(F.lit("n|a.ply|r|x")))[0]) == ("n", "a.ply", "r|x")
    assert one(spark, scalars.base_name(F.lit("/M/Frame_01_mask.PNG")))[0] == "frame_01"
    assert one(spark, scalars.feature_file(F.lit("u")))[0] == "part_feat_u_0.npy"
    assert one(spark, scalars.frame_schedule(0, 10, 5))[0] == [0, 2, 5, 8, 10]
    with pytest.raises(ValueError):
        scalars.quantised_key("x", 0)


def test_relabel_and_zip(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((0, 7, 3, 7, -1))], "uid string, vid long, label int")
    assert [r["label"] for r in scalars.relabel_contiguous(df).sort("vid").collect()] == [0, 2, 1, 2, 0]
    assert scalars.positional_zip(df, df.where("vid < 3").select("uid", "vid", F.col("label").alias("l"))).count() == 3


def test_colour_sources(spark):
    xyz = spark.createDataFrame([("a", 1.0)], "uid string, x double")
    assert scalars.resolve_color(xyz).first()["red"] == 180.0
    assert scalars.resolve_color(xyz.withColumns({f"f_dc_{i}": F.lit(0.0) for i in range(3)})).first()["red"] == 128
    rgb = spark.createDataFrame([("a", 255.0, 0.0, 1.0), ("b", 1.0, 0.5, 0.0)], "uid string, red double, green double, blue double")
    assert sorted((r["uid"], r["red"]) for r in scalars.rescale_colors(rgb).collect()) == [("a", 1.0), ("b", 1.0)]


def test_palettes(spark):
    hues = [i * colors.HUE_STEP % 1 for i in range(1, 40)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hues)], "i int, h double")
    for r in df.select("h", *[c.alias(n) for c, n in zip(colors.hsv_to_rgb(F.col("h"), 0.7, 0.95), "rgb", strict=True)]).collect():
        assert (r["r"], r["g"], r["b"]) == pytest.approx(colorsys.hsv_to_rgb(r["h"], 0.7, 0.95), abs=1e-9)
    ids = spark.createDataFrame([(0,), (1,), (1,), (5,)], "instance_id int")
    got = colors.instance_palette(ids).collect()
    assert {r["instance_id"]: r["red"] for r in got}[0] == 0 and len(got) == 4
    labels = ids.withColumnRenamed("instance_id", "label")
    table = {r["label"]: (r["red"], r["green"], r["blue"]) for r in colors.label_palette(labels).collect()}
    assert table[0] == colors.NO_LABEL and table[5] == colors.TAB20[-1]
    assert colors.random_palette(labels).count() == 3


def test_green(spark):
    df = spark.createDataFrame([(40, 160, 40), (160, 40, 40), (128, 128, 128)], "r int, g int, b int")
    assert [tuple(r) for r in df.select(colors.is_green("r", "g", "b"), colors.is_green_range("r", "g", "b")).collect()] == [(True, True), (False, False), (False, False)]


def test_pca_colours(spark):
    df = spark.createDataFrame([(i, [float(i), float(i % 3), float(i % 5), 1.0]) for i in range(30)], "vid long, feat array<double>")
    got = colors.pca_colors(df).collect()
    assert min(r["red"] for r in got) == 0 and max(r["red"] for r in got) == pytest.approx(1) and len(got) == 30
