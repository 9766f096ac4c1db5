"""Readers and writers: round trips and the rules of the formats."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyllo.session import spread
from phyllo.sources import arrays, colmap, files, ply, text_cloud
from phyllo.streaming import watch


@pytest.fixture(scope="module")
def gaussian(spark):
    rows = [(i, float(i), 0.0, 1.0, float(i), 0.1, 1.0) for i in range(5)]
    return spark.createDataFrame(rows, "vid long, x float, y float, z float, opacity float, scale_0 float, rot_0 float")


@pytest.mark.parametrize("ascii", [False, True])
def test_ply_round_trip(spark, gaussian, tmp_path, ascii):
    path = str(tmp_path / "plant_001.ply")
    assert ply.write_ply(gaussian.repartition(3), path, ascii=ascii) == 5 and ply.count_vertices(path) == 5
    back = ply.read_ply(spark, path)
    assert back.columns == ["uid", "vid", "x", "y", "z", "opacity", "scale_0", "rot_0"]
    assert [tuple(r)[1:] for r in back.sort("vid").collect()] == [tuple(r) for r in gaussian.sort("vid").collect()]
    with pytest.raises(FileExistsError):
        ply.write_ply(gaussian, path)
    assert ply.write_ply(gaussian.limit(0), path, mode="ignore") == 5
    with pytest.raises(Exception, match="missing properties"):
        ply.read_ply(spark, path, required="x,red").collect()


def test_ply_rules(spark, gaussian, tmp_path):
    path = str(tmp_path / "a.ply")
    ply.write_ply(gaussian, path)
    raw = open(path, "rb").read()
    cut = str(tmp_path / "cut.ply")
    open(cut, "wb").write(raw[:-10])
    with pytest.raises(Exception, match="4 of 5 vertices"):
        ply.read_ply(spark, cut).collect()
    assert ply.read_ply(spark, cut, mode="PREFIX").count() == 4
    for bad, why in (
        (b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n", "list"),
        (b"ply\nformat binary_little_endian 1.0\nelement face 1\nend_header\n", "no vertex"),
        (b"ply\nformat ascii 1.0\nelement vertex 1\n", "no end_header"),
        (b"ply\nformat binary_big_endian 1.0\nelement vertex 0\nend_header\n", "format"),
        (b"hello\n", "no PLY"),
    ):
        p = str(tmp_path / "bad.ply")
        open(p, "wb").write(bad)
        with pytest.raises(ply.PlyError, match=why):
            ply.read_header(p)


def test_ply_types_and_folders(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty uchar red\nproperty uint u\nproperty double d\nelement face 0\nproperty list uchar int v\nend_header\n"
    open(tmp_path / "p.ply", "wb").write(head + struct.pack("<BId", 255, 4_000_000_000, 0.5) + struct.pack("<BId", 0, 1, -1.0))
    open(tmp_path / "q.ply", "wb").write(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty uchar red\nend_header\n\x07")
    got = {(r["uid"], r["vid"]): (r["red"], r["u"], r["d"]) for r in ply.read_ply(spark, str(tmp_path)).collect()}
    assert got == {("p", 0): (255, 4_000_000_000, 0.5), ("p", 1): (0, 1, -1.0), ("q", 0): (7, None, None)}


def test_cloud_writers(spark, gaussian, tmp_path):
    path = str(tmp_path / "c.ply")
    ply.write_cloud(gaussian, path)
    assert [p for p, _ in ply.read_header(path).properties] == ["x", "y", "z", "red", "green", "blue"]
    assert ply.read_ply(spark, path).first()["red"] == 180
    rgb = ply.add_rgb(gaussian.withColumns({f"f_dc_{i}": F.lit(0.0) for i in range(3)}))
    assert rgb.first()["red"] == 127
    with pytest.raises(ply.PlyError):
        ply.add_rgb(rgb)
    with pytest.raises(ply.PlyError):
        ply.add_rgb(gaussian)
    ply.write_instances(gaussian.withColumn("instance_id", F.col("vid")), str(tmp_path / "i.ply"))
    ply.write_labelled(rgb.withColumn("label", F.lit(3)), str(tmp_path / "l.ply"))
    assert ply.read_ply(spark, str(tmp_path / "l.ply")).first()["label"] == 3


def test_images_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    spot = "struct<x: double, y: double, point3d_id: bigint>"
    ims = spark.range(400).selectExpr("CAST(id AS int) AS image_id", "array(1.0D, 0D, 0D, 0D) AS qvec", "array(CAST(id AS double), 0D, 1D) AS tvec", "CAST(id % 3 AS int) AS camera_id", "concat('é', repeat('n', CAST(id % 50 AS int)), id) AS name", f"CAST(transform(sequence(0L, (id * 7) % 90), i -> named_struct('x', CAST(i AS double), 'y', 0.5D, 'point3d_id', i - 1)) AS array<{spot}>) AS points2d")
    path = str(tmp_path / "images.bin")
    colmap.write_images(ims, path)
    spark.dataSource.register(colmap.ColmapImages)
    read = lambda size: spark.read.format("colmap_images").option("part_bytes", size).load(path)
    whole, split = read(1 << 30), read(20_000)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 15
    assert sorted(map(repr, split.collect())) == sorted(map(repr, ims.collect())) == sorted(map(repr, whole.collect()))
    parts = colmap.image_parts(path, 20_000)
    assert sum(n for _, n in parts) == 400 and all(n for _, n in parts)
    colmap.write_images(ims.limit(0), path)
    assert read(100).count() == 0


def test_colmap_round_trip(spark, tmp_path):
    folder = tmp_path / "sparse" / "0"
    os.makedirs(folder)
    cams = spark.createDataFrame([(2, 1, 10, 20, [1.0, 2.0, 3.0, 4.0]), (1, 2, 5, 6, [1.0, 2.0, 3.0, 4.0])], colmap.CAMERA_SCHEMA)
    ims = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 0.0], 2, "b é.png", [(1.5, 2.5, -1)]), (3, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "a.png", [])], f"{colmap.IMAGE_SCHEMA}, {colmap.POINTS}")
    colmap.write_cameras(cams, str(folder / "cameras.bin"))
    colmap.write_images(ims, str(folder / "images.bin"))
    c, i = colmap.read_model(spark, str(tmp_path))
    assert c.sort("camera_id").collect() == cams.sort("camera_id").collect() and i.sort("image_id").collect() == ims.sort("image_id").collect()
    assert "points2d" not in colmap.read_model(spark, str(tmp_path), False)[1].columns and colmap.read_model(spark, str(tmp_path), False)[1].count() == 2
    first = open(folder / "images.bin", "rb").read()
    colmap.write_images(i, str(folder / "again.bin"))
    assert open(folder / "again.bin", "rb").read() == first
    with pytest.raises(FileNotFoundError):
        colmap.sparse_dir(str(tmp_path / "none"))


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "l.npy", np.array([[1], [2], [3]], np.int32)[:, 0])
    np.save(tmp_path / "f.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.savez(tmp_path / "m.npz", mask=np.array([True, False]))
    assert [tuple(r) for r in arrays.read_npy(spark, str(tmp_path / "l.npy"), "label", "u").sort("vid").collect()] == [("u", 0, 1), ("u", 1, 2), ("u", 2, 3)]
    assert arrays.read_npy(spark, str(tmp_path / "f.npy"), "feat").sort("vid").collect()[2]["feat"] == [4.0, 5.0]
    assert arrays.read_npz(spark, str(tmp_path / "m.npz"), "mask").where("value").count() == 1
    np.savez(tmp_path / "c.npz", coord=np.eye(3), feat=np.eye(3))
    whole = arrays.read_cloud_npz(spark, str(tmp_path / "c.npz"), "u").sort("vid").collect()
    assert (whole[1]["y"], whole[1]["red"], whole[2]["feat"]) == (1.0, 1.0, [0.0, 0.0, 1.0])
    df = spark.createDataFrame([(1, 5), (0, 4)], "vid long, label int")
    assert arrays.write_npy(df, str(tmp_path / "o.npy"), "label") == 2 and np.load(tmp_path / "o.npy").tolist() == [4, 5]
    with pytest.raises(ValueError):
        arrays.write_npy(df.where("vid = 1"), str(tmp_path / "o.npy"), "label")


def test_text_tables(spark, tmp_path):
    open(tmp_path / "c.txt", "w").write("# head\n\n1,2,3,10,20,300\n4 5 6 1.5 2.5 -3 9\n")
    got = text_cloud.read_text_cloud(spark, str(tmp_path / "c.txt")).sort("line_at").collect()
    assert [(r["uid"], r["x"], r["red"], r["green"], r["blue"]) for r in got] == [("c", 1.0, 10, 20, 255), ("c", 4.0, 2, 2, 0)]
    open(tmp_path / "d.txt", "w").write("1 2 3\n")
    with pytest.raises(Exception, match="fewer than six"):
        text_cloud.read_text_cloud(spark, str(tmp_path / "d.txt")).collect()
    open(tmp_path / "s.csv", "w").write('uid,cluster_ids\na,"1，2"\nb,3\n')
    assert arrays.read_selection(spark, str(tmp_path / "s.csv")).count() == 3
    open(tmp_path / "t.log", "w").write("x\nTRAIN_TIME_SEC=12.5\nTRAIN_TIME_SEC=9\n")
    assert arrays.train_time(spark, str(tmp_path / "t.log")).first()["train_time_sec"] == 12.5
    for i, s in enumerate(("a.ply", "a.ply", "b.ply")):
        open(tmp_path / f"click{i}.json", "w").write('{"source_ply": "%s", "scale": 1}' % s)
    assert arrays.read_clicks(spark, str(tmp_path / "click[01].json")).count() == 2
    with pytest.raises(ValueError):
        arrays.read_clicks(spark, str(tmp_path / "click*.json"))
    rows = spark.createDataFrame([("a", 1.23456789, None), ("b", 2.0, 3)], "name string, m double, n int")
    assert [r["line"] for r in arrays.markdown_lines(rows, rows.columns[0]).sort("at").collect()][2] == "| a | 1.23457 |  |"
    arrays.write_metrics(rows, str(tmp_path / "out"))
    assert arrays.read_metrics(spark, [str(tmp_path / "out" / "csv")]).count() == 2
    summary = arrays.write_partitioned(spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 2)], "uid string, instance_id int, vid int"), str(tmp_path / "parts"), most=1)
    assert summary.first()["n_points"] == 2 and spark.read.parquet(str(tmp_path / "parts")).count() == 2
    assert arrays.dir_size_mb(spark, str(tmp_path / "parts")) > 0


def test_file_catalogues(spark, tmp_path):
    for n in (7000, 30000):
        folder = tmp_path / "gof" / "plant_002" / "point_cloud" / f"iteration_{n}"
        os.makedirs(folder)
        for name in ("point_cloud.ply", "zz.ply"):
            open(folder / name, "w").write("x")
    for root in ("plant_003", "plant_003_undistorted"):
        os.makedirs(tmp_path / "data" / root / "sparse" / "0")
        os.makedirs(tmp_path / "data" / root / "images")
        open(tmp_path / "data" / root / "images" / "a.png", "w").write("x")
        for name in ("cameras.bin", "images.bin", "points3D.bin"):
            open(tmp_path / "data" / root / "sparse" / "0" / name, "w").write("x")
    found = files.list_files(spark, str(tmp_path))
    latest = files.latest_iteration(files.runs_of(found)).first()
    assert latest["path"].endswith("gof/plant_002/point_cloud/iteration_30000/point_cloud.ply")
    ready = files.ready_datasets(found.withColumn("plant", F.regexp_extract("path", r"(plant_\d+)", 1))).first()
    assert ready["root"].endswith("plant_003_undistorted")
    one, many = files.only_match(found.where("name = 'a.png'").withColumn("uid", F.lit("u")))
    assert one.count() == 0 and many.first()["n"] == 2
    assert files.extras(found).where("name = 'points3D.bin'").count() == 2 and files.extras(found).where("name = 'cameras.bin'").count() == 0
    names = spark.createDataFrame([("a.png",)], "name string")
    assert files.image_paths(names, found).first()["path"].endswith("images/a.png")


def test_image_paths_meet_by_ends_of_paths(spark, monkeypatch):
    """Names with one last part are not compared with every file of that last part: before, 300 names met 300 files each."""
    paths = spark.range(300).select(F.concat(F.lit("/data/p"), "id", F.lit("/images/b.png")).alias("path")).unionByName(spark.createDataFrame([("/x/images/p7/images/b.png",), ("/a/p7/images/b.png",)], "path string"))
    names = spark.range(300).select(F.concat(F.lit("p"), "id", F.lit("/images/b.png")).alias("name"))
    got = {r["name"]: r["path"] for r in files.image_paths(names, paths).collect()}
    assert len(got) == 300 and got["p8/images/b.png"] == "/data/p8/images/b.png" and got["p7/images/b.png"] == "/x/images/p7/images/b.png"


def test_clicks_of_a_pattern_are_read_line_by_line(spark, tmp_path):
    """Files of several lines, and no file beside the pattern."""
    for i in range(3):
        (tmp_path / f"{i}.json").write_text('{"source_ply": "a.ply",\r\n "click":\n ' + str(i) + "}\n")
    (tmp_path / "other.txt").write_text("no json")
    got = arrays.read_clicks(spark, f"{tmp_path}/*.json")
    assert sorted((r["source_ply"], r["click"]) for r in got.collect()) == [("a.ply", i) for i in range(3)]
    assert len(got.inputFiles()) <= 3 and not any(str(tmp_path) in f for f in got.inputFiles())  # read from lines, not from the files again


def test_small_tables_are_spread_over_tasks(spark, sf):
    assert spread(spark.range(0, 1001, 1, 1), 500).rdd.getNumPartitions() == 3 and spread(spark.range(0), 500).count() == 0
    assert sorted(r["id"] for r in spread(spark.range(1001), 100).collect()) == list(range(1001))


def test_watched_folder(spark, tmp_path):
    schema = "uid string, vid long, x double, y double, z double"
    spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 0.0, 0.0)], schema).write.parquet(str(tmp_path / "in"))
    boxes = watch.running_boxes(watch.watch_vertices(spark, str(tmp_path / "in"), schema))
    q = boxes.writeStream.outputMode("complete").format("memory").queryName("boxes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("boxes").first()["max_x"] == 4.0
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert watch.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
