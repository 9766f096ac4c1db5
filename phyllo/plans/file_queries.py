"""Registered queries of the sources and sinks: tables go out in a format and come back, with DuckDB SQL for what must come back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.operators import aggregates, images, metrics
from phyllo.plans.catalogue import OVERLAP_SQL, PARTS_SQL, parts, query, rounded, segments
from phyllo.plans.more_queries import _pictures, _pixel_sql
from phyllo.session import cut, read_table, shared_path, spread
from phyllo.sources import arrays, colmap, files, pictures, ply, stores, text_cloud


def _cloud(spark, sf) -> DataFrame:
    """Parts as vertices with positions 0..n-1 and harmonics."""
    p = parts(spark, sf)
    return p.select("vid", *[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("opacity").alias("opacity"), *[((F.col("vid") * (i + 3) % 17) / 4 - 2).cast("float").alias(f"f_dc_{i}") for i in range(3)], (F.col("vid") % 200).cast("int").alias("label"))


CLOUD_SQL = f"{PARTS_SQL}, cl AS (SELECT vid, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, opacity, ((vid * 3) % 17) / 4.0::DOUBLE - 2 AS f_dc_0, CAST(vid % 200 AS INTEGER) AS label FROM pt)"


@query(f"WITH {CLOUD_SQL} SELECT 'plant_001' AS uid, vid, round(x, 6) AS x, round(y, 6) AS y, round(opacity, 6) AS opacity, round(f_dc_0, 6) AS f_dc_0, label FROM cl")
def ply_binary(spark, sf):
    path = shared_path(spark, "ply") + "/plant_001.ply"
    ply.write_ply(_cloud(spark, sf), path)
    return rounded(ply.read_ply(spark, path).select("uid", "vid", "x", "y", "opacity", "f_dc_0", "label"))


@query(f"WITH {CLOUD_SQL} SELECT vid, round(x, 6) AS x, round(opacity, 6) AS opacity, label FROM cl")
def ply_ascii(spark, sf):
    path = shared_path(spark, "ply") + "/plant_002.ply"
    ply.write_ply(_cloud(spark, sf), path, ascii=True)
    return rounded(ply.read_ply(spark, path, columns="x,opacity,label").select("vid", "x", "opacity", "label"))


@query(f"WITH {CLOUD_SQL} SELECT vid, label FROM cl WHERE vid < (SELECT count(*) - 7 FROM cl)")
def ply_prefix(spark, sf):
    """A file that ends five bytes into the seventh vertex from the end."""
    path = shared_path(spark, "ply") + "/plant_003.ply"
    n = ply.write_ply(_cloud(spark, sf), path)
    head = ply.read_header(path)
    with stores.opened(path) as f:
        raw = f.read(head.size + (n - 7) * head.dtype.itemsize + 5)
    stores.write_whole(path.replace("003", "004"), raw)
    return ply.read_ply(spark, path.replace("003", "004"), mode="PREFIX").select("vid", "label")


@query(f"WITH {CLOUD_SQL} SELECT 'plant_005' AS uid, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, (SELECT count(*) FROM cl) AS n FROM cl")
def ply_xyz(spark, sf):
    path = shared_path(spark, "ply") + "/plant_005.ply"
    ply.write_ply(_cloud(spark, sf), path)
    return rounded(ply.read_xyz(spark, path).withColumn("n", F.lit(ply.count_vertices(path)).cast("long")))


@query(f"""WITH {CLOUD_SQL}, r AS (SELECT *, CAST(trunc(greatest(0.0, least(255.0, (f_dc_0 * 0.28209479177387814::DOUBLE + 0.5) * 255))) AS SMALLINT) AS cut_off, CAST(round_even(greatest(0.0, least(1.0, f_dc_0 * 0.28209479177387814::DOUBLE + 0.5)) * 255, 0) AS SMALLINT) AS half_even FROM cl)
SELECT 'cloud' AS kind, vid, half_even AS red, NULL::DOUBLE AS tag FROM r UNION ALL SELECT 'rgb', vid, cut_off, NULL FROM r UNION ALL SELECT 'labelled', vid, cut_off, label FROM r UNION ALL SELECT 'instances', vid, NULL, label FROM r""")
def ply_kinds(spark, sf):
    """Plain clouds, clouds with colours from their harmonics, labelled clouds, and instances."""
    folder, c = shared_path(spark, "ply"), _cloud(spark, sf)
    shown = ply.add_rgb(c)
    ply.write_cloud(c, f"{folder}/cloud.ply")
    ply.write_ply(shown, f"{folder}/rgb.ply")
    ply.write_labelled(shown, f"{folder}/labelled.ply")
    ply.write_instances(c.withColumnRenamed("label", "instance_id"), f"{folder}/instances.ply")
    none = lambda kind: F.lit(None).cast(kind)
    tags = {"cloud": (F.col("red"), none("double")), "rgb": (F.col("red"), none("double")), "labelled": (F.col("red"), F.col("label").cast("double")), "instances": (none("smallint"), F.col("instance_id").cast("double"))}
    back = [ply.read_ply(spark, f"{folder}/{k}.ply").select(F.lit(k).alias("kind"), "vid", red.alias("red"), tag.alias("tag")) for k, (red, tag) in tags.items()]
    return functools.reduce(DataFrame.union, back)


@query("SELECT 'errorifexists' AS mode, true AS raised, 25 AS n UNION ALL SELECT 'ignore', false, 25 UNION ALL SELECT 'overwrite', false, (SELECT count(*) FROM nation WHERE n_nationkey < 5)")
def ply_modes(spark, sf):
    """What each mode leaves of 25 vertices where five are written over them."""
    path, rows = shared_path(spark, "ply") + "/a.ply", read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), F.col("n_regionkey").cast("float").alias("x"))
    out = []
    for mode in ("errorifexists", "ignore", "overwrite"):
        ply.write_ply(rows, path, "overwrite")
        try:
            ply.write_ply(rows.where("vid < 5"), path, mode)
            raised = False
        except FileExistsError:
            raised = True
        out.append((mode, raised, ply.count_vertices(path)))
    return spark.createDataFrame(out, "mode string, raised boolean, n long")


@query("SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, round(p_retailprice, 6) AS y, CAST(p_partkey % 256 AS INTEGER) AS red, CAST(least(255, p_size * 9) AS INTEGER) AS green FROM part")
def text_clouds(spark, sf):
    p, folder = read_table(spark, sf, "part"), shared_path(spark, "text")
    line = F.concat_ws(", ", "p_size", "p_retailprice", "p_partkey", F.col("p_partkey") % 256, F.col("p_size") * 9, F.lit(-3), F.lit("more"))
    p.select(F.explode(F.array(F.lit("# a comment"), line, F.lit(" "))).alias("value")).write.text(folder)
    return rounded(text_cloud.read_text_cloud(spark, folder).select(F.col("z").cast("long").alias("vid"), "x", "y", "red", "green"))


@query("SELECT s_suppkey AS image_id, s_name AS name, round(s_acctbal, 6) AS tx, CAST(s_suppkey % 4 + 1 AS INTEGER) AS camera_id, CAST(s_suppkey % 4 AS INTEGER) AS model_id, 640 AS width, CAST(CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 5 ELSE 4 END AS INTEGER) AS n_params, count(l_orderkey) AS n_points, round(coalesce(sum(l_tax), 0), 6) AS points_x FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber = 2 GROUP BY s_suppkey, s_name, s_acctbal")
def colmap_models(spark, sf):
    root, s = shared_path(spark, "colmap"), read_table(spark, sf, "supplier")
    spots = read_table(spark, sf, "lineitem").where("l_linenumber = 2").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_list(F.struct(F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_orderkey").alias("point3d_id"))).alias("points2d"))
    half = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    ims = s.join(spots, "s_suppkey", "left").select(F.col("s_suppkey").cast("int").alias("image_id"), half.alias("qvec"), F.array(F.col("s_acctbal"), F.lit(0.0), F.lit(1.0)).alias("tvec"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("camera_id"), F.col("s_name").alias("name"), F.coalesce("points2d", F.array().cast("array<struct<x: double, y: double, point3d_id: bigint>>")).alias("points2d"))
    cams = spark.createDataFrame([(i + 1, i, 640, 480, [float(v) for v in range(colmap.CAMERA_MODELS[i][1])]) for i in range(4)], colmap.CAMERA_SCHEMA)
    folder = f"{root}/sparse/0"
    colmap.write_cameras(cams, f"{folder}/cameras.bin")
    colmap.write_images(ims, f"{folder}/images.bin")
    cameras, images_ = colmap.read_model(spark, root)
    back = images_.join(cameras, "camera_id")
    x = F.aggregate("points2d", F.lit(0.0), lambda a, p: a + p["x"])
    return rounded(back.select(F.col("image_id").cast("long").alias("image_id"), "name", F.col("tvec")[0].alias("tx"), "camera_id", "model_id", F.col("width").cast("int").alias("width"), F.size("params").alias("n_params"), F.size("points2d").cast("long").alias("n_points"), x.alias("points_x")))


@query("SELECT vec_id AS vid, CAST(label AS BIGINT) AS label, label > 4 AS mask, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[64]::DOUBLE, 6) AS last_, 1.0::DOUBLE AS red FROM embeddings")
def numpy_arrays(spark, sf):
    """Label vectors, masks and matrices as NPY files, and all of them as one archive."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").cast("int").alias("label"), (F.col("label") > 4).alias("mask"), F.col("embedding").alias("feat"), F.slice("embedding", 1, 3).alias("coord"))
    e, folder = cut(e, "arrays"), shared_path(spark, "npy")
    kinds = {"label": "int32", "mask": "bool", "feat": "float32", "coord": "float64"}
    for name, kind in kinds.items():
        arrays.write_npy(e, f"{folder}/{name}.npy", name, dtype=kind)
    arrays.write_npz({n: f"{folder}/{n}.npy" for n in kinds}, f"{folder}/all.npz")
    labels = arrays.read_npy(spark, f"{folder}/label.npy", "label").join(arrays.read_npz(spark, f"{folder}/all.npz", "mask").select("vid", F.col("value").alias("mask")), "vid")
    cloud = arrays.read_cloud_npz(spark, f"{folder}/all.npz")
    return rounded(labels.join(cloud, "vid").select("vid", "label", "mask", "x", F.col("feat")[63].alias("last_"), "red"))


@query("SELECT s_suppkey, 'part_feat_plant_' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_0.npy' AS file FROM supplier")
def feature_files(spark, sf):
    from phyllo.functions import scalars

    uid = F.concat(F.lit("plant_"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"))
    return read_table(spark, sf, "supplier").select("s_suppkey", scalars.feature_file(uid).alias("file"))


@query("SELECT 'one.ply' AS source_ply, s_suppkey AS click, CAST(s_nationkey AS BIGINT) AS label FROM supplier")
def click_files(spark, sf):
    """Metadata of a click for each supplier, a file each, written by the tasks and read back."""
    folder = shared_path(spark, "clicks")
    said = F.to_json(F.struct(F.lit("one.ply").alias("source_ply"), F.col("s_suppkey").alias("click"), F.col("s_nationkey").alias("label")))
    stores.write_each(spread(read_table(spark, sf, "supplier")).select(F.concat(F.lit(f"{folder}/"), "s_suppkey", F.lit(".json")).alias("path"), said.alias("raw")))
    return arrays.read_clicks(spark, f"{folder}/*.json").select("source_ply", F.col("click").cast("long").alias("click"), "label")


@query(f"WITH {_pixel_sql('x')}, {_pixel_sql('y', 3)} SELECT x.s_name AS name, 12 AS height, 12 AS width, round(avg(x.g), 6) AS mean, round(20 * log10(1 / sqrt(avg((x.g - y.g) * (x.g - y.g)))), 6) AS psnr FROM x JOIN y ON y.k = x.k AND y.i = x.i AND y.j = x.j GROUP BY x.s_name")
def picture_files(spark, sf):
    """Renders and truths as PNG files, read back, met by name, and compared pixel by pixel."""
    folder = shared_path(spark, "pictures")
    for kind, shift in (("render", 0), ("gt", 3)):
        pictures.write_pictures(_pictures(spark, sf, shift), f"{folder}/{kind}")
    shown = lambda kind: pictures.read_pictures(spark, f"{folder}/{kind}").select("name", "height", "width", F.col("pixels").alias(kind))
    met = cut(shown("render").join(shown("gt").select("name", "gt").hint("merge"), "name"), "met")  # whole pictures meet; their pixels are spread afterwards
    value = lambda c, at: F.conv(F.hex(F.substring(c, at + 1, F.lit(1))), 16, 10).cast("double") / 255
    places = F.sequence(F.lit(0), F.least(F.length("render"), F.length("gt")) - 1)
    both = met.where((F.length("render") > 0) & (F.length("gt") > 0)).select("name", "height", "width", F.explode(places).alias("at"), "render", "gt").select("name", "height", "width", value(F.col("render"), F.col("at")).alias("render"), value(F.col("gt"), F.col("at")).alias("gt"))
    sizes = both.groupBy("name").agg(F.first("height").alias("height"), F.first("width").alias("width"), F.avg("render").alias("mean"))
    return rounded(images.psnr(both, ("name",)).join(sizes, "name"))


@query("SELECT 'run_' || s_suppkey AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey + 0.5::DOUBLE END AS train_time_sec, round(sum(octet_length(encode('x' || chr(10) || CASE WHEN s_suppkey % 5 > 0 THEN 'TRAIN_TIME_SEC=' || s_suppkey || '.5' ELSE 'none' END || chr(10)))) OVER () / 1048576.0::DOUBLE, 6) AS folder_mb FROM supplier")
def log_files(spark, sf):
    """A log for each supplier, written by the tasks; what it says, and the size of them all."""
    folder, k = shared_path(spark, "logs"), F.col("s_suppkey")
    said = F.when(k % 5 > 0, F.concat(F.lit("TRAIN_TIME_SEC="), k, F.lit(".5"))).otherwise("none")
    stores.write_each(spread(read_table(spark, sf, "supplier")).select(F.concat(F.lit(f"{folder}/run_"), k, F.lit(".log")).alias("path"), F.concat(F.lit("x\n"), said, F.lit("\n")).alias("raw")))
    name = F.regexp_extract("path", r"([^/]+)\.log$", 1)
    return rounded(arrays.train_time(spark, folder).select(name.alias("name"), "train_time_sec").withColumn("folder_mb", F.lit(arrays.dir_size_mb(spark, folder))))


@query("SELECT s_name || '.ply' AS name, CAST(s_suppkey % 50 + 1 AS BIGINT) AS length, s_suppkey % 5 < 4 AS alone FROM supplier")
def found_files(spark, sf):
    """Files of a folder by their ending, and which of them are the only one of their key."""
    folder, s = shared_path(spark, "found"), spread(read_table(spark, sf, "supplier"))
    key = F.when(F.col("s_suppkey") % 5 < 4, F.col("s_suppkey")).otherwise(10**9)
    stores.write_each(s.select(F.concat(F.lit(f"{folder}/"), key, F.lit("/"), "s_name", F.lit(".ply")).alias("path"), F.repeat(F.lit("x"), (F.col("s_suppkey") % 50 + 1).cast("int")).alias("raw")))
    stores.write_each(s.select(F.concat(F.lit(f"{folder}/"), "s_name", F.lit(".txt")).alias("path"), F.lit("y").alias("raw")))
    there = files.list_files(spark, folder, "*.ply").withColumn("uid", F.regexp_extract("path", r"/(\d+)/[^/]+$", 1))
    one, _ = files.only_match(there)
    return there.join(one.select("uid", F.lit(True).alias("alone")), "uid", "left").select("name", "length", F.coalesce("alone", F.lit(False)).alias("alone"))


def _runs(spark, sf) -> DataFrame:
    c = read_table(spark, sf, "customer")
    n = (F.col("c_custkey") * 7 % 50 * 1000).cast("string")
    return c.select(F.concat(F.lit("/runs/m"), F.col("c_nationkey") % 3, F.lit("/plant_"), F.col("c_nationkey"), F.lit("/point_cloud/iteration_"), n, F.when(F.col("c_custkey") % 2 == 0, "/point_cloud.ply").otherwise("/zz.ply")).alias("path")).distinct()


@query("""WITH f AS (SELECT DISTINCT 'm' || (c_nationkey % 3) AS method, 'plant_' || c_nationkey AS plant, (c_custkey * 7 % 50) * 1000 AS n, CASE WHEN c_custkey % 2 = 0 THEN 'point_cloud.ply' ELSE 'zz.ply' END AS name FROM customer)
SELECT method, plant, '/runs/' || method || '/' || plant || '/point_cloud/iteration_' || n || '/' || name AS path FROM (SELECT *, row_number() OVER (PARTITION BY method, plant ORDER BY n DESC, name = 'point_cloud.ply' DESC, name DESC) AS r FROM f) WHERE r = 1""")
def latest_iterations(spark, sf):
    return files.latest_iteration(files.runs_of(_runs(spark, sf)))


def _datasets(spark, sf) -> DataFrame:
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    root = F.concat(F.lit("/data/plant_"), F.col("k"))
    of = lambda base, inner, names: [F.concat(base, F.lit(f"/{inner}/{n}")) for n in names]
    model = ("cameras.bin", "images.bin", "points3D.bin")
    better = F.concat(root, F.lit("_undistorted"))
    every = F.array(*of(root, "images", ["a.png", "b.png"]), *of(root, "sparse", model), *of(root, "sparse/0", ["cameras.bin", "images.bin", "rigs.bin"]))
    some = F.when(F.col("k") % 3 == 0, F.array(*of(better, "images", ["a.png"]), *of(better, "sparse/0", model))).when(F.col("k") % 3 == 1, F.array(*of(better, "images", ["a.png"]), *of(better, "sparse/0", model[:2]))).otherwise(F.array().cast("array<string>"))
    return s.select("k", F.explode(F.concat(every, some)).alias("path")).withColumn("name", F.element_at(F.split("path", "/"), -1))


@query("SELECT s_suppkey AS k, '/data/plant_' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '_undistorted' ELSE '' END AS root FROM supplier")
def ready_datasets(spark, sf):
    return files.ready_datasets(_datasets(spark, sf), "k")


@query("""WITH n AS (SELECT 'plant_' || s_suppkey || '/images/' AS d, s_suppkey AS k FROM supplier) SELECT 'image' AS kind, d || 'b.png' AS name, '/data/' || d || 'b.png' AS path FROM n
UNION ALL SELECT 'extra', 'points3D.bin', '/data/plant_' || k || '/sparse/points3D.bin' FROM n UNION ALL SELECT 'extra', 'rigs.bin', '/data/plant_' || k || '/sparse/0/rigs.bin' FROM n UNION ALL SELECT 'extra', 'points3D.bin', '/data/plant_' || k || '_undistorted/sparse/0/points3D.bin' FROM n WHERE k % 3 = 0""")
def dataset_files(spark, sf):
    """Paths of named images, and the files of a model that are copied as they are."""
    d = cut(_datasets(spark, sf), "datasets")
    names = d.where("name = 'b.png'").select(F.concat(F.lit("plant_"), F.col("k"), F.lit("/images/b.png")).alias("name"))
    found = files.image_paths(names, d).select(F.lit("image").alias("kind"), "name", "path")
    rest = files.extras(d.where("path LIKE '%/sparse/%'")).select(F.lit("extra").alias("kind"), "name", "path")
    return found.union(rest)


@query("SELECT p_brand AS uid, CAST(p_size % 4 AS INTEGER) AS instance_id, count(*) AS n_points, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand, p_size % 4) AS INTEGER) AS place FROM part GROUP BY p_brand, p_size % 4")
def partitioned_instances(spark, sf):
    """One folder for each instance, and the summary by falling size; what is read back has as many rows."""
    folder = shared_path(spark, "instances")
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("uid"), (F.col("p_size") % 4).cast("int").alias("instance_id"), F.col("p_partkey").alias("vid"))
    summary = arrays.write_partitioned(p, folder)
    places = aggregates.numbered(summary.withColumn("_by", F.struct(-F.col("n_points"), "uid", "instance_id")), "_by", "place").select("uid", "instance_id", (F.col("place") + 1).cast("int").alias("place"))
    counts = spark.read.parquet(folder).groupBy("uid", "instance_id").agg(F.count(F.lit(1)).alias("n_points"))
    return counts.join(places, ["uid", "instance_id"]).select("uid", "instance_id", "n_points", "place")


@query("SELECT kind, p_brand AS uid, round(avg(p_size), 6) AS mean_size, count(*) AS n FROM part, (VALUES ('csv'), ('json')) v(kind) GROUP BY kind, p_brand")
def metric_files(spark, sf):
    folder = shared_path(spark, "metrics")
    m = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("uid")).agg(F.round(F.avg("p_size"), 6).alias("mean_size"), F.count(F.lit(1)).alias("n"))
    arrays.write_metrics(m, folder)
    kept = lambda kind, df: df.select(F.lit(kind).alias("kind"), "uid", F.col("mean_size").cast("double").alias("mean_size"), F.col("n").cast("long").alias("n"))
    return rounded(kept("csv", arrays.read_metrics(spark, [f"{folder}/csv"])).union(kept("json", spark.read.json(f"{folder}/json"))))


@query("SELECT 1 + row_number() OVER (ORDER BY s_suppkey) AS at, '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_suppkey || '.5 | ' || CASE WHEN s_nationkey > 5 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END || ' |' AS line FROM supplier UNION ALL SELECT 0, '| k | name | m | n |' UNION ALL SELECT 1, '| --- | --- | --- | --- |'")
def markdown_rows(spark, sf):
    """A summary table of all suppliers as a file, read back line by line."""
    path, k = shared_path(spark, "table") + "/summary.md", F.col("s_suppkey")
    arrays.write_markdown(read_table(spark, sf, "supplier").select(k.alias("k"), F.col("s_name").alias("name"), (k + F.lit(0.5)).alias("m"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")).alias("n")), path, "k")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    return lines.select(F.col("at").cast("long").alias("at"), "line")


@query(f"WITH {OVERLAP_SQL} SELECT uid, gt, " + ", ".join(f"round(max(iou) FILTER (WHERE pred = {p}), 6) AS P{p}" for p in range(1, 10)) + " FROM iou GROUP BY uid, gt")
def matrix_rows(spark, sf):
    return rounded(metrics.matrix_csv(metrics.iou_matrix(segments(spark, sf)), keys=("uid",)))
