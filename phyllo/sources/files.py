"""Catalogues of files: discovery, latest iterations, readiness of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, name, length)`` of all files below a folder whose name fits; contents are not read, and empty files are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def only_match(files: DataFrame, keys: tuple[str, ...] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """(``(*keys, path)`` of keys with one file, ``(*keys, n)`` of those with more)."""
    counts = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return counts.where("n = 1").select(*keys, "path"), counts.where("n > 1").select(*keys, "n")


def latest_iteration(files: DataFrame, keys: tuple[str, ...] = ("method", "plant"), path: str = "path") -> DataFrame:
    """``(*keys, path)``: of ``.ply`` files below ``iteration_<n>`` the one of the largest number, ``point_cloud.ply`` before others, then the last name."""
    number = F.expr(f"try_cast(regexp_extract({path}, 'iteration_([0-9]+)/', 1) AS bigint)")
    rows = files.where(F.col(path).endswith(".ply")).withColumn("_n", number).where("_n IS NOT NULL")
    return rows.groupBy(*keys).agg(F.max_by(path, F.struct("_n", F.col(path).endswith("/point_cloud.ply"), path)).alias(path))


def runs_of(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``method`` and ``plant`` from ``<method>/<plant>/point_cloud/``."""
    found = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/point_cloud/", i)
    return files.withColumns({"method": found(1), "plant": found(2)}).where("method <> ''")


def ready_datasets(files: DataFrame, key: str = "plant", path: str = "path", prefer: str = "_undistorted") -> DataFrame:
    """``(key, root)`` of datasets with images and all three model files below ``sparse/0`` or ``sparse``; a root with the preferred ending wins."""
    root = F.regexp_extract(path, r"^(.*)/(?:sparse(?:/0)?|images)/[^/]+$", 1)
    rows = files.withColumn("root", root).where("root <> ''")
    model = lambda inner: F.count_distinct(F.when(F.col(path).rlike(rf"/{inner}/(cameras|images|points3D)\.bin$"), F.element_at(F.split(path, "/"), -1)))
    agg = rows.groupBy(key, "root").agg(F.count_if(F.col(path).rlike("/images/[^/]+$")).alias("n"), model("sparse/0").alias("a"), model("sparse").alias("b"))
    ok = agg.where("n > 0 AND (a = 3 OR b = 3)")
    return ok.groupBy(key).agg(F.max_by("root", F.struct(F.col("root").endswith(prefer), "root")).alias("root"))


def image_paths(images: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, path)``: ``images/<name>`` if there, else ``<name>``, of equals the shortest path, then the first.

    A file answers to every end of its path that begins after a slash, and names
    are met by equality; so files of one last name are not all compared.
    """
    steps = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    known = files.select("path").where(F.col("path").contains("/")).select("path", F.explode(ends).alias("name"))
    order = F.struct((~F.col("path").endswith(F.concat(F.lit("/images/"), F.col("name")))).alias("a"), F.length("path").alias("b"), F.col("path").alias("c"))
    best = known.groupBy("name").agg(F.min_by("path", order).alias("path"))  # an end that all paths share is one row of a task
    return best.join(images.select("name").distinct().hint("merge"), "name")


def extras(files: DataFrame, written: tuple[str, ...] = ("cameras.bin", "images.bin")) -> DataFrame:
    """Files of a model that are copied as they are."""
    return files.where(~F.col("name").isin(*written))
