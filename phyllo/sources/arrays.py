"""NPY and NPZ arrays as a data source; masks, sample tables and metric rows."""

from __future__ import annotations

import io
import os
import re
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from phyllo.operators.aggregates import numbered
from phyllo.session import cut
from phyllo.sources.stores import opened, write_joined, write_whole

STEP, BATCH = 200_000, 10_000


def _head(f) -> tuple[tuple[int, ...], np.dtype]:
    """(shape, type) of the array that begins here; ``f`` is left at its first value. Objects and column order are refused."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject:
        raise ValueError("pickled objects are not read")
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order are not read")
    return shape, dtype


def _opened(path: str, name: str | None):
    """An array's bytes from its head on: a file, or a member of an archive."""
    f = opened(path)
    return zipfile.ZipFile(f).open(f"{name}.npy") if name else f


def _shape(path: str, name: str | None) -> tuple[tuple[int, ...], np.dtype]:
    """An array's shape with all but the first axis as one, and its type."""
    with _opened(path, name) as f:
        shape, dtype = _head(f)
    return ((shape[0], int(np.prod(shape[1:]))) if len(shape) > 1 else (int(np.prod(shape)),)), dtype


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, name: str | None):
        self.path, self.name = path, name

    def partitions(self):
        n = _shape(self.path, self.name)[0][0]
        step = max(n, 1) if self.name else STEP  # a packed member is read from its start
        return [InputPartition((i, min(step, n - i))) for i in range(0, n, step)] or [InputPartition((0, 0))]

    def read(self, part):
        first, count = part.value
        shape, dtype = _shape(self.path, self.name)
        width = dtype.itemsize * (shape[1] if len(shape) > 1 else 1)
        with _opened(self.path, self.name) as f:
            _head(f)
            f.seek(f.tell() + first * width)
            for at in range(first, first + count, BATCH):
                n = min(BATCH, first + count - at)
                raw = f.read(n * width)
                if len(raw) < n * width:
                    raise ValueError(f"{self.path}: the file is cut off")
                rows = np.frombuffer(raw, dtype)
                if len(shape) > 1:
                    flat = pa.array(rows.astype(np.float32))
                    value = pa.ListArray.from_arrays(pa.array(np.arange(0, n * shape[1] + 1, shape[1], dtype=np.int32)), flat)
                else:
                    value = pa.array(rows.astype(_scalar(dtype)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), value], names=["vid", "value"])


def _scalar(dtype: np.dtype) -> str:
    return {"b": "bool", "f": "float64"}.get(dtype.kind, "int64")


class NpyDataSource(DataSource):
    """``format("npy")``: ``vid`` (the place) and ``value``: a number, a truth value, or for matrices an array of floats.

    Option ``array`` names an array of an ``.npz`` archive. Pickled objects are
    refused. Files are read by place with pyarrow's file systems, in parts.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _of(self) -> tuple[str, str | None]:
        return self.options["path"], self.options.get("array")

    def schema(self) -> str:
        shape, dtype = _shape(*self._of())
        kind = "array<float>" if len(shape) > 1 else {"bool": "boolean", "float64": "double", "int64": "bigint"}[_scalar(dtype)]
        return f"vid bigint, value {kind}"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(*self._of())


def read_npy(spark: SparkSession, path: str, value: str = "value", uid: str | None = None, array: str | None = None) -> DataFrame:
    """An array, of an archive if it is named, with its column named and the cloud's id beside it if given."""
    spark.dataSource.register(NpyDataSource)
    reader = spark.read.format("npy")
    df = (reader if array is None else reader.option("array", array)).load(path).withColumnRenamed("value", value)
    return df if uid is None else df.select(F.lit(uid).alias("uid"), "*")


def read_npz(spark: SparkSession, path: str, name: str, uid: str = "") -> DataFrame:
    """``(uid, vid, value)`` of one array of an archive."""
    return read_npy(spark, path, uid=uid, array=name)


def read_cloud_npz(spark: SparkSession, path: str, uid: str = "") -> DataFrame:
    """``(uid, vid, x, y, z, red, green, blue[, feat])`` of an archive with ``coord`` and maybe ``color`` (white by default) and ``feat``.

    Pickled dictionaries are not loaded; they are turned into archives offline.
    """
    with opened(path) as f:
        there = set(zipfile.ZipFile(f).namelist())
    spread = lambda df, names: df.select("vid", *[F.col("value")[i].cast("double").alias(c) for i, c in enumerate(names)])
    colors = ("red", "green", "blue")
    out = spread(read_npy(spark, path, array="coord"), "xyz")
    out = out.join(spread(read_npy(spark, path, array="color"), colors), "vid") if "color.npy" in there else out.withColumns({c: F.lit(1.0) for c in colors})
    if "feat.npy" in there:
        out = out.join(read_npy(spark, path, "feat", array="feat"), "vid")
    return out.select(F.lit(uid).alias("uid"), "*")


def _npy_head(shape: tuple[int, ...], dtype: np.dtype) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return head.getvalue()


def _value_bytes(df: DataFrame, value: str, vid: str, dtype: np.dtype) -> DataFrame:
    """``(at, n, raw)``: the values of runs of vertices in order, whose ids must be 0..n-1 without a gap."""
    ordered = df.select(F.col(vid).cast("long").alias("vid"), F.col(value).alias("value")).repartitionByRange("vid").sortWithinPartitions("vid")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            if (np.diff(ids) != 1).any():
                raise ValueError(f"vertex {int(ids[np.flatnonzero(np.diff(ids) != 1)[0]]) + 1} is missing or repeated")
            raw = np.array(b.column(1).to_pylist(), dtype).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([raw], pa.binary())], names=["at", "n", "raw"])

    return cut(ordered.mapInArrow(run, "at long, n long, raw binary"), "npy-parts")


def write_npy(df: DataFrame, path: str, value: str, vid: str = "vid", dtype: str = "int32") -> int:
    """One value (or one array of equal length) for each vertex in vertex order; ids must be 0..n-1. Tasks make the bytes and one joins them."""
    try:
        parts = _value_bytes(df, value, vid, np.dtype(dtype))
    except Exception as e:
        if "is missing or repeated" in str(e):
            raise ValueError("a vertex is missing or repeated") from e
        raise
    from pyspark.sql import Window as W

    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.min("at"), F.lit(0)).alias("first")).first()
    gaps = parts.select("at", (F.lag(F.col("at") + F.col("n")).over(W.orderBy("at"))).alias("due")).where("due <> at").limit(1).count()  # a row for each part
    if gaps or whole["first"]:
        raise ValueError("a vertex is missing or repeated")
    one = df.select(value).first()
    shape = (whole["n"], len(one[0])) if one is not None and isinstance(one[0], list) else (whole["n"],)
    write_joined(parts, path, _npy_head(shape, np.dtype(dtype)))
    return int(whole["n"])


def write_npz(parts: dict[str, str], path: str) -> None:
    """An archive of arrays that have been written as ``.npy`` files: name to path. Members are stored, not packed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, part in parts.items():
            with opened(part) as f:
                z.writestr(f"{name}.npy", f.read())
    write_whole(path, out.getvalue())


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """``(uid, cluster_id)`` of a CSV with ``uid, cluster_ids``, a list with plain or full-width commas."""
    from phyllo.functions.scalars import parse_id_list

    rows = spark.read.csv(path, header=True)
    return rows.select("uid", F.explode(parse_id_list("cluster_ids")).alias("cluster_id"))


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metric rows of one-row CSV files under the union of their columns."""
    from phyllo.operators.aggregates import union_of_columns

    return union_of_columns([spark.read.csv(p, header=True) for p in paths])


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """Click metadata: JSON files, those of a folder or all that a pattern names; clicks of more than one source raise.

    The files, which are small and may be many, are opened once: their texts go
    into few files of a line each, and those are read from then on. A pattern is
    taken apart, so that its folder is listed and its files are not looked up one
    by one.
    """
    from phyllo.session import shared_path

    folder, _, last = path.rstrip("/").rpartition("/")
    if re.search(r"[*?\[{]", last) and not re.search(r"[*?\[{]", folder):
        texts = spark.read.option("pathGlobFilter", last).text(folder or "/", wholetext=True)
    else:
        texts = spark.read.text(path, wholetext=True)
    line = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "[\r\n]+", " ")  # strings of JSON have no bare line ends
    flat = shared_path(spark, "clicks")
    texts.select(line.alias("value")).write.text(flat)
    rows = spark.read.json(flat)
    sources = rows.agg(F.count_distinct("source_ply").alias("n")).first()["n"]
    if sources > 1:
        raise ValueError(f"clicks of {sources} sources")
    return rows


def train_time(spark: SparkSession, path: str) -> DataFrame:
    """``(path, train_time_sec)``: the first TRAIN_TIME_SEC of each log; null if none."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    found = F.nullif(F.regexp_extract("value", r"TRAIN_TIME_SEC=([0-9.]+)", 1), F.lit(""))
    return logs.select("path", found.cast("double").alias("train_time_sec"))


def dir_size_mb(spark: SparkSession, path: str) -> float:
    """Size of all files below a folder in MiB; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return float(files.agg(F.coalesce(F.sum("length"), F.lit(0)) / 1048576).first()[0])


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("uid", "instance_id"), mode: str = "errorifexists", most: int | None = None) -> DataFrame:
    """One folder for each instance, and the summary ``(*by, n_points)`` by falling size; with ``most``, only the largest are written."""
    summary = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points")).orderBy(F.desc("n_points"), *by)
    rows = df if most is None else df.join(summary.limit(most), list(by), "left_semi")
    rows.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    return summary


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows as CSV and as JSON; a row for each run, so one file of each."""
    df.coalesce(1).write.mode(mode).csv(os.path.join(path, "csv"), header=True)
    df.coalesce(1).write.mode(mode).json(os.path.join(path, "json"))


@F.pandas_udf(StringType())
def _six_digits(v: pd.Series) -> pd.Series:
    return v.map(lambda x: f"{x:.6g}", na_action="ignore")


def markdown_lines(df: DataFrame, order: str) -> DataFrame:
    """``(at, line)`` of a summary table in the order of a column without ties: numbers with six significant digits, nothing for nulls."""
    show = lambda c, kind: F.coalesce(_six_digits(F.col(c).cast("double")) if kind in ("float", "double") else F.col(c).cast("string"), F.lit(""))
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    lines = numbered(df.select(F.col(order).alias("_by"), row([show(c, k) for c, k in df.dtypes]).alias("line")), "_by", "at")
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "| " + " | ".join("---" for _ in df.columns) + " |")], "at long, line string")
    return head.unionByName(lines.select((F.col("at") + 2).alias("at"), "line"))


def write_markdown(df: DataFrame, path: str, order: str) -> int:
    """A summary table as a file, which one task writes; its size."""
    lines = markdown_lines(df, order)
    return write_joined(lines.select("at", F.concat("line", F.lit("\n")).cast("binary").alias("raw")), path, b"")
