"""Cameras and images of COLMAP binary models as data sources, with byte-exact writers."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phyllo.functions.scalars import CAMERA_MODELS
from phyllo.session import cut
from phyllo.sources.stores import exists, opened, write_joined

CAMERA_SCHEMA = "camera_id int, model_id int, width bigint, height bigint, params array<double>"
IMAGE_SCHEMA = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string"
POINTS = "points2d array<struct<x: double, y: double, point3d_id: bigint>>"


def sparse_dir(root: str) -> str:
    """``sparse/0`` of a dataset, else ``sparse``."""
    for folder in (os.path.join(root, "sparse", "0"), os.path.join(root, "sparse")):
        if exists(os.path.join(folder, "cameras.bin")):
            return folder
    raise FileNotFoundError(f"no sparse model below {root}")


#: Images of a batch of observations, and bytes of a file that a task reads.
IMAGES, PART_BYTES = 256, 32 << 20
_SPOT = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")])


def _bytes(f, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("the file is cut off")
    return raw


def _take(f, form: str) -> tuple:
    return struct.unpack(form, _bytes(f, struct.calcsize(form)))


def camera_rows(path: str):
    with opened(path) as f:
        for _ in range(_take(f, "<Q")[0]):
            camera, model, width, height = _take(f, "<iiQQ")
            if model not in CAMERA_MODELS:
                raise ValueError(f"{path}: unknown camera model {model}")
            yield camera, model, width, height, list(_take(f, f"<{CAMERA_MODELS[model][1]}d"))


def _name(f) -> str:
    """Text up to a zero byte, looked for in what the reader holds."""
    out = b""
    while True:
        ahead = f.peek(1)
        if not ahead:
            raise ValueError("the file is cut off")
        end = ahead.find(b"\0")
        out += f.read(len(ahead) if end < 0 else end)
        if end >= 0:
            f.read(1)
            return out.decode()


def image_parts(path: str, size: int) -> list[tuple[int, int]]:
    """``(offset, images)`` of runs of whole images of about ``size`` bytes: from one pass over their heads, which skips what lies between."""
    parts, last = [], None
    with opened(path, 4096) as f:
        for at in range(_take(f, "<Q")[0]):
            begin = f.tell()
            if last is None or begin - parts[-1][0] >= size:
                parts.append((begin, 0))
            f.seek(struct.calcsize("<idddddddi"), os.SEEK_CUR)
            _name(f)
            f.seek(24 * _take(f, "<Q")[0], os.SEEK_CUR)
            parts[-1], last = (parts[-1][0], parts[-1][1] + 1), at
    return parts


def image_batches(part: tuple[str, int, int], points: bool = True):
    """Arrow batches of a run of images ``(path, offset, images)``; observations are taken as they lie in the file."""
    path, offset, images = part
    spots = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("point3d_id", pa.int64())])
    names = ["image_id", "qvec", "tvec", "camera_id", "name"] + ["points2d"] * points

    def out(rows):
        ids, poses, cameras, texts, seen = zip(*rows, strict=True)
        lists = lambda a, b: pa.array([p[a:b] for p in poses], pa.list_(pa.float64()))
        columns = [pa.array(ids, pa.int32()), lists(0, 4), lists(4, 7), pa.array(cameras, pa.int32()), pa.array(texts)]
        if points:
            flat = np.concatenate(seen)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in seen])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[n])) for n in _SPOT.names], fields=list(spots))
            columns.append(pa.ListArray.from_arrays(pa.array(ends), values))
        return pa.RecordBatch.from_arrays(columns, names=names)

    with opened(path) as f:
        f.seek(offset)
        rows = []
        for _ in range(images):
            image, *pose, camera = _take(f, "<idddddddi")
            name, n = _name(f), _take(f, "<Q")[0]
            if points:
                seen = np.frombuffer(_bytes(f, 24 * n), _SPOT)
            else:
                f.seek(24 * n, os.SEEK_CUR)
                seen = None
            rows.append((image, pose, camera, name, seen))
            if len(rows) == IMAGES:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


class _Reader(DataSourceReader):
    def __init__(self, rows, path: str, *args):
        self.rows, self.path, self.args = rows, path, args

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, part):
        yield from self.rows(part.value, *self.args)


class _ImageReader(DataSourceReader):
    """Images dealt to tasks by runs of about so many bytes."""

    def __init__(self, path: str, points: bool, size: int):
        self.path, self.points, self.size = path, points, size

    def partitions(self):
        return [InputPartition((self.path, *part)) for part in image_parts(self.path, self.size)] or [InputPartition((self.path, 0, 0))]

    def read(self, part):
        yield from image_batches(part.value, self.points)


class ColmapCameras(DataSource):
    """``format("colmap_cameras")`` of a ``cameras.bin``."""

    @classmethod
    def name(cls) -> str:
        return "colmap_cameras"

    def schema(self) -> str:
        return CAMERA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(camera_rows, self.options["path"])


class ColmapImages(DataSource):
    """``format("colmap_images")`` of an ``images.bin``.

    Options: ``points2d`` false leaves the observations out; ``part_bytes``, about
    how much of the file a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "colmap_images"

    def _points(self) -> bool:
        return str(self.options.get("points2d", "true")).lower() != "false"

    def schema(self) -> str:
        return f"{IMAGE_SCHEMA}, {POINTS}" if self._points() else IMAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ImageReader(self.options["path"], self._points(), int(self.options.get("part_bytes", PART_BYTES)))


def read_model(spark: SparkSession, root: str, points2d: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cameras, images) of a dataset's sparse model."""
    spark.dataSource.register(ColmapCameras)
    spark.dataSource.register(ColmapImages)
    folder = sparse_dir(root)
    cameras = spark.read.format("colmap_cameras").load(os.path.join(folder, "cameras.bin"))
    images = spark.read.format("colmap_images").option("points2d", str(points2d).lower()).load(os.path.join(folder, "images.bin"))
    return cameras, images


def _write(rows: DataFrame, path: str, key: str, pack) -> None:
    """A count and the packed rows by rising key; tasks pack them, and one joins them behind the count."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r[key]], pa.int64()), pa.array([pack(r)], pa.binary())], names=["at", "raw"])

    packed = cut(rows.mapInArrow(run, "at long, raw binary"), "colmap")
    write_joined(packed, path, struct.pack("<Q", packed.count()))


def write_cameras(cameras: DataFrame, path: str) -> None:
    """``cameras.bin`` by rising id."""
    _write(cameras.select("camera_id", "model_id", "width", "height", "params"), path, "camera_id", lambda r: struct.pack("<iiQQ", r["camera_id"], r["model_id"], r["width"], r["height"]) + struct.pack(f"<{len(r['params'])}d", *r["params"]))


def write_images(images: DataFrame, path: str) -> None:
    """``images.bin`` by rising id."""

    def pack(r: dict) -> bytes:
        seen = np.array([(p["x"], p["y"], p["point3d_id"]) for p in r["points2d"]], _SPOT)
        return struct.pack("<idddddddi", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(seen)) + seen.tobytes()

    _write(images.select("image_id", "qvec", "tvec", "camera_id", "name", F.col("points2d")), path, "image_id", pack)
