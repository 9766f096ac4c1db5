"""PLY vertex tables as a Spark data source, and their writers."""

from __future__ import annotations

import itertools
import json
import posixpath
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from phyllo.session import cut
from phyllo.sources.stores import exists, files_of, opened, store, write_joined, write_whole

# Names of the format's scalar types.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: Spark has no unsigned types: each is widened.
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
ARROW = {"i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}
WRITTEN = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "int", "float": "float", "double": "double", "boolean": "uchar"}
#: Vertices of a partition of a binary file, and of a batch.
CHUNK, BATCH = 500_000, 65_536


class PlyError(ValueError):
    """A file that breaks the format's rules."""


@dataclass(frozen=True)
class Header:
    """Where a file's vertices begin, how many there are, and their properties."""

    size: int
    ascii: bool
    count: int
    properties: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, f"<{t}") for n, t in self.properties])


def read_header(path: str) -> Header:
    """The header; only properties of ``vertex`` count, which must be the first element and hold no lists."""
    with opened(path) as f:
        if f.readline().strip() != b"ply":
            raise PlyError(f"{path}: no PLY file")
        kind, element, count, found, before = "", "", -1, [], 0
        for line in iter(f.readline, b""):
            words = line.decode("ascii", "replace").split()
            if not words:
                continue
            if words[0] == "end_header":
                break
            if words[0] == "format":
                kind = words[1]
            elif words[0] == "element":
                element = words[1]
                if element == "vertex":
                    count = int(words[2])
                elif count < 0:
                    before += 1
            elif words[0] == "property" and element == "vertex":
                if words[1] == "list":
                    raise PlyError(f"{path}: list properties of vertices are not read")
                found.append((words[2], TYPES[words[1]]))
        else:
            raise PlyError(f"{path}: no end_header")
        if count < 0:
            raise PlyError(f"{path}: no vertex element")
        if before:
            raise PlyError(f"{path}: another element comes before the vertices")
        if kind not in ("ascii", "binary_little_endian"):
            raise PlyError(f"{path}: format {kind!r} is not read")
        return Header(f.tell(), kind == "ascii", count, tuple(found))


def require(header: Header, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in dict(header.properties)]
    if missing:
        raise PlyError(f"missing properties: {', '.join(missing)}")


@dataclass
class VertexRange(InputPartition):
    path: str
    first: int
    count: int


#: What can be pushed down: comparisons of numbers, as a rule for values and one for the least and largest of a range. NaN is the largest of all.
COMPARED = {
    EqualTo: (lambda v, x: v == x, lambda lo, hi, nan, x: lo <= x <= hi),
    GreaterThan: (lambda v, x: (v > x) | np.isnan(v), lambda lo, hi, nan, x: nan or hi > x),
    GreaterThanOrEqual: (lambda v, x: (v >= x) | np.isnan(v), lambda lo, hi, nan, x: nan or hi >= x),
    LessThan: (lambda v, x: v < x, lambda lo, hi, nan, x: lo < x),
    LessThanOrEqual: (lambda v, x: v <= x, lambda lo, hi, nan, x: lo <= x),
}


SIGNS = {"=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual}


class PlyReader(DataSourceReader):
    def __init__(self, paths: list[str], options: dict, names: list[str]):
        self.paths, self.prefix, self.names = paths, options.get("mode", "FAILFAST").upper() == "PREFIX", names
        self.required = tuple(n for n in options.get("required", "").split(",") if n)
        self.rows = int(options.get("range_rows", CHUNK))
        self.pushed: list[tuple[str, type, float]] = [(c, SIGNS[sign], value) for c, sign, value in json.loads(options.get("keep", "[]"))]
        self.there: list[str] = []
        if unknown := {c for c, _, _ in self.pushed} - {"vid", *names}:
            raise PlyError(f"missing properties: {', '.join(sorted(unknown))}")

    def partitions(self):
        found = []
        for path in self.paths:
            header = read_header(path)
            require(header, self.required)
            step = max(header.count, 1) if header.ascii else self.rows
            ranges = [VertexRange(path, i, min(step, header.count - i)) for i in range(0, header.count, step)] or [VertexRange(path, 0, 0)]
            found += self._possible(path, header, ranges) if self.pushed or self.there else ranges
        return found

    def _possible(self, path: str, header: Header, ranges: list[VertexRange]) -> list[VertexRange]:
        """The ranges in which every pushed comparison may hold, by their places and by the file's table of ranges, if it has one."""
        if ({c for c, _, _ in self.pushed} | {*self.there}) - {"vid", *dict(header.properties)}:
            return []  # a property that is not there is null
        table = read_ranges(path)

        def may(part: VertexRange) -> bool:
            for column, kind, value in self.pushed:
                if column == "vid":
                    held = [(part.first, part.first + part.count - 1, False)]
                else:
                    held = [r[column] for r in table if r["first"] < part.first + part.count and part.first < r["first"] + r["count"]]
                if held and not any(COMPARED[kind][1](*ends, value) for ends in held):
                    return False
            return True

        return [part for part in ranges if may(part)]

    def _kept(self, rows: np.ndarray, first: int) -> np.ndarray:
        """Which rows of a block all pushed comparisons hold for."""
        kept = np.ones(len(rows), bool)
        for column, kind, value in self.pushed:
            values = np.arange(first, first + len(rows)) if column == "vid" else rows[column]
            exact = values.astype(np.float64) if values.dtype.kind == "f" else values.astype(np.int64)
            kept &= COMPARED[kind][0](exact, value)
        return kept

    def read(self, part: VertexRange | None):
        if part is None:  # there is no range to read
            return
        header = read_header(part.path)
        stem, kinds, at = posixpath.basename(part.path).rsplit(".", 1)[0], dict(header.properties), part.first
        for rows in self._ascii(part, header) if header.ascii else self._binary(part, header):
            places, read = np.arange(at, at + len(rows), dtype=np.int64), len(rows)
            if self.pushed:
                kept = self._kept(rows, at)
                rows, places = rows[kept], places[kept]
            columns = [pa.array([stem] * len(rows), pa.string()), pa.array(places)]
            columns += [pa.array(np.ascontiguousarray(rows[n])).cast(ARROW[kinds[n]]) if n in kinds else pa.nulls(len(rows), pa.float32()) for n in self.names]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "vid", *self.names])
            at += read
        if at < part.first + part.count and not self.prefix:
            raise PlyError(f"{part.path}: {at} of {header.count} vertices are there")

    @staticmethod
    def _binary(part: VertexRange, header: Header):
        with opened(part.path) as f:
            f.seek(header.size + part.first * header.dtype.itemsize)
            for at in range(0, part.count, BATCH):
                raw = f.read(min(BATCH, part.count - at) * header.dtype.itemsize)
                yield np.frombuffer(raw, header.dtype, count=len(raw) // header.dtype.itemsize)

    def _ascii(self, part: VertexRange, header: Header):
        done, width = 0, len(header.properties)
        with opened(part.path) as f:
            f.seek(header.size)
            lines = (line for line in f if not line.isspace())
            while block := list(itertools.islice(lines, min(BATCH, part.count - done))):
                try:
                    values, bad = np.loadtxt(block, np.float64, comments=None, ndmin=2), False
                    bad = values.shape[1] != width
                except ValueError:
                    bad = True
                if bad:  # up to the line that is wrong
                    good = []
                    for line in block:
                        try:
                            good.append([float(w) for w, _ in zip(line.split(), header.properties, strict=True)])
                        except ValueError:
                            break
                    if not self.prefix:
                        raise PlyError(f"{part.path}: vertex {done + len(good)} is malformed")
                    values = np.array(good, np.float64).reshape(-1, width)
                rows = np.empty(len(values), header.dtype)
                for i, (n, t) in enumerate(header.properties):
                    rows[n] = values[:, i].astype(f"<{t}")
                yield rows
                done += len(rows)
                if bad:
                    return


class FilteredPlyReader(PlyReader):
    """A reader that decides comparisons of the query; the other one is for sessions that don't push filters down to Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
            if column in ("vid", *self.names) and type(f) in COMPARED and number:
                self.pushed.append((column, type(f), value))
            elif column in ("vid", *self.names) and isinstance(f, IsNotNull):
                self.there.append(column)
            else:
                yield f


def ranges_path(path: str) -> str:
    """Where a file's table of ranges is kept."""
    return f"{path}.ranges.json"


def read_ranges(path: str) -> list[dict]:
    """Rows ``{first, count, property: [least, largest, whether NaN is there]}`` of a file's table of ranges; none if there is no table or it is of other bytes."""
    if not exists(ranges_path(path)):
        return []
    with opened(ranges_path(path)) as f:
        said = json.loads(f.read())
    system, inner = store(path)
    info = system.get_file_info(inner)
    return said["ranges"] if [info.size, info.mtime_ns] == said["of"] else []


def write_ranges(spark: SparkSession, path: str, rows: int = CHUNK) -> int:
    """Keep the least and largest value of every property in every ``rows`` vertices of a file or folder beside each file, for readers to skip by; how many ranges there are.

    Spark reads the files once; the driver gets one row for each range. A file
    that is written anew needs its table written anew: until then it has none.
    """
    table = read_ply(spark, path)
    names = [c for c in table.columns if c not in ("uid", "vid")]
    of = lambda c: F.struct(F.min(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))).alias("lo"), F.max(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))).alias("hi"), F.coalesce(F.bool_or(F.isnan(F.col(f"`{c}`").cast("double"))), F.lit(False)).alias("nan")).alias(c)
    found = table.groupBy("uid", F.expr(f"vid div {rows}").alias("at")).agg(F.count(F.lit(1)).alias("count"), *[of(c) for c in names]).collect()
    for file in files_of(path, ".ply"):
        stem = posixpath.basename(file).rsplit(".", 1)[0]
        system, inner = store(file)
        info = system.get_file_info(inner)
        ends = lambda v: [v["lo"], v["hi"], v["nan"]] if v["lo"] is not None else [float("inf"), float("-inf"), v["nan"]]
        said = [{"first": r["at"] * rows, "count": r["count"], **{c: ends(r[c]) for c in names if c in dict(read_header(file).properties)}} for r in found if r["uid"] == stem]
        write_whole(ranges_path(file), json.dumps({"of": [info.size, info.mtime_ns], "ranges": said}).encode())
    return len(found)


class PlyDataSource(DataSource):
    """``format("ply")``: ``uid`` (the file's stem), ``vid`` (the vertex's place) and the properties of a file or a folder of files.

    Options: ``path``; ``mode`` FAILFAST or PREFIX (keep the whole vertices of a
    cut-off file); ``required``, a comma list of properties that must be there;
    ``columns``, a comma list of the properties to read, all by default;
    ``range_rows``, vertices of a task's range of a binary file; ``keep``, a JSON
    list of comparisons ``[column, sign, number]`` of ``vid`` and properties that all
    must hold. Ranges in which they can't are not read: by their place, or by the
    table that ``write_ranges`` keeps beside a file. With ``pushdown`` true, and
    ``spark.sql.python.filterPushdown.enabled``, comparisons of the query itself
    are decided here too. Read anew for every query then: in Spark 4.1 a frame
    keeps the filters of an earlier query where a later one has none to push.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _paths(self) -> list[str]:
        return files_of(self.options["path"], ".ply")

    def _properties(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for path in self._paths():
            for n, t in read_header(path).properties:
                if found.setdefault(n, t) != t:
                    raise PlyError(f"{path}: property {n} has another type than in the other files")
        if wanted := [n for n in self.options.get("columns", "").split(",") if n]:
            if missing := [n for n in wanted if n not in found]:
                raise PlyError(f"missing properties: {', '.join(missing)}")
            found = {n: found[n] for n in wanted}
        return found

    def schema(self) -> str:
        return ", ".join(["uid string", "vid bigint"] + [f"`{n}` {SPARK[t]}" for n, t in self._properties().items()])

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredPlyReader if self.options.get("pushdown", "false").lower() == "true" else PlyReader
        return kind(self._paths(), dict(self.options), list(self._properties()))


def read_ply(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The vertex table of a file or folder; ``options`` are those of ``PlyDataSource``: ``columns`` prunes columns, ``keep`` vertices and whole ranges of them."""
    spark.dataSource.register(PlyDataSource)
    return spark.read.format("ply").options(**options).load(path)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """``(uid, vid, x, y, z)`` as doubles; a file without coordinates raises."""
    return read_ply(spark, path, columns="x,y,z", required="x,y,z").select("uid", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])


def count_vertices(path: str) -> int:
    """From the header alone."""
    return read_header(path).count


def _ply_type(name: str, kind: str, unsigned: tuple[str, ...]) -> str:
    if kind == "string":
        raise PlyError(f"column {name} is text, which vertices can't hold")
    return "uchar" if name in unsigned else WRITTEN[kind]


def write_ply(df: DataFrame, path: str, mode: str = "errorifexists", ascii: bool = False, vid: str = "vid", unsigned: tuple[str, ...] = ("red", "green", "blue")) -> int:
    """Write the columns other than ``uid`` and ``vid``, in their order and in vertex order; the number of vertices.

    Tasks turn their share of the ordered rows into bytes; the shares are kept in
    the shared folder, and one task joins them behind the header.
    """
    if exists(path):
        if mode == "errorifexists":
            raise FileExistsError(path)
        if mode == "ignore":
            return count_vertices(path)
    names = [c for c in df.columns if c not in ("uid", vid)]
    kinds = {n: _ply_type(n, df.schema[n].dataType.simpleString(), unsigned) for n in names}
    dtype = np.dtype([(n, f"<{TYPES[t]}") for n, t in kinds.items()])
    ordered = df.select(*([vid] if vid in df.columns else []), *names)
    ordered = ordered.sort(vid) if vid in df.columns else ordered

    def run(batches):
        for b in batches:
            rows = np.zeros(b.num_rows, dtype)
            for n in names:
                rows[n] = b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            raw = "".join(" ".join(map(repr, r.tolist())) + "\n" for r in rows).encode() if ascii else rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([raw], pa.binary())], names=["n", "raw"])

    parts = cut(ordered.mapInArrow(run, "n long, raw binary").withColumn("at", F.monotonically_increasing_id()), "ply-parts")
    count = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", f"element vertex {count}", *[f"property {t} {n}" for n, t in kinds.items()], "end_header"]
    write_joined(parts, path, "\n".join(lines).encode() + b"\n")
    return int(count)


def write_cloud(df: DataFrame, path: str, default: int = 180, **options) -> int:
    """Plain x, y, z, red, green, blue; grey where there are no colours."""
    from phyllo.functions.scalars import resolve_color

    colored = resolve_color(df, default)
    return write_ply(colored.select(*[c for c in ("vid",) if c in df.columns], *[F.col(c).cast("float").alias(c) for c in "xyz"], *[F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue")]), path, **options)


def write_instances(df: DataFrame, path: str, **options) -> int:
    """x, y, z and ``instance_id`` as a float."""
    return write_ply(df.select("vid", *[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("instance_id").cast("float").alias("instance_id")), path, **options)


def write_labelled(df: DataFrame, path: str, **options) -> int:
    """x, y, z, colours and a whole-number ``label``."""
    return write_ply(df.select("vid", *[F.col(c).cast("float").alias(c) for c in "xyz"], *[F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue")], F.col("label").cast("int").alias("label")), path, **options)


def add_rgb(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """``df`` with colours, cut off to whole numbers, from its harmonics, which must be there; existing colours raise unless overwritten."""
    from phyllo.functions.scalars import sh_to_rgb_trunc

    if not all(f"f_dc_{i}" in df.columns for i in range(3)):
        raise PlyError("missing properties: f_dc_0, f_dc_1, f_dc_2")
    if not overwrite and any(c in df.columns for c in ("red", "green", "blue")):
        raise PlyError("the vertices have colours already")
    return df.withColumns({c: sh_to_rgb_trunc(f"f_dc_{i}").cast("smallint") for i, c in enumerate(("red", "green", "blue"))})
