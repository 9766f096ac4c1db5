"""Scalar functions of vertices, labels and cameras as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.operators.grouped import per_group
from phyllo.operators.quantiles import with_quantiles

# Fixed value: the constant of the zeroth spherical harmonic.
SH_C0 = 0.28209479177387814
# Camera models as id: (name, number of parameters, places of cx and cy).
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3, (1, 2)),
    1: ("PINHOLE", 4, (2, 3)),
    2: ("SIMPLE_RADIAL", 4, (1, 2)),
    3: ("RADIAL", 5, (1, 2)),
    4: ("OPENCV", 8, (2, 3)),
    5: ("OPENCV_FISHEYE", 8, (2, 3)),
    6: ("FULL_OPENCV", 12, (2, 3)),
    7: ("FOV", 5, (2, 3)),
    8: ("SIMPLE_RADIAL_FISHEYE", 4, (1, 2)),
    9: ("RADIAL_FISHEYE", 5, (1, 2)),
    10: ("THIN_PRISM_FISHEYE", 12, (2, 3)),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """False for null, NaN and both infinities; Spark alone would hold NaN above every number."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def sh_to_rgb_trunc(f: Column | str) -> Column:
    """Harmonic to 0..255, cut off: 0 gives 127."""
    return clip((col(f).cast("double") * SH_C0 + 0.5) * 255, 0.0, 255.0).cast("int")


def sh_to_rgb_rint(f: Column | str) -> Column:
    """Harmonic to 0..255, rounded half to even: 0 gives 128."""
    return F.rint(clip(col(f).cast("double") * SH_C0 + 0.5, 0.0, 1.0) * 255).cast("int")


def sh_to_unit(f: Column | str) -> Column:
    """Harmonic to 0..1."""
    return clip(col(f).cast("double") * SH_C0 + 0.5, 0.0, 1.0)


def clamp_color(c: Column | str) -> Column:
    """Rounded half to even, then drawn into 0..255."""
    return clip(F.rint(col(c).cast("double")), 0.0, 255.0).cast("int")


def resolve_color(df: DataFrame, default: float = 180.0) -> DataFrame:
    """``red, green, blue`` from the table's own colours, else from its harmonics, else a constant."""
    names = ("red", "green", "blue")
    if all(n in df.columns for n in names):
        return df
    if all(f"f_dc_{i}" in df.columns for i in range(3)):
        return df.withColumns({n: sh_to_rgb_rint(f"f_dc_{i}") for i, n in enumerate(names)})
    return df.withColumns({n: F.lit(default) for n in names})


def fill_color(df: DataFrame, colors: DataFrame, on: list[str], default: int = 180) -> DataFrame:
    """Colours of ``colors`` by key; rows without one get a grey."""
    names = ("red", "green", "blue")
    joined = df.drop(*names).join(colors.select(*on, *names), on, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(default)) for n in names})


def rescale_colors(df: DataFrame, keys: tuple[str, ...] = ("uid",), names: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Colours by 255 where a cloud's largest exceeds 1.5."""
    top = reduce(F.greatest, [F.max(F.col(n).cast("double")) for n in names])
    with_top = per_group(df, {"_top": top}, keys)
    scale = F.when(F.col("_top") > 1.5, F.lit(255.0)).otherwise(F.lit(1.0))
    return with_top.withColumns({n: F.col(n).cast("double") / scale for n in names}).drop("_top")


def normalise_quaternion(df: DataFrame, names: tuple[str, ...] = ("rot_0", "rot_1", "rot_2", "rot_3")) -> DataFrame:
    """Unit quaternions; (1, 0, 0, 0) where the length is not finite or next to none. Untouched if a part is missing."""
    if not all(n in df.columns for n in names):
        return df
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(n).cast("double") * F.col(n).cast("double") for n in names]))
    good = is_finite(length) & (length > 1e-12)
    return df.withColumns({n: F.when(good, F.col(n) / length).otherwise(F.lit(float(i == 0))).cast(df.schema[n].dataType) for i, n in enumerate(names)})


def sanitise_opacity(df: DataFrame, keys: tuple[str, ...] = ("uid",), name: str = "opacity", q: float = 0.999) -> DataFrame:
    """Non-finite opacities become the quantile of the finite ones (0 if there are none); ``opacity_replaced`` counts them per group."""
    c = F.col(name).cast("double")
    out = with_quantiles(per_group(df, {"opacity_replaced": F.count_if(~is_finite(c))}, keys), {"_fill": (F.when(is_finite(c), c), [q])}, keys)
    return out.withColumn(name, F.when(is_finite(c), c).otherwise(F.coalesce(F.col("_fill")[0], F.lit(0.0))).cast(df.schema[name].dataType)).drop("_fill")


def repair_non_finite(df: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Every float column's non-finite values become the median of its finite ones; where none is, 1 for rot_0, else 0.

    The median is exact over all rows.
    """
    names = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double") and f.name not in keys]
    if not names:
        return df
    with_fill = with_quantiles(df, {f"_fill_{n}": (F.when(is_finite(n), F.col(n).cast("double")), [0.5]) for n in names}, keys)
    return with_fill.withColumns({n: F.when(is_finite(n), F.col(n)).otherwise(F.coalesce(F.col(f"_fill_{n}")[0], F.lit(float(n == "rot_0")))).cast(df.schema[n].dataType) for n in names}).drop(*[f"_fill_{n}" for n in names])


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-clip(col(c).cast("double"), -60.0, 60.0)))


def l2_normalise(c: Column | str) -> Column:
    """An array over its length, which counts as 1e-8 at least."""
    c = col(c).cast("array<double>")
    length = F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))
    return F.transform(c, lambda x: x / length)


def normalise_bbox(df: DataFrame, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Coordinates about the box's centre, over the largest half extent: columns with ``_n`` added."""
    stats = {f"_{s}_{c}": f(F.col(c).cast("double")) for c in coords for s, f in (("lo", F.min), ("hi", F.max))}
    out = per_group(df, stats, keys)
    half = reduce(F.greatest, [(F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / 2 for c in coords]) if len(coords) > 1 else (F.col(f"_hi_{coords[0]}") - F.col(f"_lo_{coords[0]}")) / 2
    return out.withColumns({f"{c}_n": (F.col(c).cast("double") - (F.col(f"_hi_{c}") + F.col(f"_lo_{c}")) / 2) / (half + 1e-10) for c in coords}).drop(*stats)


def quantised_key(c: Column | str, tolerance: float) -> Column:
    """Whole steps of the tolerance, rounded half to even."""
    if tolerance <= 0:
        raise ValueError("the tolerance must be above 0")
    return F.rint(col(c).cast("double") / tolerance).cast("long")


def rotation(q: list[Column]) -> list[list[Column]]:
    """3x3 matrix of a quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def intrinsics(model: Column | str, params: Column | str) -> Column:
    """struct(fx, fy, cx, cy); distortion is left out and models beyond OPENCV raise."""
    model, params = col(model), col(params)
    at = lambda i: F.get(params, F.lit(i))
    one = F.struct(at(0).alias("fx"), at(0).alias("fy"), at(1).alias("cx"), at(2).alias("cy"))
    two = F.struct(at(0).alias("fx"), at(1).alias("fy"), at(2).alias("cx"), at(3).alias("cy"))
    return F.when(model.isin(0, 2, 3), one).when(model.isin(1, 4), two).otherwise(F.raise_error(F.concat(F.lit("unsupported camera model "), model.cast("string"))))


def project(xyz: list[Column], q: list[Column], t: list[Column], k: Column) -> tuple[Column, Column, Column]:
    """(u, v, depth) of points in a view: camera = R p + t; u = fx X / Z + cx."""
    return project_turned(xyz, rotation(q), t, k)


def project_turned(xyz: list[Column], r: list[list[Column]], t: list[Column], k: Column) -> tuple[Column, Column, Column]:
    """``project`` with the view's rotation as a matrix."""
    cam = [reduce(lambda a, b: a + b, [r[i][j] * xyz[j] for j in range(3)]) + t[i] for i in range(3)]
    return F.try_divide(k["fx"] * cam[0], cam[2]) + k["cx"], F.try_divide(k["fy"] * cam[1], cam[2]) + k["cy"], cam[2]


def to_pixel(c: Column, rounding: str = "rint") -> Column:
    """A pixel's number by ``rint`` (half to even) or ``trunc`` (towards 0, so -0.5 counts as 0)."""
    return (F.rint(c) if rounding == "rint" else c).cast("long")


def shift_camera(model: Column | str, params: Column | str, left: Column, top: Column) -> Column:
    """Parameters with the principal point moved by a crop's corner."""
    model, params = col(model), col(params)
    pairs = F.create_map(*[F.lit(v) for m, (_, _, (a, b)) in CAMERA_MODELS.items() for v in (m, a * 100 + b)])
    place = F.element_at(pairs, model)
    return F.transform(params, lambda v, i: F.when(i == F.floor(place / 100), v - left).when(i == place % 100, v - top).otherwise(v))


def frame_schedule(start: Column | int, end: Column | int, n: int) -> Column:
    """Indices of ``n`` frames spread evenly from ``start`` to ``end``, rounded half to even."""
    low, high = (v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in (start, end))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(low + i * (high - low) / F.lit(float(max(n - 1, 1)))).cast("long"))


def label_from_float(c: Column | str) -> Column:
    """Labels kept as floats: not finite gives 0, else cut off to a whole number."""
    return F.when(is_finite(c), col(c).cast("double")).otherwise(F.lit(0.0)).cast("long")


def plant_uid(c: Column | str) -> Column:
    """The ``plant_<digits>`` that a file's name begins with; null if none."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(col(c), "/"), -1), r"^(plant_\d+)", 1), F.lit(""))


def parse_item(c: Column | str) -> Column:
    """struct(name, ply, renders) of ``name|ply[|renders]``."""
    parts = F.split(col(c), r"\|", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("ply"), F.get(parts, F.lit(2)).alias("renders"))


def parse_id_list(c: Column | str) -> Column:
    """Whole numbers of a list with plain or full-width commas; blanks drop out."""
    parts = F.split(F.translate(col(c), "，", ","), ",")
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.trim(p).cast("int"))


def base_name(c: Column | str) -> Column:
    """A file's name in lower case without its folders, its extension and the mask's ending."""
    name = F.lower(F.element_at(F.split(col(c), r"[/\\]"), -1))
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"_mask$", "")


def feature_file(uid: Column | str) -> Column:
    """The name that a cloud's part features are kept under."""
    return F.concat(F.lit("part_feat_"), col(uid), F.lit("_0.npy"))


def nested_json(*columns: str) -> Column:
    """Aggregate: the rows' columns as one JSON list, in their order."""
    return F.to_json(F.sort_array(F.collect_list(F.struct(*columns))))


def positional_zip(vertices: DataFrame, labels: DataFrame, on: tuple[str, ...] = ("uid", "vid")) -> DataFrame:
    """Vertices with the labels of their position; what one side has more of drops out (``length_mismatches`` tells where)."""
    return vertices.join(labels, list(on))


def length_mismatches(vertices: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, n_vertices, n_labels)`` of the clouds whose counts differ, for a caller to warn of what ``positional_zip`` leaves out."""
    counts = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = counts(vertices, "n_vertices").join(counts(labels, "n_labels"), list(keys), "full_outer").na.fill(0, ["n_vertices", "n_labels"])
    return both.where("n_vertices <> n_labels")


def relabel_contiguous(df: DataFrame, label: str = "label", keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Positive labels become 1..n in their order, others 0. Ranks run over one row for each label."""
    from pyspark.sql import Window as W

    ids = df.where(F.col(label) > 0).select(*keys, label).distinct()
    ranked = ids.withColumn("_new", F.row_number().over(W.partitionBy(*keys).orderBy(label)).cast("int"))
    return df.join(ranked, [*keys, label], "left").withColumn(label, F.coalesce("_new", F.lit(0))).drop("_new").select(df.columns)
