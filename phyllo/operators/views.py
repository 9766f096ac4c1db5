"""Projection into camera views, votes, rendering and crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.functions.scalars import base_name, intrinsics, is_finite, project_turned, rotation, shift_camera, to_pixel
from phyllo.operators import kdtree
from phyllo.operators.aggregates import front_surface
from phyllo.operators.filters import in_frame

COORDS = ("x", "y", "z")


def views(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """``(view_id, name, q0..q3, t0..t2, k, width, height)``: one row per image with its camera."""
    joined = images.join(cameras, "camera_id")
    q = [F.col("qvec")[i].alias(f"q{i}") for i in range(4)]
    t = [F.col("tvec")[i].alias(f"t{i}") for i in range(3)]
    return joined.select(F.col("image_id").alias("view_id"), "name", *q, *t, intrinsics("model_id", "params").alias("k"), "width", "height")


def _frustum(near: float, margin: int) -> Column:
    """Planes ``(a0, a1, a2, b)`` of a view, inside where ``a . p + b >= 0``: in front, and between the picture's edges, a pixel wider for the rounding."""
    r, t, k = rotation([F.col(f"q{i}") for i in range(4)]), [F.col(f"t{i}") for i in range(3)], F.col("k")

    def plane(scale: Column, axis: int, offset: Column) -> Column:
        """``scale`` times a camera axis plus ``offset`` times the depth."""
        parts = [scale * a + offset * z for a, z in zip([*r[axis], t[axis]], [*r[2], t[2]], strict=True)]
        return F.struct(*[p.alias(n) for p, n in zip(parts, ("a0", "a1", "a2", "b"), strict=True)])

    front = F.struct(*[r[2][i].alias(f"a{i}") for i in range(3)], (t[2] - F.lit(float(near))).alias("b"))
    if near < 0:
        return F.array(front)  # behind the camera the edges change sides
    edges = [(k["fx"], 0, k["cx"], F.col("width")), (k["fy"], 1, k["cy"], F.col("height"))]
    low = [plane(f, axis, c + 1) for f, axis, c, _ in edges]
    high = [plane(-f, axis, size - margin + 1 - c) for f, axis, c, size in edges]
    return F.array(front, *low, *high)


def _in_view() -> Column:
    """Whether a box ``lo0.., hi0..`` has a point inside all ``planes``, or rounding leaves that open."""

    def reaches(plane: Column) -> Column:
        ends = [(plane[f"a{i}"] * F.col(f"lo{i}"), plane[f"a{i}"] * F.col(f"hi{i}")) for i in range(3)]
        best = sum((F.greatest(a, b) for a, b in ends), plane["b"])
        size = sum((F.greatest(F.abs(a), F.abs(b)) for a, b in ends), F.abs(plane["b"]))
        return best >= -1e-9 * size

    return F.forall("planes", reaches)


def seen_cells(view: DataFrame, roots: DataFrame, rounds: list[DataFrame], near: float = 1e-6, margin: int = 0) -> DataFrame:
    """``view`` with ``gid`` and ``path`` of every leaf of a k-d partition whose box is not wholly outside of the view's frustum, found from the root down."""
    whole = view.withColumns({"planes": _frustum(near, margin), "gid": F.lit(0).cast("long"), "path": F.lit(0).cast("long")})
    boxes = roots.select("gid", "path", *[f"{end}{i}" for i in range(3) for end in ("lo", "hi")])
    start = whole.join(boxes, ["gid", "path"]).where(_in_view()).select(whole.columns)
    return (kdtree.descend(start, rounds, 3, _in_view()) if rounds else start).drop("planes")


def project_points(points: DataFrame, view: DataFrame, rounding: str = "rint", near: float = 1e-6, margin: int = 0, coords: tuple[str, ...] = COORDS, keys: tuple[str, ...] = ("uid", "vid"), cell: int = kdtree.LEAF, few: int = 8) -> DataFrame:
    """``(*keys, view_id, u, v, depth)`` of every point in every view that has it in front and in frame.

    Points are dealt to cells of about ``cell`` of them, the leaves of a k-d tree.
    A view meets only the cells whose box its frustum cuts, so points are
    projected where they may be seen, and no product of points and views is made.
    Up to ``few`` views are sent to all points instead, which is less work than
    dealing them. Points with a null or non-finite coordinate are in no view.
    """
    spots = [F.col(c).cast("double") for c in coords]
    fine = reduce(lambda a, b: a & b, [F.coalesce(is_finite(s), F.lit(False)) for s in spots])
    names = [f"c{i}" for i in range(3)]
    own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    rows = points.where(fine).select(F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("path"), F.lit(False).alias("asks"), own.alias("vid"), *[s.alias(n) for s, n in zip(spots, names, strict=True)])
    r = rotation([F.col(f"q{i}") for i in range(4)])
    slim = view.select("view_id", *[F.col(f"q{i}") for i in range(4)], *[F.col(f"t{i}") for i in range(3)], "k", "width", "height", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    if slim.limit(few + 1).count() <= few:
        met = rows.join(F.broadcast(slim))
    else:
        dealt, roots, rounds = kdtree.deal(rows, names, cell)
        # Neither side is sent to all tasks: the files of many like points are small, the points are not.
        met = dealt.select("gid", "path", "vid", *names).hint("merge").join(seen_cells(slim, roots, rounds, near, margin), ["gid", "path"])
    u, v, depth = project_turned([F.col(n) for n in names], [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"t{i}") for i in range(3)], F.col("k"))
    # A view's rotation is taken once, before the join, and a pair's place once: what filters and columns need would repeat them.
    seen = met.select("vid", "view_id", F.inline(F.array(F.struct(u.alias("_u"), v.alias("_v"), depth.alias("depth")))), "width", "height").where(is_finite("_u") & is_finite("_v") & (F.col("depth") > near))
    pixels = seen.select("vid", "view_id", to_pixel(F.col("_u"), rounding).alias("u"), to_pixel(F.col("_v"), rounding).alias("v"), "depth", "width", "height")
    inside = pixels.where(in_frame(F.col("u"), F.col("v"), F.col("depth"), F.col("width"), F.col("height"), near, margin))
    return inside.select(*[F.col(f"vid.k{i}").alias(c) for i, c in enumerate(keys)], "view_id", "u", "v", "depth")


def masks_of_images(images: DataFrame, masks: DataFrame, how: str = "stem", order: str = "image_id") -> DataFrame:
    """``(image_id, mask_path)``: by equal base names, or with ``contains`` by either name within the other; the first image in order takes a mask."""
    im = images.select(order, base_name("name").alias("a"))
    ma = masks.select(F.col("path").alias("mask_path"), base_name("path").alias("b"))
    on = F.col("a") == F.col("b") if how == "stem" else F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    return im.join(ma, on).groupBy("mask_path").agg(F.min(order).alias("image_id")).select("image_id", "mask_path")


def foreground_votes(hits: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("uid", "vid")) -> DataFrame:
    """``(*keys, visible, foreground)``: views that show a point, and those whose mask ``(view_id, v, u, val)`` is set there."""
    joined = hits.join(mask.select("view_id", "v", "u", "val"), ["view_id", "v", "u"], "left")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("visible"), F.count_if(F.coalesce("val", F.lit(0)) > 0).alias("foreground"))


def instance_votes(hits: DataFrame, mask: DataFrame, tolerance: float = 0.012, keys: tuple[str, ...] = ("uid", "vid")) -> tuple[DataFrame, DataFrame]:
    """(``(*keys, view_count, hit_count)``, ``(*keys, view_id, label)``): a hit is a front-surface pixel with a label; hidden points count as seen."""
    front = front_surface(hits, tolerance)
    joined = front.join(mask.select("view_id", "v", "u", "val"), ["view_id", "v", "u"], "left")
    hit = F.col("is_front") & (F.coalesce("val", F.lit(0)) > 0)
    counts = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("view_count"), F.count_if(hit).alias("hit_count"))
    return counts, joined.where(hit).select(*keys, "view_id", F.col("val").alias("label"))


def colourise(points: DataFrame, hits: DataFrame, pixels: DataFrame, default: int = 180, keys: tuple[str, ...] = ("uid", "vid")) -> DataFrame:
    """``points`` with the mean colour ``(view_id, v, u, red, green, blue)`` over the views that show them, rounded half to even; unseen ones get a grey."""
    names = ("red", "green", "blue")
    means = hits.join(pixels, ["view_id", "v", "u"]).groupBy(*keys).agg(*[F.rint(F.avg(n)).cast("int").alias(n) for n in names])
    joined = points.drop(*names).join(means, list(keys), "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(default)) for n in names})


def splat_offsets(radius: int) -> Column:
    """Array of (pass, dx, dy) with dx^2 + dy^2 <= r^2, row by row; ``pass`` counts them from 0."""
    pairs = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    return F.array(*[F.struct(F.lit(i).alias("pass"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(pairs)])


def render(points: DataFrame, hits: DataFrame, view: DataFrame, radius: int = 1, keys: tuple[str, ...] = ("uid", "vid")) -> tuple[DataFrame, DataFrame]:
    """(canvas ``(view_id, v, u, red, green, blue, depth)``, ``(view_id, hit_count)``) of points drawn as discs, the nearest in front.

    Passes draw one offset each; a write counts as a hit if it is nearer than all
    that earlier passes left at its pixel, one a pass and pixel. The sizes of the
    views, a row each, are sent to all tasks: dealt by view, a task would get a view.
    """
    drawn = hits.join(points.select(*keys, "red", "green", "blue"), list(keys)).withColumn("_o", F.explode(splat_offsets(radius)))
    drawn = drawn.join(F.broadcast(view.select("view_id", "width", "height")), "view_id").withColumns({"u": F.col("u") + F.col("_o.dx"), "v": F.col("v") + F.col("_o.dy")})
    drawn = drawn.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") < F.col("height")))
    best = drawn.groupBy("view_id", "v", "u").agg(F.min(F.struct("depth", *keys, "red", "green", "blue")).alias("b"))
    canvas = best.select("view_id", "v", "u", "b.red", "b.green", "b.blue", "b.depth")
    passes = drawn.groupBy("view_id", "v", "u", F.col("_o.pass").alias("p")).agg(F.min("depth").alias("d"))
    lists = passes.groupBy("view_id", "v", "u").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]).alias("ds"))  # as many as offsets at most
    start = F.struct(F.lit(float("inf")).alias("low"), F.lit(0).cast("long").alias("n"))
    walk = F.aggregate("ds", start, lambda acc, d: F.struct(F.least(acc["low"], d).alias("low"), (acc["n"] + F.when(d < acc["low"], 1).otherwise(0)).cast("long").alias("n")))
    return canvas, lists.groupBy("view_id").agg(F.sum(walk["n"]).alias("hit_count"))


def roi_crop(images: DataFrame, percentile: float = 1.0, margin: float = 0.1, least_points: int = 30, least_size: int = 64, strict: bool = True) -> DataFrame:
    """``(image_id, left, top, right, bottom, valid_points)`` around an image's valid observations ``points2d``.

    Percentile box, widened by the margin on each side, then to the least size,
    rounded outwards and cut to the picture. Too few points or an empty crop raise
    an error, or give nulls if not ``strict``.
    """
    spots = images.select("image_id", "width", "height", F.explode_outer("points2d").alias("p"))
    good = (F.col("p.point3d_id") != -1) & is_finite("p.x") & is_finite("p.y")
    q = F.array(F.lit(percentile / 100), F.lit(1 - percentile / 100))
    box = spots.groupBy("image_id", "width", "height").agg(F.count_if(good).alias("n"), *[F.percentile(F.when(good, F.col(f"p.{c}")), q).alias(c) for c in "xy"])
    for c in "xy":
        span = F.greatest(F.lit(1.0), F.col(c)[1] - F.col(c)[0])
        lo, hi = F.col(c)[0] - span * margin, F.col(c)[1] + span * margin
        pad = F.greatest(F.lit(0.0), (least_size - (hi - lo)) / 2)
        box = box.withColumns({f"lo_{c}": lo - pad, f"hi_{c}": hi + pad})
    edge = {"left": F.greatest(F.lit(0), F.floor("lo_x")), "top": F.greatest(F.lit(0), F.floor("lo_y")), "right": F.least("width", F.ceil("hi_x")), "bottom": F.least("height", F.ceil("hi_y"))}
    box = box.withColumns({k: v.cast("long") for k, v in edge.items()})
    bad = (F.col("n") < least_points) | (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))
    fail = F.raise_error(F.concat(F.lit("no crop for image "), F.col("image_id").cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return box.select("image_id", *[F.when(~F.coalesce(bad, F.lit(True)), F.col(k)).otherwise(fail).alias(k) for k in edge], F.col("n").alias("valid_points"))


def roi_driver(green: DataFrame, colmap: DataFrame, driver: str = "hybrid") -> DataFrame:
    """``(image_id, left, top, right, bottom, valid_points, crop_driver, fallback_reason)`` from crops by colour ``(image_id, left, .., reason)`` and by points."""
    names = ("left", "top", "right", "bottom")
    joined = colmap.alias("c").join(green.alias("g"), "image_id", "left")
    use = F.col("g.left").isNotNull() if driver != "colmap" else F.lit(False)
    wrong = F.raise_error(F.coalesce(F.col("g.reason"), F.lit("no crop by colour"))).cast("long")
    pick = lambda n: F.when(use, F.col(f"g.{n}")).otherwise(wrong if driver == "green" else F.col(f"c.{n}"))
    reason = F.when(use | F.lit(driver == "colmap"), F.lit("")).otherwise(F.coalesce(F.col("g.reason"), F.lit("")))
    return joined.select("image_id", *[pick(n).alias(n) for n in names], F.col("c.valid_points"), F.when(use, "green").otherwise("colmap").alias("crop_driver"), reason.alias("fallback_reason"))


def shift_to_crop(images: DataFrame, cameras: DataFrame, crops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, cameras, manifest) after cropping: every image has a camera of its own id, observations and principal point move."""
    crop = crops.select("image_id", "left", "top", "right", "bottom", "valid_points", "crop_driver", "fallback_reason")
    joined = images.join(crop, "image_id").join(cameras.withColumnsRenamed({"width": "_w", "height": "_h"}), "camera_id")
    moved = F.transform("points2d", lambda p: F.struct((p["x"] - F.col("left")).alias("x"), (p["y"] - F.col("top")).alias("y"), p["point3d_id"].alias("point3d_id")))
    new_images = joined.select(*[F.col("image_id").cast(images.schema["camera_id"].dataType).alias(c) if c == "camera_id" else moved.alias(c) if c == "points2d" else F.col(c) for c in images.columns])
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    new_cameras = joined.select(F.col("image_id").cast(cameras.schema["camera_id"].dataType).alias("camera_id"), "model_id", width.alias("width"), height.alias("height"), shift_camera("model_id", "params", F.col("left"), F.col("top")).alias("params"))
    manifest = joined.select("image_id", "name", F.col("camera_id").alias("old_camera_id"), F.col("image_id").alias("new_camera_id"), "left", "top", "right", "bottom", width.alias("width"), height.alias("height"), F.col("valid_points").alias("valid_colmap_points"), "crop_driver", "fallback_reason")
    return new_images, new_cameras, manifest
