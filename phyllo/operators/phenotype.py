"""Phenotype parameters of plants and leaf instances.

The semantics are ours: lengths and widths are extents along the first two
principal axes of an instance, its inclination is the angle of the first axis
against the horizontal plane, and its area is that of the occupied cells of a
grid in the plane of the two axes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.operators.aggregates import bounding_box
from phyllo.operators.clustering import _same
from phyllo.operators.metrics import smallest_eigenvalues


def plant_size(df: DataFrame, keys: tuple[str, ...] = ("uid",), up: str = "z", flat: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``(*keys, point_count, height, crown_width)``."""
    box = bounding_box(df, keys, (*flat, up))
    span = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    return box.select(*keys, F.col("n_points").alias("point_count"), span(up).alias("height"), F.greatest(*map(span, flat)).alias("crown_width"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [i * j for i, j in zip(a, b, strict=True)])


def principal_axes(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``(*groups, n_points, cx, cy, cz, l1, l2, l3, a0..a2, b0..b2)``: centroid, eigenvalues from the largest, and the first two axes.

    Axes come from cross products of the rows of the shifted covariance, the
    longest of which is taken; a group without a direction has the x and y axes.
    """
    xyz = [F.col(c).cast("double") for c in ("x", "y", "z")]
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    stats = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_points"), *[F.avg(c).alias(n) for c, n in zip(xyz, ("cx", "cy", "cz"), strict=True)], *[F.coalesce(F.covar_pop(xyz[i], xyz[j]), F.lit(0.0)).alias(n) for (i, j), n in zip(pairs, names, strict=True)])
    low = smallest_eigenvalues(stats, names, "l3")
    minus = low.withColumns({f"_{n}": -F.col(n) for n in names})
    both = smallest_eigenvalues(minus, [f"_{n}" for n in names], "_l1").withColumn("l1", -F.col("_l1")).withColumn("l2", F.col("xx") + F.col("yy") + F.col("zz") - F.col("l1") - F.col("l3"))

    def axis(value: str) -> Column:
        at = lambda i, j: F.col(names[pairs.index((min(i, j), max(i, j)))]) - (F.col(value) if i == j else F.lit(0.0))
        rows = [[at(i, j) for j in range(3)] for i in range(3)]
        crossed = [_cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        return F.greatest(*[F.struct(_dot(c, c).alias("n"), *[c[k].alias(f"v{k}") for k in range(3)]) for c in crossed])

    out = both.withColumns({"_a": axis("l1"), "_b": axis("l2")})
    unit = lambda c, k, fallback: F.when(F.col(f"{c}.n") > 1e-24, F.col(f"{c}.v{k}") / F.sqrt(F.col(f"{c}.n"))).otherwise(F.lit(fallback))
    out = out.withColumns({f"a{k}": unit("_a", k, float(k == 0)) for k in range(3)} | {f"b{k}": unit("_b", k, float(k == 1)) for k in range(3)})
    return out.select(*groups, "n_points", "cx", "cy", "cz", "l1", "l2", "l3", *[f"a{k}" for k in range(3)], *[f"b{k}" for k in range(3)])


def leaf_parameters(df: DataFrame, cell: float, keys: tuple[str, ...] = ("uid",), instance: str = "instance_id") -> DataFrame:
    """Per instance above 0: centroid, length, width, inclination in degrees, main direction and area by cells of ``cell``."""
    groups = (*keys, instance)
    rows = df.where(F.col(instance) > 0)
    axes = principal_axes(rows, groups)
    placed = rows.alias("p").join(axes.alias("a"), _same("p", "a", groups))
    rel = [F.col(f"p.{c}").cast("double") - F.col(f"a.c{c}") for c in ("x", "y", "z")]
    along = lambda n: _dot(rel, [F.col(f"a.{n}{k}") for k in range(3)])
    flat = placed.select(*[F.col(f"p.{g}").alias(g) for g in groups], along("a").alias("s"), along("b").alias("t"))
    cells = flat.groupBy(*groups, F.floor(F.col("s") / cell).alias("i"), F.floor(F.col("t") / cell).alias("j")).agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    sizes = cells.groupBy(*groups).agg((F.max("s1") - F.min("s0")).alias("length"), (F.max("t1") - F.min("t0")).alias("width"), (F.count(F.lit(1)) * cell * cell).alias("area"))
    out = sizes.join(axes, list(groups))
    slope = F.degrees(F.asin(F.least(F.lit(1.0), F.abs("a2"))))
    return out.select(*groups, "n_points", "cx", "cy", "cz", "length", "width", "area", slope.alias("inclination"), "a0", "a1", "a2")


def drop_stems(leaves: DataFrame, most_ratio: float = 6.0) -> DataFrame:
    """Instances that are not so much longer than wide that they are stems."""
    return leaves.where(F.col("length") <= most_ratio * F.greatest("width", F.lit(1e-12)))


def plant_summary(leaves: DataFrame, plants: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Per plant: size, instances, total area and the leaves' means."""
    sums = leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("instance_count"), F.sum("area").alias("leaf_area"), F.avg("length").alias("mean_length"), F.avg("width").alias("mean_width"), F.avg("area").alias("mean_area"))
    return plants.join(sums, list(keys), "left").na.fill(0, ["instance_count"])


def relative_error(measured: Column, truth: Column) -> Column:
    """Absolute error over the truth."""
    return F.abs(measured - truth) / F.abs(truth)
