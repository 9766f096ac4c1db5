"""Filters of clouds and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.functions.scalars import is_finite
from phyllo.operators.aggregates import numbered
from phyllo.operators.grouped import per_group
from phyllo.operators.quantiles import with_quantiles

COORDS = ("x", "y", "z")


def finite_rows(df: DataFrame, names: tuple[str, ...] = (*COORDS, "opacity")) -> DataFrame:
    """Rows whose columns are all finite."""
    for n in names:
        df = df.where(is_finite(n))
    return df


def above_quantile(df: DataFrame, name: str = "opacity", q: float = 0.35, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Rows at or above their group's quantile (linear between ranks)."""
    return with_quantiles(df, {"_q": (F.col(name), [q])}, keys).where(F.col(name).cast("double") >= F.col("_q")[0]).drop("_q")


def crop_box(df: DataFrame, low: float = 0.005, high: float = 0.995, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS) -> DataFrame:
    """Rows between the quantiles of their group on every axis; all quantiles are of the rows that come in."""
    out = with_quantiles(df, {f"_q_{c}": (F.col(c), [low, high]) for c in coords}, keys)
    for c in coords:
        out = out.where(F.col(c).cast("double").between(F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]))
    return out.drop(*[f"_q_{c}" for c in coords])


def selected_clusters(df: DataFrame, selection: DataFrame, on: tuple[str, ...] = ("uid", "cluster_id")) -> DataFrame:
    """Rows whose cluster is selected."""
    return df.join(selection.select(*on).distinct(), list(on), "left_semi")


def selected_ratio(df: DataFrame, selection: DataFrame, keys: tuple[str, ...] = ("uid",), cluster: str = "cluster_id") -> DataFrame:
    """``(*keys, n_points, n_selected, selected_ratio)``."""
    marked = df.join(selection.select(*keys, cluster).distinct().withColumn("_in", F.lit(1)), [*keys, cluster], "left")
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count("_in").alias("n_selected"))
    return counts.withColumn("selected_ratio", F.col("n_selected") / F.col("n_points"))


def drop_small_labels(df: DataFrame, least: int, label: str = "label", keys: tuple[str, ...] = ("uid",), strict: bool = False) -> DataFrame:
    """Labels of fewer than ``least`` rows (``strict``: of no more) become 0."""
    out = per_group(df, {"_n": F.count(F.lit(1))}, (*keys, label))
    big = F.col("_n") > least if strict else F.col("_n") >= least
    return out.withColumn(label, F.when(big, F.col(label)).otherwise(F.lit(0).cast(df.schema[label].dataType))).drop("_n").select(df.columns)


def masks_of_size(cells: DataFrame, sizes: DataFrame, least: int, most_share: float, mask: str = "mask_id", keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, mask, n)`` of masks with at least ``least`` points and at most that share of ``sizes`` (*keys, n_points)."""
    counts = cells.groupBy(*keys, mask).agg(F.count(F.lit(1)).alias("n")).join(sizes, list(keys))
    return counts.where((F.col("n") >= least) & (F.col("n") <= most_share * F.col("n_points"))).select(*keys, mask, "n")


def holdout_split(images: DataFrame, every: int = 8, name: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """``images`` with ``is_test``: by name, every so many-th from the first on."""
    if not keys:
        return numbered(images, name, "_place").withColumn("is_test", F.col("_place") % every == 0).drop("_place")
    return images.withColumn("is_test", (F.row_number().over(W.partitionBy(*keys).orderBy(name)) - 1) % every == 0)


def limit_views(views: DataFrame, most: int | None, order: str = "name") -> DataFrame:
    """The first ``most`` views by name; all if there is no limit or it is 0."""
    return views.orderBy(order).limit(most) if most else views


def prompt_batches(prompts: DataFrame, size: int = 8, order: str = "rank", keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``prompts`` with ``batch``, counted from 0: so many prompts of a cloud each, in their order. Prompts are hundreds of rows for a cloud."""
    return prompts.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size).cast("int"))


def vote_filter(votes: DataFrame, least_views: int = 3, share: float = 0.60) -> DataFrame:
    """Points seen in enough views, in enough of them as foreground; of ``visible`` and ``foreground`` counts."""
    return votes.where((F.col("visible") >= least_views) & (F.col("foreground") / F.greatest("visible", F.lit(1)) >= share))


def evidence(hits: Column | str = "hit_count", views: Column | str = "view_count") -> Column:
    """Three hits, or one at a rate above 0.28."""
    hits, views = (F.col(c) if isinstance(c, str) else c for c in (hits, views))
    return (hits >= 3) | ((hits / (views + 1e-6) > 0.28) & (hits >= 1))


def reject_plant_points(full: DataFrame, plant: DataFrame, kept: DataFrame, on: tuple[str, ...] = ("uid", "vid")) -> DataFrame:
    """Rows of ``full`` but for plant points that are not kept."""
    rejected = plant.select(*on).join(kept.select(*on), list(on), "left_anti")
    return full.join(rejected, list(on), "left_anti")


def leaf_predictions(iou: DataFrame, threshold: float = 0.1, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, pred)`` of predictions that any ground-truth instance meets with that IoU."""
    return iou.where((F.col("iou") >= threshold) & (F.col("iou") > 0)).select(*keys, "pred").distinct()


def valid_observations(images: DataFrame, points: str = "points2d") -> DataFrame:
    """``images`` with only the observations of a 3-D point at finite places."""
    return images.withColumn(points, F.filter(points, lambda p: (p["point3d_id"] != -1) & is_finite(p["x"]) & is_finite(p["y"])))


def in_frame(u: Column, v: Column, depth: Column, width: Column, height: Column, near: float = 1e-6, margin: int = 0) -> Column:
    """In front of the camera and within the picture less a margin at the far edges."""
    return (depth > near) & (u >= 0) & (v >= 0) & (u < width - margin) & (v < height - margin)
