"""Whole flows over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.functions.colors import instance_palette
from phyllo.operators import aggregates, clustering, features, filters, metrics, spatial, views
from phyllo.session import cut


def unmatched_clouds(gt: DataFrame, source: DataFrame, pred: DataFrame) -> DataFrame:
    """``(uid, missing)`` of clouds with a ground truth that lack a source or a prediction."""
    lacks = lambda df, name: gt.select("uid").distinct().join(df.select("uid").distinct(), "uid", "left_anti").select("uid", F.lit(name).alias("missing"))
    return lacks(source, "source").unionByName(lacks(pred, "prediction"))


def evaluate(gt: DataFrame, source: DataFrame, pred: DataFrame, max_distance: float = -1.0, iou_threshold: float = 0.1) -> DataFrame:
    """One metric row per cloud and a MEAN row.

    ``gt`` (uid, vid, x, y, z, gt), ``source`` (uid, vid, x, y, z), ``pred`` (uid, vid,
    label0), labels from 0, by position in the source cloud. Ground-truth points
    take the label of their nearest source point within the distance; source
    points that none takes count as extra predictions. Clouds that one side lacks
    drop out.
    """
    labelled = cut(source.join(pred.select("uid", "vid", (F.col("label0") + 1).alias("pred")), ["uid", "vid"]), "evaluate-source")
    near = cut(spatial.match_within(gt.select("uid", "vid", "x", "y", "z"), labelled, max_distance), "evaluate-near")
    used = near.select("uid", F.col("near_vid").alias("vid")).dropna()
    extra = aggregates.unused_rows(labelled, used).select("uid", "pred")
    rows = near.join(gt.select("uid", "vid", "gt"), ["uid", "vid"]).join(labelled.select("uid", F.col("vid").alias("near_vid"), "pred"), ["uid", "near_vid"], "left")
    rows = cut(rows.select("uid", "vid", "gt", F.coalesce("pred", F.lit(0)).alias("pred")), "evaluate-rows")
    out = metrics.distance_report(near)
    for part in (metrics.semantic_metrics(rows, iou_threshold, extra=extra), metrics.instance_metrics(rows, iou_threshold, extra=extra), metrics.leaf_rand(rows, iou_threshold, extra=extra)):
        out = out.join(part, "uid", "left")
    return aggregates.mean_row(out.where(F.col("tp").isNotNull()))


def clean_cloud(df: DataFrame, q: float = 0.35, low: float = 0.005, high: float = 0.995, most: int = 200_000) -> DataFrame:
    """Finite rows, opaque ones, those in the box, thinned by voxels. Each quantile is of the rows that the step before leaves."""
    kept = filters.crop_box(cut(filters.above_quantile(filters.finite_rows(df), "opacity", q), "clean"), low, high)
    return aggregates.adaptive_thin(cut(kept, "clean"), most)


def denoise_cloud(df: DataFrame, k: int = 16, ratio: float = 2.0, multiplier: float = 2.5, min_points: int = 10, most: int = 50_000, voxel: float = 0.0, seed: int = 0) -> DataFrame:
    """Outliers go, large density clusters of a sample stay, and voxels thin what is left."""
    kept = cut(clustering.sor_std(df, k, ratio), "denoise")
    eps = clustering.auto_eps(kept, multiplier).agg(F.max("eps")).first()[0]
    kept = clustering.sampled_dbscan_filter(kept, float(eps), min_points, most, seed)
    return aggregates.voxel_downsample(kept, voxel) if voxel > 0 else kept


def foreground_from_masks(points: DataFrame, view: DataFrame, mask: DataFrame) -> DataFrame:
    """Points that enough views show as foreground."""
    hits = views.project_points(points, view, "rint", 0.0, margin=1)
    kept = filters.vote_filter(views.foreground_votes(hits, mask))
    return points.join(kept.select("uid", "vid"), ["uid", "vid"], "left_semi")


def leaf_instances(points: DataFrame, view: DataFrame, mask: DataFrame, k: int = 550, least: int = 150, radius: float = 0.03) -> DataFrame:
    """Leaf instances of one cloud from label masks: votes on superpoints, average linkage, and the largest component of each."""
    hits = cut(views.project_points(points, view, "trunc"), "leaf-hits")
    counts, votes = views.instance_votes(hits, mask)
    seen = points.join(counts.where(filters.evidence()), ["uid", "vid"])
    tagged = cut(features.superpoints(seen, k), "leaf-superpoints")
    stats = cut(features.superpoint_stats(tagged), "leaf-stats")
    by_view = features.superpoint_views(votes.join(tagged.select("uid", "vid", "sp"), ["uid", "vid"]))
    clusters = features.agglomerate(stats, features.superpoint_distances(stats, by_view))
    labelled = tagged.join(clusters, "sp").withColumn("label", (F.col("cluster") + 1).cast("int")).select(*points.columns, "label")
    return instance_palette(clustering.largest_component(cut(labelled, "leaf-labels"), radius, least=least, renumber=True), "label")
