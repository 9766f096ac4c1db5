"""Geometry and segmentation metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.functions.scalars import safe_div
from phyllo.operators.aggregates import bounding_box, mad_stats
from phyllo.operators.clustering import _same, dbscan, mean_knn_distance
from phyllo.operators.filters import leaf_predictions
from phyllo.operators.quantiles import group_quantiles
from phyllo.operators.spatial import COORDS, knn_join
from phyllo.session import cut


def outlier_ratio(df: DataFrame, k: int = 16, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", sample: DataFrame | None = None) -> DataFrame:
    """``(*keys, outlier_ratio)``: share of rows (of a sample's rows, against all) whose mean neighbour distance exceeds median + 3 MAD; 0 for at most k rows or no deviation."""
    scores = cut(mean_knn_distance(df, k, keys, coords, vid, sample), "outliers")
    stats = mad_stats(scores, "score", keys)
    flagged = scores.alias("s").join(stats.alias("t"), _same("s", "t", keys))
    over = F.avg(F.when((F.col("t.mad") > 0) & (F.col("s.score") > F.col("t.median") + 3 * F.col("t.mad")), 1.0).otherwise(0.0))
    ratios = flagged.groupBy(*[F.col(f"s.{c}").alias(c) for c in keys]).agg(over.alias("_r"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.alias("g").join(ratios.alias("r"), _same("g", "r", keys), "left").select(*[F.col(f"g.{c}").alias(c) for c in keys], F.when(F.col("g._n") > k, F.coalesce("r._r", F.lit(0.0))).otherwise(0.0).alias("outlier_ratio"))


def main_component_ratio(df: DataFrame, min_points: int = 10, share: float = 0.02, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", sample: DataFrame | None = None) -> DataFrame:
    """``(*keys, main_component_ratio)``: the largest density cluster's share of all rows, or of a sample's; 0 if all are noise. The reach is a share of the whole cloud's diagonal."""
    boxes = bounding_box(df, keys, coords).select(*keys, F.greatest(share * F.col("bbox_diagonal"), F.lit(1e-6)).alias("_eps"))
    with_eps = (df if sample is None else sample).alias("a").join(boxes.alias("b"), _same("a", "b", keys)).select("a.*", "b._eps")
    labels = dbscan(with_eps, "_eps", min_points, keys, coords, vid)
    counts = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)) / F.sum("n")).alias("main_component_ratio"))


def smallest_eigenvalues(df: DataFrame, names: list[str], out: str = "eig_min") -> DataFrame:
    """``df`` with the smallest eigenvalue of symmetric 3x3 matrices (xx, xy, xz, yy, yz, zz); in closed form, so it stays in the JVM."""
    xx, xy, xz, yy, yz, zz = (F.col(n) for n in names)
    q = (xx + yy + zz) / 3
    p = F.sqrt((F.pow(xx - q, F.lit(2)) + F.pow(yy - q, F.lit(2)) + F.pow(zz - q, F.lit(2)) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c = ((d - q) / p for d in (xx, yy, zz))
    r = (a * (b * c - yz / p * yz / p) - xy / p * (xy / p * c - yz / p * xz / p) + xz / p * (xy / p * yz / p - b * xz / p)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    return df.withColumn(out, F.when(p == 0, q).otherwise(q + 2 * p * F.cos(phi + F.lit(2 * np.pi / 3))))


def neighbour_covariance(df: DataFrame, k: int = 16, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, n, cxx, cxy, cxz, cyy, cyz, czz)`` of each row's k nearest, itself counted; over n - 1."""
    pairs = knn_join(df, df, k, keys, coords, vid)
    at = df.select(*keys, F.col(vid).alias("dst"), *[F.col(c).cast("double").alias(n) for c, n in zip(coords, "xyz", strict=True)])
    near = pairs.alias("p").join(at.alias("a"), _same("p", "a", (*keys, "dst"))).select(*[F.col(f"p.{c}").alias(c) for c in (*keys, "src")], "a.x", "a.y", "a.z")
    two = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return near.groupBy(*keys, F.col("src").alias(vid)).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in two])


def local_thickness(df: DataFrame, k: int = 16, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, local_thickness_median)``: median root of the smallest eigenvalue of each row's neighbours; NaN for at most k rows."""
    cov = smallest_eigenvalues(neighbour_covariance(df, k, keys, coords, vid), ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"])
    thick = group_quantiles(cut(cov, "thickness"), {"_t": (F.sqrt(F.greatest("eig_min", F.lit(0.0))), [0.5])}, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.alias("g").join(thick.alias("t"), _same("g", "t", keys), "left").select(*[F.col(f"g.{c}").alias(c) for c in keys], F.when(F.col("g._n") > k, F.col("t._t")[0]).otherwise(F.lit(float("nan"))).alias("local_thickness_median"))


def geometry_metrics(df: DataFrame, k: int = 16, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """All annotation-free metrics of each cloud in one row."""
    out = bounding_box(df, keys, coords).select(*keys, F.col("n_points").alias("point_count"), "bbox_volume")
    for part in (outlier_ratio(df, k, keys, coords, vid), main_component_ratio(df, keys=keys, coords=coords, vid=vid), local_thickness(df, k, keys, coords, vid)):
        out = out.join(part, list(keys), "left")
    return out


def overlaps(df: DataFrame, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred", extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overlap ``n`` of positive gt and pred, ``n_gt`` of each gt, ``n_pred`` of each pred).

    ``extra`` (*keys, pred) are predicted rows without a ground-truth row; they
    count in ``n_pred``.
    """
    rows = df.select(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred"))
    counts = rows.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    gts = counts.where("gt > 0").groupBy(*keys, "gt").agg(F.sum("n").alias("n_gt"))
    preds = counts.where("pred > 0").select(*keys, "pred", "n")
    if extra is not None:
        preds = preds.unionByName(extra.where("pred > 0").groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n")).select(*keys, "pred", "n"))
    return counts.where("gt > 0 AND pred > 0"), gts, preds.groupBy(*keys, "pred").agg(F.sum("n").alias("n_pred"))


def iou_matrix(df: DataFrame, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred", extra: DataFrame | None = None) -> DataFrame:
    """``(*keys, gt, pred, overlap, n_gt, n_pred, iou, coverage, purity)`` of every gt with every pred of the group, zeros included."""
    n, gts, preds = overlaps(df, keys, gt, pred, extra)
    grid = gts.join(preds, list(keys)) if keys else gts.crossJoin(preds)
    full = grid.join(n, [*keys, "gt", "pred"], "left").withColumn("overlap", F.coalesce("n", F.lit(0)))
    ratio = lambda a, b: safe_div(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    return full.select(*keys, "gt", "pred", "overlap", "n_gt", "n_pred", ratio("overlap", F.col("n_gt") + F.col("n_pred") - F.col("overlap")).alias("iou"), ratio("overlap", "n_gt").alias("coverage"), ratio("overlap", "n_pred").alias("purity"))


def semantic_metrics(df: DataFrame, iou_threshold: float = 0.1, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred", extra: DataFrame | None = None) -> DataFrame:
    """Leaf against the rest per group: tp, fp, fn, tn, Leaf_IoU, Precision, Recall, F1_Dice, Accuracy.

    A prediction is leaf if it meets a ground-truth instance with that IoU.
    """
    leaves = leaf_predictions(iou_matrix(df, keys, gt, pred, extra), iou_threshold, keys).withColumn("_leaf", F.lit(True))
    rows = df.select(*keys, (F.col(gt) > 0).alias("_g"), F.col(pred).alias("pred"))
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, F.lit(False).alias("_g"), "pred"))
    marked = rows.join(leaves, [*keys, "pred"], "left").select(*keys, F.coalesce("_g", F.lit(False)).alias("g"), F.coalesce("_leaf", F.lit(False)).alias("p"))
    g, p = F.col("g"), F.col("p")
    counts = marked.groupBy(*keys).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", safe_div(tp, tp + fp + fn).alias("leaf_iou"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_dice"), safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of min(rows, columns) pairs, by shortest augmenting paths."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in hungarian(cost.T))
    n, m = cost.shape
    by_row, by_col = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        least, came, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, far = start, -1, 0.0
        tree = [start]
        while row >= 0:
            step = far + cost[row] - by_row[row] - by_col
            better = ~closed & (step < least)
            least[better], came[better] = step[better], col
            col = int(np.argmin(np.where(closed, np.inf, least)))
            far, closed[col] = least[col], True
            row = row_of[col]
            if row >= 0:
                tree.append(row)
        by_row[start] += far
        for r in tree[1:]:
            by_row[r] += far - least[int(np.flatnonzero(row_of == r)[0])]
        by_col[closed] -= far - least[closed]
        while col >= 0:
            before = came[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def one_to_one(iou: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, gt, pred, iou)`` of the assignment with the largest sum of IoU. A group is one matrix of instances, not of points."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="gt", columns="pred", values="iou").fillna(0.0)
        pairs = hungarian(-table.to_numpy())
        out = pd.DataFrame([(table.index[r], table.columns[c], table.iat[r, c]) for r, c in pairs], columns=["gt", "pred", "iou"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "gt", "pred", "iou"]]

    types = ", ".join([f"`{k}` {iou.schema[k].dataType.simpleString()}" for k in keys] + [f"gt {iou.schema['gt'].dataType.simpleString()}", f"pred {iou.schema['pred'].dataType.simpleString()}", "iou double"])
    grouped = iou.select(*keys, "gt", "pred", "iou")
    return grouped.groupBy(*keys).applyInPandas(match, types)


def instance_metrics(df: DataFrame, iou_threshold: float = 0.1, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred", extra: DataFrame | None = None) -> DataFrame:
    """Per group: precision, recall and F1 of matched instances at IoU 0.5 and 0.75, and SQ, RQ, PQ at 0.5."""
    iou = cut(iou_matrix(df, keys, gt, pred, extra), "iou")
    leaves = leaf_predictions(iou, iou_threshold, keys)
    pairs = one_to_one(iou.join(leaves, [*keys, "pred"], "left_semi"), keys)
    at = lambda t: F.col("iou") >= t
    hits = pairs.groupBy(*keys).agg(F.count_if(at(0.5)).alias("tp50"), F.count_if(at(0.75)).alias("tp75"), F.sum(F.when(at(0.5), F.col("iou"))).alias("iou50"))
    n_gt = iou.select(*keys, "gt").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    rows = n_gt.join(n_pred, list(keys), "left").join(hits, list(keys), "left").na.fill(0)
    cols = []
    for t in (50, 75):
        tp = F.col(f"tp{t}")
        cols += [safe_div(tp, F.col("n_pred")).alias(f"precision{t}"), safe_div(tp, F.col("n_gt")).alias(f"recall{t}"), safe_div(2 * tp, F.col("n_pred") + F.col("n_gt")).alias(f"f1_{t}")]
    sq, rq = safe_div(F.col("iou50"), F.col("tp50")), safe_div(2 * F.col("tp50"), F.col("n_pred") + F.col("n_gt"))
    return rows.select(*keys, "n_gt", "n_pred", *cols, sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def adjusted_rand(df: DataFrame, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred") -> DataFrame:
    """``(*keys, ari)`` by counting pairs; 1 where no pair disagrees."""
    cells = df.groupBy(*keys, F.col(gt).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cells.groupBy(*keys).agg(two("n").alias("both"), F.sum("n").alias("all"))
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("m")).groupBy(*keys).agg(two("m").alias(name))
    rows = both.join(side("g", "by_g"), list(keys)).join(side("p", "by_p"), list(keys))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("by_g") * F.col("by_p"), pairs), F.lit(0.0))
    top = (F.col("by_g") + F.col("by_p")) / 2
    return rows.select(*keys, F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0)).alias("ari"))


def leaf_rand(df: DataFrame, iou_threshold: float = 0.1, keys: tuple[str, ...] = ("uid",), gt: str = "gt", pred: str = "pred", extra: DataFrame | None = None) -> DataFrame:
    """``(*keys, ari)`` over rows of an instance or of a leaf prediction, extra leaf rows with gt 0; 0 for groups without such rows."""
    leaves = leaf_predictions(iou_matrix(df, keys, gt, pred, extra), iou_threshold, keys).withColumn("_leaf", F.lit(True))
    rows = df.select(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred"))
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, F.lit(0).alias("gt"), "pred"))
    rows = rows.join(leaves, [*keys, "pred"], "left")
    scored = adjusted_rand(rows.where((F.col("gt") > 0) | F.col("_leaf")), keys, "gt", "pred")
    return df.select(*keys).distinct().join(scored, list(keys), "left").na.fill(0.0, ["ari"])


def distance_report(near: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Of ``(*keys, near_vid, d)``: counts, match rate and the distance's percentiles."""
    counts = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count("near_vid").alias("n_matched"))
    rows = counts.alias("c").join(group_quantiles(near, {"_q": (F.col("d"), [0.5, 0.95, 0.99])}, keys).alias("q"), _same("c", "q", keys)).select("c.*", "q._q")
    return rows.select(*keys, "n_points", "n_matched", (F.col("n_matched") / F.col("n_points")).alias("match_rate"), *[F.col("_q")[i].alias(f"nn_p{p}") for i, p in enumerate((50, 95, 99))])


def matrix_csv(iou: DataFrame, value: str = "iou", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per gt with a column for each pred; the width is the number of predicted instances."""
    return iou.withColumn("_p", F.concat(F.lit("P"), F.col("pred"))).groupBy(*keys, "gt").pivot("_p").agg(F.first(value))


