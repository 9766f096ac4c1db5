"""Instance refinement and mask assignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.functions.scalars import relabel_contiguous, safe_div
from phyllo.operators.aggregates import numbered
from phyllo.operators.clustering import _same
from phyllo.operators.components import connected_components
from phyllo.operators.filters import drop_small_labels
from phyllo.operators.grouped import per_group
from phyllo.operators.spatial import COORDS, knn_join
from phyllo.session import cut


def label_edges(labels: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("uid",), label: str = "label", vid: str = "vid") -> DataFrame:
    """``(*keys, a, b, n)``: neighbour edges between two different positive labels, a < b, each direction counted."""
    tag = lambda end, name: labels.select(*keys, F.col(vid).alias(end), F.col(label).alias(name))
    both = edges.join(tag("src", "la"), [*keys, "src"]).join(tag("dst", "lb"), [*keys, "dst"])
    both = both.where((F.col("la") > 0) & (F.col("lb") > 0) & (F.col("la") != F.col("lb")))
    return both.groupBy(*keys, F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def merge_adjacent(labels: DataFrame, edges: DataFrame, least_ratio: float, least_edges: int, keys: tuple[str, ...] = ("uid",), label: str = "label", vid: str = "vid") -> DataFrame:
    """``labels`` with labels joined that share enough edges, also for the smaller one's size; each group takes its smallest label."""
    sizes = labels.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("size"))
    size = lambda end: sizes.select(*keys, F.col(label).alias(end), F.col("size").alias(f"size_{end}"))
    strong = label_edges(labels, edges, keys, label, vid).join(size("a"), [*keys, "a"]).join(size("b"), [*keys, "b"])
    strong = strong.where((F.col("n") >= least_edges) & (F.col("n") / F.least("size_a", "size_b") >= least_ratio))
    node = lambda c: F.struct(*keys, F.col(c).alias("l"))
    homes = connected_components(strong.select(node("a").alias("src"), node("b").alias("dst"))).select("node.*", F.col("component.l").alias("_home"))
    out = labels.join(homes.withColumnRenamed("l", label), [*keys, label], "left")
    return out.withColumn(label, F.coalesce("_home", label)).select(labels.columns)


def smooth_once(labels: DataFrame, edges: DataFrame, least_votes: int, keys: tuple[str, ...] = ("uid",), label: str = "label", vid: str = "vid") -> DataFrame:
    """``labels`` after one vote: the commonest positive label among a row's neighbours wins, of equals the one met first by rank, if it has enough votes."""
    votes = edges.join(labels.select(*keys, F.col(vid).alias("dst"), F.col(label).alias("_l")), [*keys, "dst"]).where("_l > 0")
    counts = votes.groupBy(*keys, "src", "_l").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    winner = counts.groupBy(*keys, F.col("src").alias(vid)).agg(F.max_by(F.struct("_l", "n"), F.struct(F.col("n"), -F.col("first"))).alias("_w"))
    out = labels.join(winner, [*keys, vid], "left")
    return out.withColumn(label, F.when(F.col("_w.n") >= least_votes, F.col("_w._l")).otherwise(F.col(label))).select(labels.columns)


def smooth_labels(labels: DataFrame, edges: DataFrame, iterations: int, least_votes: int, keys: tuple[str, ...] = ("uid",), label: str = "label", vid: str = "vid") -> DataFrame:
    """So many votes, all rows at once in each; every round is written to the shared folder."""
    for _ in range(iterations):
        labels = cut(smooth_once(labels, edges, least_votes, keys, label, vid), "smooth")
    return labels


def refine_instances(df: DataFrame, k: int = 16, least: int = 50, merge_ratio: float = 0.2, merge_edges: int = 20, iterations: int = 2, least_votes: int = 8, keys: tuple[str, ...] = ("uid",), label: str = "label", coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """Small labels go, adjacent ones merge, votes smooth, small ones go again, and labels count from 1."""
    edges = cut(knn_join(df, df, k, keys, coords, vid, drop_self=True), "refine-edges")
    labels = cut(drop_small_labels(df, least, label, keys), "refine")
    labels = cut(merge_adjacent(labels, edges, merge_ratio, merge_edges, keys, label, vid), "refine")
    labels = smooth_labels(labels, edges, iterations, least_votes, keys, label, vid)
    return relabel_contiguous(drop_small_labels(labels, least, label, keys), label, keys)


# Fixed value: rows of masks that a task meets, of which each makes a few pairs.
OVERLAP_ROWS = 500_000


def mask_overlaps(cells: DataFrame, keys: tuple[str, ...] = ("uid",), mask: str = "mask_id", vid: str = "vid") -> DataFrame:
    """``(*keys, a, b, iou)`` of every two masks that share a point, a < b. ``cells`` has a row for each mask and point.

    The number of tasks follows the rows, so what a task holds doesn't grow with them;
    pairs are counted where they are dealt to, since few repeat within a task before.
    """
    cells = cut(cells, "mask-cells")
    sizes = cells.groupBy(*keys, mask).agg(F.count(F.lit(1)).alias("size"))
    size = lambda end: sizes.select(*keys, F.col(mask).alias(end), F.col("size").alias(f"size_{end}"))
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // OVERLAP_ROWS))
    one = cells.select(*keys, vid, F.col(mask).alias("a")).repartition(parts, *keys, vid)
    two = cells.select(*keys, vid, F.col(mask).alias("b")).repartition(parts, *keys, vid)
    met = one.join(two.hint("merge"), [*keys, vid]).where("a < b").select(*keys, "a", "b")
    both = met.repartition(parts, *keys, "a", "b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = both.join(size("a"), [*keys, "a"]).join(size("b"), [*keys, "b"])
    return both.select(*keys, "a", "b", safe_div(F.col("n"), F.col("size_a") + F.col("size_b") - F.col("n")).alias("iou"))


def nms_masks(cells: DataFrame, scores: DataFrame, threshold: float, keys: tuple[str, ...] = ("uid",), mask: str = "mask_id", vid: str = "vid") -> DataFrame:
    """``(*keys, mask, score, rank)`` of the masks kept: by falling score (of equals by id), those whose IoU with every kept one is below the threshold.

    Points are only counted by joins. Masks are decided in rounds: one that no
    undecided mask before it clashes with is kept, and all that clash with it go.
    So the rounds are as many as the longest chain of clashing masks that fall in
    score, however many masks a group has. Null scores come last.
    """
    node = lambda c: F.struct(*keys, F.col(c).alias("m"))
    valued = scores.select(*keys, mask, F.col("score").cast("double").alias("score"))
    order = F.struct(-F.coalesce("score", F.lit(float("-inf"))), F.col(mask))
    open_ = cut(valued.select(node(mask).alias("node"), order.alias("order")), "nms-open")
    clash = mask_overlaps(cells, keys, mask, vid).where(F.col("iou") >= threshold).select(node("a").alias("a"), node("b").alias("b"))
    of = lambda end: open_.select(F.col("node").alias(end), F.col("order").alias(f"of_{end}"))
    both = clash.join(of("a"), "a").join(of("b"), "b")
    before = F.col("of_a") < F.col("of_b")
    edges = cut(both.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("then")), "nms-edges")
    open_, kept = open_.select("node"), []
    while True:
        free = cut(open_.join(edges.select(F.col("then").alias("node")), "node", "left_anti"), "nms-kept")
        kept.append(free)
        gone = edges.join(free.withColumnRenamed("node", "first"), "first", "left_semi").select(F.col("then").alias("node")).distinct()
        decided = cut(free.unionByName(gone), "nms-decided")
        edges = edges.join(decided.withColumnRenamed("node", "first"), "first", "left_anti").join(decided.withColumnRenamed("node", "then"), "then", "left_anti")
        edges = cut(edges, "nms-edges")
        open_ = cut(open_.join(decided, "node", "left_anti"), "nms-open")
        if open_.isEmpty():
            break
    chosen = valued.withColumn("_node", node(mask)).join(reduce(DataFrame.unionByName, kept).withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node")
    placed = cut(numbered(chosen.withColumn("_by", F.struct(*keys, order.alias("order"))), "_by", "_at"), "nms-placed")
    return per_group(placed, {"_first": F.min("_at")}, keys).select(*keys, mask, "score", (F.col("_at") - F.col("_first")).alias("rank"))


def assign_instances(cells: DataFrame, mode: str = "score", keys: tuple[str, ...] = ("uid",), vid: str = "vid") -> DataFrame:
    """``(*keys, vid, instance_id)`` from ``(*keys, vid, rank, score)``: by ``score`` the mask that scores a point highest, of equals the first; by ``order`` the first. Ids count from 1."""
    pick = F.max_by("rank", F.struct(F.col("score"), -F.col("rank"))) if mode == "score" else F.min("rank")
    return cells.groupBy(*keys, vid).agg((pick + 1).alias("instance_id"))


def merge_clicks(cells: DataFrame, mode: str = "later", keys: tuple[str, ...] = ("uid",), vid: str = "vid", click: str = "click") -> DataFrame:
    """``(*keys, vid, instance_id)`` of points covered by clicks numbered from 1: ``later`` or ``earlier`` wins, or overlaps go to the ``background``.

    With ``background`` each further click on a point takes it away or gives it
    back: an even number of clicks leaves 0, an odd one the last.
    """
    if mode == "background":
        pick = F.when(F.count(F.lit(1)) % 2 == 0, F.lit(0)).otherwise(F.max(click))
    else:
        pick = F.max(click) if mode == "later" else F.min(click)
    return cells.groupBy(*keys, vid).agg(pick.alias("instance_id"))


def choose_masks(candidates: DataFrame, keys: tuple[str, ...] = ("view_id", "box_id"), least_green: float = 0.1) -> DataFrame:
    """``(*keys, mask_id)``: of ``(*keys, mask_id, score, n_pixels, n_green)`` the mask of the largest green share if above the limit, else of the largest score."""
    share = F.when(F.col("n_pixels") > 0, F.col("n_green") / F.col("n_pixels"))
    best = candidates.withColumn("_share", share).groupBy(*keys).agg(
        F.max("_share").alias("_most"),
        F.max_by("mask_id", F.struct(F.col("_share"), -F.col("mask_id"))).alias("_green"),
        F.max_by("mask_id", F.struct(F.col("score"), -F.col("mask_id"))).alias("_score"),
    )
    return best.select(*keys, F.when(F.col("_most") > least_green, F.col("_green")).otherwise(F.col("_score")).alias("mask_id"))


def combine_masks(pixels: DataFrame, chosen: DataFrame, on: tuple[str, ...] = ("view_id", "box_id", "mask_id"), pixel: tuple[str, ...] = ("view_id", "v", "u")) -> DataFrame:
    """Pixels of any chosen mask."""
    return pixels.join(chosen, list(on), "left_semi").select(*pixel).distinct()


# Least pixels of a mask, its largest shares of the picture and of the skeleton, and its least skeleton pixels;
# the share at which an id takes a mask over, the one below which a mask over several ids is passed over, and the pixels that a new id needs more than.
LEAF_PIXELS, LEAF_SHARE, LEAF_SKELETON_SHARE, LEAF_SKELETON_PIXELS = 15, 0.06, 0.30, 5
TAKEN_SHARE, TORN_SHARE, FREE_PIXELS = 0.35, 0.25, 10


def paint_leaves(pixels: DataFrame, skeleton: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """``(*keys, v, u, leaf_id)``: candidate masks painted in their order over each view.

    ``pixels`` is ``(*keys, rank, v, u)``, ``skeleton`` ``(*keys, v, u)``, ``sizes``
    ``(*keys, height, width)``. A mask is passed over if it has under 15 pixels,
    over 6 % of the picture, over 30 % of the skeleton or under 5 of its pixels;
    it takes over an id that holds over 35 % of it; it is passed over if it meets
    two ids or more of which none holds 25 %; else its free pixels, if more than
    10, get a new id. A view is one picture, so the fold over its masks, whose
    order matters, runs in one task a view.
    """
    rows = pixels.join(sizes, list(keys))
    spots = skeleton.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("v").alias("_v"), F.col("u").alias("_u"))  # named apart, as it may come from the same table

    def paint(pdf: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({**{k: pdf[k] for k in keys}, "v": [], "u": [], "leaf_id": []})
        height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        lines = lines.rename(columns={"_v": "v", "_u": "u"})[["v", "u"]].drop_duplicates()
        total = len(lines)
        pdf = pdf.merge(lines.assign(_s=1), on=["v", "u"], how="left").fillna({"_s": 0})
        canvas, following = np.zeros((height, width), np.int32), 1
        for _, mask in pdf.sort_values("rank").groupby("rank"):
            v, u, area, on_skeleton = mask["v"].to_numpy(), mask["u"].to_numpy(), len(mask), int(mask["_s"].sum())
            if area < LEAF_PIXELS or area > LEAF_SHARE * height * width or (total and on_skeleton > LEAF_SKELETON_SHARE * total) or on_skeleton < LEAF_SKELETON_PIXELS:
                continue
            under = canvas[v, u]
            ids, counts = np.unique(under[under > 0], return_counts=True)
            share = counts.max() / (area + 1e-6) if len(ids) else 0.0
            if share > TAKEN_SHARE:
                canvas[v, u] = ids[counts.argmax()]
            elif not (len(ids) >= 2 and share < TORN_SHARE) and (under == 0).sum() > FREE_PIXELS:
                free = under == 0
                canvas[v[free], u[free]] = following
                following += 1
        v, u = np.nonzero(canvas)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(v) for k in keys}, "v": v, "u": u, "leaf_id": canvas[v, u]})

    types = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).cogroup(spots.groupBy(*[f"_{k}" for k in keys])).applyInPandas(paint, f"{types}, v long, u long, leaf_id int")


def prompt_points(boxes: DataFrame, skeleton: DataFrame, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """``(*keys, box_id, px, py)``: median of the skeleton's pixels in a box (x1, y1, x2, y2; ends excluded), else the box's middle."""
    on = reduce(lambda a, b: a & b, [F.col(f"b.{k}") == F.col(f"s.{k}") for k in keys])
    inside = (F.col("s.u") >= F.col("b.x1")) & (F.col("s.u") < F.col("b.x2")) & (F.col("s.v") >= F.col("b.y1")) & (F.col("s.v") < F.col("b.y2"))
    hits = boxes.alias("b").join(skeleton.alias("s"), on & inside).groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "b.box_id").agg(F.median("s.u").alias("_x"), F.median("s.v").alias("_y"))
    middle = lambda a, b: F.floor((F.col(f"b.{a}") + F.col(f"b.{b}")) / 2).cast("double")
    return boxes.alias("b").join(hits.alias("h"), _same("b", "h", (*keys, "box_id")), "left").select(*[F.col(f"b.{k}").alias(k) for k in (*keys, "box_id")], F.coalesce("h._x", middle("x1", "x2")).alias("px"), F.coalesce("h._y", middle("y1", "y2")).alias("py"))
