"""Outlier removal, density clusters and components of clouds."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.functions.scalars import is_finite, relabel_contiguous
from phyllo.operators.aggregates import bounding_box, largest_clusters, mad_stats, mean_std, sample_rows
from phyllo.operators.components import connected_components, smallest_reaching
from phyllo.operators.grouped import per_group
from phyllo.operators.quantiles import group_quantiles
from phyllo.operators.spatial import COORDS, knn_join, nearest_centroid, nearest_join, radius_join
from phyllo.session import cut


def _same(a: str, b: str, names) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _components_in_groups(edges: DataFrame, keys: tuple[str, ...], of=connected_components) -> DataFrame:
    """``(*keys, vid, component)`` of ``(*keys, src, dst)`` edges, components numbered by their smallest vid."""
    node = lambda c: F.struct(*keys, F.col(c).alias("vid"))
    found = of(edges.select(node("src").alias("src"), node("dst").alias("dst")))
    return found.select("node.*", F.col("component.vid").alias("component"))


def mean_knn_distance(df: DataFrame, k: int, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", sample: DataFrame | None = None) -> DataFrame:
    """``(*keys, vid, score)``: mean distance to the k nearest others, of all rows or of a sample's."""
    pairs = knn_join(df if sample is None else sample, df, k, keys, coords, vid, drop_self=True)
    return pairs.groupBy(*keys, F.col("src").alias(vid)).agg(F.avg("d").alias("score"))


def sor_mad(df: DataFrame, k: int = 16, multiplier: float = 3.0, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """Rows whose mean neighbour distance is at most median + m * 1.4826 * MAD; groups of at most max(2, k) rows stay whole."""
    scores = cut(mean_knn_distance(df, k, keys, coords, vid), "sor")
    stats = mad_stats(scores, "score", keys)
    limit = stats.select(*keys, (F.col("median") + multiplier * 1.4826 * F.col("mad")).alias("_most"))
    bad = scores.alias("s").join(limit.alias("l"), _same("s", "l", keys)).where(F.col("s.score") > F.col("l._most")).select(*[F.col(f"s.{c}").alias(c) for c in (*keys, vid)])
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(2, k))
    bad = bad.alias("b").join(big.alias("g"), _same("b", "g", keys), "left_semi")
    return df.alias("a").join(bad.alias("b"), _same("a", "b", (*keys, vid)), "left_anti")


def sor_std(df: DataFrame, k: int = 16, ratio: float = 2.0, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", reference: DataFrame | None = None) -> DataFrame:
    """Rows whose mean neighbour distance is at most mean + r * deviation; neighbours are of ``reference`` (a sample), the first dropped."""
    pairs = knn_join(df, df if reference is None else reference, k + 1, keys, coords, vid).where(F.col("rank") > 1)
    scores = cut(pairs.groupBy(*keys, F.col("src").alias(vid)).agg(F.avg("d").alias("score")), "sor")
    limit = mean_std(scores, "score", keys).select(*keys, (F.col("mean") + ratio * F.col("std")).alias("_most"))
    bad = scores.alias("s").join(limit.alias("l"), _same("s", "l", keys)).where(F.col("s.score") > F.col("l._most")).select(*[F.col(f"s.{c}").alias(c) for c in (*keys, vid)])
    return df.alias("a").join(bad.alias("b"), _same("a", "b", (*keys, vid)), "left_anti")


def _extremes(points: DataFrame, cells: tuple[str, ...], coords: tuple[str, ...]) -> DataFrame:
    """Per cell the coordinates' ends, and for every direction of the neighbouring cells the point that lies farthest that way."""
    ends = [f(c).alias(f"_{s}_{c}") for c in coords for s, f in (("lo", F.min), ("hi", F.max))]
    spot = F.struct(*[F.col(c).alias(c) for c in coords])
    ways = [way for way in itertools.product((-1, 0, 1), repeat=len(coords)) if any(way)]
    far = [F.max_by(spot, reduce(lambda x, y: x + y, [F.col(c) * w for c, w in zip(coords, way, strict=True)])).alias(_way(way)) for way in ways]
    return points.groupBy(*cells).agg(*ends, *far)


def _way(way) -> str:
    return "_f" + "".join("mzp"[w + 1] for w in way)


def _joined_cells(dense: DataFrame, links: DataFrame, keys: tuple[str, ...], coords: tuple[str, ...]) -> DataFrame:
    """``(node, component)`` of cells over ``links`` and over those between ``dense`` cells, of which two points are within ``_eps``.

    Two dense cells are first tried by the points of each that lie farthest
    towards the other. Pairs of cells that are not in one component by then are
    searched point by point, of which only those near the other cell's box take part.
    """
    cells = (*keys, *[f"_k{i}" for i in range(len(coords))])
    table = cut(_extremes(dense, (*cells, "_eps"), coords), "dbscan-cells")
    steps = [step for step in itertools.product((-2, -1, 0, 1, 2), repeat=len(coords)) if step > (0,) * len(coords)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(s)]) for s in steps]))
    one = table.withColumn("_s", step).alias("a")
    there = [F.col(f"a._k{i}") + F.col(f"_s.s{i}") == F.col(f"b._k{i}") for i in range(len(coords))]
    pairs = one.join(table.alias("b"), reduce(lambda x, y: x & y, there + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]))
    sign = [F.signum(F.col(f"_s.s{i}").cast("double")).cast("int") for i in range(len(coords))]

    def tip(side: str, turn: int):
        found = F.lit(None)
        for way in itertools.product((-1, 0, 1), repeat=len(coords)):
            if any(way):
                found = F.when(reduce(lambda x, y: x & y, [s == w for s, w in zip(sign, way, strict=True)]), F.col(f"{side}.{_way(tuple(turn * w for w in way))}")).otherwise(found)
        return found

    tried = pairs.select(F.struct(*[F.col(f"a.{c}").alias(c) for c in cells]).alias("src"), F.struct(*[F.col(f"b.{c}").alias(c) for c in cells]).alias("dst"), F.col("a._eps").alias("_eps"), tip("a", 1).alias("_p"), tip("b", -1).alias("_q"))
    apart = F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"_p.{c}") - F.col(f"_q.{c}")) * (F.col(f"_p.{c}") - F.col(f"_q.{c}")) for c in coords]))
    tried = cut(tried.select("src", "dst", (apart <= F.col("_eps")).alias("near")), "dbscan-tried")
    home = connected_components(links.unionByName(tried.where("near").select("src", "dst")))
    of = lambda end: home.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    open_ = cut(tried.where("NOT near").join(of("src"), "src", "left").join(of("dst"), "dst", "left").where(~F.coalesce("_src", "src").eqNullSafe(F.coalesce("_dst", "dst"))).select("src", "dst"), "dbscan-open")
    if not open_.limit(1).count():
        return home
    node = F.struct(*[F.col(c) for c in cells])
    boxes = table.select(node.alias("node"), *[f"_{s}_{c}" for c in coords for s in ("lo", "hi")])
    points = dense.select(node.alias("node"), "_eps", *coords)
    away = reduce(lambda x, y: x + y, [F.pow(F.greatest(F.col(f"_lo_{c}") - F.col(c), F.col(c) - F.col(f"_hi_{c}"), F.lit(0.0)), F.lit(2)) for c in coords])

    def facing(own: str, other: str) -> DataFrame:
        met = open_.join(boxes.withColumnRenamed("node", other), other).join(points.withColumnRenamed("node", own), own)
        return met.where(away <= F.col("_eps") * F.col("_eps") * 1.000001).select("src", "dst", "_eps", *[F.col(c).alias(f"{own}_{c}") for c in coords])

    met = facing("src", "dst").join(facing("dst", "src").drop("_eps"), ["src", "dst"])
    apart = F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"src_{c}") - F.col(f"dst_{c}")) * (F.col(f"src_{c}") - F.col(f"dst_{c}")) for c in coords]))
    more = cut(met.where(apart <= F.col("_eps")).select("src", "dst").distinct(), "dbscan-more")
    if not more.limit(1).count():
        return home
    return connected_components(more.unionByName(home.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def dbscan(df: DataFrame, eps: float | str, min_points: int, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, label, is_core)``: density clusters numbered from 0 by their smallest core vid, -1 for noise.

    A core point has at least ``min_points`` rows within ``eps``, itself counted;
    clusters are the components of core points within ``eps`` of each other; a
    border point joins the first cluster that it touches. Rows with a null or
    non-finite coordinate are noise.

    Points lie in cells whose diagonal is ``eps``, so the points of a cell are all
    within ``eps`` of each other: a cell with ``min_points`` of them is dense, all
    its points are core and in one cluster. Only points of other cells, of which
    a cell has fewer than ``min_points``, meet their neighbours one by one; so
    the pairs grow with the points and not with the square of their density.
    """
    width = (F.col(eps).cast("double") if isinstance(eps, str) else F.lit(float(eps))) / len(coords) ** 0.5
    fine = reduce(lambda x, y: x & y, [is_finite(c) for c in coords])
    places = {f"_k{i}": F.floor(F.col(c) / (width * 0.999999)).cast("long") for i, c in enumerate(coords)}
    rows = df.where(fine).select(*keys, F.col(vid).alias("vid"), *[F.col(c).cast("double").alias(c) for c in coords], (F.col(eps).cast("double") if isinstance(eps, str) else F.lit(float(eps))).alias("_eps"))
    cells = (*keys, *places)
    rows = cut(per_group(cut(rows.withColumns(places), "dbscan-rows"), {"_n": F.count(F.lit(1))}, cells), "dbscan-rows")
    dense, sparse = rows.where(F.col("_n") >= min_points), rows.where(F.col("_n") < min_points)
    pairs = cut(radius_join(sparse, rows, "_eps", keys, coords, "vid").select(*keys, "src", "dst"), "dbscan-pairs")
    counted = pairs.groupBy(*keys, F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(*keys, "vid")
    cell = F.struct(*[F.col(c) for c in cells]).alias("cell")
    core = dense.select(*keys, "vid", cell).unionByName(sparse.alias("s").join(counted.alias("c"), _same("s", "c", (*keys, "vid")), "left_semi").select("s.*").select(*keys, "vid", cell))
    core = cut(core, "dbscan-core")
    end = lambda name: core.select(*keys, F.col("vid").alias(name), F.col("cell").alias(f"{name}_cell"))
    touching = cut(pairs.alias("p").join(end("dst").alias("c"), _same("p", "c", (*keys, "dst"))).select("p.*", "c.dst_cell"), "dbscan-touching")  # dst is a core point
    inner = touching.alias("p").join(end("src").alias("c"), _same("p", "c", (*keys, "src"))).select(F.col("c.src_cell").alias("src"), F.col("p.dst_cell").alias("dst")).distinct()
    links = cut(inner.unionByName(core.select(F.col("cell").alias("src"), F.col("cell").alias("dst")).distinct()), "dbscan-links")
    found = _joined_cells(dense, links, keys, coords) if dense.limit(1).count() else connected_components(links)
    placed = cut(core.join(found, F.col("cell") == F.col("node")).select(*keys, "vid", "component"), "dbscan-homes")
    heads = placed.groupBy(*keys, "component").agg(F.min("vid").alias("_first"))
    heads = heads.withColumn("label", (F.row_number().over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("_first")) - 1).cast("int"))  # a row for each cluster
    labels = cut(placed.alias("h").join(heads.alias("n"), _same("h", "n", (*keys, "component"))).select(*[F.col(f"h.{c}").alias(c) for c in (*keys, "vid")], "n.label"), "dbscan-labels")
    border = touching.alias("p").join(labels.alias("h"), _same("p", "h", keys) & (F.col("p.dst") == F.col("h.vid"))).groupBy(*[F.col(f"p.{c}").alias(c) for c in keys], F.col("p.src").alias("vid")).agg(F.min("h.label").alias("label"))
    out = df.select(*keys, F.col(vid).alias("vid")).alias("d").join(labels.alias("h"), _same("d", "h", (*keys, "vid")), "left").join(border.alias("b"), _same("d", "b", (*keys, "vid")), "left")
    return out.select(*[F.col(f"d.{c}").alias(c) for c in keys], F.col("d.vid").alias(vid), F.coalesce("h.label", "b.label", F.lit(-1)).alias("label"), F.col("h.label").isNotNull().alias("is_core"))


def dbscan_keep(df: DataFrame, eps: float, min_points: int, least_core: int, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """Rows of clusters with at least ``least_core`` core points, and border points that touch such a cluster."""
    labels = cut(dbscan(df, eps, min_points, keys, coords, vid), "dbscan-keep")
    big = labels.where("is_core").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_core)
    core = labels.where("is_core").alias("l").join(big.alias("b"), _same("l", "b", (*keys, "label")), "left_semi")
    cores = df.alias("a").join(core.alias("c"), _same("a", "c", (*keys, vid)), "left_semi")
    others = df.alias("a").join(labels.where("NOT is_core").alias("l"), _same("a", "l", (*keys, vid)), "left_semi")
    touch = radius_join(others, cores, eps, keys, coords, vid).select(*keys, F.col("src").alias(vid)).distinct()
    kept = core.select(*keys, vid).unionByName(touch)
    return df.alias("a").join(kept.alias("k"), _same("a", "k", (*keys, vid)), "left_semi")


def plant_keep(df: DataFrame, sor_k: int = 16, multiplier: float = 3.0, eps: float = 0.05, min_points: int = 10, least_core: int = 50, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``df`` with ``keep``: outlier removal, then density clusters of what it leaves."""
    kept = dbscan_keep(cut(sor_mad(df, sor_k, multiplier, keys, coords, vid), "plant"), eps, min_points, least_core, keys, coords, vid).select(*keys, vid).withColumn("_k", F.lit(True))
    return df.alias("a").join(kept.alias("k"), _same("a", "k", (*keys, vid)), "left").select("a.*", F.coalesce("k._k", F.lit(False)).alias("keep"))


def auto_eps(df: DataFrame, multiplier: float, k: int = 8, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, eps)``: so many times the median of all neighbour distances; 1e-6 for groups of at most k rows; where the median is 0, a share of the span."""
    pairs = knn_join(df, df, k, keys, coords, vid, drop_self=True)
    medians = group_quantiles(pairs, {"_m": (F.col("d"), [0.5])}, keys).withColumn("_e", F.col("_m")[0] * multiplier)
    span = reduce(F.greatest, [F.col(f"max_{c}") - F.col(f"min_{c}") for c in coords])
    boxes = bounding_box(df, keys, coords).withColumn("_span", span)
    eps = F.when(F.col("n_points") <= k, 1e-6).when(F.col("_e") > 0, F.col("_e")).otherwise(F.greatest(0.002 * F.col("_span"), F.lit(1e-6)))
    return boxes.alias("b").join(medians.alias("m"), _same("b", "m", keys), "left").select(*[F.col(f"b.{c}").alias(c) for c in keys], eps.alias("eps"))


def point_spacing(df: DataFrame, k: int = 8, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", sample: DataFrame | None = None) -> DataFrame:
    """``(*keys, spacing)``: median distance to the k-th nearest other, of all rows or of a sample's."""
    pairs = knn_join(df if sample is None else sample, df, k, keys, coords, vid, drop_self=True)
    farthest = cut(pairs.groupBy(*keys, "src").agg(F.max("d").alias("d")), "spacing")
    return group_quantiles(farthest, {"_m": (F.col("d"), [0.5])}, keys).select(*keys, F.col("_m")[0].alias("spacing"))


def sampled_dbscan_filter(df: DataFrame, eps: float, min_points: int, most: int, seed: int = 0, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """Rows within ``eps`` of a sampled row of a large cluster; if the clusters leave nothing, all rows. The sample has ``most`` rows of each cloud."""
    sample = cut(sample_rows(df, most, seed, vid, keys=keys), "dbscan-sample")
    kept = largest_clusters(dbscan(sample, eps, min_points, keys, coords, vid), keys=keys)
    chosen = sample.alias("a").join(kept.alias("k"), _same("a", "k", (*keys, vid)), "left_semi")
    near = nearest_join(df, chosen, keys, coords, vid, eps).where(F.col("near_vid").isNotNull())
    out = cut(df.alias("a").join(near.alias("n"), _same("a", "n", (*keys, vid)), "left_semi"), "dbscan-filter")
    return out if out.limit(1).count() else df


def radius_components(df: DataFrame, radius: float, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, component)`` over steps of at most ``radius``; component is the smallest vid.

    These are density clusters in which every point is core: the points of a cell
    are one node, and touching cells are tried by their outermost points first. So
    a crowd within the radius makes no more rows than it has points. Rows with a
    null or non-finite coordinate are in no component.
    """
    own = [f"_of{i}" for i in range(len(keys))]  # a key may be called like what density clusters add
    slim = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(vid).alias("vid"), *coords)
    labels = cut(dbscan(slim, radius, 1, tuple(own), coords, "vid").where("is_core"), "radius-components")
    found = per_group(labels, {"component": F.min("vid")}, (*own, "label"))
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "vid", "component")


def largest_component(df: DataFrame, radius: float = 0.03, label: str = "label", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", least: int = 150, renumber: bool = False) -> DataFrame:
    """Labels with the rows outside of an instance's largest component set to 0; instances of fewer than ``least`` rows, and components of no more, go. ``renumber``: those kept count from 1."""
    groups = (*keys, label)
    rows = df.where(F.col(label) > 0)
    sized = per_group(rows, {"_n": F.count(F.lit(1))}, groups).where(F.col("_n") >= least)
    homes = cut(radius_components(sized, radius, groups, coords, vid).select(*groups, "vid", "component"), "components")
    counts = homes.groupBy(*groups, "component").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*groups).agg(F.max(F.struct("n", -F.col("component"))).alias("b")).where(F.col("b.n") > least).select(*groups, (-F.col("b.col2")).alias("component"))
    kept = homes.alias("h").join(best.alias("b"), _same("h", "b", (*groups, "component")), "left_semi").select(*keys, F.col("vid").alias(vid), F.lit(True).alias("_k"))
    out = df.alias("a").join(kept.alias("k"), _same("a", "k", (*keys, vid)), "left")
    out = out.select(*[F.when(F.col("k._k"), F.col(f"a.{c}")).otherwise(F.lit(0).cast(df.schema[c].dataType)).alias(c) if c == label else F.col(f"a.{c}") for c in df.columns])
    return relabel_contiguous(cut(out, "components"), label, keys) if renumber else out


def scan_components(df: DataFrame, radius: float | str, cap: int = 16, label: str = "label", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", ordered: bool = False) -> DataFrame:
    """``(*keys, label, vid, part)``: components of each label over edges to the ``cap`` nearest within ``radius``; ``part`` is the smallest vid.

    By default edges count in both directions. With ``ordered`` they are followed
    as they are directed, from the rows in ascending order: a row falls to the
    smallest row that reaches it.
    """
    groups = (*keys, label)
    rows = df.where(F.col(label) > 0)
    pairs = knn_join(rows, rows, cap, groups, coords, vid, drop_self=True)
    if isinstance(radius, str):
        limits = rows.select(*groups, F.col(vid).alias("src"), F.col(radius).alias("_r"))
        pairs = pairs.alias("p").join(limits.alias("l"), _same("p", "l", (*groups, "src"))).where(F.col("p.d") <= F.col("l._r")).select("p.*")
    else:
        pairs = pairs.where(F.col("d") <= radius)
    edges = pairs.select(*groups, "src", "dst").unionByName(rows.select(*groups, F.col(vid).alias("src"), F.col(vid).alias("dst")))
    homes = _components_in_groups(edges, groups, smallest_reaching if ordered else connected_components)
    return homes.select(*groups, F.col("vid").alias(vid), F.col("component").alias("part"))


def split_labels(df: DataFrame, radius: float | str, least: int, cap: int = 16, label: str = "label", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``df`` with each label split into its components of at least ``least`` rows.

    New ids count from 1 by old label, then size from the largest, then smallest
    vid. A label without a large component keeps its largest; the rows of small
    ones go to the large part of the same label with the nearest centroid.
    """
    parts = cut(scan_components(df, radius, cap, label, keys, coords, vid), "split-parts")
    groups = (*keys, label)
    placed = df.alias("a").join(parts.alias("p"), _same("a", "p", (*groups, vid))).select("a.*", F.col("p.part"))
    sizes = placed.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in coords])
    ranked = sizes.withColumn("_r", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("n"), "part")))
    large = cut(ranked.where((F.col("n") >= least) | (F.col("_r") == 1)), "split-large")
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(label, F.desc("n"), "part")
    named = large.withColumn("new_label", F.row_number().over(order)).select(*groups, "part", "new_label")
    small = ranked.alias("s").join(large.alias("l"), _same("s", "l", (*groups, "part")), "left_anti")
    moved = nearest_centroid(small.select(*groups, "part", *coords), large.select(*groups, "part", *coords), label, keys, coords)
    moved = moved.alias("m").join(named.alias("n"), _same("m", "n", groups) & (F.col("m.near_part") == F.col("n.part"))).select(*[F.col(f"m.{c}").alias(c) for c in (*groups, "part")], "n.new_label")
    homes = named.unionByName(moved)
    tagged = placed.alias("a").join(homes.alias("h"), _same("a", "h", (*groups, "part"))).select(*[F.col(f"a.{c}").alias(c) for c in (*keys, vid)], F.col("h.new_label"))
    out = df.alias("a").join(tagged.alias("t"), _same("a", "t", (*keys, vid)), "left")
    return out.select(*[F.coalesce("t.new_label", F.lit(0)).alias(c) if c == label else F.col(f"a.{c}") for c in df.columns])


def prompt_component(df: DataFrame, prompt: tuple[float, ...], radius: float, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """Of a mask's rows, those connected over steps of ``radius`` with the row nearest to the prompt."""
    away = reduce(lambda a, b: a + b, [F.pow(F.col(c).cast("double") - p, F.lit(2)) for c, p in zip(coords, prompt, strict=True)])
    seed = df.groupBy(*keys).agg(F.min(F.struct(away.alias("d"), F.col(vid).alias("v"))).alias("_s")).select(*keys, F.col("_s.v").alias("vid"))
    homes = cut(radius_components(df, radius, keys, coords, vid), "prompt")
    chosen = homes.alias("h").join(seed.alias("s"), _same("h", "s", (*keys, "vid"))).select(*[F.col(f"h.{c}").alias(c) for c in keys], "h.component")
    kept = homes.alias("h").join(chosen.alias("c"), _same("h", "c", (*keys, "component")), "left_semi").withColumnRenamed("vid", "_vid")
    return df.alias("a").join(kept.alias("k"), (_same("a", "k", keys) if keys else F.lit(True)) & (F.col(f"a.{vid}") == F.col("k._vid")), "left_semi")
