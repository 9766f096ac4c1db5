"""Nearest-neighbour, radius and quantised-key joins over grids.

Points are dealt to cubic cells of a grid within their group; whatever lies
within one cell's width of a point is in the 27 cells around it, so a join on
the cell is exact for that distance. Nearest neighbours are found over a k-d tree.
No group is ever gathered.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.operators import kdtree
from phyllo.operators.grouped import per_group
from phyllo.session import cut

COORDS = ("x", "y", "z")
#: Of joins by radius: points of a spot, spots and points of a block, points of it that meet another block at once (Spark holds the rows that come of them), pairs that a task tries and tasks, about at most.
COPIES, SPOTS, BLOCK, HANDFUL, PAIRS, MOST_TASKS = 64, 512, 2048, 8, 1 << 26, 20000


def _cell(coords: tuple[str, ...], width: Column) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / width).cast("long") for c in coords]


def _distance(coords: tuple[str, ...]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"s.{c}").cast("double") - F.col(f"d.{c}").cast("double")) * (F.col(f"s.{c}").cast("double") - F.col(f"d.{c}").cast("double")) for c in coords]))


def _near_cells(coords: tuple[str, ...]) -> Column:
    """All cells around the columns ``_c0``, ``_c1``, ..."""
    steps = itertools.product((-1, 0, 1), repeat=len(coords))
    return F.explode(F.array(*[F.struct(*[(F.col(f"_c{i}") + s).alias(f"_c{i}") for i, s in enumerate(step)]) for step in steps]))


def _blocks(df: DataFrame, width: Column, radius: Column, keys: tuple[str, ...], coords: tuple[str, ...], vid: str, kind: str | None = None) -> DataFrame:
    """``(_k0.., _c0.., _b, _n, _r, _spots)``: the points of a cell in blocks of bounded size, those of equal coordinates as one spot with their vids.

    Spots of very many points are several, and cells of very many are several
    blocks. With ``kind``, a block has ``_kinds`` instead: its spots by that column.
    """
    own, cells, names, kinds = [f"_k{i}" for i in range(len(keys))], [f"_c{i}" for i in range(len(coords))], [f"_x{i}" for i in range(len(coords))], [] if kind is None else ["_kind"]
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in coords])
    rows = df.where(fine).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[c.alias(n) for c, n in zip(_cell(coords, width), cells, strict=True)], *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names, strict=True)], *[F.col(kind).alias(k) for k in kinds], radius.alias("_r"), F.col(vid).alias("_v"))
    rows = per_group(rows, {"_n": F.count(F.lit(1))}, (*own, *cells, *names, *kinds)).withColumn("_s", F.pmod(F.xxhash64("_v"), F.ceil(F.col("_n") / COPIES)))
    nulls = F.array_repeat(F.lit(None).cast(df.schema[vid].dataType), F.count_if(F.col("_v").isNull()).cast("int"))
    spots = rows.groupBy(*own, *cells, *names, *kinds, "_s").agg(F.concat(F.collect_list("_v"), nulls).alias("_vids"), F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_r"))
    most = BLOCK if kinds else SPOTS  # the fewer the blocks, the fewer the pairs of kinds
    spots = per_group(spots, {"_of": F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("_n") / BLOCK))}, (*own, *cells)).withColumn("_b", F.pmod(F.xxhash64(*names, "_s"), F.col("_of")))
    listed = lambda by, c: spots.groupBy(*own, *cells, "_b", *by).agg(F.sum("_n").alias("_n"), F.max("_r").alias("_r"), F.collect_list(c).alias("_spots"))
    if not kinds:
        return listed([], F.struct(*names, "_vids"))
    return listed(kinds, F.struct(*names, "_vids")).groupBy(*own, *cells, "_b").agg(F.max("_r").alias("_r"), F.collect_list(F.struct("_kind", "_n", "_spots")).alias("_kinds"), F.sum("_n").alias("_n"))


def _crowding(blocks: DataFrame, by: list[str]) -> float:
    """Sum of the squared numbers of points of the cells."""
    return blocks.groupBy(*by).agg(F.sum("_n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0


def _handfuls(spots: str, n: str) -> Column:
    """Runs of the spots of a column, of about ``HANDFUL`` of its ``n`` points each."""
    width = F.greatest(F.lit(1), F.floor(HANDFUL * F.size(spots) / F.col(n)).cast("int"))
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(spots), width), lambda at: F.slice(spots, at, width)))


def radius_join(src: DataFrame, dst: DataFrame, radius: float | str, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", digits: int | None = None, once: bool = False, kind: str | None = None, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(*keys, src, dst, d)`` of all pairs at most ``radius`` apart, a point with itself included if it is on both sides.

    ``radius`` is a number or a column of ``src`` and ``dst`` that is constant in
    a group. Rows with a null or non-finite coordinate have no partners. With
    ``digits``, d is rounded to so many places. With ``once``, for which ``src``
    has to be ``dst``, each pair comes once, src < dst. With ``kind`` and ``score``
    there is a column ``score`` of the kinds of both, taken once for all points of
    two kinds in two blocks; it has to be the same whichever comes first.

    Points meet by blocks of cells. Pairs of blocks have bounded work and are dealt
    to as many tasks as there is work for, so a crowded cell is many tasks' work;
    no pair of points is dealt. Distances are taken once for all points of equal
    coordinates. A block goes by handfuls, since Spark holds all rows that come of
    one row before it hands on the first.
    """
    width = F.col(radius).cast("double") if isinstance(radius, str) else F.lit(float(radius))
    own, cells, names = [f"_k{i}" for i in range(len(keys))], [f"_c{i}" for i in range(len(coords))], [f"_x{i}" for i in range(len(coords))]
    s = cut(_blocks(src, width, width, keys, coords, vid, kind), "radius-blocks")
    d = s if src is dst else cut(_blocks(dst, width, width, keys, coords, vid, kind), "radius-blocks")
    # By Cauchy and Schwarz no more pairs than this are tried, if each cell meets all around it.
    work = 3 ** len(coords) * (_crowding(s, [*own, *cells]) * _crowding(d, [*own, *cells])) ** 0.5
    tasks = int(max(1, min(work // (1 << 20), src.sparkSession.sparkContext.defaultParallelism), min(work // PAIRS, MOST_TASKS)))
    around = s.withColumn("_home", F.struct(*cells, "_b")).withColumn("_at", _near_cells(coords)).drop(*cells).select("*", "_at.*").drop("_at")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) if c in own else F.col(f"s.{c}") == F.col(f"d.{c}") for c in (*own, *cells)])
    there = F.struct(*[F.col(f"d.{c}") for c in cells], F.col("d._b"))
    held, own = "_kinds" if kind else "_spots", [*own, "_r", *(["_same"] if once else [])]
    met = around.alias("s").join(d.alias("d"), on & (F.col("s._home") <= there) if once else on)
    met = met.select(*[F.col(f"s.{k}").alias(k) for k in own if k != "_same"], (F.col("s._home") == there).alias("_same"), "s._n", F.col(f"s.{held}").alias("_p"), F.col(f"d.{held}").alias("_q"), "s._home", *[F.col(f"d.{c}").alias(c) for c in cells], "d._b")
    met = met.repartition(tasks, "_home", *cells, "_b").select(*own, "_n", "_p", "_q")
    if kind:
        met = met.select(*own, F.explode(F.transform("_p", lambda k: F.struct(k["_kind"].alias("kind"), k["_n"].alias("n"), k["_spots"].alias("spots")))).alias("p"), "_q")
        met = met.select(*own, "p", F.explode("_q").alias("q")).select(*own, score(F.col("p.kind"), F.col("q._kind")).alias("score"), F.col("p.n").alias("_n"), F.col("p.spots").alias("_p"), F.col("q._spots").alias("_q"))
        own = [*own, "score"]
    met = met.select(*own, _handfuls("_p", "_n").alias("_p"), "_q")
    tried = met.select(*own, F.explode("_p").alias("s"), "_q").select(*own, "s", F.explode("_q").alias("d")).withColumn("d_", _distance(tuple(names)))
    d_ = F.col("d_") if digits is None else F.round("d_", digits) + F.lit(0.0)
    near = tried.where(F.col("d_") <= F.col("_r")).select(*own, F.col("s._vids").alias("_p"), F.col("d._vids").alias("_q"), d_.alias("d"))
    spread = near.select(*own, F.explode("_p").alias("src"), "_q", "d").select(*own, "src", F.explode("_q").alias("dst"), "d")
    if once:
        spread = spread.where(F.when(F.col("_same"), F.col("src") < F.col("dst")).otherwise(F.col("src") != F.col("dst"))).withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return spread.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "src", "dst", "d", *(["score"] if kind else []))


def knn_join(src: DataFrame, dst: DataFrame, k: int, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", drop_self: bool = False, max_distance: float | None = None, leaf: int = kdtree.LEAF) -> DataFrame:
    """``(*keys, src, dst, d, rank)``: the k nearest of ``dst`` for every point of ``src``, ties by the smaller vid; rank from 1.

    ``drop_self`` leaves out a partner with the point's own vid. With
    ``max_distance``, farther partners are left out. Points of a group with fewer
    partners get what there is; rows with a null or non-finite coordinate have
    none and are none. Exact at any density, at a cost that points far out don't
    raise: points are dealt to the leaves of a k-d tree (``kdtree``).
    """
    if not keys:
        one = F.lit(1).alias("_one")
        return knn_join(src.select("*", one), dst.select("*", one), k, ("_one",), coords, vid, drop_self, max_distance, leaf).drop("_one")
    return kdtree.nearest(src, dst, k, keys, coords, vid, drop_self, max_distance, leaf)


def nearest_join(src: DataFrame, dst: DataFrame, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", max_distance: float | None = None) -> DataFrame:
    """``(*keys, vid, near_vid, d)`` for every point of ``src``: its nearest of ``dst``; null and infinity where there is none."""
    found = knn_join(src, dst, 1, keys, coords, vid, max_distance=max_distance)
    on = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys] + [F.col(f"p.{vid}") == F.col("n.src")])
    joined = src.select(*keys, vid).alias("p").join(found.alias("n"), on, "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in (*keys, vid)], F.col("n.dst").alias("near_vid"), F.coalesce("n.d", F.lit(float("inf"))).alias("d"))


def transfer_labels(src: DataFrame, labelled: DataFrame, label: str = "label", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", max_distance: float | None = None) -> DataFrame:
    """``(*keys, vid, near_vid, d, label)``: the nearest point's label; 0 where none is near enough."""
    return with_labels(nearest_join(src, labelled, keys, coords, vid, max_distance), labelled, label, keys, vid)


def with_labels(near: DataFrame, labelled: DataFrame, label: str = "label", keys: tuple[str, ...] = ("uid",), vid: str = "vid") -> DataFrame:
    """``near`` with the label of the point ``near_vid``; 0 where that is null."""
    labels = labelled.select(*keys, F.col(vid).alias("near_vid"), F.col(label).alias(label))
    on = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"l.{c}")) for c in keys] + [F.col("n.near_vid") == F.col("l.near_vid")])
    return near.alias("n").join(labels.alias("l"), on, "left").select("n.*", F.coalesce(f"l.{label}", F.lit(0)).alias(label))


def match_within(gt: DataFrame, source: DataFrame, max_distance: float = -1.0, share: float = 0.002, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, near_vid, d)``: nearest source point within a distance; below 0: that share of the box's diagonal of ``gt``."""
    near = nearest_join(gt, source, keys, coords, vid)
    if max_distance >= 0:
        limit = near.withColumn("_max", F.lit(max_distance))
    else:
        diagonal = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")), F.lit(2)) for c in coords]))
        boxes = gt.groupBy(*keys).agg((diagonal * share).alias("_max"))
        limit = near.join(boxes, list(keys)) if keys else near.crossJoin(boxes)
    return limit.select(*keys, vid, F.when(F.col("d") <= F.col("_max"), F.col("near_vid")).alias("near_vid"), "d")


def quantised_match(full: DataFrame, part: DataFrame, tolerance: float = 1e-6, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> tuple[DataFrame, DataFrame]:
    """The full cloud with ``matched``, and counts per group, by equal quantised coordinates; of equal full points the first matches.

    Counts: full, part, matched, unmatched, duplicate_full_keys, duplicate_part_hits.
    """
    from phyllo.functions.scalars import quantised_key

    q = [quantised_key(c, tolerance).alias(f"_q{i}") for i, c in enumerate(coords)]
    names = [f"_q{i}" for i in range(len(coords))]
    fulls = full.select(*keys, vid, *q).groupBy(*keys, *names).agg(F.min(vid).alias(vid), F.count(F.lit(1)).alias("_n"))
    parts = part.select(*keys, *q).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_m"))
    on = lambda a, b, cs: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs])
    hits = fulls.alias("f").join(parts.alias("p"), on("f", "p", [*keys, *names]), "full_outer")
    pick = [F.coalesce(f"f.{k}", f"p.{k}").alias(k) for k in keys]
    hits = hits.select(*pick, f"f.{vid}", "f._n", "p._m")
    counts = hits.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("full"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("part"),
        F.count_if(F.col("_n").isNotNull() & F.col("_m").isNotNull()).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("_n").isNull(), F.col("_m"))), F.lit(0)).alias("unmatched"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_full_keys"),
        F.coalesce(F.sum(F.when(F.col("_n").isNotNull(), F.col("_m") - 1)), F.lit(0)).alias("duplicate_part_hits"),
    )
    matched = hits.where(F.col("_n").isNotNull() & F.col("_m").isNotNull()).select(*keys, vid)
    out = full.alias("a").join(matched.withColumn("_hit", F.lit(True)).alias("m"), on("a", "m", [*keys, vid]), "left").select("a.*", F.coalesce("m._hit", F.lit(False)).alias("matched"))
    return out, counts


def close_pairs(centroids: DataFrame, distance: float, keys: tuple[str, ...] = (), coords: tuple[str, ...] = COORDS, vid: str = "vid", kind: str | None = None, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(*keys, src, dst, d)`` with src < dst and d below ``distance``; ``kind`` and ``score`` as in ``radius_join``."""
    return radius_join(centroids, centroids, distance, keys, coords, vid, once=True, kind=kind, score=score).where(F.col("d") < distance)


def pick_on_ray(points: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], tight: float = 0.005, loose: float = 0.025, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, depth)``: per group, of the points within ``tight`` of a ray (else within ``loose``) the one nearest along it."""
    length = sum(d * d for d in direction) ** 0.5
    rel = [F.col(c).cast("double") - o for c, o in zip(coords, origin, strict=True)]
    depth = reduce(lambda a, b: a + b, [r * (d / length) for r, d in zip(rel, direction, strict=True)])
    off = [r - depth * (d / length) for r, d in zip(rel, direction, strict=True)]
    seen = points.select(*keys, vid, depth.alias("depth"), F.sqrt(reduce(lambda a, b: a + b, [o * o for o in off])).alias("_off")).where(F.col("depth") > 0)
    best = seen.where(F.col("_off") < loose).groupBy(*keys).agg(F.min(F.struct((F.col("_off") >= tight).alias("a"), F.col("depth").alias("depth"), F.col(vid).alias(vid))).alias("b"))
    return best.select(*keys, f"b.{vid}", "b.depth")


def nearest_centroid(small: DataFrame, large: DataFrame, label: str, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS) -> DataFrame:
    """``(*keys, label, part, near_part)``: for every small part of a label, the large part of that label with the nearest centroid.

    Both sides are ``(*keys, label, part, *coords)`` with one row per part.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*keys, label)])
    pairs = small.alias("s").join(large.alias("d"), on).select(*[F.col(f"s.{c}").alias(c) for c in (*keys, label, "part")], F.struct(_distance(coords).alias("d"), F.col("d.part").alias("near")).alias("_b"))
    return pairs.groupBy(*keys, label, "part").agg(F.min("_b").alias("_b")).select(*keys, label, "part", F.col("_b.near").alias("near_part"))
