"""A sampled k-d partition of points, and k nearest neighbours over it.

The partner points of every group are dealt to the leaves of a k-d tree. A node
with too many points is split at medians of a bounded sample of it, over up to
six levels at once; nodes that are still too full are split again in the next
round. So leaves hold about as many points wherever they lie, and a few points
far out make a leaf long but no fuller.

Every point looks for its neighbours in its own leaf first. If the ball up to its
k-th neighbour there leaves the leaf, it goes down the tree again, to just the
leaves whose box the ball cuts. Only points whose coordinates all tie can fill a
leaf beyond its bound, and of those the first few by id stand for all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.session import cut

#: Points of a leaf at most, points of a node that its split is taken from, levels of a split, and searching points of a leaf that go to one task together.
LEAF, SAMPLE, LEVELS, SEARCHING = 1024, 4096, 6, 16384
#: Children of a node; bits of a node's name below those that tell its round.
_CHILDREN, _ROUND_BITS = 1 << LEVELS, 57


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def splits(points: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Axes and values of a full binary tree of ``depth`` levels over a sample, as in a heap; a part whose points all tie isn't split (value infinity: all go left)."""
    axes, values = [0] * ((1 << depth) - 1), [float("inf")] * ((1 << depth) - 1)
    held = {0: points}
    for node in range(len(axes)):
        mine = held.pop(node)
        if len(mine):
            extents = mine.max(axis=0) - mine.min(axis=0)
            axis = int(extents.argmax())
            if extents[axis] > 0:
                along = np.sort(mine[:, axis])
                value = along[len(along) // 2]
                if value == along[0]:
                    value = along[np.searchsorted(along, value, "right")]
                axes[node], values[node] = axis, float(value)
        left = mine[:, axes[node]] < values[node]
        held[2 * node + 1], held[2 * node + 2] = mine[left], mine[~left]
    return axes, values


def _tree_of(depth_of: int, n_coords: int):
    """Kernel: the split of one node from its sampled points."""

    def run(key, table):
        points = np.column_stack([table[f"c{i}"].to_numpy() for i in range(n_coords)])
        depth = min(LEVELS, max(1, int(np.ceil(np.log2(table["n"][0].as_py() / depth_of)))))
        axes, values = splits(points, depth)
        return pa.table({"gid": [key[0].as_py()], "path": [key[1].as_py()], "axes": pa.array([axes], pa.list_(pa.int32())), "cuts": pa.array([values], pa.list_(pa.float64())), "depth": pa.array([depth], pa.int32())})

    return run


def _boxes(points: DataFrame, names: list[str]) -> DataFrame:
    """``(gid, path, n, lo0.., hi0..)`` of the partner points of every node."""
    return points.where("NOT asks").groupBy("gid", "path").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(names)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(names)])


def _split_round(points: DataFrame, open_: DataFrame, names: list[str], most: int, number: int) -> tuple[DataFrame, DataFrame]:
    """(``points`` with the rows of open nodes dealt to the nodes' children, ``(gid, path, base)``: the children of a node are ``base`` and up)."""
    drawn = F.pmod(F.xxhash64("vid", F.lit(number)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")) * float(1 << 30)
    sample = points.where("NOT asks").join(open_.select("gid", "path", "n"), ["gid", "path"]).where(drawn).select("gid", "path", "n", *names)
    trees = sample.groupBy("gid", "path").applyInArrow(_tree_of(max(1, most // 2), len(names)), "gid long, path long, axes array<int>, cuts array<double>, depth int")
    # A node whose sample ties, or has none, is split in the middle of its longest side; so every round splits every open node.
    sides = [F.struct((F.col(f"hi{i}") - F.col(f"lo{i}")).alias("length"), F.lit(i).alias("axis"), F.when(F.col(f"lo{i}") / 2 + F.col(f"hi{i}") / 2 > F.col(f"lo{i}"), F.col(f"lo{i}") / 2 + F.col(f"hi{i}") / 2).otherwise(F.col(f"hi{i}")).alias("middle")) for i in range(len(names))]
    longest = F.greatest(*sides) if len(sides) > 1 else sides[0]
    nodes = open_.join(trees, ["gid", "path"], "left").withColumn("_side", longest)
    usable = F.col("axes").isNotNull() & (F.element_at("cuts", 1) < float("inf"))
    nodes = nodes.select("gid", "path", F.when(usable, F.col("axes")).otherwise(F.array(F.col("_side.axis"))).alias("axes"), F.when(usable, F.col("cuts")).otherwise(F.array(F.col("_side.middle"))).alias("cuts"), F.when(usable, F.col("depth")).otherwise(F.lit(1)).alias("depth"))
    base = F.lit((number + 1) << _ROUND_BITS) + F.monotonically_increasing_id() * _CHILDREN
    nodes = cut(nodes.withColumn("base", base), "knn-splits")
    joined = points.join(nodes, ["gid", "path"], "left")
    coords = F.array(*names)
    go = lambda at, _: F.when(F.element_at(coords, F.element_at("axes", at + 1) + 1) < F.element_at("cuts", at + 1), 2 * at + 1).otherwise(2 * at + 2)
    child = F.aggregate(F.sequence(F.lit(1), F.col("depth")), F.lit(0), lambda at, _: go(at, _).cast("int")) - F.expr("shiftleft(1, depth) - 1")
    moved = F.when(F.col("base").isNotNull(), F.col("base") + child).otherwise(F.col("path"))
    return joined.select("gid", moved.alias("path"), *[c for c in points.columns if c not in ("gid", "path")]), nodes.select("gid", "path", "base")


def _near(k: int, n_coords: int, drop_self: bool):
    """Kernel over rows ``(gid, path, salt, asks, vid, reach, c0..)`` in the order of leaf, salt, partners first, vid: the k nearest partners of every asking row.

    A leaf's partners are held, those that ask pass by in pieces. ``full``: the
    row has as many as it wants.
    """

    def search(gid, path, partners, ids, asking, asking_ids, reach):
        lines = []
        want = k + 1 if drop_self else k
        step = max(1, (1 << 21) // max(1, len(partners)))
        for at in range(0, len(asking), step):
            q = asking[at : at + step]
            d = None
            for i in range(n_coords):
                apart = q[:, i, None] - partners[None, :, i]
                d = apart * apart if d is None else d + apart * apart
            d = np.sqrt(d) if d is not None and d.size else np.zeros((len(q), len(partners)))
            near = d <= reach[at : at + step, None]
            if d.shape[1] > want:
                near &= d <= np.partition(d, want - 1, axis=1)[:, want - 1 : want]
            rows, cols = np.nonzero(near)
            far = d[rows, cols]
            by = np.lexsort((cols, far, rows))  # partners are in the order of their ids
            lines.append((rows[by] + at, cols[by], far[by]))
        rows, cols, far = (np.concatenate(c) for c in zip(*lines, strict=True))
        src, dst = asking_ids.take(pa.array(rows)), ids.take(pa.array(cols))
        if drop_self:
            other = np.array(pc.not_equal(src, dst).to_numpy(zero_copy_only=False), bool)
            rows, cols, far, src, dst = rows[other], cols[other], far[other], src.filter(pa.array(other)), dst.filter(pa.array(other))
        first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, np.int64)
        kept = place < k
        n = int(kept.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, gid)), pa.array(np.full(n, path)), src.filter(pa.array(kept)), dst.filter(pa.array(kept)), pa.array(far[kept]), pa.array((place[kept] + 1).astype(np.int32))], names=["gid", "path", "src", "dst", "d", "place"])

    def run(batches):
        leaf, held, ids = None, [], []
        joined = None
        for b in batches:
            if not b.num_rows:
                continue
            gid, path, salt = (b.column(i).to_numpy() for i in range(3))
            asks = b.column(3).to_numpy(zero_copy_only=False)
            reach = b.column(5).to_numpy()
            points = np.column_stack([b.column(6 + i).to_numpy() for i in range(n_coords)])
            edges = np.flatnonzero(np.append(True, (np.diff(gid) != 0) | (np.diff(path) != 0) | (np.diff(salt) != 0) | (np.diff(asks.astype(np.int8)) != 0)))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                if (gid[lo], path[lo], salt[lo]) != leaf:
                    leaf, held, ids, joined = (gid[lo], path[lo], salt[lo]), [], [], None
                if not asks[lo]:
                    held.append(points[lo:hi])
                    ids.append(b.column(4).slice(lo, hi - lo))
                elif held:
                    if joined is None:
                        joined = np.concatenate(held), pa.concat_arrays(ids)
                    yield search(gid[lo], path[lo], *joined, points[lo:hi], b.column(4).slice(lo, hi - lo), reach[lo:hi])

    return run


def _searched(asking: DataFrame, partners: DataFrame, names: list[str], k: int, drop_self: bool) -> DataFrame:
    """``(gid, path, src, dst, d, place)``: the k nearest partners within ``reach`` of every row ``(gid, path, vid, reach, c..)`` of ``asking`` in its leaf.

    Leaves that very many rows ask are dealt to several tasks, each with the leaf's partners.
    """
    crowd = cut(asking.groupBy("gid", "path").agg(F.ceil(F.count(F.lit(1)) / SEARCHING).cast("int").alias("parts")), "knn-crowds")
    asked = asking.join(crowd, ["gid", "path"]).select("gid", "path", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("asks"), "vid", "reach", *names)
    held = partners.join(crowd, ["gid", "path"]).select("gid", "path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("asks"), "vid", F.lit(0.0).alias("reach"), *names)
    both = asked.unionByName(held).repartition("gid", "path", "salt").sortWithinPartitions("gid", "path", "salt", "asks", "vid")
    kind = asking.schema["vid"].dataType.simpleString()
    return both.mapInArrow(_near(k, len(names), drop_self), f"gid long, path long, src {kind}, dst {kind}, d double, place int")


def deal(points: DataFrame, names: list[str], most: int = LEAF) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(``points`` with their leaf as ``path``, boxes of the roots, boxes of the nodes of each round) of ``(gid, path = 0, asks, vid, *names)``.

    Only rows that don't ask fill the leaves. Boxes are ``(gid, path, n, lo0.., hi0..)``,
    those of the rounds also have ``_up``, the node above, and ``open``: whether it is split again.
    """
    points = cut(points, "kd-dealt")
    roots = cut(_boxes(points, names), "kd-boxes")
    apart = reduce(lambda a, b: a | b, [F.col(f"lo{i}") < F.col(f"hi{i}") for i in range(len(names))])
    open_, rounds = roots.where((F.col("n") > most) & apart), []
    while not open_.isEmpty():
        dealt, nodes = _split_round(points, open_, names, most, len(rounds))
        points = cut(dealt, "kd-dealt")
        fresh = _boxes(points.where(F.col("path") >= F.lit((len(rounds) + 1) << _ROUND_BITS)), names)
        boxes = fresh.withColumn("base", F.col("path") - F.pmod("path", F.lit(_CHILDREN))).join(nodes.withColumnRenamed("path", "_up"), ["gid", "base"])
        boxes = cut(boxes.withColumn("open", (F.col("n") > most) & apart), "kd-boxes")
        rounds.append(boxes)
        open_ = boxes.where("open")
    return points, roots, rounds


def descend(rows: DataFrame, rounds: list[DataFrame], n_coords: int, meets: Column) -> DataFrame:
    """``rows`` ``(gid, path, ..)`` sent from their node down to every leaf all of whose boxes on the way meet a condition on ``lo0.., hi0.., _child``; ``path`` is then the leaf."""
    out, here = [], rows
    for number, boxes in enumerate(rounds):
        sides = boxes.select("gid", F.col("_up").alias("path"), F.col("path").alias("_child"), "open", *[f"lo{i}" for i in range(n_coords)], *[f"hi{i}" for i in range(n_coords)])
        met = here.join(sides, ["gid", "path"]).where(meets)
        met = met.select(*[F.col("_child").alias(c) if c == "path" else F.col(c) for c in rows.columns], "open")
        if number < len(rounds) - 1:
            met = cut(met, "kd-met")
        out.append(met.where("NOT open").drop("open"))
        here = met.where("open").drop("open")
    return reduce(DataFrame.unionByName, out)


def nearest(src: DataFrame, dst: DataFrame, k: int, keys: tuple[str, ...], coords: tuple[str, ...], vid: str = "vid", drop_self: bool = False, max_distance: float | None = None, leaf: int = LEAF) -> DataFrame:
    """``(*keys, src, dst, d, rank)`` as ``spatial.knn_join`` has it; ``leaf``: points of a leaf at most."""
    names = [f"c{i}" for i in range(len(coords))]
    fine = _all([F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in coords])
    of = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("of")
    slim = lambda df, asks: df.where(fine).select(of, F.lit(asks).alias("asks"), F.col(vid).alias("vid"), *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names, strict=True)])
    rows = cut(slim(src, True).unionByName(slim(dst, False)), "knn-points")
    most = max(leaf, 8 * k)
    groups = cut(rows.groupBy("of").agg(F.count_if(~F.col("asks")).alias("n")).where("n > 0").withColumn("gid", F.monotonically_increasing_id()), "knn-groups")
    points = rows.join(groups.select(F.col("of").alias("_of"), "gid"), F.col("of").eqNullSafe(F.col("_of"))).select("gid", F.lit(0).cast("long").alias("path"), "asks", "vid", *names)
    rounds: list[DataFrame] = []
    if not groups.where(F.col("n") > most).isEmpty():
        points, _, rounds = deal(points, names, most)
    partners = points.where("NOT asks")
    if rounds:
        # Of points whose coordinates all tie in an overfull leaf, the first by id stand for all.
        tied = reduce(DataFrame.unionByName, rounds).where((F.col("n") > most) & ~F.col("open")).select("gid", "path")
        first = F.row_number().over(W.partitionBy("gid", "path").orderBy("vid"))
        partners = partners.join(tied, ["gid", "path"], "left_anti").unionByName(partners.join(tied, ["gid", "path"], "left_semi").withColumn("_r", first).where(F.col("_r") <= k + 1).drop("_r"))
        partners = cut(partners, "knn-partners") if not tied.isEmpty() else partners
    reach = float("inf") if max_distance is None else float(max_distance)
    asking = points.where("asks").withColumn("reach", F.lit(reach))
    found = _searched(asking, partners, names, k, drop_self)
    if rounds:
        found = cut(found, "knn-own-leaf")
        # A row for each point, so not broadcast however small its file is.
        reached = found.where(F.col("place") == k).select("gid", F.col("src").alias("vid"), F.col("d").alias("_d"))
        balls = asking.join(reached.hint("merge"), ["gid", "vid"], "left").withColumn("reach", F.coalesce("_d", "reach")).drop("_d")
        balls = balls.select("gid", F.col("path").alias("home"), F.lit(0).cast("long").alias("path"), "vid", "reach", *names)
        across = cut(_cut_leaves(balls, rounds, names), "knn-across")
        found = found.unionByName(_searched(across, partners, names, k, drop_self))
        found = found.withColumn("place", F.row_number().over(W.partitionBy("gid", "src").orderBy("d", "dst"))).where(F.col("place") <= k)
    out = found.join(groups, "gid").select(*[F.col(f"of.k{i}").alias(c) for i, c in enumerate(keys)], "src", "dst", "d", F.col("place").cast("int").alias("rank"))
    return cut(out, "knn")


def _cut_leaves(balls: DataFrame, rounds: list[DataFrame], names: list[str]) -> DataFrame:
    """``(gid, path, vid, reach, c..)``: a row for every leaf but the home that a ball cuts, found from the root of the tree down."""
    off = [F.greatest(F.col(f"lo{i}") - F.col(c), F.col(c) - F.col(f"hi{i}"), F.lit(0.0)) for i, c in enumerate(names)]
    reached = reduce(lambda a, b: a + b, [o * o for o in off]) <= F.col("reach") * F.col("reach") * (1 + 1e-9) + 1e-300
    return descend(balls, rounds, len(names), reached & (F.col("_child") != F.col("home"))).drop("home")
