"""Aggregates and ranked picks of clouds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.functions.scalars import is_finite
from phyllo.operators.grouped import per_group
from phyllo.operators.quantiles import group_quantiles, with_quantiles
from phyllo.session import cut

COORDS = ("x", "y", "z")


def bounding_box(df: DataFrame, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS) -> DataFrame:
    """Count, ends, diagonal and volume per group; an empty table gives no groups, and with no keys one of volume 0."""
    ends = {f"{s}_{c}": f(F.col(c).cast("double")) for c in coords for s, f in (("min", F.min), ("max", F.max))}
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *[v.alias(k) for k, v in ends.items()])
    extents = [F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)) for c in coords]
    squares = [e * e for e in extents]
    return agg.withColumn("bbox_diagonal", F.coalesce(F.sqrt(reduce(lambda a, b: a + b, squares)), F.lit(0.0))).withColumn("bbox_volume", F.coalesce(reduce(lambda a, b: a * b, extents), F.lit(0.0)))


def safe_quantile(c: Column | str, q: float, default: float = 0.0) -> Column:
    """Aggregate: quantile of the finite values, else a default. For groups that one buffer holds; ``group_quantiles`` has no such limit."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.coalesce(F.percentile(F.when(is_finite(c), c), F.lit(q)), F.lit(default))


def mad_stats(df: DataFrame, value: str, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, median, mad, n)`` of a column."""
    c = F.col(value).cast("double")
    away = with_quantiles(df, {"_med": (c, [0.5])}, keys).withColumn("_away", F.abs(c - F.col("_med")[0]))
    sizes = away.groupBy(*keys).agg(F.first(F.col("_med")[0]).alias("median"), F.count(F.lit(1)).alias("n"))
    mads = group_quantiles(away, {"_mad": (F.col("_away"), [0.5])}, keys)
    both = sizes.crossJoin(mads) if not keys else sizes.alias("s").join(mads.alias("m"), reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]))
    return both.select(*[F.col(f"s.{k}").alias(k) for k in keys], "median", F.col("_mad")[0].alias("mad"), "n")


def mean_std(df: DataFrame, value: str, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, mean, std)``, the deviation over n."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def mean_row(df: DataFrame, name: str = "uid", label: str = "MEAN") -> DataFrame:
    """All rows as text and a last one with the mean of each column whose rows are all numbers, else ''."""
    others = [c for c in df.columns if c != name]
    as_text = df.select(F.col(name).cast("string").alias(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in others])
    number = lambda c: F.col(c).try_cast("double")
    means = as_text.agg(*[F.when((F.count(number(c)) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.avg(number(c)).cast("string")).otherwise("").alias(c) for c in others])
    return as_text.unionByName(means.select(F.lit(label).alias(name), *others))


def voxel_key(df: DataFrame, voxel: float | Column, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, from_minimum: bool = True) -> DataFrame:
    """``df`` with ``_v0, _v1, ...``: the voxel of each row, counted from the group's smallest coordinates."""
    width = voxel if isinstance(voxel, Column) else F.lit(float(voxel))
    if from_minimum:
        df = per_group(df, {f"_min_{c}": F.min(F.col(c).cast("double")) for c in coords}, keys)
    base = [F.col(f"_min_{c}") if from_minimum else F.lit(0.0) for c in coords]
    out = df.withColumns({f"_v{i}": F.floor((F.col(c).cast("double") - b) / width).cast("long") for i, (c, b) in enumerate(zip(coords, base, strict=True))})
    return out.drop(*[f"_min_{c}" for c in coords])


def voxel_downsample(df: DataFrame, voxel: float, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, colors: tuple[str, ...] = ()) -> DataFrame:
    """One row per voxel: mean coordinates, mean colours cut off to whole numbers. A voxel of 0 or less passes all rows."""
    if voxel <= 0:
        return df.select(*keys, *coords, *colors)
    voxels = [f"_v{i}" for i in range(len(coords))]
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in coords] + [F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.avg(F.col(c).cast("double")))).cast("int").alias(c) for c in colors]
    return voxel_key(df, voxel, keys, coords).groupBy(*keys, *voxels).agg(*means).select(*keys, *coords, *colors)


def voxel_top1(df: DataFrame, voxel: float | Column, by: str = "opacity", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """The row of each voxel with the largest ``by``; of equals the smallest vid. Picked by a pre-aggregated maximum."""
    voxels = [f"_v{i}" for i in range(len(coords))]
    keyed = voxel_key(df, voxel, keys, coords)
    row = F.struct(*[F.col(c) for c in df.columns])
    return keyed.groupBy(*keys, *voxels).agg(F.max_by(row, F.struct(F.col(by), -F.col(vid))).alias("_r")).select("_r.*")


def adaptive_thin(df: DataFrame, most: int, by: str = "opacity", keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid", rounds: int = 8) -> DataFrame:
    """Per cloud: voxels of (volume / most) ^ 1/3, widened by (n / most) ^ 1/3 * 1.03 until at most 1.05 * most rows are left; then the top ``most`` by ``by``.

    Clouds of ``most`` rows or fewer stay whole. All clouds go through a round
    together, each with its own width; those that are thin enough are done.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    on = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{g}")) for k, g in zip(keys, names, strict=True)], F.lit(True))
    extents = [F.greatest(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")), F.lit(1e-6)) for c in coords]
    volume = reduce(lambda a, b: a * b, extents, F.lit(1.0))
    sized = df.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n"), F.pow(volume / most, F.lit(1 / 3)).alias("_w"))
    open_ = cut(sized.where(F.col("_n") > most).select(*names, "_w"), "thin-widths")
    if open_.isEmpty():
        return df
    out = [df.alias("d").join(open_.alias("o"), on("d", "o"), "left_anti")] if keys else []
    large = df
    for at in range(rounds):
        wide = large.alias("d").join(open_.alias("o"), on("d", "o")).select("d.*", F.col("o._w").alias("_w"))
        thin = cut(voxel_top1(wide, F.col("_w"), by, keys, coords, vid), "thin")
        left = thin.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)], "_w").agg(F.count(F.lit(1)).alias("_n"))
        left = cut(left.withColumn("_over", (F.col("_n") > 1.05 * most) & F.lit(at < rounds - 1)), "thin-left")
        done = thin.alias("d").join(left.where("NOT _over").alias("o"), on("d", "o"), "left_semi").drop("_w")
        out.append(top_by_group(done, most, by, keys, vid))
        open_ = left.where("_over").select(*names, (F.col("_w") * F.pow(F.col("_n") / most, F.lit(1 / 3)) * 1.03).alias("_w"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def top_by_group(df: DataFrame, most: int, by: str = "opacity", keys: tuple[str, ...] = ("uid",), vid: str = "vid") -> DataFrame:
    """The ``most`` rows of each group with the largest ``by``; of equals the smaller vid. Every task leaves out what cannot be among them."""
    if not keys:
        return top_by(df, most, by, vid)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), vid))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def top_by(df: DataFrame, most: int, by: str = "opacity", vid: str = "vid") -> DataFrame:
    """The ``most`` rows with the largest ``by``."""
    return df.orderBy(F.desc(by), vid).limit(most)


def zbuffer(hits: DataFrame, keys: tuple[str, ...] = ("view_id", "v", "u"), depth: str = "depth") -> DataFrame:
    """``hits`` with ``front``, the smallest depth at their pixel. The hits, which come from every point in every view, are computed once."""
    return per_group(cut(hits, "zbuffer"), {"front": F.min(depth)}, keys)


def front_surface(hits: DataFrame, tolerance: float = 0.012, keys: tuple[str, ...] = ("view_id", "v", "u"), depth: str = "depth") -> DataFrame:
    """``hits`` with ``front`` and ``is_front``: within the tolerance of it."""
    return zbuffer(hits, keys, depth).withColumn("is_front", F.abs(F.col(depth) - F.col("front")) < tolerance)


def largest_clusters(labels: DataFrame, most: int = 5, least_share: float = 0.01, keys: tuple[str, ...] = ("uid",), label: str = "label", noise: int = -1) -> DataFrame:
    """Rows of the largest clusters that hold that share of all rows, noise counted; none does: of the largest; all noise: every row."""
    counts = labels.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = per_group(counts, {"_all": F.sum("_n")}, keys).where(F.col(label) != noise)
    order = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(F.desc("_n"), label)
    ranked = ranked.withColumn("_rank", F.row_number().over(order))
    chosen = ranked.where((F.col("_rank") == 1) | ((F.col("_rank") <= most) & (F.col("_n") >= least_share * F.col("_all"))))
    out = per_group(labels, {"_some": F.bool_or(F.col(label) != noise)}, keys).join(chosen.select(*keys, label).withColumn("_in", F.lit(True)), [*keys, label], "left")
    return out.where(F.col("_in") | ~F.col("_some")).select(labels.columns)


def cluster_sizes(df: DataFrame, label: str = "label", keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, label, n_points, share)``."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_points"))
    return per_group(counts, {"_all": F.sum("n_points")}, keys).withColumn("share", F.col("n_points") / F.col("_all")).drop("_all")


def sample_rows(df: DataFrame, most: int, seed: int = 0, order: str = "vid", presorted: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``most`` rows of each cloud without replacement, the same as NumPy's generator draws by position; all of clouds that have no more.

    A row's position is its place in its cloud in the order of a column without
    ties, which may have gaps. The draws are made where the clouds' sizes are,
    and joined back.
    """
    placed = cut(numbered(df.withColumn("_order", F.struct(*keys, order)), "_order", "_place").drop("_order"), "sample")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    large = cut(sizes.where(F.col("_n") > most), "sample-sizes")
    if not large.limit(1).count():
        return placed.drop("_place")

    def draw(batches):
        for pdf in batches:
            for n, start in zip(pdf["_n"], pdf["_start"], strict=True):
                picked = np.random.default_rng(seed).choice(n, size=most, replace=False)
                yield pd.DataFrame({"_place": (np.sort(picked) if presorted else picked) + start})

    chosen = large.select("_n", "_start").mapInPandas(draw, "_place long")
    if keys:
        small = sizes.where(F.col("_n") <= most).select(*[F.col(k).alias(f"_s_{k}") for k in keys])
        whole = placed.join(small, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "left_semi")
        return placed.join(chosen, "_place", "left_semi").unionByName(whole).drop("_place")
    return placed.join(chosen, "_place", "left_semi").drop("_place")


def numbered(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in the order of a column without ties.

    Rows are dealt by ranges of the column; the counts of the ranges, one row for
    each, give the number that a range starts at.
    """
    dealt = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1 + F.col("_start")
    return dealt.join(starts.select("_range", "_start"), "_range").withColumn(name, place.cast("long")).select(*df.columns, name)


def best_k(scores: DataFrame, k: str = "k", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """The k of the largest score; of equals the smallest."""
    return scores.groupBy(*keys).agg(F.max_by(k, F.struct(F.col(score), -F.col(k))).alias("best_k"), F.max(score).alias("best_score"))


def union_with_source(parts: dict[str, DataFrame], vid: str = "vid") -> DataFrame:
    """All rows of all parts with ``source`` and ``source_index``."""
    tagged = [df.withColumns({"source": F.lit(name), "source_index": F.col(vid)}) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def distinct_labels(columns: list[Column], df: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Distinct labels that any of the columns holds."""
    return reduce(lambda a, b: a.union(b), [df.select(*keys, c.alias("label")) for c in columns]).distinct()


def unused_rows(source: DataFrame, used: DataFrame, on: tuple[str, ...] = ("uid", "vid")) -> DataFrame:
    """Rows of ``source`` whose key is not used."""
    return source.join(used.select(*on).distinct(), list(on), "left_anti")


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def dominant(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """``(*keys, value, n)``: the commonest value of each group; of equals the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col(value))).alias("_b")).select(*keys, "_b.*")


def run_status(runs: DataFrame, needs: list[str], errors: list[str]) -> DataFrame:
    """``runs`` with ``status`` and ``errors``: failed if an error is set, ok if all that is needed is there, else pending."""
    joined = F.concat_ws("; ", *[F.nullif(F.col(e), F.lit("")) for e in errors])
    there = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in needs])
    return runs.withColumns({"errors": joined, "status": F.when(joined != "", "failed").when(there, "ok").otherwise("pending")})


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def histogram(df: DataFrame, value: str, bins: int = 80, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, bin, low, high, n)``: plot data of a column, over equal bins of its range."""
    out = per_group(df.where(is_finite(value)), {"_lo": F.min(value), "_hi": F.max(value)}, keys)
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    step = (F.col("_hi") - F.col("_lo")) / bins
    return out.groupBy(*keys, place.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(*keys, "bin", (F.col("_lo") + step * F.col("bin")).alias("low"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("high"), "n")


def heatmap(iou: DataFrame, value: str = "iou", keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``(*keys, row, column, value)``: plot data of a matrix of instances, rows and columns counted from 0 in the order of their ids."""
    row = F.dense_rank().over(W.partitionBy(*keys).orderBy("gt")) - 1
    column = F.dense_rank().over(W.partitionBy(*keys).orderBy("pred")) - 1
    return iou.select(*keys, row.alias("row"), column.alias("column"), F.col(value).alias("value"))


def scatter(df: DataFrame, most: int = 20_000, seed: int = 0, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> DataFrame:
    """``(*keys, vid, plane, a, b)``: plot data of a sample of each cloud, seen along every axis."""
    planes = [(a, b) for i, a in enumerate(coords) for b in coords[i + 1 :]]
    shown = F.explode(F.array(*[F.struct(F.lit(a + b).alias("plane"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in planes]))
    return sample_rows(df.select(*keys, vid, *coords), most, seed, vid, keys=keys).select(*keys, vid, shown.alias("_p")).select(*keys, vid, "_p.*")
