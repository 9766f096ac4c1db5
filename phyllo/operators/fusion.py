"""Fusion of two reconstructions of one cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.functions.scalars import is_finite, normalise_quaternion, sanitise_opacity
from phyllo.operators.aggregates import sample_rows, union_with_source
from phyllo.operators.quantiles import group_quantiles
from phyllo.operators.spatial import COORDS, nearest_join
from phyllo.session import cut


def fuse(main: DataFrame, fill: DataFrame, keep_q: float = 0.75, fill_q: float = 0.35, most_fill: int = 200_000, seed: int = 0, sanitise: bool = True, names: tuple[str, str] = ("radegs", "gof"), coords: tuple[str, ...] = COORDS, vid: str = "vid") -> tuple[DataFrame, dict[str, int]]:
    """(the fused rows with ``source`` and ``source_index``, counts) of two clouds of one plant.

    Kept: rows of ``main`` whose nearest of ``fill`` is within the ``keep_q``
    quantile of those distances. Added: rows of ``fill`` farther from ``main``
    than the larger of that limit and the ``fill_q`` quantile of their own
    distances, at most ``most_fill`` of them by a seeded draw in row order. If a
    side is empty, the other is taken whole. Columns must agree in name and order.
    """
    if main.columns != fill.columns:
        raise ValueError("the clouds' columns differ in name or order")
    any_main, any_fill = bool(main.limit(1).count()), bool(fill.limit(1).count())
    if any_main and any_fill:
        there = cut(nearest_join(main, fill, (), coords, vid), "fuse-main")
        back = cut(nearest_join(fill, main, (), coords, vid), "fuse-fill")
        at = lambda df, q: (group_quantiles(df.where(is_finite("d")), {"q": (F.col("d"), [q])}, ()).first()["q"] or [0.0])[0]
        keep_to = at(there, keep_q)
        fill_from = max(at(back, fill_q), keep_to)
        kept = cut(main.join(there.where(F.col("d") <= keep_to), vid, "left_semi"), "fuse-kept")
        extra = cut(fill.join(back.where(F.col("d") > fill_from), vid, "left_semi"), "fuse-extra")
    else:
        kept, extra = main, fill
    if extra.limit(most_fill + 1).count() > most_fill:
        drawn = sample_rows(extra.select(vid), most_fill, seed, vid, presorted=True)
        extra = extra.join(drawn, vid, "left_semi")
    out = union_with_source({names[0]: kept.select(main.columns), names[1]: extra.select(main.columns)}, vid)
    replaced = 0
    if sanitise:
        out = normalise_quaternion(out)
        if "opacity" in out.columns:
            replaced = out.where(~is_finite("opacity")).count()
            out = sanitise_opacity(out, ()).drop("opacity_replaced")
    counts = {"kept": kept.count(), "added": extra.count(), "nonfinite_opacity_replaced": replaced}
    return out, counts
