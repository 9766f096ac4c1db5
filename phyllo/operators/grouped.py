"""Statistics of a group beside each of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, stats: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """``df`` with aggregate columns of its group.

    The aggregate is one row per group and joined back by a null-safe equality,
    so that only it is moved where it is small (Spark checks its size), and a hot
    group is never ordered or gathered as by a window.
    """
    if not keys:
        return df.crossJoin(df.agg(*[c.alias(n) for n, c in stats.items()]))  # one row
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    right = agg.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *stats)
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(right, on, "left").drop(*[f"_g_{k}" for k in keys])
