"""Exact quantiles of groups of any size.

Spark's own percentile keeps every distinct value of a group in one buffer. That
is the faster way for groups up to ``MOST`` rows. In larger ones the ranks asked
for are narrowed down: the values between two bounds are counted in equal bins,
and the bounds move to the ends of the one bin that holds the rank, until that
bin holds few values. Counts are pre-aggregated, so a hot group is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.session import cut

#: Rows of a group whose values one buffer may hold, and bins of a round.
MOST, BINS = 1 << 20, 1024


def _same(a: str, b: str, names) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names], F.lit(True))


def group_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], keys: tuple[str, ...] = ("uid",), most: int = MOST) -> DataFrame:
    """``(*keys, one array for each name)``: quantiles of columns, linear between ranks. Null values don't count; a group of nulls has a null array."""
    aggs = [F.percentile(c.cast("double"), F.array(*map(F.lit, qs))).alias(name) for name, (c, qs) in wanted.items()]
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    if large.isEmpty():
        return df.groupBy(*keys).agg(*aggs)
    large = cut(large, "quantile-groups")
    whole = df.alias("d").join(large.alias("l"), _same("d", "l", keys), "left_anti").groupBy(*keys).agg(*aggs) if keys else None
    crowded = df.alias("d").join(large.alias("l"), _same("d", "l", keys), "left_semi")
    out = large.select(*keys)
    for name, (c, qs) in wanted.items():
        found = _selected(crowded.select(*keys, c.cast("double").alias("_v")).where("_v IS NOT NULL"), qs, keys, most).withColumnRenamed("_q", name)
        out = out.alias("o").join(found.alias("f"), _same("o", "f", keys), "left").select(*[F.col(f"o.{c_}").alias(c_) for c_ in out.columns], F.col(f"f.{name}").alias(name))
    return out if whole is None else whole.unionByName(out)


def _selected(rows: DataFrame, qs: list[float], keys: tuple[str, ...], most: int) -> DataFrame:
    """``(*keys, _q)`` by narrowing down the ranks below and above each quantile."""
    v, inf = F.col("_v"), F.lit(float("inf"))
    finite = (F.abs(v) < inf) & ~F.isnan(v)
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(v == -inf).alias("down"), F.count_if(finite).alias("whole"), F.count_if(v == inf).alias("up"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    ends = cut(ends, "quantile-ends")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in qs])))
    asked = cut(ends.select("*", F.explode(ranks).alias("rank")), "quantile-ranks")
    beyond = F.when(F.col("rank") < F.col("down"), -inf).when(F.col("rank") < F.col("down") + F.col("whole") + F.col("up"), inf).otherwise(F.lit(float("nan")))
    inside = (F.col("rank") >= F.col("down")) & (F.col("rank") < F.col("down") + F.col("whole"))
    open_ = asked.where(inside).select(*keys, "rank", "lo", "hi", F.col("down").alias("below"), F.col("whole").alias("held"))
    rows = rows.where(finite)
    done, at = [], (*keys, "rank")
    while True:
        done.append(open_.where((F.col("held") <= most) | (F.col("lo") == F.col("hi"))))
        open_ = open_.where((F.col("held") > most) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        near = rows.alias("r").join(open_.alias("o"), _same("r", "o", keys) & F.col("r._v").between(F.col("o.lo"), F.col("o.hi"))).select(*[F.col(f"o.{c}").alias(c) for c in (*at, "lo", "hi", "below")], "r._v")
        step = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))  # halves: no difference overflows
        step = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BINS - 1).otherwise(step)  # so every round parts the two ends, and ends
        bins = near.groupBy(*at, "below", step.alias("bin")).agg(F.count(F.lit(1)).alias("held"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("held").over(W.partitionBy(*at).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("below")  # a row for each bin
        picked = bins.withColumn("_b", before).where((F.col("_b") <= F.col("rank")) & (F.col("rank") < F.col("_b") + F.col("held")))
        open_ = cut(picked.select(*at, "lo", "hi", F.col("_b").alias("below"), "held"), "quantile-open")
    bounds = reduce(DataFrame.unionByName, done)
    same = bounds.where("lo = hi").select(*at, F.col("lo").alias("value"))
    few = bounds.where("lo < hi").alias("o")
    near = rows.alias("r").join(few, _same("r", "o", keys) & F.col("r._v").between(F.col("o.lo"), F.col("o.hi"))).groupBy(*[F.col(f"o.{c}").alias(c) for c in (*at, "below")]).agg(F.sort_array(F.collect_list("r._v")).alias("vs"))  # ``most`` at most
    values = same.unionByName(near.select(*at, F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
    values = values.unionByName(asked.where(~inside).select(*at, beyond.alias("value")))
    table = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))  # two ranks for each quantile
    met = ends.alias("e").join(table.alias("t"), _same("e", "t", keys)).select(*[F.col(f"e.{k}").alias(k) for k in keys], "e.n", "t._m")

    def between(q: float) -> Column:
        low, high, share = F.col("_m")[F.floor(place(q))], F.col("_m")[F.ceil(place(q))], place(q) - F.floor(place(q))
        return F.when((share == 0) | (low == high), low).otherwise((1 - share) * low + share * high)

    return met.select(*keys, F.array(*map(between, qs)).alias("_q"))


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], keys: tuple[str, ...] = ("uid",), most: int = MOST) -> DataFrame:
    """``df`` with the arrays of ``group_quantiles`` of its group."""
    found = group_quantiles(df, wanted, keys, most)
    if not keys:
        return df.crossJoin(found)  # one row
    named = found.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *wanted)
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left").drop(*[f"_g_{k}" for k in keys])
