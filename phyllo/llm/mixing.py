"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document of a source gets the whole copies that its source's target holds
for certain, ``floor(target / source size)``. The rest of the target is filled by
a Pareto order sample: documents are ranked by their random odds ``u / (1 - u)``
divided by the odds ``p / (1 - p)`` of their inclusion, and are taken in that
order until the source's missing words are there. Inclusion is unequal: ``p`` is
the missing share of the source times a damping of long documents
(``size ** -DAMPING``, scaled so that the expected words come out the same), so
that a few huge pages do not make up a source's extra copies.

Ranks are never taken over a whole source. The rank order is cut into ``CELLS``
cells; words are summed by source and cell, and the one cell in which the target
is reached is cut once more in the same way. Only the documents of the one part
in which the target is reached are ordered, about one of 17 million of a source.
The outcome is one threshold for each source, so the decision on a document needs
nothing but its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.operators.aggregates import numbered
from phyllo.session import cut

#: Weights of the sources in their order, repeating; the share of all words that the mix has; copies at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
DAMPING = 0.25
CELLS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Number of words of a text; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _uniform(doc_id: Column) -> Column:
    """A number in (0, 1) drawn from the seed and the id: 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, damped, target)`` of ``(source, source_size, damped)``.

    Filling the targets by weight and sharing out anew what a full source can't
    hold ends at one level: a source has ``weight * level`` or, if less, its cap.
    The sources that reach their cap are those with the smallest cap for their
    weight, so the level follows from running sums. Both orders are dealt by
    ranges, so there may be as many sources as web domains.
    """
    ranked = numbered(sizes.withColumn("_by", F.struct(F.col("source").isNull(), "source")), "_by", "place").drop("_by")
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(MOST))
    order = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place")
    run = _sums_before(ranked.withColumn("_order", order), "_order", {"full": "cap", "full_weight": "weight", "full_words": "source_size"})
    level = (F.lit(SHARE) * F.col("all_full_words") - F.col("full")) / (F.col("all_full_weight") - F.col("full_weight"))
    run = cut(run.select("source", "source_size", "damped", "weight", "cap", "_order", level.alias("level")), "mix-levels")
    first_open = run.agg(F.min_by("level", F.when(F.col("_order.ratio") > F.col("level"), F.col("_order"))).alias("first_open"))  # one row
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("first_open", F.lit(0.0)))
    return run.crossJoin(first_open).select("source", "source_size", "damped", target.alias("target"))


def _sums_before(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with sums of columns over all rows before a row, in an order without ties, and over all rows (``all_``): by ranges, whose totals are one row each."""
    dealt = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(every).alias(f"all_{n}") for n in sums])
    within = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(starts, "_range").withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


@dataclass(frozen=True)
class Mix:
    """The plan of a mix: what each source takes, and how far its rank order is taken."""

    plan: DataFrame
    sizes: DataFrame

    def counted(self) -> DataFrame:
        """``(doc_id, source)`` of the documents that were planned for, plus the columns of ``apply``; their words are not counted again."""
        return self._decide(self.sizes.withColumnRenamed("size", "_phyllo_size"), ["doc_id", "source"])

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``size``, ``source_size``, ``target`` and ``copies``; columns already called so are replaced."""
        docs = docs.drop("size", "source_size", "target", "copies")
        return self._decide(docs.withColumn("_phyllo_size", n_words("text")), docs.columns)

    def _decide(self, sized: DataFrame, names: list[str]) -> DataFrame:
        kept = [F.col(f"d.`{c}`") for c in names]
        joined = sized.alias("d").join(self.plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        size, key = F.col("d._phyllo_size"), _key(F.col("d.doc_id"))
        rank = _rank(size, F.col("d.doc_id"), F.col("p.per_word"))
        within = (rank < F.col("p.last_rank")) | ((rank == F.col("p.last_rank")) & (key <= F.col("p.last_key")))
        inner = (_part(rank) < F.col("p.last_part")) | ((_part(rank) == F.col("p.last_part")) & within)
        extra = (size > 0) & ((_cell(rank) < F.col("p.last_cell")) | ((_cell(rank) == F.col("p.last_cell")) & inner))
        copies = F.when(size > 0, F.col("p.whole") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
        return joined.select(*kept, size.alias("size"), F.col("p.source_size"), F.col("p.target"), copies.alias("copies"))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def _damping(size: Column) -> Column:
    return F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(-DAMPING))


def _rank(size: Column, doc_id: Column, per_word: Column) -> Column:
    """Random odds over inclusion odds; ``per_word``: inclusion for a damping of 1."""
    u, p = _uniform(doc_id), F.least(F.greatest(per_word * _damping(size), F.lit(1e-9)), F.lit(1 - 1e-9))
    return (u / (1 - u)) / (p / (1 - p))


def _cell(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * CELLS)


def _part(rank: Column) -> Column:
    """The place within a cell, which is cut into as many parts as there are cells."""
    place = rank / (1 + rank) * CELLS
    return F.floor((place - F.floor(place)) * CELLS)


def _ranked(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """The rows with words of the sources in ``open_``, whose columns they carry, with their rank and its cell and part."""
    joined = rows.where(F.col("size") > 0).alias("d").join(open_.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")))
    ranked = joined.select("o.*", "d.size", _key(F.col("d.doc_id")).alias("key"), _rank(F.col("d.size"), F.col("d.doc_id"), F.col("o.per_word")).alias("rank"))
    return ranked.withColumns({"cell": _cell(F.col("rank")), "part": _part(F.col("rank"))})


def _reached(ranked: DataFrame, held: list[str], cell: str) -> DataFrame:
    """``(*held, last_..., before)``: the cell in which a source's missing words are reached, and the words before it. ``held``: columns that a source has one value of."""
    cells = ranked.groupBy(*held, "before", cell).agg(F.sum("size").alias("words"))
    running = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy(cell))
    last = cells.withColumn("up_to", running).where(F.col("up_to") >= F.col("missing"))
    first = last.groupBy(*held).agg(F.min(F.struct(F.col(cell).alias(f"last_{cell}"), (F.col("up_to") - F.col("words")).alias("before"))).alias("at"))
    return cut(first.select(*held, "at.*"), "mix-cells")


def plan_mix(docs: DataFrame) -> Mix:
    """The plan for ``docs`` (doc_id, source, text).

    Null and wordless texts have size 0 and are not taken. A null source is a
    source of its own, the last. Documents of equal rank are ordered by their id,
    nulls first; repeated rows of one id stand or fall together, so with them a
    source comes near its target up to their words. An empty table gives an empty
    plan. Reruns agree: nothing is drawn but by hashing the id.
    """
    rows = cut(docs.select(F.col("doc_id"), "source", n_words("text").alias("size")), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _damping(F.col("size"))).alias("damped"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = source_targets(sums).withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.withColumn("per_word", F.when(F.col("damped") > 0, F.col("missing") / F.col("damped")).otherwise(0.0)), "mix-targets")
    held = ["source", "missing", "per_word"]
    open_ = plan.where(F.col("missing") > 0).select(*held, F.lit(0).cast("long").alias("before"))
    last = _reached(_ranked(rows, open_), held, "cell")
    edge = _ranked(rows, last).where(F.col("cell") == F.col("last_cell"))
    inner = _reached(edge, [*held, "last_cell"], "part")
    edge = _ranked(rows, inner).where((F.col("cell") == F.col("last_cell")) & (F.col("part") == F.col("last_part")))
    up_to = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank", "key").rowsBetween(W.unboundedPreceding, 0))
    taken = F.when(F.col("up_to") - F.col("size") / 2 <= F.col("missing"), F.struct("rank", "key"))
    ends = edge.withColumn("up_to", up_to).groupBy("source", "last_cell", "last_part").agg(F.max(taken).alias("end"))
    out = plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    return Mix(cut(out.select("p.*", "e.last_cell", "e.last_part", F.col("e.end.rank").alias("last_rank"), F.col("e.end.key").alias("last_key")), "mix-plan"), rows)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each as many times as the mix has it, side by side, with the columns of ``docs`` whatever their names."""
    names = [f"_phyllo_{i}" for i in range(len(docs.columns))]  # no column is lost to a name that the plan adds
    carried = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("_phyllo_row"))
    taken = plan_mix(docs).apply(carried).where(F.col("copies") > 0)
    taken = taken.withColumn("_phyllo_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(f"_phyllo_row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op8_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    """Words of every document in the mix, beside its size and its source's size and target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = plan_mix(docs).counted()
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * pow(CAST(greatest(size, 1) AS DOUBLE), -0.25)) AS DOUBLE) AS damped
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS place, CAST(2 * source_size AS DOUBLE) AS cap
  FROM s
), l AS (
  SELECT *, row_number() OVER o AS step,
    (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, place), b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, damped, least(cap, weight * (SELECT arg_min(level, step) FROM l WHERE cap / weight > level)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, p.*, p.target - whole * source_size AS missing,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    least(greatest((p.target - whole * source_size) / damped * pow(CAST(greatest(size, 1) AS DOUBLE), -0.25), 1e-9), 1 - 1e-9) AS q
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (q / (1 - q)), doc_id ROWS UNBOUNDED PRECEDING) AS up_to FROM r
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND missing > 0 AND up_to - size / 2.0 <= missing THEN 1 ELSE 0 END) AS BIGINT) AS taken, source,
  CAST(CASE WHEN size > 0 THEN whole + CASE WHEN missing > 0 AND up_to - size / 2.0 <= missing THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
FROM c
"""
