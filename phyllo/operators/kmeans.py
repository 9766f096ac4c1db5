"""Mini-batch k-means: seeded starts, centres with counts, and batches read from a table dealt by batch.

A step assigns one batch to its nearest centres; every task sums its rows by
centre, the sums meet in an aggregation, and a centre moves to the mean of all
rows it has ever taken: ``(count * centre + sum) / (count + n)``. What reaches the
driver is one row for each centre.

Centres are searched by groups: a group has a pivot and a radius, and a row looks
into a group only if its distance to the pivot less the radius is within the least
distance that it has found. So most of many centres are skipped, and the nearest
is always found; ties go to the lower centre.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.session import cut

#: Rows that are searched at once, and rows of the sample that starts are drawn from, for each centre.
ROWS, START_ROWS = 2048, 20


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, summed up axis by axis."""
    out = np.zeros((len(points), len(others)))
    for i in range(points.shape[1]):
        apart = points[:, i, None] - others[None, :, i]
        out += apart * apart
    return out


@dataclass
class Centres:
    """``values`` (k x width) and how many rows each has taken."""

    values: np.ndarray
    counts: np.ndarray
    looked: int = field(default=0, compare=False)  # distances that searches have taken

    def __post_init__(self):
        self.values, self.counts = np.asarray(self.values, np.float64), np.asarray(self.counts, np.float64)
        n = max(1, int(len(self.values) ** 0.5))
        pivots, far = [0], np.full(len(self.values), np.inf)
        while len(pivots) < n:
            far = np.minimum(far, squared(self.values, self.values[pivots[-1:]])[:, 0])
            if not far.max() > 0:
                break
            pivots.append(int(far.argmax()))
        self.pivots = self.values[pivots]
        home = squared(self.values, self.pivots).argmin(axis=1)
        self.groups = [np.flatnonzero(home == g) for g in range(len(pivots))]
        self.radii = np.array([np.sqrt(squared(self.values[g], self.pivots[i : i + 1]).max(initial=0)) for i, g in enumerate(self.groups)])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre, squared distance) of every row."""
        parts = [self._nearest(points[at : at + ROWS]) for at in range(0, len(points), ROWS)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_pivot = np.sqrt(squared(points, self.pivots))
        bound = (to_pivot - self.radii) * (1 - 1e-9) - 1e-12
        own = to_pivot.argmin(axis=1)
        place, least = np.full(len(points), len(self.values)), np.full(len(points), np.inf)
        self.looked += to_pivot.size
        for first in (True, False):
            for g, members in enumerate(self.groups):
                rows = np.flatnonzero(own == g) if first else np.flatnonzero((own != g) & (np.maximum(bound[:, g], 0) ** 2 <= least))
                if not len(rows) or not len(members):
                    continue
                d = squared(points[rows], self.values[members])
                self.looked += d.size
                at = d.argmin(axis=1)
                far, centre = d[np.arange(len(rows)), at], members[at]
                better = (far < least[rows]) | ((far == least[rows]) & (centre < place[rows]))
                place[rows[better]], least[rows[better]] = centre[better], far[better]
        return place, least


def _points(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def step(batch: DataFrame, centres: Centres, feature: str = "feat") -> tuple[Centres, float]:
    """(centres after one batch, the batch's summed squared distance to the centres before)."""
    sent = batch.sparkSession.sparkContext.broadcast(centres)
    width = centres.values.shape[1]

    def sums(batches):
        held = sent.value
        k = len(held.values)
        total, n, error = np.zeros((k, width)), np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            points = _points(b.column(0))
            if not len(points):
                continue
            place, least = held.nearest(points)
            n += np.bincount(place, minlength=k)
            error += np.bincount(place, least, k)
            for i in range(width):
                total[:, i] += np.bincount(place, points[:, i], k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(error[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["centre", "n", "error", "sums"])

    found = batch.select(F.col(feature).cast("array<double>").alias("f")).where("f IS NOT NULL").mapInArrow(sums, "centre int, n long, error double, sums array<double>")
    rows = found.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()  # one for each centre
    sent.destroy()
    values, counts, error = centres.values.copy(), centres.counts.copy(), 0.0
    for r in rows:
        c, n = r["centre"], r["n"]
        values[c] = (counts[c] * values[c] + [r[f"s{i}"] for i in range(width)]) / (counts[c] + n)
        counts[c] += n
        error += r["error"]
    return Centres(values, counts), error


def starts(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of a sample, each drawn in proportion to the squared distance from those before it; equal rows only when all others are taken."""
    chosen, far = [int(rng.integers(len(points)))], np.full(len(points), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, squared(points, points[chosen[-1:]])[:, 0])
        total = far.sum()
        chosen.append(int(rng.choice(len(points), p=far / total)) if total > 0 else int(rng.integers(len(points))))
    return points[chosen]


def fit(df: DataFrame, k: int, feature: str = "feat", vid: str = "vid", seed: int = 0, batch_rows: int = 20_000, steps: int = 60, n_init: int = 3, reassign: float = 0.01) -> Centres:
    """Centres from up to ``steps`` batches of about ``batch_rows`` rows; both are bounds of what the fit reads, whatever the table's size.

    Rows are dealt to batches by a hash of their id; with fewer batches than steps
    they are gone through again. Of ``n_init`` starts by k-means++ on a bounded
    sample that with the least error there is taken. When all batches have been
    gone through, centres that took less than ``reassign`` of what the largest did
    move to rows of the sample, and counts begin anew. Rows with a null feature are left out; with fewer rows than
    ``k``, centres repeat.
    """
    rows = df.select(F.col(vid).alias("id"), F.col(feature).cast("array<double>").alias("f")).where("f IS NOT NULL")
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit on")
    batches = max(1, -(-n // batch_rows))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int")).where(F.col("batch") < steps)
    dealt = cut(dealt.repartition("batch").sortWithinPartitions("batch", F.xxhash64("f")), "kmeans-batches")  # files of few batches each, so a step reads little
    held = _points(dealt.where("batch = 0").orderBy(F.xxhash64("id"), "id").limit(max(1000, START_ROWS * k)).select("f").toArrow()["f"].combine_chunks())
    rng = np.random.default_rng(seed)
    tried = [Centres(starts(held, k, rng), np.zeros(k)) for _ in range(n_init)]
    centres = min(tried, key=lambda c: c.nearest(held)[1].sum())
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = min(batches, steps)
    for at in range(steps):
        if at and at % every == 0:  # gone through once: what was taken for a centre where it no longer stands is forgotten
            centres = Centres(centres.values, np.zeros(k))
        centres, _ = step(dealt.where(F.col("batch") == at % every).select("f").repartition(spread), centres, "f")
        poor = np.flatnonzero(centres.counts < reassign * centres.counts.max())
        if at % every == every - 1 and at < steps - 2 * every and len(poor):
            values, counts = centres.values.copy(), centres.counts.copy()
            values[poor] = held[rng.choice(len(held), len(poor), replace=len(held) < len(poor))]
            centres = Centres(values, counts)
    return centres


def assign(df: DataFrame, centres: Centres, feature: str = "feat", out: str = "cluster_id") -> DataFrame:
    """``df`` with the nearest centre; null where the feature is null."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    fields = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in fields]

    def run(batches):
        for b in batches:
            there = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            place = np.zeros(b.num_rows, np.int64)
            if there.any():
                place[there] = sent.value.nearest(_points(b.column(0).drop_null()))[0]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(place.astype(np.int32), mask=~there)], names=[*names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` int"])
    return df.select(F.col(feature).cast("array<double>").alias("_phyllo_f"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def error(df: DataFrame, centres: Centres, feature: str = "feat") -> float:
    """The summed squared distance of all rows to their centres."""
    return step(df, centres, feature)[1]
