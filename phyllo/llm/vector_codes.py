"""Compression of vectors to codes: integer product quantisation with segment-mean lower bounds.

Vectors become integers and are cut into equal parts; every part position has a
codebook of at most 256 entries that a few rounds of k-means improve. All sums,
distances and means are exact integers, so reruns and cluster sizes don't matter.

The nearest entry is found coarse to fine. A vector is described by the means of
its blocks and by the norm of what the means leave, its residual. For a block of
``m`` components the squared distance of two vectors is ``m`` times the squared
difference of the means, plus the squared distance of the residuals, which is at
least the squared difference of their norms. Entries whose bound exceeds a
distance that has been reached are dropped, first by one block, then by finer
ones; what survives gets its exact distance. Bounds are lowered by more than
their rounding, so no nearest entry, and none of equal distance, is ever lost.

Codebooks have a fixed size, and are all that is broadcast; a round sends each
task's sums and counts by entry through an aggregation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches
from phyllo.operators.grouped import per_group
from phyllo.session import cut

#: Parts of a vector, entries of a codebook, rounds, and integer steps in 1.0.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of blocks that bounds are taken over, coarse to fine, rows that are searched at once, and the share of open pairs above which a level's bounds are taken by one product of matrices.
LEVELS, ROWS, CROWDED = (1, 4, 16), 1024, 0.1
#: Integers are kept as longs; components beyond are cut to the largest.
LARGEST = (1 << 62) - 1


def _blocks(width: int, level: int) -> np.ndarray:
    """Starts of the blocks of a part: ``level`` of them, or as many as there are components."""
    n = max(1, min(level, width))
    return np.array([width * i // n for i in range(n)], np.int64)


def summary(x: np.ndarray, level: int) -> np.ndarray:
    """Block means, each times the root of its block's length, and the residual's norm: distances of summaries bound distances of vectors from below."""
    starts = _blocks(x.shape[1], level)
    lengths = np.diff(np.append(starts, x.shape[1]))
    wide = x.astype(np.float64)
    sums = np.add.reduceat(wide, starts, axis=1)
    rest = wide - np.repeat(sums / lengths, lengths, axis=1)
    return np.column_stack([sums / np.sqrt(lengths), np.sqrt((rest * rest).sum(axis=1))])


def _lowered(bound: np.ndarray, scale: float) -> np.ndarray:
    """A bound less what rounding may have added to it; ``scale``: the largest squared norm at hand."""
    return bound - 1e-9 * (bound + scale) - 1e-6


@dataclass
class Codebook:
    """The entries of one part position, and their summaries at every level."""

    entries: np.ndarray
    levels: tuple[int, ...] = LEVELS
    summaries: list[np.ndarray] = field(init=False)
    open: list[int] = field(init=False, default_factory=list)  # pairs that each level leaves, for each block of rows

    def __post_init__(self):
        self.summaries = [summary(self.entries, n) for n in self.levels]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of ``x``; ties go to the lower entry."""
        place, least = np.zeros(len(x), np.int64), np.zeros(len(x), self.entries.dtype)
        for at in range(0, len(x), ROWS):
            place[at : at + ROWS], least[at : at + ROWS] = self._nearest(x[at : at + ROWS])
        return place, least

    def _distance(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        apart = x - self.entries[entries]
        return (apart * apart).sum(axis=1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reached, rows, entries = None, np.repeat(np.arange(len(x)), len(self.entries)), np.tile(np.arange(len(self.entries)), len(x))
        for level, theirs in zip(self.levels, self.summaries, strict=True):
            mine = summary(x, level)
            scale = float((mine * mine).sum(axis=1).max() + (theirs * theirs).sum(axis=1).max())
            if len(rows) > CROWDED * len(x) * len(self.entries):
                bound = ((mine * mine).sum(axis=1)[:, None] + (theirs * theirs).sum(axis=1) - 2 * (mine @ theirs.T))[rows, entries]
            else:
                apart = mine[rows] - theirs[entries]
                bound = np.einsum("ij,ij->i", apart, apart)
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))  # every row keeps its nearest entry at least
            ahead = np.flatnonzero(bound == np.minimum.reduceat(bound, first)[rows])
            ahead = ahead[np.append(True, np.diff(rows[ahead]) != 0)]
            tried = self._distance(x, entries[ahead])
            reached = tried if reached is None else np.minimum(reached, tried)
            kept = _lowered(bound, scale) <= reached.astype(np.float64)[rows]
            rows, entries = rows[kept], entries[kept]
            self.open.append(len(rows))
        exact = self._distance(x[rows], entries)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        least = np.minimum.reduceat(exact, first)
        at = np.flatnonzero(exact == least[rows])  # pairs go by row, then by entry
        return entries[at[np.append(True, np.diff(rows[at]) != 0)]], least


def as_integers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` as longs, cut to ``LARGEST``."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    inside = np.abs(scaled) < float(LARGEST)
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, LARGEST, -LARGEST))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the same width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Codes:
    """What ``compress`` returns: the coded rows, the final codebooks as an array (part, entry, position), and their digest."""

    rows: DataFrame
    codebooks: np.ndarray
    sha256: str


def _parts(width: int, at: int) -> slice:
    return slice(at * width, (at + 1) * width)


def _usable(vec: str):
    """A vector that is not null and holds only finite numbers."""
    return F.col(vec).isNotNull() & F.forall(F.coalesce(vec, F.array().cast("array<double>")), lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def _typed(ints: np.ndarray, wide: bool) -> np.ndarray:
    return ints.astype(object) if wide else ints


def _updated(books: np.ndarray, kept: DataFrame, width: int, wide: bool, more: bool) -> np.ndarray:
    """The codebooks after one round: every used entry becomes the floored mean of its parts."""
    spark = kept.sparkSession
    sent = spark.sparkContext.broadcast(books)
    n_entries = books.shape[1]

    def sums(batches):
        total, counts = _typed(np.zeros((PARTS, n_entries, width), np.int64), more), np.zeros((PARTS, n_entries), np.int64)
        found = [Codebook(_typed(b, wide)) for b in sent.value]
        for b in batches:
            x = _typed(_matrix(b.column(0), PARTS * width), wide)
            for p, book in enumerate(found):
                part = x[:, _parts(width, p)]
                place, _ = book.nearest(part)
                order = np.argsort(place, kind="stable")
                used, first = np.unique(place[order], return_index=True)
                total[p, used] += np.add.reduceat(_typed(part[order], more), first, axis=0)
                counts[p] += np.bincount(place, minlength=n_entries)
        p, e = np.nonzero(counts)
        values = pa.array([[str(v) for v in row] for row in total[p, e]] if more else total[p, e].tolist(), pa.list_(pa.string() if more else pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), values], names=["part", "entry", "n", "sums"])

    made = map_batches(kept.select("ints"), sums, f"part int, entry int, n long, sums array<{'string' if more else 'bigint'}>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)" if more else "long")).cast("string").alias(f"s{i}") for i in range(width)]
    used = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # PARTS * ENTRIES rows at most
    sent.destroy()
    out = books.copy()
    for row in used:
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return out


def compress(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", rounds: int = ROUNDS) -> Codes:
    """Codes of the usable rows of ``vectors``: all their columns plus ``code`` (array of PARTS ints) and ``error`` (long).

    Rows whose vector is null or holds null or non-finite components are dropped.
    The first codebooks are the parts of the ENTRIES smallest keys, null keys last,
    equal keys by their vector; with fewer rows they have fewer entries. Vectors
    are as long as the longest, and that a multiple of PARTS: others are filled up
    with zeros, an empty one is all zeros. Components beyond the range of longs are
    cut to it, and so is an error. Columns that are already called ``code`` or
    ``error`` are replaced; repeated rows stay; an empty table gives no rows.
    """
    rows = vectors.drop("code", "error").where(_usable(vec))
    longest = rows.agg(F.max(F.size(vec))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    names = [f"c{i}" for i in range(len(rows.columns))]
    carried = rows.select(F.col(f"`{vec}`").cast("array<double>").alias("v"), F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)])
    schema = ", ".join(["ints array<bigint>", f"id {carried.schema['id'].dataType.simpleString()}"] + [f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(rows.columns, names, strict=True)])

    def integers(batches):
        for b in batches:
            ints = as_integers(_matrix(b.column(0), PARTS * width))
            offsets = pa.array(np.arange(0, ints.size + 1, PARTS * width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(ints.ravel())), *b.columns[1:]], names=["ints", "id", *names])

    kept = cut(map_batches(carried, integers, schema), "codes-integers")
    n, largest = kept.agg(F.count(F.lit(1)), F.max(F.greatest(F.array_max("ints"), -F.array_min("ints")))).first()
    wide, more = PARTS * width * (2 * (largest or 0)) ** 2 > LARGEST, (largest or 0) * max(n, 1) > LARGEST  # whether distances, and sums, need more than longs
    first = kept.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(ENTRIES).toArrow()["ints"].combine_chunks()
    books = _matrix(first, PARTS * width).reshape(-1, PARTS, width).transpose(1, 0, 2) if n else np.zeros((PARTS, 0, width), np.int64)
    for _ in range(rounds if n else 0):
        books = _updated(books, kept, width, wide, more)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def coded(batches):
        found = [Codebook(_typed(b, wide)) for b in sent.value] if sent.value.shape[1] else []
        for b in batches:
            x = _typed(_matrix(b.column(0), PARTS * width), wide)
            codes, error = np.zeros((len(x), PARTS), np.int32), _typed(np.zeros(len(x), np.int64), wide)
            for p, book in enumerate(found):
                codes[:, p], least = book.nearest(x[:, _parts(width, p)])
                error = error + least
            error = np.minimum(error, (1 << 63) - 1).astype(np.int64) if wide else error
            offsets = pa.array(np.arange(0, codes.size + 1, PARTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)], names=[*names, "code", "error"])

    out = map_batches(kept.select("ints", *names), coded, ", ".join([*schema.split(", ", 2)[2:], "code array<int>", "error long"]))
    out = out.select(*[F.col(n).alias(c) for c, n in zip(rows.columns, names, strict=True)], "code", "error")
    return Codes(out, books, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and error of every vector, its label's summed error, and the digest of the codebooks."""
    made = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    rows = cut(made.rows.select("vec_id", "label", digits.alias("code"), "error"), "codes")
    return per_group(rows, {"label_error": F.sum("error")}, ("label",)).select("vec_id", "code", "error", "label_error", F.lit(made.sha256).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """One pair of relations for each round: the nearest entries, then the entries' new values."""
    apart = "list_sum(list_transform(list_zip(k.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "SELECT k.vec_id, k.part, k.x, min({d: " + apart + ", entry: b.entry}) AS best FROM k JOIN b%d b USING (part) GROUP BY ALL"
    moved = (
        "SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b%d b LEFT JOIN (SELECT part, entry, list(CAST((s - (s %% n + n) %% n) // n AS BIGINT) ORDER BY i) AS x "
        "FROM (SELECT part, best.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM n%d, range(1, 65) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry)"
    )
    steps = []
    for r in range(ROUNDS):
        steps += [f"n{r} AS MATERIALIZED ({nearest % r})", f"b{r + 1} AS MATERIALIZED ({moved % (r, r)})"]
    last = nearest % ROUNDS
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM e, range({PARTS}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM k QUALIFY entry < {ENTRIES}
), {", ".join(steps)}, z AS MATERIALIZED ({last}),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN e USING (vec_id) CROSS JOIN digest
"""


OP11_SQL = _op11_sql()
