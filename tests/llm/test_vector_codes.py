"""Vector codes against a plain version with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from phyllo.llm import vector_codes as vc


def plain(rows, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """[(id, vector's integers, codes, error)] and the codebooks' digest of (id, vector) whose vectors are of one length."""
    kept = [(i, [max(-vc.LARGEST, min(vc.LARGEST, math.floor(vc.SCALE * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(4)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(4):
            sums = {}
            for _, v in kept:
                k = near(v, p)[1]
                n, s = sums.get(k, (0, [0] * w))
                sums[k] = n + 1, [a + b for a, b in zip(s, cut(v, p), strict=True)]
            new.append([[a // sums[k][0] for a in sums[k][1]] if k in sums else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v in kept:
        found = [near(v, p) for p in range(4)]
        out.append((i, v, tuple(k for _, k in found), min(sum(d for d, _ in found), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compared(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, mark int").repartition(3)
    made = vc.compress(df)
    got = sorted(((r["vec_id"], tuple(r["code"]), r["error"]) for r in made.rows.collect()), key=repr)
    want, digest = plain(rows)
    assert got == sorted(((i, c, e) for i, _, c, e in want), key=repr) and made.sha256 == digest


@pytest.fixture
def small_books(monkeypatch):
    """Codebooks of 16 entries, in the driver and, as workers are sent them, everywhere."""
    monkeypatch.setattr(vc, "ENTRIES", 16)


def test_codes_equal_plain_ones(spark):
    r = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(3 * i - 50, [f32(r.gauss(i % 5, 0.3)) for _ in range(20)]) for i in range(400)]
    rows += [(i, [f32(0.25)] * 20) for i in range(5000, 5040)] + [rows[7], rows[7], (None, [f32(-1.5)] * 20)]
    rows += [(1, None), (2, [float("nan")] * 20), (3, [f32(1)] * 19 + [float("inf")]), (4, [None] + [f32(1)] * 19), (5, [float("-inf")] + [0.0] * 19)]
    compared(spark, rows)


@pytest.mark.parametrize("size", [1e5, 1e14, 1e30])
def test_codes_of_large_components(spark, size):
    r = random.Random(5)
    rows = [(i, [r.choice((-1, 1)) * size * r.random() for _ in range(8)]) for i in range(60)] + [(100 + i, [r.random() for _ in range(8)]) for i in range(60)]
    compared(spark, rows, "double")


def test_vectors_of_unlike_lengths_and_clashing_names(spark):
    short = spark.createDataFrame([(1, [1.0, 2.0, 3.0], "x", 5), (2, [], "y", 6), (3, [1.0, 2.0, 3.0, 0.0, 0.5], "z", 7)], "vec_id long, embedding array<double>, ints string, n int")
    filled = spark.createDataFrame([(i, v + [0.0] * (8 - len(v))) for i, v in ((1, [1.0, 2.0, 3.0]), (2, []), (3, [1.0, 2.0, 3.0, 0.0, 0.5]))], "vec_id long, embedding array<double>")
    one, other = vc.compress(short), vc.compress(filled)
    assert one.sha256 == other.sha256
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in one.rows.collect()) == sorted((r["vec_id"], r["code"], r["error"]) for r in other.rows.collect())
    assert {(r["ints"], r["n"]) for r in one.rows.collect()} == {("x", 5), ("y", 6), ("z", 7)} and one.rows.columns == ["vec_id", "embedding", "ints", "n", "code", "error"]
    none = vc.compress(short.limit(0))
    assert none.rows.count() == 0 and none.codebooks.shape == (4, 0, 1)
    assert vc.compress(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).rows.count() == 0


def test_bounds_are_below_distances_and_filter():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-900, 900, (500, 16)), rng.integers(-900, 900, (256, 16))
    entries[40] = entries[3]
    exact = ((x[:, None] - entries) ** 2).sum(axis=2)
    for level in vc.LEVELS:
        a, b = vc.summary(x, level), vc.summary(entries, level)
        assert (((a[:, None] - b) ** 2).sum(axis=2) <= exact * (1 + 1e-9) + 1e-6).all()
    book = vc.Codebook(entries)
    place, least = book.nearest(x)
    assert (place == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert sorted(book.open, reverse=True) == book.open and len(x) <= book.open[-1] < 0.02 * x.shape[0] * len(entries)
    far = vc.Codebook(entries + np.arange(256)[:, None] * 10_000)
    place, _ = far.nearest(entries[:50] + np.arange(50)[:, None] * 10_000)
    assert place.tolist() == list(range(50)) and far.open[0] < 4 * 50
