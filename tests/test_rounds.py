"""Operators that go in rounds of joins against plain walks: directed scans, mask suppression, average linkage."""

import random

import numpy as np
import pytest

from phyllo.operators import clustering, components, features, refine


def _walk(n, edges):
    """Components by walks over directed edges, begun at every unvisited node in ascending order; named by where they begin."""
    out, near = {}, {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    for start in range(n):
        stack = [start] if start not in out else []
        while stack:
            at = stack.pop()
            if at not in out:
                out[at] = start
                stack += near.get(at, [])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_smallest_reaching_equals_a_walk(spark, seed):
    r = random.Random(seed)
    n = 120
    edges = [(i, i) for i in range(n)] + [(r.randrange(n), r.randrange(n)) for _ in range(n if seed < 3 else n // 2)]
    if seed == 3:
        edges += [(i, i + 1) for i in range(0, 60)] + [(i + 1, i) for i in range(70, 110)]
    got = {x["node"]: x["component"] for x in components.smallest_reaching(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    assert got == _walk(n, edges)


def test_ordered_scan_follows_asymmetric_neighbours(spark):
    """With one neighbour each, edges of unevenly spaced points lead one way only."""
    r = np.random.default_rng(4)
    x = np.cumsum(r.exponential(size=80))[r.permutation(80)]
    df = spark.createDataFrame([("a", i, float(v), 0.0, 0.0, 1 + i % 2) for i, v in enumerate(x)], "uid string, vid long, x double, y double, z double, label int")
    got = {r_["vid"]: r_["part"] for r_ in clustering.scan_components(df, 4.0, 1, ordered=True).collect()}
    for lab in (0, 1):
        mine = np.arange(lab, 80, 2)
        edges = []
        for i in mine:
            far = np.abs(x[mine] - x[i])
            far[mine == i] = np.inf
            if far.min() <= 4:
                edges.append((int(i), int(mine[far.argmin()])))
        want = _walk(80, edges)
        assert all(got[i] == want[i] for i in mine.tolist())


def _suppressed(cells, scores, threshold):
    kept = []
    for m in sorted(scores, key=lambda m: (-scores[m], m)):
        if all(len(cells[m] & cells[k]) / len(cells[m] | cells[k]) < threshold for k in kept):
            kept.append(m)
    return kept


def test_mask_suppression_equals_a_walk(spark):
    r = random.Random(5)
    rows, scores, want = [], [], []
    for uid in "ab":
        cells = {m: set(r.sample(range(60), r.randint(1, 25))) for m in range(40)}
        cells |= {100 + m: set(range(10 * m, 10 * m + 14)) for m in range(30)}  # a chain, each clashing with the next
        score = {m: float(r.randint(0, 9)) if m < 100 else -float(m) for m in cells}
        rows += [(uid, m, v) for m, vs in cells.items() for v in vs]
        scores += [(uid, m, s) for m, s in score.items()]
        want += [(uid, m, score[m], i) for i, m in enumerate(_suppressed(cells, score, 0.15))]
    got = refine.nms_masks(spark.createDataFrame(rows, "uid string, mask_id long, vid long"), spark.createDataFrame(scores, "uid string, mask_id long, score double"), 0.15)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    none = spark.createDataFrame([], "uid string, mask_id long, vid long")
    assert refine.nms_masks(none, none.selectExpr("uid", "mask_id", "1.0D AS score"), 0.5).count() == 0


def _linked(n, known, links, most, blind):
    """Greedy average linkage, one merge after another, with sums over all pairs; clusters named by their smallest node."""
    clusters = {i: [i] for i in range(n)}
    apart = lambda a, b: sum(known.get((min(i, j), max(i, j)), blind) for i in clusters[a] for j in clusters[b]) / (len(clusters[a]) * len(clusters[b]))
    near = {tuple(sorted(p)) for p in links}
    while True:
        open_ = sorted((apart(a, b), a, b) for a, b in near)
        if not open_ or open_[0][0] > most:
            return {i: c for c, members in clusters.items() for i in members}
        _, a, b = open_[0]
        clusters[a] += clusters.pop(b)
        near = {tuple(sorted((a if x == b else x, a if y == b else y))) for x, y in near if (x, y) != (a, b)}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_average_linkage_equals_single_merges(spark, seed):
    r = random.Random(seed)
    n, coarse = 30, seed == 4
    draw = (lambda: r.choice([0.0, 0.125, 0.25, 0.5, 0.75])) if coarse else lambda: r.random() * (0.5 if seed == 2 else 1.2)
    known = {}
    for _ in range(80):
        i, j = sorted(r.sample(range(n), 2))
        known[i, j] = draw()
    links = {p for p in known if r.random() < 0.6} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(15)}
    rows = [(a, b, known.get((a, b)), (a, b) in links) for a, b in {*known, *links}]
    pairs = spark.createDataFrame([(b, a, d, k) if r.random() < 0.5 else (a, b, d, k) for a, b, d, k in rows], "a long, b long, distance double, linked boolean")
    got = {x["node"]: x["home"] for x in features.average_linkage(spark.range(n).withColumnRenamed("id", "node"), pairs, 0.6, 0.4).collect()}
    assert got == _linked(n, known, links, 0.6, 0.4)


def test_average_linkage_merges_side_by_side(spark, monkeypatch):
    """A thousand separate triples take a few rounds, not a merge at a time."""
    written = []
    real = features.cut
    monkeypatch.setattr(features, "cut", lambda df, name="cut": written.append(name) or real(df, name))
    pairs = spark.createDataFrame([p for i in range(0, 3000, 3) for p in ((i, i + 1, 0.1, True), (i + 1, i + 2, 0.2, True), (i, i + 2, 0.9, True))], "a long, b long, distance double, linked boolean")
    got = features.average_linkage(spark.range(3001).withColumnRenamed("id", "node"), pairs, 0.6, 0.4)
    assert got.select("home").distinct().count() == 1001 and written.count("linkage-round") <= 4


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_clusters_at_no_distance_merge_as_one_by_one(spark, seed):
    """Intervals that meet are at 0, so partners of one head need not be at 0 of each other; some pairs are not linked."""
    r = random.Random(seed)
    n, at = 36, [random.Random(seed + 100).random() * 6 for _ in range(36)]
    known = {(i, j): 0.0 if abs(at[i] - at[j]) < 1 else r.choice([0.25, 0.5, 0.75]) for i in range(n) for j in range(i + 1, n) if abs(at[i] - at[j]) < 1 or r.random() < 0.3}
    links = {p for p in known if seed < 7 or r.random() < 0.8}
    pairs = spark.createDataFrame([(a, b, d, (a, b) in links) for (a, b), d in known.items()], "a long, b long, distance double, linked boolean")
    got = {x["node"]: x["home"] for x in features.average_linkage(spark.range(n).withColumnRenamed("id", "node"), pairs, 0.6, 0.4).collect()}
    assert got == _linked(n, known, links, 0.6, 0.4)


def test_a_crowd_at_no_distance_takes_few_rounds(spark, monkeypatch):
    """A merge a round before: 39 rounds for 40 nodes."""
    written = []
    real = features.cut
    monkeypatch.setattr(features, "cut", lambda df, name="cut": written.append(name) or real(df, name))
    pairs = spark.createDataFrame([(i, j, 0.0, True) for i in range(40) for j in range(i + 1, 40)], "a long, b long, distance double, linked boolean")
    got = features.average_linkage(spark.range(40).withColumnRenamed("id", "node"), pairs, 0.6, 0.4)
    assert {x["home"] for x in got.collect()} == {0} and written.count("linkage-round") <= 3


def test_radius_components_of_crowds_and_chains(spark, monkeypatch):
    r = np.random.default_rng(6)
    crowd = r.random((900, 3)) * 0.4
    chain = np.column_stack([5 + 0.95 * np.arange(40), np.zeros(40), np.zeros(40)])
    loose = r.random((150, 3)) * 12 + (0, 20, 0)
    p = np.concatenate([crowd, chain, loose])[r.permutation(1090)]
    df = spark.createDataFrame([("a", i, *map(float, x)) for i, x in enumerate(p)] + [("b", 0, 0.0, 0.0, 0.0), ("b", 1, float("nan"), 0.0, 0.0)], "uid string, vid long, x double, y double, z double")
    met = []
    real = clustering.radius_join
    monkeypatch.setattr(clustering, "radius_join", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    got = {(x["uid"], x["vid"]): x["component"] for x in clustering.radius_components(df, 1.0).collect()}
    near = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2)) <= 1.0
    want = _walk(len(p), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert got == {("a", i): c for i, c in want.items()} | {("b", 0): 0}
    assert all(m.count() == 0 for m in met)  # no two points of a crowd meet one by one


def test_superpoints_that_are_nowhere_far_merge_without_rounds(spark, monkeypatch):
    """All pairs of a crowd went through the rounds before. One far pair in a component sends that one there, and only it."""
    written = []
    real = features.cut
    monkeypatch.setattr(features, "cut", lambda df, name="cut": written.append((name, real(df, name))) or written[-1][1])
    r = np.random.default_rng(11)
    x = np.concatenate([r.random(60) * 0.3, 1 + r.random(60) * 0.3, 2 + 0.03 * np.arange(12), [5.0]])  # the last are a chain and one alone
    stats = spark.createDataFrame([(int(i), 0.5, float(v), 0.0, 0.0) for i, v in enumerate(x)] + [(900, 0.5, None, 0.0, 0.0)], "sp long, confidence double, x double, y double, z double")
    views = spark.createDataFrame([(i, 1, 1 if i != 70 else 2) for i in range(len(x))], "sp long, view_id int, label int")
    whole = features.superpoint_distances(stats, views.where("sp != 70"), within=0.04)
    got = {a["sp"]: a["cluster"] for a in features.agglomerate(stats, whole).collect()}
    assert [len({got[i] for i in s}) for s in (range(60), range(60, 120), range(120, 132), (0, 60, 120, 132, 900))] == [1, 1, 1, 5]
    assert not [n for n, _ in written if n in ("linkage-round", "linkage-edges")]
    far = features.superpoint_distances(stats, views, within=0.04)
    got = {a["sp"]: a["cluster"] for a in features.agglomerate(stats, far).collect()}
    edges = [df for n, df in written if n == "linkage-edges"][0]
    assert {a for e in edges.collect() for a in (e["a"], e["b"])} <= set(range(60, 120)) and len({got[i] for i in range(60)}) == 1
    known = {(d["a"], d["b"]): d["distance"] for d in far.collect()}
    want = _linked(len(x), known, set(known), 0.6, 0.4)
    assert len(set(got.values())) - 1 == len(set(want.values())) and all(got[i] == got[j] for i, j in want.items())
