"""Fingerprints, vectors and the pipeline's stages against plain versions without arrays or Spark."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from phyllo.llm import imatch, mixing, quality, simhash

M = (1 << 64) - 1


def _kept(h, k):
    x = (h + 0x9E3779B97F4A7C15 * (k + 1)) & M
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & M
    x ^= x >> 31
    return x < int([1 / 32, 1 / 64, 1 / 128, 1 / 512][k // 16] * 2**64)


def _imatch(texts):
    """The fingerprint of any text by the band of terms of ``texts``."""
    terms = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    df = Counter(w for t in texts for w in terms(t))
    band = {w for w, n in df.items() if max(2, 0.0005 * len(texts)) <= n <= max(2, 0.1 * len(texts))}

    def mark(text):
        chosen = terms(text) & band or terms(text)
        hashes = sorted(xxhash.xxh64_intdigest(w, 42) for w in chosen)
        spell = lambda hs: b"".join(h.to_bytes(8, "little") for h in hs)
        out = f"{xxhash.xxh64_intdigest(spell(hashes), 42):016x}"
        for k in range(64):
            own = [h for h in hashes if _kept(h, k)]
            out += f"{xxhash.xxh32_intdigest(spell(own), 42) % 65535 + 1 if own else 0:04x}"
        return out

    return mark


def test_imatch_equals_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    mark = _imatch([t for _, t in rows])
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for i, (k, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[k]["fingerprint"] == mark(text) and got[k]["edited_fingerprint"] == mark(edited) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (re.findall("....", mark(t)[16:]) for t in (text, edited))
        told = [x == y for x, y in zip(a, b, strict=True) if x != "0000" or y != "0000"]
        assert math.isclose(got[k]["near_edited"], 1.0 if mark(text) == mark(edited) else sum(told) / len(told) if told else 0.0)


def test_fingerprints_when_known_terms_are_let_go(monkeypatch):
    monkeypatch.setattr(imatch, "KEPT_TERMS", 20)
    lexicon = np.sort(np.array([imatch._hash(f"w{i}") for i in range(300)], np.uint64))
    small = imatch.Fingerprinter(lexicon)
    texts = [" ".join(f"w{(i * 7 + j * 13) % 400}" for j in range(30)) for i in range(40)]
    first = [small(t) for t in texts]
    monkeypatch.setattr(imatch, "KEPT_TERMS", 10**6)
    whole = imatch.Fingerprinter(lexicon)
    assert first == [whole(t) for t in texts] and imatch.Fingerprinter(lexicon[:0])("a b") == imatch.Fingerprinter(lexicon)("a b")


def test_context_sums_and_pooling_equal_plain_loops():
    terms, index = quality.Terms(), quality.index_vectors()
    texts = ["one two two THREE!! four", "two four", "", "a", "one one one"]
    sequences = [terms.sequence(t) for t in texts]
    want = np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
    for seq in sequences:
        for i, here in enumerate(seq):
            for j, there in enumerate(seq):
                if i != j and abs(i - j) <= quality.REACH:
                    want[here] += index[there]
    assert (quality.context_sums(sequences, index) == want).all()
    assert (np.abs(index).sum(axis=1) == quality.NONZERO).all()
    vectors = quality.word_vectors(want, index)
    for text, seq in zip(texts, sequences, strict=True):
        mean = np.mean([vectors[b] for b in seq], axis=0) if len(seq) else np.zeros(quality.WIDTH)
        assert np.allclose(quality.pool(text, terms, vectors), mean, atol=1e-5)
    long = "word other " * 100_000
    assert np.allclose(quality.pool(long, terms, vectors), quality.pool("word other", terms, vectors), atol=1e-5) and (quality.pool(None, terms, vectors) == 0).all()


def test_the_network_equals_plain_sums():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=64), rng.random(64) + 1, rng.normal(size=(64, 32)), rng.normal(size=32), rng.normal(size=32), 0.3, 2.0)
    for x in rng.normal(size=(5, 64)):
        z = [(a - b) / c for a, b, c in zip(x, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, net.w1[:, j], strict=True)) + net.b1[j]) for j in range(32)]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + 0.3
        assert math.isclose(net.score(x[None])[0], 1 / (1 + math.exp(-logit / 2)), rel_tol=1e-9)


def test_the_temperature_lowers_the_loss_of_rows_left_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, quality.WIDTH))
    y = (x[:, 0] + rng.normal(size=2000) > 0).astype(float)
    net = quality.fit(x, y)
    fresh = rng.normal(size=(4000, quality.WIDTH))
    truth = (fresh[:, 0] + rng.normal(size=4000) > 0).astype(float)

    def loss(p):
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))

    calibrated = loss(np.clip(net.score(fresh), 1e-9, 1 - 1e-9))
    net.temperature = 1.0
    assert calibrated < loss(np.clip(net.score(fresh), 1e-9, 1 - 1e-9))


def _near_groups(texts):
    """Smallest id of each component of texts whose five-word-shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = [w.lower() for w in re.split("[\x20\x09-\x0d]+", t) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in texts}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns of clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    near = [" ".join(f"n{i}" if i != 50 * k else "x" for i in range(200)) for k in range(4)]
    rows = [(i, t, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate([None, "", " \n ", long, long, *near, "one two", "a b c d e f"])]
    rows += [rows[3], rows[5], (None, "no id", None, 5), (None, None, None, None)]
    names = "node long, word long, size int, bands string, key long, component_id long, home long, score string, predicted string, copies int, n_lines int, band string, ids string"
    values = (1, 2, 3, "b", 4, 5, 6, "s", "p", 7, 8, "x", "i")
    return spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string, source string, n_chars int, " + names).repartition(3)


def test_the_stages_keep_columns_and_odd_rows(spark, sf, odd):
    """Every row that a stage keeps has the values and types of its own columns, however they are called."""
    own = [c for c in odd.columns if c not in ("doc_id", "text", "source", "n_chars")]
    before = {tuple(r[c] for c in own) for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        rows = out.collect()
        assert rows or name == "quality classifier"
        assert {tuple(r[c] for c in own) for r in rows} <= before, name
        assert stage(spark, odd.limit(0), sf).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, sf).count() == odd.count() and last(spark, odd.limit(0), sf).count() == 0


def test_stages_keep_values_of_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    taken = docs.selectExpr("*", "7.5D AS score", "concat('mine', doc_id) AS predicted", "concat('l', doc_id) AS n_lines", "doc_id * 2 AS n_removed", "'w' AS word", "doc_id AS node", "'r' AS row", "'o' AS own")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, taken, sf)
        assert dict(out.dtypes) == dict(taken.dtypes), name
        rows = out.collect()
        assert rows and all((r["score"], r["predicted"], r["n_lines"], r["n_removed"], r["node"]) == (7.5, f"mine{r['doc_id']}", f"l{r['doc_id']}", 2 * r["doc_id"], r["doc_id"]) for r in rows), name


def test_texts_that_share_an_id_stay_apart(spark):
    apart, like = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, apart, "x"), (7, like, "x"), (7, like, "y"), (7, like + " end", "z"), (9, like, "x"), (3, "other words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = {tuple(r) for r in simhash.keep_one(docs.repartition(4)).collect()}
    assert len(got) == 3 and (7, apart, "x") in got and (3, "other words here", "x") in got and sum(t.startswith("b0") for _, t, _ in got) == 1
    for n in (1, 2, 3):
        assert {tuple(r) for r in simhash.keep_one(docs.repartition(n)).collect()} == got


def test_keep_one_of_odd_rows(odd):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    kept = [r["doc_id"] for r in simhash.keep_one(odd).select("doc_id").collect()]
    assert kept.count(None) == 2 and sorted(i for i in kept if i is not None) == sorted(set(_near_groups(texts).values()))


def test_near_dedup_and_mixing_of_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    kept = corpus_pipeline.keep_one(spark, docs, sf).toPandas()
    assert sorted(kept.doc_id) == sorted(set(_near_groups(texts).values()))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf).toPandas()
    size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])
    own, taken = Counter(), Counter()
    for r in docs.select("source", "text").collect():
        own[r["source"]] += size(r["text"] or "")
    for source, text in zip(mixed.source, mixed.text, strict=True):
        taken[source] += size(text)
    targets = {r["source"]: r["target"] for r in mixing.plan_mix(docs).plan.collect()}
    most = max(map(size, texts.values()))
    assert all(abs(taken[s] - targets[s]) <= most and taken[s] <= 2 * own[s] for s in own)
    assert pd.Series(mixed.doc_id).value_counts().max() <= 2


@pytest.mark.parametrize("most", [8, 30])
def test_crowded_shards_are_split_without_losing_links(spark, most):
    import random

    r = random.Random(most)
    centres = [r.getrandbits(64) for _ in range(3)]
    words = set()
    for c in centres:
        for _ in range(150):
            w = c
            for _ in range(r.randint(0, 6)):
                w ^= 1 << r.randrange(64)
            words.add(w)
    words = list(words)
    up = {w: w for w in words}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    def join(a, b):
        x, y = sorted((top(a), top(b)))
        up[y] = x

    df = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "word long").repartition(3)
    links = [(x["src"] & M, x["dst"] & M) for x in simhash.near_links(df, 4, 5, most).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    for a, b in links:
        join(a, b)
    ours = {w: top(w) for w in words}
    up.update({w: w for w in words})
    for i, a in enumerate(words):
        for b in words[:i]:
            if (a ^ b).bit_count() <= 4:
                join(a, b)
    assert ours == {w: top(w) for w in words}


def test_blocks_of_crowds_lose_no_link():
    import random

    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(120)] = f"x{r.randrange(999)}"
        texts.append(" ".join(words))
    sets = list({s.tobytes(): s for s in (simhash.shingle_set(t.encode(), 5) for t in texts)}.values())
    words = [simhash.majority(s) for s in sets]
    bands = np.array([simhash.band_keys(s) for s in sets])
    band = int(pd.Series(bands[:, 0]).value_counts().index[0])
    mine = [i for i in range(len(sets)) if bands[i, 0] == band]
    half = len(mine) // 2
    block = lambda part: ([*part], [*part], [words[i] for i in part], bands[part], [sets[i] for i in part])
    links = simhash.block_links(band, block(mine[:half]), block(mine[half:]), 0.8, simhash.reach(0.8))
    up = {i: i for i in mine}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        assert simhash.alike(sets[a], sets[b], 0.8)
        up[max(top(a), top(b))] = min(top(a), top(b))
    for i in mine[:half]:
        for j in mine[half:]:
            assert top(i) == top(j) or not simhash.alike(sets[i], sets[j], 0.8)


def test_bk_tree_searches_equal_scans():
    import random

    r = random.Random(2)
    words = list({r.getrandbits(64) & r.getrandbits(64) for _ in range(300)})
    tree = simhash.BKTree()
    assert tree.near(5, 64) == [] and tree.nearest(5, 64) is None
    for w in words:
        tree.put(w)
    for w in [*words[:40], *(r.getrandbits(64) for _ in range(40))]:
        for radius in (0, 3, 20, 27):
            assert sorted(tree.near(w, radius)) == sorted(x for x in words if (x ^ w).bit_count() <= radius)
            found, least = tree.nearest(w, radius), min((x ^ w).bit_count() for x in words)
            assert (found is None) == (least > radius) and (found is None or (found ^ w).bit_count() == least)
