"""Repeated passages against plain versions."""

import random
import re

import numpy as np
import pytest

from phyllo.llm import repeats


def plain(rows, length):
    """Per row (words kept, words removed); rows are (doc_id, text), null ids last and one document."""
    words = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    place = [(i is None, i or 0) for i, _ in rows]
    first = {}
    for p, ws in zip(place, words, strict=True):
        for k in range(len(ws) - length + 1):
            seq = tuple(ws[k : k + length])
            first[seq] = min(first.get(seq, (p, k)), (p, k))
    out = []
    for p, ws in zip(place, words, strict=True):
        gone = set()
        for k in range(len(ws) - length + 1):
            if first[tuple(ws[k : k + length])] < (p, k):
                gone |= set(range(k, k + length))
        out.append((" ".join(w for k, w in enumerate(ws) if k not in gone), len(gone)))
    return out


SCHEMA = "doc_id long, text string, n int"


def compared(spark, rows, length=20, **how):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA).repartition(4)
    got = {r["n"]: (r["text"], r["n_removed"], r["n_words"], r["removed"]) for r in repeats.remove_repeats(df, length, **how).collect()}
    assert len(got) == len(rows)
    for n, (kept, gone) in enumerate(plain(rows, length)):
        assert got[n][:2] == (kept, gone), (n, rows[n][0])
        assert got[n][2] == len(kept.encode().split()) + gone and sum(s["stop"] - s["start"] for s in got[n][3]) == gone


def _texts(seed, n=60):
    r = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(r.randint(15, 70))] for k in range(6)]
    rows = []
    for i in range(n):
        words = [f"u{i}x{j}" for j in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            at = r.randint(0, len(words))
            words[at:at] = p
        rows.append((i * 3 % n, r.choice((" ", "\n", " \t ")).join(words)))
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_words": 200}, {"crowd": 1, "shard_words": 300}])
def test_repeats_equal_a_plain_version(spark, how):
    rows = _texts(1)
    rows += [(500 + i, rows[4][1]) for i in range(30)]
    rows += [(600, "a b " * 200), (601, "same " * 400), (602, "a b " * 60), (603, None), (604, ""), (605, " \n "), (606, "é ü " * 30 + "é x " * 30)]
    compared(spark, rows, **how)


def test_repeats_of_small_alphabets(spark):
    r = random.Random(2)
    compared(spark, [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(80)], 10, gram=3, shard_words=500)


def test_repeats_of_odd_rows(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), "lead in " + " ".join(f"w{i}" for i in range(10, 40))
    rows = [(None, text), (None, other), (7, text), (7, text), (7, other), (7, other), (9, other), (-(2**63), text + " end"), (2**63 - 2, text)]
    compared(spark, rows)
    compared(spark, [(None, text), (None, other), (5, "x " + other)])
    long = " ".join(f"z{i % 25_013}" for i in range(200_000))
    compared(spark, [(1, long), (0, text), (2, long)])
    clash = spark.createDataFrame([(1, text, 2, "r", 3, 4.5), (2, text, 3, "s", 4, 5.5)], "doc_id long, text string, key int, row string, n_words int, _1 double")
    out = repeats.remove_repeats(clash)
    assert out.columns == ["doc_id", "text", "key", "row", "_1", "n_words", "n_removed", "removed"]
    assert sorted(tuple(r)[:7] for r in out.collect()) == [(1, text, 2, "r", 4.5, 40, 0), (2, "", 3, "s", 5.5, 40, 40)]
    assert repeats.remove_repeats(clash.limit(0)).count() == 0


def test_ranks_and_matching_statistics():
    r = random.Random(1)
    for _ in range(60):
        depth, k = r.choice([2, 3, 5]), r.choice([2, 3, 6])
        pieces = [np.array([r.randint(1, k) for _ in range(r.randint(depth, 12))]) for _ in range(r.randint(1, 6))]
        text = np.concatenate([np.append(p, 0) for p in pieces])
        tree = repeats.Wavelets(text, k + 1)
        for i in range(len(text) + 1):
            assert tree.rank(np.arange(k + 1), np.full(k + 1, i)).tolist() == [(text[:i] == c).sum() for c in range(k + 1)]
        index = repeats.FMIndex(text, k + 1, depth)
        asked = [*pieces, np.array([r.choice([-1, *range(1, k + 1)]) for _ in range(9)])]
        for p, (length, earliest) in zip(asked, index.matches(asked), strict=True):
            for i in range(len(p)):
                found = {m: [j for j in range(len(text) - m + 1) if (text[j : j + m] == p[i : i + m]).all()] for m in range(1, min(depth, len(p) - i) + 1)}
                best = max((m for m, hits in found.items() if hits), default=0)
                assert length[i] == best and earliest[i] == (min(found[best]) if best == depth else -1)
    none = repeats.FMIndex(np.zeros(0, np.int64), 1, 4)
    assert none.matches([np.array([-1, -1])])[0][0].tolist() == [0, 0]
