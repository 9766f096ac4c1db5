"""Near copies by exact Jaccard similarity of word shingles."""

import random

from phyllo.llm import simhash


def _components(texts, similarity):
    sets = {i: {t.lower().encode().split()[n : n + 5].__repr__() for n in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def _edited(words, edits, r):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def test_moderately_edited_copies_go_and_looser_ones_stay(spark):
    r = random.Random(5)
    texts, n = {}, 0
    for _ in range(30):  # pairs from about 0.6 to 0.95
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        for words in (base, _edited(base, r.randrange(1, 8), r)):
            texts[n] = " ".join(words)
            n += 1
    crowd = [f"c{r.randrange(5000)}" for _ in range(200)]
    for _ in range(80):  # a crowd whose copies are alike to some of the others only
        texts[n] = " ".join(_edited(crowd, r.randrange(0, 5), r))
        n += 1
    want = _components(texts, 0.8)
    words = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    assert any(want[i] == want[i + 1] and (words[i] ^ words[i + 1]).bit_count() > 6 for i in range(0, 60, 2)) and any(want[i] != want[i + 1] for i in range(0, 60, 2))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_components(df).collect()} == want
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == sorted(set(want.values()))
