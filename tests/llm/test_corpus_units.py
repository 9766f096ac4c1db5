"""The operators' parts, without Spark, against brute force."""

import random

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from phyllo.llm import bpe, imatch, pii, quality, quality_rules, simhash, token_tree, warc

MIXED = "abcdefgh ei\n\t 12٣Ⅷ²'stré漢字🙂  \x1c\x85aaaaaaaa..!!--  ́"


def texts(n, seed, alphabet=MIXED, most=80):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load_ranks(P.path(bpe.RANKS)))


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})


def test_merge_replay_equals_the_library(coder, theirs):
    cases = texts(3000, 1) + ["", "a" * 5000, "ab" * 2000, " " * 300, "the" * 400, "<|endoftext|>", "\n\n\n x", "x\r\n\r\n  y's'LL"]
    got = coder.encode_block(cases)
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == theirs.encode_ordinary_batch(cases)
    assert [coder.decode(i) for i in got] == [c.encode() for c in cases]


def test_merge_replay_when_a_merge_makes_a_pair_of_lower_rank():
    base = {bytes([b]): b for b in range(256)}
    r = random.Random(5)
    for _ in range(60):
        tokens = set()
        while len(tokens) < 25:
            tokens.add(bytes(r.choice(b"abc") for _ in range(r.randint(2, 4))))
        order = sorted(tokens)
        r.shuffle(order)
        ranks = base | {t: 256 + i for i, t in enumerate(order)}
        encoding = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(40)]
        assert [np.frombuffer(i, "<u4").tolist() for i in bpe.MergeReplay(ranks).encode([w.encode() for w in words])] == [_plain(w.encode(), ranks) for w in words]
        assert [np.frombuffer(i, "<u4").tolist() for i in bpe.Encoder(ranks, r"\S+|\s+").encode_block(words)] == [encoding.encode_ordinary(w) for w in words]


def _plain(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_known_pieces_stay_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    small = bpe.Encoder(coder.replay.ranks)
    cases = texts(200, 9)
    assert small.encode_block(cases[:100]) + small.encode_block(cases[100:]) == coder.encode_block(cases)


def test_token_tree_under_edits(coder, theirs):
    r = random.Random(3)
    for text in texts(120, 4, "ab 's  \n\n\tX9é漢..'t\x85", 600) + ["", "word " * 2000]:
        tree = token_tree.TokenTree(text, coder)
        assert tree.count == len(theirs.encode_ordinary(text))
        for _ in range(8):
            at = r.randint(0, len(text) + 3)
            until = at + r.choice([0, 0, 1, 3, 60])
            new = "".join(r.choice("ab \n'sX9") for _ in range(r.choice([0, 1, 5, 300])))
            a = min(at, len(text))
            text = text[:a] + new + text[max(min(until, len(text)), a) :]
            assert tree.edit(at, until, new) == len(theirs.encode_ordinary(text)) and tree.text == text


def test_token_tree_recounts_little(coder):
    tree = token_tree.TokenTree("some words of a long text. " * 3000, coder)
    tree.edit(40_000, 40_002, "xy")
    assert tree.recounted < 10


def _simhash(text, k):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force():
    for text in texts(300, 6, "aB É\n\tc\x85\xa0d", 60) + ["", " \n", "one", "one two three four five"]:
        for k in (4, 5):
            assert simhash.fingerprint(text.encode(), k) == _simhash(text, k)
    assert simhash.fingerprint(None) == 0


def test_bk_tree_links_give_all_components():
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(20)]
    words = list({s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) for s in seeds for _ in range(15)})
    words = [w & (1 << 64) - 1 for w in words]
    links = simhash.shard_links(words, 4)
    up = {w: w for w in words}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    for i, a in enumerate(words):
        for b in words[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert dict(links) == {w: top(w) for w in words if top(w) != w}


def test_imatch():
    lexicon = np.sort(np.array([imatch._hash(f"w{i}") for i in range(500)], np.uint64))
    mark = imatch.Fingerprinter(lexicon)
    r = random.Random(2)
    words = [f"w{r.randrange(500)}" for _ in range(200)]
    whole, near, other = " ".join(words), " ".join(words[:195] + ["w1"]), " ".join(f"w{r.randrange(500)}" for _ in range(200))
    assert mark(whole) == mark(whole.upper()) == mark(" ".join(sorted(words))) == mark(whole + " unheard of")
    assert imatch.likeness(mark(whole), mark(whole)) == 1
    assert imatch.likeness(mark(whole), mark(near)) > imatch.likeness(mark(whole), mark(other))
    assert mark("") != mark("x") != mark("y") and len(mark("")) == 16 + 4 * imatch.SUBSETS
    assert 0 <= imatch.likeness(mark(""), mark(whole)) <= 1


def test_base_counts_equal_brute_force():
    for text in texts(400, 7, "ab #$\n\né", 60):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        places = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        lines = text.split("\n")
        dup = sum(1 for i, line in enumerate(lines) if line in lines[:i] and line.strip(" \t\x0b\x0c\r\n"))
        assert quality_rules.base_counts(text.encode()) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(places))


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for bound in (1, 2, 3, 10, 97, 1000):
        assert sorted(f(i, bound, b"t") for i in range(bound)) == list(range(bound))
    assert [f(i, 1000, b"t") for i in range(20)] != [f(i, 1000, b"u") for i in range(20)]


def test_pseudonyms():
    s = pii.Pseudonyms(b"tests")
    text = "a.1@b.example, +1 (017) 555-7713 4111 1111 1111 1111 4111111111111111 192.168.0.1 123-45-6789 GB82 WEST 1234 5698 7654 32 2024-02-29 29/02/2024"
    new, counts = s.replace(text)
    assert counts == {"email": 1, "phone": 1, "card": 2, "ip": 1, "ssn": 1, "iban": 1, "date": 2}
    assert [c if not c.isalnum() else "x" for c in new.split("192")[0][:40]] == [c if not c.isalnum() else "x" for c in text[:40]]
    again, counts_again = s.replace(new)
    assert counts_again == counts and again != new
    spaced, plain = __import__("re").findall(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", new)[0]
    assert spaced.replace(" ", "") == plain and pii.luhn_digit(plain[:-1]) == int(plain[-1])
    for clean in ("9859476043669043", "version 3. 4.0", "999.1.1.1", "000-12-3456", "30/02/2024", "no numbers", "", "1234567", "x4111111111111111"):
        assert s.replace(clean) == (clean, {})
    assert pii.Pseudonyms(b"other").replace(text)[0] != new


def _archive(n, compress=True):
    return [warc.page_record(i, f"http://x/{i}", f"payload {i} ".encode() * 50, None if i % 3 else i + 1, compress) for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = _archive(12, compress)
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert [f.reason for f in found] == [None] * 12 and found[1].block.endswith(b"payload 1 " * 50)
    assert b"".join(whole[f.offset : f.offset + f.length] for f in found) == whole
    r = random.Random(1)
    for _ in range(60):
        data = bytearray(whole)
        hit = r.randrange(12)
        start = sum(map(len, parts[:hit]))
        kind = r.randrange(3)
        if kind == 0:
            at = start + r.randrange(len(parts[hit]))
            data[at] ^= 1 << r.randrange(8)
        elif kind == 1:
            del data[start + 5 : start + len(parts[hit]) - 5]
        else:
            data[start:start] = bytes(r.randrange(256) for _ in range(50))
        found = list(warc.salvage(bytes(data)))
        ids = [f.headers["warc-record-id"] for f in found if f.reason is None]
        missing = {f"<urn:x-page:{i}>" for i in range(12)} - set(ids)
        assert missing <= {f"<urn:x-page:{hit}>"} and len(ids) == len(set(ids))
        at = 0
        for f in found:  # records and gaps cover the file
            assert f.offset == at
            at += f.length
        assert at == len(data)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"rubbish"))[0].length == 7
    assert [f.reason is None for f in warc.salvage(whole[:-3])][-1] is False


def test_quality_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality.WIDTH))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(float)
    net = quality.fit(x, y)
    fresh = rng.normal(size=(400, quality.WIDTH))
    assert ((net.score(fresh) >= 0.5) == (fresh[:, 0] > 0)).mean() > 0.8 and net.temperature > 0
    assert np.allclose(quality.fit(x[:0], y[:0]).score(fresh), 0.5)
    assert (quality.fit(x, np.ones(600)).score(fresh) > 0.9).all()


def test_terms():
    assert quality.terms_of("HASHWH!!") == ["hashwh", "\x01caps", "\x01tail !"]
    assert quality.terms_of("the,") == ["the"] and quality.terms_of("|") == ["\x01tail |"]
    t = quality.Terms()
    assert len(t.sequence("Der Der x")) == 4 and t.counts("Der Der x")[1].sum() == 4
    assert pd.Series(quality.index_vectors().astype(int).sum(axis=1)).eq(0).all()
