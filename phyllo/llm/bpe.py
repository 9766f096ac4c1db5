"""Byte-level BPE by corpus-level merge replay.

The pre-tokens that a block of documents holds and that have not been met before
are encoded together. An inverted index leads from a token pair (by the token
that it makes) to the positions in all those pre-tokens where the pair stands;
the pairs present are applied in rank order, each to all of its positions, and
only the neighbours of a merged position enter the index anew. Documents are then
spelled with the encoded pre-tokens, of which a worker keeps a bounded number.

Ranks double as token ids, as in files of the ``.tiktoken`` form; a merge makes
the token whose bytes are the pair's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from phyllo.llm.arrow import batch, map_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker keeps encoded, the bytes of ids up to which one is kept when they become too many, and characters of text met before a block is encoded.
KEPT_PIECES = 500_000
KEPT_BYTES = 8
BLOCK_CHARS = 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; the file's size bounds what is sent to the executors."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class MergeReplay:
    """Encodes many pre-tokens at once, merge by merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.singles = self.single.tolist()
        self.made: dict[int, int] = {}
        of = np.full(65536, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                of[token[0] * 256 + token[1]] = rank
        self.first = of

    def pair(self, left: int, right: int) -> int:
        """The token that a pair makes, or -1; kept for the next time."""
        if len(self.made) > 200_000:
            self.made.clear()
        found = self.made[left * self.size + right] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return found

    def _start(self, words: list[bytes]) -> tuple:
        """Per byte of all words: its token, what it makes with the next, its neighbours, its word; the inverted index; the words' ends."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate([[0], ends[:-1]])
        n = len(data)
        makes = np.full(n, -1, np.int64)
        makes[:-1] = self.first[data[:-1] * 256 + data[1:]]
        makes[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[starts] = -1
        order = np.flatnonzero(makes >= 0)
        order = order[np.argsort(makes[order], kind="stable")]
        ranks, firsts = np.unique(makes[order], return_index=True)
        index = {r: places.tolist() for r, places in zip(ranks.tolist(), np.split(order, firsts[1:]), strict=True)} if len(order) else {}
        word_of = np.repeat(np.arange(len(words)), ends - starts)
        return self.single[data].tolist(), makes.tolist(), after.tolist(), before.tolist(), word_of.tolist(), index, ends

    def _start_few(self, words: list[bytes]) -> tuple:
        """The same for a few bytes, without arrays."""
        token, makes, after, before, word_of, index, ends = [], [], [], [], [], {}, []
        for w, word in enumerate(words):
            start, last = len(token), len(token) + len(word) - 1
            for at, byte in enumerate(word, start):
                token.append(self.singles[byte])
                new = self.ranks.get(word[at - start : at - start + 2], -1) if at < last else -1
                makes.append(new)
                if new >= 0:
                    index.setdefault(new, []).append(at)
                after.append(at + 1 if at < last else -1)
                before.append(at - 1 if at > start else -1)
                word_of.append(w)
            ends.append(last + 1)
        return token, makes, after, before, word_of, index, np.array(ends)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit token ids of each non-empty word."""
        if not words:
            return []
        token, makes, after, before, word_of, index, ends = self._start(words) if sum(map(len, words)) > 200 else self._start_few(words)
        heap, made, size = list(index), self.made, self.size
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()  # within a word, the leftmost of equal pairs merges first
            held: set[int] = set()
            left_over = []
            for at in places:
                if makes[at] != rank:
                    continue
                if held and word_of[at] in held:
                    left_over.append(at)
                    continue
                gone = after[at]
                makes[gone] = token[gone] = -1
                token[at] = rank
                behind = after[at] = after[gone]
                ahead = before[at]
                if behind >= 0:
                    before[behind] = at
                    right = token[behind]
                    new = made.get(rank * size + right)
                    if new is None:
                        new = self.pair(rank, right)
                    makes[at] = new
                    if new >= 0:
                        there = index.get(new)
                        if there is None:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                        else:
                            there.append(at)
                        if new < rank:  # this word has an earlier merge to make before it goes on
                            held.add(word_of[at])
                else:
                    makes[at] = -1
                if ahead >= 0:
                    left = token[ahead]
                    new = made.get(left * size + rank)
                    if new is None:
                        new = self.pair(left, rank)
                    makes[ahead] = new
                    if new >= 0:
                        there = index.get(new)
                        if there is None:
                            index[new] = [ahead]
                            heapq.heappush(heap, new)
                        else:
                            there.append(ahead)
                        if new < rank:
                            held.add(word_of[at])
            if left_over:
                index.setdefault(rank, []).extend(left_over)
                heapq.heappush(heap, rank)
        final = np.array(token, np.int64)
        whole = np.flatnonzero(final >= 0)
        ids = final[whole].astype("<u4").tobytes()
        edges = [0, *(4 * np.searchsorted(whole, ends)).tolist()]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Encoder:
    """Whole texts to ids, with a bounded store of encoded pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not held."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known = {p: v for p, v in self.known.items() if len(v) <= KEPT_BYTES}  # the short ones are met most
            if 2 * len(self.known) > KEPT_PIECES:
                self.known = {}
            new = [p for p in pieces if p not in self.known]
        coded = [p.encode() for p in new]
        whole = [self.replay.ranks.get(c) for c in coded]
        spelled = iter(self.replay.encode([c for c, w in zip(coded, whole, strict=True) if w is None]))
        for piece, w in zip(new, whole, strict=True):
            self.known[piece] = next(spelled) if w is None else w.to_bytes(4, "little")

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        of = self.known.__getitem__
        return [b"".join(map(of, s)) for s in split]

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        self.learn(set(pieces))
        return [len(self.known[p]) >> 2 for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, key: str) -> Encoder:
    """The worker's encoder for these ranks: kept between tasks."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[key, pattern]


def blocks(texts: list[str], chars: int = BLOCK_CHARS):
    """Runs of texts of about ``chars`` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` and digests of the ids and of the bytes decoded from them; ``ids`` (little-endian binary) on demand.

    A null or empty text has no tokens; texts are read whole, however long. Each
    row stands by itself, so nulls in other columns, repeated rows and further
    columns pass through as they are; equal texts of one batch (copies that a mix
    puts side by side) are encoded once. Columns that are already called like an
    added one are replaced; an empty table gives no rows.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in docs.columns if c != text]
    added = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] + [("ids", "binary", pa.binary())] * with_ids
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {t}" for n, t, _ in added])
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        coder = encoder(ranks.value, pattern, path)
        for b in batches:
            texts, of = [t or "" for t in b.column(0).to_pylist()], {}
            for part in blocks(list(dict.fromkeys(texts))):
                for text_, ids in zip(part, coder.encode_block(part), strict=True):
                    of[text_] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), ids)[: len(added)]
            columns = zip(*map(of.__getitem__, texts), strict=True) if texts else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, t) for c, (_, _, t) in zip(columns, added, strict=True))], names=[*kept, *(n for n, _, _ in added)])

    return map_batches(docs.select(text, *kept), run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs.select("doc_id", "text"), with_ids=False)
