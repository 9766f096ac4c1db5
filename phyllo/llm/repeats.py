"""Removal of word passages that stand earlier in the corpus, by FM-indexes over content-defined shards.

A window is ``LENGTH`` consecutive words of a document. What is cut is every word
of a window whose words also start earlier: in a document of smaller id, or
before it in the same one.

Windows meet by content. Of the ``GRAM``-word sequences in a window the one with
the smallest hash is its anchor; equal windows have equal anchors, and windows
that follow one another mostly share theirs, so a document falls into segments,
runs of windows with one anchor. Anchors that occur once need no search. Segments
of equal words are searched once, for their earliest place; all their others are
repeats as a whole.

A shard holds the distinct segments of some anchors. Its index is compressed: the
words are numbered within the shard, the Burrows-Wheeler transform is kept as
packed bits of a wavelet tree, level by level. Segments stream through it from
their last word to the first: a backward search goes on one word at a time, and
where it fails, the match is cut at its far end to the nearest length that has
more continuations (matching statistics). Where the match is as long as a window,
its interval names the earliest place of all that begin so; windows whose
earliest place isn't their own are reported as intervals.

Shards have a bounded number of words however large the corpus; an anchor with
very many distinct segments is dealt to several by the hash of whole windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches
from phyllo.session import cut

#: Words of a window and of the sequences that anchors are chosen from.
LENGTH, GRAM = 20, 8
#: Windows of a segment, words of a shard, and segments of an anchor that go to one shard.
MOST_WINDOWS, SHARD_WORDS, CROWD = 64, 1 << 19, 1 << 12
KEPT_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M = (1 << 64) - 1


class _Hashes(dict):
    """Words to 64-bit hashes, with a bounded store."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any run of a word sequence, from one pass over it."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.ones(n + 1, np.uint64)
        inverse = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _BASE, np.uint64), out=powers[1:])
        np.cumprod(np.full(n, _INVERSE, np.uint64), out=inverse[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])
        self.inverse = inverse

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchored(rolling: Rolling, n_words: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the segments of a sequence: runs of windows whose least hash of a ``gram`` is the same."""
    n = n_words - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n_words - gram + 1)
    least, span, wide = rolling.of(at, at + gram), 1, length - gram + 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    begins = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    sizes = np.diff(np.append(begins, n))
    if sizes.max() > MOST_WINDOWS:
        pieces = -(-sizes // MOST_WINDOWS)
        before = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(begins + sizes, pieces)
        begins = np.repeat(begins, pieces) + before * MOST_WINDOWS
        sizes = np.minimum(ends - begins, MOST_WINDOWS)
    return begins, sizes, least[begins]


def repeating(rolling: Rolling, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether a segment holds a window twice by itself."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) + (starts[0] if len(starts) else 0)  # segments lie side by side
    windows = rolling.of(at, at + length)
    by = np.lexsort((windows, of))
    twice = (windows[by][1:] == windows[by][:-1]) & (of[by][1:] == of[by][:-1])
    out = np.zeros(len(sizes), bool)
    out[of[by][1:][twice]] = True
    return out


class Wavelets:
    """Ranks of symbols in a sequence: a wavelet tree whose levels are packed bits with counts before every 64."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        row = symbols.astype(np.int64)
        for level in reversed(range(self.depth)):
            bit = (row >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1])
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.starts = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.depth):
            ones = self.counts[i][at >> 6] + np.bitwise_count(self.bits[i][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            one = (symbols >> (self.depth - 1 - i)) & 1
            at = np.where(one == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place."""
        return self._walk(symbols, at) - self.starts[symbols]


class FMIndex:
    """An index over a sequence of symbols from 1 on, in which 0 parts its pieces; suffixes are sorted by their first ``depth`` symbols.

    That is enough for matches of up to ``depth`` symbols, since backward search
    for them never looks farther. ``order`` says of every place how early it is;
    a match knows the least of the places that begin with it.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int, depth: int, order: np.ndarray | None = None):
        n = len(symbols)
        rank, known = symbols.astype(np.int64), 1
        while known < depth:
            step = min(known, depth - known)
            after = np.append(rank[step:], np.zeros(step, np.int64))[:n] if step < n else np.zeros(n, np.int64)
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after + 1, return_inverse=True)[1].astype(np.int64) + 1
            known += step
        self.places = np.argsort(rank, kind="stable")
        self.n, self.depth = n, depth
        self.wavelets = Wavelets(symbols[self.places - 1] if n else symbols, n_symbols)
        self.before = np.append(0, np.cumsum(np.bincount(symbols, minlength=n_symbols)))[:n_symbols]
        self.common = np.full(n, depth, np.int64)  # symbols that a suffix shares with the one before it
        padded = np.append(symbols, np.zeros(depth, symbols.dtype))
        alike = np.ones(n, bool)
        for i in range(depth):
            column = padded[self.places + i]
            alike[1:] &= column[1:] == column[:-1]
            self.common[1:] = np.where(alike[1:], self.common[1:], np.minimum(self.common[1:], i))
        self.common[:1] = -1
        self.edges: dict[int, np.ndarray] = {}
        order = np.arange(n) if order is None else order
        self.least = np.minimum.reduceat(order[self.places], self._edges(depth)) if n else order

    def _edges(self, size: int) -> np.ndarray:
        """Where suffixes begin that differ from the one before them within ``size`` symbols."""
        if size not in self.edges:
            self.edges[size] = np.flatnonzero(self.common < size)
        return self.edges[size]

    def _widened(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``sizes`` symbols of matches."""
        low, high = low.copy(), high.copy()
        for size in np.unique(sizes).tolist():
            at, edges = np.flatnonzero(sizes == size), self._edges(size)
            if size == 0:
                low[at], high[at] = 0, self.n
                continue
            low[at] = edges[np.searchsorted(edges, low[at], "right") - 1]
            high[at] = np.append(edges, self.n)[np.searchsorted(edges, high[at], "left")]
        return low, high

    def matches(self, pieces: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every piece (length, earliest): how many symbols from each place on match somewhere, ``depth`` at most, and the least order of a match of that length (else -1).

        All pieces go through the index side by side, last symbols first. Symbols
        out of the index are -1.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([np.zeros(0, np.int64), *[p.astype(np.int64) for p in pieces]])
        ends = np.cumsum(sizes)
        length, earliest = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        low, high, size = np.zeros(len(pieces), np.int64), np.full(len(pieces), self.n, np.int64), np.zeros(len(pieces), np.int64)
        for back in range(int(sizes.max(initial=0))):
            now = by_size[: int((sizes > back).sum())]
            at = ends[now] - 1 - back
            symbol = flat[at]
            lo, hi, m = low[now], high[now], size[now]
            full = np.flatnonzero(m == self.depth)
            if len(full):
                m[full] = self.depth - 1
                lo[full], hi[full] = self._widened(lo[full], hi[full], m[full])
            gone = symbol < 1
            lo[gone], hi[gone], m[gone] = 0, self.n, 0
            todo = np.flatnonzero(~gone)
            while len(todo):
                c = symbol[todo]
                both = self.wavelets.rank(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                a, b = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
                good = a < b
                hit = todo[good]
                lo[hit], hi[hit], m[hit] = a[good], b[good], m[hit] + 1
                todo = todo[~good]
                todo = todo[m[todo] > 0]
                if len(todo):
                    edge = np.append(self.common, -1)
                    m[todo] = np.maximum(0, np.maximum(edge[lo[todo]], edge[hi[todo]]))
                    lo[todo], hi[todo] = self._widened(lo[todo], hi[todo], m[todo])
            low[now], high[now], size[now] = lo, hi, m
            length[at] = m
            whole = m == self.depth
            earliest[at[whole]] = self.least[np.searchsorted(self._edges(self.depth), lo[whole], "right") - 1]
        return [(length[e - s : e], earliest[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def shard_repeats(docs: list[int], starts: list[int], windows: list[int], words: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, first window, windows) of what stands earlier, for the segments of one shard: their words joined by spaces, from a place of a document."""
    number: dict[bytes, int] = {}
    pieces = [np.fromiter((number.setdefault(w, len(number) + 1) for w in text.split(b" ")), np.int64, n + length - 1) for text, n in zip(words, windows, strict=True)]
    sizes = np.array(windows, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    doc, place = np.array(docs, np.int64)[of], np.array(starts, np.int64)[of] + inside
    by = np.lexsort((place, doc))
    fresh = np.append(False, (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1]))
    own = np.empty(len(of), np.int64)
    own[by] = np.cumsum(fresh)  # equal places of equal ids are equally early
    whole = sizes + length  # words, and the gap after them
    begins = np.cumsum(whole) - whole
    symbols = np.zeros(int(whole.sum()), np.int64)
    order = np.full(len(symbols), len(of), np.int64)
    for b, piece in zip(begins.tolist(), pieces, strict=True):
        symbols[b : b + len(piece)] = piece
    order[begins[of] + inside] = own
    index = FMIndex(symbols, len(number) + 1, length, order)
    out, done = [], 0
    for i, (_, earliest) in enumerate(index.matches(pieces)):
        n = windows[i]
        for first, many in zip(*_spans(earliest[:n] < own[done : done + n]), strict=True):
            out.append((i, int(first), int(many)))
        done += n
    return out


def _segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(anchor, content, doc, key, start, windows, inner)`` of all segments of ``(doc, key, text)``; content: the hash of its words, inner: whether it repeats a window itself."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            columns = [[np.zeros(0, t)] for t in [*[np.int64] * 6, bool]]
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else ()
                if len(words) < length:
                    continue
                rolling = Rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                starts, sizes, anchors = anchored(rolling, len(words), length, gram)
                content = rolling.of(starts, starts + sizes + length - 1)
                for held, values in zip(columns, (anchors.view(np.int64), content.view(np.int64), np.full(len(starts), doc), np.full(len(starts), key), starts, sizes, repeating(rolling, starts, sizes, length)), strict=True):
                    held.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_()], strict=True)], names=["anchor", "content", "doc", "key", "start", "windows", "inner"])

    return map_batches(rows, run, "anchor long, content long, doc long, key long, start int, windows int, inner boolean")


def _met(segments: DataFrame) -> DataFrame:
    """The ``segments`` whose anchor occurs again or that repeat a window themselves, without equal rows, plus ``first``: whether a place is the earliest of its content."""

    def run(batches):
        names = ["anchor", "content", "doc", "start", "key", "windows", "inner", "first"]
        held = None  # the last row, whether it shares its anchor and equals the row before it, and the earliest place of its content

        def out(columns, rows):
            return pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in columns], names=names)

        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held:
                columns = [np.append(h, c) for h, c in zip(held[0], columns, strict=True)]
            if not len(columns[0]):
                continue
            anchor, content, doc, start, key, _, inner = columns
            near = np.append(held[1] if held else False, anchor[1:] == anchor[:-1])
            same = near & np.append(True, content[1:] == content[:-1])
            begin = np.maximum.accumulate(np.where(np.append(False, same[1:]), 0, np.arange(len(anchor))))
            doc0, start0 = doc[begin], start[begin]
            if held:
                doc0[begin == 0], start0[begin == 0] = held[3]
            again = same & np.append(True, (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (key[1:] == key[:-1]))
            again[0] = held[2] if held else False
            shared = near | np.append(near[1:], False) | inner
            full = [*columns, (doc == doc0) & (start == start0)]
            yield out(full, np.flatnonzero((shared & ~again)[:-1]))
            held = [c[-1:] for c in columns], bool(near[-1]), bool(again[-1]), (doc0[-1], start0[-1])
        if held and (held[1] or held[0][6][0]) and not held[2]:
            yield out([*held[0], (held[0][2] == held[3][0]) & (held[0][3] == held[3][1])], np.arange(1))

    order = ["anchor", "content", "doc", "start", "key", "windows"]
    dealt = segments.select(*order, "inner").repartition("anchor").sortWithinPartitions(*order)
    return map_batches(dealt, run, "anchor long, content long, doc long, start int, key long, windows int, inner boolean, first boolean")


def _dealt(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """``(shard, doc, key, start, windows, words)`` of the segments ``todo`` of each row of ``docs``; those of crowded anchors (``parts`` above 1) by the hash of each window."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            rows = []
            for doc, key, text, todo in zip(*(b.column(c).to_pylist() for c in ("doc", "key", "text", "todo")), strict=True):
                if not todo:
                    continue
                words, rolling = text.encode().split(), None
                for s in todo:
                    begin, n, parts = s["start"], s["windows"], s["parts"]
                    anchor = s["anchor"] & _M
                    if parts > 1:
                        rolling = rolling or Rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                        at = np.arange(begin, begin + n)
                        part = (rolling.of(at, at + length) % np.uint64(parts)).astype(np.int64)
                        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        runs = zip((at[edges]).tolist(), np.diff(np.append(edges, n)).tolist(), part[edges].tolist(), strict=True)
                    else:
                        runs = ((begin, n, 0),)
                    rows += [(xxhash.xxh64_intdigest(b"%d %d" % (anchor, p)) % shards, doc, key, a, m, b" ".join(words[a : a + m + length - 1])) for a, m, p in runs]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "doc", "key", "start", "windows", "words"])

    return map_batches(docs, run, "shard long, doc long, key long, start int, windows int, words binary")


def _searched(dealt: DataFrame, length: int) -> DataFrame:
    """``(doc, key, start, windows)``: intervals of windows that stand earlier in their shard."""

    def run(batches):
        def found(rows):
            docs, keys, starts, windows, words = (list(c) for c in zip(*rows, strict=True))
            hits = shard_repeats(docs, starts, windows, words, length)
            columns = [[docs[i] for i, _, _ in hits], [keys[i] for i, _, _ in hits], [starts[i] + a for i, a, _ in hits], [m for _, _, m in hits]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["doc", "key", "start", "windows"])

        held, shard = [], None
        for b in batches:
            for at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != shard and held:
                    yield found(held)
                    held = []
                shard = at
                held.append(row)
        if held:
            yield found(held)

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "doc", "start", "key")
    return map_batches(ordered, run, "doc long, key long, start int, windows int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id", shard_words: int = SHARD_WORDS, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``text`` cut to its kept words, joined by single spaces, plus ``n_words``, ``n_removed`` and ``removed``, the spans cut: (start, stop) in words.

    Words are runs of characters other than \\x20 and \\x09-\\x0D, taken as they
    are. A null text has none and becomes empty, as does one whose words all go;
    one of fewer than ``length`` words stays. Rows without an id come after all
    others and count as one document, as do rows that share an id: of their equal
    windows those of the earliest start stay, of the same start all. So repeated
    rows are alike. Texts are read whole, however long. All columns stay, whatever
    their names, but for those called like an added one, which are replaced. An
    empty table gives no rows.

    Places of windows are exact; their words are compared by 64-bit hashes only to
    find anchors and equal segments, and by the words themselves in the shards.
    """
    docs = docs.drop("n_words", "n_removed", "removed")
    names = [f"_{i}" for i in range(len(docs.columns))]
    row = F.struct(*[(F.lit(None).cast("string") if c == text else F.col(f"`{c}`")).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    ids = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    rows = docs.select(ids, F.xxhash64(f"`{text}`").alias("key"), F.col(f"`{text}`").alias("text"), row.alias("row"))
    met = cut(_met(_segments(rows.select("doc", "key", "text"), length, gram)), "repeats-met")
    first = met.where("first")
    crowds = first.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("parts"))
    first = first.join(crowds, "anchor").select("doc", "key", F.struct("start", "windows", "anchor", "parts").alias("segment"))
    words = met.where("first").agg(F.sum(F.col("windows") + F.lit(length - 1))).first()[0] or 0
    lists = first.groupBy("doc", "key").agg(F.collect_list("segment").alias("todo"))  # the segments of one document
    dealt = _dealt(rows.join(lists, ["doc", "key"], "left"), length, -(-words // shard_words) or 1)
    spans = _searched(dealt, length).unionByName(met.where("NOT first").select("doc", "key", "start", "windows"))
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    joined = rows.join(spans, ["doc", "key"], "left").select("text", "spans", "row")

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text_, spans_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words_ = (text_ or "").encode().split()
                gone = np.zeros(len(words_) + 1, np.int64)
                for s in spans_ or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["windows"] + length - 1] -= 1
                marks = np.cumsum(gone)[:-1] > 0
                starts, sizes = _spans(marks)
                values = [b" ".join([w for w, g in zip(words_, marks.tolist(), strict=True) if not g]).decode(), len(words_), int(marks.sum()), [{"start": s, "stop": s + n} for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]]
                for held, v in zip(out, values, strict=True):
                    held.append(v)
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, types, strict=True)], b.column(2)], names=["kept", "n_words", "n_removed", "removed", "row"])

    made = map_batches(joined, run, f"kept string, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, row {rows.schema['row'].dataType.simpleString()}")
    return made.select(*[(F.col("kept") if c == text else F.col(f"row.{n}")).alias(c) for c, n in zip(docs.columns, names, strict=True)], "n_words", "n_removed", "removed")


def op13_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them stand earlier, and the digest of the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d
), s AS (
  SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + {LENGTH - 1} <= len(words) THEN array_to_string(words[pos : pos + {LENGTH - 1}], ' ') END AS seq FROM w
), r AS (
  SELECT doc_id, pos, word, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1 AS repeated FROM s
), k AS (
  SELECT doc_id, pos, word, max(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM r
), g AS (
  SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
