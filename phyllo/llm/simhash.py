"""SimHash near-duplicate components, found with sharded BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's
word shingles. Two fingerprints link when at most ``radius`` bits differ.

Links are searched within shards. If two 64-bit words differ in at most r bits
and are cut into b > r blocks, at least b - r blocks agree; so a fingerprint is
dealt to one shard for every choice of b - r blocks, keyed by the value of those
blocks, and every linked pair meets in at least one shard. In each shard the
fingerprints are put one by one into a BK-tree, whose children are keyed by
their Hamming distance to the parent, and a search follows only the edges whose
key lies within the radius of the distance at hand. The trees are built in the
task that holds their shard instead of being broadcast: all trees together grow
with the corpus, and so have no size bound that a broadcast would need.

A task emits one link from each fingerprint to the smallest fingerprint of its
component in the shard, never all pairs; the components of those links are found
by joins. Only distinct fingerprints take part, so thousands of copies count as
one. A shard with more words than a tree may hold is dealt to several trees by a
salt; the words of such shards whose components still differ are then searched
for in the trees of each other's blocks.

``similar_components`` links by the Jaccard similarity of the shingle sets. Its
trees are searched within a radius of some twenty bits, for which no choice of
blocks is selective; so its shards are keyed by bands of minima of the sets
instead, and what the trees find is checked on the sets.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import batch, map_batches
from phyllo.operators.components import connected_components
from phyllo.session import cut

SEED = 42
#: Fingerprints that a shard holds on average before the blocks are cut finer.
SHARD_ROWS = 64
#: Bands of minima of a shingle set, and minima in a band: a pair of Jaccard j shares a band with probability 1 - (1 - j**BAND_ROWS)**BANDS.
BANDS, BAND_ROWS = 24, 4
#: Words that one tree of a shard holds; a shard with more is dealt to several trees, of which pairs are then searched by blocks of so many words.
TREE_WORDS, BLOCK_WORDS = 1 << 16, 1 << 12
#: Members of a band's shard that one tree holds, and members and bytes of a block that is checked against another one.
TREE_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1024, 128, 4 << 20
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), np.uint32)
_FACTORS, _SHIFTS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, A-Z lower-cased; fewer words than a shingle: of the whole sequence."""
    found = text.lower().split()  # on bytes: A-Z only, and the separators \\x20 \\x09-\\x0D
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half the hashes; of none: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The SimHash of a text; a null or wordless text has 0."""
    return majority(shingle_hashes(text or b"", words))


class BKTree:
    """Distinct 64-bit words under Hamming distance: children are keyed by their integer distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def put(self, word: int) -> None:
        node = [word, {}]
        if self.root is None:
            self.root = node
            return
        home = self.root
        while True:
            apart = (home[0] ^ word).bit_count()
            if apart not in home[1]:
                home[1][apart] = node
                return
            home = home[1][apart]

    def near(self, word: int, radius: int) -> list[int]:
        """The words at most ``radius`` bits away; only edges whose key the radius reaches are followed."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            held, children = open_nodes.pop()
            apart = (held ^ word).bit_count()
            if apart <= radius:
                found.append(held)
            low, high = apart - radius, apart + radius
            open_nodes += [child for key, child in children.items() if low <= key <= high]
        return found

    def nearest(self, word: int, radius: int) -> int | None:
        """A word of the least distance within ``radius``, which shrinks with what is found."""
        found, open_nodes = None, [(0, self.root)] if self.root else []
        while open_nodes:
            least, (held, children) = open_nodes.pop()
            if least > radius:
                continue
            apart = (held ^ word).bit_count()
            if apart <= radius:
                found, radius = held, apart - 1
            open_nodes += sorted(((abs(key - apart), child) for key, child in children.items() if abs(key - apart) <= radius), key=lambda n: -n[0])
        return found


class LinkedTree:
    """Words in a BK-tree, and their components over links of at most ``radius`` bits.

    A node also says whether all words below it are of its own component: a
    search that has reached that component already need not enter there, so a
    crowd of near copies costs each of its words a short walk and not a visit to
    all others.
    """

    def __init__(self, radius: int):
        self.radius, self.root = radius, None
        self.up: dict[int, int] = {}

    def top(self, word: int) -> int:
        """The smallest word of a component."""
        up = self.up
        while up[word] != word:
            up[word] = word = up[up[word]]
        return word

    def add(self, word: int) -> None:
        """Link ``word`` with the components that it comes near, and hold it."""
        self.up[word] = word
        node = [word, {}, True]
        if self.root is None:
            self.root = node
            return
        radius, top, open_nodes = self.radius, self.top, [self.root]
        while open_nodes:
            held, children, alike = open_nodes.pop()
            apart = (held ^ word).bit_count()
            if apart <= radius:
                a, b = sorted((top(held), top(word)))
                self.up[b] = a
            if children and not (alike and top(held) == top(word)):
                low, high = apart - radius, apart + radius
                open_nodes += [child for key, child in children.items() if low <= key <= high]
        home, own = self.root, top(word)
        while True:
            if home[2] and top(home[0]) != own:
                home[2] = False
            apart = (home[0] ^ word).bit_count()
            if apart not in home[1]:
                home[1][apart] = node
                return
            home = home[1][apart]


def shard_links(words: list[int], radius: int) -> list[tuple[int, int]]:
    """(word, smallest word of its component) for the distinct words of one shard that have a partner in it."""
    tree = LinkedTree(radius)
    for w in words:
        tree.add(w)
    return [(w, root) for w in words if (root := tree.top(w)) != w]


def _blocks(radius: int, distinct: int) -> int:
    """Blocks to cut 64 bits into, so that a shard of evenly spread words stays small. Any number over the radius finds all links."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if distinct / 2 ** (64 * (blocks - radius) // blocks) <= SHARD_ROWS:
            return blocks
    return max(2 * radius, radius + 1)


def _shard_keys(word: Column, radius: int, blocks: int) -> list[Column]:
    """One key for every choice of blocks that may agree: the choice's number and the bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, kept in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for k in kept:
            width = edges[k + 1] - edges[k]
            part = F.shiftrightunsigned(word, edges[k]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.xxhash64(key, part) if blocks - radius > 2 else F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return keys


def _runs(batches, n_keys: int):
    """Rows of consecutive equal values of the first columns, as lists of columns; a run may span batches."""
    held, key = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        keys = list(zip(*columns[:n_keys], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            part = [c[start:i] for c in columns[n_keys:]]
            if held is not None and keys[start] == key:
                for mine, more in zip(held, part, strict=True):
                    mine += more
            else:
                if held is not None:
                    yield key, held
                held, key = part, keys[start]
            start = i
    if held is not None:
        yield key, held


def _search(radius: int):
    """Links within the parts ``(shard, salt)`` of rows ``(shard, salt, word)`` that are in this order."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(part: np.ndarray) -> pa.RecordBatch:
        found = shard_links(part.view(np.uint64).tolist(), radius) if len(part) > 1 else []
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return batch(schema, [pairs[:, 0], pairs[:, 1]])

    def run(batches):
        held, key = [], None  # the pieces of a part that may go on in the next batch
        for b in batches:
            shard, salt, word = (b.column(i).to_numpy() for i in range(3))
            if not len(word):
                continue
            starts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1).tolist(), len(word)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if key is not None and (shard[i], salt[i]) != key:
                    yield links(np.concatenate(held))
                    held = []
                key = shard[i], salt[i]
                held.append(word[i:j])
        if held:
            yield links(np.concatenate(held))

    return run


def cross_links(one: np.ndarray, homes: np.ndarray, other: np.ndarray, their_homes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between words of two blocks whose homes differ, found in the one's tree; homes that a link has joined count as one from then on."""
    tree, up, links = BKTree(), {}, []
    home_of = dict(zip(one.tolist(), homes.tolist(), strict=True))
    for word in home_of:
        tree.put(word)

    def top(home: int) -> int:
        while (above := up.get(home, home)) != home:
            home = above
        return home

    for word, home in zip(other.tolist(), their_homes.tolist(), strict=True):
        for near in tree.near(word, radius):
            a, b = top(home_of[near]), top(home)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((near, word))
    return links


def _across(placed: DataFrame, radius: int) -> DataFrame:
    """Links between words of ``(shard, salt, word, home)`` that are in different parts of a shard and have different homes."""
    names = ["shard", "salt", "block", "low", "high", "words", "homes"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.binary()]

    def blocks(batches):
        number = TaskContext.get().partitionId() << 32
        for (shard, salt), (words, homes) in _runs(batches, 2):
            for at in range(0, len(words), BLOCK_WORDS):
                number += 1
                word, home = (np.array(c[at : at + BLOCK_WORDS], np.int64) for c in (words, homes))
                values = [shard, salt, number, int(home.min()), int(home.max()), word.tobytes(), home.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                one, homes, other, their_homes = (np.frombuffer(c[row].as_py(), np.int64) for c in b.columns)
                pairs = np.array(cross_links(one.view(np.uint64), homes, other.view(np.uint64), their_homes, radius), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    dealt = placed.select("shard", "salt", "word", "home").repartition("shard", "salt").sortWithinPartitions("shard", "salt", "home", "word")
    made = cut(map_batches(dealt, blocks, "shard long, salt int, block long, low long, high long, words binary, homes binary"), "simhash-blocks")
    other = made.select("shard", *[F.col(n).alias(f"_{n}") for n in names[1:]])
    one_home = (F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low"))
    pairs = made.join(other, "shard").where((F.col("salt") < F.col("_salt")) & ~one_home)
    return map_batches(pairs.select("words", "homes", "_words", "_homes"), run, "src long, dst long")


def near_links(words: DataFrame, radius: int, blocks: int, most: int = TREE_WORDS) -> DataFrame:
    """``(src, dst)`` links that connect all distinct long ``word``s of which at most ``radius`` bits differ; a tree holds about ``most`` words."""
    dealt = words.select(F.explode(F.array(*_shard_keys(F.col("word"), radius, blocks))).alias("shard"), "word")
    crowded = cut(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "simhash-crowded")
    split = crowded.limit(1).count() > 0
    salt = F.pmod(F.xxhash64("word"), F.ceil(F.col("n") / most)).cast("int")
    parts = (dealt.join(crowded, "shard", "left").withColumn("salt", F.coalesce(salt, F.lit(0))) if split else dealt.withColumn("salt", F.lit(0))).select("shard", "salt", "word")
    ordered = parts.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "salt").sortWithinPartitions("shard", "salt", "word")
    links = ordered.mapInArrow(_search(radius), "src long, dst long").distinct()
    if not split:
        return links
    links = cut(links, "simhash-links")
    placed = parts.join(crowded.select("shard"), "shard", "left_semi").join(connected_components(links), F.col("word") == F.col("node"), "left")
    placed = cut(placed.select("shard", "salt", "word", F.coalesce("component", "word").alias("home")), "simhash-placed")
    mixed = placed.groupBy("shard").agg(F.min("home").alias("_low"), F.max("home").alias("_high")).where("_low < _high").select("shard")
    return links.unionByName(_across(placed.join(mixed, "shard", "left_semi"), radius))


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus the long column ``word``: one row per row of ``docs``."""
    kept = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["`word` long"])

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            word = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(word, pa.int64())], names=[*kept, "word"])

    return map_batches(docs.select(text, *kept), run, schema)


def near_components(docs: DataFrame, words: int = 4, radius: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``word`` (the fingerprint) and ``component_id``.

    ``component_id`` is the smallest key that can be reached over links. A null
    or wordless text has fingerprint 0 and links like any other; rows with a null
    key take part, and a component of null keys only has a null id. Repeated rows
    stay; other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words), "simhash")
    distinct = cut(rows.groupBy("word").agg(F.min("key").alias("least")), "simhash-words")
    links = cut(near_links(distinct.select("word"), radius, _blocks(radius, distinct.count())), "simhash-links")
    homes = connected_components(links)
    grouped = distinct.join(homes, F.col("word") == F.col("node"), "left").select("word", "least", F.coalesce("component", "word").alias("home"))
    least = grouped.groupBy("home").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(least, "home").select("word", "component_id"), "simhash-components")
    return rows.join(named, "word").select(F.col("key").alias(key), "word", "component_id")


def hex_word(word: Column | str) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text or b"", words))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima of a set; of an empty set none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        least = np.minimum(least, (_FACTORS * folded[at : at + 2048] + _SHIFTS).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def reach(similarity: float) -> int:
    """Bits by which the fingerprints of sets of this Jaccard similarity differ, and six standard deviations more."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(64 * share + 6 * math.sqrt(64 * share * (1 - share)))


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """``(key, text)`` with ``node`` (the hash of its shingle set), ``size`` and ``word`` (the fingerprint) of the set, and ``bands``."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            word = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(word), bands], names=["key", "text", "node", "size", "word", "bands"])

    return map_batches(docs.select("key", "text"), run, f"key {docs.schema['key'].dataType.simpleString()}, text string, node long, size int, word long, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)`` of ``(node, text)``: the shingle set as bytes."""

    def run(batches):
        for b in batches:
            hashes = [shingle_set(t, words).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    return map_batches(texts.select("node", "text"), run, "node long, hashes binary")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    both = shared(a, b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)`` of the ``(a, b)`` whose sets have at least this Jaccard similarity, by the sets themselves."""
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = sets.join(used, "node", "left_semi")
    side = lambda n: held.select(F.col("node").alias(n), F.col("hashes").alias(f"of_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")

    def run(batches):
        for batch_ in batches:
            kept = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(*(batch_.column(i).to_pylist() for i in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch_.column(0), batch_.column(1)], names=["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    return map_batches(both, run, "src long, dst long")


def tree_pairs(nodes: list[int], sizes: list[int], words: list[int], similarity: float, radius: int) -> set[tuple[int, int]]:
    """For every member of a shard, its nearest before it in the shard's BK-tree, and the member nearest to the middle of all."""
    tree, first, found = BKTree(), {}, []
    bits = np.unpackbits(np.array(words, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(words), bitorder="little").view(np.uint64)[0])
    hub = min(range(len(words)), key=lambda i: (words[i] ^ middle).bit_count())
    for i, word in enumerate(words):
        near = word if word in first else tree.nearest(word, radius)
        if near is not None:
            found.append((i, first[near]))
        if word not in first:
            first[word] = i
            tree.put(word)
        found.append((i, hub))
    return {(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in found if i != j and min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]) - 1e-9}


def _first_pairs(members: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``(a, b)``: the pairs of ``tree_pairs`` of every shard ``(band, salt)``."""

    def run(batches):
        for _, (nodes, sizes, words) in _runs(batches, 2):
            pairs = sorted(tree_pairs(nodes, sizes, [w & (1 << 64) - 1 for w in words], similarity, radius))
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.select("band", "salt", "node", "size", "word").repartition("band", "salt").sortWithinPartitions("band", "salt", "word", "node")
    return map_batches(dealt, run, "a long, b long").distinct()


_BLOCK = "band long, block long, low long, high long, nodes binary, homes binary, words binary, bands binary, hashes array<binary>"


def _blocks_of(members: DataFrame) -> DataFrame:
    """Rows of at most ``BLOCK_ROWS`` members of one shard, in the order of their homes, so that most blocks of a crowd have one home."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def out(band, rows):
            nonlocal number
            number += 1
            homes, nodes, words, bands, hashes = zip(*rows, strict=True)
            as_bytes = lambda values: np.array(values, np.int64).tobytes()
            values = [band, number, min(homes), max(homes), as_bytes(nodes), as_bytes(homes), as_bytes(words), as_bytes(bands), list(hashes)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        types = [*[pa.int64()] * 4, *[pa.binary()] * 4, pa.list_(pa.binary())]
        held, size, key = [], 0, None
        for b in batches:
            for band, salt, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and ((band, salt) != key or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    yield out(key[0], held)
                    held, size = [], 0
                key = band, salt
                held.append(row)
                size += len(row[-1])
        if held:
            yield out(key[0], held)

    dealt = members.select("band", "salt", "home", "node", "word", "bands", "hashes").repartition("band", "salt").sortWithinPartitions("band", "salt", "home", "node")
    return map_batches(dealt, run, _BLOCK)


def block_links(band: int, one: tuple, other: tuple, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links between members of two blocks (or of one) whose homes differ: what the BK-tree of the one finds for the other, checked on the sets.

    A pair is checked only in the first band that it shares. Homes that a link
    has joined count as one from then on.
    """
    (nodes, homes, words, bands, sets), (their_nodes, their_homes, their_words, their_bands, their_sets) = one, other
    up: dict[int, int] = {}

    def top(home: int) -> int:
        while (above := up.get(home, home)) != home:
            home = above
        return home

    tree, held, links = BKTree(), {}, []
    for i, word in enumerate(words):
        if word in held:
            held[word].append(i)
        else:
            held[word] = [i]
            tree.put(word)
    sizes, place = np.array([len(s) for s in sets]), int(np.flatnonzero(bands[0] == band)[0])
    for j, word in enumerate(their_words):
        mine, size = their_homes[j], len(their_sets[j])
        at = np.array([i for w in tree.near(word, radius) for i in held[w] if homes[i] != mine], np.int64)
        at = at[np.minimum(sizes[at], size) >= similarity * np.maximum(sizes[at], size) - 1e-9]
        at = at[~(bands[at, :place] == their_bands[j, :place]).any(axis=1)]
        for i in at.tolist():
            a, b = top(homes[i]), top(mine)
            if a != b and alike(sets[i], their_sets[j], similarity):
                up[max(a, b)] = min(a, b)
                links.append((nodes[i], their_nodes[j]))
    return links


def _rest_links(members: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``(src, dst)`` links between members of different homes, by pairs of blocks of a band. Two blocks of one and the same home are not paired."""
    blocks = cut(_blocks_of(members), "similar-blocks")
    other = blocks.select("band", *[F.col(c).alias(f"_{c}") for c in blocks.columns if c != "band"])
    one_home = (F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low"))
    pairs = blocks.join(other, "band").where((F.col("block") <= F.col("_block")) & ~one_home)
    names = ["nodes", "homes", "words", "bands", "hashes"]

    def unpacked(nodes, homes, words, bands, hashes):
        as_array = lambda data, kind: np.frombuffer(data, kind)
        return as_array(nodes, np.int64).tolist(), as_array(homes, np.int64).tolist(), as_array(words, np.uint64).tolist(), as_array(bands, np.int64).reshape(-1, BANDS), [as_array(h, np.uint64) for h in hashes]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                band, *values = (c[row].as_py() for c in b.columns)
                links = block_links(band, unpacked(*values[:5]), unpacked(*values[5:]), similarity, radius)
                src, dst = zip(*links, strict=True) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return map_batches(pairs.select("band", *names, *[f"_{n}" for n in names]), run, "src long, dst long")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``node`` (the hash of its shingle set) and ``component_id``, the smallest key reached over links.

    Two texts link when the Jaccard similarity of their shingle sets is at least
    ``similarity``, which is always checked on the sets. The candidates are found
    in BK-trees over the sets' SimHash words, searched within ``reach`` of the
    similarity (a pair is farther apart about once in a million). A shard is what
    shares a band of minima; a pair at 0.8 shares none with probability 3e-6.

    In each shard every member is first checked against its nearest in the tree
    and against the member in the middle, so a crowd of near copies falls into
    few components at a cost in proportion to its members. Then blocks of the
    shards that still hold several components are searched against each other,
    for pairs of different components only; so no link is lost. Crowded shards
    are dealt to many tasks by a salt, and no task holds more than two blocks or
    ``TREE_ROWS`` fingerprints of them.

    A null or wordless text has an empty set and links with its like; rows with a
    null key take part, and a component of null keys only has a null id. Repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """
    radius = reach(similarity)
    rows = cut(_shingled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words), "similar")
    distinct = cut(rows.groupBy("node").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("size", "word", "bands")]), "similar-nodes")
    dealt = distinct.select("node", "size", "word", F.explode("bands").alias("band"))
    crowds = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TREE_ROWS)).cast("int").alias("salt")
    members = cut(dealt.join(crowds, "band").select("band", "n", salt, "node", "size", "word"), "similar-members")
    shown = distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("key"))  # one row of a crowd of copies shows its text
    texts = rows.alias("r").join(shown.alias("s"), (F.col("r.node") == F.col("s.node")) & F.col("r.key").eqNullSafe(F.col("s.key")), "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut(_sets(texts, words), "similar-sets")
    tried = cut(_first_pairs(members, similarity, radius), "similar-pairs")
    homes = connected_components(cut(_alike(tried, sets, similarity), "similar-links"))
    placed = members.where("n > 2").join(homes, "node", "left").select("band", "salt", "node", "word", F.coalesce("component", "node").alias("home"))  # the pair of two has been checked
    mixed = placed.groupBy("band").agg(F.min("home").alias("_low"), F.max("home").alias("_high")).where("_low < _high").select("band")
    left = placed.join(mixed, "band", "left_semi").join(sets, "node").join(distinct.select("node", "bands"), "node")
    links = cut(_rest_links(left, similarity, radius), "similar-links")
    if links.limit(1).count():
        homes = connected_components(links.unionByName(homes.select(F.col("node").alias("src"), F.col("component").alias("dst"))))
    grouped = distinct.select("node", "least").join(homes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("home"))
    least = grouped.groupBy("home").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(least, "home").select("node", "component_id"), "similar-components")
    return rows.select("key", "node").join(named, "node").select(F.col("key").alias(key), "node", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component of ``similar_components``; of its repeated rows, one.

    A document is a row's id and text: unlike texts that share an id are
    documents of their own, like ones are one group, of which the text with the
    smallest hash stays. Of rows with equal id and text the one whose other
    columns have the smallest hash stays, so reruns agree. Rows with a null id
    stay. Null and wordless texts are near copies of each other. All columns of
    ``docs`` are kept, whatever their names; an empty table gives no rows.
    """
    hashable = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    named = docs.where(F.col("doc_id").isNotNull()).select(F.struct("doc_id", F.xxhash64("text").alias("of_text")).alias("own"), F.xxhash64(*hashable).alias("order"), "text", row.alias("row"))
    of_null = docs.where(F.col("doc_id").isNull())
    every = named.select("own", "text").unionByName(of_null.select(F.lit(None).cast(named.schema["own"].dataType).alias("own"), "text"))
    labelled = similar_components(every, words, similarity, key="own").where(F.col("own") == F.col("component_id"))
    first = named.drop("text").join(labelled.select("own").distinct(), "own", "left_semi").groupBy("own").agg(F.min_by("row", "order").alias("row"))
    return first.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)]).unionByName(of_null)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, at most 4 bits apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_components(docs, words=4, radius=4)
    return found.select("doc_id", hex_word("word").alias("fingerprint"), "component_id")
