"""Edit-aware token counts over segment trees of pre-tokens.

The leaves of a document's tree are chunks of consecutive pre-tokens; inner nodes
hold the sums of characters and tokens below them. An edit finds its place by
character sums, splits anew from a little before the edit until the new
boundaries meet the old ones again, and counts only those pre-tokens; sums are
updated on the path to the root.

Where a match ends depends on at most two characters behind its end (the next
one, and for white space the one after it), and what follows depends on nothing
before it. So every pre-token that ends two characters before an edit stays, and
so do all from the first old boundary behind the edit at which a new pre-token
begins as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches
from phyllo.llm.bpe import RANKS, Encoder, encoder, load_ranks

#: Pre-tokens of a leaf when a tree is built; a leaf that grows to four times that is cut up.
LEAF = 32
#: Characters that a match may look at behind its end.
CONTEXT = 2


class TokenTree:
    """A text with its token count, kept under edits."""

    def __init__(self, text: str, coder: Encoder, pieces: list[str] | None = None):
        """``pieces``: the text's pre-tokens, if ``coder`` has split it and learnt them already."""
        self.text, self.coder, self.recounted = text, coder, 0
        if pieces is None:
            pieces = coder.split(text)
            coder.learn(set(pieces))
        n = len(pieces)
        tokens = np.fromiter(map(len, map(coder.known.__getitem__, pieces)), np.int64, n) >> 2
        self._build(np.fromiter(map(len, pieces), np.int64, n), tokens)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Leaves over the characters and tokens of all pre-tokens, and the sums above them. A leaf is spelled out when it is first touched."""
        starts = np.arange(0, max(len(chars), 1), LEAF)
        self.leaves: list[list[tuple[int, int]] | None] = [None] * len(starts)
        self.flat = (chars, tokens)
        self.size = 1 << (len(starts) - 1).bit_length()
        self.chars, self.tokens = (self._sums(np.add.reduceat(a, starts) if len(a) else np.zeros(1, np.int64)) for a in self.flat)

    def _sums(self, leaves: np.ndarray) -> list[int]:
        level = self.size
        tree = np.zeros(2 * level, np.int64)
        tree[level : level + len(leaves)] = leaves
        while level > 1:
            level //= 2
            tree[level : 2 * level] = tree[2 * level : 4 * level : 2] + tree[2 * level + 1 : 4 * level : 2]
        return tree.tolist()

    def _leaf(self, at: int) -> list[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens of a leaf."""
        if self.leaves[at] is None:
            chars, tokens = (a[at * LEAF : (at + 1) * LEAF].tolist() for a in self.flat)
            self.leaves[at] = list(zip(chars, tokens, strict=True))
        return self.leaves[at]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at ``place``, or the last with any."""
        node, start = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            right = self.chars[2 * node + 1]
            if place < start + left or not right:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.size, start

    def _set_leaf(self, at: int, pieces: list[tuple[int, int]]) -> None:
        self.leaves[at] = pieces
        node = self.size + at
        self.chars[node], self.tokens[node] = sum(c for c, _ in pieces), sum(t for _, t in pieces)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from ``start`` to ``end``; the new token count."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first, place = self._leaf_at(max(start - CONTEXT, 0))
        while first and place > max(start - CONTEXT, 0):  # an empty leaf was met
            first -= 1
            place -= self.chars[self.size + first]
        kept = []
        for chars, tokens in self._leaf(first):
            if place + chars > start - CONTEXT:
                break
            kept.append((chars, tokens))
            place += chars
        # Old boundaries from here on, leaf by leaf, until a new one meets one of them behind the edit.
        leaf, at, old = first, len(kept), place
        matches = self.coder.pattern.finditer(self.text, place)
        found: list[str] = []
        now = place
        while True:
            while now - shift > old or old < end:
                if at < len(self._leaf(leaf)):
                    old += self._leaf(leaf)[at][0]
                    at += 1
                elif leaf + 1 < len(self.leaves):
                    leaf, at = leaf + 1, 0
                else:
                    break
            if now - shift == old and old >= end and now >= start + len(new):
                break
            match = next(matches, None)
            if match is None:
                leaf, at = len(self.leaves) - 1, len(self._leaf(len(self.leaves) - 1))
                break
            found.append(match[0])
            now = match.end()
        self.recounted += len(found)
        fresh = list(zip(map(len, found), self.coder.counts(found), strict=True))
        rest = self._leaf(leaf)[at:]
        if leaf == first:
            self._set_leaf(first, kept + fresh + rest)
        else:
            self._set_leaf(first, kept + fresh)
            for i in range(first + 1, leaf):
                self._set_leaf(i, [])
            self._set_leaf(leaf, rest)
        if len(self.leaves[first]) >= 4 * LEAF:
            whole = np.array([p for i in range(len(self.leaves)) for p in self._leaf(i)], np.int64).reshape(-1, 2)
            self._build(whole[:, 0], whole[:, 1])
        return self.count


def edited_counts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text, edits) before and after its edits.

    ``edits`` is an array of (at, until, new): the edits of a document in order,
    each in characters of the text as the ones before it left it; ends beyond the
    text are drawn in. Null edits or null texts count as none and as empty, a null
    ``new`` as a deletion. Rows stand by themselves, so repeated rows and null ids
    stay; texts are read whole, however long. Columns beside the three are ignored,
    whatever their names; an empty table gives no rows. Only the default pattern is
    taken, as ``CONTEXT`` holds for what it looks at behind a match.
    """
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("edited counts are right for the default pattern only")
    path = path or public_tokenizers.path(RANKS)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    names = ["doc_id", "n_tokens", "n_edits", "edited_tokens", "edited_chars", "edited_sha256", "pretokens_recounted"]
    types = [pa.int64()] * 5 + [pa.string(), pa.int64()]

    def run(batches):
        coder = encoder(ranks.value, pattern, path)
        for b in batches:
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 200):
                split = [coder.split(t) for t in texts[at : at + 200]]
                coder.learn(set().union(*split))
                trees = [TokenTree(t, coder, s) for t, s in zip(texts[at : at + 200], split, strict=True)]
                for i, tree in enumerate(trees, at):
                    whole, edits = tree.count, b.column(2)[i].as_py() or []
                    for e in edits:
                        tree.edit(e["at"] or 0, e["until"] or 0, e["new"] or "")
                    out.append((b.column(0)[i].as_py(), whole, len(edits), tree.count, len(tree.text), hashlib.sha256(tree.text.encode()).hexdigest(), tree.recounted))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return map_batches(rows, run, "doc_id long, n_tokens long, n_edits long, edited_tokens long, edited_chars long, edited_sha256 string, pretokens_recounted long")


def op2_edit_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a passage moved to the front third, one deleted, one word put in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit(""))).cast("int")
    edit = lambda at, until, new: F.struct(at.cast("int").alias("at"), until.cast("int").alias("until"), new.alias("new"))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    edits = F.array(
        edit(third, third, F.substring(F.col("text"), half + 1, F.lit(40))),
        edit(half, half + 25, F.lit("")),
        edit(F.lit(1), F.lit(3), F.lit(" edited's 42\n\n")),
    )
    return edited_counts(docs.withColumn("edits", edits))
