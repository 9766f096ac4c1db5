"""Quality classifier: random-indexing vectors, pooled per document, and a two-layer network with calibrated probabilities.

A term's index vector is a sparse ternary vector drawn from the term's hash. Its
context vector is the sum of the index vectors of the terms within ``REACH``
places of it, over the sample of labelled documents; the word vector joins the
two. Terms are words without outer punctuation, lower-cased, and marks: a word
in capitals, a run of symbols on a word, a word repeated at once. Terms fall
into ``BUCKETS`` buckets, so the vectors that are broadcast have a fixed size.

A document is the mean of the vectors of all its terms. A network of one hidden
layer is fitted on the sample, then its logits are divided by the temperature
that gives the least log loss on the part of the sample that fitting left out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches, put_back, set_aside
from phyllo.session import cut

#: Buckets of terms, width of the vectors, non-zeros of an index vector, and places on each side that are context.
BUCKETS, WIDTH, NONZERO, REACH = 1 << 15, 64, 8, 2
#: Labelled documents that the model is fitted on at most; every fifth of them calibrates.
SAMPLE = 6000
HIDDEN, EPOCHS, SEED = 32, 60, 7
#: Tasks that the bounded sample is read in. Each sends sums of BUCKETS x WIDTH to the driver, so there must not be more of them than this.
FIT_TASKS = 4
KEPT_WORDS = 300_000
_CORE = re.compile(r"^[\W_]*(.*?)([\W_]*)$", re.S)


def _bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), SEED) % BUCKETS


SAME = "\x01same"


def terms_of(word: str) -> list[str]:
    """The terms that one word stands for: its core, then marks of its form."""
    core, tail = _CORE.match(word).groups()
    found = [core.lower()] if core else []
    if len(core) > 1 and core.isupper():
        found.append("\x01caps")
    tail = tail if core else word
    if tail and (len(tail) > 1 or not core):
        found.append("\x01tail " + tail[0])
    return found


class Terms:
    """Words to buckets, with a bounded store."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}
        self.same = _bucket(SAME)

    def buckets(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = tuple(_bucket(t) for t in terms_of(word))
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of a text's terms."""
        words = text.split()
        total: dict[int, int] = {}
        for word, n in Counter(words).items():
            for b in self.buckets(word):
                total[b] = total.get(b, 0) + n
        if same := sum(map(eq, words, words[1:])):
            total[self.same] = total.get(self.same, 0) + same
        return np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.float32, len(total))

    def sequence(self, text: str) -> np.ndarray:
        """The buckets of a text's terms in order."""
        out, last = [], None
        for word in text.split():
            out.extend(self.buckets(word))
            if word == last:
                out.append(self.same)
            last = word
        return np.array(out, np.int64)


def index_vectors() -> np.ndarray:
    """The sparse ternary vector of every bucket."""
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, WIDTH), np.int8)
    places = rng.permuted(np.tile(np.arange(WIDTH, dtype=np.int16), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    signs = np.tile(np.array([1, -1], np.int8), NONZERO // 2)
    np.put_along_axis(vectors, places.astype(np.int64), signs[None, :], axis=1)
    return vectors


def context_sums(sequences: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around each bucket."""
    sums = np.zeros((BUCKETS, WIDTH), np.int32)
    for seq in sequences:
        for step in range(1, REACH + 1):
            if len(seq) <= step:
                continue
            here, there = np.concatenate([seq[:-step], seq[step:]]), np.concatenate([seq[step:], seq[:-step]])
            order = np.argsort(here, kind="stable")
            buckets, firsts = np.unique(here[order], return_index=True)
            sums[buckets] += np.add.reduceat(index[there[order]], firsts, axis=0, dtype=np.int32)
    return sums


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Own index vector and centred context, each of length 1 where not zero."""

    def unit(rows: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(length > 0, length, 1)

    context = unit(sums.astype(np.float32))
    seen = np.abs(sums).sum(axis=1) > 0
    if seen.any():
        context[seen] -= context[seen].mean(axis=0)
    return ((unit(context) + unit(index.astype(np.float32))) / 2).astype(np.float32)


def pool(text: str | None, terms: Terms, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of a text's terms; of none: zeros."""
    buckets, n = terms.counts(text or "")
    return n @ vectors[buckets] / n.sum() if len(n) else np.zeros(WIDTH, np.float32)


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` calibrates."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """A network for features and 0/1 labels. Labels of one kind only, or none, give a constant score: their rate with one success and one failure added."""
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if len(y) < 10 or y.min() == y.max():
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), start)
    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    train, calib = np.flatnonzero(~held), np.flatnonzero(held)
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(start)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            a = z[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    logits, truth = net.logits(x[calib]), y[calib]
    losses = {t: np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)) for t in np.geomspace(0.25, 8, 61)}
    net.temperature = float(min(losses, key=losses.get))
    return net


def is_held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors and network from ``SAMPLE`` labelled documents that are not held out, those of the smallest id hash.

    Labels with a null id or quality are left out; of repeated labels of an id
    the larger counts, of the texts of one id the smallest. The sample's bound also
    bounds the broadcast of its ids and what the driver gathers.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(F.col("quality").cast("int")).alias("quality"))
    sample = cut(sample, "quality-sample")
    sample = sample.coalesce(FIT_TASKS)

    def sums(batches):
        terms, index = Terms(), index_vectors()
        total = np.zeros((BUCKETS, WIDTH), np.int32)
        for b in batches:
            total += context_sums([terms.sequence(t) for t in b.column(1).to_pylist()], index)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((BUCKETS, WIDTH), np.int32)
    for row in map_batches(sample, sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"], np.int32).reshape(BUCKETS, WIDTH)
    vectors = word_vectors(total, index_vectors())
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        terms = Terms()
        for b in batches:
            rows = [pool(t, terms, sent.value).astype("<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "features"])

    table = map_batches(sample, features, "doc_id long, quality int, features binary").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    sent.destroy()
    x = np.frombuffer(b"".join(table["features"].to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
    return vectors, fit(x, np.array(table["quality"].to_pylist(), np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``.

    Only the text enters a score; it is read whole, however long, and a null or
    empty text is scored as the zero vector. Equal texts have equal scores. Every
    row of ``docs`` stays, repeated ones and those with a null id too, with its own columns; an empty table
    gives no rows, and without labels all rows score alike. Columns that are
    already called ``score`` or ``predicted`` are replaced.
    """
    docs = docs.drop("score", "predicted")
    vectors, net = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))
    kept = docs.columns
    at = kept.index("text")

    def run(batches):
        terms = Terms()
        vectors, net = sent.value
        for b in batches:
            x = np.array([pool(t, terms, vectors) for t in b.column(at).to_pylist()], np.float64).reshape(-1, WIDTH)
            score = net.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*kept, "score", "predicted"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])
    return map_batches(docs, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns and values, whatever the names."""
    scored = classify(set_aside(docs, ("doc_id", "text")), labels)
    return put_back(scored.where(F.col("predicted") == 1), docs, ("doc_id", "text"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and class of every document, with whether its labels were held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
