"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms (lower-cased runs of letters and digits) whose
document frequency lies in a band, that is whose inverse document frequency is
neither high nor low. A document's distinct terms in the lexicon are sorted by
their hash and hashed: once all of them, and once for every randomised subset of
the lexicon. Subsets keep shares of the lexicon from ``RATES``, small ones
included, so that some subset holds only a few terms of a long or a short
document and outlives an edit of the others.

A document without any term in the lexicon has all its terms hashed instead, so
that short texts of rare words don't all look alike.

A fingerprint is 16 hex digits for all terms, then 4 for each subset (``0000``:
none of the document's terms are in it). The likeness of two fingerprints is 1 if
they are equal, else the share of equal subsets among those that hold a term of
either.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches
from phyllo.session import cut

#: Document-frequency band as shares of all documents. The lower one bounds the lexicon: a term in it takes LOW * N of the
#: N * (mean distinct terms) pairs of document and term, so the lexicon has at most (mean distinct terms) / LOW entries.
LOW, HIGH = 0.0005, 0.1
RATES = (1 / 32, 1 / 64, 1 / 128, 1 / 512)
SUBSETS_PER_RATE = 16
SUBSETS = SUBSETS_PER_RATE * len(RATES)
SEED = 42
#: Entries that a task counts, and a worker keeps, before it lets go of them.
KEPT_TERMS = 400_000
TERM = re.compile(r"[^\W_]+")


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), SEED)


def subset_masks(hashes: np.ndarray) -> np.ndarray:
    """For every term hash, the bits of the subsets that keep the term."""
    masks = np.zeros(len(hashes), np.uint64)
    for k in range(SUBSETS):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))  # a mix of the hash and the subset's number
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        keep = x < np.uint64(int(RATES[k // SUBSETS_PER_RATE] * (1 << 64)))
        masks |= keep.astype(np.uint64) << np.uint64(k)
    return masks


class Fingerprinter:
    """Fingerprints by a lexicon of term hashes."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.masks = lexicon, subset_masks(lexicon)
        self.known: dict[str, int] = {}

    def _look(self, terms: list[str]) -> None:
        """Keep the places of terms in the lexicon, or -1."""
        if len(self.known) >= KEPT_TERMS:
            self.known.clear()
        hashes = np.array(list(map(_hash, terms)), np.uint64)
        places = np.minimum(np.searchsorted(self.lexicon, hashes), max(len(self.lexicon) - 1, 0))
        here = self.lexicon[places] == hashes if len(self.lexicon) else np.zeros(len(hashes), bool)
        self.known.update(zip(terms, np.where(here, places, -1).tolist(), strict=True))

    def __call__(self, text: str) -> str:
        terms = set(TERM.findall(text.lower()))
        found = list(map(self.known.get, terms))
        if None in found:
            self._look([t for t, f in zip(terms, found, strict=True) if f is None] if len(self.known) < KEPT_TERMS else list(terms))
            found = list(map(self.known.__getitem__, terms))
        places = np.array(found, np.int64)
        places = np.sort(places[places >= 0])  # the lexicon is in the order of its hashes
        if not len(places):
            hashes = np.array(sorted(map(_hash, terms)), np.uint64)
            masks = subset_masks(hashes)
        else:
            hashes, masks = self.lexicon[places], self.masks[places]
        bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :SUBSETS]
        subset, place = np.nonzero(bits.T)
        data, ends = hashes[place].tobytes(), np.searchsorted(subset, np.arange(SUBSETS + 1)).tolist()
        digest = xxhash.xxh32_intdigest
        values = [digest(data[8 * a : 8 * b], SEED) % 65535 + 1 if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return xxhash.xxh64_hexdigest(hashes.tobytes(), SEED) + "%04x" * SUBSETS % tuple(values)


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, 0 to 1."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (one, other))
    told = (a != 0) | (b != 0)
    return float((a == b)[told].mean()) if told.any() else 0.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``: hash of every term and the number of documents that have it."""

    def run(batches):
        def out(total):
            return pa.RecordBatch.from_arrays([pa.array(np.array([_hash(t) for t in total], np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

        total: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(set(TERM.findall((text or "").lower())))
                if len(total) > KEPT_TERMS:
                    yield out(total)
                    total.clear()
        yield out(total)

    return map_batches(docs.select("text"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms within the band; a term of one document only is never in it.

    Its size is bounded, whatever the number of documents: each of its terms takes
    at least ``LOW`` of all documents, so there are at most (mean distinct terms
    of a document) / ``LOW`` of them, of 8 bytes each.
    """
    n = docs.count()
    chosen = document_frequencies(docs).where((F.col("df") >= max(2, LOW * n)) & (F.col("df") <= max(2, HIGH * n)))
    return np.sort(np.frombuffer(cut(chosen.select("term"), "imatch-terms").toArrow()["term"].combine_chunks().to_numpy().tobytes(), np.uint64))


def with_next(docs: DataFrame) -> DataFrame:
    """``(part, halo, doc_id, text)``, dealt to tasks by ranges of doc_id and ordered; a range ends with the next range's first document (``halo`` 1).

    Only ids decide the ranges. The first document of every range is sent to the
    range before it as well, that of the first range to the last one, so each
    task knows the next document of all of its own.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    cuts = rows.where("doc_id IS NOT NULL").approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    splits = splits if len(splits) > 2 else [float("-inf"), 0.0, float("inf")]
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="part").transform(rows).withColumn("part", F.col("part").cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min("place").alias("first")).collect())
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    spread = spark.createDataFrame([(p, f, before[p]) for p, f in firsts], "part int, first double, before int")
    rows = rows.join(F.broadcast(spread), "part")  # one row for each range
    own = F.struct("part", F.lit(0).alias("halo"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(1).alias("halo"))
    rows = rows.select(F.explode(F.when(F.col("place") == F.col("first"), F.array(own, ahead)).otherwise(F.array(own))).alias("to"), "doc_id", "text")
    rows = rows.select("to.part", "to.halo", "doc_id", "text").repartitionById(len(splits) - 1, "part")
    return rows.sortWithinPartitions("part", "halo", F.asc_nulls_first("doc_id"), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document of ``docs`` (doc_id, text), and of its text edited with the next document's.

    A null text is empty; an empty text has no terms and the fingerprint of the
    empty list. Null ids come first in the order; rows of one id follow each
    other by text. The next document of the last is the first, so a lone document
    is edited with itself. Texts are read whole, however long; equal ones have
    equal fingerprints. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        mark, now = Fingerprinter(sent.value), None
        for b in batches:
            out = []
            for part, halo, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if halo and now is None:
                    continue  # only the first halo row is the next document
                own = mark(text)
                if now is not None:
                    _, last_id, last, last_mark = now
                    half = len(last) // 2
                    edited = last[: len(last) - half] + text[:half]
                    edited_mark = mark(edited)
                    out.append((last_id, len(last), hashlib.sha256(edited.encode()).hexdigest(), last_mark, edited_mark, likeness(last_mark, edited_mark), likeness(last_mark, own)))
                now = None if halo else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return map_batches(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
