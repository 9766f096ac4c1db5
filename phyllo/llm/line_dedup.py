"""Cross-site line dedup by distinct-site spread.

For every normalised line a HyperLogLog sketch of the sites that show it is
built map-side and merged by aggregation. A line whose estimate lies clearly
above ``SITES`` is boilerplate, one clearly below is not; for the lines between,
whose estimate is too near to the threshold to trust, distinct sites are counted
exactly. Boilerplate stays where it comes first, at its first place in the
document of the smallest id, and is cut from every other place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches, put_back, set_aside
from phyllo.llm.lines import hashed_lines, line_hash
from phyllo.session import cut

#: Sites at which a line is boilerplate; words of a line that counts; log2 of a sketch's registers; the share of SITES
#: by which an estimate must miss it to be trusted (over ten standard errors of a sketch of that size).
SITES = 5
LEAST_WORDS = 4
REGISTERS = 12
DOUBT = 0.25


def _lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, site, text_key, hashes)`` with the distinct line hashes of each row."""

    def run(batches):
        for b in batches:
            hashes = [list(dict.fromkeys(h for h, _ in hashed_lines(t or b"", LEAST_WORDS))) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "site", "text_key", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("site"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return map_batches(rows, run, "doc_id long, site string, text_key string, hashes array<long>")


def boilerplate(lines: DataFrame) -> DataFrame:
    """``(hash, keeper)`` of the lines that at least ``SITES`` sites show; keeper: the smallest doc_id that has it."""
    seen = lines.select("doc_id", "site", F.explode("hashes").alias("hash"))
    sketched = seen.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.min("doc_id").alias("keeper"))
    spread = sketched.select("hash", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.where(F.col("sites") >= SITES * (1 - DOUBT)), "line-spread")
    near = spread.where(F.col("sites") <= SITES * (1 + DOUBT))
    exact = seen.join(near.select("hash"), "hash", "left_semi").groupBy("hash", "site").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n")).where(F.col("n") >= SITES)
    sure = spread.where(F.col("sites") > SITES * (1 + DOUBT)).select("hash", "keeper")
    return cut(sure.union(near.join(exact, "hash", "left_semi").select("hash", "keeper")), "line-boilerplate")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate cut from ``text``, plus ``n_lines`` and ``n_removed``.

    ``docs`` has doc_id, source (the site) and text; all its columns stay, n_chars
    follows the text. A null text stays null and has no lines; a text all of whose
    lines go becomes empty. A null source is a site of its own. Rows that share an
    id and a text are treated alike; of rows with null ids only, all keep the line.
    Texts are read whole, however long; an empty table gives no rows.
    Columns that are already called ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = cut(_lines_of(docs), "line-hashes")
    cuts = lines.select("doc_id", "text_key", F.explode("hashes").alias("hash")).join(boilerplate(lines), "hash")
    own = F.col("doc_id").eqNullSafe(F.col("keeper"))
    cuts = cuts.groupBy("doc_id", "text_key").agg(F.collect_set(F.when(~own, F.col("hash"))).alias("_phyllo_drop"), F.collect_set(F.when(own, F.col("hash"))).alias("_phyllo_first"))
    cuts = cut(cuts, "line-cuts")
    kept = list(docs.columns)
    rows = docs.withColumn("_phyllo_key", F.md5(F.coalesce("text", F.lit("")))).alias("d")
    rows = rows.join(cuts.alias("c"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")) & (F.col("d._phyllo_key") == F.col("c.text_key")), "left")
    rows = rows.select(*[F.col(f"d.`{c}`") for c in kept], "c._phyllo_drop", "c._phyllo_first")
    at = {c: i for i, c in enumerate(kept)}

    def run(batches):
        for b in batches:
            texts, n_lines, n_removed = [], [], []
            for text, drop, first in zip(b.column(at["text"]).to_pylist(), b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist(), strict=True):
                n_lines.append(0 if text is None else text.count("\n") + 1)
                n_removed.append(0)
                if text is not None and (drop or first):
                    gone, once, left = set(drop), set(first), []
                    for line in text.split("\n"):
                        words = line.encode().lower().split()
                        h = line_hash(words) if len(words) >= LEAST_WORDS else None
                        if h in gone:
                            n_removed[-1] += 1
                            continue
                        if h in once:
                            once.discard(h)
                            gone.add(h)
                        left.append(line)
                    text = "\n".join(left)
                texts.append(text)
            columns = list(b.columns[: len(kept)])
            columns[at["text"]] = pa.array(texts, pa.string())
            if "n_chars" in at:
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(at["n_chars"]).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept, "n_lines", "n_removed"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["n_lines long", "n_removed long"])
    return map_batches(rows, run, schema)


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` without boilerplate lines; only ``text`` and ``n_chars`` change, all other columns keep their values, whatever their names."""
    used = ("doc_id", "source", "text", "n_chars")
    return put_back(dedup_lines(set_aside(docs, used)), docs, used)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, lines removed from it, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, source, u.line, u.pos,
    trim(regexp_replace(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) u
), b AS (
  SELECT norm, min(doc_id) AS keeper FROM l WHERE len(string_split(norm, ' ')) >= 4
  GROUP BY norm HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 5
), m AS (
  SELECT l.doc_id, l.line, l.pos, b.norm IS NOT NULL AND (l.doc_id <> b.keeper OR row_number() OVER (PARTITION BY l.doc_id, l.norm ORDER BY l.pos) > 1) AS gone
  FROM l LEFT JOIN b ON l.norm = b.norm
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
