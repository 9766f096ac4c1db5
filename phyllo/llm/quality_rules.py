"""Quality rules: base counts of a text, and cross-document line frequency by host.

Lines are normalised and hashed; for every host the distinct documents that show
a line are counted, exact copies once; lines that more than ``MOST_DOCS`` and more
than ``MOST_PERCENT`` of a host's documents show are removed; a document that
loses more than half of its words that way, or of which too few words are left to
pass the base rules, is depleted and rejected.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches
from phyllo.llm.lines import hashed_lines
from phyllo.session import cut

#: Documents of a host that may share a line whatever their share, and percent of a host's documents that may; percent of a document's words that must be left.
MOST_DOCS = 3
MOST_PERCENT = 1
LEAST_LEFT = 50
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts named in ``COUNTS`` of a UTF-8 text."""
    words = text.split()
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        found, covered = Counter(windows), 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    return len(words), chars, symbols, dup, repeated


def _rows(docs: DataFrame) -> DataFrame:
    """Per row: id, host, key of the text, base counts, and the words that each of its distinct lines has in it."""
    names = ["doc_id", "host", "text_key", *COUNTS, "lines"]
    line = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for b in batches:
            counts, lines = [], []
            for text in b.column(3).cast(pa.binary()).to_pylist():
                counts.append(base_counts(text or b""))
                total: dict[int, int] = {}
                for h, n in hashed_lines(text or b""):
                    total[h] = total.get(h, 0) + n
                lines.append([{"hash": h, "words": n} for h, n in total.items()])
            columns = list(zip(*counts, strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int64()) for c in columns), pa.array(lines, line)], names=names)

    schema = "doc_id long, host string, text_key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<hash: long, words: long>>"
    host = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("null")).alias("host")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), host, F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text"), run, schema)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``n_removed_words``, ``base_failed`` and ``kept`` for each row of ``docs`` (doc_id, host, text).

    A null or empty text has no words and fails the base rules. A null host is a
    host of its own. Repeated rows are judged alike and count once for their
    lines, as do documents of one host with equal texts: a line of a text that is
    copied a thousand times is no boilerplate. Rows with null ids are judged too.
    Texts are read whole, however long. Columns of ``docs`` beside the three are
    ignored, whatever their names. An empty table gives no rows.
    """
    rows = cut(_rows(docs), "rules-rows")
    texts = rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    lines = cut(texts.select("host", "text_key", F.inline("lines")), "rules-lines")
    hosts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    spread = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_DOCS)
    common = cut(spread.join(hosts, "host").where(100 * F.col("n") > MOST_PERCENT * F.col("texts")).select("host", "hash"), "rules-common")
    removed = lines.join(common, ["host", "hash"], "left_semi").groupBy("host", "text_key").agg(F.sum("words").alias("n_removed_words"))
    removed = cut(removed, "rules-removed")
    judged = rows.drop("lines").join(removed, ["host", "text_key"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (100 * left < LEAST_LEFT * F.col("n_words")) | (left < LEAST_WORDS)
    return judged.select("doc_id", *COUNTS, "n_removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; its source is its host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs.select("doc_id", F.col("source").alias("host"), "text"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), raw AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), dup AS (
  SELECT doc_id, count(*) FILTER (WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM raw) GROUP BY doc_id
), win AS (
  SELECT doc_id, pos, [words[pos], words[pos + 1], words[pos + 2]] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM d)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM twice) GROUP BY doc_id
), norm AS (
  SELECT doc_id, host, md5(text) AS text_key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw
), common AS (
  SELECT host, norm FROM norm JOIN (SELECT host, count(DISTINCT md5(text)) AS texts FROM d GROUP BY host) USING (host) WHERE n > 0
  GROUP BY host, norm HAVING count(DISTINCT text_key) > 3 AND 100 * count(DISTINCT text_key) > any_value(texts)
), gone AS (
  SELECT doc_id, sum(n) AS n_removed_words FROM norm SEMI JOIN common USING (host, norm) GROUP BY doc_id
), c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AND n_words - n_removed_words >= 50 AS kept
FROM c
"""
