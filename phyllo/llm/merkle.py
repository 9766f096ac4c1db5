"""Merkle manifest of a dataset over a radix-ranked trie.

Leaves are ranked within their group by hierarchical histograms of the digits of
their ids: rows are counted by id prefix, the counts are summed up digit by digit,
and going down again every prefix learns how many rows of its group lie before it.
A rank is that start plus the place among the few ids that share the longest
prefix. So ranks are exact without a sort over all rows, and no window holds more
than the children of one prefix.

The rank, written in base ``fanout``, is a leaf's path in the trie: a node is what
shares a prefix of these digits. Nodes are reduced by the longest prefix first,
several digits at once: a task holds one block of at most ``BLOCK`` nodes. Proofs
come back down the same way, block by block.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.operators.aggregates import numbered
from phyllo.session import cut

#: Bits of a digit of the id histograms, and nodes of a block that one task reduces.
DIGIT_BITS = 10
BLOCK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATH = "path array<struct<before:string,after:string>>, subroot string, root string"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """The digest of fields, each ``-`` if null, else its UTF-8 bytes with their number and a colon before them."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def ranked(rows: DataFrame, group: str, key: str, ties: str, name: str = "idx", bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` plus the 0-based place of a row in its ``group`` by the long ``key``, nulls first, equal keys by ``ties``.

    Rows that share a key are numbered by a window of their own prefix, in one
    task; ids are meant to be nearly unique.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    depth = 1
    while low is not None and bits * depth < 64 and low >> bits * depth != high >> bits * depth:
        depth += 1
    cell = F.shiftright(key, bits)
    levels = [cut(rows.groupBy(group, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "manifest-digits")]
    for _ in range(1, depth):
        levels.append(cut(levels[-1].groupBy(group, F.shiftright("cell", bits).alias("cell")).agg(F.sum("n").alias("n")), "manifest-digits"))
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(F.col("cell").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = levels[-1].select(group, "cell", before(group).alias("start"))  # a cell of a group or two, and one of null keys
    for level in reversed(levels[:-1]):
        up = starts.select(F.col(group).alias("_g"), F.col("cell").alias("_up"), "start")
        down = level.withColumn("_above", F.shiftright("cell", bits))
        down = down.withColumn("_before", before(group, "_above"))
        joined = down.join(up, (F.col(group) == F.col("_g")) & F.col("_above").eqNullSafe(F.col("_up")))
        starts = joined.select(group, "cell", (F.col("start") + F.col("_before")).alias("start"))
    starts = cut(starts.select(F.col(group).alias("_g"), F.col("cell").alias("_of"), "start"), "manifest-starts")
    placed = rows.withColumn("_cell", cell).join(starts, (F.col(group) == F.col("_g")) & F.col("_cell").eqNullSafe(F.col("_of")))
    place = F.row_number().over(W.partitionBy(group, "_cell").orderBy(F.col(key).asc_nulls_first(), ties))
    return placed.withColumn(name, F.col("start") + place - 1).drop("_g", "_of", "_cell", "start")


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n = -(-n // fanout)
        levels += 1
    return levels


def block_levels(digests: list[str], n: int, fanout: int, most: int) -> list[list[str]]:
    """The nodes of a block level by level, its own first: as many levels as a block has, or as the ``n`` nodes of its group have yet."""
    levels = [digests]
    for _ in range(min(most, _depth(n, fanout))):
        below = levels[-1]
        levels.append([_sha(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _steps(levels: list[list[str]], at: int, fanout: int) -> list[dict]:
    """Siblings before and after a node of the block on its way up."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append({"before": "".join(nodes[first:at]), "after": "".join(nodes[at + 1 : first + fanout])})
        at //= fanout
    return out


def _up(nodes: DataFrame, fanout: int, most: int) -> DataFrame:
    """``(g, idx, n, h)`` of the blocks of ``(g, idx, n, h)``."""
    width = fanout**most

    def reduced(key, table):
        g, block = (k.as_py() for k in key)
        table = table.sort_by("idx")
        n = table["n"][0].as_py()
        top = block_levels(table["h"].to_pylist(), n, fanout, most)[-1]
        return pa.table({"g": [g], "idx": [block], "n": [-(-n // width)], "h": top})

    blocks = nodes.select("g", F.expr(f"idx div {width}").alias("block"), "idx", "n", "h")
    return blocks.groupBy("g", "block").applyInArrow(reduced, "g long, idx long, n long, h string")


def _down(nodes: DataFrame, above: DataFrame, fanout: int, most: int) -> DataFrame:
    """``nodes`` with the path of each: the way through its block, then the block's own of ``above`` ``(g, idx, path, subroot, root)``."""
    width = fanout**most
    fields = [f for f in nodes.schema if f.name not in ("n",)]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [_PATH])

    def placed(key, table, parent):
        table = table.sort_by("idx")
        levels = block_levels(table["h"].to_pylist(), table["n"][0].as_py(), fanout, most)
        rest, subroot, root = (parent[c][0].as_py() for c in ("path", "subroot", "root"))
        paths = pa.array([_steps(levels, i, fanout) + rest for i in range(table.num_rows)], _STEPS)
        same = lambda v: pa.array([v] * table.num_rows, pa.string())
        return table.select(names).append_column("path", paths).append_column("subroot", same(subroot)).append_column("root", same(root))

    below = nodes.withColumn("_block", F.expr(f"idx div {width}"))
    return below.groupBy("g", "_block").cogroup(above.select("g", F.col("idx").alias("_block"), "path", "subroot", "root").groupBy("g", "_block")).applyInArrow(placed, schema)


def _stages(nodes: DataFrame, largest: int, fanout: int, most: int) -> list[DataFrame]:
    """The tables of nodes of all stages; the last has one node for each group."""
    stages, width = [nodes], fanout**most
    while largest > 1:
        stages.append(cut(_up(stages[-1].select("g", "idx", "n", "h"), fanout, most), "manifest-nodes"))
        largest = -(-largest // width)
    return stages


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", fanout: int = 2, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``(key, group, idx, leaf, *carry, subroot, root, proof)``: one row per row of ``docs``.

    A leaf is the digest of a row's ``fields``. The leaves of a group ascend by
    ``key``; every ``fanout`` of them become their digest until one remains, the
    subroot. The subroots, ordered by group, lead to the root in the same way.
    ``proof`` has one step ``(before, after)`` for each level up to the root: the
    digests of the siblings on both sides, which may be empty.

    Null keys come first in their group and null groups before all others; rows of
    equal key are ordered by their leaf, so repeated rows have places of their own
    side by side. Fields may be null, empty or very long. Other columns are
    ignored, whatever their names, but for those named in ``carry``, which are
    passed on and must not be called like an added one. An empty table has no rows.
    """
    most = 1
    while fanout ** (most + 1) <= block:
        most += 1
    kept = [f"c{i}" for i in range(len(carry))]
    leaves = docs.select(F.struct(F.col(group).isNotNull().alias("there"), F.col(group).alias("value")).alias("of"), F.col(key).cast("long").alias("id"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("h"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])
    leaves = cut(leaves, "manifest-leaves")
    groups = cut(numbered(leaves.groupBy("of").agg(F.count(F.lit(1)).alias("n")), "of", "g"), "manifest-groups")
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = leaves.join(groups.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of"))).drop("_of")
    nodes = cut(ranked(rows, "g", "id", "h"), "manifest-ranked")
    stages = _stages(nodes, largest, fanout, most)
    tops = stages[-1].select("g", F.col("h").alias("subroot"))
    over = _stages(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("h")), n_groups, fanout, most)
    way = over[-1].select("g", "idx", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    for stage in reversed(over[:-1]):
        way = _down(stage, way, fanout, most)
    way = way.select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "path", "root").join(tops, "g").select("g", "idx", "path", "subroot", "root")
    way = cut(way, "manifest-path")
    for stage in reversed(stages[:-1]):
        way = _down(stage, way, fanout, most)
    if len(stages) == 1:  # groups of one leaf each
        way = nodes.join(way.drop("idx"), "g")
    return way.select(F.col("id").alias(key), F.col("of.value").alias(group), "idx", F.col("h").alias("leaf"), *[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "subroot", "root", F.col("path").alias("proof"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its leaf leads to when some rows are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.when(altered, F.try_add(F.col(f), F.lit(1))) if f == "n_chars" else F.col(f) for f in FIELDS]
    rows = docs.select(*FIELDS, F.when(altered, leaf_digest(*fields)).alias("altered"))
    made = manifest(rows, carry=("altered",))
    folded = made.withColumns({"proof_sha256": proof_digest(F.col("proof")), "folded_root": fold(F.coalesce("altered", "leaf"), F.col("proof"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce([4294967295] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) AS crc
  FROM documents
), d AS (
  SELECT documents.*, crc.crc % 7 = 0 AS altered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, lang, idx, n, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
    CASE WHEN altered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) END AS altered_leaf
  FROM d
), up AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, max(n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lang, level, idx // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, max(n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
  SELECT l.doc_id, u.level, CASE WHEN u.idx < (l.idx >> u.level) THEN u.h END AS before, CASE WHEN u.idx > (l.idx >> u.level) THEN u.h END AS after
  FROM leaves l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.n > 1 AND u.idx // 2 = l.idx >> (u.level + 1)
  UNION ALL
  SELECT l.doc_id, 1000 + t.level, CASE WHEN t.idx < (s.idx >> t.level) THEN t.h END, CASE WHEN t.idx > (s.idx >> t.level) THEN t.h END
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n > 1 AND t.idx // 2 = s.idx >> (t.level + 1)
), way AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step, coalesce(max(before), '') AS before, coalesce(max(after), '') AS after
  FROM steps GROUP BY doc_id, level
), folded AS (
  SELECT doc_id, 0 AS step, coalesce(altered_leaf, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(w.before || f.h || w.after) FROM folded f JOIN way w ON w.doc_id = f.doc_id AND w.step = f.step + 1
), proofs AS (
  SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY doc_id
), ends AS (
  SELECT doc_id, arg_max(h, step) AS folded_root FROM folded GROUP BY doc_id
), root AS (
  SELECT h AS root FROM top WHERE n = 1
)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root r LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN ends e ON e.doc_id = l.doc_id
"""
