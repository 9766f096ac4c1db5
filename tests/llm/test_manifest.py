"""The Merkle manifest against a plain version."""

import hashlib

import pytest
from pyspark.sql import functions as F

from phyllo.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes, fanout):
    """(root, siblings of every node level by level as (before, after))."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j, under in enumerate(spans[at : at + fanout]):
                for i in under:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(_h(*run))
            above.append([i for under in spans[at : at + fanout] for i in under])
        nodes, spans = up, above
    return nodes[0], paths


def plain(rows, fanout=2):
    """Sorted (doc_id, lang, idx, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0], _h(*map(_field, r))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        leaves = sorted(langs[lang], key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append((leaves, *_tree([x[2] for x in leaves], fanout)))
    root, over = _tree([t[1] for t in trees], fanout)
    return sorted(((i, lang, at, leaf, sub, root, paths[at] + over[g]) for g, (lang, (leaves, sub, paths)) in enumerate(zip(order, trees, strict=True)) for at, (_, i, leaf) in enumerate(leaves)), key=repr)


def made(df, **how):
    return sorted(((r["doc_id"], r["lang"], r["idx"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]]) for r in merkle.manifest(df, **how).collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 3), (5, 30)])
def test_manifest_equals_a_plain_tree(spark, fanout, block):
    ids = [*range(37), 2**62, -(2**63), 2**63 - 1, -5, *range(10**6, 10**6 + 9), None, None]
    rows = [(i, f"s{n % 3}", (None, "en", "é", "de")[n % 4] if n % 9 else "once", n if n % 5 else None, None if n % 11 == 0 else "t" * n + "ü\n") for n, i in enumerate(ids)]
    rows += [rows[3], rows[3], (7, None, None, None, None), (8, "", "alone", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert made(df, fanout=fanout, block=block) == plain(rows, fanout)
    folded = merkle.manifest(df, fanout=fanout, block=block).select(merkle.fold(F.col("leaf"), F.col("proof")).alias("f"), "root", merkle.fold(merkle.digest(F.lit("x")), F.col("proof")).alias("wrong"))
    assert all(r["f"] == r["root"] != r["wrong"] for r in folded.collect())


def test_manifest_of_small_and_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert made(empty) == []
    one = [(1, "a", "en", 3, "abc")]
    assert made(spark.createDataFrame(one, SCHEMA)) == plain(one)
    long = [(i, "a", "en", 1, "word " * 300_000) for i in range(3)]
    df = spark.createDataFrame(long, SCHEMA)
    assert made(df) == plain(long)
    clash = df.selectExpr("*", "'x' AS g", "'y' AS idx", "1 AS n", "'h' AS h", "'p' AS path", "'r' AS root", "'c' AS c0", "'q' AS mark")
    assert made(clash) == plain(long) and [r["mark"] for r in merkle.manifest(clash, carry=("mark",)).collect()] == ["q"] * 3


def test_op12_equals_a_plain_version(spark, sf):
    import zlib

    got = {r["doc_id"]: r for r in merkle.op12_merkle_manifest(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    by_id = {r[0]: r for r in rows}
    for i, _, _, leaf, sub, root, path in plain(rows):
        r, bad = got[i], zlib.crc32(str(i).encode()) % 7 == 0
        node = _h(*map(_field, (*by_id[i][:3], by_id[i][3] + 1, by_id[i][4]))) if bad else leaf
        for before, after in path:
            node = _h(before, node, after)
        assert (r["leaf"], r["subroot"], r["root"], r["folded_root"], r["verified"]) == (leaf, sub, root, node, not bad)
        assert r["proof_sha256"] == _h(*[b + a for b, a in path])
    assert len(got) == len(rows)
