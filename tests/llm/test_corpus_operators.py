"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force where SQL has no say."""

import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phyllo.llm import bpe, imatch, line_dedup, mixing, pii, quality, quality_rules, registry, simhash, token_tree, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, word string, n_lines long, text_key string, part int"
LONG = "long words of a very long text, number 17. " * 6000
BOILER = "All rights of this site are reserved here."


def doc(i, text, source="s1"):
    return (i, text, "en", source, None if text is None else len(text), 0.5, 7, "w", 3, "k", 1)


ROWS = [
    doc(1, "a small text with one line of words\n" + BOILER),
    doc(2, "another small text, of other words\n" + BOILER, "s2"),
    doc(3, "a third one that is on a third site\n" + BOILER, "s3"),
    doc(4, "and the fourth, which says\n" + BOILER + "\n" + BOILER, "s4"),
    doc(5, "fifth " + BOILER + "\n" + BOILER, "s5"),
    doc(6, None),
    doc(7, ""),
    doc(8, " \n\t\n", None),
    doc(9, LONG, None),
    doc(9, LONG, None),
    doc(10, LONG),
    doc(None, "no id but words enough for a line", "s2"),
    doc(None, None, None),
    (11, "null in every other column", *[None] * 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df, *columns):
    return sorted(map(tuple, df.select("doc_id", *columns).collect()), key=str)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_imatch(docs, empty):
    got = imatch.fingerprint_documents(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (k, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        want.append((k, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    marks = [r["fingerprint"] for r in got if r["doc_id"] in (9, 10)]
    assert len(set(marks)) == 1 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert imatch.fingerprint_documents(empty).count() == 0


def test_imatch_over_many_ranges(spark):
    texts = [(i * 3 % 101, f"text {i} of {i % 7} words") for i in range(101)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = by_id(imatch.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    of = dict(texts)
    for i in range(101):
        text, after = of[i], of[(i + 1) % 101]
        half = len(text) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["near_next"] == imatch.likeness(got[i]["fingerprint"], got[(i + 1) % 101]["fingerprint"])


def test_document_frequencies(docs):
    want: dict[int, int] = {}
    for r in ROWS:
        for t in set(imatch.TERM.findall((r[1] or "").lower())):
            h = imatch._hash(t)
            want[h - (1 << 64) if h >> 63 else h] = want.get(h - (1 << 64) if h >> 63 else h, 0) + 1
    assert {r["term"]: r["df"] for r in imatch.document_frequencies(docs).collect()} == want


def test_token_counts(docs, empty):
    edits = F.when(F.col("doc_id") != 7, F.array(F.struct(F.lit(0).alias("at"), F.lit(5).alias("until"), F.lit("X y").alias("new")), F.struct(F.lit(10**6).alias("at"), F.lit(0).alias("until"), F.lit(None).cast("string").alias("new"))))
    got = token_tree.edited_counts(docs.withColumn("edits", edits)).collect()
    coder = bpe.Encoder(bpe.load_ranks(bpe.public_tokenizers.path(bpe.RANKS)))
    count = lambda t: sum(coder.counts(coder.split(t)))
    assert len(got) == len(ROWS)
    assert sorted(r["n_tokens"] for r in got) == sorted(count(x[1] or "") for x in ROWS)
    for r in got:
        if r["n_edits"]:
            text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
            assert r["edited_tokens"] == count("X y" + text[5:])
    assert token_tree.edited_counts(empty.withColumn("edits", edits)).count() == 0


def test_quality(docs, empty, labels):
    got = quality.classify(docs, labels)
    assert got.columns.count("score") == 1 and ids(got, "text") == ids(docs, "text")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.collect())
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.is_held_out("doc_id").alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items() if i is not None) and held[None] is False


def test_quality_holds_out_and_generalises(spark, sf):
    got = registry.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 1000 and (held.predicted == held.quality).mean() > 0.95


def _components(words, radius):
    home = {w: w for w in words}
    changed = True
    while changed:
        changed = False
        for a in words:
            for b in words:
                if (a ^ b).bit_count() <= radius and home[b] < home[a]:
                    home[a], changed = home[b], True
    return home


def test_simhash(docs, empty):
    got = simhash.near_components(docs).collect()
    word = lambda w: w & (1 << 64) - 1
    home = _components({word(r["word"]) for r in got}, 4)
    least = {}
    for r in got:
        h = home[word(r["word"])]
        least[h] = min((x for x in (least.get(h), r["doc_id"]) if x is not None), default=None)
    assert len(got) == len(ROWS) and all(r["component_id"] == least[home[word(r["word"])]] for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7, 8)} == {6} and {r["component_id"] for r in got if r["doc_id"] in (9, 10)} == {9}
    assert simhash.near_components(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 9, 11]


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_simhash_links_by_any_blocks(spark, blocks):
    import random

    r = random.Random(blocks)
    seeds = [r.getrandbits(64) for _ in range(30)]
    words = {s ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}) for s in seeds for _ in range(6)}
    df = spark.createDataFrame([(w - (1 << 64) if w >> 63 else w,) for w in words], "word long")
    links = [(a["src"] & (1 << 64) - 1, a["dst"] & (1 << 64) - 1) for a in simhash.near_links(df, 4, blocks).collect()]
    up = {w: w for w in words}

    def top(w):
        while up[w] != w:
            w = up[w]
        return w

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert {w: top(w) for w in words} == _components(words, 4)
    assert all((a ^ b).bit_count() <= 64 for a, b in links) and len(links) <= 70 * len(words)


def test_simhash_query_equals_brute_force(spark, sf):
    got = registry.QUERIES["op4_simhash_near_dedup"](spark, sf).toPandas().set_index("doc_id")
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    words = {i: simhash.fingerprint(t.encode(), 4) for i, t in texts.items()}
    home = _components(set(words.values()), 4)
    least = {}
    for i in sorted(words):
        least.setdefault(home[words[i]], i)
    assert all(got.fingerprint[i] == f"{w:016x}" and got.component_id[i] == least[home[w]] for i, w in words.items())


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_removed"} and got.count() == len(ROWS)
    rows = by_id(got.where("doc_id IS NOT NULL"))
    assert rows[1]["text"].endswith(BOILER) and rows[1]["n_removed"] == 0
    assert [rows[i]["n_removed"] for i in (2, 3, 4)] == [1, 1, 2] and rows[4]["text"] == "and the fourth, which says"
    assert rows[5]["text"] == "fifth " + BOILER and rows[6]["text"] is None and rows[6]["n_lines"] == 0 and rows[9]["text"] == LONG
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_sites_near_the_threshold_are_counted_exactly(spark):
    line = "one line of {} words that many sites show"
    rows = [(i * 100 + s, line.format(i), f"site{s}") for i in range(1, 40) for s in range(i)]
    lines = line_dedup._lines_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert line_dedup.boilerplate(lines).count() == 39 - line_dedup.SITES + 1


def test_bpe(docs, empty):
    got = bpe.encode(docs)
    assert got.count() == len(ROWS) and "text" not in got.columns
    for r in got.collect():
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
    of = {r["decoded_sha256"] for r in got.collect()}
    assert of == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS}
    assert bpe.encode(empty).count() == 0


def test_quality_rules(docs, empty):
    hosted = docs.withColumnRenamed("source", "host")
    got = quality_rules.judge(hosted).collect()
    assert len(got) == len(ROWS) and quality_rules.judge(hosted.limit(0)).count() == 0
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (6, 7, 8))


def test_quality_rules_reject_depleted_documents(spark):
    common, more = (" ".join(f"{c}{k}" for k in range(30)) for c in ("common", "more"))
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    rows = [(i, f"{own(i)}\n{common}\n{more}", "h") for i in range(quality_rules.MOST_DOCS + 1)]
    rows += [(500, f"{own(500)} {own(501)}\n{common}", "h"), (501, f"{own(502)}\n{common}", "other")]
    rows += [(600 + i, f"{own(700)} {own(701)}", "h") for i in range(50)]  # exact copies count once
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, host string")))
    assert not any(got[i]["kept"] for i in range(quality_rules.MOST_DOCS + 1)) and not got[0]["base_failed"]
    assert got[500]["kept"] and got[501]["kept"] and all(got[600 + i]["kept"] for i in range(50))


def test_mixing(docs, empty):
    got = mixing.plan_mix(docs).apply(docs)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in rows) and all(r["copies"] == 0 for r in rows if r["doc_id"] in (6, 7, 8))
    assert sorted(mixing.mix(docs).collect(), key=str) == sorted(mixing.mix(docs).collect(), key=str)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_a_mix_takes_few_jobs(spark, docs):
    """Every job leaves buffers of some MB on the driver, so their number is what a mix costs it: 51 before totals came from the ranges' sums and sources carried what is known of them."""
    jobs = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    before = jobs()
    mixing.mix(docs).write.format("noop").mode("overwrite").save()
    assert jobs() - before <= 40


def test_mixing_comes_near_its_targets(spark):
    got = registry.QUERIES["op8_pareto_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and (g.taken <= 2 * g["size"]).all()
    assert abs(got.groupby("source").target.first().sum() - 1.5 * got["size"].sum()) < 1


def test_source_targets_by_repeated_sharing(spark):
    import random

    r = random.Random(4)
    for n in (1, 2, 7, 25):
        sizes = [(f"s{i:03d}" if i else None, r.choice([0, 1, 10, 500, 100000]), 1.0) for i in range(n)]
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long, damped double")).collect()}
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0]))
        weight = {s[0]: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        cap = {s[0]: 2 * s[1] for s in sizes}
        target, left, free = dict.fromkeys(cap, 0.0), 1.5 * sum(s[1] for s in sizes), set(cap)
        while free and left > 1e-9:
            total = sum(weight[s] for s in free)
            for s in free:
                target[s] += left * weight[s] / total
            left = sum(max(0, target[s] - cap[s]) for s in free)
            full = {s for s in free if target[s] >= cap[s]}
            target |= {s: float(cap[s]) for s in full}
            free -= full
        assert all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in cap)


def test_warc(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "u", big, 1), (2, "u\r\n2", big, 1), (3, None, "small", 1), (4, "u", "small", 1), (5, "u", None, 1), (6, "u", big + "é", 1), (None, "u", big, 1)], "page_id long, url string, html string, payload int")
    folder = warc.shared_path(spark, "warc-test")
    manifest = warc.write_archives(warc.with_revisits(pages.drop("payload")), folder)
    read = warc.read_archives(spark, folder, manifest)
    rows = {r["record_id"]: r for r in read.collect()}
    assert len(rows) == 7 and all(r["gap_reason"] is None for r in rows.values())
    kind = {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in rows.items()}
    assert kind["<urn:x-page:1>"] == ("revisit", "<urn:x-page:2>", 1500) and kind["<urn:x-page:2>"] == ("response", None, 1500)
    assert kind["<urn:x-page:3>"][0] == kind["<urn:x-page:4>"][0] == "response" and kind["<urn:x-page:5>"] == ("response", None, 0)
    assert bytes(rows["<urn:x-page:6>"]["payload"]).decode() == big + "é" and kind["<urn:x-page:>"][0] == "revisit"
    assert manifest.agg(F.sum("records")).first()[0] == 7
    none = warc.write_archives(warc.with_revisits(pages.drop("payload").limit(0)), folder + "-empty")
    assert none.count() == 0


def test_pii(docs, empty, spark):
    assert pii.pseudonymise(empty, b"tests").count() == 0 and pii.pseudonymise(docs, b"tests").count() == len(ROWS)
    rows = spark.createDataFrame([(1, "call +1 (017) 555-7713 now", 26), (2, "+1 (017) 555-7713", 17), (3, None, None), (4, "plain", 5)], "doc_id long, text string, n_chars int")
    got = by_id(pii.pseudonymise(rows, b"tests"))
    assert got[1]["text"] == f"call {got[2]['text']} now" and got[1]["n_phone"] == 1 and got[3]["text"] is None and got[4]["text"] == "plain" and got[4]["n_pii"] == 0


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = docs.toPandas()
    scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    left = table[table.doc_id.isin(scored[scored.predicted == 1].doc_id)]
    sites: dict[bytes, set] = {}
    keeper: dict[bytes, int] = {}
    for i, text, source in zip(left.doc_id, left.text, left.source, strict=True):
        for line in text.split("\n"):
            words = line.encode().lower().split()
            if len(words) >= line_dedup.LEAST_WORDS:
                norm = b" ".join(words)
                sites.setdefault(norm, set()).add(source)
                keeper[norm] = min(keeper.get(norm, i), i)
    cleaned = {}
    for i, text in zip(left.doc_id, left.text, strict=True):
        lines, seen = [], set()
        for line in text.split("\n"):
            norm = b" ".join(line.encode().lower().split())
            if len(sites.get(norm, ())) >= line_dedup.SITES and (keeper[norm] != i or norm in seen):
                continue
            seen.add(norm)
            lines.append(line)
        cleaned[i] = "\n".join(lines)
    sets = {i: frozenset(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in cleaned.items()}
    home = {i: i for i in sets}

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for j in sets:
        for i in sets:
            both = len(sets[i] & sets[j])
            if i < j and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                home[b] = a
    kept = sorted({top(i) for i in sets})
    rows = spark.createDataFrame([(i, cleaned[i], table.set_index("doc_id").source[i]) for i in kept], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(rows).apply(rows).collect()}
    want = sorted((i, hashlib.sha256(cleaned[i].encode()).hexdigest()) for i in kept for _ in range(copies[i]))
    assert sorted(zip(got.doc_id, got.decoded_sha256, strict=True)) == want and len(want)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
