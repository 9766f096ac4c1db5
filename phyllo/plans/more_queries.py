"""Further registered queries: scalars, filters, joins, votes, crops, refinement and clustering, with their DuckDB SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.functions import colors, scalars
from phyllo.operators import aggregates, clustering, features, filters, fusion, images, kmeans, metrics, phenotype, refine, views
from phyllo.plans import pipelines
from phyllo.plans.catalogue import EDGES_SQL, EMB_SQL, EVENTS_SQL, OVERLAP_SQL, PARTS_SQL, VIEW_SQL, _hits, _points_and_views, events, parts, query, rounded, segments, vectors
from phyllo.session import cut, read_table, spread

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def knn_sql(name: str, points: str, k: int, drop_self: bool = True) -> str:
    """The ``k`` nearest of each point as CTE ``name`` (src, dst, d, r)."""
    own = "WHERE src <> dst" if drop_self else ""
    return f"""{name}_p AS (SELECT a.vid AS src, b.vid AS dst, {DIST} AS d FROM {points} a, {points} b),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM {name}_p {own}) WHERE r <= {k})"""


def dbscan_sql(name: str, points: str, eps: str, least: int) -> str:
    """Density clusters of a cloud as CTE ``name`` (vid, label, is_core); ``{name}_n`` has the pairs."""
    return f"""{name}_n AS (SELECT a.vid AS src, b.vid AS dst FROM {points} a, {points} b WHERE {DIST} <= {eps}),
{name}_c AS (SELECT src AS vid FROM {name}_n GROUP BY src HAVING count(*) >= {least}),
{name}_e AS (SELECT src, dst FROM {name}_n WHERE src IN (SELECT vid FROM {name}_c) AND dst IN (SELECT vid FROM {name}_c)),
{name}_r AS (SELECT vid, vid AS c FROM {name}_c UNION SELECT e.dst, r.c FROM {name}_r r JOIN {name}_e e ON e.src = r.vid),
{name}_l AS (SELECT vid, min(c) AS c FROM {name}_r GROUP BY vid), {name}_h AS (SELECT vid, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM {name}_l),
{name}_b AS (SELECT n.src AS vid, min(h.label) AS label FROM {name}_n n JOIN {name}_h h ON h.vid = n.dst GROUP BY n.src),
{name} AS (SELECT p.vid, coalesce(h.label, b.label, -1) AS label, h.vid IS NOT NULL AS is_core FROM {points} p LEFT JOIN {name}_h h ON h.vid = p.vid LEFT JOIN {name}_b b ON b.vid = p.vid)"""


# Scalars.


@query("SELECT vec_id AS vid, CAST(i AS INTEGER) AS i, round(greatest(0.0, least(1.0, f * 4 * 0.28209479177387814::DOUBLE + 0.5)), 6) AS unit FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS f FROM embeddings)")
def sh_unit(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.posexplode("embedding").alias("i", "f"))
    return rounded(rows.select("vid", "i", scalars.sh_to_unit(F.col("f").cast("double") * 4).alias("unit")))


@query("""WITH e AS (SELECT vec_id AS vid, embedding[1]::DOUBLE * 4 AS f, CAST(vec_id % 256 AS INTEGER) AS own FROM embeddings)
SELECT 'own' AS kind, vid, own::DOUBLE AS red FROM e UNION ALL SELECT 'harmonics', vid, round_even(greatest(0.0, least(1.0, f * 0.28209479177387814::DOUBLE + 0.5)) * 255, 0) FROM e UNION ALL SELECT 'none', vid, 180.0 FROM e""")
def resolved_colors(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), *[(F.col("embedding")[i].cast("double") * 4).alias(f"f_dc_{i}") for i in range(3)])
    own = e.withColumns({c: (F.col("vid") % 256).cast("int") for c in ("red", "green", "blue")})
    kinds = {"own": own, "harmonics": e, "none": e.select("vid")}
    tables = [scalars.resolve_color(df).select(F.lit(k).alias("kind"), "vid", F.col("red").cast("double").alias("red")) for k, df in kinds.items()]
    return tables[0].union(tables[1]).union(tables[2])


@query(f"WITH {PARTS_SQL} SELECT vid, CAST(CASE WHEN vid % 3 = 0 THEN vid % 200 ELSE 180 END AS INTEGER) AS red FROM pt")
def filled_colors(spark, sf):
    p = parts(spark, sf).select("uid", "vid")
    known = p.where("vid % 3 = 0").withColumns({c: (F.col("vid") % 200).cast("int") for c in ("red", "green", "blue")})
    return scalars.fill_color(p, known, ["uid", "vid"]).select("vid", "red")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS m, unnest(CASE s_suppkey % 4 WHEN 0 THEN [0, 1, 2] WHEN 3 THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2, 3] END) AS i, s_acctbal FROM supplier)
SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(s_acctbal + i - CASE WHEN i = CASE m WHEN 1 THEN 2 ELSE 1 END THEN 10 WHEN i = CASE m WHEN 1 THEN 3 ELSE 2 END THEN 20 ELSE 0 END, 6) AS value FROM s""")
def shifted_cameras(spark, sf):
    s = read_table(spark, sf, "supplier")
    n = F.when(F.col("s_suppkey") % 4 == 0, 3).when(F.col("s_suppkey") % 4 == 3, 5).otherwise(4)
    params = F.slice(F.array(*[F.col("s_acctbal") + i for i in range(5)]), 1, n)
    moved = s.select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("m"), params.alias("p")).select("s_suppkey", F.posexplode(scalars.shift_camera("m", "p", F.lit(10), F.lit(20))).alias("i", "value"))
    return rounded(moved)


_TAB20_SQL = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(colors.TAB20))


@query(f"""WITH l AS (SELECT DISTINCT CAST(p_size AS BIGINT) % 40 AS label FROM part), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n, count(*) OVER () AS al FROM l), t AS (SELECT * FROM (VALUES {_TAB20_SQL}) v(i, red, green, blue)),
c AS (SELECT label, least(CAST(floor(CASE WHEN al > 1 THEN n::DOUBLE / (al - 1) ELSE 0 END * 20) AS BIGINT), 19) AS i FROM n)
SELECT label, CASE WHEN label = 0 THEN 220 ELSE red END AS red, CASE WHEN label = 0 THEN 220 ELSE green END AS green, CASE WHEN label = 0 THEN 220 ELSE blue END AS blue FROM c JOIN t USING (i)""")
def label_colors(spark, sf):
    return colors.label_palette(read_table(spark, sf, "part").select((F.col("p_size").cast("long") % 40).alias("label")))


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal > 0 THEN 255 ELSE 173 END AS INTEGER) AS red, CAST(CASE WHEN c_acctbal > 0 THEN 80 ELSE 216 END AS INTEGER) AS green, CAST(CASE WHEN c_acctbal > 0 THEN 80 ELSE 230 END AS INTEGER) AS blue FROM customer")
def mask_colors(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", colors.mask_color(F.col("c_acctbal") > 0).alias("_c")).select("c_custkey", "_c.*")


@query("SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(trunc(value - 60) AS BIGINT) END AS label FROM events")
def float_labels(spark, sf):
    e = read_table(spark, sf, "events")
    hole = F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return e.select("event_id", scalars.label_from_float(F.when(F.col("event_id") % 97 == 0, hole).otherwise(F.col("value") - 60)).alias("label"))


@query("""SELECT c_nationkey, '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}', ',' ORDER BY c_custkey) || ']' AS rows FROM customer GROUP BY c_nationkey""")
def nested_json(spark, sf):
    return read_table(spark, sf, "customer").groupBy("c_nationkey").agg(scalars.nested_json("c_custkey", "c_mktsegment").alias("rows"))


@query("SELECT s_suppkey AS video, CAST(i AS INTEGER) AS i, CAST(round_even(s_suppkey % 10 + i * (500 + s_suppkey - s_suppkey % 10)::DOUBLE / 39, 0) AS BIGINT) AS frame FROM supplier, (SELECT unnest(range(0, 40)) AS i)")
def frame_schedule(spark, sf):
    """Forty frames of a video for each supplier, from its first to its last."""
    k = F.col("s_suppkey")
    return read_table(spark, sf, "supplier").select(k.alias("video"), F.posexplode(scalars.frame_schedule(k % 10, k + 500, 40)).alias("i", "frame"))


@query(f"WITH {PARTS_SQL} SELECT vid, vid % 5 AS label FROM pt WHERE vid % 10 < 9")
def positional_zip(spark, sf):
    p = parts(spark, sf).select("uid", "vid")
    return scalars.positional_zip(p, p.where("vid % 10 < 9").withColumn("label", F.col("vid") % 5)).select("vid", "label")


@query("SELECT p_brand AS uid, count(*) AS n_vertices, count(*) FILTER (WHERE p_size > 2) AS n_labels FROM part GROUP BY p_brand HAVING count(*) <> count(*) FILTER (WHERE p_size > 2)")
def length_mismatches(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("uid"), "p_size")
    return scalars.length_mismatches(p, p.where("p_size > 2"))


@query("""WITH f AS (SELECT p_partkey AS k, s, CASE WHEN p_partkey % 3 = 0 THEN s * 9.0::DOUBLE * (p_partkey % 17 + 1) ELSE 0 END AS a, CASE WHEN p_partkey % 3 = 1 THEN s * 3.0::DOUBLE * (p_partkey % 17 + 1) ELSE 0 END AS b, CASE WHEN p_partkey % 3 = 2 THEN s * 1.0::DOUBLE * (p_partkey % 17 + 1) ELSE 0 END AS c FROM part, (VALUES (-1), (1)) v(s)),
u AS (SELECT k, s, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS c FROM f)
SELECT k, s, round(least(a, 1 - a), 5) AS red, round(least(b, 1 - b), 5) AS green, round(least(c, 1 - c), 5) AS blue FROM u""")
def pca_colors(spark, sf):
    """Features along three axes, so the components are known but for their sign: colours count from either end."""
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("s"))
    size = F.col("s") * (F.col("k") % 17 + 1)
    p = p.withColumn("feat", F.array(*[F.when(F.col("k") % 3 == i, size * w).otherwise(0.0).cast("double") for i, w in enumerate((9.0, 3.0, 1.0))]))
    shown = colors.pca_colors(p)
    return shown.select("k", "s", *[F.round(F.least(F.col(c), 1 - F.col(c)), 5).alias(c) for c in ("red", "green", "blue")])


# Filters, sets and joins.


@query("WITH c AS (SELECT l_suppkey AS mask_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey) SELECT mask_id, n FROM c WHERE n >= 30 AND n <= 0.05 * (SELECT count(DISTINCT l_orderkey) FROM lineitem)")
def mask_sizes(spark, sf):
    cells = read_table(spark, sf, "lineitem").select(F.lit(1).alias("uid"), F.col("l_orderkey").alias("vid"), F.col("l_suppkey").alias("mask_id")).distinct()
    sizes = cells.groupBy("uid").agg(F.count_distinct("vid").alias("n_points"))
    return filters.masks_of_size(cells, sizes, 30, 0.05).select("mask_id", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 >= 3 OR ((c_custkey % 5) / (c_custkey % 17 + 1e-6) > 0.28 AND c_custkey % 5 >= 1)")
def evidence_filter(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("hit_count"), (F.col("c_custkey") % 17).alias("view_count"))
    return c.where(filters.evidence()).select("c_custkey")


@query(f"WITH {EVENTS_SQL} SELECT uid, vid FROM ev WHERE vid % 3 <> 0 OR vid % 6 = 0")
def rejected_plant_points(spark, sf):
    e = events(spark, sf).select("uid", "vid")
    return filters.reject_plant_points(e, e.where("vid % 3 = 0"), e.where("vid % 6 = 0"))


@query("SELECT l_suppkey AS image_id, l_orderkey * 10 + l_linenumber AS spot FROM lineitem WHERE l_linenumber > 2 AND l_partkey % 10 <> 0")
def valid_observations(spark, sf):
    spot = F.struct(F.when(F.col("l_partkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("x"), F.col("l_discount").alias("y"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey") * 10 + F.col("l_linenumber")).otherwise(-1).alias("point3d_id"))
    ims = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.collect_list(spot).alias("points2d"))
    return filters.valid_observations(ims).select("image_id", F.explode("points2d").alias("p")).select("image_id", F.col("p.point3d_id").alias("spot"))


def _images_and_masks(spark, sf):
    s = read_table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("image_id"), F.concat(F.lit("set/Img_"), F.col("s_suppkey").cast("string"), F.lit(".JPG")).alias("name")), s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("/masks/IMG_"), F.col("s_suppkey").cast("string"), F.lit("_mask.png")).alias("path"))


@query("SELECT s_suppkey AS image_id, '/masks/IMG_' || s_suppkey || '_mask.png' AS mask_path FROM supplier WHERE s_suppkey % 2 = 0")
def masks_by_stem(spark, sf):
    return views.masks_of_images(*_images_and_masks(spark, sf))


@query("""WITH i AS (SELECT s_suppkey AS image_id, 'img_' || s_suppkey AS a FROM supplier), m AS (SELECT '/masks/IMG_' || s_suppkey || '_mask.png' AS mask_path, 'img_' || s_suppkey AS b FROM supplier WHERE s_suppkey % 2 = 0)
SELECT min(image_id) AS image_id, mask_path FROM i JOIN m ON contains(a, b) OR contains(b, a) GROUP BY mask_path""")
def masks_by_substring(spark, sf):
    return views.masks_of_images(*_images_and_masks(spark, sf), how="contains")


@query("SELECT DISTINCT p_brand AS uid, 'source' AS missing FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3) UNION ALL SELECT DISTINCT p_brand, 'prediction' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def unmatched_clouds(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("uid"), "p_size")
    return pipelines.unmatched_clouds(p, p.where("p_size < 3"), p.where("p_size > 49"))


@query("SELECT DISTINCT * FROM (SELECT c_nationkey AS uid, unnest([c_custkey % 3, c_custkey % 4 + 2]) AS label FROM customer)")
def label_sets(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("uid"), "c_custkey")
    return aggregates.distinct_labels([F.col("c_custkey") % 3, F.col("c_custkey") % 4 + 2], c)


@query("SELECT 'both' AS kind, c_custkey AS vid FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'any', c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def mask_sets(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("vid"))
    a, b = c.where("vid % 2 = 0"), c.where("vid % 3 = 0")
    return aggregates.mask_intersection(a, b).select(F.lit("both").alias("kind"), "vid").union(aggregates.mask_union(a, b).select(F.lit("any"), "vid"))


@query("WITH s AS (SELECT o_orderpriority AS uid, o_custkey % 12 + 2 AS k, max(o_custkey % 7) AS score FROM orders GROUP BY ALL) SELECT uid, arg_max(k, score * 100 - k) AS best_k, max(score) AS best_score FROM s GROUP BY uid")
def best_k(spark, sf):
    o = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("uid"), (F.col("o_custkey") % 12 + 2).alias("k")).agg(F.max(F.col("o_custkey") % 7).alias("score"))
    return aggregates.best_k(o, keys=("uid",))


@query("WITH c AS (SELECT event_type AS uid, count(*) AS n FROM events GROUP BY event_type) SELECT uid, least(n, 100) AS n, least(n, 100) AS n_distinct, true AS members FROM c")
def sample_counts(spark, sf):
    """Samples of each cloud after a filter that leaves gaps: their size, and whether all rows are of the cloud, once."""
    e = events(spark, sf).select("uid", (F.col("vid") * 3 + 7).alias("vid"))
    drawn = cut(aggregates.sample_rows(e, 100, 7, keys=("uid",)), "drawn")
    known = drawn.join(e, ["uid", "vid"], "left_semi").groupBy("uid").agg(F.count(F.lit(1)).alias("k"))
    return drawn.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vid").alias("n_distinct")).join(known, "uid").select("uid", "n", "n_distinct", (F.col("k") == F.col("n")).alias("members"))


@query("SELECT s_name AS name FROM supplier ORDER BY s_name LIMIT 25")
def limited_views(spark, sf):
    return filters.limit_views(read_table(spark, sf, "supplier").select(F.col("s_name").alias("name")), 25)


@query("SELECT c_nationkey AS uid, c_custkey AS rank, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 8) AS INTEGER) AS batch FROM customer")
def prompt_batches(spark, sf):
    return filters.prompt_batches(read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("uid"), F.col("c_custkey").alias("rank")))


@query(f"WITH {OVERLAP_SQL} SELECT uid, CAST(dense_rank() OVER (PARTITION BY uid ORDER BY gt) - 1 AS INTEGER) AS \"row\", CAST(dense_rank() OVER (PARTITION BY uid ORDER BY pred) - 1 AS INTEGER) AS \"column\", round(iou, 6) AS value FROM iou")
def heatmap(spark, sf):
    return rounded(aggregates.heatmap(metrics.iou_matrix(segments(spark, sf))))


@query(f"WITH {PARTS_SQL} SELECT vid, plane, round(CASE plane WHEN 'yz' THEN y ELSE x END, 6) AS a, round(CASE plane WHEN 'xy' THEN y ELSE z END, 6) AS b FROM pt, (VALUES ('xy'), ('xz'), ('yz')) v(plane)")
def scatter(spark, sf):
    return rounded(aggregates.scatter(parts(spark, sf), 1 << 40).drop("uid"))


# Segmentation metrics.


@query(f"""WITH {OVERLAP_SQL}, h AS (SELECT uid, count(*) FILTER (WHERE iou >= 0.5) AS t5, count(*) FILTER (WHERE iou >= 0.75) AS t7 FROM iou JOIN lf USING (uid, pred) GROUP BY uid),
g AS (SELECT uid, count(DISTINCT gt) AS n_gt FROM iou GROUP BY uid), p AS (SELECT uid, count(*) AS n_pred FROM lf GROUP BY uid)
SELECT uid, round(t5::DOUBLE / n_pred, 6) AS precision50, round(t5::DOUBLE / n_gt, 6) AS recall50, round(2.0::DOUBLE * t5 / (n_pred + n_gt), 6) AS f1_50, round(t7::DOUBLE / n_pred, 6) AS precision75, round(t7::DOUBLE / n_gt, 6) AS recall75, round(2.0::DOUBLE * t7 / (n_pred + n_gt), 6) AS f1_75 FROM g JOIN p USING (uid) JOIN h USING (uid)""")
def seg_instance_f1(spark, sf):
    return rounded(metrics.instance_metrics(segments(spark, sf)).select("uid", "precision50", "recall50", "f1_50", "precision75", "recall75", "f1_75"))


@query(f"""WITH {OVERLAP_SQL}, r AS (SELECT sg.uid, gt, sg.pred FROM sg LEFT JOIN lf ON lf.uid = sg.uid AND lf.pred = sg.pred WHERE gt > 0 OR lf.pred IS NOT NULL), n AS (SELECT uid, gt, pred, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
t AS (SELECT uid, sum(n * (n - 1) / 2) AS both_, sum(n) AS al FROM n GROUP BY uid), g AS (SELECT uid, sum(m * (m - 1) / 2) AS g FROM (SELECT uid, gt, sum(n) AS m FROM n GROUP BY ALL) GROUP BY uid), p AS (SELECT uid, sum(m * (m - 1) / 2) AS p FROM (SELECT uid, pred, sum(n) AS m FROM n GROUP BY ALL) GROUP BY uid)
SELECT uid, round((both_ - g * p / (al * (al - 1) / 2)) / ((g + p) / 2 - g * p / (al * (al - 1) / 2)), 6) AS ari FROM t JOIN g USING (uid) JOIN p USING (uid)""")
def seg_leaf_ari(spark, sf):
    return rounded(metrics.leaf_rand(segments(spark, sf)))


def _assignment_sql() -> str:
    """The best one-to-one assignment of nine instances by growing sets of taken predictions."""
    steps = ["a0 AS (SELECT DISTINCT uid, 0 AS mask, 0.0::DOUBLE AS total, [0] AS taken FROM iou)"]
    for k in range(1, 10):
        steps.append(f"""a{k} AS (SELECT uid, mask, max(total) AS total, arg_max(taken, total) AS taken FROM (
SELECT a.uid, a.mask + CAST(pow(2, i.pred) AS BIGINT) AS mask, a.total + i.iou AS total, list_append(a.taken, i.pred) AS taken FROM a{k - 1} a JOIN iou i ON i.uid = a.uid AND i.gt = {k} WHERE (a.mask // CAST(pow(2, i.pred) AS BIGINT)) % 2 = 0) GROUP BY uid, mask)""")
    best = "b AS (SELECT uid, arg_max(taken, total) AS taken FROM a9 GROUP BY uid), m AS (SELECT uid, unnest(range(1, 10)) AS gt, unnest(taken[2:]) AS pred FROM b)"
    return ", ".join([*steps, best])


@query(f"WITH {OVERLAP_SQL}, {_assignment_sql()} SELECT m.uid, m.gt, m.pred, round(iou.iou, 6) AS iou FROM m JOIN iou ON iou.uid = m.uid AND iou.gt = m.gt AND iou.pred = m.pred")
def seg_hungarian(spark, sf):
    return rounded(metrics.one_to_one(metrics.iou_matrix(segments(spark, sf))))


# Votes, views, crops and pictures.


@query(f"WITH {VIEW_SQL} SELECT uid, vid, count(*) AS view_count, count(*) FILTER (WHERE abs(depth - front) < 0.012 AND (u + v) % 3 > 0) AS hit_count FROM zb GROUP BY uid, vid")
def instance_votes(spark, sf):
    hits = cut(_hits(spark, sf), "hits")
    mask = hits.select("view_id", "v", "u", ((F.col("u") + F.col("v")) % 3).alias("val")).distinct()
    return views.instance_votes(hits, mask)[0]


@query("SELECT l_suppkey AS sp, round(avg((l_linenumber % 4) / (l_linenumber + 1e-6)), 6) AS confidence, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y, round(avg(l_tax), 6) AS z FROM lineitem GROUP BY l_suppkey")
def superpoint_stats(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sp"), (F.col("l_linenumber") % 4).alias("hit_count"), F.col("l_linenumber").alias("view_count"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return rounded(features.superpoint_stats(rows))


@query("SELECT s_suppkey AS sp, CAST(min(s_suppkey) OVER (PARTITION BY s_nationkey) AS BIGINT) AS cluster FROM supplier")
def agglomerated_superpoints(spark, sf):
    """Superpoints of one nation lie together and are seen under one label, so average linkage has to find the nations."""
    s = read_table(spark, sf, "supplier")
    stats = s.select(F.col("s_suppkey").alias("sp"), F.lit(0.5).alias("confidence"), (F.col("s_nationkey") + F.col("s_suppkey") / 1e6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    votes = s.select(F.col("s_suppkey").alias("sp"), F.lit(1).alias("view_id"), (F.col("s_nationkey") + 1).alias("label"))
    found = features.agglomerate(stats, features.superpoint_distances(stats, features.superpoint_views(votes), within=0.04))
    return found.join(found.groupBy("cluster").agg(F.min("sp").alias("first")), "cluster").select("sp", F.col("first").alias("cluster"))


def _crops(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"))
    green = s.select("image_id", *[F.when(F.col("image_id") % 3 > 0, F.lit(v) + F.col("image_id") % 7).alias(n) for n, v in (("left", 5), ("top", 6), ("right", 105), ("bottom", 106))], F.when(F.col("image_id") % 3 == 0, "nothing green").otherwise("").alias("reason"))
    points = s.select("image_id", F.lit(1).cast("long").alias("left"), F.lit(2).cast("long").alias("top"), F.lit(201).cast("long").alias("right"), F.lit(202).cast("long").alias("bottom"), (F.col("image_id") % 90).alias("valid_points"))
    return green, points


@query("""SELECT s_suppkey AS image_id, CASE WHEN s_suppkey % 3 > 0 THEN 5 + s_suppkey % 7 ELSE 1 END AS "left", CASE WHEN s_suppkey % 3 > 0 THEN 106 + s_suppkey % 7 ELSE 202 END AS bottom, s_suppkey % 90 AS valid_points,
CASE WHEN s_suppkey % 3 > 0 THEN 'green' ELSE 'colmap' END AS crop_driver, CASE WHEN s_suppkey % 3 > 0 THEN '' ELSE 'nothing green' END AS fallback_reason FROM supplier""")
def roi_driver(spark, sf):
    return views.roi_driver(*_crops(spark, sf)).select("image_id", "left", "bottom", "valid_points", "crop_driver", "fallback_reason")


@query("""SELECT s_suppkey AS image_id, CAST(s_suppkey AS INTEGER) AS camera_id, round(50.5 - CASE WHEN s_suppkey % 3 > 0 THEN 5 + s_suppkey % 7 ELSE 1 END, 6) AS x, round(300.0 - CASE WHEN s_suppkey % 3 > 0 THEN 5 + s_suppkey % 7 ELSE 1 END, 6) AS cx, round(200.0 - CASE WHEN s_suppkey % 3 > 0 THEN 6 + s_suppkey % 7 ELSE 2 END, 6) AS cy,
CAST(CASE WHEN s_suppkey % 3 > 0 THEN 100 ELSE 200 END AS BIGINT) AS width, s_suppkey % 90 AS valid_colmap_points FROM supplier""")
def cropped_cameras(spark, sf):
    s = read_table(spark, sf, "supplier")
    ims = s.select(F.col("s_suppkey").alias("image_id"), F.lit(1).alias("camera_id"), F.col("s_name").alias("name"), F.array(F.struct(F.lit(50.5).alias("x"), F.lit(60.5).alias("y"), F.lit(7).cast("long").alias("point3d_id"))).alias("points2d"))
    cams = spark.createDataFrame([(1, 1, 640, 480, [500.0, 500.0, 300.0, 200.0])], "camera_id int, model_id int, width long, height long, params array<double>")
    new_images, new_cameras, manifest = views.shift_to_crop(ims, cams, views.roi_driver(*_crops(spark, sf)))
    joined = new_images.join(new_cameras, "camera_id").join(manifest.select("image_id", "valid_colmap_points"), "image_id")
    return rounded(joined.select("image_id", "camera_id", F.col("points2d")[0]["x"].alias("x"), F.col("params")[2].alias("cx"), F.col("params")[3].alias("cy"), "width", "valid_colmap_points"))


@query("""WITH s AS (SELECT l_suppkey % 20 AS view_id, l_partkey % 640 AS u, (l_partkey * 7) % 480 AS v FROM lineitem GROUP BY ALL), b AS (SELECT s_suppkey % 20 AS view_id, s_suppkey AS box_id, (s_suppkey * 37) % 600 AS x1, (s_suppkey * 53) % 440 AS y1, s_suppkey % 61 AS w FROM supplier),
h AS (SELECT b.view_id, b.box_id, median(u) AS x, median(v) AS y FROM b JOIN s ON s.view_id = b.view_id AND u >= x1 AND u < x1 + w AND v >= y1 AND v < y1 + w GROUP BY ALL)
SELECT b.view_id, b.box_id, round(coalesce(h.x, floor((x1 + x1 + w) / 2)), 6) AS px, round(coalesce(h.y, floor((y1 + y1 + w) / 2)), 6) AS py FROM b LEFT JOIN h ON h.view_id = b.view_id AND h.box_id = b.box_id""")
def prompt_points(spark, sf):
    skeleton = read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("view_id"), (F.col("l_partkey") % 640).alias("u"), (F.col("l_partkey") * 7 % 480).alias("v")).distinct()
    s, w = read_table(spark, sf, "supplier"), F.col("s_suppkey") % 61
    x, y = F.col("s_suppkey") * 37 % 600, F.col("s_suppkey") * 53 % 440
    boxes = s.select((F.col("s_suppkey") % 20).alias("view_id"), F.col("s_suppkey").alias("box_id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2"))
    return rounded(refine.prompt_points(boxes, skeleton))


@query("""WITH m AS (SELECT s_suppkey // 100 * 10 + s_suppkey % 10 AS view_id, s_suppkey AS rank, s_suppkey % 9 + 2 AS side, s_suppkey % 100 // 10 AS place FROM supplier), k AS (SELECT view_id, rank, side, place, row_number() OVER (PARTITION BY view_id ORDER BY rank) AS leaf_id FROM m WHERE side * side >= 15 AND side * side <= 0.06 * 60 * 140)
SELECT view_id, CAST(y AS BIGINT) AS v, CAST(place * 12 + x AS BIGINT) AS u, CAST(leaf_id AS INTEGER) AS leaf_id FROM k, (SELECT unnest(range(0, 60)) AS y), (SELECT unnest(range(0, 12)) AS x) WHERE y < side AND x < side""")
def painted_leaves(spark, sf):
    """Squares side by side, each with five pixels and more of a skeleton that has many others: those of a fitting size are painted in their order."""
    m = spread(read_table(spark, sf, "supplier")).select((F.floor(F.col("s_suppkey") / 100) * 10 + F.col("s_suppkey") % 10).alias("view_id"), F.col("s_suppkey").alias("rank"), (F.col("s_suppkey") % 9 + 2).alias("side"), F.floor(F.col("s_suppkey") % 100 / 10).alias("place"))
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)).alias(c)
    pixels = m.select("*", axis("v")).select("*", axis("x")).select("view_id", "rank", "v", (F.col("place") * 12 + F.col("x")).alias("u"))
    rest = spread(m.select("view_id").distinct(), 100).select("view_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(139).cast("long"))).alias("u")).select("view_id", F.explode(F.sequence(F.lit(20).cast("long"), F.lit(59).cast("long"))).alias("v"), "u")
    sizes = m.select("view_id").distinct().withColumns({"height": F.lit(60), "width": F.lit(140)})
    return refine.paint_leaves(pixels, pixels.select("view_id", "v", "u").unionByName(rest), sizes)


SIDE = 12


def _pictures(spark, sf, shift: int = 0) -> DataFrame:
    """One grey picture for each supplier, by a rule of its key."""
    pixel = lambda p: (F.col("s_suppkey") * 7 + F.floor(p / SIDE) * 13 + (p % SIDE) * 29 + F.floor(p / SIDE) * (p % SIDE) * F.col("s_suppkey") + shift * p) % 256
    spelled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda p: F.lpad(F.hex(pixel(p).cast("long")), 2, "0")), "")
    return spread(read_table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.unhex(spelled).alias("pixels"))


def _pixel_sql(name: str, shift: int = 0) -> str:
    return f"{name} AS (SELECT s_suppkey AS k, s_name, p // {SIDE} AS i, p % {SIDE} AS j, ((s_suppkey * 7 + (p // {SIDE}) * 13 + (p % {SIDE}) * 29 + (p // {SIDE}) * (p % {SIDE}) * s_suppkey + {shift} * p) % 256) / 255.0::DOUBLE AS g FROM supplier, (SELECT unnest(range(0, {SIDE * SIDE})) AS p))"


@query(f"""WITH {_pixel_sql('x')}, {_pixel_sql('y', 3)}, w AS (SELECT x.s_name AS name, a.i AS wi, b.j AS wj, avg(x.g) AS mx, avg(y.g) AS my, var_samp(x.g) AS vx, var_samp(y.g) AS vy, covar_samp(x.g, y.g) AS c FROM x JOIN y ON y.k = x.k AND y.i = x.i AND y.j = x.j
JOIN (SELECT unnest(range(0, {SIDE - 6})) AS i) a ON x.i BETWEEN a.i AND a.i + 6 JOIN (SELECT unnest(range(0, {SIDE - 6})) AS j) b ON x.j BETWEEN b.j AND b.j + 6 GROUP BY ALL)
SELECT name, round(avg((2 * mx * my + 0.0001::DOUBLE) * (2 * c + 0.0009::DOUBLE) / ((mx * mx + my * my + 0.0001::DOUBLE) * (vx + vy + 0.0009::DOUBLE))), 6) AS ssim FROM w GROUP BY name""")
def ssim(spark, sf):
    return rounded(images.ssim_by_name(_pictures(spark, sf), _pictures(spark, sf, 3)))


_MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > {SIDE - 1} THEN {2 * SIDE - 2} - ({c}) ELSE {c} END"


@query(f"""WITH {_pixel_sql('x')}, o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj)),
s AS (SELECT c.k, c.i, c.j, sum(n.g * dj * (2 - abs(di))) AS sx, sum(n.g * di * (2 - abs(dj))) AS sy, sum(n.g * CASE WHEN di = 0 AND dj = 0 THEN -4 WHEN di = 0 OR dj = 0 THEN 1 ELSE 0 END) AS l FROM x c CROSS JOIN o JOIN x n ON n.k = c.k AND n.i = {_MIRROR('c.i + di')} AND n.j = {_MIRROR('c.j + dj')} GROUP BY ALL)
SELECT k AS image_id, round(0.5 * (avg(sqrt(sx * sx + sy * sy)) + avg(abs(l))), 6) AS edge FROM s GROUP BY k""")
def edge_strength(spark, sf):
    return rounded(images.per_image(_pictures(spark, sf), {"edge": images.edge_strength}))


# Clusters, components and refinement.


@query(f"WITH RECURSIVE {PARTS_SQL}, ep AS (SELECT greatest(0.02 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 1e-6) AS e FROM pt), {dbscan_sql('db', 'pt', '(SELECT e FROM ep)', 10)} SELECT 'p' AS uid, round(coalesce(max(n) FILTER (WHERE label >= 0), 0)::DOUBLE / sum(n), 6) AS main_component_ratio FROM (SELECT label, count(*) AS n FROM db GROUP BY label)")
def main_component_ratio(spark, sf):
    return rounded(metrics.main_component_ratio(parts(spark, sf)))


_EIGEN_SQL = """cv AS (SELECT src, covar_samp(p.x, p.x) AS xx, covar_samp(p.x, p.y) AS xy, covar_samp(p.x, p.z) AS xz, covar_samp(p.y, p.y) AS yy, covar_samp(p.y, p.z) AS yz, covar_samp(p.z, p.z) AS zz FROM kn JOIN pt p ON p.vid = kn.dst GROUP BY src),
qp AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), pp AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM qp),
rr AS (SELECT *, ((xx - q) / p * ((yy - q) / p * (zz - q) / p - yz / p * yz / p) - xy / p * (xy / p * (zz - q) / p - yz / p * xz / p) + xz / p * (xy / p * yz / p - (yy - q) / p * xz / p)) / 2 AS r FROM pp),
ei AS (SELECT src, CASE WHEN p = 0 THEN q ELSE q + 2 * p * cos(acos(greatest(-1.0, least(1.0, r))) / 3 + 2 * pi() / 3) END AS e FROM rr)"""


@query(f"WITH {PARTS_SQL}, {knn_sql('kn', 'pt', 8, False)}, {_EIGEN_SQL} SELECT 'p' AS uid, round(median(sqrt(greatest(e, 0.0))), 4) AS local_thickness_median FROM ei")
def local_thickness(spark, sf):
    out = metrics.local_thickness(parts(spark, sf), 8)
    return out.select("uid", F.round("local_thickness_median", 4).alias("local_thickness_median"))


SOR_SQL = f"{knn_sql('kk', 'pt', 9, False)}, sc AS (SELECT src AS vid, avg(d) AS s FROM kk WHERE r > 1 GROUP BY src), kp AS (SELECT * FROM pt WHERE vid IN (SELECT vid FROM sc WHERE s <= (SELECT avg(s) + 2 * stddev_pop(s) FROM sc)))"


@query(f"WITH {PARTS_SQL}, {SOR_SQL} SELECT vid FROM kp")
def sor_std_keep(spark, sf):
    return clustering.sor_std(parts(spark, sf), 8).select("vid")


@query(f"""WITH RECURSIVE {PARTS_SQL}, {SOR_SQL}, {knn_sql('k8', 'kp', 8)}, ep AS (SELECT 2.5 * median(d) AS e FROM k8), {dbscan_sql('db', 'kp', '(SELECT e FROM ep)', 10)},
cn AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS al FROM db GROUP BY label), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS r FROM cn WHERE label >= 0), ch AS (SELECT kp.* FROM kp JOIN db USING (vid) WHERE label IN (SELECT label FROM rk WHERE r = 1 OR (r <= 5 AND n >= 0.01 * al)) OR NOT EXISTS (SELECT 1 FROM rk))
SELECT DISTINCT a.vid FROM kp a, ch b WHERE {DIST} <= (SELECT e FROM ep)""")
def denoise_flow(spark, sf):
    return pipelines.denoise_cloud(parts(spark, sf), 8).select("vid")


MAD_SQL = f"{knn_sql('kk', 'pt', 8)}, sc AS (SELECT src AS vid, avg(d) AS s FROM kk GROUP BY src), st AS (SELECT med, (SELECT median(abs(s - med)) FROM sc) AS mad FROM (SELECT median(s) AS med FROM sc)), kp AS (SELECT * FROM pt WHERE vid IN (SELECT vid FROM sc, st WHERE s <= med + 3 * 1.4826::DOUBLE * mad))"


@query(f"""WITH RECURSIVE {PARTS_SQL}, {MAD_SQL}, {dbscan_sql('db', 'kp', '8', 5)}, bg AS (SELECT label FROM db WHERE is_core GROUP BY label HAVING count(*) >= 20),
ok AS (SELECT vid FROM db WHERE is_core AND label IN (SELECT label FROM bg) UNION SELECT n.src FROM db_n n JOIN db ON db.vid = n.dst WHERE db.is_core AND db.label IN (SELECT label FROM bg)) SELECT vid, vid IN (SELECT vid FROM ok) AS keep FROM pt""")
def plant_keep(spark, sf):
    return clustering.plant_keep(parts(spark, sf), 8, 3.0, 8.0, 5, 20).select("vid", "keep")


THIRDS_SQL = f"{PARTS_SQL}, lb AS (SELECT *, CAST(vid % 3 + 1 AS INTEGER) AS label FROM pt)"


def _thirds(spark, sf):
    return parts(spark, sf).withColumn("label", (F.col("vid") % 3 + 1).cast("int"))


@query(f"""WITH RECURSIVE {THIRDS_SQL}, ed AS (SELECT a.vid AS src, b.vid AS dst FROM lb a JOIN lb b ON a.label = b.label WHERE {DIST} <= 12), rc AS (SELECT vid, vid AS c FROM lb UNION SELECT ed.dst, rc.c FROM rc JOIN ed ON ed.src = rc.vid), hm AS (SELECT vid, min(c) AS c FROM rc GROUP BY vid),
sz AS (SELECT label, c, count(*) AS n FROM hm JOIN lb USING (vid) GROUP BY ALL), bs AS (SELECT label, c, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, c) AS r FROM sz) WHERE r = 1 AND n > 10), ids AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS fresh FROM bs)
SELECT lb.vid, coalesce(ids.fresh, 0) AS label FROM lb JOIN hm USING (vid) LEFT JOIN bs ON bs.label = lb.label AND bs.c = hm.c LEFT JOIN ids ON ids.label = bs.label""")
def largest_component(spark, sf):
    return clustering.largest_component(_thirds(spark, sf), 12.0, least=10, renumber=True).select("vid", "label")


@query(f"""WITH RECURSIVE {THIRDS_SQL}, kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM (SELECT a.vid AS src, b.vid AS dst, {DIST} AS d FROM lb a JOIN lb b ON a.label = b.label AND a.vid <> b.vid)) WHERE r <= 16 AND d <= 12),
ed AS (SELECT src, dst FROM kn UNION SELECT dst, src FROM kn), rc AS (SELECT vid, vid AS c FROM lb UNION SELECT ed.dst, rc.c FROM rc JOIN ed ON ed.src = rc.vid), hm AS (SELECT vid, min(c) AS c FROM rc GROUP BY vid),
sz AS (SELECT label, c, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM hm JOIN lb USING (vid) GROUP BY label, c), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, c) AS r FROM sz), lg AS (SELECT * FROM rk WHERE n >= 10 OR r = 1),
nm AS (SELECT label, c, row_number() OVER (ORDER BY label, n DESC, c) AS fresh FROM lg), sm AS (SELECT a.label, a.c, b.c AS home, row_number() OVER (PARTITION BY a.label, a.c ORDER BY {DIST}, b.c) AS r FROM rk a JOIN lg b ON a.label = b.label WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.label = a.label AND lg.c = a.c)),
al AS (SELECT label, c, c AS home FROM lg UNION ALL SELECT label, c, home FROM sm WHERE r = 1) SELECT lb.vid, CAST(nm.fresh AS INTEGER) AS label FROM lb JOIN hm USING (vid) JOIN al ON al.label = lb.label AND al.c = hm.c JOIN nm ON nm.label = al.label AND nm.c = al.home""")
def split_components(spark, sf):
    return clustering.split_labels(_thirds(spark, sf), 12.0, 10).select("vid", F.col("label").cast("int").alias("label"))


@query(f"""WITH RECURSIVE {PARTS_SQL}, lb AS (SELECT *, vid % 3 + 1 AS label FROM pt), kn AS (SELECT a.vid AS src, b.vid AS dst, a.label, {DIST} AS d, row_number() OVER (PARTITION BY a.vid ORDER BY {DIST}, b.vid) AS r FROM lb a JOIN lb b ON a.label = b.label AND a.vid <> b.vid),
rc AS (SELECT vid AS s, vid AS v FROM lb UNION SELECT rc.s, kn.dst FROM rc JOIN kn ON kn.src = rc.v AND kn.r <= 2 AND kn.d <= 15) SELECT v AS vid, min(s) AS part FROM rc GROUP BY v""")
def ordered_components(spark, sf):
    """Directed edges to the two nearest of the same label: a row falls to the smallest row that reaches it."""
    return clustering.scan_components(_thirds(spark, sf), 15.0, 2, ordered=True).select("vid", "part")


@query(f"""WITH RECURSIVE {PARTS_SQL}, m AS (SELECT * FROM pt WHERE vid % 2 = 0), ed AS (SELECT a.vid AS src, b.vid AS dst FROM m a, m b WHERE {DIST} <= 20), sd AS (SELECT vid FROM m ORDER BY pow(x - 25, 2) + pow(y - 1000, 2) + pow(z - 50, 2), vid LIMIT 1), rc AS (SELECT vid FROM sd UNION SELECT ed.dst FROM rc JOIN ed ON ed.src = rc.vid) SELECT vid FROM rc""")
def prompt_component(spark, sf):
    return clustering.prompt_component(parts(spark, sf).where("vid % 2 = 0"), (25.0, 1000.0, 50.0), 20.0).select("vid")


def _votes_sql(source: str, out: str) -> str:
    return f"""{out}_v AS (SELECT kn.src AS vid, l.label, count(*) AS n, min(rank) AS f FROM kn JOIN {source} l ON l.vid = kn.dst WHERE l.label > 0 GROUP BY kn.src, l.label), {out}_w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) AS r FROM {out}_v) WHERE r = 1),
{out} AS (SELECT l.uid, l.vid, CASE WHEN w.n >= 4 THEN w.label ELSE l.label END AS label FROM {source} l LEFT JOIN {out}_w w ON w.vid = l.vid)"""


def _small_sql(source: str, out: str, least: int) -> str:
    return f"{out} AS (SELECT uid, vid, CASE WHEN count(*) OVER (PARTITION BY uid, label) >= {least} THEN label ELSE 0 END AS label FROM {source})"


_EDGES8_SQL = EDGES_SQL.split(", ad AS")[0].replace("rank <= 6", "rank <= 8").rsplit("lb AS", 1)[0].rstrip().rstrip(",")


@query(f"""WITH RECURSIVE {_EDGES8_SQL}, l0 AS (SELECT uid, vid, label FROM em), {_small_sql('l0', 'l1', 10)},
ad AS (SELECT kn.uid, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, count(*) AS n FROM kn JOIN l1 p ON p.vid = kn.src JOIN l1 q ON q.vid = kn.dst WHERE p.label > 0 AND q.label > 0 AND p.label <> q.label GROUP BY ALL), sz AS (SELECT uid, label, count(*) AS n FROM l1 GROUP BY ALL),
sg AS (SELECT ad.uid, a, b FROM ad JOIN sz s ON s.uid = ad.uid AND s.label = a JOIN sz t ON t.uid = ad.uid AND t.label = b WHERE ad.n >= 20 AND ad.n::DOUBLE / least(s.n, t.n) >= 0.9), tw AS (SELECT uid, a, b FROM sg UNION SELECT uid, b, a FROM sg),
cc AS (SELECT uid, label, label AS c FROM sz UNION SELECT cc.uid, tw.b, cc.c FROM cc JOIN tw ON tw.uid = cc.uid AND tw.a = cc.label), hm AS (SELECT uid, label, min(c) AS c FROM cc GROUP BY ALL), l2 AS (SELECT l1.uid, l1.vid, hm.c AS label FROM l1 JOIN hm USING (uid, label)),
{_votes_sql('l2', 'l3')}, {_votes_sql('l3', 'l4')}, {_small_sql('l4', 'l5', 10)}
SELECT uid, vid, CASE WHEN label > 0 THEN CAST(dense_rank() OVER (PARTITION BY uid, label > 0 ORDER BY label) AS INTEGER) ELSE 0 END AS label FROM l5""")
def refine_instances(spark, sf):
    e = vectors(spark, sf).withColumn("label", F.col("label").cast("int"))
    return refine.refine_instances(e, 8, 10, 0.9, 20, 2, 4).select("uid", "vid", F.col("label").cast("int").alias("label"))


def _masks(spark, sf):
    return read_table(spark, sf, "lineitem").select(F.lit(1).alias("uid"), F.col("l_orderkey").alias("vid"), F.col("l_suppkey").alias("mask_id")).distinct()


MASKS_SQL = "m AS (SELECT DISTINCT l_orderkey AS vid, l_suppkey AS mask_id FROM lineitem), s AS (SELECT mask_id, count(*) AS n FROM m GROUP BY mask_id), ov AS (SELECT a.mask_id AS a, b.mask_id AS b, count(*)::DOUBLE / (any_value(s.n) + any_value(t.n) - count(*)) AS iou FROM m a JOIN m b ON a.vid = b.vid AND a.mask_id < b.mask_id JOIN s ON s.mask_id = a.mask_id JOIN s t ON t.mask_id = b.mask_id GROUP BY ALL)"


@query(f"WITH {MASKS_SQL} SELECT a, b, round(iou, 6) AS iou FROM ov")
def mask_overlaps(spark, sf):
    return rounded(refine.mask_overlaps(_masks(spark, sf)).drop("uid"))


@query(f"""WITH RECURSIVE {MASKS_SQL}, k AS (SELECT mask_id, n::DOUBLE AS score, row_number() OVER (ORDER BY n DESC, mask_id) AS k FROM s), cl AS (SELECT a, b FROM ov WHERE iou >= 0.02 UNION ALL SELECT b, a FROM ov WHERE iou >= 0.02), w AS (SELECT a AS mask_id, list(b) AS bad FROM cl GROUP BY a),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT k.k, CASE WHEN w.bad IS NULL OR len(list_intersect(w.bad, r.kept)) = 0 THEN list_append(r.kept, k.mask_id) ELSE r.kept END FROM r JOIN k ON k.k = r.k + 1 LEFT JOIN w ON w.mask_id = k.mask_id),
e AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1), o AS (SELECT unnest(kept) AS mask_id, unnest(range(0, len(kept))) AS rank FROM e) SELECT mask_id, score, rank FROM o JOIN k USING (mask_id)""")
def nms_masks(spark, sf):
    cells = _masks(spark, sf)
    scores = cells.groupBy("uid", "mask_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rounded(refine.nms_masks(cells, scores, 0.02).drop("uid"))


@query(f"""WITH RECURSIVE {EMB_SQL}, r AS (SELECT uid, vid, x, y, z, 0 AS step, CAST('inf' AS DOUBLE) AS near, min(vid) OVER (PARTITION BY uid) AS chosen FROM em
UNION ALL SELECT uid, vid, x, y, z, step + 1, nn, first_value(vid) OVER (PARTITION BY uid ORDER BY nn DESC, vid) FROM (SELECT r.uid, r.vid, r.x, r.y, r.z, r.step, least(r.near, (r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y) + (r.z - c.z) * (r.z - c.z)) AS nn FROM r JOIN em c ON c.uid = r.uid AND c.vid = r.chosen WHERE step < 19))
SELECT DISTINCT uid, chosen AS vid, CAST(step AS BIGINT) AS rank FROM r""")
def farthest_points(spark, sf):
    return features.farthest_points(vectors(spark, sf), 20, seed=None)


def _thin_sql(most: int, rounds: int) -> str:
    """The rounds of voxel thinning one after another; a round after the last needed one changes nothing."""
    place = ", ".join(f"floor(({c} - lo_{c}) / w)" for c in "xyz")
    span = " * ".join(f"greatest(max({c}) - min({c}), 1e-6)" for c in "xyz")
    steps = [f"b AS (SELECT min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, {span} AS vol, count(*) AS n FROM pt), v0 AS (SELECT pow(vol / {most}, 1.0::DOUBLE / 3) AS w FROM b)"]
    for i in range(1, rounds + 1):
        steps.append(f"""t{i} AS (SELECT vid, opacity FROM (SELECT vid, opacity, b.n, row_number() OVER (PARTITION BY {place} ORDER BY opacity DESC, vid) AS r FROM pt, b, v{i - 1}) WHERE r = 1 OR n <= {most}),
v{i} AS (SELECT CASE WHEN k <= 1.05 * {most} THEN w ELSE w * pow(k::DOUBLE / {most}, 1.0::DOUBLE / 3) * 1.03::DOUBLE END AS w FROM v{i - 1}, (SELECT count(*) AS k FROM t{i}))""")
    return ", ".join(steps)


@query(f"WITH {PARTS_SQL}, {_thin_sql(100, 8)} SELECT vid, round(opacity, 6) AS opacity FROM t8 ORDER BY t8.opacity DESC, vid LIMIT 100")
def adaptive_thin(spark, sf):
    return rounded(aggregates.adaptive_thin(parts(spark, sf), 100).select("vid", "opacity"))


@query("""WITH p AS (SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS instance_id, CAST(p_size AS DOUBLE) AS x FROM part), a AS (SELECT instance_id, count(*) AS n_points, avg(x) AS cx, max(x) - min(x) AS length FROM p GROUP BY instance_id), c AS (SELECT DISTINCT instance_id, abs(round(x - cx, 9)) AS s, sign(x - cx) AS g FROM p JOIN a USING (instance_id))
SELECT instance_id, n_points, round(cx, 6) AS cx, length, 0.0::DOUBLE AS width, 0.0::DOUBLE AS inclination FROM a""")
def leaf_parameters(spark, sf):
    """Leaves that lie along the x axis, so that their axes are known: centroid, length, width and inclination."""
    p = read_table(spark, sf, "part").select(F.lit("p").alias("uid"), (F.col("p_partkey") % 5 + 1).cast("int").alias("instance_id"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return rounded(phenotype.leaf_parameters(p, 25.0).select("instance_id", "n_points", "cx", "length", "width", "inclination"))


def _classes(spark, sf) -> DataFrame:
    """Customers as points of five classes far apart, each a little off its middle."""
    c = read_table(spark, sf, "customer")
    spot = [F.when(F.col("c_nationkey") % 5 == i, 10.0).otherwise(0.0) + (F.col("c_custkey") * (i + 3) % 11) / 100 for i in range(5)]
    return c.select(F.col("c_custkey").alias("vid"), F.array(*spot).alias("feat"), *[s.alias(n) for s, n in zip(spot, "xyz", strict=False)])


def _by_smallest(df: DataFrame, cluster: str) -> DataFrame:
    return df.join(df.groupBy(cluster).agg(F.min("vid").alias("_first")), cluster).select("vid", F.col("_first").alias("cluster"))


CLASSES_SQL = "SELECT c_custkey AS vid, min(c_custkey) OVER (PARTITION BY c_nationkey % 5) AS cluster FROM customer"


@query(CLASSES_SQL)
def kmeans_classes(spark, sf):
    return _by_smallest(features.kmeans_labels(_classes(spark, sf), 5), "cluster_id")


@query(CLASSES_SQL)
def auto_k_classes(spark, sf):
    """The k of the best silhouette has to be the number of classes."""
    return _by_smallest(features.auto_k(_classes(spark, sf).select("vid", "feat"), 2, 9)[2], "cluster_id")


@query("SELECT c_custkey AS vid, min(c_custkey) OVER (PARTITION BY least(c_nationkey % 5, 3)) AS cluster FROM customer")
def superpoint_classes(spark, sf):
    """By three coordinates the last two classes are one."""
    return _by_smallest(features.superpoints(_classes(spark, sf), 4), "sp")


WIDE, HIGH = 120, 90


@query(f"""WITH p AS (SELECT s_suppkey AS k, 20 + s_suppkey % 30 AS x0, 15 + s_suppkey % 20 AS y0, 10 + s_suppkey % 23 AS w, 8 + s_suppkey % 17 AS h FROM supplier), d AS (SELECT k, greatest(x0 - 7, 0) AS l, least(x0 + w + 7, {WIDE}) AS r, greatest(y0 - 7, 0) AS t, least(y0 + h + 7, {HIGH}) AS b FROM p),
m AS (SELECT k, greatest(0, floor(l - (r - l) * 0.1::DOUBLE)) AS l, least({WIDE}, ceil(r + (r - l) * 0.1::DOUBLE)) AS r, greatest(0, floor(t - (b - t) * 0.1::DOUBLE)) AS t, least({HIGH}, ceil(b + (b - t) * 0.1::DOUBLE)) AS b FROM d),
g AS (SELECT k, l, r, t, b, greatest(0, ceil((64 - (r - l)) / 2)) AS gx, greatest(0, ceil((64 - (b - t)) / 2)) AS gy FROM m)
SELECT k AS image_id, CASE WHEN k % 5 > 0 THEN CAST(greatest(0, l - gx) AS BIGINT) END AS "left", CASE WHEN k % 5 > 0 THEN CAST(greatest(0, t - gy) AS BIGINT) END AS top, CASE WHEN k % 5 > 0 THEN CAST(least({WIDE}, r + gx) AS BIGINT) END AS "right", CASE WHEN k % 5 > 0 THEN CAST(least({HIGH}, b + gy) AS BIGINT) END AS bottom,
CASE WHEN k % 5 > 0 THEN '' ELSE 'nothing is green' END AS reason FROM g""")
def green_crops(spark, sf):
    """Pictures of one green rectangle each, which opening and closing leave as it is and dilation widens by seven pixels; every fifth has none."""
    k = F.col("s_suppkey")
    x0, y0, w, h = 20 + k % 30, 15 + k % 20, 10 + k % 23, 8 + k % 17
    row = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda x: F.when((x >= x0) & (x < x0 + w) & (k % 5 > 0), "28B432").otherwise("B4B4B4"))
    blank = F.repeat(F.lit("B4B4B4"), WIDE)
    rows = F.transform(F.sequence(F.lit(0), F.lit(HIGH - 1)), lambda y: F.when((y >= y0) & (y < y0 + h), F.col("_row")).otherwise(blank))
    s = spread(read_table(spark, sf, "supplier")).select("s_suppkey", F.array_join(row, "").alias("_row"))
    pictures = s.select(k.alias("image_id"), F.lit(HIGH).alias("height"), F.lit(WIDE).alias("width"), F.unhex(F.array_join(rows, "")).alias("pixels"))
    return images.green_crops(pictures)


# Other ways of operators that have a query already.


@query("""SELECT s_suppkey, 500.0::DOUBLE + s_suppkey % 5 AS fx, CASE WHEN s_suppkey % 5 IN (1, 4) THEN 600.0::DOUBLE ELSE 500.0::DOUBLE + s_suppkey % 5 END AS fy, CASE WHEN s_suppkey % 5 IN (1, 4) THEN 320.0::DOUBLE ELSE 600.0 END AS cx, CASE WHEN s_suppkey % 5 IN (1, 4) THEN 240.0::DOUBLE ELSE 320.0 END AS cy FROM supplier""")
def intrinsics_of_models(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).cast("int").alias("m"))
    k = scalars.intrinsics("m", F.array(F.lit(500.0) + F.col("m"), F.lit(600.0), F.lit(320.0), F.lit(240.0)))
    return rounded(s.select("s_suppkey", k.alias("k")).select("s_suppkey", "k.*"))


@query(f"""WITH {VIEW_SQL.split(", px AS")[0]}, rp AS (SELECT uid, vid, view_id, CAST(round_even(100 * cx / cz + 64, 0) AS BIGINT) AS u, CAST(round_even(100 * cy / cz + 48, 0) AS BIGINT) AS v, cz FROM cm WHERE cz > 0)
SELECT view_id, uid, count(*) AS n, sum(u)::BIGINT AS u, sum(v)::BIGINT AS v FROM rp WHERE u >= 0 AND v >= 0 AND u < 127 AND v < 95 GROUP BY ALL""")
def project_with_margin(spark, sf):
    """Half-even pixels within the last row and column left out."""
    found = views.project_points(*_points_and_views(spark, sf), "rint", 0.0, margin=1)
    return found.groupBy("view_id", "uid").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"))


OFFSETS_SQL = "o AS (SELECT * FROM (VALUES (0, 0, -1), (1, -1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1)) t(pass, dx, dy)), d AS (SELECT uid, vid, view_id, pass, u + dx AS u, v + dy AS v, depth FROM ht, o WHERE u + dx >= 0 AND v + dy >= 0 AND u + dx < 128 AND v + dy < 96)"


@query(f"""WITH {VIEW_SQL}, {OFFSETS_SQL}, b AS (SELECT view_id, vid, row_number() OVER (PARTITION BY view_id, v, u ORDER BY depth, uid, vid) AS r FROM d), s AS (SELECT view_id, count(*) AS pixels, sum(vid % 256)::BIGINT AS red FROM b WHERE r = 1 GROUP BY view_id),
p AS (SELECT view_id, v, u, pass, min(depth) AS m FROM d GROUP BY ALL), q AS (SELECT view_id, m, min(m) OVER (PARTITION BY view_id, v, u ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM p), h AS (SELECT view_id, count(*) FILTER (WHERE low IS NULL OR m < low) AS hit_count FROM q GROUP BY view_id)
SELECT view_id, pixels, red, hit_count FROM s JOIN h USING (view_id)""")
def splat_colors(spark, sf):
    hits = cut(_hits(spark, sf), "hits")
    shade = F.col("vid") % 256
    canvas, counts = views.render(events(spark, sf).select("uid", "vid", shade.alias("red"), shade.alias("green"), shade.alias("blue")), hits, hits.select("view_id").distinct().withColumns({"width": F.lit(128), "height": F.lit(96)}), 1)
    return canvas.groupBy("view_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("red").alias("red")).join(counts, "view_id")


@query(f"""WITH {PARTS_SQL}, v AS (SELECT *, floor((x - min(x) OVER ()) / 10.0::DOUBLE) AS i, floor((y - min(y) OVER ()) / 10.0::DOUBLE) AS j, floor((z - min(z) OVER ()) / 10.0::DOUBLE) AS k FROM pt)
SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, CAST(trunc(avg(vid % 256)) AS INTEGER) AS red FROM v GROUP BY i, j, k""")
def voxel_colors(spark, sf):
    return rounded(aggregates.voxel_downsample(parts(spark, sf).withColumn("red", F.col("vid") % 256), 10.0, colors=("red",)).drop("uid"))


@query("SELECT l_orderkey AS vid, CAST(min(l_suppkey % 9) + 1 AS BIGINT) AS instance_id FROM lineitem GROUP BY l_orderkey")
def assign_by_order(spark, sf):
    cells = read_table(spark, sf, "lineitem").select(F.lit(1).alias("uid"), F.col("l_orderkey").alias("vid"), (F.col("l_suppkey") % 9).alias("rank"), F.lit(1.0).alias("score")).distinct()
    return refine.assign_instances(cells, "order").select("vid", F.col("instance_id").cast("long").alias("instance_id"))


@query(f"""WITH {PARTS_SQL}, a AS (SELECT * FROM pt WHERE vid % 2 = 0), b AS (SELECT * FROM pt WHERE vid % 2 = 1), pr AS (SELECT a.vid AS va, b.vid AS vb, {DIST} AS d FROM a, b), na AS (SELECT va, min(d) AS d FROM pr GROUP BY va), nb AS (SELECT vb, min(d) AS d FROM pr GROUP BY vb),
k AS (SELECT quantile_cont(d, 0.75) AS k FROM na), f AS (SELECT greatest(quantile_cont(d, 0.35), (SELECT k FROM k)) AS f FROM nb) SELECT 'radegs' AS source, count(*) AS n FROM na, k WHERE d <= k UNION ALL SELECT 'gof', least(count(*), 7) FROM nb, f WHERE d > f""")
def fuse_capped(spark, sf):
    """No more than seven rows are filled in."""
    p = cut(parts(spark, sf), "parts")
    out, _ = fusion.fuse(p.where("vid % 2 = 0"), p.where("vid % 2 = 1"), most_fill=7)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


STEP_K, STEP_COUNT = 550, 20
STEP_SQL = f"""f AS (SELECT l_orderkey * 8 + l_linenumber AS vid, l_partkey % {STEP_K} AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y, l_tax::DOUBLE * 100 AS z FROM lineitem),
c AS (SELECT g, arg_min(x, vid) AS x, arg_min(y, vid) AS y, arg_min(z, vid) AS z FROM f GROUP BY g), nr AS (SELECT f.vid, f.x, f.y, f.z, min({{d: (f.x - c.x) * (f.x - c.x) + (f.y - c.y) * (f.y - c.y) + (f.z - c.z) * (f.z - c.z), g: c.g}}) AS best FROM f, c GROUP BY ALL)"""


def _step_rows(spark, sf):
    """Lines as points, and one line of each of 550 groups of parts as its centre."""
    rows = read_table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vid"), (F.col("l_partkey") % STEP_K).alias("g"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 1000, F.col("l_tax").cast("double") * 100).alias("feat"))
    first = rows.groupBy("g").agg(F.min_by("feat", "vid").alias("feat")).orderBy("g").collect()  # k rows
    return rows, kmeans.Centres([r["feat"] for r in first], [STEP_COUNT] * len(first)), [r["g"] for r in first]


@query(f"""WITH {STEP_SQL}, m AS (SELECT best.g AS g, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM nr GROUP BY best.g)
SELECT CAST(c.g AS BIGINT) AS centre, CAST({STEP_COUNT} + coalesce(n, 0) AS BIGINT) AS n, round(({STEP_COUNT} * c.x + coalesce(m.x, 0)) / ({STEP_COUNT} + coalesce(n, 0)), 6) AS x, round(({STEP_COUNT} * c.y + coalesce(m.y, 0)) / ({STEP_COUNT} + coalesce(n, 0)), 6) AS y, round(({STEP_COUNT} * c.z + coalesce(m.z, 0)) / ({STEP_COUNT} + coalesce(n, 0)), 6) AS z FROM c LEFT JOIN m USING (g)""")
def kmeans_step(spark, sf):
    """One step of mini-batch k-means at k = 550 over all lines: where the centres, with counts of 20 before, move."""
    rows, centres, names = _step_rows(spark, sf)
    moved, _ = kmeans.step(rows, centres)
    table = [(int(g), int(n), *map(float, v)) for g, n, v in zip(names, moved.counts, moved.values, strict=True)]
    return rounded(spark.createDataFrame(table, "centre long, n long, x double, y double, z double"))


@query(f"WITH {STEP_SQL} SELECT vid, CAST(p.place AS INTEGER) AS place, CAST(best.g AS BIGINT) AS centre FROM nr JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place FROM c) p ON p.g = nr.best.g")
def kmeans_assigned(spark, sf):
    """The nearest of the 550 centres for every line."""
    rows, centres, names = _step_rows(spark, sf)
    named = kmeans.assign(rows.select("vid", "feat"), centres, out="place")
    return named.select("vid", "place", F.element_at(F.array(*[F.lit(int(g)).cast("long") for g in names]), F.col("place") + 1).alias("centre"))


@query(f"""WITH {EVENTS_SQL}, vw AS (SELECT n_nationkey AS view_id, 60.0::DOUBLE + n_nationkey * 8 AS f, n_nationkey * 20.0::DOUBLE - 240 AS tx, 90.0::DOUBLE - n_nationkey * 7 AS ty FROM nation),
px AS (SELECT view_id, CAST(round_even(f * (x - 250 + tx) / (z + 400) + 64, 0) AS BIGINT) AS u, CAST(round_even(f * (y - 700 + ty) / (z + 400) + 48, 0) AS BIGINT) AS v FROM ev, vw)
SELECT CAST(view_id AS INTEGER) AS view_id, count(*) AS n, round(avg(u), 2) AS u, round(avg(v), 2) AS v FROM px WHERE u >= 0 AND v >= 0 AND u < 128 AND v < 96 GROUP BY view_id""")
def project_through_many_views(spark, sf):
    """A view for each nation, so points are met by the cells that a view's frustum cuts."""
    e = events(spark, sf).select("uid", "vid", (F.col("x") - 250).alias("x"), (F.col("y") - 700).alias("y"), (F.col("z") + 400).alias("z"))
    k, d = F.col("n_nationkey"), lambda c: c.cast("double")
    shots = read_table(spark, sf, "nation").select(k.cast("int").alias("view_id"), *[F.lit(float(i == 0)).alias(f"q{i}") for i in range(4)], d(k * 20 - 240).alias("t0"), d(90 - k * 7).alias("t1"), F.lit(0.0).alias("t2"), F.struct(d(60 + k * 8).alias("fx"), d(60 + k * 8).alias("fy"), F.lit(64.0).alias("cx"), F.lit(48.0).alias("cy")).alias("k"), F.lit(128).alias("width"), F.lit(96).alias("height"))
    hits = views.project_points(e, shots, "rint")
    return rounded(hits.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 2).alias("u"), F.round(F.avg("v"), 2).alias("v")))
