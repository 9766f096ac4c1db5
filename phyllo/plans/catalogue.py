"""Registered queries of the point-cloud operators and their DuckDB SQL.

The test tables hold no clouds; adapters read events, parts and embeddings as
points and labels. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phyllo.functions import colors, scalars
from phyllo.operators import aggregates, clustering, features, filters, fusion, images, metrics, phenotype, quantiles, refine, spatial, views
from phyllo.session import cut, read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{f.name}`").cast("double"), 6) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


# Points and labels, in both dialects.
EVENTS_SQL = "ev AS (SELECT event_type AS uid, event_id AS vid, CAST(value AS DOUBLE) AS x, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS y, CAST(user_id AS DOUBLE) AS z FROM events)"
PARTS_SQL = "pt AS (SELECT 'p' AS uid, p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CAST(p_partkey % 100 AS DOUBLE) AS z, CAST(p_retailprice AS DOUBLE) AS opacity FROM part)"
SEG_SQL = "sg AS (SELECT CAST(vec_id % 2 AS BIGINT) AS uid, vec_id AS vid, CAST(label AS BIGINT) AS gt, CASE WHEN vec_id % 5 < 4 THEN CAST(label AS BIGINT) ELSE vec_id % 10 END AS pred FROM embeddings)"
EMB_SQL = "em AS (SELECT CAST(vec_id % 2 AS BIGINT) AS uid, vec_id AS vid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_type").alias("uid"), F.col("event_id").alias("vid"), F.col("value").cast("double").alias("x"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("y"), F.col("user_id").cast("double").alias("z"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return p.select(F.lit("p").alias("uid"), F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), (F.col("p_partkey") % 100).cast("double").alias("z"), F.col("p_retailprice").cast("double").alias("opacity"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 2).alias("uid"), F.col("vec_id").alias("vid"), F.col("label").cast("long").alias("gt"), F.when(F.col("vec_id") % 5 < 4, F.col("label").cast("long")).otherwise(F.col("vec_id") % 10).alias("pred"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 2).alias("uid"), F.col("vec_id").alias("vid"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.col("label").cast("long").alias("label"))


OVERLAP_SQL = f"""{SEG_SQL}, ov AS (SELECT uid, gt, pred, count(*) AS n FROM sg WHERE gt > 0 AND pred > 0 GROUP BY ALL),
ng AS (SELECT uid, gt, count(*) AS n_gt FROM sg WHERE gt > 0 GROUP BY ALL), np AS (SELECT uid, pred, count(*) AS n_pred FROM sg WHERE pred > 0 GROUP BY ALL),
iou AS (SELECT ng.uid, ng.gt, np.pred, coalesce(n, 0) AS overlap, n_gt, n_pred, coalesce(n, 0)::DOUBLE / (n_gt + n_pred - coalesce(n, 0)) AS iou
  FROM ng JOIN np USING (uid) LEFT JOIN ov ON ov.uid = ng.uid AND ov.gt = ng.gt AND ov.pred = np.pred),
lf AS (SELECT DISTINCT uid, pred FROM iou WHERE iou >= 0.1)"""


@query(f"WITH {OVERLAP_SQL} SELECT uid, gt, pred, n FROM ov")
def seg_overlap(spark, sf):
    return metrics.overlaps(segments(spark, sf))[0].select("uid", "gt", "pred", "n")


@query(f"WITH {OVERLAP_SQL} SELECT uid, gt, pred, overlap, n_gt, n_pred, round(iou, 6) AS iou, round(overlap::DOUBLE / n_gt, 6) AS coverage, round(overlap::DOUBLE / n_pred, 6) AS purity FROM iou")
def seg_iou_matrix(spark, sf):
    return rounded(metrics.iou_matrix(segments(spark, sf)))


SEMANTIC_SQL = f"""{OVERLAP_SQL}, m AS (SELECT sg.uid, sg.gt > 0 AS g, lf.pred IS NOT NULL AS p FROM sg LEFT JOIN lf ON lf.uid = sg.uid AND lf.pred = sg.pred),
c AS (SELECT uid, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM m GROUP BY uid),
sem AS (SELECT uid, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp + fn), 6) AS leaf_iou, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall,
  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1_dice, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM c)"""


@query(f"WITH {SEMANTIC_SQL} SELECT * FROM sem")
def seg_semantic_metrics(spark, sf):
    return rounded(metrics.semantic_metrics(segments(spark, sf)))


@query(f"WITH {SEMANTIC_SQL} SELECT CAST(uid AS VARCHAR) AS uid, tp::DOUBLE AS tp, leaf_iou FROM sem UNION ALL SELECT 'MEAN', round(avg(tp), 6), round(avg(leaf_iou), 6) FROM sem")
def seg_mean_row(spark, sf):
    rows = aggregates.mean_row(rounded(metrics.semantic_metrics(segments(spark, sf))).select("uid", "tp", "leaf_iou"))
    return rounded(rows.select("uid", F.col("tp").cast("double").alias("tp"), F.col("leaf_iou").cast("double").alias("leaf_iou")))


@query(f"""WITH {SEG_SQL}, n AS (SELECT uid, gt, pred, count(*)::DOUBLE AS n FROM sg GROUP BY ALL),
t AS (SELECT uid, sum(n * (n - 1) / 2) AS both_, sum(n) AS al FROM n GROUP BY uid),
g AS (SELECT uid, sum(m * (m - 1) / 2) AS g FROM (SELECT uid, gt, sum(n) AS m FROM n GROUP BY ALL) GROUP BY uid),
p AS (SELECT uid, sum(m * (m - 1) / 2) AS p FROM (SELECT uid, pred, sum(n) AS m FROM n GROUP BY ALL) GROUP BY uid)
SELECT uid, round((both_ - g * p / (al * (al - 1) / 2)) / ((g + p) / 2 - g * p / (al * (al - 1) / 2)), 6) AS ari FROM t JOIN g USING (uid) JOIN p USING (uid)""")
def seg_ari(spark, sf):
    return rounded(metrics.adjusted_rand(segments(spark, sf)))


@query(f"""WITH {OVERLAP_SQL}, h AS (SELECT uid, count(*) AS tp, sum(iou) AS s FROM iou JOIN lf USING (uid, pred) WHERE iou > 0.5 GROUP BY uid),
g AS (SELECT uid, count(DISTINCT gt) AS n_gt FROM iou GROUP BY uid), p AS (SELECT uid, count(*) AS n_pred FROM lf GROUP BY uid)
SELECT uid, n_gt, n_pred, round(s / tp, 6) AS sq, round(2.0::DOUBLE * tp / (n_gt + n_pred), 6) AS rq, round(s / tp * 2.0::DOUBLE * tp / (n_gt + n_pred), 6) AS pq FROM g JOIN p USING (uid) JOIN h USING (uid)""")
def seg_pq(spark, sf):
    return rounded(metrics.instance_metrics(segments(spark, sf)).select("uid", "n_gt", "n_pred", "sq", "rq", "pq"))


@query(f"""WITH {EVENTS_SQL} SELECT uid, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 6) AS bbox_diagonal, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 6) AS bbox_volume FROM ev GROUP BY uid""")
def cloud_bbox(spark, sf):
    return rounded(aggregates.bounding_box(events(spark, sf)))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT uid, median(x) AS md FROM ev GROUP BY uid)
SELECT uid, round(max(md), 6) AS median, round(median(abs(x - md)), 6) AS mad, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.35), 6) AS q35 FROM ev JOIN m USING (uid) GROUP BY uid""")
def cloud_quantiles(spark, sf):
    e = events(spark, sf)
    q = quantiles.group_quantiles(e, {"q": (F.col("x"), [0.35])}).select("uid", F.col("q")[0].alias("q35"))
    return rounded(aggregates.mad_stats(e, "x").join(aggregates.mean_std(e, "x"), "uid").join(q, "uid"))


@query(f"""WITH {PARTS_SQL}, o AS (SELECT * FROM pt WHERE opacity >= (SELECT quantile_cont(opacity, 0.35) FROM pt)),
q AS (SELECT quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b, quantile_cont(y, 0.005) AS c, quantile_cont(y, 0.995) AS d, quantile_cont(z, 0.005) AS e, quantile_cont(z, 0.995) AS f FROM o)
SELECT vid, x, round(y, 6) AS y, z FROM o, q WHERE x BETWEEN a AND b AND y BETWEEN c AND d AND z BETWEEN e AND f""")
def cloud_crop(spark, sf):
    return rounded(filters.crop_box(filters.above_quantile(filters.finite_rows(parts(spark, sf)))).select("vid", "x", "y", "z"))


@query(f"""WITH {PARTS_SQL}, v AS (SELECT *, floor((x - min(x) OVER ()) / 10.0::DOUBLE) AS i, floor((y - min(y) OVER ()) / 10.0::DOUBLE) AS j, floor((z - min(z) OVER ()) / 10.0::DOUBLE) AS k FROM pt)
SELECT uid, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM v GROUP BY uid, i, j, k""")
def voxel_downsample(spark, sf):
    return rounded(aggregates.voxel_downsample(parts(spark, sf), 10.0))


@query(f"""WITH {PARTS_SQL}, v AS (SELECT *, floor((x - min(x) OVER ()) / 20.0::DOUBLE) AS i, floor((y - min(y) OVER ()) / 20.0::DOUBLE) AS j, floor((z - min(z) OVER ()) / 20.0::DOUBLE) AS k FROM pt)
SELECT vid, round(opacity, 6) AS opacity FROM (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY opacity DESC, vid) AS r FROM v) WHERE r = 1""")
def voxel_top1(spark, sf):
    return rounded(aggregates.voxel_top1(parts(spark, sf), 20.0).select("vid", "opacity"))


@query(f"WITH {PARTS_SQL} SELECT vid, round(opacity, 6) AS opacity FROM pt ORDER BY pt.opacity DESC, vid LIMIT 100")
def topk_opacity(spark, sf):
    return rounded(aggregates.top_by(parts(spark, sf), 100).select("vid", "opacity"))


KNN_SQL = f"""{PARTS_SQL}, pr AS (SELECT a.vid AS src, b.vid AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pt a, pt b),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM pr WHERE src <> dst) WHERE r <= 8), sc AS (SELECT src AS vid, avg(d) AS score FROM kn GROUP BY src),
st AS (SELECT med, (SELECT median(abs(score - med)) FROM sc) AS mad FROM (SELECT median(score) AS med FROM sc))"""


@query(f"WITH {KNN_SQL} SELECT vid, round(score, 6) AS score FROM sc")
def knn_mean_distance(spark, sf):
    return rounded(clustering.mean_knn_distance(parts(spark, sf), 8).select("vid", "score"))


@query(f"WITH {KNN_SQL} SELECT vid FROM sc, st WHERE score <= med + 3 * 1.4826 * mad")
def sor_mad_keep(spark, sf):
    return clustering.sor_mad(parts(spark, sf), 8).select("vid")


@query(f"WITH {KNN_SQL} SELECT 'p' AS uid, round(avg(CASE WHEN score > med + 3 * mad AND mad > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS outlier_ratio FROM sc, st")
def outlier_ratio(spark, sf):
    return rounded(metrics.outlier_ratio(parts(spark, sf), 8))


@query(f"WITH {KNN_SQL} SELECT round(median(m), 6) AS spacing FROM (SELECT src, max(d) AS m FROM kn GROUP BY src)")
def point_spacing(spark, sf):
    return rounded(clustering.point_spacing(parts(spark, sf), 8).select("spacing"))


@query(f"WITH {KNN_SQL} SELECT round(2.5 * median(d), 6) AS eps FROM kn")
def auto_eps(spark, sf):
    return rounded(clustering.auto_eps(parts(spark, sf), 2.5).select("eps"))


NEAR_SQL = f"""{EMB_SQL}, a AS (SELECT * FROM em WHERE vid % 4 < 2), b AS (SELECT * FROM em WHERE vid % 4 >= 2),
pr AS (SELECT a.uid, a.vid, b.vid AS near_vid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d, b.label FROM a JOIN b USING (uid)),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY d, near_vid) AS r FROM pr) WHERE r = 1)"""


@query(f"WITH {NEAR_SQL} SELECT uid, vid, CASE WHEN d <= 0.05 THEN near_vid END AS near_vid, round(d, 6) AS d, CASE WHEN d <= 0.05 THEN label ELSE 0 END AS label FROM nn")
def nearest_within(spark, sf):
    e = cut(vectors(spark, sf), "emb")
    a, b = e.where("vid % 4 < 2"), e.where("vid % 4 >= 2")
    return rounded(spatial.with_labels(spatial.match_within(a, b, 0.05), b))


@query(f"WITH {NEAR_SQL} SELECT uid, count(*) AS n_points, count(*) FILTER (WHERE d <= 0.05) AS n_matched, round(count(*) FILTER (WHERE d <= 0.05)::DOUBLE / count(*), 6) AS match_rate, round(quantile_cont(d, 0.5), 6) AS nn_p50, round(quantile_cont(d, 0.95), 6) AS nn_p95, round(quantile_cont(d, 0.99), 6) AS nn_p99 FROM nn GROUP BY uid")
def nearest_report(spark, sf):
    e = cut(vectors(spark, sf), "emb")
    return rounded(metrics.distance_report(spatial.match_within(e.where("vid % 4 < 2"), e.where("vid % 4 >= 2"), 0.05)))


@query(f"""WITH {PARTS_SQL}, a AS (SELECT * FROM pt WHERE vid % 2 = 0), b AS (SELECT * FROM pt WHERE vid % 2 = 1),
pr AS (SELECT a.vid AS va, b.vid AS vb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM a, b),
na AS (SELECT va AS vid, min(d) AS d FROM pr GROUP BY va), nb AS (SELECT vb AS vid, min(d) AS d FROM pr GROUP BY vb),
k AS (SELECT quantile_cont(d, 0.75) AS k FROM na), f AS (SELECT greatest(quantile_cont(d, 0.35), (SELECT k FROM k)) AS f FROM nb)
SELECT 'radegs' AS source, vid AS source_index FROM na, k WHERE d <= k UNION ALL SELECT 'gof', vid FROM nb, f WHERE d > f""")
def fuse_keep_fill(spark, sf):
    p = cut(parts(spark, sf), "parts")
    out, _ = fusion.fuse(p.where("vid % 2 = 0"), p.where("vid % 2 = 1"))
    return out.select("source", "source_index")


RADIUS_SQL = f"""{PARTS_SQL}, pr AS (SELECT a.vid AS src, b.vid AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pt a JOIN pt b ON abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8 AND abs(a.z - b.z) <= 8),
nb AS (SELECT * FROM pr WHERE d <= 8), co AS (SELECT src AS vid FROM nb GROUP BY src HAVING count(*) >= 5), ed AS (SELECT src, dst FROM nb WHERE src IN (SELECT vid FROM co) AND dst IN (SELECT vid FROM co))"""
DBSCAN_SQL = f"""{RADIUS_SQL}, cc AS (SELECT vid, vid AS c FROM co UNION SELECT ed.dst, cc.c FROM cc JOIN ed ON ed.src = cc.vid),
cl AS (SELECT vid, min(c) AS c FROM cc GROUP BY vid), nm AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM cl)), hl AS (SELECT vid, label FROM cl JOIN nm USING (c)),
bd AS (SELECT nb.src AS vid, min(hl.label) AS label FROM nb JOIN hl ON hl.vid = nb.dst GROUP BY nb.src),
db AS (SELECT pt.vid, CAST(coalesce(hl.label, bd.label, -1) AS INTEGER) AS label, co.vid IS NOT NULL AS is_core FROM pt LEFT JOIN hl USING (vid) LEFT JOIN bd ON bd.vid = pt.vid LEFT JOIN co ON co.vid = pt.vid)"""


@query(f"WITH {RADIUS_SQL} SELECT src, dst, round(d, 6) AS d FROM nb")
def radius_pairs(spark, sf):
    p = parts(spark, sf)
    return spatial.radius_join(p, p, 8.0, digits=6).select("src", "dst", "d")


@query(f"WITH RECURSIVE {DBSCAN_SQL} SELECT vid, label, is_core FROM db")
def dbscan_labels(spark, sf):
    return clustering.dbscan(parts(spark, sf), 8.0, 5).select("vid", "label", "is_core")


@query(f"WITH RECURSIVE {DBSCAN_SQL} SELECT round(coalesce(max(n) FILTER (WHERE label >= 0), 0)::DOUBLE / sum(n), 6) AS ratio FROM (SELECT label, count(*) AS n FROM db GROUP BY label)")
def largest_cluster_ratio(spark, sf):
    sizes = clustering.dbscan(parts(spark, sf), 8.0, 5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.agg((F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)) / F.sum("n")).alias("ratio")))


@query(f"WITH RECURSIVE {DBSCAN_SQL}, big AS (SELECT label FROM db WHERE is_core GROUP BY label HAVING count(*) >= 20) SELECT vid FROM db WHERE is_core AND label IN (SELECT label FROM big) UNION SELECT nb.src FROM nb JOIN db ON db.vid = nb.dst WHERE db.is_core AND db.label IN (SELECT label FROM big)")
def dbscan_keep(spark, sf):
    return clustering.dbscan_keep(parts(spark, sf), 8.0, 5, 20).select("vid")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT round_even(x / 5.0::DOUBLE, 0)::BIGINT AS a, round_even(y / 60.0::DOUBLE, 0)::BIGINT AS b, vid FROM ev), g AS (SELECT a, b, min(vid) AS vid, count(*) AS n FROM f GROUP BY a, b),
p AS (SELECT a, b, count(*) AS m FROM f WHERE vid % 7 = 0 GROUP BY a, b)
SELECT g.vid FROM g JOIN p USING (a, b)""")
def quantized_mask(spark, sf):
    e = events(spark, sf).select(F.lit("e").alias("uid"), "vid", (F.col("x") / 5).alias("x"), (F.col("y") / 60).alias("y"))
    matched, _ = spatial.quantised_match(e, e.where("vid % 7 = 0"), 1.0, coords=("x", "y"))
    return matched.where("matched").select("vid")


EDGES_SQL = f"""{EMB_SQL}, pr AS (SELECT a.uid, a.vid AS src, b.vid AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM em a JOIN em b ON a.uid = b.uid AND a.vid <> b.vid),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM pr) WHERE rank <= 6),
lb AS (SELECT uid, vid, label FROM em), ad AS (SELECT kn.uid, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, count(*) AS n FROM kn JOIN lb p ON p.vid = kn.src JOIN lb q ON q.vid = kn.dst
  WHERE p.label > 0 AND q.label > 0 AND p.label <> q.label GROUP BY ALL)"""


def _labels_edges(spark, sf):
    e = cut(vectors(spark, sf), "emb")
    return e.select("uid", "vid", "label"), cut(spatial.knn_join(e, e, 6, drop_self=True), "edges")


@query(f"WITH {EDGES_SQL} SELECT uid, a, b, n FROM ad")
def label_adjacency(spark, sf):
    return refine.label_edges(*_labels_edges(spark, sf))


@query(f"""WITH {EDGES_SQL}, v AS (SELECT kn.src AS vid, lb.label, count(*) AS n, min(rank) AS f FROM kn JOIN lb ON lb.vid = kn.dst WHERE lb.label > 0 GROUP BY kn.src, lb.label),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) AS r FROM v) WHERE r = 1)
SELECT lb.uid, lb.vid, CASE WHEN w.n >= 3 THEN w.label ELSE lb.label END AS label FROM lb LEFT JOIN w ON w.vid = lb.vid""")
def smooth_once(spark, sf):
    labels, edges = _labels_edges(spark, sf)
    return refine.smooth_once(labels, edges, 3)


@query(f"""WITH RECURSIVE {EDGES_SQL}, sz AS (SELECT uid, label, count(*) AS n FROM lb GROUP BY ALL),
st AS (SELECT ad.uid, a, b FROM ad JOIN sz s ON s.uid = ad.uid AND s.label = a JOIN sz t ON t.uid = ad.uid AND t.label = b WHERE ad.n >= 10 AND ad.n::DOUBLE / least(s.n, t.n) >= 1.3),
tw AS (SELECT uid, a, b FROM st UNION SELECT uid, b, a FROM st), cc AS (SELECT uid, label, label AS c FROM sz UNION SELECT cc.uid, tw.b, cc.c FROM cc JOIN tw ON tw.uid = cc.uid AND tw.a = cc.label),
hm AS (SELECT uid, label, min(c) AS c FROM cc GROUP BY ALL)
SELECT lb.uid, lb.vid, hm.c AS label FROM lb JOIN hm USING (uid, label)""")
def merge_adjacent(spark, sf):
    labels, edges = _labels_edges(spark, sf)
    return refine.merge_adjacent(labels, edges, 1.3, 10)


LINES_SQL = "ln AS (SELECT l_suppkey AS uid, l_orderkey * 10 + l_linenumber AS vid, CAST(l_partkey % 7 AS BIGINT) AS label FROM lineitem)"


def _lines(spark, sf):
    return read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("uid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vid"), (F.col("l_partkey") % 7).alias("label"))


@query(f"WITH {LINES_SQL} SELECT uid, vid, CASE WHEN count(*) OVER (PARTITION BY uid, label) >= 90 THEN label ELSE 0 END AS label FROM ln")
def remove_small(spark, sf):
    return filters.drop_small_labels(_lines(spark, sf), 90)


@query(f"WITH {LINES_SQL} SELECT uid, vid, CASE WHEN label > 0 THEN CAST(dense_rank() OVER (PARTITION BY uid, label > 0 ORDER BY label) AS INTEGER) ELSE 0 END AS label FROM (SELECT uid, vid, CASE WHEN label % 2 = 0 THEN label ELSE 0 END AS label FROM ln)")
def relabel_contiguous(spark, sf):
    return scalars.relabel_contiguous(_lines(spark, sf).withColumn("label", F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(0)))


@query(f"WITH {LINES_SQL}, c AS (SELECT uid, label, count(*) AS n, min(vid) AS v FROM ln GROUP BY ALL) SELECT uid, label, n AS n_points, round(n::DOUBLE / sum(n) OVER (PARTITION BY uid), 6) AS share, CAST(row_number() OVER (PARTITION BY uid ORDER BY n DESC, v) AS INTEGER) AS place FROM c")
def split_rank(spark, sf):
    rows = _lines(spark, sf)
    first = rows.groupBy("uid", "label").agg(F.min("vid").alias("v"))
    sized = aggregates.cluster_sizes(rows).join(first, ["uid", "label"])
    return rounded(sized.withColumn("place", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("n_points"), "v"))).drop("v"))


@query("""WITH d AS (SELECT vec_id AS vid, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE * 4 AS f FROM embeddings), s AS (SELECT vid, i, f * 0.28209479177387814::DOUBLE + 0.5 AS c FROM d)
SELECT vid, i, CAST(trunc(greatest(0.0, least(255.0, c * 255))) AS INTEGER) AS cut_off, CAST(round_even(greatest(0.0, least(1.0, c)) * 255, 0) AS INTEGER) AS half_even FROM s""")
def sh_rgb(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.posexplode("embedding").alias("i", "f"))
    f = F.col("f").cast("double") * 4
    return rows.select("vid", F.col("i").cast("long").alias("i"), scalars.sh_to_rgb_trunc(f).alias("cut_off"), scalars.sh_to_rgb_rint(f).alias("half_even"))


@query("SELECT event_id AS vid, CAST(greatest(0, least(255, round_even(value - 50, 0))) AS INTEGER) AS c, round(1 / (1 + exp(-greatest(-60.0, least(60.0, value - 100)))), 6) AS s FROM events")
def clamp_color(spark, sf):
    e = read_table(spark, sf, "events")
    return rounded(e.select(F.col("event_id").alias("vid"), scalars.clamp_color(F.col("value") - 50).alias("c"), scalars.sigmoid(F.col("value") - 100).alias("s")))


@query("""WITH q AS (SELECT vec_id AS vid, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, vec_id % 10 = 0 AS none FROM embeddings)
SELECT vid, CASE WHEN none THEN 1.0 ELSE round(a / sqrt(a * a + b * b + c * c + d * d), 6) END AS rot_0, CASE WHEN none THEN 0.0 ELSE round(d / sqrt(a * a + b * b + c * c + d * d), 6) END AS rot_3 FROM q""")
def quat_norm(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("vid"), *[F.when(F.col("vec_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("embedding")[i].cast("double")).alias(f"rot_{i}") for i in range(4)])
    return rounded(scalars.normalise_quaternion(q).select("vid", "rot_0", "rot_3"))


@query("SELECT vec_id AS vid, i, round(f / greatest(n, 1e-8), 6) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS f, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def l2_norm(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.posexplode(scalars.l2_normalise("embedding")).alias("i", "v"))
    return rounded(e.select("vid", F.col("i").cast("long").alias("i"), "v"))


@query("WITH e AS (SELECT event_type AS uid, event_id AS vid, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value::DOUBLE END AS v FROM events), m AS (SELECT uid, median(v) AS m FROM e GROUP BY uid) SELECT uid, vid, round(coalesce(v, m), 6) AS opacity FROM e JOIN m USING (uid)")
def nan_repair(spark, sf):
    return rounded(scalars.repair_non_finite(_with_holes(spark, sf)))


@query("WITH e AS (SELECT event_type AS uid, event_id AS vid, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value::DOUBLE END AS v FROM events), m AS (SELECT uid, quantile_cont(v, 0.999) AS m, count(*) - count(v) AS n FROM e GROUP BY uid) SELECT uid, vid, round(coalesce(v, m), 6) AS opacity, n AS opacity_replaced FROM e JOIN m USING (uid)")
def opacity_sanitize(spark, sf):
    return rounded(scalars.sanitise_opacity(_with_holes(spark, sf)))


def _with_holes(spark, sf):
    e = read_table(spark, sf, "events")
    hole = F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return e.select(F.col("event_type").alias("uid"), F.col("event_id").alias("vid"), F.when(F.col("event_id") % 97 == 0, hole).otherwise(F.col("value").cast("double")).alias("opacity"))


# Three cameras looking down the z axis, turned about it by 0, 90 and 180 degrees.
VIEW_SQL = f"""{EVENTS_SQL}, vw AS (SELECT view_id, 1 - 2 * qz * qz AS c, 2 * qw * qz AS s FROM (VALUES (1, 1.0::DOUBLE, 0.0::DOUBLE), (2, sqrt(0.5::DOUBLE), sqrt(0.5::DOUBLE)), (3, 0.0::DOUBLE, 1.0::DOUBLE)) t(view_id, qw, qz)),
cm AS (SELECT uid, vid, view_id, c * (x - 250) - s * (y - 700) AS cx, s * (x - 250) + c * (y - 700) AS cy, z + 400 AS cz FROM ev, vw),
px AS (SELECT uid, vid, view_id, CAST(trunc(100 * cx / cz + 64) AS BIGINT) AS u, CAST(trunc(100 * cy / cz + 48) AS BIGINT) AS v, cz AS depth FROM cm),
ht AS (SELECT * FROM px WHERE u >= 0 AND v >= 0 AND u < 128 AND v < 96 AND depth > 1e-6),
zb AS (SELECT *, min(depth) OVER (PARTITION BY view_id, v, u) AS front FROM ht)"""


def _points_and_views(spark, sf):
    e = events(spark, sf).select("uid", "vid", (F.col("x") - 250).alias("x"), (F.col("y") - 700).alias("y"), (F.col("z") + 400).alias("z"))
    half = 0.5**0.5
    poses = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [half, 0.0, 0.0, half]), (3, [0.0, 0.0, 0.0, 1.0])]
    images_ = spark.createDataFrame([(i, q, [0.0, 0.0, 0.0], 1, f"{i}.png") for i, q in poses], "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string")
    cameras = spark.createDataFrame([(1, 1, 128, 96, [100.0, 100.0, 64.0, 48.0])], "camera_id int, model_id int, width long, height long, params array<double>")
    return e, views.views(images_, cameras)


def _hits(spark, sf):
    return views.project_points(*_points_and_views(spark, sf), "trunc")


@query(f"WITH {VIEW_SQL} SELECT view_id, uid, count(*) AS n, round(avg(u), 2) AS u, round(avg(v), 2) AS v, round(avg(depth), 6) AS depth FROM ht GROUP BY ALL")
def project_points(spark, sf):
    return rounded(_hits(spark, sf).groupBy("view_id", "uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 2).alias("u"), F.round(F.avg("v"), 2).alias("v"), F.avg("depth").alias("depth")))


@query(f"WITH {VIEW_SQL} SELECT view_id, count(*) AS n, count(*) FILTER (WHERE abs(depth - front) < 0.012) AS n_front, round(avg(front), 4) AS front FROM zb GROUP BY view_id")
def zbuffer(spark, sf):
    front = aggregates.front_surface(_hits(spark, sf))
    return rounded(front.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_front").alias("n_front"), F.round(F.avg("front"), 4).alias("front")))


@query(f"WITH {VIEW_SQL}, vo AS (SELECT uid, vid, count(*) AS visible, count(*) FILTER (WHERE (u + v) % 3 > 0) AS foreground FROM ht GROUP BY ALL) SELECT uid, vid, visible, foreground FROM vo WHERE visible >= 3 AND foreground::DOUBLE / visible >= 0.60")
def vote_filter(spark, sf):
    hits = cut(_hits(spark, sf), "hits")
    mask = hits.select("view_id", "v", "u", ((F.col("u") + F.col("v")) % 3).alias("val")).distinct()
    return filters.vote_filter(views.foreground_votes(hits, mask))


@query("SELECT s_suppkey AS image_id, s_name AS name, (row_number() OVER (ORDER BY s_name) - 1) % 8 = 0 AS is_test FROM supplier")
def holdout_split(spark, sf):
    return filters.holdout_split(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name")))


@query("SELECT s_suppkey, 'plant_' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS uid, 'Supplier' AS item, CASE WHEN s_suppkey % 2 = 0 THEN 'r' END AS renders FROM supplier")
def uid_regex(spark, sf):
    s = read_table(spark, sf, "supplier")
    path = F.concat(F.lit("/data/plant_"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), F.lit("_labeled.ply"))
    item = scalars.parse_item(F.concat(F.lit("Supplier|a.ply"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("|r")).otherwise(F.lit(""))))
    return s.select("s_suppkey", scalars.plant_uid(path).alias("uid"), item["name"].alias("item"), item["renders"].alias("renders"))


@query("SELECT c_custkey AS uid, CAST(unnest([c_custkey % 5, c_custkey % 7, c_nationkey]) AS INTEGER) AS cluster_id FROM customer")
def csv_list_explode(spark, sf):
    c = read_table(spark, sf, "customer")
    text = F.concat_ws("", (F.col("c_custkey") % 5).cast("string"), F.lit("，"), (F.col("c_custkey") % 7).cast("string"), F.lit(", "), F.col("c_nationkey").cast("string"), F.lit(","))
    return c.select(F.col("c_custkey").alias("uid"), F.explode(scalars.parse_id_list(text)).alias("cluster_id"))


@query()
def kmeans_fixed_k(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("feat"))
    return features.kmeans_labels(e, 10).select("vid", "cluster_id")


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), pr AS (SELECT a.vec_id AS i, a.label AS la, b.label AS lb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
m AS (SELECT i, la, lb, avg(d) AS d FROM pr GROUP BY ALL), s AS (SELECT i, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM m GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def silhouette(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), "label", F.col("embedding").alias("feat"))
    return rounded(features.silhouette(e))


@query(f"WITH {EVENTS_SQL} SELECT CASE WHEN vid % 2 = 0 THEN 'even' ELSE 'odd' END AS source, vid AS source_index, round(x, 6) AS x FROM ev")
def union_provenance(spark, sf):
    e = events(spark, sf)
    return rounded(aggregates.union_with_source({"even": e.where("vid % 2 = 0"), "odd": e.where("vid % 2 = 1")}).select("source", "source_index", "x"))


@query(f"WITH {EVENTS_SQL} SELECT uid, vid FROM ev WHERE vid % 3 <> 0")
def unused_source(spark, sf):
    e = events(spark, sf)
    return aggregates.unused_rows(e, e.where("vid % 3 = 0")).select("uid", "vid")


@query(f"""WITH {PARTS_SQL}, c AS (SELECT p_brand AS b, count(*) AS n, avg(p_size) AS l FROM part GROUP BY p_brand)
SELECT p_brand AS instance_id, count(*) AS n_points, round(max(p_retailprice) - min(p_retailprice), 6) AS height, CAST(max(p_size) - min(p_size) AS DOUBLE) AS crown_width FROM part GROUP BY p_brand""")
def phenotype_size(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("instance_id"), F.col("p_size").alias("x"), F.lit(0.0).alias("y"), F.col("p_retailprice").alias("z"))
    return rounded(phenotype.plant_size(p, ("instance_id",)).withColumnRenamed("point_count", "n_points"))


@query("WITH m AS (SELECT l_orderkey AS vid, l_suppkey % 9 AS rank, max(l_quantity) AS score FROM lineitem GROUP BY ALL) SELECT vid, CAST(arg_max(rank, score * 100 - rank) + 1 AS BIGINT) AS instance_id FROM m GROUP BY vid")
def assign_instances(spark, sf):
    cells = read_table(spark, sf, "lineitem").groupBy(F.lit(1).alias("uid"), F.col("l_orderkey").alias("vid"), (F.col("l_suppkey") % 9).alias("rank")).agg(F.max("l_quantity").alias("score"))
    return refine.assign_instances(cells).select("vid", F.col("instance_id").cast("long").alias("instance_id"))


@query("WITH m AS (SELECT DISTINCT l_orderkey AS vid, l_suppkey % 5 + 1 AS click FROM lineitem) SELECT vid, max(click) AS later, min(click) AS earlier, CASE WHEN count(*) % 2 = 0 THEN 0 ELSE max(click) END AS background FROM m GROUP BY vid")
def merge_clicks(spark, sf):
    cells = read_table(spark, sf, "lineitem").select(F.lit(1).alias("uid"), F.col("l_orderkey").alias("vid"), (F.col("l_suppkey") % 5 + 1).alias("click")).distinct()
    ways = [refine.merge_clicks(cells, m).select("vid", F.col("instance_id").cast("long").alias(m)) for m in ("later", "earlier", "background")]
    return reduce(lambda a, b: a.join(b, "vid"), ways)


@query("WITH c AS (SELECT l_suppkey AS sp, l_linenumber AS view_id, l_partkey % 4 AS label, count(*) AS n FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL) SELECT sp, view_id, label FROM (SELECT *, row_number() OVER (PARTITION BY sp, view_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1")
def superpoint_views(spark, sf):
    votes = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sp"), F.col("l_linenumber").alias("view_id"), (F.col("l_partkey") % 4).alias("label"))
    return features.superpoint_views(votes)


@query("""WITH h AS (SELECT vec_id AS instance_id, (vec_id * 0.618033988749895::DOUBLE) % 1.0::DOUBLE AS h FROM embeddings WHERE vec_id > 0), k AS (SELECT instance_id, CAST(floor(h * 6) AS INTEGER) % 6 AS i, h * 6 - floor(h * 6) AS f FROM h),
c AS (SELECT instance_id, i, 0.95::DOUBLE AS v, 0.95::DOUBLE * (1 - 0.70::DOUBLE) AS p, 0.95::DOUBLE * (1 - f * 0.70::DOUBLE) AS q, 0.95::DOUBLE * (1 - (1 - f) * 0.70::DOUBLE) AS t FROM k)
SELECT instance_id, round((CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END) * 255, 3) AS red, round((CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END) * 255, 3) AS green FROM c""")
def hsv_palette(spark, sf):
    e = read_table(spark, sf, "embeddings").where("vec_id > 0").select(F.col("vec_id").alias("instance_id"))
    r, g, _ = colors.hsv_to_rgb((F.col("instance_id").cast("double") * colors.HUE_STEP) % 1.0, 0.70, 0.95)
    return rounded(e.select("instance_id", F.round(r * 255, 3).alias("red"), F.round(g * 255, 3).alias("green")))


@query("""WITH e AS (SELECT event_type AS uid, value::DOUBLE AS x FROM events), m AS (SELECT uid, min(x) AS lo, max(x) AS hi FROM e GROUP BY uid)
SELECT uid, CAST(least(floor((x - lo) / (hi - lo) * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM e JOIN m USING (uid) GROUP BY ALL""")
def nn_histogram(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("uid"), F.col("value").cast("double").alias("x"))
    return aggregates.histogram(e, "x").select("uid", "bin", "n")


@query("WITH m AS (SELECT l_suppkey AS image_id, avg((l_discount - l_tax) * (l_discount - l_tax)) AS mse FROM lineitem GROUP BY ALL) SELECT image_id, round(CASE WHEN mse = 0 THEN 100 ELSE 20 * log10(1 / sqrt(mse)) END, 6) AS psnr FROM m")
def psnr(spark, sf):
    pairs = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_discount").alias("render"), F.col("l_tax").alias("gt"))
    return rounded(images.psnr(pairs))


@query("SELECT l_orderkey AS vid, l_linenumber AS k, CASE WHEN 2 * g - r - b >= 18 AND g > r + 8 AND g > b + 8 THEN 1 ELSE 0 END AS excess FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, (l_partkey * 7) % 256 AS g, (l_suppkey * 3) % 256 AS b FROM lineitem)")
def green_excess(spark, sf):
    p = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_partkey") * 7 % 256).alias("g"), (F.col("l_suppkey") * 3 % 256).alias("b"))
    excess = (2 * F.col("g") - F.col("r") - F.col("b") >= 18) & (F.col("g") > F.col("r") + 8) & (F.col("g") > F.col("b") + 8)
    sat = colors.rgb_to_hsv8(F.col("r"), F.col("g"), F.col("b"))[1]
    return p.select("vid", "k", F.when((colors.is_green("r", "g", "b") & (sat >= 25) & excess) | (excess & (sat < 25)), 1).otherwise(0).alias("excess"))


@query(f"WITH {SEG_SQL}, c AS (SELECT uid, pred AS cluster_id, count(*) AS n FROM sg GROUP BY ALL) SELECT uid, CAST(sum(n) AS BIGINT) AS n_points, CAST(coalesce(sum(n) FILTER (WHERE cluster_id IN (1, 3, 5)), 0) AS BIGINT) AS n_selected, round(coalesce(sum(n) FILTER (WHERE cluster_id IN (1, 3, 5)), 0)::DOUBLE / sum(n), 6) AS selected_ratio FROM c GROUP BY uid")
def selected_ratio(spark, sf):
    s = segments(spark, sf).withColumnRenamed("pred", "cluster_id")
    selection = spark.createDataFrame([(u, c) for u in (0, 1) for c in (1, 3, 5)], "uid long, cluster_id long")
    return rounded(filters.selected_ratio(s, selection))


@query(f"WITH {EVENTS_SQL}, b AS (SELECT uid, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 + 1e-10 AS h FROM ev GROUP BY uid) SELECT ev.uid, vid, round((x - cx) / h, 6) AS x_n, round((y - cy) / h, 6) AS y_n, round((z - cz) / h, 6) AS z_n FROM ev JOIN b USING (uid)")
def bbox_normalise(spark, sf):
    return rounded(scalars.normalise_bbox(events(spark, sf)).select("uid", "vid", "x_n", "y_n", "z_n"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT round_even(x / 5.0::DOUBLE, 0)::BIGINT AS a, round_even(y / 60.0::DOUBLE, 0)::BIGINT AS b, vid FROM ev), g AS (SELECT a, b, count(*) AS n FROM f GROUP BY a, b), p AS (SELECT a, b, count(*) AS m FROM f WHERE vid % 7 = 0 GROUP BY a, b), h AS (SELECT n, m FROM g FULL JOIN p USING (a, b)) SELECT CAST(sum(n) AS BIGINT) AS full_, CAST(sum(m) AS BIGINT) AS part, count(*) FILTER (WHERE n IS NOT NULL AND m IS NOT NULL) AS matched, CAST(coalesce(sum(m) FILTER (WHERE n IS NULL), 0) AS BIGINT) AS unmatched, CAST(sum(n - 1) AS BIGINT) AS duplicate_full_keys, CAST(sum(m - 1) FILTER (WHERE n IS NOT NULL) AS BIGINT) AS duplicate_part_hits FROM h")
def quantized_counts(spark, sf):
    e = events(spark, sf).select(F.lit("e").alias("uid"), "vid", (F.col("x") / 5).alias("x"), (F.col("y") / 60).alias("y"))
    _, counts = spatial.quantised_match(e, e.where("vid % 7 = 0"), 1.0, coords=("x", "y"))
    return counts.drop("uid").withColumnRenamed("full", "full_")


@query(f"WITH {EVENTS_SQL}, r AS (SELECT uid, vid, z AS depth, sqrt((x - 100) * (x - 100) + (y - 700) * (y - 700)) AS off FROM ev WHERE z > 0) SELECT uid, vid, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY off >= 20, depth, vid) AS k FROM r WHERE off < 60) WHERE k = 1")
def ray_pick(spark, sf):
    return rounded(spatial.pick_on_ray(events(spark, sf), (100.0, 700.0, 0.0), (0.0, 0.0, 1.0), 20.0, 60.0))


@query(f"WITH {EMB_SQL}, c AS (SELECT uid, label, vid % 6 AS part, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM em GROUP BY ALL), p AS (SELECT s.uid, s.label, s.part, d.part AS near_part, sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y) + (s.z - d.z) * (s.z - d.z)) AS dd FROM c s JOIN c d ON s.uid = d.uid AND s.label = d.label WHERE s.part >= 4 AND d.part < 4) SELECT uid, label, part, near_part FROM (SELECT *, row_number() OVER (PARTITION BY uid, label, part ORDER BY dd, near_part) AS k FROM p) WHERE k = 1")
def nearest_centroid(spark, sf):
    c = vectors(spark, sf).groupBy("uid", "label", (F.col("vid") % 6).alias("part")).agg(*[F.avg(n).alias(n) for n in "xyz"])
    return spatial.nearest_centroid(c.where("part >= 4"), c.where("part < 4"), "label")


@query(f"WITH {EMB_SQL} SELECT a.uid, a.vid AS src, b.vid AS dst FROM em a JOIN em b ON a.uid = b.uid AND a.vid < b.vid WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.04")
def close_centroids(spark, sf):
    return spatial.close_pairs(vectors(spark, sf), 0.04, ("uid",)).select("uid", "src", "dst")


@query("WITH l AS (SELECT l_suppkey AS uid, l_orderkey * 10 + l_linenumber AS vid, CASE WHEN l_partkey % 40 < 30 THEN -1 ELSE l_partkey % 9 END AS label FROM lineitem), c AS (SELECT uid, label, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY uid) AS al FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, label) AS k FROM s WHERE label <> -1) SELECT l.uid, l.vid, l.label FROM l JOIN r ON r.uid = l.uid AND r.label = l.label WHERE k = 1 OR (k <= 5 AND n >= 0.01 * al)")
def largest_clusters(spark, sf):
    l_ = read_table(spark, sf, "lineitem")
    rows = l_.select(F.col("l_suppkey").alias("uid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vid"), F.when(F.col("l_partkey") % 40 < 30, -1).otherwise(F.col("l_partkey") % 9).alias("label"))
    return aggregates.largest_clusters(rows)


@query("WITH m AS (SELECT l_orderkey % 50 AS view_id, l_suppkey % 4 AS box_id, l_partkey % 3 AS mask_id, count(*) AS n_pixels, count(*) FILTER (WHERE l_quantity > 44) AS n_green, sum(l_linenumber) AS score FROM lineitem GROUP BY ALL), s AS (SELECT *, n_green::DOUBLE / n_pixels AS sh FROM m), t AS (SELECT *, row_number() OVER (PARTITION BY view_id, box_id ORDER BY sh DESC, mask_id) AS g, row_number() OVER (PARTITION BY view_id, box_id ORDER BY score DESC, mask_id) AS k FROM s) SELECT view_id, box_id, CASE WHEN max(sh) > 0.1 THEN max(mask_id) FILTER (WHERE g = 1) ELSE max(mask_id) FILTER (WHERE k = 1) END AS mask_id FROM t GROUP BY view_id, box_id")
def choose_masks(spark, sf):
    cells = read_table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("view_id"), (F.col("l_suppkey") % 4).alias("box_id"), (F.col("l_partkey") % 3).alias("mask_id"))
    return refine.choose_masks(cells.agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("l_quantity") > 44).alias("n_green"), F.sum("l_linenumber").alias("score")))


SUPER_SQL = """st AS (SELECT l_suppkey AS sp, avg(l_discount * 4) AS confidence, avg(l_quantity) AS x, avg(l_tax * 100) AS y, avg(l_linenumber) AS z FROM lineitem GROUP BY l_suppkey), c AS (SELECT l_suppkey AS sp, l_linenumber AS view_id, l_partkey % 3 + 1 AS label, count(*) AS n FROM lineitem WHERE l_linenumber > 3 + l_suppkey % 4 GROUP BY ALL),
vw AS (SELECT sp, view_id, label FROM (SELECT *, row_number() OVER (PARTITION BY sp, view_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1)"""


@query(f"WITH {SUPER_SQL}, ag AS (SELECT p.sp AS a, q.sp AS b, avg(CASE WHEN p.label = q.label THEN 1.0::DOUBLE ELSE 0 END) AS ag FROM vw p JOIN vw q ON p.view_id = q.view_id AND p.sp < q.sp GROUP BY ALL) SELECT x.sp AS a, y.sp AS b, round(CASE WHEN ag >= 0.65 THEN 0.02 * (1 - ag) WHEN ag IS NOT NULL THEN 50 WHEN x.confidence < 0.25 OR y.confidence < 0.25 THEN 2 ELSE 0.25 END, 6) AS distance FROM st x JOIN st y ON x.sp < y.sp AND sqrt((x.x - y.x) * (x.x - y.x) + (x.y - y.y) * (x.y - y.y) + (x.z - y.z) * (x.z - y.z)) < 0.8 LEFT JOIN ag ON ag.a = x.sp AND ag.b = y.sp")
def superpoint_distances(spark, sf):
    rows = read_table(spark, sf, "lineitem")
    stats = cut(rows.groupBy(F.col("l_suppkey").alias("sp")).agg(F.avg(F.col("l_discount") * 4).alias("confidence"), F.avg("l_quantity").alias("x"), F.avg(F.col("l_tax") * 100).alias("y"), F.avg("l_linenumber").alias("z")), "superpoints")
    votes = rows.where(F.col("l_linenumber") > 3 + F.col("l_suppkey") % 4).select(F.col("l_suppkey").alias("sp"), F.col("l_linenumber").alias("view_id"), (F.col("l_partkey") % 3 + 1).alias("label"))
    return features.superpoint_distances(stats, features.superpoint_views(votes), within=0.8, digits=6)


@query(f"WITH {VIEW_SQL}, c AS (SELECT uid, vid, CAST(round_even(avg((u * 3 + v) % 256), 0) AS INTEGER) AS red FROM ht GROUP BY ALL) SELECT ev.uid, ev.vid, coalesce(c.red, 180) AS red FROM ev LEFT JOIN c ON c.uid = ev.uid AND c.vid = ev.vid")
def colourise(spark, sf):
    hits = cut(_hits(spark, sf), "hits")
    shade = (F.col("u") * 3 + F.col("v")) % 256
    pixels = hits.select("view_id", "v", "u", shade.alias("red"), shade.alias("green"), shade.alias("blue")).distinct()
    return views.colourise(events(spark, sf), hits, pixels).select("uid", "vid", F.col("red").cast("int").alias("red"))


@query(f"WITH {VIEW_SQL}, o AS (SELECT * FROM (VALUES (0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)) t(dx, dy)), d AS (SELECT view_id, u + dx AS u, v + dy AS v, depth FROM ht, o WHERE u + dx >= 0 AND v + dy >= 0 AND u + dx < 128 AND v + dy < 96) SELECT view_id, v, u, round(min(depth), 6) AS depth FROM d GROUP BY ALL")
def splat_canvas(spark, sf):
    hits = cut(_hits(spark, sf), "hits")
    points = events(spark, sf).select("uid", "vid", *[F.lit(1).alias(c) for c in ("red", "green", "blue")])
    frame = hits.select("view_id").distinct().withColumns({"width": F.lit(128), "height": F.lit(96)})
    return rounded(views.render(points, hits, frame, 1)[0].select("view_id", "v", "u", "depth"))


@query("""WITH p AS (SELECT l_suppkey AS image_id, l_partkey % 640 + l_discount AS x, (l_partkey * 7) % 480 + l_tax AS y FROM lineitem WHERE l_linenumber > 1), q AS (SELECT image_id, count(*) AS n, quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1 FROM p GROUP BY image_id),
m AS (SELECT image_id, n, x0 - greatest(1.0, x1 - x0) * 0.1::DOUBLE AS a, x1 + greatest(1.0, x1 - x0) * 0.1::DOUBLE AS b, y0 - greatest(1.0, y1 - y0) * 0.1::DOUBLE AS c, y1 + greatest(1.0, y1 - y0) * 0.1::DOUBLE AS d FROM q)
SELECT image_id, CAST(greatest(0, floor(a)) AS BIGINT) AS "left", CAST(greatest(0, floor(c)) AS BIGINT) AS top, CAST(least(640, ceil(b)) AS BIGINT) AS "right", CAST(least(480, ceil(d)) AS BIGINT) AS bottom, n AS valid_points FROM m""")
def roi_crop(spark, sf):
    spot = F.struct((F.col("l_partkey") % 640 + F.col("l_discount")).alias("x"), (F.col("l_partkey") * 7 % 480 + F.col("l_tax")).alias("y"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).otherwise(-1).cast("long").alias("point3d_id"))
    ims = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.collect_list(spot).alias("points2d"))
    return views.roi_crop(ims.withColumns({"width": F.lit(640).cast("long"), "height": F.lit(480).cast("long")}))


@query("WITH l AS (SELECT event_type AS uid, user_id AS vid, CAST(value AS DOUBLE) AS v FROM events), m AS (SELECT uid, max(v) AS mx FROM l GROUP BY uid) SELECT l.uid, vid, count(*) AS n, round(sum(CASE WHEN mx > 1.5 THEN v / 255.0::DOUBLE ELSE v END), 4) AS s FROM l JOIN m USING (uid) GROUP BY ALL")
def rescale_colors(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("uid"), F.col("user_id").alias("vid"), F.col("value").alias("red"))
    return rounded(scalars.rescale_colors(e, names=("red", "red")).groupBy("uid", "vid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("red"), 4).alias("s")))


@query("WITH r AS (SELECT o_orderkey AS k, o_custkey % 11 AS a, CASE WHEN o_orderstatus = 'F' THEN 'late' ELSE '' END AS e1, CASE WHEN o_custkey % 3 = 0 THEN 'x' END AS e2 FROM orders) SELECT k, concat_ws('; ', nullif(e1, ''), nullif(e2, '')) AS errors, CASE WHEN e1 <> '' OR coalesce(e2, '') <> '' THEN 'failed' WHEN a > 0 THEN 'ok' ELSE 'pending' END AS status FROM r")
def run_status(spark, sf):
    o = read_table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 11 > 0, 1).alias("a"), F.when(F.col("o_orderstatus") == "F", "late").otherwise("").alias("e1"), F.when(F.col("o_custkey") % 3 == 0, "x").alias("e2"))
    return aggregates.run_status(rows, ["a"], ["e1", "e2"]).select("k", "errors", "status")


@query("SELECT p_brand AS uid, round(avg(p_size), 6) AS mean_size, max(p_type) AS kind FROM part GROUP BY p_brand UNION ALL SELECT 'MEAN', round((SELECT avg(m) FROM (SELECT round(avg(p_size), 6) AS m FROM part GROUP BY p_brand)), 6), ''")
def mean_row(spark, sf):
    p = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("uid")).agg(F.round(F.avg("p_size"), 6).alias("mean_size"), F.max("p_type").alias("kind"))
    out = aggregates.mean_row(p)
    return rounded(out.select("uid", F.col("mean_size").cast("double").alias("mean_size"), "kind"))


@query("WITH c AS (SELECT c_nationkey AS image_id, c_custkey % 50 AS value, count(*) AS n FROM customer GROUP BY ALL) SELECT image_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, value) AS r FROM c) WHERE r = 1")
def dominant_ids(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("image_id"), (F.col("c_custkey") % 50).alias("value"))
    return aggregates.dominant(c, "value", ("image_id",))


@query()
def auto_k(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("feat"))
    return features.auto_k(e)[2].select("vid", "cluster_id")


@query()
def evaluate_flow(spark, sf):
    from phyllo.plans import pipelines

    e = cut(vectors(spark, sf).withColumn("uid", F.col("uid").cast("string")), "emb")
    pred = e.select("uid", "vid", (F.when(F.col("vid") % 5 < 4, F.col("label")).otherwise(F.col("vid") % 10) - 1).alias("label0"))
    return pipelines.evaluate(e.withColumnRenamed("label", "gt"), e.select("uid", "vid", "x", "y", "z"), pred)
