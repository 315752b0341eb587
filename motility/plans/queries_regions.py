"""Queries of the region and detection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from motility.operators import detections as D
from motility.operators import regions as R
from motility.plans.registry import query

K = "capture, t"
SHIFTED = "b AS (SELECT capture, t, z, y, x + 1 AS x, label + 100000 AS label FROM voxels)"


def _shifted(v):
    return v.voxels.withColumn("x", F.col("x") + 1).withColumn("label", F.col("label") + 100000)


@query("c1_label_components", """
WITH RECURSIVE n AS (SELECT *, row_number() OVER (ORDER BY capture, t, z, y, x) AS id FROM voxels),
s AS (SELECT a, b, unnest(range(-1, 2)) AS c FROM (SELECT a, unnest(range(-1, 2)) AS b FROM (SELECT unnest(range(-1, 2)) AS a))),
e AS MATERIALIZED (SELECT n.id AS p, m.id AS q FROM (SELECT id, capture, t, z + a AS z, y + b AS y, x + c AS x FROM n, s) m JOIN n USING (capture, t, z, y, x) WHERE n.id != m.id),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id FROM n
  UNION (SELECT u.id, min(w.comp) FROM cc w JOIN e ON e.q = w.id JOIN recurring.cc u ON u.id = e.p WHERE w.comp < u.comp GROUP BY u.id))
SELECT capture, t, z, y, x, dense_rank() OVER (PARTITION BY capture, t ORDER BY comp) AS component FROM n JOIN cc USING (id)""", "voxels")
def c1(v):
    return R.label_components(v.voxels.select("capture", "t", "z", "y", "x"))


@query("c2_drop_small", "SELECT capture, t, z, y, x, label FROM voxels QUALIFY count(*) OVER (PARTITION BY capture, t, label) > 50", "voxels")
def c2(v):
    return R.drop_small(v.voxels, 50).select("capture", "t", "z", "y", "x", "label")


@query("c3_keep_largest", """
WITH s AS (SELECT capture, t, label, row_number() OVER (PARTITION BY capture, t ORDER BY count(*) DESC, label) AS k FROM voxels GROUP BY capture, t, label)
SELECT capture, t, z, y, x, label FROM voxels JOIN s USING (capture, t, label) WHERE k = 1""", "voxels")
def c3(v):
    return R.keep_largest(v.voxels).select("capture", "t", "z", "y", "x", "label")


@query("c4_fill_holes", """
WITH RECURSIVE m AS (SELECT capture, t, z, y, x FROM voxels WHERE (z * 7 + y * 3 + x) % 11 != 0),
b AS (SELECT capture, t, min(z) AS z1, max(z) AS z2, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM m GROUP BY ALL),
g AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM (SELECT *, unnest(range(z1, z2 + 1)) AS z FROM b))),
o AS MATERIALIZED (SELECT g.* FROM g ANTI JOIN m USING (capture, t, z, y, x)),
s(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
r AS (SELECT capture, t, z, y, x FROM o WHERE z IN (z1, z2) OR y IN (y1, y2) OR x IN (x1, x2)
  UNION SELECT o.capture, o.t, o.z, o.y, o.x FROM (SELECT capture, t, z + a AS z, y + b AS y, x + c AS x FROM r, s) k JOIN o USING (capture, t, z, y, x))
SELECT capture, t, z, y, x FROM m UNION ALL SELECT capture, t, z, y, x FROM o ANTI JOIN r USING (capture, t, z, y, x)""", "voxels")
def c4(v):
    shell = v.voxels.where("(z * 7 + y * 3 + x) % 11 != 0")
    return R.fill_holes(shell)


@query("c5_region_boxes", "SELECT capture, t, label, min(y) - 1 AS y1, min(x) - 1 AS x1, max(y) + 1 AS y2, max(x) + 1 AS x2, min(z) - 1 AS z1, max(z) + 1 AS z2 FROM voxels GROUP BY ALL", "voxels")
def c5(v):
    return R.region_boxes(v.voxels)


PROPS = """SELECT capture, t, label, count(*) AS volume, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, max(z) - min(z) + 1 AS dz, max(y) - min(y) + 1 AS dy, max(x) - min(x) + 1 AS dx,
round(covar_pop(z, z), 6) + 0.0::DOUBLE AS m_zz, round(covar_pop(y, x), 6) + 0.0::DOUBLE AS m_yx, round(cbrt(6 / pi() * count(*)), 6) AS diameter,
round(count(*)::DOUBLE / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS extent FROM voxels GROUP BY capture, t, label"""


@query("c6_region_moments", PROPS, "voxels")
def c6(v):
    m = R.region_moments(v.voxels)
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return m.select("capture", "t", "label", "volume", r("cz"), r("cy"), r("cx"), "dz", "dy", "dx", r("m_zz"), r("m_yx"), r("diameter"), r("extent"))


@query("c6_region_props")
def c6_axes(v):
    return R.region_props(v.voxels)


@query("c7_shape_scores", """
WITH b AS (SELECT box_id, y2 - y1 AS p, x2 - x1 AS q, z2 - z1 AS r FROM boxes),
s AS (SELECT box_id, p * q * r AS v, 2 * (p * q + q * r + p * r) AS surf, list_sort([p, q, r]) AS a FROM b)
SELECT box_id, round(pi() ** (1.0 / 3) * (6 * v) ** (2.0 / 3) / surf, 6) AS sphericity,
 round(2 * a[1] * a[1] / (a[1] * a[1] + a[2] * a[2]) * ((a[3] * a[3] - a[1] * a[1]) / (a[3] * a[3])), 6) AS prolate,
 round(2 * a[2] * a[2] / (a[2] * a[2] + a[3] * a[3]) * ((a[3] * a[3] - a[1] * a[1]) / (a[3] * a[3])), 6) AS oblate FROM s""", "boxes")
def c7(v):
    b = v.boxes.select("box_id", (F.col("y2") - F.col("y1")).alias("p"), (F.col("x2") - F.col("x1")).alias("q"), (F.col("z2") - F.col("z1")).alias("r"))
    b = b.withColumn("volume", F.col("p") * F.col("q") * F.col("r")).withColumn("surface", 2 * (F.col("p") * F.col("q") + F.col("q") * F.col("r") + F.col("p") * F.col("r")))
    return R.shape_scores(b, axes=("p", "q", "r")).select("box_id", *(F.round(c, 6).alias(c) for c in ("sphericity", "prolate", "oblate")))


@query("c8_surface_area", """
WITH s(a, b, c) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
f AS (SELECT capture, t, label, z + a AS z, y + b AS y, x + c AS x FROM voxels, s)
SELECT capture, t, label, count(*) AS surface FROM f ANTI JOIN voxels USING (capture, t, label, z, y, x) GROUP BY capture, t, label""", "voxels")
def c8(v):
    return R.surface_area(v.voxels)


@query("c8_solidity")
def c8_hull(v):
    return R.solidity(v.voxels)


@query("c9_region_mean_score", "SELECT capture, t, z, y, x, round(avg((z * 5 + y * 3 + x) % 100 / 100.0::DOUBLE) OVER (PARTITION BY capture, t, label), 6) AS score FROM voxels", "voxels")
def c9(v):
    scored = v.voxels.withColumn("score", ((F.col("z") * 5 + F.col("y") * 3 + F.col("x")) % 100) / F.lit(100.0))
    return R.region_mean_score(scored).select("capture", "t", "z", "y", "x", F.round("score", 6).alias("score"))


@query("c10_compact_labels", "SELECT capture, t, z, y, x, dense_rank() OVER (PARTITION BY capture, t ORDER BY label) AS label FROM voxels", "voxels")
def c10(v):
    return R.compact_labels(v.voxels).select("capture", "t", "z", "y", "x", "label")


@query("c11_build_nodes", "SELECT capture, t, label, n, row_number() OVER (PARTITION BY capture ORDER BY t, label) AS node_id FROM (SELECT capture, t, label, count(*) AS n FROM voxels GROUP BY ALL)", "voxels")
def c11(v):
    return R.build_nodes(v.voxels.groupBy("capture", "t", "label").agg(F.count("*").alias("n")))


SEEDS = "s AS (SELECT capture, t, label, seed, min(z) + seed AS sz, min(y) + seed * 2 AS sy, max(x) - seed AS sx FROM voxels, (SELECT unnest(range(0, 3)) AS seed) GROUP BY capture, t, label, seed)"


@query("c12_partition_by_seed", f"""
WITH {SEEDS} SELECT capture, t, label, z, y, x, seed FROM voxels JOIN s USING (capture, t, label)
QUALIFY row_number() OVER (PARTITION BY capture, t, label, z, y, x ORDER BY (z - sz) ** 2 + (y - sy) ** 2 + (x - sx) ** 2, seed) = 1""", "voxels")
def c12(v):
    box = v.voxels.groupBy("capture", "t", "label").agg(F.min("z").alias("a"), F.min("y").alias("b"), F.max("x").alias("c")).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    seeds = box.select("capture", "t", "label", "seed", (F.col("a") + F.col("seed")).alias("sz"), (F.col("b") + F.col("seed") * 2).alias("sy"), (F.col("c") - F.col("seed")).alias("sx"))
    return R.partition_by_seed(v.voxels, seeds)


OVERLAP = """WITH {b}, i AS (SELECT capture, t, a.label AS la, b.label AS lb, count(*) AS n FROM voxels a JOIN b USING (capture, t, z, y, x) GROUP BY ALL),
na AS (SELECT capture, t, label AS la, count(*) AS na FROM voxels GROUP BY ALL), nb AS (SELECT capture, t, label AS lb, count(*) AS nb FROM b GROUP BY ALL)
SELECT capture, t, la, lb, n AS inter, na, nb, round(n::DOUBLE / (na + nb - n), 6) AS iou FROM i JOIN na USING (capture, t, la) JOIN nb USING (capture, t, lb)"""


@query("c13_label_overlaps", OVERLAP.format(b=SHIFTED), "voxels")
def c13(v):
    return R.label_overlaps(v.voxels, _shifted(v)).withColumn("iou", F.round("iou", 6))


@query("c14_merge_oversegmented")
def c14(v):
    pieces = v.voxels.withColumn("label", F.col("label") * 4 + F.col("x") % 2 * 2 + F.col("y") % 2)
    return R.merge_oversegmented(R.label_overlaps(pieces, _shifted(v)))


@query("d1_filter_detections", "SELECT box_id, score FROM boxes WHERE (y2 - y1) * (x2 - x1) * (z2 - z1) > 0 AND score >= 0.1", "boxes")
def d1(v):
    return D.filter_detections(v.boxes).select("box_id", "score")


@query("d2_clamp_boxes", "SELECT box_id, " + ", ".join(f"least(greatest({c} + 1, 1), {n})::DOUBLE AS {c}" for c, n in (("y1", 150), ("y2", 150), ("x1", 180), ("x2", 180), ("z1", 12), ("z2", 12))) + " FROM boxes", "boxes")
def d2(v):
    return D.clamp_boxes(v.boxes, {"y": 150, "x": 180, "z": 12}).select("box_id", "y1", "y2", "x1", "x2", "z1", "z2")


def _iou_sql(extra: int) -> str:
    both = " * ".join(f"greatest(0, least(a.{c}2, b.{c}2) - greatest(a.{c}1, b.{c}1) + {extra})" for c in "yxz")
    one = lambda p: " * ".join(f"({p}.{c}2 - {p}.{c}1 + {extra})" for c in "yxz")
    return f"""SELECT capture, t, box_a, box_b, round(i / (va + vb - i), 6) AS iou FROM (
SELECT a.capture, a.t, a.box_id AS box_a, b.box_id AS box_b, {both} AS i, {one('a')} AS va, {one('b')} AS vb
FROM boxes a JOIN boxes b ON a.capture = b.capture AND a.t = b.t WHERE (a.box_id // 200) % 2 = 0 AND (b.box_id // 200) % 2 = 1) WHERE i > 0"""


@query("d3_box_iou", _iou_sql(0), "boxes")
def d3(v):
    return D.box_iou(v.boxes.where("box_id div 200 % 2 = 0"), v.boxes.where("box_id div 200 % 2 = 1")).withColumn("iou", F.round("iou", 6))


@query("d3_box_iou_inclusive", _iou_sql(1), "boxes")
def d3_inclusive(v):
    return D.box_iou(v.boxes.where("box_id div 200 % 2 = 0"), v.boxes.where("box_id div 200 % 2 = 1"), mode="inclusive").withColumn("iou", F.round("iou", 6))


@query("d4_mask_iou_by_plane", """
WITH p AS (SELECT capture, t, z, count(*) FILTER (label % 3 != 0 AND label % 4 != 0) AS i, count(*) FILTER (label % 3 != 0 OR label % 4 != 0) AS u FROM voxels GROUP BY ALL)
SELECT capture, t, round(avg(i::DOUBLE / u), 6) AS iou, count(*) AS planes FROM p WHERE u > 0 GROUP BY capture, t""", "voxels")
def d4(v):
    return D.mask_iou_by_plane(v.voxels.where("label % 3 != 0"), v.voxels.where("label % 4 != 0")).withColumn("iou", F.round("iou", 6))


@query("d5_label_detections", """
WITH m AS (SELECT capture, t, z, y, x, label % 3 != 0 AS p, label % 4 != 0 AS q FROM voxels WHERE label % 3 != 0 OR label % 4 != 0),
h AS (SELECT box_id, count(*) FILTER (p AND q) AS i, count(*) AS u, count(*) FILTER (q) AS nq FROM boxes b JOIN m ON b.capture = m.capture AND b.t = m.t
  AND m.z >= z1 AND m.z < z2 AND m.y >= y1 AND m.y < y2 AND m.x >= x1 AND m.x < x2 GROUP BY box_id)
SELECT box_id, CASE WHEN nq > 0 AND i::DOUBLE / u > 0.5 THEN 1 ELSE 0 END AS true_label FROM boxes LEFT JOIN h USING (box_id)""", "voxels boxes")
def d5(v):
    return D.label_detections(v.boxes, v.voxels.where("label % 3 != 0"), v.voxels.where("label % 4 != 0")).select("box_id", "true_label")


@query("d6_roc_auc", """
WITH r AS (SELECT kind, label, rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2.0::DOUBLE AS rk FROM (SELECT id % 5 AS kind, score, CASE WHEN id % 5 = 4 THEN 1 ELSE label END AS label FROM scored)),
s AS (SELECT kind, sum(label) AS p, count(*) - sum(label) AS n, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY kind)
SELECT kind, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) ELSE 1 END, 6) AS auc FROM s""", "scored")
def d6(v):
    rows = v.scored.withColumn("kind", F.col("id") % 5).withColumn("label", F.when(F.col("kind") == 4, F.lit(1).cast("long")).otherwise(F.col("label")))
    return D.roc_auc(rows, by=["kind"]).withColumn("auc", F.round("auc", 6))


@query("d7_dice", """
WITH e AS (SELECT raw % 3 AS truth, exp(l0) AS a, exp(l1) AS b, exp(l2) AS c FROM grid), p AS (SELECT truth, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM e),
s AS (SELECT sum(p1 * (truth = 1)::INT) AS i1, sum(p1 * (truth = 1)::INT + 2 * p1 * (truth != 1)::INT) AS q1, sum((truth = 1)::INT) AS t1, sum(p2 * (truth = 2)::INT) AS i2, sum(p2 * (truth = 2)::INT + 2 * p2 * (truth != 2)::INT) AS q2, sum((truth = 2)::INT) AS t2 FROM p),
d AS (SELECT (2 * i1 + 1e-6) / (q1 + t1 + 1e-6) AS d1, (2 * i2 + 1e-6) / (q2 + t2 + 1e-6) AS d2 FROM s)
SELECT round(d1, 6) AS dice_1, round(d2, 6) AS dice_2, round((d1 + d2) / 2, 6) AS dice FROM d""", "grid")
def d7(v):
    from motility.operators.voxels import softmax_argmax

    p = softmax_argmax(v.grid, ["l0", "l1", "l2"]).select((F.col("raw") % 3).alias("truth"), *(F.col("prob")[i].alias(f"p{i}") for i in range(3)))
    return D.dice(p, ["p0", "p1", "p2"], "truth", fp_weight=2.0).select(*(F.round(c, 6).alias(c) for c in ("dice_1", "dice_2", "dice")))


@query("d8_detections_for_tile", "SELECT box_id FROM boxes WHERE box_id % 4 = 2 AND capture < 4 AND t <= 10", "boxes")
def d8(v):
    boxes = v.boxes.withColumn("k", F.col("box_id") % 4)
    tiles = v.boxes.where("capture < 4 and t <= 10").select("capture", "t").distinct().withColumn("k", F.lit(2).cast("long"))
    return D.detections_for_tile(boxes, tiles, ["capture", "t", "k"]).select("box_id")
