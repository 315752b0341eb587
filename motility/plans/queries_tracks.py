"""Queries of the tracking, dynamics and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from motility.operators import dynamics as G
from motility.operators import features as W
from motility.operators import selection as H
from motility.operators import tracks as T
from motility.plans.registry import query
from motility.sources.tables import merged

KEYS = "grp, volume, capture"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query("f1_match_nodes", """
WITH d AS (SELECT grp, volume, capture, t, node_id AS det_id, z + 0.25 AS z, y + 3 AS y, x - 2 AS x FROM track_nodes WHERE node_id % 3 = 0),
b AS (SELECT grp, volume, capture, t, det_id, node_id, (d.z - n.z) * (d.z - n.z) + (d.y - n.y) * (d.y - n.y) + (d.x - n.x) * (d.x - n.x) AS q FROM d JOIN track_nodes n USING (grp, volume, capture, t))
SELECT grp, volume, capture, t, det_id, node_id, round(sqrt(q), 6) AS distance FROM b QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY q, node_id DESC) = 1""", "track_nodes")
def f1(v):
    dets = v.track_nodes.where("node_id % 3 = 0").select("grp", "volume", "capture", "t", F.col("node_id").alias("det_id"), (F.col("z") + 0.25).alias("z"), (F.col("y") + 3).alias("y"), (F.col("x") - 2).alias("x"))
    return rounded(T.match_nodes(dets, v.track_nodes, cell=32.0), "distance")


@query("f2_link_detections")
def f2(v):
    nodes = v.track_nodes.withColumns({"dz": F.lit(4.0), "dx": F.col("dx") * 4, "dy": F.col("dy") * 4, "diameter": F.cbrt("vol"), "surface": F.col("dx") * F.col("dy")})
    return T.link_detections(nodes)


COLLISIONS = f"""WITH l AS (SELECT *, min(t) OVER (PARTITION BY {KEYS}, track_id) AS t0, max(t) OVER (PARTITION BY {KEYS}, track_id) AS t1, min(t) OVER (PARTITION BY {KEYS}) AS f0, max(t) OVER (PARTITION BY {KEYS}) AS f1 FROM n),
o AS (SELECT *, 'separation' AS kind, t - 1 AS near FROM l WHERE t = t0 AND t > f0 UNION ALL SELECT *, 'collision' AS kind, t + 1 AS near FROM l WHERE t = t1 AND t < f1),
p AS (SELECT o.grp, o.volume, o.capture, kind, o.t, o.track_id, near, min(n.track_id) AS other FROM o JOIN n ON o.grp = n.grp AND o.volume = n.volume AND o.capture = n.capture AND o.near = n.t AND o.track_id != n.track_id
  AND abs(o.x - n.x) * 2 < o.dx + n.dx AND abs(o.y - n.y) * 2 < o.dy + n.dy GROUP BY ALL)
SELECT {KEYS}, kind, t, track_id, other FROM p QUALIFY row_number() OVER (PARTITION BY {KEYS}, kind, near, other ORDER BY track_id) = 1"""
BIG = "n AS (SELECT grp, volume, capture, track_id, node_id, t + track_id % 3 AS t, x, y, dx * 10 AS dx, dy * 10 AS dy FROM track_nodes WHERE node_id % 17 != 0)"


def _big(v):
    return v.track_nodes.where("node_id % 17 != 0").withColumns({"t": F.col("t") + F.col("track_id") % 3, "dx": F.col("dx") * 10, "dy": F.col("dy") * 10})


@query("f3_collisions", COLLISIONS.replace("WITH l", f"WITH {BIG}, l"), "track_nodes")
def f3(v):
    return T.collisions(_big(v))


@query("f4_event_spans", f"""
WITH {BIG}, ev AS ({COLLISIONS.replace("WITH l", f"WITH {BIG}, l")}),
r AS (SELECT {KEYS}, track_id, t, t - row_number() OVER (PARTITION BY {KEYS}, track_id ORDER BY t) AS run FROM n),
q AS (SELECT {KEYS}, track_id AS other, t AS first, min(t) OVER (PARTITION BY {KEYS}, track_id, run) AS lo, max(t) OVER (PARTITION BY {KEYS}, track_id, run) AS hi, min(t) OVER (PARTITION BY {KEYS}, track_id) AS t0, max(t) OVER (PARTITION BY {KEYS}, track_id) AS t1 FROM r),
a AS (SELECT ev.*, lo, hi, t0, t1 FROM ev JOIN q ON ev.grp = q.grp AND ev.volume = q.volume AND ev.capture = q.capture AND ev.other = q.other AND q.first = ev.t + CASE WHEN kind = 'collision' THEN 1 ELSE -1 END),
w AS (SELECT *, lead(t) OVER g AS nx, lag(t) OVER g AS pv FROM a WINDOW g AS (PARTITION BY {KEYS}, other ORDER BY t, kind, track_id)),
e AS (SELECT *, CASE WHEN kind = 'collision' THEN abs(hi - t) ELSE abs(lo - t) END AS reach, CASE WHEN kind = 'collision' THEN hi != t1 ELSE lo != t0 END AS gap, CASE WHEN kind = 'collision' THEN nx ELSE pv END AS evt FROM w),
c AS (SELECT *, CASE WHEN evt IS NOT NULL AND abs(evt - t) <= reach THEN abs(evt - t) // 2 WHEN gap THEN reach WHEN reach <= 5 THEN reach ELSE 0 END AS k FROM e)
SELECT {KEYS}, kind, t, track_id, other, t + CASE WHEN kind = 'collision' THEN 1 ELSE -1 END * i AS frame FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM c WHERE k > 0)""", "track_nodes")
def f4(v):
    big = _big(v)
    return T.event_spans(T.collisions(big), big)


@query("f5_track_table", "SELECT track_id, t, node_id FROM track_nodes WHERE node_id > 0", "track_nodes")
def f5(v):
    frames = [r[0] for r in v.track_nodes.select("t").distinct().orderBy("t").collect()]  # a matrix has a column per frame
    matrix = T.track_matrix(v.track_nodes, frames)
    return T.track_table(matrix, [f"t{t}" for t in frames]).select("track_id", "t", "node_id")


NETWORK = f"""WITH h AS (SELECT *, sqrt((z - lag(z) OVER g) ** 2 + (y - lag(y) OVER g) ** 2 + (x - lag(x) OVER g) ** 2) AS hop FROM track_nodes WINDOW g AS (PARTITION BY {KEYS}, track_id ORDER BY t, node_id)),
s AS (SELECT {KEYS}, track_id, count(*) AS n_nodes, coalesce(sum(hop), 0) AS path, max(hop) AS max_step, avg(hop) AS mean_step, avg(z) AS mean_depth,
 arg_max(z, t) - arg_min(z, t) AS gz, arg_max(y, t) - arg_min(y, t) AS gy, arg_max(x, t) - arg_min(x, t) AS gx FROM h GROUP BY ALL), e AS (SELECT *, sqrt(gz * gz + gy * gy + gx * gx) AS ends FROM s)
SELECT {KEYS}, track_id, n_nodes, round(path, 6) AS path, round(max_step, 6) AS max_step, round(mean_step, 6) AS mean_step, round(ends, 6) AS ends, round(ends / path, 6) AS meander, round(path / ends, 6) AS tortuosity, round(mean_depth, 6) AS mean_depth, round(acos(gx / sqrt(gy * gy + gx * gx)), 6) AS angle FROM e"""


@query("f6_distance_network", NETWORK, "track_nodes")
def f6(v):
    return rounded(T.distance_network(v.track_nodes), "path", "max_step", "mean_step", "ends", "meander", "tortuosity", "mean_depth", "angle")


OUTLIERS = f"""WITH a AS (SELECT *, dx * dy AS area, count(*) OVER g AS n, avg(vol) OVER g AS m, median(vol) OVER g AS vm, median(dx * dy) OVER g AS am FROM track_nodes WINDOW g AS (PARTITION BY {KEYS}, track_id)),
b AS (SELECT *, median(abs(vol - vm)) OVER g * 1.4826::DOUBLE AS vd, median(abs(area - am)) OVER g * 1.4826::DOUBLE AS ad FROM a WINDOW g AS (PARTITION BY {KEYS}, track_id)),
f7 AS (SELECT {KEYS}, track_id, t, node_id, CASE WHEN n > 10 AND (vol / m > 5 OR vol / m < 0.2::DOUBLE OR abs(area - am) > 10 * ad) THEN CASE WHEN vol > vm - 3 * vd THEN 'agglomeration' WHEN vol < vm THEN 'separation' END END AS outlier FROM b)"""


@query("f7_track_outliers", f"{OUTLIERS} SELECT node_id, outlier FROM f7", "track_nodes")
def f7(v):
    return T.track_outliers(v.track_nodes).select("node_id", "outlier")


@query("f8_nearest_valid_frame", f"""
{OUTLIERS} SELECT o.grp, o.volume, o.capture, o.track_id, o.t, o.node_id, w.t AS ref_t, w.node_id AS ref_node FROM f7 o JOIN f7 w ON o.track_id = w.track_id AND o.outlier IS NOT NULL AND w.outlier IS NULL
QUALIFY row_number() OVER (PARTITION BY o.node_id ORDER BY abs(o.t - w.t), w.t) = 1""", "track_nodes")
def f8(v):
    marked = T.track_outliers(v.track_nodes)
    return T.nearest_valid_frame(marked.where("outlier is not null"), marked.where("outlier is null"))


@query("f9_difference", "SELECT DISTINCT track_id AS id FROM track_nodes WHERE track_id NOT IN (SELECT track_id FROM track_nodes WHERE score < 0.02)", "track_nodes")
def f9(v):
    ids = v.track_nodes.withColumnRenamed("track_id", "id")
    return T.difference(ids, ids.where("score < 0.02"))


@query("f9_stable_intersection", "SELECT track_id AS id, min(node_id) AS pos FROM track_nodes WHERE track_id IN (SELECT track_id FROM track_nodes WHERE score < 0.02) GROUP BY track_id", "track_nodes")
def f9_both(v):
    ids = v.track_nodes.select(F.col("track_id").alias("id"), F.col("node_id").alias("pos"), "score")
    return T.stable_intersection(ids, ids.where("score < 0.02"))


@query("f10_filter_short_tracks", "SELECT node_id FROM track_nodes QUALIFY count(*) OVER (PARTITION BY grp, volume, capture, track_id) > 65", "track_nodes")
def f10(v):
    return T.filter_short_tracks(v.track_nodes, min_len=65).select("node_id")


@query("f11_three_pass")
def f11(v):
    tracks, measures = T.three_pass(v.voxels)
    return tracks.select("capture", "track_id", "t", "node_id", "vol").join(merged(measures.select("capture", "track_id", "n_nodes", "path")), ["capture", "track_id"])


@query("g1_track_kinematics", f"""
WITH c AS (SELECT n.*, n.z * (dz / 0.5) AS zz, dt FROM track_nodes n LEFT JOIN calibration USING (grp, volume, capture)),
h AS (SELECT *, sqrt((round(zz) - lag(round(zz)) OVER g) ** 2 + (round(y) - lag(round(y)) OVER g) ** 2 + (round(x) - lag(round(x)) OVER g) ** 2) AS hop FROM c WINDOW g AS (PARTITION BY {KEYS}, track_id ORDER BY t, node_id)),
s AS (SELECT {KEYS}, track_id, count(*) AS n_nodes, coalesce(sum(hop), 0) AS path, max(hop) / any_value(dt) AS max_speed, avg(hop) / any_value(dt) AS mean_speed,
 sqrt((arg_max(zz, t) - arg_min(zz, t)) ** 2 + (arg_max(y, t) - arg_min(y, t)) ** 2 + (arg_max(x, t) - arg_min(x, t)) ** 2) AS ends FROM h GROUP BY ALL)
SELECT {KEYS}, track_id, n_nodes, round(path, 6) AS path, round(max_speed, 6) AS max_speed, round(mean_speed, 6) AS mean_speed, round(path / ends, 6) AS path_over_ends, round(ends / path, 6) AS ends_over_path FROM s""", "track_nodes calibration")
def g1(v):
    return rounded(G.track_kinematics(v.track_nodes, v.calibration), "path", "max_speed", "mean_speed", "path_over_ends", "ends_over_path")


PAIRS = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, track_id ORDER BY t, node_id) AS pos FROM track_nodes),
r AS (SELECT a.grp, a.volume, a.capture, a.track_id, a.node_id AS focal, b.node_id, b.vol, b.score, (1 + cos(pi() * (b.pos - a.pos) / 84)) / 2 AS w FROM p a JOIN p b ON a.track_id = b.track_id AND abs(b.pos - a.pos) < 84),
f AS (SELECT grp, volume, capture, track_id, focal, node_id, vol, score, w / sum(w) OVER (PARTITION BY track_id, focal) AS w FROM r)"""


@query("g2_hann_pairs", f"{PAIRS} SELECT {KEYS}, track_id, focal, node_id, round(w, 9) AS w FROM f", "track_nodes")
def g2(v):
    return rounded(G.hann_pairs(v.track_nodes), "w", digits=9)


@query("g3_weighted_stats", f"""
{PAIRS}, s AS (SELECT {KEYS}, track_id, focal, sum(w * vol) AS vm, sum(w * vol * vol) AS vs, sum(w * score) AS sm, sum(w * score * score) AS ss FROM f GROUP BY ALL)
SELECT {KEYS}, track_id, focal AS node_id, round(vm, 4) AS vol_mean, round(sqrt(greatest(0, vs - vm * vm)), 4) AS vol_std, round(sm, 4) AS score_mean, round(sqrt(greatest(0, ss - sm * sm)), 4) AS score_std FROM s""", "track_nodes")
def g3(v):
    return rounded(G.weighted_stats(v.track_nodes, ["vol", "score"]), "vol_mean", "vol_std", "score_mean", "score_std", digits=4)


@query("g4_track_extrema", f"SELECT {KEYS}, track_id, min(z) AS min_distance, max(score) AS max_score, min(score) AS min_score, round(max(score) - min(score), 6) AS range_score FROM track_nodes GROUP BY ALL", "track_nodes")
def g4(v):
    return rounded(G.track_extrema(v.track_nodes, distance="z"), "range_score")


@query("g5_angle_to_vessel", f"""
WITH l AS (SELECT {KEYS}, t AS pos, round(avg(y), 6) AS ly, CAST(t * 2 AS DOUBLE) AS lx FROM track_nodes GROUP BY {KEYS}, t),
e AS (SELECT {KEYS}, track_id, arg_min(y, struct_pack(x := x, t := t)) AS ay, min(x) AS ax, arg_max(y, struct_pack(x := x, t := t)) AS by_, max(x) AS bx FROM track_nodes GROUP BY ALL),
na AS (SELECT {KEYS}, track_id, ay, ax, by_, bx, ly AS lay, lx AS lax FROM e JOIN l USING (grp, volume, capture) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY (ay - ly) * (ay - ly) + (ax - lx) * (ax - lx), pos) = 1),
nb AS (SELECT track_id, ly AS lby, lx AS lbx FROM e JOIN l USING (grp, volume, capture) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY (by_ - ly) * (by_ - ly) + (bx - lx) * (bx - lx), pos) = 1)
SELECT {KEYS}, track_id, CASE WHEN lbx != lax OR lby != lay THEN round(acos((bx - ax) / sqrt((by_ - ay) ** 2 + (bx - ax) ** 2)) - acos((lbx - lax) / sqrt((lby - lay) ** 2 + (lbx - lax) ** 2)), 6) END AS angle FROM na JOIN nb USING (track_id)""", "track_nodes")
def g5(v):
    line = v.track_nodes.groupBy("grp", "volume", "capture", F.col("t").alias("pos")).agg(F.round(F.avg("y"), 6).alias("y")).withColumn("x", (F.col("pos") * 2).cast("double"))
    return rounded(G.angle_to_vessel(v.track_nodes, line), "angle")


@query("g6_fill_missing", f"""
SELECT node_id, CASE WHEN isnan(f2) THEN -1 ELSE f2 END AS f2, CASE WHEN max(isnan(f2)::INT) OVER (PARTITION BY {KEYS}, track_id) = 1 THEN -1 ELSE round(f3, 6) END AS f3 FROM features""", "features")
def g6(v):
    d = v.features.withColumn("g", F.col("f2"))
    out = G.fill_missing(d, ["f2"], ["f3", "g"])
    return rounded(out, "f3").select("node_id", "f2", "f3")


@query("g7_attach_track_features", "SELECT n.node_id, coalesce(m.vol, 0) AS path FROM track_nodes n LEFT JOIN (SELECT node_id, vol FROM track_nodes WHERE t % 2 = 0) m USING (node_id)", "track_nodes")
def g7(v):
    measures = v.track_nodes.where("t % 2 = 0").select("grp", "volume", "capture", "node_id", F.col("vol").alias("path"))
    return G.attach_track_features(v.track_nodes, measures, ["path"]).select("node_id", "path")


@query("h1_assemble_features", "SELECT node_id, [score, f1, f3, f1 / 2]::DOUBLE[] AS features FROM features", "features")
def h1(v):
    track = v.features.select("node_id", "score", "f1")
    cell = v.features.select("node_id", "f3", (F.col("f1") / 2).alias("half"))
    return H.assemble_features(track, cell, ["score", "f1"], ["f3", "half"], ["node_id"])


@query("h2_valid_rows", "SELECT node_id FROM (SELECT *, count(*) OVER (PARTITION BY grp, volume, capture, track_id) AS n FROM features) WHERE n > 60 AND f1 > 110 AND f1 < 3060 AND NOT isnan(f2)", "features")
def h2(v):
    d = v.features.withColumn("features", F.array("f1", "f2", "f3"))
    return H.valid_rows(d, ["grp", "volume", "capture"], volume="f1", min_len=60).select("node_id")


@query("h3_ensemble_score", """
WITH s AS (SELECT row_id, member, sum((value - mu) / sd * coef) + max(intercept) AS s FROM cells JOIN members USING (feature) GROUP BY row_id, member)
SELECT row_id, round(avg(1 / (1 + exp(-s))), 6) AS score, avg(1 / (1 + exp(-s))) > 0.6815::DOUBLE AS selected FROM s GROUP BY row_id""", "cells members")
def h3(v):
    return rounded(H.ensemble_score(v.cells, v.members), "score")


@query("h4_scatter_labels", "SELECT node_id, coalesce(score > 0.5 AND f1 > 110, false) AS selected FROM features", "features")
def h4(v):
    valid = v.features.where("f1 > 110").select("node_id", (F.col("score") > 0.5).alias("selected"))
    return H.scatter_labels(v.features.select("node_id"), valid, ["node_id"])


def _cell_table_sql() -> str:
    """The 74 measures of every node, in the order of the table."""
    mean = lambda c: f"m_{c}"
    dev = lambda c: f"sqrt(greatest(0, s_{c} - m_{c} * m_{c}))"
    cell, polar, turned, far, shape = W.CELL, W.POLAR, W.ORIENTATION, W.DISTANCE, W.SHAPE
    gap = lambda e: f"CASE WHEN lost THEN -1 ELSE {e} END"
    ratio = lambda p, q: f"CASE WHEN {q} != 0 THEN {p} / {q} ELSE -1 END"
    track = ["n_nodes", "path", "max_speed", "mean_speed", ratio("ends", "path"), ratio("path", "ends"), "angle", *map(mean, shape), *map(dev, shape),
             *(gap(mean(c)) for c in polar), *(gap(dev(c)) for c in polar), *(gap(mean(c)) for c in turned), *(gap(dev(c)) for c in turned), *map(mean, far),
             "min_distance", "m_score", "max_score", "min_score", "max_score - min_score"]
    values = ", ".join(f"round(({e})::DOUBLE, 3)" for e in [*track, *cell])
    sums = ", ".join(f"sum(w * b.{c}) AS m_{c}, sum(w * b.{c} * b.{c}) AS s_{c}" for c in cell)
    return f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, track_id ORDER BY t, node_id) AS pos FROM cell_nodes),
r AS (SELECT a.node_id AS focal, b.node_id AS other, (1 + cos(pi() * (b.pos - a.pos) / 84)) / 2 AS w FROM p a JOIN p b ON a.track_id = b.track_id AND abs(b.pos - a.pos) < 84),
f AS (SELECT focal, other, w / sum(w) OVER (PARTITION BY focal) AS w FROM r),
st AS (SELECT focal AS node_id, {sums} FROM f JOIN cell_nodes b ON b.node_id = other GROUP BY focal),
c AS (SELECT n.*, n.z * (dz / 0.5) AS zz, dt FROM cell_nodes n JOIN calibration USING (grp, volume, capture)),
h AS (SELECT *, sqrt((round(zz) - lag(round(zz)) OVER g) ** 2 + (round(y) - lag(round(y)) OVER g) ** 2 + (round(x) - lag(round(x)) OVER g) ** 2) AS hop FROM c WINDOW g AS (PARTITION BY {KEYS}, track_id ORDER BY t, node_id)),
k AS (SELECT track_id, count(*) AS n_nodes, coalesce(sum(hop), 0) AS path, max(hop) / any_value(dt) AS max_speed, avg(hop) / any_value(dt) AS mean_speed, min(surface_distance) AS min_distance, max(score) AS max_score, min(score) AS min_score,
  bool_or(isnan(polar_radius)) AS lost, sqrt((arg_max(zz, t) - arg_min(zz, t)) ** 2 + (arg_max(y, t) - arg_min(y, t)) ** 2 + (arg_max(x, t) - arg_min(x, t)) ** 2) AS ends FROM h GROUP BY track_id),
l AS (SELECT {KEYS}, t AS lpos, round(avg(y), 6) AS ly, CAST(t * 2 AS DOUBLE) AS lx FROM track_nodes GROUP BY {KEYS}, t),
e AS (SELECT {KEYS}, track_id, arg_min(y, struct_pack(x := x, t := t)) AS ay, min(x) AS ax, arg_max(y, struct_pack(x := x, t := t)) AS by_, max(x) AS bx FROM track_nodes GROUP BY ALL),
na AS (SELECT track_id, ay, ax, by_, bx, ly AS lay, lx AS lax FROM e JOIN l USING (grp, volume, capture) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY (ay - ly) * (ay - ly) + (ax - lx) * (ax - lx), lpos) = 1),
nb AS (SELECT track_id, ly AS lby, lx AS lbx FROM e JOIN l USING (grp, volume, capture) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY (by_ - ly) * (by_ - ly) + (bx - lx) * (bx - lx), lpos) = 1),
an AS (SELECT track_id, CASE WHEN lbx != lax OR lby != lay THEN acos((bx - ax) / sqrt((by_ - ay) ** 2 + (bx - ax) ** 2)) - acos((lbx - lax) / sqrt((lby - lay) ** 2 + (lbx - lax) ** 2)) END AS angle FROM na JOIN nb USING (track_id)),
v AS (SELECT node_id, [{values}] AS features FROM cell_nodes n JOIN st USING (node_id) JOIN k USING (track_id) LEFT JOIN an USING (track_id))
SELECT node_id, i - 1 AS feature, coalesce(features[i], 0) + 0.0::DOUBLE AS value FROM v, (SELECT unnest(range(1, 75)) AS i) WHERE NOT isnan(coalesce(features[i], 0))"""


@query("w2_cell_table", _cell_table_sql(), "cell_nodes calibration")
def w2(v):
    """The whole job from cells and tracks to the 74 measures, as a row per node and measure; values that are no numbers are left out."""
    line = v.track_nodes.groupBy("grp", "volume", "capture", F.col("t").alias("pos")).agg(F.round(F.avg("y"), 6).alias("y")).withColumn("x", (F.col("pos") * 2).cast("double"))
    table = W.cell_table(v.cell_nodes, v.calibration, line)
    long = table.select("node_id", F.posexplode("features").alias("feature", "value")).withColumn("feature", F.col("feature").cast("long"))
    return long.withColumn("value", F.round(F.coalesce("value", F.lit(0.0)), 3) + 0.0).where(~F.isnan("value"))
