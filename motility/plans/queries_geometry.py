"""Queries of the geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from motility.operators import geometry as G
from motility.operators.regions import region_props
from motility.plans.registry import query
from motility.sources.tables import merged

CENTRES = "c AS (SELECT capture, t, label, round(avg(z)) AS z, round(avg(y)) AS y, round(avg(x)) AS x FROM voxels GROUP BY capture, t, label), s AS (SELECT capture, t, z AS tz, y AS ty, x AS tx FROM voxels WHERE label % 50 = 0)"
FAR = "sqrt((z - tz) * (z - tz) + (y - ty) * (y - ty) + (x - tx) * (x - tx))"


def _centres(v):
    return v.voxels.groupBy("capture", "t", "label").agg(*(F.round(F.avg(a)).alias(a) for a in "zyx"))


def _surface(v):
    return v.voxels.where("label % 50 = 0").select("capture", "t", "z", "y", "x")


@query("e1_nearest_point", f"""
WITH {CENTRES} SELECT capture, t, label, z, y, x, tz, ty, tx, round({FAR}, 6) AS distance FROM c JOIN s USING (capture, t)
QUALIFY row_number() OVER (PARTITION BY capture, t, label ORDER BY {FAR}, tz, ty, tx) = 1""", "voxels")
def e1(v):
    return G.nearest_point(_centres(v), _surface(v), cell=12.0).withColumn("distance", F.round("distance", 6))


@query("e2_min_distance", f"""
WITH s AS (SELECT capture, t, z AS tz, y AS ty, x AS tx FROM voxels WHERE label % 50 = 0),
n AS (SELECT v.capture, v.t, label, z, y, x, min({FAR}) AS d FROM voxels v JOIN s ON v.capture = s.capture AND v.t = s.t GROUP BY ALL),
m AS (SELECT *, min(d) OVER (PARTITION BY capture, t, label) AS least FROM n)
SELECT capture, t, label, round(least, 6) AS distance, round(median(z)) AS cz, round(median(y)) AS cy, round(median(x)) AS cx FROM m WHERE d = least GROUP BY capture, t, label, least""", "voxels")
def e2(v):
    return G.min_distance(v.voxels, _surface(v)).withColumn("distance", F.round("distance", 6))


LINE = """f AS (SELECT DISTINCT capture, t, y, x FROM voxels), a AS (SELECT capture, t, count(*) FILTER (x = 0) >= count(*) FILTER (y = 0) AS ax FROM f GROUP BY ALL),
l AS (SELECT capture, t, z, count(*) AS n FROM voxels GROUP BY ALL), zz AS (SELECT capture, t, round(median(z)) AS z FROM l WHERE (capture, t, n) IN (SELECT capture, t, max(n) FROM l GROUP BY capture, t) GROUP BY capture, t),
p AS (SELECT capture, t, ax, CASE WHEN ax THEN x ELSE y END AS pos, CASE WHEN ax THEN y ELSE x END AS o FROM f JOIN a USING (capture, t)),
m AS (SELECT capture, t, ax, pos, round(median(o)) AS mid FROM p GROUP BY ALL),
line AS (SELECT capture, t, pos, z, CASE WHEN ax THEN mid ELSE pos END AS y, CASE WHEN ax THEN pos ELSE mid END AS x FROM m JOIN zz USING (capture, t))"""


@query("e3_centerline", f"WITH {LINE} SELECT * FROM line", "voxels")
def e3(v):
    return G.centerline(v.voxels)


@query("e4_order_points", f"""
WITH RECURSIVE {LINE}, pt AS (SELECT capture, t, z, y, x, row_number() OVER (PARTITION BY capture, t ORDER BY z, y, x) AS id FROM line),
chain AS (
  SELECT capture, t, 0 AS pos, id, z, y, x, [id] AS seen FROM pt QUALIFY row_number() OVER (PARTITION BY capture, t ORDER BY z * z + y * y + x * x, id) = 1
  UNION ALL SELECT capture, t, pos + 1, id, z, y, x, list_append(seen, id) FROM (
    SELECT c.capture, c.t, pos, seen, pt.id, pt.z, pt.y, pt.x, row_number() OVER (PARTITION BY c.capture, c.t ORDER BY (pt.z - c.z) ** 2 + (pt.y - c.y) ** 2 + (pt.x - c.x) ** 2, pt.id) AS k
    FROM chain c JOIN pt ON pt.capture = c.capture AND pt.t = c.t WHERE NOT list_contains(seen, pt.id)) WHERE k = 1)
SELECT capture, t, z, y, x, pos FROM chain""", "voxels")
def e4(v):
    return G.order_points(G.centerline(v.voxels).drop("pos"))


@query("e5_local_direction", f"""
WITH {CENTRES}, l AS (SELECT capture, t, x AS pos, round(median(z)) AS tz, round(median(y)) AS ty, CAST(x AS DOUBLE) AS tx FROM voxels GROUP BY capture, t, x),
n AS (SELECT c.capture, c.t, label, z, y, x, pos FROM c JOIN l ON c.capture = l.capture AND c.t = l.t QUALIFY row_number() OVER (PARTITION BY c.capture, c.t, label ORDER BY {FAR}, pos) = 1),
e AS (SELECT capture, t, min(pos) AS lo, max(pos) AS hi FROM l GROUP BY ALL)
SELECT n.capture, n.t, label, n.z, n.y, n.x, n.pos, round(atan2(b.ty - a.ty, b.tx - a.tx), 6) + 0.0::DOUBLE AS flow FROM n JOIN e ON n.capture = e.capture AND n.t = e.t
JOIN l a ON a.capture = n.capture AND a.t = n.t AND a.pos = greatest(n.pos - 5, lo) JOIN l b ON b.capture = n.capture AND b.t = n.t AND b.pos = least(n.pos + 5, hi)""", "voxels")
def e5(v):
    # medians of counted places: few rows reach them, where rows of voxels would be sorted
    counted = v.voxels.select("capture", "t", F.col("x").alias("pos"), F.expr("stack(2, 0, z, 1, y) AS (axis, at)")).groupBy("capture", "t", "pos", "axis", "at").agg(F.count("*").alias("n"))
    middle = lambda a: F.round(F.percentile(F.when(F.col("axis") == a, F.col("at")), 0.5, F.col("n")))
    line = counted.groupBy("capture", "t", "pos").agg(middle(0).alias("z"), middle(1).alias("y")).withColumn("x", F.col("pos").cast("double"))
    return G.local_direction(_centres(v), line).withColumn("flow", F.round("flow", 6) + 0.0)


@query("e6_fit_ellipse")
def e6(v):
    return G.fit_ellipse(v.voxels.select("capture", "t", "label", "y", "x").distinct(), ["capture", "t", "label"])


MOMENT_ELLIPSES = "el AS (SELECT capture, t, label, avg(x) AS cx, avg(y) AS cy, 1 + 2 * stddev_pop(x) AS r1, 1 + stddev_pop(y) AS r2, CAST(label % 7 AS DOUBLE) / 5 - 0.6::DOUBLE AS angle FROM voxels GROUP BY capture, t, label)"


@query("e7_ellipse_polar", f"""
WITH {MOMENT_ELLIPSES}, p AS (SELECT v.capture, v.t, v.label, z, y, x, ((x - cx) * cos(angle) + (y - cy) * sin(angle)) / r1 AS u, (-(x - cx) * sin(angle) + (y - cy) * cos(angle)) / r2 AS v FROM voxels v JOIN el USING (capture, t, label))
SELECT capture, t, label, z, y, x, round(u * u + v * v, 6) AS radius2, CASE WHEN u * u + v * v > 1e-9 THEN round(CASE WHEN atan2(v, u) < 0 THEN atan2(v, u) + 2 * pi() ELSE atan2(v, u) END, 4) % 6.2832 END AS theta FROM p""", "voxels")
def e7(v):
    """Every voxel against an ellipse of its region's own moments."""
    el = v.voxels.groupBy("capture", "t", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (1 + 2 * F.stddev_pop("x")).alias("r1"), (1 + F.stddev_pop("y")).alias("r2"))
    el = el.withColumn("angle", (F.col("label") % 7).cast("double") / 5 - F.lit(0.6))
    out = G.ellipse_polar(v.voxels.join(merged(el), ["capture", "t", "label"]))
    theta = F.when(F.col("radius2") > 1e-9, F.round("theta", 4) % F.lit(6.2832))  # the angle of the centre means nothing, and 2 pi is 0
    return out.select("capture", "t", "label", "z", "y", "x", F.round("radius2", 6).alias("radius2"), theta.alias("theta"))


NORMALS = "nn AS (SELECT capture, t, label AS sid, CAST(min(z) AS DOUBLE) AS sz, CAST(min(y) AS DOUBLE) AS sy, CAST(min(x) AS DOUBLE) AS sx, CASE label % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.0 ELSE 0.48 END::DOUBLE AS nz, CASE label % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 0.64 END::DOUBLE AS ny, CASE label % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE 0.6 END::DOUBLE AS nx FROM voxels WHERE label % 5 = 0 GROUP BY capture, t, label)"


@query("e8_nearest_normal", f"""
WITH {CENTRES}, {NORMALS}, b AS (SELECT c.capture, c.t, label, sid, (z - sz) * nz + (y - sy) * ny + (x - sx) * nx AS k, z - sz AS dz, y - sy AS dy, x - sx AS dx, nz, ny, nx FROM c JOIN nn ON c.capture = nn.capture AND c.t = nn.t),
d AS (SELECT capture, t, label, sid, sqrt((dz - k * nz) * (dz - k * nz) + (dy - k * ny) * (dy - k * ny) + (dx - k * nx) * (dx - k * nx)) AS line, abs(k) AS foot FROM b)
SELECT capture, t, label, sid, round(line, 6) AS line_distance, round(foot, 6) AS foot_distance FROM d QUALIFY row_number() OVER (PARTITION BY capture, t, label ORDER BY round(line + foot, 9), sid) = 1""", "voxels")
def e8(v):
    third = lambda a, b, c: F.when(F.col("label") % 3 == 0, a).when(F.col("label") % 3 == 1, b).otherwise(c)
    corner = v.voxels.where("label % 5 = 0").groupBy("capture", "t", "label").agg(*(F.min(a).cast("double").alias(f"s{a}") for a in "zyx"))
    normals = corner.withColumns({"nz": third(0.6, 0.0, 0.48), "ny": third(0.8, 1.0, 0.64), "nx": third(0.0, 0.0, 0.6)}).withColumnRenamed("label", "sid")
    return G.nearest_normal(_centres(v), normals, cell=12.0).withColumn("line_distance", F.round("line_distance", 6)).withColumn("foot_distance", F.round("foot_distance", 6))


@query("e9_extent_along_ray", """
WITH m AS (SELECT capture, t, label, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, min(z) - 3.5 AS sz, min(y) - 2.25 AS sy, min(x) - 1.125 AS sx FROM voxels GROUP BY ALL),
p AS (SELECT DISTINCT capture, t, label, CAST(round(sz + (cz - sz) * i * 0.01) AS BIGINT) AS z, CAST(round(sy + (cy - sy) * i * 0.01) AS BIGINT) AS y, CAST(round(sx + (cx - sx) * i * 0.01) AS BIGINT) AS x FROM m, (SELECT unnest(range(0, 10001)) AS i))
SELECT m.capture, m.t, m.label, count(v.z) AS height FROM m LEFT JOIN p USING (capture, t, label) LEFT JOIN voxels v ON v.capture = m.capture AND v.t = m.t AND v.label = m.label AND v.z = p.z AND v.y = p.y AND v.x = p.x GROUP BY ALL""", "voxels")
def e9(v):
    cells = v.voxels.groupBy("capture", "t", "label").agg(*(F.avg(a).alias(f"c{a}") for a in "zyx"), (F.min("z") - 3.5).alias("sz"), (F.min("y") - 2.25).alias("sy"), (F.min("x") - 1.125).alias("sx"))
    return G.extent_along_ray(cells, v.voxels)


@query("e10_oriented_width", """
WITH r AS (SELECT capture, t, label, z, y, x, round(x * cos(a) + y * sin(a), 6) AS u, round((-x * sin(a) + y * cos(a)) * cos(b) + z * sin(b), 6) AS w, h FROM (SELECT *, label % 7 / 10.0::DOUBLE AS a, label % 5 / 10.0::DOUBLE AS b, CAST(label % 9 AS DOUBLE) AS h FROM voxels)),
e AS (SELECT *, min(u) OVER g AS ul, max(u) OVER g AS uh, min(w) OVER g AS wl, max(w) OVER g AS wh FROM r WINDOW g AS (PARTITION BY capture, t, label)),
d AS (SELECT capture, t, label, h,
 sqrt((avg(z) FILTER (u = ul) - avg(z) FILTER (u = uh)) ** 2 + (avg(y) FILTER (u = ul) - avg(y) FILTER (u = uh)) ** 2 + (avg(x) FILTER (u = ul) - avg(x) FILTER (u = uh)) ** 2) AS du,
 sqrt((avg(z) FILTER (w = wl) - avg(z) FILTER (w = wh)) ** 2 + (avg(y) FILTER (w = wl) - avg(y) FILTER (w = wh)) ** 2 + (avg(x) FILTER (w = wl) - avg(x) FILTER (w = wh)) ** 2) AS dw FROM e GROUP BY capture, t, label, h)
SELECT capture, t, label, round(greatest(du, dw), 6) AS width, CASE WHEN greatest(du, dw) > 0 THEN round(h / greatest(du, dw), 6) END AS ratio FROM d""", "voxels")
def e10(v):
    cells = v.voxels.select("capture", "t", "label").distinct()
    angles = cells.withColumns({"about_z": F.col("label") % 7 / F.lit(10.0), "about_x": F.col("label") % 5 / F.lit(10.0), "height": (F.col("label") % 9).cast("double")})
    return G.oriented_width(v.voxels, angles).withColumn("width", F.round("width", 6)).withColumn("ratio", F.round("ratio", 6))


@query("e11_orientation_delta", """
SELECT b.box_id, x1 - cx AS azimuth, y1 - cy AS elevation, z1 - cz AS roll FROM boxes b JOIN (SELECT capture, t, max(x1) AS cx, max(y1) AS cy, max(z1) AS cz FROM boxes GROUP BY ALL) c ON b.capture = c.capture AND b.t = c.t""", "boxes")
def e11(v):
    cells = v.boxes.select("box_id", "capture", "t", F.col("x1").alias("azimuth"), F.col("y1").alias("elevation"), F.col("z1").alias("roll"))
    vessel = cells.groupBy("capture", "t").agg(*(F.max(a).alias(a) for a in ("azimuth", "elevation", "roll")))
    return G.orientation_delta(cells, vessel, ["capture", "t"]).select("box_id", "azimuth", "elevation", "roll")


@query("e11_regions_against_flow")
def e11_regions(v):
    props = region_props(v.voxels).select("capture", "t", "label", "azimuth", "elevation", "roll")
    vessel = region_props(v.voxels.where("label % 50 = 0").withColumn("label", F.lit(0))).select("capture", "t", "azimuth", "elevation", "roll")
    return G.orientation_delta(props, vessel, ["capture", "t"])
