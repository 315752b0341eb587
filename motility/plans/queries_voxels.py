"""Queries of the source and voxel operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from motility.functions.names import natural_path_key, parse_capture_path
from motility.operators import planes as P
from motility.operators import voxels as V
from motility.plans.registry import query
from motility.sources import captures as C
from motility.sources.tables import scratch_path

NUMBER = "CAST(nullif(regexp_extract(path, '{}', 1), '') AS BIGINT)"


@query("a2_parse_capture_path", f"""
SELECT path, {NUMBER.format('group([0-9]+)')} AS grp, {NUMBER.format('([0-9]+)_capture[0-9]+')} AS volume, {NUMBER.format('_capture([0-9]+)')} AS capture,
       {NUMBER.format('(?:T|_t)([0-9]+)')} AS t, {NUMBER.format('T[0-9]+__([0-9]+)')} AS k, {NUMBER.format('_z([0-9]+)')} AS z, {NUMBER.format('_c([0-9]+)(?:[^0-9]|$)')} AS c
FROM paths""", "paths")
def a2(v):
    return parse_capture_path(v.paths)


@query("a3_natural_sort_key", r"""
WITH p AS (SELECT DISTINCT path FROM paths),
parts AS (SELECT path, string_split(path, '/') AS f FROM p),
named AS (SELECT path, f, regexp_extract(f[-1], '(\.[^.]*)$', 1) AS ext FROM parts),
levels AS (SELECT path, list_concat(f[1:-2], [f[-1][1:length(f[-1]) - length(ext)], ext]) AS lv FROM named),
keyed AS (SELECT path, list_transform(lv, lambda x: list_transform(regexp_extract_all(lower(x), '[0-9]+|[^0-9]'),
  lambda w: {'rank': CASE WHEN w < '0' THEN 0 WHEN regexp_matches(w, '^[0-9]') THEN 1 ELSE 2 END, 'num': CASE WHEN regexp_matches(w, '^[0-9]') THEN CAST(w AS HUGEINT) ELSE -1 END, 'ch': CASE WHEN regexp_matches(w, '^[0-9]') THEN '' ELSE w END})) AS k FROM levels)
SELECT path, row_number() OVER (PARTITION BY substr(path, 1, 6) ORDER BY k, path) AS place FROM keyed""", "paths")
def a3(v):
    keyed = v.paths.distinct().withColumn("k", natural_path_key(F.col("path")))
    return keyed.select("path", F.row_number().over(Window.partitionBy(F.substring("path", 1, 6)).orderBy("k", "path")).cast("long").alias("place"))


@query("a4_series_extent", "SELECT capture, max(t) AS n_t, max(z) AS n_z, max(raw % 4) AS n_c FROM grid GROUP BY capture", "grid")
def a4(v):
    return C.series_extent(v.grid.withColumn("c", F.col("raw") % 4), ["capture"])


@query("a5_apply_calibration", "SELECT n.node_id, dz / 0.5 AS z_factor, dt AS t_factor FROM track_nodes n LEFT JOIN calibration USING (grp, volume, capture)", "track_nodes calibration")
def a5(v):
    return C.apply_calibration(v.track_nodes, v.calibration).select("node_id", "z_factor", "t_factor")


@query("b1_normalize_intensity", "SELECT capture, t, z, y, x, round(raw / 65535.0::DOUBLE, 9) AS value FROM grid", "grid")
def b1(v):
    return V.normalize_intensity(v.grid).select("capture", "t", "z", "y", "x", F.round("value", 9).alias("value"))


@query("b2_arrange_channels", """
WITH g AS (SELECT capture, t, z, y, x, raw % 2 AS c, l0 AS value FROM grid)
SELECT capture, t, z, y, x, CASE WHEN c = 0 THEN 0 ELSE 2 END AS c, value FROM g
UNION ALL SELECT capture, t, z, y, x, 1 AS c, 0.0::DOUBLE AS value FROM g WHERE c = 0""", "grid")
def b2(v):
    two = v.grid.select("capture", "t", "z", "y", "x", (F.col("raw") % 2).alias("c"), F.col("l0").alias("value"))
    return V.arrange_channels(two, [0, 2])


@query("b3_z_tiles", """
WITH g AS (SELECT DISTINCT capture, t, CASE WHEN capture = 2 THEN z % 10 ELSE z END AS z FROM grid),
n AS (SELECT capture, t, max(z) + 1 AS nz FROM g GROUP BY ALL),
k AS (SELECT capture, t, nz, unnest(range(0, abs(nz - 16) + 1)) AS k FROM n),
kz AS (SELECT *, unnest(range(0, 16)) AS zt FROM k)
SELECT kz.capture, kz.t, k, zt, g.z FROM kz LEFT JOIN g ON g.capture = kz.capture AND g.t = kz.t AND g.z = CASE WHEN nz >= 16 THEN k + zt ELSE zt - k END
WHERE g.z IS NOT NULL OR nz < 16""", "grid")
def b3(v):
    planes = v.grid.select("capture", "t", F.when(F.col("capture") == 2, F.col("z") % 10).otherwise(F.col("z")).alias("z")).distinct()
    return V.z_tiles(planes)


STATS = "(VALUES (0, 0.1, 0.5), (1, -0.2, 0.7), (2, 0.05, 0.9)) AS s(c, mean, std)"


@query("b4_standardize_channels", f"SELECT o.capture, o.t, o.z, o.y, o.x, round((l0 - mean::DOUBLE) / std::DOUBLE, 6) AS value FROM grid o JOIN {STATS} ON raw % 3 = s.c", "grid")
def b4(v):
    stats = v.spark.createDataFrame([(0, 0.1, 0.5), (1, -0.2, 0.7), (2, 0.05, 0.9)], "c long, mean double, std double")
    return V.standardize_channels(v.grid.withColumn("c", F.col("raw") % 3), stats, value="l0").select("capture", "t", "z", "y", "x", F.round("l0", 6).alias("value"))


TILED = "WITH tiled AS (SELECT capture, t, z AS k, zt, y, x, l0 + zt AS l0, l1, l2 FROM (SELECT *, unnest(range(0, 3)) AS zt FROM grid))"


def _tiled(v):
    return v.grid.withColumn("zt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("l0", F.col("l0") + F.col("zt")).withColumnRenamed("z", "k")


@query("b5_merge_tiles", f"{TILED} SELECT capture, t, k + zt AS z, y, x, round(sum(l0), 6) AS l0, round(sum(l1), 6) AS l1, round(sum(l2), 6) AS l2 FROM tiled GROUP BY capture, t, k + zt, y, x", "grid")
def b5(v):
    merged = V.merge_tiles(_tiled(v), ["l0", "l1", "l2"])
    return merged.select("capture", "t", "z", "y", "x", *(F.round(c, 6).alias(c) for c in ("l0", "l1", "l2")))


@query("b6_softmax_argmax", """
WITH e AS (SELECT *, greatest(l0, l1, l2) AS m FROM grid)
SELECT capture, t, z, y, x, round(exp(l0 - m) / (exp(l0 - m) + exp(l1 - m) + exp(l2 - m)), 6) AS p0, CASE WHEN l0 = m THEN 0 WHEN l1 = m THEN 1 ELSE 2 END AS class FROM e""", "grid")
def b6(v):
    return V.softmax_argmax(v.grid, ["l0", "l1", "l2"]).select("capture", "t", "z", "y", "x", F.round(F.col("prob")[0], 6).alias("p0"), "class")


@query("b7_mean_over_planes", f"{TILED} SELECT capture, t, k + zt AS z, y, x, round(avg(l1), 6) AS score, count(*) AS n_tiles FROM tiled GROUP BY capture, t, k + zt, y, x", "grid")
def b7(v):
    out = V.mean_over_planes(_tiled(v).withColumn("score", F.col("l1")))
    return out.withColumn("score", F.round("score", 6))


@query("b3_b7_plane_arrays", """
WITH n AS (SELECT capture, t, max(z) + 1 AS nz FROM grid GROUP BY ALL),
dense AS (SELECT *, unnest(range(8)) AS x FROM (SELECT *, unnest(range(8)) AS y FROM (SELECT *, unnest(range(nz)) AS z FROM n))),
s AS (SELECT d.*, (coalesce(l0, 0) - 0.1) / 0.5 AS s0, (coalesce(l1, 0) + 0.2) / 0.8 AS s1 FROM dense d LEFT JOIN grid USING (capture, t, z, y, x)),
k AS (SELECT *, unnest(range(CASE WHEN nz >= 16 THEN greatest(0, z - 15) ELSE 0 END, 1 + CASE WHEN nz >= 16 THEN least(z, nz - 16) ELSE 16 - nz END)) AS k FROM s),
p AS (SELECT *, CASE WHEN nz >= 16 THEN z - k ELSE z + k END AS zt FROM k),
m AS (SELECT capture, t, z, y, x, round(sum(s0 + 0.02 * zt), 6) + 0.0::DOUBLE AS l0, round(sum(s1 - 0.01 * zt), 6) + 0.0::DOUBLE AS l1, round(sum(0.5 * s0 - 0.25 * s1), 6) + 0.0::DOUBLE AS l2, count(*) AS n_tiles FROM p GROUP BY ALL),
e AS (SELECT *, greatest(l0, l1, l2) AS top FROM m)
SELECT capture, t, z, y, x, l0, l1, l2, n_tiles, round(l1 / n_tiles, 9) + 0.0::DOUBLE AS score, round(exp(l0 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)), 6) AS p0,
       CASE WHEN l0 = top THEN 0 WHEN l1 = top THEN 1 ELSE 2 END AS class
FROM e""", "grid")
def b3_b7(v):
    """From voxels to classes by tiles of whole planes: one shuffle."""

    def make_model():
        weights, drift = np.array([[1, 0], [0, 1], [0.5, -0.25]]), np.array([0.02, -0.01, 0])
        return lambda tile: weights @ tile + (np.arange(len(tile))[:, None] * drift)[:, :, None]

    tiles = P.tile_planes(P.stack_planes(v.grid, ["l0", "l1"], (8, 8)))
    merged = P.predict_planes(P.standardize_planes(tiles, [(0.1, 0.5), (-0.2, 0.8)]), make_model)
    rounded = merged.withColumn("logits", F.transform("logits", lambda a: F.transform(a, lambda x: F.round(x, 6))))
    named = {f"l{i}": F.get("logits", F.lit(i)) for i in range(3)} | {"score": F.get("score", F.lit(1)), "prob": F.col("prob"), "class": F.col("class")}
    rows = P.voxel_rows(P.classify_planes(P.mean_planes(rounded)), 8, named, rest=["n_tiles"])
    return rows.withColumn("score", F.round("score", 9)).withColumn("p0", F.round(F.get("prob", F.lit(0)), 6)).drop("prob")


@query("b8_paint_boxes", """
WITH g AS (SELECT *, unnest(range(CAST(y1 AS BIGINT) // 16, CAST(y2 AS BIGINT) // 16 + 1)) AS cy FROM boxes), h AS (SELECT *, unnest(range(CAST(x1 AS BIGINT) // 16, CAST(x2 AS BIGINT) // 16 + 1)) AS cx FROM g),
p AS (SELECT v.capture, v.t, v.z, v.y, v.x, product(score) AS paint FROM (SELECT *, y // 16 AS cy, x // 16 AS cx FROM voxels) v JOIN h b ON v.capture = b.capture AND v.t = b.t AND v.cy = b.cy AND v.cx = b.cx
  WHERE v.z BETWEEN z1 AND z2 AND v.y BETWEEN y1 AND y2 AND v.x BETWEEN x1 AND x2 GROUP BY ALL)
SELECT v.capture, v.t, v.z, v.y, v.x, label, round(coalesce(paint, 1.0), 6) AS paint FROM voxels v LEFT JOIN p USING (capture, t, z, y, x)""", "voxels boxes")
def b8(v):
    return V.paint_boxes(v.voxels, v.boxes).withColumn("paint", F.round("paint", 6))


@query("b9_max_projection", "SELECT capture, t, y, x, max(label) AS label FROM voxels GROUP BY capture, t, y, x", "voxels")
def b9(v):
    return V.max_projection(v.voxels, "label")


@query("b10_temporal_majority", """
SELECT capture, z, y, x FROM voxels JOIN (SELECT capture, count(DISTINCT t) AS f FROM voxels GROUP BY capture) USING (capture)
GROUP BY capture, z, y, x, f HAVING count(DISTINCT t) * 2 > f""", "voxels")
def b10(v):
    return V.temporal_majority(v.voxels)


@query("b11_rescale_z", "SELECT capture, t, y, x, label, j AS z FROM voxels JOIN (SELECT unnest(range(0, 40)) AS j) ON CAST(floor((j + 0.5) * 16 / 40) AS BIGINT) = z", "voxels")
def b11(v):
    return V.rescale_z(v.voxels, 2.5, 16)


@query("b12_boundary_shell", """
WITH o AS (SELECT a, b, unnest(range(-1, 2)) AS c FROM (SELECT a, unnest(range(-1, 2)) AS b FROM (SELECT unnest(range(-1, 2)) AS a)))
SELECT DISTINCT capture, t, z + a AS z, y + b AS y, x + c AS x FROM voxels, o WHERE z + a BETWEEN 0 AND 15 AND y + b BETWEEN 0 AND 69 AND x + c BETWEEN 0 AND 69
EXCEPT SELECT capture, t, z, y, x FROM voxels""", "voxels")
def b12(v):
    return V.boundary_shell(v.voxels, dims=(16, 70, 70))


@query("b13_predict_tiles", "SELECT capture, t, z, y, x, l0 * 2 - l1 AS score FROM grid", "grid")
def b13(v):
    def make_model():
        return lambda batch: batch[["capture", "t", "z", "y", "x"]].assign(score=batch["l0"] * 2 - batch["l1"])

    return V.predict_tiles(v.grid, make_model, "capture long, t long, z long, y long, x long, score double")


@query("a1_list_files")
def a1(v):
    files = C.list_files(v.spark, v.sf_dir, "*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("a6_a7_cells_round_trip", "SELECT CAST(f AS BIGINT) AS feature, count(*) AS n FROM (SELECT unnest(range(64)) AS f FROM embeddings) GROUP BY f")
def a6(v):
    """Writes the cell table to the shared folder, reads it back and counts the values that came back as they were."""
    from motility.operators.behaviors import to_long, to_vectors

    rows = to_vectors(v.cells, ["row_id", "grp", "cluster"])
    wide = rows.select(*(F.col("features")[i].alias(f"f {i}") for i in range(64)), "grp", "cluster", F.lit(1).alias("volume"), F.lit(1).alias("capture"), F.col("row_id").alias("track_id"), F.lit(1).alias("t"))
    path = scratch_path(v.spark, "cells")
    C.write_cells(wide, path)
    back = to_long(C.read_cells(v.spark, path, 64).withColumnRenamed("track_id", "row_id"), ["row_id"])
    return back.join(v.cells.select("row_id", "feature", F.col("value").alias("was")), ["row_id", "feature"]).where("value = was").groupBy("feature").agg(F.count("*").alias("n"))


@query("a8_write_by_capture", "SELECT grp, volume, capture, count(*) AS n FROM track_nodes GROUP BY ALL", "track_nodes")
def a8(v):
    path = scratch_path(v.spark, "captures")
    C.write_by_capture(v.track_nodes, path)
    return v.spark.read.parquet(path).groupBy(*(F.col(k).cast("long").alias(k) for k in C.KEYS)).agg(F.count("*").alias("n"))
