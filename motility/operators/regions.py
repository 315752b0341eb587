"""Regions of label volumes: components, sizes, boxes, shapes, overlaps and node tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motility.functions.graphs import connected
from motility.functions.grouped import merged_pieces, neighbour_steps, principal_axes, rows_hull_volume, voxel_components
from motility.operators.voxels import KEYS, VOXEL
from motility.sources.tables import dealt_alike, merged, spread, stored


#: Side of the blocks in which voxels are labelled by one task; a block has its cube of voxels at most.
TILE = 128
#: Shapes of regions whose hulls a task remembers.
SHAPES = 20_000


def label_components(voxels: DataFrame, keys: Sequence[str] = KEYS, connectivity: int = 26, tile: int = TILE) -> DataFrame:
    """Adds ``component``: the number of the connected region that a voxel is in, from 1 in each volume by the first voxel (z, y, x).

    ``keys`` should name capture and frame. A volume is cut into cubes of side ``tile``, each labelled in a task; labels that touch across the faces of cubes are edges, whose connected components join them.
    """
    keys = list(keys)
    columns = [c for c in voxels.columns if c != "component"]
    cube = [f"_t{a}" for a in VOXEL]
    fields = [*voxels.select(columns).schema.fields, T.StructField("_first", T.LongType())]
    # one number per place, rising by (z, y, x), for coordinates from -2**20 to 2**20
    steps = (1 << 42, 1 << 21, 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = pdf[list(VOXEL)].to_numpy(np.int64)
        number = voxel_components(places, connectivity) - 1
        code = sum((places[:, k] + (1 << 20)) * step for k, step in enumerate(steps))
        first = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, code)
        return pdf[columns].assign(_first=first[number])

    cubed = voxels.select(columns).withColumns({t: F.floor(F.col(a) / tile).cast("long") for a, t in zip(VOXEL, cube, strict=True)})
    local = stored(spread(cubed, [*keys, *cube]).groupBy(*keys, *cube).applyInPandas(run, T.StructType(fields)), "labels")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    faces = local.where(edge("z") | edge("y") | edge("x"))
    ahead = F.explode(F.array(*(F.struct(*(F.lit(n).alias(c) for n, c in zip(step, "abc", strict=True))) for step in neighbour_steps(connectivity))))
    there = faces.withColumn("_s", ahead).select(*keys, *((F.col(a) + F.col(f"_s.{s}")).alias(a) for a, s in zip(VOXEL, "abc", strict=True)), F.col("_first").alias("u"))
    touch = there.join(merged(faces.select(*keys, *VOXEL, F.col("_first").alias("v"))), [*keys, *VOXEL]).where("u != v").select(*keys, "u", "v")
    roots = connected(touch, keys).withColumnRenamed("node", "_first")
    regions = local.select(*keys, "_first").distinct().join(merged(roots), [*keys, "_first"], "left").withColumn("_root", F.coalesce("root", "_first"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_root")).cast("long")  # a row per region
    return local.join(merged(regions.select(*keys, "_first", number.alias("component"))), [*keys, "_first"]).select(*columns, "component")


def _sized(voxels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return voxels.groupBy(*keys, label).agg(F.count("*").alias("volume"))


def drop_small(voxels: DataFrame, min_voxels: int = 110, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Keeps the regions of more than ``min_voxels`` voxels. Each region is measured by itself."""
    n = max(voxels.columns, key=len) + "_n"  # a name that no column has
    return voxels.withColumn(n, F.count("*").over(Window.partitionBy(*keys, label))).where(F.col(n) > min_voxels).drop(n)


def keep_largest(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Keeps the biggest region of each volume (of equal ones that with the least label)."""
    best = _sized(voxels, keys, label).groupBy(*keys).agg(F.max_by(label, F.struct("volume", -F.col(label))).alias(label))
    return voxels.join(best, [*keys, label], "left_semi")


def fill_holes(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The mask and the background that no path of face neighbours leads out of its bounding box."""
    box = mask.groupBy(*keys).agg(*(f(a).alias(f"{a}_{n}") for a in VOXEL for f, n in ((F.min, "lo"), (F.max, "hi"))))
    full = box
    for a in VOXEL:
        full = full.withColumn(a, F.explode(F.sequence(F.col(f"{a}_lo"), F.col(f"{a}_hi"))))
    border = F.lit(False)
    for a in VOXEL:
        border = border | (F.col(a) == F.col(f"{a}_lo")) | (F.col(a) == F.col(f"{a}_hi"))
    background = full.withColumn("border", border).select(*keys, *VOXEL, "border").join(merged(mask.select(*keys, *VOXEL)), [*keys, *VOXEL], "left_anti")
    labelled = label_components(background, keys, 6)
    closed = labelled.groupBy(*keys, "component").agg(F.max("border").alias("open")).where("not open").drop("open")
    return mask.select(*keys, *VOXEL).distinct().unionByName(labelled.join(merged(closed), [*keys, "component"], "left_semi").select(*keys, *VOXEL))


def region_boxes(voxels: DataFrame, keys: Sequence[str] = KEYS, margin: int = 1, label: str = "label") -> DataFrame:
    """Bounding boxes ``y1, x1, y2, x2, z1, z2``, widened by ``margin``."""
    sides = [(F.min(a) - margin).alias(f"{a}1") for a in VOXEL] + [(F.max(a) + margin).alias(f"{a}2") for a in VOXEL]
    return voxels.groupBy(*keys, label).agg(*sides).select(*keys, label, "y1", "x1", "y2", "x2", "z1", "z2")


def region_moments(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Volume, centroid, box, equivalent diameter, extent and second moments of each region, in one aggregate."""
    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    sums = voxels.groupBy(*keys, label).agg(
        F.count("*").alias("volume"), *(F.avg(a).alias(f"c{a}") for a in VOXEL), *(F.min(a).alias(f"{a}_lo") for a in VOXEL), *((F.max(a) - F.min(a) + 1).alias(f"d{a}") for a in VOXEL),
        *(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"m_{a}{b}") for a, b in pairs),
    )
    diameter = F.cbrt(F.lit(6 / math.pi) * F.col("volume"))
    return sums.withColumn("diameter", diameter).withColumn("extent", F.col("volume") / (F.col("dz") * F.col("dy") * F.col("dx")))


def region_props(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """``region_moments`` with the lengths of the principal axes (falling) and their orientation in degrees.

    A voxel is a solid cube, which adds 1/12 to each variance.
    """

    @F.pandas_udf("axis1 double, axis2 double, axis3 double, azimuth double, elevation double, roll double")
    def axes(zz: pd.Series, yy: pd.Series, xx: pd.Series, zy: pd.Series, zx: pd.Series, yx: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx + 1 / 12, yx, zx], axis=1), np.stack([yx, yy + 1 / 12, zy], axis=1), np.stack([zx, zy, zz + 1 / 12], axis=1)], axis=1)
        lengths, angles = principal_axes(m)
        return pd.DataFrame(np.concatenate([lengths, angles], axis=1), columns=["axis1", "axis2", "axis3", "azimuth", "elevation", "roll"])

    moments = region_moments(voxels, keys, label)
    found = moments.withColumn("_a", axes("m_zz", "m_yy", "m_xx", "m_zy", "m_zx", "m_yx"))
    return found.select(*moments.columns, "_a.*")


def shape_scores(df: DataFrame, volume: str = "volume", surface: str = "surface", axes: Sequence[str] = ("axis1", "axis2", "axis3")) -> DataFrame:
    """Adds ``sphericity``, ``prolate`` and ``oblate`` ellipticity; axes in any order, null where a length is 0."""
    a, b, c = (F.get(F.array_sort(F.array(*axes)), F.lit(i)) for i in range(3))
    divided = lambda p, q: F.when(q != 0, p / q)
    ball = F.lit(math.pi ** (1 / 3)) * F.pow(F.lit(6.0) * F.col(volume), F.lit(2 / 3))
    prolate = divided(F.lit(2.0) * a * a, a * a + b * b) * divided(c * c - a * a, c * c)
    oblate = divided(F.lit(2.0) * b * b, b * b + c * c) * divided(c * c - a * a, c * c)
    return df.withColumns({"sphericity": divided(ball, F.col(surface)), "prolate": prolate, "oblate": oblate})


def surface_area(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Exposed voxel faces of each region: faces whose other side isn't of the same region."""
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, "abc", strict=True))) for s in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))))
    own = (F.col("s.a") == 0) & (F.col("s.b") == 0) & (F.col("s.c") == 0)
    place = [*keys, label, *VOXEL]
    # each voxel sends a row to its own place and to the six beside it, so places meet in one aggregate and nothing is joined or sorted
    sent = voxels.select(*keys, label, *VOXEL, F.explode(steps).alias("s")).select(*keys, label, *((F.col(v) + F.col(f"s.{s}")).alias(v) for v, s in zip(VOXEL, "abc", strict=True)), own.alias("_own"))
    held = sent.groupBy(*place).agg(F.sum(F.when(~F.col("_own"), 1).otherwise(0)).alias("_faces"), F.max("_own").alias("_held"))
    nowhere = F.expr(" OR ".join(f"`{c}` IS NULL" for c in place))  # equal to no place, not even its own
    return held.where((~F.col("_held") | nowhere) & (F.col("_faces") > 0)).groupBy(*keys, label).agg(F.coalesce(F.sum("_faces"), F.lit(0)).alias("surface"))


def solidity(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Volume over the volume of the convex hull of a region's voxels (as cubes).

    Spark finds the ends of each row of voxels along x; a region's ends are the unit of work. Regions of one shape have one hull, so a task remembers those of up to ``SHAPES`` shapes.
    """
    rows = voxels.groupBy(*keys, label, "z", "y").agg(F.min("x").cast("long").alias("lo"), F.max("x").cast("long").alias("hi"), F.count("*").alias("n"))
    ends = F.sort_array(F.collect_list(F.struct(F.col("z").cast("long").alias("z"), F.col("y").cast("long").alias("y"), "lo", "hi")))
    whole = rows.groupBy(*keys, label).agg(F.sum("n").alias("volume"), ends.alias("_ends"))

    @F.pandas_udf("double")
    def hulls(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict[bytes, float] = {}
        for columns in batches:
            found = []
            for z, y, lo, hi in zip(*columns, strict=True):
                x = lo.min()
                shape = np.stack([z - z[0], y - y[0], lo - x, hi - x])
                name = shape.tobytes()
                if name not in known:
                    if len(known) >= SHAPES:
                        known.clear()
                    known[name] = rows_hull_volume(*shape)
                found.append(known[name])
            yield pd.Series(found, dtype=float)

    out = spread(whole, [*keys, label]).withColumn("hull", hulls(*(F.col(f"_ends.{c}") for c in ("z", "y", "lo", "hi"))))
    return out.select(*keys, label, "volume", "hull", F.when(F.col("hull") > 0, F.col("volume") / F.col("hull")).otherwise(math.nan).alias("solidity"))


def region_mean_score(voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "score") -> DataFrame:
    """Replaces each voxel's score by the mean of its region."""
    return voxels.withColumn(score, F.avg(score).over(Window.partitionBy(*keys, label)))


def compact_labels(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """Renumbers the labels of each volume 1, 2 ... in their order."""
    distinct = df.select(*keys, label).distinct()
    ranked = distinct.withColumn("_new", F.row_number().over(Window.partitionBy(*keys).orderBy(label)).cast("long"))
    return df.join(merged(ranked), [*keys, label]).withColumn(label, F.col("_new")).drop("_new")


def build_nodes(regions: DataFrame, keys: Sequence[str] = ("capture",), frame: str = "t", label: str = "label") -> DataFrame:
    """Adds ``node_id``: 1, 2 ... within a capture, by frame and label."""
    return regions.withColumn("node_id", F.row_number().over(Window.partitionBy(*keys).orderBy(frame, label)).cast("long"))


def partition_by_seed(voxels: DataFrame, seeds: DataFrame, keys: Sequence[str] = KEYS, obj: str = "label") -> DataFrame:
    """Splits each object among its seeds ``(keys, obj, seed, sz, sy, sx)``: a voxel goes to the nearest, of equal ones the least. Adds ``seed``."""
    of_object = seeds.groupBy(*keys, obj).agg(F.collect_list(F.struct("seed", "sz", "sy", "sx")).alias("_seeds"))
    a, b = dealt_alike(voxels.select(*keys, obj, *VOXEL), of_object, [*keys, obj])
    far = lambda s: F.pow(F.col("z") - s["sz"], 2) + F.pow(F.col("y") - s["sy"], 2) + F.pow(F.col("x") - s["sx"], 2)
    nearest = F.array_min(F.transform("_seeds", lambda s: F.struct(far(s).alias("far"), s["seed"].alias("seed"))))
    return a.join(b, [*keys, obj]).select(*keys, obj, *VOXEL, nearest["seed"].alias("seed")).distinct()


def label_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, project: str | None = None, label: str = "label") -> DataFrame:
    """``(keys, la, lb, inter, na, nb, iou)`` of all pairs of labels that meet; with ``project`` on projections along that axis."""
    at = [v for v in VOXEL if v != project]
    side = lambda df, name: df.select(*keys, *at, F.col(label).alias(name)).distinct()
    pa, pb = stored(side(a, "la"), "sides"), stored(side(b, "lb"), "sides")  # each is joined and counted
    left, right = dealt_alike(pa, pb, [*keys, *at])
    inter = left.join(right, [*keys, *at]).groupBy(*keys, "la", "lb").agg(F.count("*").alias("inter"))
    out = inter.join(merged(pa.groupBy(*keys, "la").agg(F.count("*").alias("na"))), [*keys, "la"]).join(merged(pb.groupBy(*keys, "lb").agg(F.count("*").alias("nb"))), [*keys, "lb"])
    return out.withColumn("iou", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")))


def merge_oversegmented(overlaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Joins pieces ``la`` while the overlap with their best reference ``lb`` rises, and gives each group to its best reference.

    Takes ``label_overlaps``, returns ``(keys, piece, merged, reference, iou)``: the least piece of the group, and its reference. The table has a row per
    pair of labels that meet, so a volume's share is small.
    """
    types = dict(overlaps.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "piece long, merged long"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {(a, b): n for a, b, n in zip(pdf["la"], pdf["lb"], pdf["inter"], strict=True)}
        group = merged_pieces(counts, dict(zip(pdf["la"], pdf["na"], strict=True)), dict(zip(pdf["lb"], pdf["nb"], strict=True)))
        return pd.DataFrame([[*key, p, g] for p, g in sorted(group.items())], columns=[*keys, "piece", "merged"])

    groups = spread(overlaps, keys).groupBy(*keys).applyInPandas(run, schema)
    sized = groups.join(merged(overlaps.select(*keys, F.col("la").alias("piece"), "na").distinct()), [*keys, "piece"]).groupBy(*keys, "merged").agg(F.sum("na").alias("n"))
    joined = groups.join(merged(overlaps.withColumnRenamed("la", "piece")), [*keys, "piece"]).groupBy(*keys, "merged", "lb").agg(F.sum("inter").alias("inter"), F.max("nb").alias("nb"))
    scored = joined.join(merged(sized), [*keys, "merged"]).withColumn("iou", F.col("inter") / (F.col("n") + F.col("nb") - F.col("inter")))
    best = scored.groupBy(*keys, "merged").agg(F.min_by(F.struct(F.col("lb").alias("reference"), "iou"), F.struct(-F.col("iou"), "lb")).alias("b"))
    return groups.join(merged(best), [*keys, "merged"]).select(*keys, "piece", "merged", "b.reference", "b.iou")
