"""Voxel and tile tables: planes, tiles, logits and masks, one row per voxel.

``keys`` names the columns of a volume (capture and frame); a voxel is ``z, y, x`` within it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.sources.tables import merged, spread

KEYS = ("capture", "t")
VOXEL = ("z", "y", "x")


def normalize_intensity(df: DataFrame, value: str = "raw", bits: int = 16) -> DataFrame:
    """Adds ``value``: the pixel over the greatest of its bits. Works on a number or on a plane array."""
    most = float(2**bits - 1)
    is_plane = dict(df.dtypes)[value].startswith("array")
    return df.withColumn("value", F.transform(value, lambda v: v / most) if is_plane else F.col(value) / most)


def arrange_channels(df: DataFrame, order: Sequence[int], n_out: int = 3, channel: str = "c", value: str = "value") -> DataFrame:
    """Channel ``i`` moves to place ``order[i]``; other channels are dropped, and places that no channel takes are filled with zeros.

    Zero rows are made from the rows of the first channel, so every pixel has ``n_out`` channels.
    """
    place = F.lit(None).cast("long")
    for old, new in enumerate(order):
        place = F.when(F.col(channel) == old, F.lit(new).cast("long")).otherwise(place)
    moved = df.withColumn(channel, place).where(F.col(channel).isNotNull())
    empty = [p for p in range(n_out) if p not in order]
    if not empty:
        return moved
    zero = df.where(F.col(channel) == 0).withColumn(channel, F.explode(F.array(*(F.lit(p).cast("long") for p in empty)))).withColumn(value, F.lit(0.0))
    return moved.unionByName(zero)


def z_tiles(planes: DataFrame, keys: Sequence[str] = KEYS, depth: int = 16) -> DataFrame:
    """Overlapping depth windows of stride 1 as ``(keys, k, zt, z)`` and the plane's columns.

    ``nz`` planes (0 .. nz - 1) of more than ``depth`` give the tiles k = 0 .. nz - depth; as many give one; fewer are placed in depth - nz + 1 ways, and the
    other places of a tile are empty planes, whose ``z`` and columns are null. Planes keep their arrays: the copies are made after one shuffle by volume, and
    stay in its partitions. A row without ``z`` is no plane; a repeated plane is copied as often as it comes.
    """
    rest = [c for c in planes.columns if c not in (*keys, "z")]
    down = Window.partitionBy(*keys).orderBy(F.col("z").desc())
    each = planes.where(F.col("z").isNotNull()).withColumn("_nz", F.first("z").over(down).cast("long") + 1).withColumn("_first", F.row_number().over(down) == 1)
    z, nz, zero, full = F.col("z").cast("long"), F.col("_nz"), F.lit(0).cast("long"), F.lit(depth).cast("long")
    place = lambda k, zt, held: F.struct(k.alias("k"), zt.alias("zt"), F.lit(held).alias("held"))
    deep = F.transform(F.sequence(F.greatest(zero, z - full + 1), F.least(z, nz - full)), lambda k: place(k, z - k, True))
    shifts = F.sequence(zero, full - nz)
    flat = F.transform(shifts, lambda k: place(k, z + k, True))
    outside = lambda k: F.filter(F.sequence(zero, full - 1), lambda zt: (zt < k) | (zt >= k + nz))
    empty = F.flatten(F.transform(shifts, lambda k: F.transform(outside(k), lambda zt: place(k, zt, False))))
    places = F.when(nz >= full, deep).when(F.col("_first"), F.concat(flat, empty)).otherwise(flat)
    held = lambda c: F.when(F.col("_place.held"), F.col(c)).alias(c)
    return each.withColumn("_place", F.explode(places)).select(*keys, "_place.k", "_place.zt", *(held(c) for c in ("z", *rest)))


def standardize_channels(df: DataFrame, stats: DataFrame, channel: str = "c", value: str = "value") -> DataFrame:
    """``(value - mean) / std`` by channel; ``stats`` has ``c, mean, std``, a row per channel."""
    both = df.join(stats.select(F.col("c").alias("_c"), "mean", "std"), F.col(channel) == F.col("_c"))
    return both.withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("_c", "mean", "std")


def _placed(tiles: DataFrame, nz: int | None) -> DataFrame:
    """Tile voxels at their place in the volume; with ``nz`` below the depth, padding is cropped."""
    if nz is None:
        return tiles.withColumn("z", F.col("k") + F.col("zt"))
    return tiles.withColumn("z", F.col("zt") - F.col("k")).where((F.col("z") >= 0) & (F.col("z") < nz))


def merge_tiles(tiles: DataFrame, logits: Sequence[str], keys: Sequence[str] = KEYS, nz: int | None = None) -> DataFrame:
    """Sums the logits of all tiles that hold a voxel. Give ``nz`` for volumes that were padded."""
    return _placed(tiles, nz).groupBy(*keys, *VOXEL).agg(*(F.sum(c).alias(c) for c in logits))


def mean_over_planes(tiles: DataFrame, score: str = "score", keys: Sequence[str] = KEYS, nz: int | None = None) -> DataFrame:
    """The mean score of a voxel over the tiles that hold it."""
    return _placed(tiles, nz).groupBy(*keys, *VOXEL).agg(F.avg(score).alias(score), F.count("*").alias("n_tiles"))


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array; the maximum is taken off first."""
    powers = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def softmax_argmax(df: DataFrame, logits: Sequence[str]) -> DataFrame:
    """Adds ``prob array<double>`` and ``class`` (from 0; the first of equal maxima)."""
    values = F.array(*logits)
    return df.withColumn("prob", softmax(values)).withColumn("class", (F.array_position(values, F.array_max(values)) - 1).cast("long"))


def paint_boxes(voxels: DataFrame, boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``paint``: the product of the scores of the boxes that hold a voxel, 1 without any. Box sides are included.

    Boxes are dealt to the cells of a grid in y and x, and each voxel meets those of its own cell only.
    """
    from motility.operators.detections import cell_size, in_cells

    size = cell_size(boxes)
    b = in_cells(boxes, size).select(*(F.col(k).alias(f"_{k}") for k in keys), "y1", "x1", "z1", "y2", "x2", "z2", "_cy", "_cx", F.col("score").alias("_score"))
    at = voxels.select(*keys, *VOXEL).withColumn("_vy", F.floor(F.col("y") / F.lit(size[0]))).withColumn("_vx", F.floor(F.col("x") / F.lit(size[1])))
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_vy") == F.col("_cy"), F.col("_vx") == F.col("_cx")]
    hit = at.join(merged(b), same + [F.col(a).between(F.col(f"{a}1"), F.col(f"{a}2")) for a in VOXEL]).groupBy(*keys, *VOXEL).agg(F.product("_score").alias("paint"))
    return voxels.join(merged(hit), [*keys, *VOXEL], "left").withColumn("paint", F.coalesce("paint", F.lit(1.0)))


def max_projection(df: DataFrame, value: str, axis: str = "z", keys: Sequence[str] = KEYS) -> DataFrame:
    """The greatest value along one axis."""
    return df.groupBy(*keys, *(a for a in VOXEL if a != axis)).agg(F.max(value).alias(value))


def temporal_majority(mask: DataFrame, keys: Sequence[str] = ("capture",), frame: str = "t") -> DataFrame:
    """Voxels that are set in more than half of the frames of a capture."""
    frames = mask.groupBy(*keys).agg(F.count_distinct(frame).alias("frames"))
    counts = spread(mask.select(*keys, frame, *VOXEL), [*keys, *VOXEL]).groupBy(*keys, *VOXEL).agg(F.count_distinct(frame).alias("n"))
    return counts.join(frames, list(keys)).where(F.col("n") * 2 > F.col("frames")).select(*keys, *VOXEL)


def rescale_z(voxels: DataFrame, factor: float, nz: int) -> DataFrame:
    """Nearest-neighbour resampling of label planes 0 .. nz - 1 to round(nz * factor) planes.

    Target plane j shows source plane floor((j + 1/2) * nz / target).
    """
    target = max(1, int(nz * factor + 0.5))
    source = lambda j: F.floor((j + F.lit(0.5)) * F.lit(nz) / F.lit(target))
    planes = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long")), lambda j: source(j) == F.col("z"))
    return voxels.withColumn("z", F.explode(planes))


def boundary_shell(mask: DataFrame, keys: Sequence[str] = KEYS, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """The voxels that a 3x3x3 dilation adds to a mask, clipped to ``dims`` (nz, ny, nx) where given."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    own = (F.col("s.a") == 0) & (F.col("s.b") == 0) & (F.col("s.c") == 0)
    near = mask.select(*keys, *VOXEL, F.explode(steps).alias("s")).select(*keys, *((F.col(v) + F.col(f"s.{s}")).alias(v) for v, s in zip(VOXEL, "abc", strict=True)), own.alias("own"))
    if dims is not None:
        for v, n in zip(VOXEL, dims, strict=True):
            near = near.where(F.col(v).between(0, n - 1))
    return near.groupBy(*keys, *VOXEL).agg(F.max("own").alias("own")).where("not own").drop("own")


def predict_tiles(tiles: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batch inference with a user's model: ``make_model`` runs once per task, its result once per batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield model(batch)

    return tiles.mapInPandas(run, schema)
