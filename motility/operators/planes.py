"""Whole planes as arrays: tiles, their standardising, a user's model and the merge of its logits, under one shuffle by volume.

A plane is a row ``(keys, z, pixels)``; ``pixels`` holds one array per channel, each of ``ny * nx`` values, row by row. A tile is a row ``(keys, k, nz, tile)`` of ``depth``
planes. After the rows of a volume have met once, every step below leaves them where they are: the copies of a plane that overlapping tiles need are never shuffled.
Logits of a user's model are summed as they come (``predict_planes``); those of a table of tiles by ``merge_planes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.operators.voxels import KEYS, softmax, z_tiles


def _each(arrays: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` on every value of an array of arrays."""
    return F.transform(arrays, lambda a: F.transform(a, f))


def _settled(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``column`` as a value that is made once: a list of one, taken apart again. Else a plan may write it into a lambda, which makes it anew for every pixel."""
    return df.withColumn(column, F.explode(F.array(value)))


def stack_planes(voxels: DataFrame, values: Sequence[str], shape: tuple[int, int], keys: Sequence[str] = KEYS, fill: float = 0.0) -> DataFrame:
    """Voxel rows as planes of ``shape`` (ny, nx), a channel per column of ``values``.

    Pixels without a row or a value get ``fill``; of repeated voxels the greatest values, compared column by column, stay. A voxel outside of ``shape`` or without a place is
    an error. A plane without any voxel is no row. No rows give no planes.
    """
    ny, nx = shape
    inside = F.col("z").isNotNull() & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)
    pos = F.when(inside, (F.col("y") * nx + F.col("x")).cast("int")).otherwise(F.raise_error(F.lit(f"voxel outside of planes of {ny} x {nx}")).cast("int"))
    cell = F.struct(pos.alias("pos"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    held = voxels.select(*keys, F.col("z").cast("long").alias("z"), cell.alias("_cell")).repartition(*keys).groupBy(*keys, "z").agg(F.array_sort(F.collect_list("_cell")).alias("_all"))
    after = lambda i: F.get("_all", i + 1)["pos"]
    held = _settled(held, "_cells", F.filter("_all", lambda s, i: after(i).isNull() | (after(i) != s["pos"])))
    gap = lambda n: F.array_repeat(F.lit(float(fill)), n)

    def channel(name: str) -> Column:
        filled = F.transform("_cells", lambda s, i: F.concat(gap(s["pos"] - F.coalesce(F.get("_cells", i - 1)["pos"], F.lit(-1)) - 1), F.array(F.coalesce(s[name], F.lit(float(fill))))))
        return F.concat(F.flatten(filled), gap(F.lit(ny * nx - 1) - F.element_at("_cells", -1)["pos"]))

    return held.select(*keys, "z", F.array(*(channel(f"v{i}") for i in range(len(values)))).alias("pixels"))


def tile_planes(planes: DataFrame, keys: Sequence[str] = KEYS, depth: int = 16) -> DataFrame:
    """Overlapping tiles of ``depth`` planes, placed as ``z_tiles`` places them, as ``(keys, k, nz, tile)``; ``nz`` is the number of planes of the volume.

    Padding, and planes that the volume lacks below its last one, are zeros. Of repeated planes the greatest stays, compared value by value; a plane without ``z`` or pixels
    counts as missing.
    """
    volume, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("z")
    known = planes.where("z IS NOT NULL AND pixels IS NOT NULL").select(*keys, F.col("z").cast("long").alias("z"), "pixels")
    before = F.lag("z", 1, -1).over(up)
    sized = known.select(*keys, "z", "pixels", before.alias("_before"), (F.max("z").over(volume) + 1).alias("nz"), F.max(F.size("pixels")).over(volume).alias("_c"), F.max(F.size(F.get("pixels", F.lit(0)))).over(volume).alias("_n"))
    to = F.when(F.col("_before") < F.col("z"), F.sequence(F.col("_before") + 1, F.col("z"))).otherwise(F.array("z"))
    whole = sized.withColumn("_z", F.explode(to)).select(*keys, F.col("_z").alias("z"), F.when(F.col("_z") == F.col("z"), F.col("pixels")).alias("pixels"), "nz", "_c", "_n")
    placed = z_tiles(whole, keys, depth).where("z IS NOT NULL")
    tiles = placed.groupBy(*keys, "k").agg(*(F.max(c).alias(c) for c in ("nz", "_c", "_n")), F.collect_list(F.struct("zt", "pixels")).alias("_held"))
    nothing = F.array_repeat(F.array_repeat(F.lit(0.0), F.col("_n")), F.col("_c"))
    at = lambda zt: F.array_max(F.filter("_held", lambda s: s["zt"] == zt))["pixels"]
    return tiles.select(*keys, "k", "nz", F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda zt: F.coalesce(at(zt), nothing)).alias("tile"))


def standardize_planes(tiles: DataFrame, stats: Sequence[tuple[float, float]], column: str = "tile") -> DataFrame:
    """``(value - mean) / std`` in every plane of a tile; ``stats`` has a mean and a deviation for each channel, in their order."""

    def channel(plane: Column, i: int, mean: float, std: float) -> Column:
        return F.transform(F.get(plane, F.lit(i)), lambda v: (v - float(mean)) / float(std))

    return tiles.withColumn(column, F.transform(column, lambda plane: F.array(*(channel(plane, i, *s) for i, s in enumerate(stats)))))


def predict_planes(tiles: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "tile", keys: Sequence[str] = KEYS) -> DataFrame:
    """A user's model on every tile, (planes, channels, pixels) to (planes, classes, pixels), and its overlaps summed: ``(keys, z, logits, n_tiles)``, as ``merge_planes`` gives.

    ``make_model`` runs once per task. Tiles of a volume come in their order, so a plane is done once the tiles have passed it: a task holds the planes of one tile, and the
    copies that overlaps make are never shuffled, which they would be if the logits of each tile were rows. A tile without planes or arrays of unequal length is an error.
    """
    types = dict(tiles.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "z long, logits array<array<double>>, n_tiles long"])
    rows = tiles.select(*keys, "k", "nz", column, F.row_number().over(Window.partitionBy(*keys).orderBy("k")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        held: dict[int, tuple[np.ndarray, int]] = {}
        volume: list[pa.Array] = []

        def done(upto: float) -> Iterator[pa.RecordBatch]:
            for z in sorted(z for z in held if z <= upto):
                plane, n = held.pop(z)
                found = [pa.array([z], pa.int64()), pa.array([list(plane)], pa.list_(pa.list_(pa.float64()))), pa.array([n], pa.int64())]
                yield pa.RecordBatch.from_arrays([*volume, *found], [*keys, "z", "logits", "n_tiles"])

        for batch in batches:
            known = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if known["_at"][i].as_py() == 1:
                    yield from done(np.inf)
                    volume = [known[c].slice(i, 1) for c in keys]
                k, nz, tile = known["k"][i].as_py(), known["nz"][i].as_py(), known[column][i].values
                logits = np.asarray(model(tile.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(tile), len(tile[0]), -1)), float)
                first = k if nz >= len(logits) else -k
                for z in range(max(0, first), min(nz, first + len(logits))):
                    total, n = held.get(z, (0.0, 0))
                    held[z] = total + logits[z - first], n + 1
                if nz >= len(logits):
                    yield from done(k)
        yield from done(np.inf)

    return rows.mapInArrow(run, schema)


def merge_planes(tiles: DataFrame, column: str = "logits", keys: Sequence[str] = KEYS) -> DataFrame:
    """Planes put back at their place, overlaps summed value by value in the order of their tiles: ``(keys, z, column, n_tiles)``.

    Padding is cropped by the volume's own ``nz``, so volumes of any depth may be mixed. A plane lies in at most as many tiles as a tile has planes, which bounds a group.
    """
    each = tiles.select(*keys, "k", "nz", F.size(column).alias("_depth"), F.posexplode(column).alias("zt", "_plane"))
    z = F.when(F.col("nz") >= F.col("_depth"), F.col("k") + F.col("zt")).otherwise(F.col("zt") - F.col("k"))
    placed = each.withColumn("z", z.cast("long")).where((F.col("z") >= 0) & (F.col("z") < F.col("nz")))
    held = placed.groupBy(*keys, "z").agg(F.array_sort(F.collect_list(F.struct("k", F.col("_plane").alias("plane")))).alias("_held"))
    add = lambda a, b: F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda u, v: u + v))
    total = F.aggregate(F.slice("_held", 2, F.size("_held")), F.get("_held", F.lit(0))["plane"], lambda s, t: add(s, t["plane"]))
    return held.select(*keys, "z", total.alias(column), F.size("_held").cast("long").alias("n_tiles"))


def mean_planes(merged: DataFrame, column: str = "logits") -> DataFrame:
    """Adds ``score``: the merged values over the number of tiles that hold their plane."""
    return merged.withColumn("score", _each(F.col(column), lambda v: v / F.col("n_tiles")))


def classify_planes(merged: DataFrame, column: str = "logits") -> DataFrame:
    """Adds ``prob``, an array of class probabilities a pixel, and ``class``, its class from 0; the first of equal maxima."""
    merged = _settled(merged, column, F.col(column))
    pixels = F.sequence(F.lit(0), F.size(F.get(column, F.lit(0))) - 1)
    at = lambda i: F.transform(column, lambda a: F.get(a, i))
    first = lambda values: (F.array_position(values, F.array_max(values)) - 1).cast("long")
    return merged.withColumn("prob", F.transform(pixels, lambda i: softmax(at(i)))).withColumn("class", F.transform(pixels, lambda i: first(at(i))))


def voxel_rows(planes: DataFrame, nx: int, values: Mapping[str, Column], keys: Sequence[str] = KEYS, rest: Sequence[str] = ()) -> DataFrame:
    """Planes as voxel rows ``(keys, z, y, x)`` with the columns of ``rest`` and one per entry of ``values``, each an array of a value a pixel."""
    zipped = F.arrays_zip(*(c.alias(n) for n, c in values.items()))
    each = planes.select(*keys, "z", *rest, zipped.alias("_zip")).select(*keys, "z", *rest, F.posexplode("_zip").alias("_at", "_v"))
    return each.select(*keys, "z", F.floor(F.col("_at") / nx).alias("y"), (F.col("_at") % nx).cast("long").alias("x"), *rest, *(F.col(f"_v.{n}").alias(n) for n in values))
