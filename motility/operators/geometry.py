"""Geometry against the vessel: nearest points, centre lines, ellipses, rays and orientation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motility.functions.fields import NONE, lower_envelope, planes_field
from motility.functions.walks import greedy_chain
from motility.operators.voxels import KEYS, VOXEL
from motility.sources.tables import dealt_alike, merged, spread, stored

TARGET = ("tz", "ty", "tx")
#: Targets of a volume up to which each of its points is held against all of them; the points of a volume that one group then takes, about, and those whose distances it holds at a time.
FEW, SHARE, SPAN = 256, 100_000, 8192
#: Sides of a block, which one task searches, over how far it searches at first; that over a cell with a target; pairs of points and targets measured at a time.
BLOCK, WIDE, PAIRS = 16, 4, 1 << 19


def _squared(a: Sequence[str], b: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        total = total + (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    return total


def cell_of(targets: DataFrame, keys: Sequence[str], to: Sequence[str]) -> float:
    """A size of grid cells that hold about a target each: from the extent and number of the targets by volume, averaged over the volumes. One row reaches the driver."""
    box = targets.groupBy(*keys).agg(F.count("*").alias("n"), *((F.max(t) - F.min(t)).cast("double").alias(f"_e{i}") for i, t in enumerate(to)))
    wide = lambda i: F.col(f"_e{i}") > 0
    dims, logs = F.lit(0), F.lit(0.0)
    for i in range(len(to)):
        dims = dims + wide(i).cast("int")
        logs = logs + F.when(wide(i), F.log(F.when(wide(i), F.col(f"_e{i}")))).otherwise(0.0)
    size = box.agg(F.avg(F.when(dims > 0, F.exp((logs - F.log("n")) / dims))).alias("size")).first()["size"]
    return size if size and math.isfinite(size) else 1.0


def _placed(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return df.where(" AND ".join(f"abs({a}) < double('inf')" for a in axes))


def _by_rings(points: DataFrame, targets: DataFrame, keys: Sequence[str], group: Sequence[str], to: Sequence[str], best: Callable[[DataFrame], DataFrame], far: str, cell: float | None) -> DataFrame:
    """``best`` over the pairs of points and targets of one volume, where a pair's measure ``far`` is no less than its distance.

    Points are held only against the targets in their own and the neighbouring cells of a grid of size ``cell`` (``cell_of`` the targets, where none is given). What is found within one cell length
    can't be beaten by a target farther away; the points left are held against a grid twice as wide, and so on, each step written to the shared folder.
    Points of volumes without targets, and points and targets that lack a coordinate, have no row.
    """
    points, targets = stored(_placed(points, VOXEL), "points"), stored(_placed(targets, to), "targets")  # every step reads them
    if cell is None:
        cell = cell_of(targets, keys, to)
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((a, b, c), "abc", strict=True))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    rest = points.join(targets.select(*keys).distinct(), list(keys), "left_semi")
    found = None
    while found is None or not rest.isEmpty():
        at = lambda c, size=cell: F.floor(F.col(c) / F.lit(size))
        # targets, the fewer as a rule, are copied to the cells around theirs
        boxed = targets.withColumn("_s", F.explode(steps)).select(*targets.columns, *((at(t) + F.col(f"_s.{s}")).alias(f"_g{v}") for v, t, s in zip(VOXEL, to, "abc", strict=True)))
        around = rest.select("*", *(at(v).alias(f"_g{v}") for v in VOXEL))
        cells = [*keys, *(f"_g{v}" for v in VOXEL)]
        mine, theirs = dealt_alike(around, boxed, cells)  # a few bytes of points and targets make many pairs
        near = stored(best(mine.join(theirs, cells)).where(F.col(far) <= cell * (1 - 1e-9)), "nearest")
        rest = stored(rest.join(merged(near.select(*group)), list(group), "left_anti"), "points")
        found = near if found is None else found.unionByName(near)
        cell *= 2
    return found


def nearest_point(points: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS, point_id: str = "label", cell: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The nearest target of each point of the same volume: ``(keys, point_id, z, y, x, tz, ty, tx, distance)``; of equal ones the least.

    ``cell`` is the grid size that the search begins with; by default it suits the targets, and volumes of ``FEW`` targets at most need none. Columns ``order`` of the targets, where given, decide between equal distances and are returned in place of the target's place.
    """
    group = [*keys, point_id, *VOXEL]
    named = targets.select(*keys, *(F.col(v).alias(t) for v, t in zip(VOXEL, TARGET, strict=True)), *order)
    told = list(order) or list(TARGET)

    def best(pairs: DataFrame) -> DataFrame:
        near = pairs.groupBy(*group).agg(F.min(F.struct(_squared(VOXEL, TARGET).alias("d"), *told)).alias("m"))
        return near.select(*group, *(f"m.{c}" for c in told), F.sqrt("m.d").alias("distance"))

    if cell is not None:
        return _by_rings(points.select(group), named, keys, group, TARGET, best, "distance", cell)
    points, named = stored(_placed(points.select(group), VOXEL), "points"), stored(_placed(named, TARGET), "targets")
    sizes = named.groupBy(*keys).agg(F.count("*").alias("_n")).join(merged(points.groupBy(*keys).agg(F.count("*").alias("_p"))), list(keys))
    sizes = stored(sizes.withColumn("_k", F.ceil(F.col("_p") / SHARE)), "sizes")
    near = stored(_nearest_of_few(points, named, sizes.where(F.col("_n") <= FEW).select(*keys, "_k"), keys, group, told), "nearest")
    many = sizes.where(F.col("_n") > FEW).select(*keys)
    if many.isEmpty():
        return near
    these = lambda df: df.join(merged(many), list(keys), "left_semi")
    return near.unionByName(_by_rings(these(points), these(named), keys, group, TARGET, best, "distance", None))


def _nearest_of_few(points: DataFrame, targets: DataFrame, few: DataFrame, keys: Sequence[str], group: Sequence[str], told: Sequence[str]) -> DataFrame:
    """The nearest target of each point in the volumes of ``few``, whose points are dealt to ``_k`` shares. A task holds a share and the ``FEW`` targets at most of its volume, and the distances of ``SPAN`` points to them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*told))  # of equal distances the least target stands
    dealt = points.distinct().join(merged(few), list(keys)).withColumn("_share", F.pmod(F.xxhash64(*VOXEL), F.col("_k"))).drop("_k")
    copied = targets.join(merged(few), list(keys)).withColumn("_rank", rank).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k")
    kinds = dict(points.dtypes) | dict(targets.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, *told)), "distance double"])
    number = lambda table, c: table.column(c).cast(pa.float64()).to_numpy()

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return pa.Table.from_batches([], pa.schema([*(mine.schema.field(c) for c in group), *(theirs.schema.field(c) for c in told), pa.field("distance", pa.float64())]))
        theirs = theirs.sort_by("_rank")
        which, least = [], []
        for at in range(0, len(mine), SPAN):
            part = mine.slice(at, SPAN)
            d = sum((number(part, v)[:, None] - number(theirs, t)[None]) ** 2 for v, t in zip(VOXEL, TARGET, strict=True))
            which.append(d.argmin(axis=1))
            least.append(d.min(axis=1))
        chosen = theirs.take(pa.array(np.concatenate(which)))
        columns = [*(mine.column(c) for c in group), *(chosen.column(c) for c in told), pa.array(np.sqrt(np.concatenate(least)))]
        return pa.Table.from_arrays(columns, names=[*group, *told, "distance"])

    return dealt.groupBy(*keys, "_share").cogroup(copied.groupBy(*keys, "_share")).applyInArrow(run, schema)


def _ranked(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """The order of the rows by these columns, as Spark sorts them: nulls first, what is no number last."""
    keys = []
    for c in names:
        column = table.column(c)
        if pa.types.is_floating(column.type):
            column = pc.if_else(pc.is_nan(column), pa.scalar(math.inf, column.type), column)
        keys.append(pc.rank(column, null_placement="at_start", tiebreaker="dense").to_numpy())
    return np.lexsort(keys[::-1])


def _nearest_within(points: np.ndarray, targets: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """The number and squared distance of the target nearest to each point; of equal ones the first, and -1 where none is within ``far``. Cells of a grid are searched with those around them, the finest first."""
    which, least = np.full(len(points), -1), np.full(len(points), np.inf)
    low = np.minimum(points.min(axis=0), targets.min(axis=0))
    for size in (far / 4, far / 2, far):
        left = np.flatnonzero(which < 0)
        if not len(left):
            break
        at, cells = np.floor((points[left] - low) / size).astype(np.int64) + 1, np.floor((targets - low) / size).astype(np.int64) + 1
        wide = np.maximum(at.max(axis=0), cells.max(axis=0)) + 2
        code = (cells[:, 0] * wide[1] + cells[:, 1]) * wide[2] + cells[:, 2]
        order = np.argsort(code, kind="stable")
        code = code[order]
        lines = [(((at[:, 0] + a) * wide[1] + at[:, 1] + b) * wide[2] + at[:, 2]) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        first, stop = (np.stack([np.searchsorted(code, line + s, side) for line in lines], axis=1).ravel() for s, side in ((-1, "left"), (1, "right")))
        n = stop - first
        ends = np.cumsum(n.reshape(-1, len(lines)).sum(axis=1))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "right"), len(left)))
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            m, base = n[a * len(lines) : b * len(lines)], first[a * len(lines) : b * len(lines)]
            per = m.reshape(-1, len(lines)).sum(axis=1)
            if not per.sum():
                continue
            j = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(base, m)]
            i = np.repeat(left[a:b], per)
            d = 0.0
            for axis in range(3):
                d = d + (points[i, axis] - targets[j, axis]) * (points[i, axis] - targets[j, axis])
            some = np.flatnonzero(per)
            starts = (np.cumsum(per) - per)[some]
            best = np.minimum.reduceat(d, starts)
            one = np.minimum.reduceat(np.where(d == np.repeat(best, per[some]), j, len(targets)), starts)
            sure = np.sqrt(best) <= size * (1 - 1e-9)
            who = left[a:b][some][sure]
            which[who], least[who] = one[sure], best[sure]
    return which, least


def nearest_in_blocks(points: DataFrame, targets: DataFrame, keys: Sequence[str], point_id: str, order: Sequence[str], cell: float | None = None) -> DataFrame:
    """``nearest_point`` for volumes that may be dense: ``(keys, point_id, z, y, x, order, distance)``.

    Points are dealt by blocks of their volume, targets to all blocks whose points may be near to them, and a task searches a block by a grid whose cells follow from how dense the targets are; so a point is held against some
    tens of targets however many its volume has. ``cell`` bounds how far is searched at first. Points without a target so near are searched again twice as far.
    """
    group = [*keys, point_id, *VOXEL]
    targets = stored(_placed(targets.select(*keys, *(F.col(v).alias(t) for v, t in zip(VOXEL, TARGET, strict=True)), *order), TARGET), "targets")
    rest = _placed(points.select(group), VOXEL).join(merged(targets.select(*keys).distinct()), list(keys), "left_semi")
    cell = min(cell or math.inf, WIDE * cell_of(targets, keys, TARGET))
    kinds = dict(rest.dtypes) | dict(targets.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, *order)), "distance double"])
    number = lambda table, names: np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in names])
    boxes = [f"_g{v}" for v in VOXEL]

    def within(far: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(here: pa.Table, there: pa.Table) -> pa.Table:
            if not len(here):
                return pa.Table.from_batches([], pa.schema([*(here.schema.field(c) for c in group), *(there.schema.field(c) for c in order), pa.field("distance", pa.float64())]))
            there = there.take(pa.array(_ranked(there, order))) if len(there) else there
            which, least = _nearest_within(number(here, VOXEL), number(there, TARGET), far) if len(there) else (np.full(len(here), -1), np.full(len(here), np.inf))
            lost = which < 0
            chosen = there.select(list(order)).take(pa.array(which, mask=lost))
            return pa.Table.from_arrays([*(here.column(c) for c in group), *chosen.columns, pa.array(np.sqrt(least), mask=lost)], names=[*group, *order, "distance"])

        return run

    found = None
    while True:
        side, far = cell * BLOCK, cell
        block = lambda c, side=side: F.floor(c / F.lit(side) + 0.5).cast("long")
        mine = spread(rest.withColumns({g: block(F.col(v)) for g, v in zip(boxes, VOXEL, strict=True)}), [*keys, *boxes]).dropDuplicates([*group, *boxes])
        theirs = targets
        for g, t in zip(boxes, TARGET, strict=True):
            theirs = theirs.withColumn(g, F.explode(F.sequence(block(F.col(t) - far), block(F.col(t) + far))))
        theirs = spread(theirs, [*keys, *boxes])
        near = stored(mine.groupBy(*keys, *boxes).cogroup(theirs.groupBy(*keys, *boxes)).applyInArrow(within(far), schema), "nearest")
        here = near.where("distance IS NOT NULL")
        found = here if found is None else found.unionByName(here)
        rest = near.where("distance IS NULL").select(group)
        if rest.isEmpty():
            return found
        cell *= 2


def distance_field(voxels: DataFrame, surface: DataFrame, keys: Sequence[str] = KEYS, slab: int = 8, unique: bool = False, nearest_of: str | None = None) -> DataFrame:
    """Adds ``d2``: the exact squared distance of each voxel to the nearest voxel of the surface in its volume.

    Coordinates are whole numbers. Distances are built one axis at a time: tasks take ``slab`` planes of constant x of the surface and settle z and y inside them; their fields are dealt anew by ``slab``
    planes of constant y, where the distance along x is added and voxels read theirs. A volume is never one group, and no pairs are made. A slab is as large as a few planes of the box around the
    volume's voxels. Voxels of volumes without a surface, and voxels without a place, have no row; of repeated rows ``unique`` keeps one.
    ``nearest_of`` names a column of the voxels: of those with one value in one such slab, only the nearest stay.
    """
    keys = list(keys)
    whole = lambda df: df.where(" AND ".join(f"{a} IS NOT NULL" for a in VOXEL)).withColumns({a: F.col(a).cast("long") for a in VOXEL})
    voxels, surface = whole(voxels), whole(surface)
    box = voxels.groupBy(*keys).agg(F.min("z").alias("_z1"), F.max("z").alias("_z2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"))
    in_planes = surface.select(*keys, *VOXEL).join(merged(box), keys).withColumn("_p", F.floor(F.col("x") / slab))
    told = [surface.schema[k] for k in keys]
    field = T.StructType([*told, *(T.StructField(c, T.LongType()) for c in ("_b", "_x", "_z", "_n")), T.StructField("_d", T.ArrayType(T.LongType()))])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x0 = int(first["_p"]) * slab
        b1, b2 = int(first["_y1"]) // slab, int(first["_y2"]) // slab
        planes = planes_field(*(pdf[a].to_numpy() for a in "xzy"), (int(first["_z1"]), int(first["_z2"])), (b1 * slab, b2 * slab + slab - 1), (x0, x0 + slab - 1))
        rows = [(*(first[k] for k in keys), b, x0, int(first["_z1"]), planes.shape[1], planes[:, :, (b - b1) * slab :][:, :, :slab].ravel()) for b in range(b1, b2 + 1)]
        return pd.DataFrame(rows, columns=field.names)

    fields = spread(in_planes, [*keys, "_p"]).groupBy(*keys, "_p").applyInPandas(settle, field)
    out = T.StructType([*voxels.schema.fields, T.StructField("d2", T.LongType())])

    def read(parts: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(parts) or not len(pdf):
            return pd.DataFrame(columns=out.names).astype({"d2": "int64"})
        x0 = min(int(parts["_x"].min()), int(pdf["x"].min()))
        n = max(int(parts["_x"].max()) + slab - 1, int(pdf["x"].max())) - x0 + 1
        lines = np.full((slab, int(parts["_n"].iloc[0]), n), NONE, np.int64)
        for x, d in zip(parts["_x"], parts["_d"], strict=True):
            lines[:, :, x - x0 : x - x0 + slab] = np.asarray(d, np.int64).reshape(slab, -1, slab).transpose(2, 1, 0)
        lines = lower_envelope(lines)
        pdf = pdf.drop_duplicates() if unique else pdf
        at = pdf["y"].to_numpy() % slab, pdf["z"].to_numpy() - int(parts["_z"].iloc[0]), pdf["x"].to_numpy() - x0
        pdf = pdf.assign(d2=lines[at])
        return pdf[pdf["d2"] == pdf.groupby(nearest_of, dropna=False)["d2"].transform("min")] if nearest_of else pdf

    mine = voxels.withColumn("_b", F.floor(F.col("y") / slab))
    fields, mine = spread(fields, [*keys, "_b"]), spread(mine, [*keys, "_b"])
    return fields.groupBy(*keys, "_b").cogroup(mine.groupBy(*keys, "_b")).applyInPandas(lambda a, b: read(a, b.drop(columns="_b")), out)


def min_distance(voxels: DataFrame, surface: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """The least distance of a region's voxels to the surface, and the rounded median of the voxels that have it. See ``distance_field``."""
    field = distance_field(voxels.select(*keys, label, *VOXEL), surface, keys, unique=True, nearest_of=label)
    middles = spread(field, [*keys, label]).groupBy(*keys, label, "d2").agg(*(F.round(F.median(v)).alias(f"c{v}") for v in VOXEL))
    least = middles.groupBy(*keys, label).agg(F.min(F.struct("d2", "cz", "cy", "cx")).alias("m"))
    return least.select(*keys, label, F.sqrt(F.col("m.d2").cast("double")).alias("distance"), "m.cz", "m.cy", "m.cx")


def centerline(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The middle of a vessel mask: ``(keys, pos, z, y, x)``.

    If the first column of the projection along z holds at least as many pixels as the first row, the line runs along x, else along y; ``pos`` is
    the place along it. The other coordinate is the rounded median of the pixels there, z the rounded median of the fullest levels.
    """
    flat = mask.select(*keys, "y", "x").distinct()
    axis = flat.groupBy(*keys).agg((F.count(F.when(F.col("x") == 0, 1)) >= F.count(F.when(F.col("y") == 0, 1))).alias("along_x"))
    levels = mask.groupBy(*keys, "z").agg(F.count("*").alias("n"))
    full = levels.withColumn("most", F.max("n").over(Window.partitionBy(*keys))).where("n = most").groupBy(*keys).agg(F.round(F.median("z")).alias("z"))
    placed = flat.join(axis, list(keys)).select(*keys, "along_x", F.when(F.col("along_x"), F.col("x")).otherwise(F.col("y")).alias("pos"), F.when(F.col("along_x"), F.col("y")).otherwise(F.col("x")).alias("other"))
    line = placed.groupBy(*keys, "along_x", "pos").agg(F.round(F.median("other")).alias("mid")).join(full, list(keys))
    return line.select(*keys, "pos", "z", F.when(F.col("along_x"), F.col("mid")).otherwise(F.col("pos").cast("double")).alias("y"), F.when(F.col("along_x"), F.col("pos").cast("double")).otherwise(F.col("mid")).alias("x"))


def order_points(points: DataFrame, keys: Sequence[str] = KEYS, start: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Adds ``pos``: 0, 1 ... along a greedy chain that begins at the point nearest to ``start`` (z, y, x) and goes on to the nearest one left.

    Ties go to the least point. A volume's line is the unit of work; its points are found by a grid (``greedy_chain``), so time follows their number.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("pos", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(VOXEL), ignore_index=True)
        return pdf.assign(pos=greedy_chain(pdf[list(VOXEL)].to_numpy(float), np.array(start, float)))

    return spread(points, keys).groupBy(*keys).applyInPandas(run, schema)


def local_direction(points: DataFrame, ordered: DataFrame, keys: Sequence[str] = KEYS, point_id: str = "label", window: int = 5, cell: float | None = None) -> DataFrame:
    """Adds ``flow``: the angle in the plane from the line's point ``window`` before the nearest one to that ``window`` after, ends clamped. ``cell`` as in ``nearest_point``."""
    group = [*keys, point_id, *VOXEL]
    ordered = stored(ordered.select(*keys, "pos", *VOXEL), "line")  # it is searched, and read at both ends of a direction
    near = nearest_point(points, ordered, keys, point_id, cell, ["pos"]).drop("distance")
    # a direction for each point of the line, which is joined to the points once
    ends = ordered.groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    way = ordered.select(*keys, "pos").join(merged(ends), list(keys)).withColumn("a", F.greatest(F.col("pos") - window, F.col("lo"))).withColumn("b", F.least(F.col("pos") + window, F.col("hi")))
    side = lambda c: ordered.select(*keys, F.col("pos").alias(c), *(F.col(v).cast("double").alias(f"{c}{v}") for v in "yx"))
    way = way.join(merged(side("a")), [*keys, "a"]).join(merged(side("b")), [*keys, "b"])
    way = way.select(*keys, "pos", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("flow"))
    return near.join(merged(way), [*keys, "pos"]).select(*group, "pos", "flow")


_POWERS = [(i, j) for n in range(5) for i in range(n, -1, -1) for j in [n - i]]


def _ellipse(row: dict[tuple[int, int], float]) -> tuple[float, ...]:
    """Direct least-squares ellipse from the sums of x**i * y**j: centre, radii (long first) and angle; zeros without one."""
    n = row[0, 0]
    if n < 5:
        return (0.0,) * 5
    m = lambda i, j: row[i, j]
    square, mixed = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    block = lambda p, q: np.array([[m(a + c, b + d) for c, d in q] for a, b in p])
    s1, s2, s3 = block(square, square), block(square, mixed), block(mixed, mixed)
    try:
        t = -np.linalg.solve(s3, s2.T)
        values, vectors = np.linalg.eig(np.linalg.solve(np.array([[0, 0, 2.0], [0, -1.0, 0], [2.0, 0, 0]]), s1 + s2 @ t))
    except np.linalg.LinAlgError:
        return (0.0,) * 5
    vectors = np.real(vectors)
    fits = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 1e-14)
    if not len(fits):
        return (0.0,) * 5
    k = fits[np.argmin(np.abs(np.real(values[fits])))]
    a, b, c = vectors[:, k]
    d, e, f = t @ vectors[:, k]
    centre = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e])
    f0 = a * centre[0] ** 2 + b * centre[0] * centre[1] + c * centre[1] ** 2 - f
    spread, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / f0)
    if not (np.isfinite(spread).all() and (spread > 0).all()):
        return (0.0,) * 5
    angle = math.atan2(axes[1, 0], axes[0, 0])
    angle = angle + math.pi if angle <= -math.pi / 2 else angle - math.pi if angle > math.pi / 2 else angle
    return float(centre[0]), float(centre[1]), float(spread[0] ** -0.5), float(spread[1] ** -0.5), angle


def fit_ellipse(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """The ellipse of each section: ``cx, cy, r1, r2`` (r1 at least r2) and ``angle`` of the long axis; zeros where no ellipse fits.

    Spark adds up the monomials of the points, moved to their mean and scaled by their spread; a task then only solves a 3x3 eigenproblem per section.
    """
    mean = points.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.greatest(F.stddev_pop(x) + F.stddev_pop(y), F.lit(1e-9)).alias("scale"))
    unit = points.join(merged(mean), list(keys)).withColumn("u", (F.col(x) - F.col("mx")) / F.col("scale")).withColumn("v", (F.col(y) - F.col("my")) / F.col("scale"))
    power = lambda c, k: F.lit(1.0) if k == 0 else F.col(c) if k == 1 else F.pow(F.col(c), F.lit(float(k)))
    sums = unit.groupBy(*keys, "mx", "my", "scale").agg(*(F.sum(power("u", i) * power("v", j)).alias(f"s{i}{j}") for i, j in _POWERS))

    @F.pandas_udf("cx double, cy double, r1 double, r2 double, angle double")
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_ellipse({p: r[k] for k, p in enumerate(_POWERS)}) for r in rows.to_numpy()]
        return pd.DataFrame(found, columns=["cx", "cy", "r1", "r2", "angle"])

    out = sums.withColumn("e", solve(F.struct(*(f"s{i}{j}" for i, j in _POWERS))))
    fits = F.col("e.r1") > 0
    moved = lambda c, m: F.when(fits, F.col(f"e.{c}") * F.col("scale") + F.col(m)).otherwise(0.0).alias(c)
    return out.select(*keys, moved("cx", "mx"), moved("cy", "my"), (F.col("e.r1") * F.col("scale")).alias("r1"), (F.col("e.r2") * F.col("scale")).alias("r2"), F.col("e.angle").alias("angle"))


def ellipse_polar(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``radius2`` (1 on the ellipse) and ``theta`` in [0, 2 pi), relative to the ellipse ``cx, cy, r1, r2, angle``; null without radii."""
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    u = dx * F.cos("angle") + dy * F.sin("angle")
    v = -dx * F.sin("angle") + dy * F.cos("angle")
    fits = (F.col("r1") > 0) & (F.col("r2") > 0)
    p, q = F.when(fits, u / F.col("r1")), F.when(fits, v / F.col("r2"))
    theta = F.atan2(q, p)
    return df.withColumn("radius2", p * p + q * q).withColumn("theta", F.when(theta < 0, theta + 2 * math.pi).otherwise(theta))


def nearest_normal(points: DataFrame, normals: DataFrame, keys: Sequence[str] = KEYS, point_id: str = "label", cell: float | None = None) -> DataFrame:
    """The surface point whose normal line passes nearest: least sum of the distance to the line and from its foot to the surface point.

    ``normals`` has ``sid, sz, sy, sx`` and unit vectors ``nz, ny, nx``. Returns ``(keys, point_id, sid, line_distance, foot_distance)``; ties go to the least sid. The sum is no less than the
    distance to the surface point, so a grid bounds the search; ``cell`` as in ``nearest_point``.
    """
    group = [*keys, point_id]

    def best(both: DataFrame) -> DataFrame:
        along = off = F.lit(0.0)
        for a in VOXEL:
            along = along + (F.col(a) - F.col(f"s{a}")) * F.col(f"n{a}")
        both = both.withColumn("_t", along)
        for a in VOXEL:
            gap = F.col(a) - F.col(f"s{a}") - F.col("_t") * F.col(f"n{a}")
            off = off + gap * gap
        both = both.withColumn("_line", F.sqrt(off)).withColumn("_foot", F.abs("_t"))
        least = both.groupBy(*group).agg(F.min(F.struct(F.round(F.col("_line") + F.col("_foot"), 9).alias("sum"), "sid", "_line", "_foot")).alias("m"))
        return least.select(*group, "m.sid", F.col("m._line").alias("line_distance"), F.col("m._foot").alias("foot_distance"), F.col("m.sum").alias("_sum"))

    found = _by_rings(points.select(*group, *VOXEL), normals, keys, group, ["sz", "sy", "sx"], best, "_sum", cell)
    return found.drop("_sum")


def extent_along_ray(cells: DataFrame, voxels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", steps: int = 10_000, step: float = 0.01) -> DataFrame:
    """How many voxels of a cell the ray from its surface point ``sz, sy, sx`` through its centroid ``cz, cy, cx`` meets.

    The ray is sampled at ``steps`` places, ``step`` times the way to the centroid apart; places are rounded and counted once. Samples beyond the far
    corner of the cell's box can't meet it and are not made.
    """
    box = voxels.groupBy(*keys, label).agg(*(f(a).alias(f"{a}{n}") for a in VOXEL for f, n in ((F.min, "1"), (F.max, "2"))))
    at = cells.join(merged(box), [*keys, label])
    reach = F.lit(0.0)
    way = F.lit(0.0)
    for a in VOXEL:
        gap = F.greatest(F.abs(F.col(f"{a}1") - F.col(f"s{a}")), F.abs(F.col(f"{a}2") - F.col(f"s{a}"))) + 1
        reach = reach + gap * gap
        way = way + F.pow(F.col(f"c{a}") - F.col(f"s{a}"), 2)
    last = F.when(way > 0, F.least(F.lit(steps), F.ceil(F.sqrt(reach / way) / step))).otherwise(0).cast("int")
    places = at.withColumn("_i", F.explode(F.sequence(F.lit(0), last))).select(*keys, label, *(F.round(F.col(f"s{a}") + (F.col(f"c{a}") - F.col(f"s{a}")) * F.col("_i") * step).cast("long").alias(a) for a in VOXEL))
    hit = places.distinct().join(merged(voxels.select(*keys, label, *VOXEL)), [*keys, label, *VOXEL], "left_semi").groupBy(*keys, label).agg(F.count("*").alias("height"))
    return cells.select(*keys, label).join(merged(hit), [*keys, label], "left").withColumn("height", F.coalesce("height", F.lit(0)))


def oriented_width(voxels: DataFrame, angles: DataFrame, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """The greater of the two widths of a region across its turned axes, and its height to width.

    ``angles`` has ``about_z, about_x`` (radians) and ``height`` by region. Coordinates are turned about z, then about x. A width is the distance between the mean places
    of the voxels at both extremes of a turned axis (x and y). Regions without voxels have nulls.
    """
    u = F.col("x") * F.cos("about_z") + F.col("y") * F.sin("about_z")
    w = -F.col("x") * F.sin("about_z") + F.col("y") * F.cos("about_z")
    a, b = dealt_alike(voxels, angles, [*keys, label])
    turned = a.join(b, [*keys, label]).withColumn("u", F.round(u, 6)).withColumn("v", F.round(w * F.cos("about_x") + F.col("z") * F.sin("about_x"), 6))
    mine = Window.partitionBy(*keys, label)
    for c in "uv":
        turned = turned.withColumn(f"{c}_lo", F.min(c).over(mine)).withColumn(f"{c}_hi", F.max(c).over(mine))
    means = [F.avg(F.when(F.col(c) == F.col(f"{c}_{e}"), F.col(a))).alias(f"{c}{e}{a}") for c in "uv" for e in ("lo", "hi") for a in VOXEL]
    ends = turned.groupBy(*keys, label).agg(*means)
    length = lambda c: F.sqrt(_squared([f"{c}lo{a}" for a in VOXEL], [f"{c}hi{a}" for a in VOXEL]))
    out = angles.select(*keys, label, "height").join(merged(ends), [*keys, label], "left").withColumn("width", F.greatest(length("u"), length("v")))
    return out.select(*keys, label, "width", F.when(F.col("width") > 0, F.col("height") / F.col("width")).alias("ratio"))


def orientation_delta(regions: DataFrame, vessel: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("azimuth", "elevation", "roll")) -> DataFrame:
    """Region orientation minus that of the vessel, by axis."""
    side = vessel.select(*keys, *(F.col(a).alias(f"_{a}") for a in axes))
    return regions.join(merged(side), list(keys)).withColumns({a: F.col(a) - F.col(f"_{a}") for a in axes}).drop(*(f"_{a}" for a in axes))
