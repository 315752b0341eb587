"""Detections (boxes with scores) and measures of segmentations and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motility.operators.voxels import KEYS, VOXEL
from motility.sources.tables import dealt_alike, in_ranges, merged

SIDES = (("y1", "y2"), ("x1", "x2"), ("z1", "z2"))


def filter_detections(df: DataFrame, min_conf: float = 0.1) -> DataFrame:
    """Boxes with a positive volume and a score of at least ``min_conf``."""
    size = F.lit(1.0)
    for lo, hi in SIDES:
        size = size * (F.col(hi) - F.col(lo))
    return df.where((size > 0) & (F.col("score") >= min_conf))


def clamp_boxes(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Moves boxes from counting from 0 to counting from 1 and clamps them to 1 .. ``dims[axis]``."""
    clamped = {c: F.least(F.greatest(F.col(c) + 1, F.lit(1)), F.lit(dims[c[0]])) for pair in SIDES for c in pair}
    return df.withColumns(clamped)


def _overlap(sides: Sequence[tuple[str, str]], extra: float) -> tuple[Column, Column, Column]:
    one = lambda p: _product(F.col(f"{p}.{hi}") - F.col(f"{p}.{lo}") + extra for lo, hi in sides)
    both = _product(F.greatest(F.lit(0.0), F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}") + extra) for lo, hi in sides)
    return both, one("a"), one("b")


def _product(columns) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * c
    return out


def in_cells(boxes: DataFrame, size: tuple[float, float], extra: float = 0.0) -> DataFrame:
    """A row for each cell ``_cy, _cx`` of a grid in y and x that a box reaches into; ``extra`` is added to its far sides."""
    at = lambda c, s: F.floor(F.col(c) / F.lit(s))
    reach = lambda lo, hi, s: F.sequence(at(lo, s), F.greatest(at(lo, s), F.floor((F.col(hi) + extra) / F.lit(s))))
    whole = boxes.where(" and ".join(f"{c} is not null" for pair in SIDES[:2] for c in pair))
    return whole.withColumn("_cy", F.explode(reach("y1", "y2", size[0]))).withColumn("_cx", F.explode(reach("x1", "x2", size[1])))


def cell_size(*tables: DataFrame) -> tuple[float, float]:
    """Twice the mean sides in y and x, so that a usual box reaches into four cells at most and a huge one into many."""
    sides = tables[0].select("y1", "y2", "x1", "x2")
    for t in tables[1:]:
        sides = sides.unionByName(t.select("y1", "y2", "x1", "x2"))
    mean = sides.agg(F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("y"), F.avg(F.abs(F.col("x2") - F.col("x1"))).alias("x")).first()
    return max(1.0, 2 * (mean.y or 0.0)), max(1.0, 2 * (mean.x or 0.0))


def box_iou(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, mode: str = "half_open", flat: bool = False, box_id: str = "box_id") -> DataFrame:
    """``(keys, box_a, box_b, iou)`` of the pairs of boxes of one volume that overlap; ``inclusive`` sides add one; ``flat`` leaves z out.

    Boxes meet in the cells of a grid in y and x, and a pair counts in the first cell that both reach into. Boxes with a null side overlap nothing.
    """
    sides = SIDES[:2] if flat else SIDES
    extra = {"half_open": 0.0, "inclusive": 1.0}[mode]
    size = cell_size(a, b)
    columns = [*keys, box_id, *(c for pair in sides for c in pair)]
    a, b = (in_cells(t.select(*columns), size, extra) for t in (a, b))
    both, va, vb = _overlap(sides, extra)
    meet = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_cy", "_cx")]
    for lo, hi in sides:
        meet += [F.col(f"a.{lo}") < F.col(f"b.{hi}") + extra, F.col(f"b.{lo}") < F.col(f"a.{hi}") + extra]
    for c, lo, s in (("_cy", "y1", size[0]), ("_cx", "x1", size[1])):
        meet.append(F.col(f"a.{c}") == F.floor(F.greatest(f"a.{lo}", f"b.{lo}") / F.lit(s)))
    joined = a.alias("a").join(merged(b.alias("b")), meet).select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{box_id}").alias("box_a"), F.col(f"b.{box_id}").alias("box_b"), both.alias("_i"), va.alias("_a"), vb.alias("_b"))
    return joined.where("_i > 0").withColumn("iou", F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i"))).drop("_i", "_a", "_b")


def mask_iou_by_plane(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """IoU of two masks by z plane, averaged over the planes where either has a voxel."""
    side = lambda df, name: df.select(*keys, *VOXEL).distinct().withColumn(name, F.lit(1))
    p, q = dealt_alike(side(pred, "p"), side(truth, "q"), [*keys, *VOXEL])
    both = p.join(q, [*keys, *VOXEL], "full")
    planes = both.groupBy(*keys, "z").agg((F.count(F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), 1)) / F.count("*")).alias("iou"))
    return planes.groupBy(*keys).agg(F.avg("iou").alias("iou"), F.count("*").alias("planes"))


def label_detections(boxes: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str] = KEYS, thr: float = 0.5, box_id: str = "box_id") -> DataFrame:
    """Adds ``true_label``: 1 if the IoU of the two masks inside the box is above ``thr``; without truth in the box it is 0.

    Boxes are half open, and negative corners count as 0. Boxes are dealt to the cells of a grid, and each voxel meets those of its cell.
    """
    size = cell_size(boxes)
    side = lambda df, name: df.select(*keys, *VOXEL).distinct().withColumn(name, F.lit(1))
    voxels = side(pred, "p").join(merged(side(truth, "q")), [*keys, *VOXEL], "full").withColumnsRenamed({k: f"_{k}" for k in keys})
    voxels = voxels.withColumn("_vy", F.floor(F.col("y") / F.lit(size[0]))).withColumn("_vx", F.floor(F.col("x") / F.lit(size[1])))
    inside = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_cy") == F.col("_vy"), F.col("_cx") == F.col("_vx")]
    for a in VOXEL:
        inside += [F.col(a) >= F.greatest(F.lit(0), F.floor(F.col(f"{a}1"))), F.col(a) < F.greatest(F.lit(0), F.floor(F.col(f"{a}2")))]
    hit = in_cells(boxes, size).join(merged(voxels), inside).groupBy(box_id).agg(F.count(F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), 1)).alias("_i"), F.count("*").alias("_u"), F.count("q").alias("_q"))
    true = F.when((F.col("_q") > 0) & (F.col("_i") / F.col("_u") > thr), 1).otherwise(0)
    return boxes.join(merged(hit), box_id, "left").withColumn("true_label", F.coalesce(true, F.lit(0)).cast("long")).drop("_i", "_u", "_q")


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by group, ties counted half; 1.0 where there is one class only.

    Counts are added up per distinct score first and written to the shared folder by ranges whose bounds are taken from the scores themselves, so that tasks have like numbers of them however they
    are distributed. Running sums go over the scores of a range, then over the ranges: no task meets all scores of a group.
    """
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    placed = in_ranges(counts, [*by, "_s"], "_bin")
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy(*by, *order[1:]).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = placed.groupBy(*by, "_bin").agg(F.sum("n").alias("n"))
    bins = bins.select(*by, "_bin", before("_bin").alias("_before"))
    at = placed.withColumn("_within", before("_s", "_bin")).join(bins, [*by, "_bin"])
    area = at.withColumn("area", F.col("p") * (F.col("_before") + F.col("_within") + F.col("n") / 2.0))
    sums = area.groupBy(*by).agg(F.sum("area").alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n")).cast("double")).otherwise(1.0).alias("auc"))


def dice(df: DataFrame, probabilities: Sequence[str], truth: str, fp_weight: float = 1.0, smooth: float = 1e-6) -> DataFrame:
    """Soft Dice score of the foreground classes (all but the first), over the whole table; ``dice`` is their mean.

    ``fp_weight`` weighs probability where the class isn't true.
    """
    sums = []
    for k, p in enumerate(probabilities[1:], 1):
        own = (F.col(truth) == k).cast("double")
        sums += [F.sum(F.col(p) * own).alias(f"i{k}"), F.sum(F.col(p) * own + F.lit(fp_weight) * F.col(p) * (1 - own)).alias(f"p{k}"), F.sum(own).alias(f"t{k}")]
    one = df.agg(*sums)
    each = [(2 * F.col(f"i{k}") + smooth) / (F.col(f"p{k}") + F.col(f"t{k}") + smooth) for k in range(1, len(probabilities))]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return one.select(*(e.alias(f"dice_{k}") for k, e in enumerate(each, 1)), (total / len(each)).alias("dice"))


def detections_for_tile(detections: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("grp", "volume", "capture", "t", "k")) -> DataFrame:
    """The detections of the given tiles."""
    return detections.join(tiles.select(*keys).distinct(), list(keys), "left_semi")
