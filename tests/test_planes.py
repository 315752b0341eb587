"""Tiles of whole planes give what voxel rows give, under one shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motility.operators import planes, voxels

VOXELS = "capture long, t long, z long, y long, x long, a double, b double"
STATS = [(0.25, 0.5), (-1.0, 2.0)]


def makers():
    """A maker that travels by value: workers can't import the tests."""

    def make_model():
        return lambda tile: np.stack([tile[:, 0] - tile[:, 1], tile[:, 0] * np.arange(len(tile))[:, None]], axis=1)

    return make_model


def chain(df, shape, depth):
    tiles = planes.tile_planes(planes.stack_planes(df, ["a", "b"], shape), depth=depth)
    merged = planes.predict_planes(planes.standardize_planes(tiles, STATS), makers())
    return planes.classify_planes(planes.mean_planes(merged))


def by_rule(volume, depth):
    """A volume (z, channel, pixel) by tiles, one after another."""
    nz = len(volume)
    total, n = np.zeros((nz, 2, volume.shape[2])), np.zeros(nz, int)
    for k in range(abs(nz - depth) + 1):
        tile = np.zeros((depth, *volume.shape[1:]))
        to, at = (slice(None), slice(k, k + depth)) if nz >= depth else (slice(k, k + nz), slice(None))
        tile[to] = volume[at]
        tile = (tile - np.array([m for m, _ in STATS])[:, None]) / np.array([s for _, s in STATS])[:, None]
        total[at] += makers()()(tile)[to]
        n[at] += 1
    return total, n


@pytest.mark.parametrize("depth", [1, 4, 16])
def test_chain_against_tiles_one_by_one(spark, depth):
    """Volumes that are deeper, as deep and flatter than a tile, with missing pixels, values and planes, and repeated voxels."""
    rng = np.random.default_rng(depth)
    rows, truth = [], {}
    for capture, nz in enumerate([1, 3, 4, 5, 16, 19]):
        volume = np.zeros((nz, 2, 6))
        for z in range(nz):
            if 0 < z < nz - 1 and rng.random() < 0.2:
                continue
            for i in np.flatnonzero(rng.random(6) < 0.7) if z < nz - 1 else range(6):
                a, b = rng.normal(size=2).round(3).tolist()
                absent = rng.random() < 0.1
                volume[z, :, i] = a, 0 if absent else b
                rows.append((capture, 1, z, int(i) // 3, int(i) % 3, a, None if absent else b))
                if rng.random() < 0.2:
                    rows.append((capture, 1, z, int(i) // 3, int(i) % 3, a - 1, 9.0))
        truth[capture] = by_rule(volume, depth)
    got = chain(spark.createDataFrame(rows, VOXELS).repartition(5), (2, 3), depth).collect()
    assert len(got) == sum(len(n) for _, n in truth.values())
    for r in got:
        total, n = truth[r.capture]
        assert r.n_tiles == n[r.z]
        assert np.allclose(np.array(r.logits), total[r.z]) and np.allclose(np.array(r.score), total[r.z] / n[r.z])
        e = np.exp(total[r.z] - total[r.z].max(0))
        assert np.allclose(np.array(r.prob).T, e / e.sum(0)) and r["class"] == np.array(r.logits).argmax(0).tolist()


def summed(df, shape, depth):
    """As ``chain``, where the logits stand in a table: the tile itself."""
    tiles = planes.standardize_planes(planes.tile_planes(planes.stack_planes(df, ["a", "b"], shape), depth=depth), STATS)
    return planes.merge_planes(tiles, "tile")


def itself():
    def make_model():
        return lambda tile: tile

    return make_model


@pytest.mark.parametrize("nz", [2, 4, 7])
def test_sums_of_tables_are_those_of_the_stream(spark, nz):
    rng = np.random.default_rng(nz)
    rows = [(c, t, z, i // 3, i % 3, *rng.integers(-9, 9, 2).tolist()) for c in (None, 1) for t in range(3) for z in range(nz) for i in range(6) if z != 1]
    df = spark.createDataFrame(rows, VOXELS.replace("double", "long"))
    tiles = planes.standardize_planes(planes.tile_planes(planes.stack_planes(df, ["a", "b"], (2, 3)), depth=4), STATS)
    stream = planes.predict_planes(tiles, itself())
    text = lambda rows: sorted(map(str, rows))
    assert text(stream.collect()) == text(summed(df, (2, 3), 4).withColumnRenamed("tile", "logits").collect())


@pytest.mark.parametrize(("steps", "in_python"), [(chain, 1), (summed, 0)])
def test_one_shuffle_from_voxels_to_classes(spark, steps, in_python):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 1.0, 2.0)], VOXELS)
    plan = steps(df, (2, 3), 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == in_python and "EvalPython" not in plan


def test_no_planes_and_voxels_outside(spark):
    none = spark.createDataFrame([], VOXELS)
    assert chain(none, (2, 3), 4).count() == 0
    with pytest.raises(Exception, match="outside of planes"):
        planes.stack_planes(spark.createDataFrame([(0, 0, 0, 2, 0, 1.0, 2.0)], VOXELS), ["a"], (2, 3)).collect()
    assert planes.tile_planes(spark.createDataFrame([(0, 0, None, None)], "capture long, t long, z long, pixels array<array<double>>")).count() == 0


def test_rows_and_planes_are_the_same_voxels(spark):
    rows = [(c, 1, z, y, x, float(c + z), float(y * 3 + x)) for c in range(2) for z in range(3) for y in range(2) for x in range(3)]
    back = planes.voxel_rows(planes.stack_planes(spark.createDataFrame(rows, VOXELS), ["a", "b"], (2, 3)), 3, {"a": F.get("pixels", F.lit(0)), "b": F.get("pixels", F.lit(1))})
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_repeated_planes_and_empty_places(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 0, 1, 3.0), (0, 0, None, 4.0)], "capture long, t long, z long, value double")
    rows = voxels.z_tiles(df, depth=3).collect()
    assert sorted((r.k, r.zt, r.value) for r in rows if r.z is not None) == [(0, 0, 1.0), (0, 1, 2.0), (0, 1, 3.0), (1, 1, 1.0), (1, 2, 2.0), (1, 2, 3.0)]
    assert sorted((r.k, r.zt) for r in rows if r.z is None) == [(0, 2), (1, 0)]
