"""Linking, components and frame walks that are cut into parts give what plain folds over whole captures give."""

import time

import numpy as np
import pandas as pd
import pytest
from plain_tracking import link

from motility.functions.walks import greedy_chain
from motility.operators import regions, tracks

NODES = "grp long, volume long, capture long, t long, node_id long, y double, x double, z double, dy double, dx double, dz double, vol double, diameter double, surface double"


def plain(pdf):
    columns = ["y", "x", "z", "dy", "dx", "dz", "vol", "diameter", "surface"]
    out = []
    for _, g in pdf.groupby("capture"):
        g = g.sort_values(["t", "node_id"])
        frames = [(t, g[g.t == t][columns].to_numpy(float)) for t in range(int(g.t.min()), int(g.t.max()) + 1)]
        numbers = [n + 1 for found in link(frames, 20.0) for n in found]
        out.append(pd.DataFrame({"capture": g.capture, "t": g.t, "node_id": g.node_id, "track_id": numbers}))
    return {tuple(r) for r in pd.concat(out)[["capture", "track_id", "t", "node_id"]].to_numpy().tolist()}


def moving(seed, n_tracks, n_frames, speed, size, capture=1, pause=()):
    """Cells that walk, vanish for some frames, cross and split off; their boxes and volumes vary."""
    draw = np.random.default_rng(seed)
    place, step = draw.uniform(0, size, (n_tracks, 3)), draw.normal(0, speed, (n_tracks, 3))
    rows = []
    for t in range(n_frames):
        place, step = place + step, step + draw.normal(0, speed / 6, step.shape)
        if t in pause:
            continue
        for k in np.flatnonzero(draw.random(n_tracks) > 0.12):
            y, x, z = (place[k] * (1, 1, 0.2)).tolist()
            dy, dx, dz = draw.uniform(10, 30, 3).tolist()
            vol = float(draw.uniform(100, 500))
            rows.append((1, 1, capture, t, len(rows), y, x, z, dy, dx, dz, vol, vol ** (1 / 3), vol ** (2 / 3)))
    return rows


@pytest.mark.parametrize(
    "rows",
    [moving(1, 12, 25, 3, 300), moving(2, 40, 12, 9, 400) + moving(3, 5, 30, 30, 2000, 2), moving(4, 6, 40, 4, 3000, pause=(9, 10, 20, 30, 31, 32)), moving(5, 30, 8, 2, 60)],
    ids=["near", "fast", "pauses", "crowd"],
)
def test_linking_in_parts_is_linking_as_a_whole(spark, rows):
    df = spark.createDataFrame(rows, NODES)
    got = {tuple(r) for r in tracks.link_detections(df.repartition(3)).select("capture", "track_id", "t", "node_id").collect()}
    assert got == plain(df.toPandas())


def test_batches_may_end_within_a_frame(spark):
    rows = moving(7, 20, 15, 3, 400)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, NODES)
        assert {tuple(r) for r in tracks.link_detections(df).select("capture", "track_id", "t", "node_id").collect()} == plain(df.toPandas())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_over_tiles(spark, connectivity):
    draw = np.random.default_rng(connectivity)
    for share in (0.15, 0.45):
        cells = np.argwhere(draw.random((9, 14, 13)) < share) - [3, 4, 5]
        rows = [(1, 1, *map(int, v)) for v in cells] + [(1, 2, *map(int, v)) for v in cells[::2]]
        df = spark.createDataFrame(rows, "capture long, t long, z long, y long, x long")
        one, many = (regions.label_components(df, connectivity=connectivity, tile=n).toPandas().sort_values(["t", "z", "y", "x"]).to_numpy().tolist() for n in (128, 4))
        assert one == many
        assert regions.voxel_components(np.array(cells), connectivity).tolist() == [r[-1] for r in one if r[1] == 1]


def ball(y, x, r=4):
    return {(a, b, c) for a in range(8 - r, 9 + r) for b in range(y - r, y + r + 1) for c in range(x - r, x + r + 1) if (a - 8) ** 2 + (b - y) ** 2 + (c - x) ** 2 <= r * r}


def merge_of_two(lost=()):
    """Two cells that come together and are one label for four frames; in the frames ``lost`` only the first is left."""
    first, second = [20, 23, 26, 28, 28, 29, 29, 26, 23, 20], [50, 45, 40, 35, 34, 34, 35, 40, 45, 50]
    rows = []
    for t, (a, b) in enumerate(zip(first, second, strict=True)):
        one, two = ball(30, a), ball(30, b)
        if t in lost:
            two = set()
        rows += [(0, t, *v, 1) for v in one] + [(0, t, *v, 1 if 3 <= t <= 6 else 2) for v in two - one]
    return rows, first, second


def walk(spark, rows, **options):
    voxels = spark.createDataFrame(rows, "capture long, t long, z long, y long, x long, label long")
    places = spark.createDataFrame([(0, 1, t, 1) for t in range(10)] + [(0, 2, t, 2) for t in range(3)], "capture long, track_id long, t long, label long")
    spans = spark.createDataFrame([(0, "collision", 2, 2, 1, t) for t in range(3, 7)], "capture long, kind string, t long, track_id long, other long, frame long")
    return tracks.walk_spans(voxels, spans, places, **options).toPandas()


def test_walk_splits_a_merge_of_four_frames(spark):
    rows, first, second = merge_of_two()
    got = walk(spark, rows)
    assert sorted(got["t"].unique()) == [3, 4, 5, 6] and len(got) == sum(3 <= r[1] <= 6 for r in rows)
    for t, g in got.groupby("t"):
        near = np.where(abs(g["x"] - first[t]) <= abs(g["x"] - second[t]), 1, 2)
        assert (near == g["seed"]).mean() > 0.9
        assert g.groupby("seed").size().min() > 80


def test_walk_ends_where_nothing_can_be_split(spark):
    rows, *_ = merge_of_two()
    gone = [r for r in rows if r[1] != 5] + [(0, 5, 8, 30, 29, 1)]  # one voxel is left in frame 5
    assert sorted(walk(spark, gone)["t"].unique()) == [3, 4]


def test_walk_merges_pieces_back(spark):
    rows, *_ = merge_of_two()
    apart = [r for r in rows if not (r[1] == 4 and r[4] in (26, 31))]  # in frame 4 the first cell is in two pieces
    got = walk(spark, apart)
    assert sorted(got["t"].unique()) == [3, 4, 5, 6]
    g = got[got["t"] == 4]
    assert (np.where(g["x"] < 31, 1, 2) == g["seed"]).all()


def test_an_event_without_both_regions_is_left_alone(spark):
    rows, *_ = merge_of_two()
    assert walk(spark, [r for r in rows if not (r[1] == 2 and r[5] == 2)]).empty


def plain_chain(points, start):
    place, left, here = np.zeros(len(points), int), np.ones(len(points), bool), start
    for k in range(len(points)):
        i = int(np.argmin(np.where(left, ((points - here) ** 2).sum(axis=1), np.inf)))
        place[i], left[i], here = k, False, points[i]
    return place


def test_chains_by_a_grid():
    draw = np.random.default_rng(3)
    sets = [draw.integers(0, 9, (300, 3)), draw.normal(size=(500, 3)), draw.normal(size=(200, 3)) * [1, 0, 0], np.zeros((20, 3)), np.vstack([draw.normal(size=(200, 3)), draw.normal(size=(5, 3)) * 1e4]), draw.integers(0, 2, (3, 3)), np.zeros((0, 3))]
    for points in sets:
        points = points[np.lexsort(points.T[::-1])].astype(float)
        for start in ([0, 0, 0], [-500, 3, 9]):
            assert greedy_chain(points, np.array(start, float)).tolist() == plain_chain(points, np.array(start, float)).tolist()


def test_a_long_chain_takes_seconds():
    t = np.linspace(0, 300, 100_000)
    points = np.column_stack([t, 40 * np.sin(t), 40 * np.cos(t)]) + np.random.default_rng(1).normal(0, 0.01, (100_000, 3))
    began = time.perf_counter()
    place = greedy_chain(points, points[0])
    assert sorted(place.tolist()) == list(range(100_000)) and time.perf_counter() - began < 60
