"""Plans that stay whole on larger tables: volumes are made by as many tasks as their number asks for, rows that grow are never broadcast, and rows that only larger tables have."""

import math
import re
import time
import tracemalloc

import numpy as np
import pytest

from motility.functions.grouped import merged_pieces, voxel_hull_volume
from motility.functions.tracking import FORBIDDEN, Linker, assign, assign_near, hungarian
from motility.operators import dynamics, geometry, regions, tracks
from motility.plans import QUERIES, fixtures

DATA = "/root/testdata/sf0.001"


def test_volumes_are_made_by_more_tasks_as_parts_grow(spark, tmp_path):
    for copies in (1, 4):
        parts = spark.range(20_000 * copies).selectExpr("id AS p_partkey", "CAST(1 + id * 7 % 50 AS INT) AS p_size").coalesce(1)
        parts.write.parquet(f"{tmp_path}/{copies}/part.parquet")
        made = fixtures.view(spark, f"{tmp_path}/{copies}", "voxels")
        assert len(re.findall("Exchange", made._jdf.queryExecution().executedPlan().toString())) == 1  # what goes by volume is where it should be
        assert made.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 2 * copies)
    assert made.groupBy("capture", "t").count().count() == 80


def test_voxels_are_those_of_the_view_in_sql(spark):
    text = spark.sql(fixtures._spark(fixtures.VIEWS["voxels"]).replace("FROM part", "FROM {part}"), part=fixtures.table(spark, DATA, "part"))
    made = fixtures.view(spark, DATA, "voxels")
    assert made.schema.simpleString() == text.schema.simpleString() and made.count() == text.count()
    assert made.exceptAll(text.select(made.columns)).isEmpty()


GROWING = ["c2_drop_small", "c4_fill_holes", "c8_surface_area", "c10_compact_labels", "c12_partition_by_seed", "c13_label_overlaps", "d4_mask_iou_by_plane", "d5_label_detections", "e1_nearest_point", "e6_fit_ellipse",
           "e7_ellipse_polar", "e9_extent_along_ray", "e10_oriented_width", "b8_paint_boxes", "b12_boundary_shell", "f1_match_nodes", "g2_hann_pairs"]


@pytest.mark.parametrize("name", GROWING)
def test_what_grows_is_never_broadcast(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Broadcast\w*Join", plan)


@pytest.mark.parametrize("name, by_bytes", [("c2_drop_small", 0), ("b12_boundary_shell", 0), ("c12_partition_by_seed", 0), ("d4_mask_iou_by_plane", 2), ("e10_oriented_width", 1), ("b10_temporal_majority", 2)])
def test_voxels_are_dealt_by_number_and_never_by_bytes(spark, name, by_bytes):
    """Only rows of planes, regions and captures may go through shuffles whose tasks Spark joins up to a size in bytes: a task would sort ten million voxels."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ENSURE_REQUIREMENTS", plan)) <= by_bytes


def test_tracks_that_return_or_rest_have_the_ratios_of_sql(spark):
    rows = [(1, t, t, 1.0, float(y), 2.0) for t, y in enumerate((0, 3, 0))] + [(2, t, 9 + t, 1.0, 1.0, 1.0) for t in range(2)] + [(3, 0, 20, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "track_id long, t long, node_id long, z double, y double, x double").selectExpr("*", "1L AS grp", "1L AS volume", "1L AS capture")
    told = lambda v: None if v is None else "nan" if math.isnan(v) else v
    network = {r.track_id: [told(v) for v in (r.path, r.meander, r.tortuosity, r.angle)] for r in tracks.distance_network(df).collect()}
    assert network == {1: [6.0, 0.0, math.inf, "nan"], 2: [0.0, "nan", "nan", "nan"], 3: [0.0, "nan", "nan", "nan"]}
    scale = spark.createDataFrame([(1, 1, 1, 0.5, 2.0)], "grp long, volume long, capture long, dz double, dt double")
    moved = {r.track_id: [told(v) for v in (r.path_over_ends, r.ends_over_path)] for r in dynamics.track_kinematics(df, scale).collect()}
    assert moved == {1: [math.inf, 0.0], 2: ["nan", "nan"], 3: ["nan", "nan"]}


def test_many_pieces_are_merged_in_seconds():
    """A volume of 4000 pieces: each reference is cut into four, which its neighbour meets as well."""
    counts = {(4 * r + k, s): 10 - 9 * (s != r) for r in range(1000) for k in range(4) for s in (r, (r + 1) % 1000)}
    began = time.perf_counter()
    group = merged_pieces(counts, dict.fromkeys(range(4000), 11), dict.fromkeys(range(1000), 44))
    assert group == {p: p // 4 * 4 for p in range(4000)} and time.perf_counter() - began < 5


def test_hulls_take_ends_of_rows_and_not_groups_of_voxels(spark):
    ball = [(z, y, x) for z in range(-3, 4) for y in range(-3, 4) for x in range(-3, 4) if z * z + y * y + x * x <= 9]
    rows = [(1, 1, n, z + 5 * n, y - n, x + 7) for n in range(3) for z, y, x in ball] + [(1, 1, 9, 0, 0, 0)]
    out = regions.solidity(spark.createDataFrame(rows, "capture long, t long, label long, z long, y long, x long"))
    assert "GroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    hull = voxel_hull_volume(np.array(ball))
    assert {r.label: (r.volume, r.hull, r.solidity) for r in out.collect()} == {n: (len(ball), hull, len(ball) / hull) for n in range(3)} | {9: (1, 1.0, 1.0)}


def test_a_short_line_is_searched_at_once_however_far_the_points(spark):
    """A grid that grows from ring to ring took some twenty steps, three jobs each; groups of one volume that are dealt to shares have the nearest point of plain search."""
    line = [(c, t, p, 0.0, float(p % 7), float(p)) for c in (1, 2) for t in (1, 2) for p in range(40)]
    rows = [(c, t, n, float(z), float(n % 45) / 2, float(n * 5 % 80) / 2) for c in (1, 2, 3) for t in (1, 2) for n in range(60) for z in (n % 3 * 1000000,)]
    ordered = spark.createDataFrame(line, "capture long, t long, pos long, z double, y double, x double")
    points = spark.createDataFrame(rows + rows[:5], "capture long, t long, label long, z double, y double, x double")
    spark.sparkContext.setJobGroup("short line", "")
    out = geometry.local_direction(points, ordered).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("short line")) < 40
    at = {(c, t, p): (z, y, x) for c, t, p, z, y, x in line}
    plain = {}
    for c, t, n, *place in rows:
        if c < 3:
            pos = min(range(40), key=lambda p: (sum((a - b) ** 2 for a, b in zip(place, at[c, t, p])), p))  # noqa: B023
            (_, ay, ax), (_, by, bx) = at[c, t, max(0, pos - 5)], at[c, t, min(39, pos + 5)]
            plain[c, t, n] = (pos, math.atan2(by - ay, bx - ax))
    assert len(out) == len(plain) and {(r.capture, r.t, r.label): (r.pos, r.flow) for r in out} == plain


def test_few_targets_are_dealt_with_shares_of_a_volume(spark, monkeypatch):
    """Volumes of few and of many targets in one call, whose points are dealt to several shares, beside the rings."""
    p = spark.createDataFrame([(c, 1, n, float(n % 3), float(n * 7 % 50), float(n * 11 % 60)) for c in (1, 2) for n in range(90)], "capture long, t long, label long, z double, y double, x double")
    q = spark.createDataFrame([(c, 1, float(n % 2), float(n * 3 % 50), float(n * 13 % 60)) for c, m in ((1, 9), (2, 30)) for n in range(m)], "capture long, t long, z double, y double, x double")
    whole = sorted(map(tuple, geometry.nearest_point(p, q, cell=10.0).collect()))
    monkeypatch.setattr(geometry, "FEW", 10)
    monkeypatch.setattr(geometry, "SHARE", 20)
    monkeypatch.setattr(geometry, "SPAN", 8)
    assert sorted(map(tuple, geometry.nearest_point(p, q).collect())) == whole and len(whole) == 180


def test_dense_frames_make_no_pairs_of_detections(spark, monkeypatch):
    """Edges between parts follow the cells of a grid, not the pairs of detections within reach: 400 to a frame made some hundred thousand."""
    rows = [(1, t, 400 * t + n, float(n % 20), float(n // 20), 1.0, 2.0, 2.0, 2.0, 5.0) for t in range(3) for n in range(400)]
    df = spark.createDataFrame(rows, "capture long, t long, node_id long, y double, x double, z double, dy double, dx double, dz double, vol double")
    seen, plain = [], tracks.connected
    monkeypatch.setattr(tracks, "connected", lambda edges, *rest: (seen.append(edges.count()), plain(edges, *rest))[1])
    out = tracks.link_detections(df, ["capture"], properties=["vol"]).collect()
    assert len(out) == 1200 and len({r.track_id for r in out}) == 400 and seen[0] < 1000


def test_dense_frames_are_assigned_in_seconds():
    """A thousand tracks and detections that compete took minutes; small ones have the total of the plain form, ties and forbidden pairs included."""
    draw = np.random.default_rng(3)
    for k in range(60):
        n, m = (int(x) for x in draw.integers(1, 9, 2))
        cost = np.round(draw.uniform(0, 60, (n, m)), -1 if k % 2 else 6)
        cost[draw.random((n, m)) < 0.3] = FORBIDDEN
        full = np.full((n + m, n + m), FORBIDDEN)
        full[:n, :m] = cost
        full[np.arange(n), m + np.arange(n)] = full[n + np.arange(m), np.arange(m)] = 20.0
        full[n:, m:] = 0
        pairs = assign(cost, 20.0)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(cost[p] < FORBIDDEN for p in pairs)
        assert sum(cost[p] for p in pairs) + 20.0 * (n + m - 2 * len(pairs)) == pytest.approx(full[np.arange(n + m), hungarian(full)].sum())
    a, b = (draw.uniform(0, 100, (1000, 2)) for _ in range(2))
    cost = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    cost[cost >= 40] = FORBIDDEN
    began = time.perf_counter()
    pairs = assign(cost, 20.0)
    assert len(pairs) > 700 and time.perf_counter() - began < 5


def test_points_meet_targets_in_tasks_dealt_by_number(spark, monkeypatch):
    """Joined up to a size in bytes, a few tasks took all cells, and each sorted the pairs that its points made."""
    plans, stored = [], geometry.stored
    monkeypatch.setattr(geometry, "stored", lambda df, label: (label == "nearest" and plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    for name in ("e1_nearest_point", "e8_nearest_normal"):
        plans.clear()
        QUERIES[name](spark, DATA)
        assert plans and all(len(re.findall("_gz.*REPARTITION_BY_NUM", p)) == 2 and not re.findall("_gz.*ENSURE_REQUIREMENTS", p) for p in plans)


def test_distances_are_dealt_by_number_and_only_the_nearest_go_on(spark):
    plan = QUERIES["e2_min_distance"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"ENSURE_REQUIREMENTS|Broadcast\w*Join", plan)
    draw = np.random.default_rng(8)
    rows = [(1, 1, *map(int, draw.integers(0, 30, 3)), None if n % 9 == 0 else n % 5) for n in range(400)]
    voxels = spark.createDataFrame([*rows, *rows[:20]], "capture long, t long, z long, y long, x long, label long")
    surface = spark.createDataFrame([(1, 1, 3, 4, 5), (1, 1, 20, 25, 2)], "capture long, t long, z long, y long, x long")
    whole = [tuple(r) for r in geometry.distance_field(voxels, surface, unique=True).collect()]
    least = {}
    for *_, y, _, label, d2 in whole:
        least[y // 8, label] = min(d2, least.get((y // 8, label), d2))
    got = geometry.distance_field(voxels, surface, unique=True, nearest_of="label").collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted((r for r in whole if r[-1] == least[r[3] // 8, r[5]]), key=key) and len(got) < len(whole) / 4


def test_orientations_against_the_vessel_are_never_broadcast(spark):
    assert not re.findall(r"Broadcast\w*Join", QUERIES["e11_regions_against_flow"](spark, DATA)._jdf.queryExecution().executedPlan().toString())


def test_volumes_at_a_bound_do_not_stand_out_however_they_are_added(spark):
    """Hundredths of which one is a fifth of, or five times, the mean of its track: the rounding of the sum flagged about a third of them, other ones in every order."""
    draw, rows, track = np.random.default_rng(5), [], 0
    while track < 60:
        rest = draw.integers(100, 30_000, int(draw.integers(20, 90)))
        n, five = len(rest) + 1, track % 2
        rest[0] += -int(rest.sum()) % ((n - 5) if five else (5 * n - 1))
        own = 5 * int(rest.sum()) // (n - 5) if five else int(rest.sum()) // (5 * n - 1)
        values = [*rest.tolist(), own]
        for order in range(4):  # the same track, added in several orders
            for t, k in enumerate(draw.permutation(n).tolist()):
                rows.append((4 * track + order, t, int(k == n - 1), values[k] / 100 * 8, 5.0, 5.0))
        track += 1
    df = spark.createDataFrame(rows, "track_id long, t long, node_id long, vol double, dx double, dy double").selectExpr("*", "1L AS grp", "1L AS volume", "1L AS capture")
    at = tracks.track_outliers(df).where("node_id = 1").collect()
    assert len(at) == 240 and all(r.outlier is None for r in at)
    far = tracks.track_outliers(df.selectExpr("* EXCEPT (vol)", "vol * IF(node_id = 1, IF(track_id div 4 % 2 = 1, 1.001, 0.999), 1) AS vol")).where("node_id = 1").collect()
    assert all(r.outlier for r in far)


def test_rows_list_only_what_is_near_and_are_assigned_as_by_the_whole_table():
    """A row that lists few of its pairs asks for more where the search comes to its bound; ties and rows alone included."""
    draw = np.random.default_rng(9)
    for k in range(400):
        n, m = (int(x) for x in draw.integers(1, 12, 2))
        cost = np.round(draw.uniform(0, 60, (n, m)), -1 if k % 2 else 6)
        cost[draw.random((n, m)) < 0.3] = FORBIDDEN
        full = [sorted(((j, float(c)) for j, c in enumerate(row) if c < 40), key=lambda p: p[1]) for row in cost]
        have = draw.integers(0, 3, n).tolist()

        def listed(i, more=0, have=have, full=full):
            have[i] += more
            return full[i][: have[i]], full[i][have[i]][1] if have[i] < len(full[i]) else math.inf

        edges, bound = (list(x) for x in zip(*(listed(i) for i in range(n)), strict=True))
        pairs = assign_near(edges, bound, m, 20.0, lambda i, listed=listed: listed(i, 1))
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        total = lambda found, cost=cost, sides=n + m: sum(cost[p] for p in found) + 20.0 * (sides - 2 * len(found))
        assert total(pairs) == pytest.approx(total(assign(cost, 20.0)))


def crowd(seed, n):
    """Places on a grid, so sums of squared distances tie."""
    draw = np.random.default_rng(seed)
    return np.column_stack([draw.integers(0, 256, (n, 2)), draw.integers(0, 16, n), 4 * draw.integers(4, 12, (n, 2)), np.full(n, 4), np.full((n, 3), 50)]).astype(float)


def test_a_dense_frame_takes_memory_by_its_detections_and_not_by_their_pairs():
    """A table of all pairs of 1500 tracks and detections took some 90 MB, and of the 22 500 of 6 GB some 4 GB."""
    linker = Linker(20.0, 9)
    linker.feed(0, np.arange(1500), crowd(1, 1500))
    tracemalloc.start()
    birth, _ = linker.feed(1, np.arange(1500, 3000), crowd(2, 1500))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (birth[:, 0] == 0).sum() > 1400 and most < 50e6


def test_equal_costs_are_decided_alike_in_any_order_and_company():
    frames = [crowd(k, 150) for k in range(4)]
    company = [crowd(k + 10, 90) + np.array([9000.0, 0, 0, 0, 0, 0, 0, 0, 0]) for k in range(4)]
    linked = []
    for order in (0, 1):
        linker, draw = Linker(20.0, 9), np.random.default_rng(order)
        for t, (a, b) in enumerate(zip(frames, company, strict=True)):
            ids, rows = (np.arange(240), np.concatenate([a, b])) if order else (np.arange(150), a)
            deal = draw.permutation(len(ids))
            birth, _ = linker.feed(t, ids[deal] + 1000 * t, rows[deal])
        linked.append({i: b for i, b in zip(ids[deal].tolist(), map(tuple, birth.tolist()), strict=True) if i < 150})
    assert linked[0] == linked[1]


def test_dense_volumes_are_searched_without_pairs(spark, monkeypatch):
    """Cells of the given size held every target of a dense frame, so all its pairs were made: the pairs measured follow the points."""
    draw = np.random.default_rng(6)
    dots = [(1, n, *(draw.integers(0, 320, 3) / 10).tolist()) for n in range(3000)] + [(2, n, float(n % 3), 1.0, float(-n)) for n in range(9)] + [(1, 9999, None, 1.0, 1.0)]
    cells = [(1, n, *(draw.integers(-20, 340, 3) / 10).tolist()) for n in range(500)] + [(2, 0, 5000.0, -3.0, 0.0), (2, 1, 0.5, 1.0, -0.5), (3, 0, 1.0, 1.0, 1.0), (1, 777, 1.0, math.nan, 1.0)]
    p = spark.createDataFrame(cells + cells[:5], "capture long, label long, z double, y double, x double")
    q = spark.createDataFrame(dots, "capture long, n long, z double, y double, x double")
    plain = {}
    for c, k, *place in cells[:-2]:
        plain[c, k] = min((sum((a - b) ** 2 for a, b in zip(place, at, strict=True)), n) for e, n, *at in dots if e == c and None not in at)
    got = geometry.nearest_in_blocks(p, q, ["capture"], "label", ["n"], 32.0).collect()
    assert len(got) == len(plain) and {(r.capture, r.label): r.n for r in got} == {k: n for k, (_, n) in plain.items()}
    assert all(r.distance == pytest.approx(math.sqrt(plain[r.capture, r.label][0])) for r in got)
    seen, added = [], np.minimum.reduceat
    monkeypatch.setattr(geometry.np, "minimum", type("Counted", (), {"reduceat": staticmethod(lambda d, at: (seen.append(len(d)), added(d, at))[1]), "__call__": staticmethod(np.minimum)})())
    places = np.array([r[2:] for r in dots[:3000]])
    which, least = geometry._nearest_within(np.array([r[2:] for r in cells[:500]]), places, 8.0)
    assert sum(seen) / 2 < 100 * 500 and (which[least < 64] >= 0).all()


def test_detections_meet_nodes_in_blocks_dealt_by_number(spark, monkeypatch):
    plans, stored = [], geometry.stored
    monkeypatch.setattr(geometry, "stored", lambda df, label: (label == "nearest" and plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, label))[1])
    QUERIES["f1_match_nodes"](spark, DATA)
    assert plans and all("SortMergeJoin [grp#" not in p.split("CoGroups")[0] and "CoGroupsInArrow" in p and len(re.findall("_gz.*REPARTITION_BY_NUM", p)) == 2 for p in plans)


def test_faces_are_counted_in_one_aggregate_without_a_join(spark):
    """Every pass of f11 sorted seven rows a voxel for a join. Repeated voxels count each, and those without a place or label touch nothing."""
    rows = [(1, 5, 0, 0, 0), (1, 5, 0, 0, 1), (1, 5, 0, 0, 1), (1, 6, 0, 0, 2), (1, 7, None, 0, 0), (1, None, 3, 3, 3), (1, None, 3, 3, 4)]
    out = regions.surface_area(spark.createDataFrame(rows, "capture long, label long, z long, y long, x long"), ["capture"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.label: r.surface for r in out.collect()} == {5: 15, 6: 6, 7: 6, None: 12}
    assert "Join" not in QUERIES["c8_surface_area"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_short_lists_of_a_frame_of_regions_are_made_together(monkeypatch):
    """A thousand tracks in small boxes asked for more one by one, some 660 times a frame."""
    draw, asked, plain = np.random.default_rng(0), [], Linker._measured
    monkeypatch.setattr(Linker, "_measured", lambda self, tracks, *rest: (asked.append(len(tracks)), plain(self, tracks, *rest))[1])
    linker = Linker(20.0, 9)
    for k in range(3):
        p = np.arange(1000) * 20 + 4 * k
        size = 1 + 2.0 * draw.integers(1, 4, 1000)
        places = np.column_stack([p * 37 % 61, p * 53 % 67, p * 7 % 13]) + draw.uniform(-0.5, 0.5, (1000, 3))
        asked.clear()
        birth, _ = linker.feed(k, p, np.column_stack([places, size, size, size, draw.uniform(3, 120, 1000), draw.uniform(2, 7, 1000), draw.uniform(5, 100, 1000)]))
    assert (birth[:, 0] < 2).sum() > 900 and len(asked) < 450
