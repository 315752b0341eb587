"""Closed-form cases and brute-force checks of the operators without SQL."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motility.functions.grouped import hull_volume, voxel_components, voxel_hull_volume
from motility.functions.tracking import FORBIDDEN, assign, hungarian
from motility.operators import behaviors, detections, dynamics, explain, geometry, regions, selection, tracks, voxels
from motility.sources.captures import list_files
from motility.sources.tables import in_ranges

V = "capture long, t long, z long, y long, x long"


def cube(a, b, c, at=(0, 0, 0)):
    return [(0, 0, at[0] + i, at[1] + j, at[2] + k) for i in range(a) for j in range(b) for k in range(c)]


def brute_components(points, most):
    left, out, n = set(map(tuple, points)), {}, 0
    for p in sorted(left):
        if p in out:
            continue
        n += 1
        stack = [p]
        while stack:
            q = stack.pop()
            if q in out:
                continue
            out[q] = n
            stack += [r for d in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= most and (r := tuple(np.add(q, d))) in left]
    return out


@pytest.mark.parametrize(("connectivity", "most"), [(6, 1), (18, 2), (26, 3)])
def test_components_against_search(connectivity, most):
    rng = np.random.default_rng(connectivity)
    points = np.unique(rng.integers(0, 7, (90, 3)), axis=0)
    rng.shuffle(points)
    want = brute_components(points.tolist(), most)
    assert [want[tuple(p)] for p in points.tolist()] == voxel_components(points, connectivity).tolist()


def test_components_meet_at_a_corner(spark):
    df = spark.createDataFrame(cube(3, 3, 3) + cube(3, 3, 3, (3, 3, 3)), V)
    count = lambda n: regions.label_components(df, connectivity=n).select("component").distinct().count()
    assert (count(26), count(6)) == (1, 2)


def test_hollow_cube_is_filled(spark):
    shell = [v for v in cube(5, 5, 5) if min(v[2:]) == 0 or max(v[2:]) == 4]
    assert regions.fill_holes(spark.createDataFrame(shell, V)).count() == 125


def test_box_of_voxels(spark):
    df = spark.createDataFrame([(*v, 1) for v in cube(2, 3, 4)], V + ", label long")
    m = regions.region_props(df).first()
    assert (m.volume, m.extent) == (24, 1.0)
    assert [round(m[f"axis{k}"], 6) for k in (1, 2, 3)] == [round(2 * math.sqrt(5 * n * n / 12), 6) for n in (4, 3, 2)]
    assert regions.surface_area(df).first().surface == 52
    assert regions.solidity(df).first().solidity == 1.0


def test_hull_volumes():
    assert voxel_hull_volume(np.array([[0, 0, 0], [1, 1, 1]])) == 4.0  # a cube swept along its diagonal
    assert hull_volume(np.array(list(itertools.product((0, 5), (0, 7), (0, 2))))) == 70
    assert hull_volume(np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6], [1, 1, 1]])) == 36
    assert hull_volume(np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [5, 0, 0]])) == 0


@pytest.mark.parametrize(("nz", "n_tiles"), [(10, 7), (16, 1), (20, 5)])
def test_tiles_by_number_of_planes(spark, nz, n_tiles):
    planes = spark.createDataFrame([(0, 0, z, float(z)) for z in range(nz)], "capture long, t long, z long, value double")
    rows = voxels.z_tiles(planes).collect()
    assert len({r.k for r in rows}) == n_tiles and len(rows) == 16 * n_tiles
    assert all(r.z is None or r.value == r.z for r in rows)


def test_first_of_equal_classes_wins(spark):
    row = voxels.softmax_argmax(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"]).first()
    assert row["class"] == 0 and row.prob == [0.5, 0.5]


@pytest.mark.parametrize(("mode", "iou"), [("half_open", 1 / 15), ("inclusive", 8 / 46)])
def test_box_iou(spark, mode, iou):
    schema = "capture long, t long, box_id long, y1 double, x1 double, z1 double, y2 double, x2 double, z2 double"
    one = lambda i, a, b: spark.createDataFrame([(0, 0, i, a, a, a, b, b, b)], schema)
    assert detections.box_iou(one(1, 0.0, 2.0), one(2, 1.0, 3.0), mode=mode).first().iou == pytest.approx(iou)


def test_auc(spark):
    auc = lambda rows: detections.roc_auc(spark.createDataFrame(rows, "score double, label long")).first().auc
    assert auc([(0.1, 0), (0.2, 0), (0.8, 1)]) == 1.0
    assert auc([(0.1, 1), (0.8, 0)]) == 0.0
    assert auc([(0.1, 1), (0.8, 1)]) == 1.0
    assert auc([(0.5, 1), (0.5, 0)]) == 0.5


def test_auc_of_any_distribution(spark):
    """Skewed scores with ties, by group, against all pairs; their ranges hold like numbers of scores."""
    rng = np.random.default_rng(12)
    score, label, kind = np.round(rng.lognormal(0, 3, 3000), 2), rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(s), int(y), int(k)) for s, y, k in zip(score, label, kind, strict=True)], "score double, label long, kind long")
    for r in detections.roc_auc(df, by=["kind"]).collect():
        p, n = score[(kind == r.kind) & (label == 1)], score[(kind == r.kind) & (label == 0)]
        assert r.auc == pytest.approx(((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2), abs=1e-12)
    sizes = [r["count"] for r in in_ranges(df.select("score").distinct(), ["score"], "bin").groupBy("bin").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * sum(sizes) / 4
    assert detections.roc_auc(df.limit(0)).first().auc == 1.0 and detections.roc_auc(df.limit(0), by=["kind"]).count() == 0


def test_straight_track(spark):
    df = spark.createDataFrame([(1, 1, 1, 7, t, t, 0.0, 0.0, float(t)) for t in range(5)], "grp long, volume long, capture long, track_id long, t long, node_id long, z double, y double, x double")
    m = tracks.distance_network(df).first()
    assert (m.path, m.meander, m.tortuosity, m.angle) == (4.0, 1.0, 1.0, 0.0)


def test_weights_sum_to_one_and_constants_stay(spark):
    df = spark.createDataFrame([(1, 1, 1, 7, t, t, 3.0) for t in range(200)], "grp long, volume long, capture long, track_id long, t long, node_id long, f double")
    sums = dynamics.hann_pairs(df).groupBy("focal").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    assert all(r.w == pytest.approx(1) for r in sums) and max(r.n for r in sums) == 167
    stats = dynamics.weighted_stats(df, ["f"]).collect()
    assert all(r.f_mean == pytest.approx(3) and r.f_std < 1e-6 for r in stats)


def test_assignment_against_permutations():
    rng = np.random.default_rng(4)
    for _ in range(20):
        cost = rng.random((5, 5))
        best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        assert cost[np.arange(5), hungarian(cost)].sum() == pytest.approx(best)
    assert assign(np.array([[FORBIDDEN, 3.0], [FORBIDDEN, 2.0]]), 20) in ([(1, 1)], [(0, 1)])
    assert assign(np.array([[50.0]]), 20) == []


def test_moving_balls_are_linked(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for k in range(6):
        start, speed = rng.uniform(0, 300, 3) + k * 400, rng.uniform(-3, 3, 3)
        for t in range(30):
            if t % 11 == 5 and k % 2:
                continue  # a missed frame
            y, x, z = (start + speed * t + rng.normal(0, 0.2, 3)).tolist()
            rows.append((1, 1, 1, t, n, y, x, z, 20.0, 20.0, 20.0, 500.0, 10.0, 300.0, k))
            n += 1
    df = spark.createDataFrame(rows, "grp long, volume long, capture long, t long, node_id long, y double, x double, z double, dy double, dx double, dz double, vol double, diameter double, surface double, truth long")
    found = tracks.link_detections(df).join(df.select("node_id", "truth"), "node_id")
    assert found.select("truth", "track_id").distinct().count() == 6


def test_merged_cell_is_split_and_tracked(spark):
    ball = lambda z, y, x, r: [(z + a, y + b, x + c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= r * r]
    rows = []
    for t in range(12):
        one, two = ball(8, 30, 20 + t, 4), ball(8, 30, 60 - t, 4)
        rows += [(0, t, *v, 1) for v in set(one)] + [(0, t, *v, 2) for v in set(two) - set(one)]
    final, measures = tracks.three_pass(spark.createDataFrame(rows, V + ", label long"))
    assert measures.count() == 2 and final.count() == 24


def ball(z, y, x, r):
    return {(z + a, y + b, x + c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= r * r}


def test_a_cell_that_fell_apart_is_joined(spark):
    rows = []
    for t in range(15):
        for k in (1, 2):
            rows += [(0, t, *p, k + 10 * (t == 7 and k == 1 and p[2] > 20 + t)) for p in ball(8, 20 * k, 20 + t, 4)]
    final, measures = tracks.three_pass(spark.createDataFrame(rows, V + ", label long"))
    got = final.collect()
    assert len(got) == 30 and {r.vol for r in got} == {float(len(ball(0, 0, 0, 4)))} and measures.count() == 2


def test_a_region_of_two_cells_is_cut_after_the_nearest_valid_frame(spark):
    rows, nodes, found = [], [], []
    for t in range(13):
        one, two = ball(8, 20, 20, 4), ball(8, 20, 29, 4)
        regions = {1: one | two} if t == 6 else {1: one, 2: two}
        for k, places in regions.items():
            rows += [(0, t, *p, k) for p in places]
            lo, hi = [min(p[i] for p in places) for i in range(3)], [max(p[i] for p in places) for i in range(3)]
            n = 2 * t + k
            nodes.append((0, t, k, n, *(sum(p[i] for p in places) / len(places) for i in range(3)), *map(float, lo), *(float(h - c + 1) for c, h in zip(lo, hi, strict=True)), float(len(places))))
            found.append((0, k, t, n))
    voxels = spark.createDataFrame(rows, V + ", label long")
    named = spark.createDataFrame(nodes, "capture long, t long, label long, node_id long, z double, y double, x double, z_lo double, y_lo double, x_lo double, dz double, dy double, dx double, vol double")
    out = tracks.resegmented(voxels, named, spark.createDataFrame(found, "capture long, track_id long, t long, node_id long"))
    sizes = out.groupBy("t", "label").count().collect()
    assert len(sizes) == 26 and out.count() == voxels.count()
    small = tracks.resegmented(voxels, named, spark.createDataFrame(found, "capture long, track_id long, t long, node_id long"), min_voxels=1000)
    assert small.where("t = 6").count() == 0


def test_pieces_of_one_reference_are_merged(spark):
    rng = np.random.default_rng(5)
    pieces, reference = [], []
    for k in range(4):
        for p in ball(8, 20, 20 * k, 4):
            reference.append((0, 0, *p, k))
            pieces.append((0, 0, *p, 10 * k + int(rng.integers(0, 3))))
    got = regions.merge_oversegmented(regions.label_overlaps(*(spark.createDataFrame(r, V + ", label long") for r in (pieces, reference)))).collect()
    assert all(r.reference == r.piece // 10 and r.merged == 10 * r.reference and r.iou == 1.0 for r in got) and len(got) == 12


def test_boxes_of_all_sizes_meet_once(spark):
    rng = np.random.default_rng(7)

    def make(n):
        lo, side = rng.uniform(-50, 200, (n, 3)), np.where(rng.random((n, 1)) < 0.05, rng.uniform(0, 400, (n, 3)), rng.uniform(0, 12, (n, 3)))
        return [(0, 0, i, *(float(v) for a in range(3) for v in (lo[i, a], lo[i, a] + side[i, a]))) for i in range(n)]

    a, b = make(120), make(150)
    schema = "capture long, t long, box_id long, y1 double, y2 double, x1 double, x2 double, z1 double, z2 double"
    for mode, extra in (("half_open", 0.0), ("inclusive", 1.0)):
        want = {}
        for p, q in itertools.product(a, b):
            sides = [min(p[i + 1], q[i + 1]) - max(p[i], q[i]) + extra for i in (3, 5, 7)]
            if min(sides) > 0:
                size = lambda r: math.prod(r[i + 1] - r[i] + extra for i in (3, 5, 7))
                want[p[2], q[2]] = math.prod(sides) / (size(p) + size(q) - math.prod(sides))
        got = detections.box_iou(spark.createDataFrame([*a, (0, 0, 999, None, 1.0, 0.0, 1.0, 0.0, 1.0)], schema), spark.createDataFrame(b, schema), mode=mode).collect()
        assert len(got) == len(want) and all(r.iou == pytest.approx(want[r.box_a, r.box_b]) for r in got)
    assert detections.box_iou(spark.createDataFrame([], schema), spark.createDataFrame(b, schema)).count() == 0


def test_sparse_path_is_optimal(spark):
    """The optimality conditions of the L1 model at each lambda, by its gradient."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] - x[:, 3] + 0.5 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(int(t), [float(v) for v in r]) for t, r in zip(y, x, strict=True)], "side long, features array<double>")
    path, weights = explain.l1_path(rows, [0.01, 0.05, 0.2], max_iter=200)
    assert [r.nonzero for r in path.orderBy("lambda").collect()] == sorted((r.nonzero for r in path.collect()), reverse=True)
    for lam in (0.01, 0.05, 0.2):
        w = np.array([r.weight for r in weights.where(F.col("lambda") == lam).orderBy("feature").collect()])
        b = 0.0
        for _ in range(200):  # the intercept, by Newton's method
            p = 1 / (1 + np.exp(-(x @ w + b)))
            b -= (p - y).mean() / (p * (1 - p)).mean()
        grad = x.T @ (p - y) / len(y)
        assert np.all(np.abs(grad[w == 0]) <= lam + 2e-3) and np.allclose(grad[w != 0], -lam * np.sign(w[w != 0]), atol=2e-3)
    assert len(explain.LAMBDAS) == 101 and explain.LAMBDAS[0] == 0.001 and explain.LAMBDAS[-1] == 1


def test_number_of_behaviours_is_found(spark):
    """Two groups that share no behaviour: with three clusters they overlap least."""
    rng = np.random.default_rng(3)
    spots = {1: [0, 8], 2: [100]}
    rows = [(g * 1000 + i, g, [float(v) for v in rng.normal(spots[g][i % len(spots[g])], 0.3, 2)]) for g in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, grp long, features array<double>")
    got, centroids, k = behaviors.choose_behaviors(df, range(2, 5), restarts=2)
    curve = {r.k: r.value for r in behaviors.worst_overlaps(got.select(F.lit(1).alias("k"), "grp", "cluster")).collect()}
    assert got.count() == 120 and centroids.count() == max(2, k) and curve == {1: 0.0}
    best = behaviors.sweep_top(df, [{"k": n, "seed": 1} for n in (2, 3, 4)], 1).first()
    assert best.k in (2, 3)


def test_exact_ellipse(spark):
    a = 0.5
    points = [(1, 10 + 6 * math.cos(u) * math.cos(a) - 3 * math.sin(u) * math.sin(a), 20 + 6 * math.cos(u) * math.sin(a) + 3 * math.sin(u) * math.cos(a)) for u in np.linspace(0, 6, 25)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in points] + [(2, 0.0, 0.0), (2, 1.0, 1.0)], "k long, x double, y double")
    got = {r.k: tuple(r)[1:] for r in geometry.fit_ellipse(df, ["k"]).collect()}
    assert got[1] == pytest.approx((10, 20, 6, 3, a), abs=1e-6)
    assert got[2] == (0, 0, 0, 0, 0)


def test_chain_of_points(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, float(x)) for x in (3, 1, 9, 5)], "capture long, t long, z double, y double, x double")
    assert [r.x for r in geometry.order_points(df).orderBy("pos").collect()] == [1, 3, 5, 9]


def test_grid_search_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    make = lambda n, s: spark.createDataFrame([(0, 0, *map(int, rng.integers(0, s, 3)), i) for i in range(n)], V + ", label long")
    p, q = make(80, 60), make(25, 40)
    a, b = ([tuple(r) for r in d.collect()] for d in (p, q))
    far = lambda u, v: sum((i - j) ** 2 for i, j in zip(u[2:5], v[2:5], strict=True))
    plain = sorted((0, 0, u[5], *u[2:5], *min((far(u, v), v[2:5]) for v in b)[1]) for u in a)
    for cell in (None, 7.0):
        assert sorted(tuple(r)[:9] for r in geometry.nearest_point(p, q, cell=cell).collect()) == plain
    odd = spark.createDataFrame([(0, 0, None, 1.0, 1.0, 1), (0, 0, float("nan"), 1.0, 1.0, 2), (1, 0, 1.0, 1.0, 1.0, 3)], "capture long, t long, z double, y double, x double, label long")
    assert geometry.nearest_point(odd, q).count() == geometry.nearest_point(p, q.limit(0)).count() == 0


def test_distance_field_is_exact(spark):
    """All voxels against all of the surface: sparse, far, outside the box, negative, in one plane, over several volumes, slabs of any size."""
    rng = np.random.default_rng(9)
    cases = {1: ((0, 30), (0, 30), 4), 2: ((-20, 9), (5, 60), 9), 3: ((0, 12), (200, 230), 1), 4: ((3, 4), (3, 4), 1), 5: ((0, 9), (0, 9), 0)}
    voxels, surface = [], []
    for c, (near, far, m) in cases.items():
        voxels += [(c, 0, *map(int, rng.integers(*near, 3)), int(rng.integers(1, 4))) for _ in range(120)]
        surface += [(c, 0, *map(int, rng.integers(*far, 3))) for _ in range(m)]
    voxels.append(voxels[0])
    v, s = spark.createDataFrame(voxels, V + ", label long"), spark.createDataFrame(surface, V)
    far = {(r, i): min((a - b) ** 2 + (p - q) ** 2 + (u - w) ** 2 for c, _, b, q, w in surface if c == r[0]) for i, r in enumerate(voxels) if r[0] != 5 for a, p, u in [r[2:5]]}
    for slab in (1, 8, 50):
        assert sorted(map(tuple, geometry.distance_field(v, s, slab=slab).collect())) == sorted((*r, d) for (r, _), d in far.items())
    plain = {}
    for r, d in {r: d for (r, _), d in far.items()}.items():
        plain.setdefault((*r[:2], r[5]), {}).setdefault(d, []).append(r[2:5])
    want = sorted((*k, min(g) ** 0.5, *(float(np.floor(np.median(m) + 0.5)) if np.median(m) >= 0 else -float(np.floor(0.5 - np.median(m))) for m in zip(*g[min(g)], strict=True))) for k, g in plain.items())
    assert sorted(map(tuple, geometry.min_distance(v, s).collect())) == want
    assert geometry.distance_field(v, s.limit(0)).count() == geometry.distance_field(v.limit(0), s).count() == 0


def test_angle_to_vessel_takes_the_nearest_places(spark):
    """Ends of tracks against all points of the line; ties go to the least place."""
    rng = np.random.default_rng(5)
    line = [(1, 1, 1, p, float(rng.integers(0, 40)), float(2 * p)) for p in range(60)]
    nodes = [(1, 1, 1, k, t, 10 * k + t, float(rng.integers(0, 40)), float(rng.integers(0, 120))) for k in range(25) for t in range(4)]
    key = "grp long, volume long, capture long, "
    got = dynamics.angle_to_vessel(spark.createDataFrame(nodes, key + "track_id long, t long, node_id long, y double, x double"), spark.createDataFrame(line, key + "pos long, y double, x double")).collect()
    assert len(got) == 25
    for r in got:
        mine = sorted((n[7], n[4], n[5], n[6]) for n in nodes if n[3] == r.track_id)
        ends = [(e[3], e[0]) for e in (mine[0], mine[-1])]
        near = [min(((e[0] - p[4]) ** 2 + (e[1] - p[5]) ** 2, p[3], p[4:]) for p in line)[2] for e in ends]
        turn = lambda p, q: np.arccos((q[1] - p[1]) / np.hypot(q[0] - p[0], q[1] - p[1])) if p != q else None
        want = [turn(*ends), turn(*near)]
        assert r.angle is None if None in want else r.angle == pytest.approx(want[0] - want[1], abs=1e-9)


def test_overlap_of_normals(spark):
    df = spark.createDataFrame([(1, 0, 5, 0.0, 1.0), (2, 0, 5, 0.0, 1.0), (3, 0, 5, 100.0, 1.0), (4, 0, 5, 0.0, 0.0)], "cluster long, feature long, n long, mean double, std double")
    got = {(r.ci, r.cj): r.ovl for r in explain.gaussian_overlap(df).collect()}
    assert got[1, 2] == pytest.approx(1, abs=1e-6) and got[1, 3] == pytest.approx(0, abs=1e-6) and got[1, 4] == 1.0 and got[3, 4] == 0.0


def test_overlap_is_the_area_between_the_curves(spark):
    """The closed form against the trapezoid rule on 10 002 points, cut off on the right where it is asked for."""
    rng = np.random.default_rng(6)
    cases = [(*rng.normal(0, 3, 2), *rng.uniform(0.05, 4, 2)) for _ in range(150)] + [(1.0, 1.0, 2.0, 2.0), (1.0, 1.0, 2.0, 3.0), (0.0, 1.0, 2.0, 2.0), (1.0, 0.0, 2.0, 2.0), (0.0, 50.0, 1.0, 1.0), (0.0, 0.1, 1.0, 1.0 + 1e-9), (5.0, 5.0, 0.05, 10.0)]
    df = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cases)], "i long, m1 double, m2 double, s1 double, s2 double")
    for above in (6.0, 3.0):
        got = df.select("i", explain.overlap_area(F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2"), 6.0, above).alias("a"), explain.normal_cdf(F.col("m1")).alias("f")).orderBy("i").collect()
        for r, (m1, m2, s1, s2) in zip(got, cases, strict=True):
            pdf = lambda x, m, s: np.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))
            x = np.linspace(min(m1 - 6 * s1, m2 - 6 * s2), max(m1 + above * s1, m2 + above * s2), 200_002 if min(s1, s2) < 0.1 else 10_002)
            assert r.a == pytest.approx(np.trapezoid(np.minimum(pdf(x, m1, s1), pdf(x, m2, s2)), x), abs=1e-6)
            assert r.f == pytest.approx(math.erfc(-m1 / math.sqrt(2)) / 2, abs=1e-12)


def test_runs_together_are_no_worse_than_one_by_one(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([([float(v) for v in rng.normal(rng.integers(0, 6) * 4, 1.0, 5)],) for _ in range(500)], "features array<double>")
    got = behaviors.kmeans_runs(df, [(k, seed) for k in (2, 3, 6) for seed in range(12)])
    vectors = df.withColumn("v", array_to_vector("features"))
    x = np.array([r.features for r in df.collect()])
    for n, k in enumerate((2, 3, 6)):
        mine = got[n * 12 : (n + 1) * 12]
        for centroids, cost in mine:
            far = ((x[:, None] - centroids) ** 2).sum(axis=2)
            assert cost == pytest.approx(far.min(axis=1).sum(), rel=1e-9)
            assert np.allclose([x[far.argmin(axis=1) == c].mean(axis=0) for c in range(k)], centroids, atol=1e-4)
        theirs = min(KMeans(k=k, seed=s, featuresCol="v", maxIter=50).fit(vectors).summary.trainingCost for s in range(3))
        assert min(cost for _, cost in mine) <= theirs * (1 + 1e-6)
    assert behaviors.kmeans_runs(df.limit(0), [(2, 1)])[0][0].size == 0


def test_the_whole_path_settles(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 12))
    x[:, 5] = x[:, 4] + 0.05 * rng.normal(size=400)
    y = (2 * x[:, 0] - x[:, 4] + 0.3 * rng.normal(size=400) > 0.4).astype(int)
    rows = spark.createDataFrame([(int(t), [float(v) for v in r]) for t, r in zip(y, x, strict=True)] + [(-1, [9.0] * 12)], "side long, features array<double>")
    path, weights = explain.l1_path(rows)
    told = path.orderBy("lambda").collect()
    assert len(told) == 101 and told[0].nonzero > 3 and told[-1].nonzero == 0 and told[0].auc > 0.95 and told[-1].auc == 0.5
    table = {lam: np.zeros(12) for lam in explain.LAMBDAS}
    for r in weights.collect():
        table[r["lambda"]][r.feature] = r.weight
    for lam, w in table.items():
        b = 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            b -= (p - y).mean() / (p * (1 - p)).mean()
        grad = x.T @ (p - y) / len(y)
        assert np.all(np.abs(grad[w == 0]) <= lam + 1e-5) and np.allclose(grad[w != 0], -lam * np.sign(w[w != 0]), atol=1e-5)
    one = explain.l1_path(rows.where("side = 1"), [0.1])[0].first()
    assert (one.auc, one.nonzero) == (1.0, 0)


def test_number_of_clusters(spark):
    pick = lambda values: behaviors.select_k(spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "k long, value double")).first().k
    assert pick([1.0, 0.8, 0.5, 0.7, 0.6, 0.9]) == 3
    assert pick([1.0, 2.0, 3.0]) == 1


def blobs(spark, centres, n=40):
    rng = np.random.default_rng(2)
    rows = [(c * n + i, c + 1, f, float(centre + rng.normal())) for c, centre in enumerate(centres) for i in range(n) for f in range(3)]
    return spark.createDataFrame(rows, "row_id long, cluster long, feature long, value double")


def test_separate_clusters_and_their_hierarchy(spark):
    long = blobs(spark, [0, 100])
    assert behaviors.davies_bouldin(long).first()[0] < 0.1
    four = blobs(spark, [0, 3, 200, 203])
    sides = {(r.node, r.cluster): r.side for r in explain.build_hierarchy(four, [1, 2, 3, 4]).collect()}
    assert sides[1, 1] == sides[1, 2] != sides[1, 3] == sides[1, 4]
    rows, centroids, cost = behaviors.kmeans(behaviors.to_vectors(long, ["row_id"]), 2, replicates=2)
    assert sorted(r.n for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()) == [40, 40] and centroids.count() == 2 and cost > 0


def test_selection_of_features(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, f, float(rng.normal() + (5 * (i % 2) if f == 4 else 0))) for i in range(80) for f in range(6)]
    long = spark.createDataFrame(rows, "row_id long, label long, feature long, value double")
    assert explain.forward_selection(long, list(range(6))) == [4]
    assert explain.forward_selection(long, [1, 2]) == [1, 2]
    folds = explain.kfold(long.select("row_id").distinct(), 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [26, 27, 27]


def test_scattered_labels_and_valid_rows(spark):
    df = spark.createDataFrame([(1, True)], "row_id long, selected boolean")
    rows = selection.scatter_labels(spark.createDataFrame([(1,), (2,)], "row_id long"), df).orderBy("row_id").collect()
    assert [r.selected for r in rows] == [True, False]


def test_manifest_leaves_results_out(spark, tmp_path):
    for name in ("a/x.bin", "a/labels/y.bin", "b_pred/z.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = list_files(spark, str(tmp_path), "*.bin").collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in rows] == [("x.bin", 5)]
