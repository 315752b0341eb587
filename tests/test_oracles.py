"""Every registered query of the library on the smallest tables: against DuckDB, and those beyond SQL against plain search or what must hold for them."""

import collections
import itertools
import math
import os

import duckdb
import numpy as np
import pytest

from motility.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    rows = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert got == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def volumes(spark, name):
    """Voxels by capture and frame, as sets of places."""
    found = collections.defaultdict(dict)
    for r in QUERIES[name](spark, DATA).collect():
        found[r.capture, r.t][r.z, r.y, r.x] = r.asDict()
    return found


def parts(places, steps):
    """Connected parts by search."""
    left, found = set(places), []
    while left:
        queue = [left.pop()]
        part = set(queue)
        while queue:
            z, y, x = queue.pop()
            for a, b, c in steps:
                if (p := (z + a, y + b, x + c)) in left:
                    left.remove(p)
                    part.add(p)
                    queue.append(p)
        found.append(part)
    return found


ALL = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]
FACES = [s for s in ALL if sum(map(abs, s)) == 1]


def test_manifest(spark):
    rows = {r.name: r.length for r in QUERIES["a1_list_files"](spark, DATA).collect()}
    assert rows == {n: os.path.getsize(f"{DATA}/{n}") for n in os.listdir(DATA)}


def test_components_by_search(spark):
    for places in volumes(spark, "c1_label_components").values():
        got = collections.defaultdict(set)
        for p, r in places.items():
            got[r["component"]].add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts(places, ALL)))


def test_holes_by_search(spark):
    for key, filled in volumes(spark, "c4_fill_holes").items():
        outside = set(itertools.product(*(range(min(p[i] for p in filled), max(p[i] for p in filled) + 1) for i in range(3)))) - set(filled)
        edge = lambda p: any(p[i] in (min(q[i] for q in filled), max(q[i] for q in filled)) for i in range(3))
        assert all(any(map(edge, part)) for part in parts(outside, FACES)), key


def test_merged_pieces(spark):
    rows = QUERIES["c14_merge_oversegmented"](spark, DATA).collect()
    assert len(rows) == len({(r.capture, r.t, r.piece) for r in rows}) and all(0 < r.iou <= 1 and r.merged <= r.piece for r in rows)


def test_chains_are_permutations(spark):
    found = collections.defaultdict(list)
    for r in QUERIES["e4_order_points"](spark, DATA).collect():
        found[r.capture, r.t].append((r.pos, (r.z, r.y, r.x)))
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    for line in found.values():
        line = [p for _, p in sorted(line)]
        here = (0, 0, 0)
        for i, p in enumerate(line):
            assert far(here, p) == min(far(here, q) for q in line[i:])
            here = p


def test_ellipses_lie_on_their_points(spark):
    rows = QUERIES["e6_fit_ellipse"](spark, DATA).collect()
    assert rows and all(r.r1 >= r.r2 >= 0 and -math.pi / 2 < r.angle <= math.pi / 2 for r in rows)


@pytest.mark.parametrize("name", ["f2_link_detections", "f11_three_pass"])
def test_a_track_has_one_node_a_frame(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    keys = [c for c in ("grp", "volume", "capture") if c in rows[0].asDict()]
    place = lambda r: tuple(r[k] for k in keys)
    assert len(rows) == len({(*place(r), r.node_id) for r in rows}) == len({(*place(r), r.track_id, r.t) for r in rows})


def test_rows_are_nearest_to_their_own_centre(spark):
    z = {r.row_id: [] for r in QUERIES["i4_kmeans"](spark, DATA).collect()}
    for r in QUERIES["i3_standardize"](spark, DATA).orderBy("row_id", "feature").collect():
        if r.row_id in z:
            z[r.row_id].append(r.value)
    rows = QUERIES["i4_kmeans"](spark, DATA).collect()
    x, c = np.array([z[r.row_id] for r in rows]), np.array([r.cluster for r in rows])
    centres = np.stack([x[c == k].mean(axis=0) for k in range(1, 6)])
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (own.argmin(axis=1) + 1 == c).mean() > 0.99


def test_division_of_all_clusters(spark):
    rows = QUERIES["i15_build_hierarchy"](spark, DATA).collect()
    nodes = collections.defaultdict(dict)
    for r in rows:
        nodes[r.node][r.cluster] = r.side
    assert nodes and all({0, 1} <= set(sides.values()) for sides in nodes.values()) and set(nodes[1].values()) == {0, 1}


def test_sparse_models_are_optimal(spark):
    rows = QUERIES["i16_l1_path"](spark, DATA).orderBy("lambda").collect()
    assert len(rows) == 101 and all(0.5 <= r.auc <= 1 for r in rows)
    assert [r.nonzero for r in rows] == sorted((r.nonzero for r in rows), reverse=True)


def test_sweeps(spark):
    top = QUERIES["i10_sweep_top"](spark, DATA).collect()
    assert len(top) == 3 and [r.davies_bouldin for r in top] == sorted(r.davies_bouldin for r in top)
    rows = QUERIES["w3_choose_behaviors"](spark, DATA).collect()
    assert len({r.k for r in rows}) == 1 and len({r.cluster for r in rows}) == max(2, rows[0].k)
    chosen = QUERIES["i21_forward_selection"](spark, DATA).collect()
    assert chosen and len({r.n for r in chosen}) == 1


def test_the_rest_agrees_with_its_parts(spark):
    assert all(0 < r.solidity <= 1 + 1e-9 for r in QUERIES["c8_solidity"](spark, DATA).collect())
    assert all(r.axis1 >= r.axis2 >= r.axis3 > 0 for r in QUERIES["c6_region_props"](spark, DATA).collect())
    assert all(abs(r.elevation) <= 180 for r in QUERIES["e11_regions_against_flow"](spark, DATA).collect())


def test_every_query_has_sql_or_a_test():
    own = {"a1_list_files", "c14_merge_oversegmented", "e6_fit_ellipse", "f2_link_detections", "f11_three_pass", "i4_kmeans", "i10_sweep_top", "i15_build_hierarchy", "i16_l1_path", "i21_forward_selection", "w3_choose_behaviors", "c8_solidity", "c6_region_props", "e11_regions_against_flow"}
    assert set(QUERIES) - set(SQL) == own
