"""What keeps the portfolio's queries in bounds on larger tables: no exploded side goes through the driver, rows are dealt before they grow, values are computed once."""

import os

import pytest
from pyspark.sql import functions as F

from masonry import plans
from masonry.functions import rings as P
from masonry.operators import faces, graphs, polygons, spatial
from masonry.sources import views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@tables
@pytest.mark.parametrize("name", ["epsilon_vertex_join", "ground_ring_percentile", "point_in_polygon_join", "polygon_overlap_area", "plane_coordinates", "outline_agreement"])
def test_exploded_sides_are_not_broadcast(spark, name):
    plan = _plan(plans.queries()[name](spark, SF))
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


@tables
def test_buildings_are_dealt(spark):
    b = views.buildings(spark, SF)
    assert b.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert b.count() == views.table(spark, SF, "part").count()
    # edges of one building's cells are counted where they are drawn: the only exchange deals the buildings
    for name in ("outline_edges", "edge_manifold_check", "edge_neighbours", "face_planes", "horizontal_clip"):
        assert _plan(plans.queries()[name](spark, SF)).count("Exchange hashpartitioning") == 1


def _square(x, y, side):
    return [{"x": x, "y": y}, {"x": x + side, "y": y}, {"x": x + side, "y": y + side}, {"x": x, "y": y + side}]


def test_values_are_computed_once(spark):
    df = spark.createDataFrame([(1, [_square(0.0, 0.0, 3.0)])], "code int, rings array<array<struct<x: double, y: double>>>")
    grid = polygons.cells(df, "code", 2.0).filter("area > 1e-9")
    assert sorted(map(tuple, grid.collect())) == [(1, 0, 0, 4.0), (1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 1, 1, 1.0)]
    solid = df.select(F.lit(1).alias("solid"), F.lit(0).alias("face"), F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z")))).alias("rings"))
    for frame in (grid, faces.planes(solid).filter("reason is null"), faces.clipped(solid, F.lit(1.0), False)):
        assert not [line for line in _plan(frame, "optimizedPlan").splitlines() if "Filter" in line.split("(")[0] and "lambda" in line]


def test_once_keeps_nulls(spark):
    df = spark.range(2).select("id", F.when(F.col("id") > 0, F.col("id")).alias("v"))
    assert sorted(P.once(df, "w", F.col("v")).collect()) == [(0, None, None), (1, 1, 1)]


def test_points_on_one_place_are_no_pairs(spark, monkeypatch):
    seen, pairs = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda points, tolerance: seen.append(points.count()) or pairs(points, tolerance))
    points = spark.range(3000).select("id", F.when(F.col("id") < 2990, 0.0).when(F.col("id") < 2995, 2.0).when(F.col("id") < 2999, 9.0).alias("x"), F.lit(0.0).alias("y"))
    found = dict(map(tuple, spatial.clusters(points, 3).collect()))
    assert seen == [3]
    assert found == {i: 0 if i < 2995 else 2995 if i < 2999 else 2999 for i in range(3000)}


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_rings_leave_little_on_disk(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    n, size = 2000, 50
    k, ring = F.col("id") % size, F.floor(F.col("id") / size)
    node = lambda i: F.struct(ring.alias("ring"), i.alias("k"), F.lit(7).alias("c"))
    ids = spark.range(n * size)
    edges = ids.select(node(k).alias("a"), node((k + 3) % size).alias("b"))
    open_end = spark.createDataFrame([((-1, 0, 7), (-1, 1, 7)), ((-1, 1, 7), (-1, 2, 7))], edges.schema)
    before = _bytes(folder)
    found = graphs.rings(edges.union(open_end))
    rows = found.filter("node.ring = 11").orderBy("pos").collect()
    assert [(r.head.k, r.pos, r.node.k) for r in rows] == [(0, i, i * 3 % size) for i in range(size)]
    assert found.count() == n * size and found.select("head").distinct().count() == n
    assert _bytes(folder) - before < 10e6  # checkpoints of all rounds took more than 100 bytes a node and round


def test_no_edges(spark):
    none = spark.createDataFrame([], "a struct<k: int>, b struct<k: int>")
    assert graphs.components(none).isEmpty() and graphs.rings(none).isEmpty()


def test_components_of_structs(spark):
    edges = spark.createDataFrame([((1, "b"), (1, "a")), ((1, "c"), (1, "b")), ((2, "z"), (2, "y"))], "a struct<k: int, s: string>, b struct<k: int, s: string>")
    assert sorted((tuple(r.id), tuple(r.label)) for r in graphs.components(edges).collect()) == [((1, "a"), (1, "a")), ((1, "b"), (1, "a")), ((1, "c"), (1, "a")), ((2, "y"), (2, "y")), ((2, "z"), (2, "y"))]


def test_junctions_deal_touching_solids_only(spark, monkeypatch):
    boxes = [(k, 20.0 * k, 0.0, 12.0) for k in range(40)] + [(40, 792.005, 3.0, 6.0)]  # the last one stands 5 mm off another's side, the others stand alone
    rows = [(k, f, 0, i, x + dx * side, y + dy * side, 9.0 * f) for k, x, y, side in boxes for f in (0, 1) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    rows += [(50, 0, 0, 0, float("nan"), 1.0, None), (50, 0, 0, 1, float("inf"), 1.0, 0.0)]
    df = faces.faces(spark.createDataFrame(rows, "solid int, face int, ring int, pos int, x double, y double, z double"))
    written, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = sorted((r.solid, round(r.p.y, 3), round(r.p.z, 3), round(r.t, 6)) for r in faces.junctions(df, 25).collect())
    assert found == [(39, y, z, t) for y, t in ((3.0, 0.25), (9.0, 0.75)) for z in (0.0, 9.0)]
    assert max(w.count() for w in written) <= 41  # a box for each solid is the most that is written; before, all vertices were


def test_components_united_in_tasks(spark, monkeypatch):
    edge = lambda a, b: ((a // 30, a), (b // 30, b))
    rows = [edge(a, a + d) for k in range(50) for a in range(30 * k, 30 * k + 27) for d in (3,) if a % 7] + [edge(k, k) for k in range(1500)]
    edges = spark.createDataFrame(rows, "a struct<k: int, n: int>, b struct<k: int, n: int>")
    root = {k: k for k in range(1500)}
    for (_, a), (_, b) in sorted(rows):  # edges lead upwards in steps of three, so the least end is settled before
        root[b] = min(root[b], root[a])
    for frame, most in ((edges.repartition(7), 11), (edges.repartition(5), 1 << 20), (edges.repartition(1), 40)):
        found = graphs.components(frame, most).collect()
        assert {r.id.n: r.label.n for r in found} == root and len(found) == len(root)
    texts = spark.createDataFrame([("z", "é"), ("é", "a"), (None, "b"), ("c", "c")], "a string, b string")
    assert sorted(graphs.components(texts, 1).collect()) == [("a", "a"), ("c", "c"), ("z", "a"), ("é", "a")]
    monkeypatch.setattr(graphs, "_rounds", lambda edges: 1 / 0)  # what is dealt by group needs no round
    assert {r.id.n: r.label.n for r in graphs.components(edges.repartition(5, "a.k")).collect()} == root


def _boxes(spark, boxes):
    """Faces of boxes (solid, x, y, side): floor and four walls, 9 high."""
    rows = []
    for k, x, y, side in boxes:
        at = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
        rows += [(k, 0, 0, i, *at[3 - i], 0.0) for i in range(4)]
        rows += [(k, f + 1, 0, i, *p, z) for f in range(4) for i, (p, z) in enumerate([(at[f], 0.0), (at[(f + 1) % 4], 0.0), (at[(f + 1) % 4], 9.0), (at[f], 9.0)])]
    return faces.faces(spark.createDataFrame(rows, "solid int, face int, ring int, pos int, x double, y double, z double"))


def test_interfaces_deal_faces_that_can_meet(spark, monkeypatch):
    df = _boxes(spark, [(k, 20.0 * k, 0.0, 12.0) for k in range(40)] + [(40, 792.0, 3.0, 6.0)])
    written, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(cut(df)) or written[-1])
    assert list(map(tuple, faces.interfaces(df, 25).collect())) == [(39, 2, 40, 4, 54.0)]
    assert max(w.count() for w in written) <= 41  # a box for each solid; before, all 205 faces were
    keys = spark.createDataFrame([(v,) for v in (0.0, 1.0, -1.0, 0.0004999)], "v double")
    assert keys.select(faces._near_keys(F.col("v"), faces.NORMAL_KEY, 5e-5)).count() == 5  # common normals take one key, those near a border two


def test_planes_of_odd_faces(spark):
    square = [(0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (4.0, 4.0, 1.0), (0.0, 4.0, 1.0)]
    hole = [(1.0, 1.0, 1.0), (1.0, 3.0, 1.0), (3.0, 3.0, 1.0), (3.0, 1.0, 1.0)]
    odd = {
        None: [[square], [square, hole]], "hole_orientation": [[square, hole[::-1]]], "invalid_topology": [[square, square[::-1]]], "planarity_tolerance_exceeded": [[[*square[:2], (4.0, 4.0, 1.01), square[3]]]],
        "invalid_coordinates": [None, [], [[]], [None], [square, None], [square[:2]], [square, []], [[*square, None]], [[*square, (0.0, 1.0, None)]], [[*square, (float("nan"), 1.0, 1.0)]], [[*square, (float("-inf"), 1.0, 1.0)]]],
        "repeated_vertices": [[[*square, (-0.0, 1e-10, 1.0)]], [square, [hole[0], *hole]]], "degenerate_face": [[[(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)]]], "zero_length_edge": [[[square[0], (1e-7, 0.0, 1.0), *square[2:]]]],
    }
    rows = [(reason, rings) for reason, many in odd.items() for rings in many]
    df = spark.createDataFrame([(i, 0, rings) for i, (_, rings) in enumerate(rows)], "solid int, face int, rings array<array<struct<x: double, y: double, z: double>>>")
    found = {r.solid: r for r in faces.planes(df).collect()}
    assert [found[i].reason for i in range(len(rows))] == [reason for reason, _ in rows]
    r = found[1]
    assert (tuple(r.origin), tuple(r.u), tuple(r.v), tuple(r.normal), r.area, r.deviation) == ((0, 0, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1), 12.0, 0.0)
    assert found[5].origin is None and found[5].area is None and found[5].deviation is None


def test_plain_corners_are_no_nodes(spark, monkeypatch):
    df = _boxes(spark, [(k, 20.0 * k, 0.0, 12.0) for k in range(30)] + [(30, 700.0, 0.0, 5.0)])
    roof = df.filter("face = 0").select("solid", F.lit(9).alias("face"), F.transform("rings", lambda r: F.reverse(F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(9.0).alias("z"))))).alias("rings"))
    written, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(cut(df)) or written[-1])
    found = {r.solid: r for r in faces.checked(df.union(roof.filter("solid <> 7"))).collect()}
    assert {k: r.reason for k, r in found.items()} == {k: "non_manifold_edge" if k == 7 else None for k in range(31)}
    assert [(found[k].n_faces, found[k].n_edges, round(found[k].volume, 9)) for k in (0, 30)] == [(6, 12, 1296.0), (6, 12, 225.0)]
    assert max(w.count() for w in written) <= 31 * 12  # the edges; before, 24 corners of each solid went through the rounds


def test_fans_of_odd_faces(spark):
    rings = "array<array<struct<x: double, y: double, z: double>>>"
    tetra = [[(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)], [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)], [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)], [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]]
    odd = [[[(1.0, 0.0, None), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]], [[]], [], None, [[(5.0, 5.0, 5.0), (6.0, 6.0, None)]]]  # what has no number adds nothing
    df = spark.createDataFrame([(1, k, [f]) for k, f in enumerate(tetra)] + [(1, 10 + k, r) for k, r in enumerate(odd)], f"solid int, face int, rings {rings}")
    assert [(r.solid, round(r.volume, 12)) for r in faces.volumes(df).collect()] == [(1, round(1 / 6, 12))]


def test_near_pairs_of_full_places(spark):
    rows = [(k, float(k % 7), float(k % 3) - 1) for k in range(120)] + [(5, 5.0, 1.0), (5, 3.0, 0.0), (None, 1.0, 1.0), (300, None, 1.0), (301, float("nan"), 1.0), (302, -0.0, 0.0)]
    sound = [(i, x, y) for i, x, y in rows if i is not None and x is not None and x == x]
    want = sorted((min(p[0], q[0]), max(p[0], q[0])) for k, p in enumerate(sound) for q in sound[:k] if p[0] != q[0] and abs(p[1] - q[1]) < 2 and abs(p[2] - q[2]) < 2)
    df = spark.createDataFrame(rows, "id int, x double, y double")
    for together in (1, 4, 1000):
        assert sorted(map(tuple, spatial.near_pairs(df, 2, together).collect())) == want
