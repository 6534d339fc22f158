import math

from pyspark.sql import functions as F

from masonry.functions import rings as P
from masonry.operators import faces as S
from masonry.operators import polygons as Q

POLYGON = "code string, rings array<array<struct<x:double,y:double>>>"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
COURT = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]


def moved(ring, dx, dy):
    return [(x + dx, y + dy) for x, y in ring]


def test_points_with_holes_and_borders(spark):
    polygons = spark.createDataFrame([("holed", [SQUARE, COURT]), ("saw", [[(10.0, 0.0), (16.0, 0.0), (16.0, 4.0), (13.0, 1.0), (10.0, 4.0)]])], POLYGON)
    points = [(0.5, 0.5), (2.0, 2.0), (1.0, 2.0), (4.0, 4.0), (0.0, 2.0), (2.0, 1.0), (4.5, 2.0), (-1.0, 1.0), (3.0, 3.0), (13.0, 1.0), (13.0, 1.5), (11.0, 2.0), (15.0, 3.0), (14.5, 2.5), (14.0, 2.5), (12.0, 0.0), (-0.5, 4.0)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "key int, x double, y double")
    want = {(k, c) for k, c in [(0, "holed"), (2, "holed"), (3, "holed"), (4, "holed"), (5, "holed"), (8, "holed"), (9, "saw"), (11, "saw"), (12, "saw"), (13, "saw"), (15, "saw")]}
    for cell in (0.7, 3.0, 100.0):
        assert {tuple(r) for r in Q.covering(frame, polygons, "key", "code", cell).collect()} == want


def test_shared_areas(spark):
    left = spark.createDataFrame([("a", [SQUARE, COURT]), ("d", [[(0.0, -10.0), (2.0, -12.0), (4.0, -10.0), (2.0, -8.0)]])], POLYGON)
    right = spark.createDataFrame(
        [("whole", [SQUARE]), ("court", [COURT[::-1]]), ("half", [moved(SQUARE, 2, 0)]), ("touch", [moved(SQUARE, 4, 0)]), ("reverse", [SQUARE[::-1], COURT[::-1]]), ("diamond", [[(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]]), ("box", [[(1.0, -11.0), (3.0, -11.0), (3.0, -9.0), (1.0, -9.0)]])], POLYGON
    )
    got = {(r.a, r.b): round(r.shared, 9) for r in Q.overlaps(left, right, 3.0).collect()}
    assert got == {("a", "whole"): 12.0, ("a", "half"): 6.0, ("a", "reverse"): 12.0, ("a", "diamond"): 4.0, ("d", "box"): 4.0}


def test_agreement(spark):
    outlines = spark.createDataFrame([("a", [SQUARE, COURT]), ("b", [SQUARE]), ("c", [SQUARE])], POLYGON)
    models = spark.createDataFrame([("a", [SQUARE]), ("b", [SQUARE])], POLYGON)
    got = {r.code: r for r in Q.agreement(outlines, models, 5.0).collect()}
    assert (got["a"].coverage, got["a"].precision, got["a"].filled, got["a"].reasons) == (1.0, 0.75, 4.0, ["fills_courtyard", "outline_mismatch"])
    assert (got["b"].iou, got["b"].reasons) == (1.0, []) and (got["c"].iou, got["c"].reasons) == (0.0, ["outline_mismatch"])


def test_cells_and_gaps(spark):
    polygons = spark.createDataFrame([("a", [SQUARE, COURT]), ("t", [[(0.0, 10.0), (3.0, 10.0), (0.0, 13.0)]])], POLYGON)
    grid = Q.cells(polygons, "code", 1.5)
    sums = {r.code: (r.n, round(r.area, 9)) for r in grid.groupBy("code").agg(F.count("*").alias("n"), F.sum("area").alias("area")).collect()}
    assert sums == {"a": (8, 12.0), "t": (5, 4.5)}
    cell = {(r.cx, r.cy): round(r.area, 9) for r in grid.filter("code = 'a'").collect()}
    assert cell[0, 0] == 2.0 and cell[0, 1] == 1.5 and (1, 1) not in cell
    hit = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 2, 1), ("x", 0, 0)], "code string, cx long, cy long")
    got = {r.code: r for r in Q.cell_evidence(grid, hit, "code").collect()}
    assert math.isclose(got["a"].gap + got["a"].coverage * 12, 12) and got["a"].largest < got["a"].gap
    assert (got["t"].coverage, round(got["t"].largest, 9)) == (0.0, 4.5)


def box(x0, x1, y0, y1, z0, z1, slope=0.0):
    """The faces of a box, its top rising along x."""
    p = lambda i, top: ((x0, x1)[i in (1, 2)], (y0, y1)[i in (2, 3)], (z1 + slope * ((x0, x1)[i in (1, 2)] - x0)) if top else z0)
    sides = [[p(i, 0), p((i + 1) % 4, 0), p((i + 1) % 4, 1), p(i, 1)] for i in range(4)]
    return [[[p(i, 0) for i in (3, 2, 1, 0)]], [[p(i, 1) for i in range(4)]], *([s] for s in sides)]


FACE = "solid string, face int, rings array<array<struct<x:double,y:double,z:double>>>"


def rows(solid, faces):
    return [(solid, k, f) for k, f in enumerate(faces)]


def frame(spark, solids):
    return spark.createDataFrame([r for k, f in solids.items() for r in rows(k, [[[tuple(map(float, p)) for p in ring] for ring in rings] for rings in f])], FACE)


def test_planes(spark):
    slope = [[(0, 0, 0), (3, 0, 4), (3, 2, 4), (0, 2, 0)], [(0.75, 0.5, 1), (0.75, 1.5, 1), (2.25, 1.5, 3), (2.25, 0.5, 3)]]
    cases = {
        "slope": [slope], "same_turn": [[slope[0], slope[1][::-1]]], "bent": [[[(0, 0, 0), (3, 0, 0), (3, 2, 0.1), (0, 2, 0)]]], "line": [[[(0, 0, 0), (1, 1, 1), (2, 2, 2)]]], "two": [[[(0, 0, 0), (1, 1, 1)]]],
        "twice": [[[(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 0, 0)]]], "nan": [[[(0, 0, 0), (float("nan"), 0, 0), (1, 1, 0)]]], "none": [[]], "filled": [[[(0, 0, 0), (1, 0, 0), (1, 1, 0)], [(0, 0, 0), (1, 1, 0), (1, 0, 0)]]],
    }
    got = {r.solid: r for r in S.planes(frame(spark, cases)).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "slope": None, "same_turn": "hole_orientation", "bent": "planarity_tolerance_exceeded", "line": "degenerate_face", "two": "invalid_coordinates", "twice": "repeated_vertices", "nan": "invalid_coordinates", "none": "invalid_coordinates", "filled": "invalid_topology",
    }
    s = got["slope"]
    assert math.isclose(s.area, 10 - 2.5) and [round(v, 9) for v in s.normal] == [-0.8, 0.0, 0.6] and [round(v, 9) for v in s.u] == [0.6, 0.0, 0.8] and s.deviation < 1e-12


def test_project_and_lift(spark):
    df = S.planes(frame(spark, {"s": [[[(1, 2, 0), (4, 2, 4), (4, 4, 4), (1, 4, 0)]]]}))
    plane = [F.col(c) for c in ("origin", "u", "v")]
    p = F.struct(F.lit(4.0).alias("x"), F.lit(4.0).alias("y"), F.lit(4.0).alias("z"))
    r = df.select(S.projected(p, *plane).alias("q"), S.lifted(S.projected(p, *plane), *plane).alias("back")).first()
    assert [round(v, 9) for v in r.q] == [5.0, 2.0] and [round(v, 9) for v in r.back] == [4.0, 4.0, 4.0]


def test_solids(spark):
    good = box(0, 2, 0, 3, 0, 1, 0.5)
    apart = good + box(10, 11, 0, 1, 0, 1)
    pinched = box(0, 1, 0, 1, 0, 1) + box(1, 2, 1, 2, 1, 2)
    twisted = [good[0], [good[1][0][::-1]], *good[2:]]
    got = {r.solid: r for r in S.checked(frame(spark, {"good": good, "open": good[:5], "twisted": twisted, "inward": [[r[::-1] for r in f] for f in good], "apart": apart, "pinched": pinched, "few": good[:3]})).collect()}
    assert {k: r.reason for k, r in got.items()} == {"good": None, "open": "non_manifold_edge", "twisted": "non_manifold_edge", "inward": "non_positive_volume", "apart": "disconnected_shell", "pinched": "disconnected_shell", "few": "too_few_faces"}
    assert math.isclose(got["good"].volume, 9.0) and (got["good"].n_faces, got["good"].n_edges) == (6, 12)
    uses = S.edge_uses(frame(spark, {"pinched": pinched}))
    assert S.shells(frame(spark, {"pinched": pinched}), uses).first().pinched == 1


def test_vertex_rows_make_faces(spark):
    v = [("s", 1, r, k, *p) for r, ring in enumerate([[(0, 0, 0), (4, 0, 0), (4, 4, 0), (0, 4, 0)], [(1, 1, 0), (1, 2, 0), (2, 2, 0)]]) for k, p in enumerate(ring)]
    df = S.faces(spark.createDataFrame(v[::-1], "solid string, face int, ring int, pos int, x int, y int, z int").repartition(3))
    assert S.planes(df).first().area == 15.5


def test_horizontal_clip(spark):
    df = frame(spark, {"s": box(0, 2, 0, 3, 0, 1, 1.0)})
    low = {r.face: r.a for r in S.planes(S.clipped(df, F.lit(1.5), False)).select("face", F.round("area", 9).alias("a")).collect()}
    assert low == {0: 6.0, 1: round(1.5 * math.sqrt(2), 9), 2: 2.875, 3: 4.5, 4: 2.875, 5: 3.0}
    high = {r.face for r in S.clipped(df, F.lit(2.0), True).collect()}
    assert high == {1, 2, 3, 4}


def test_interfaces(spark):
    left, right = box(0, 2, 0, 3, 0, 4), box(2, 5, 1, 6, 1, 3)
    near, far = box(2 + 5e-7, 3, -3, 0, 0, 1), box(2 + 3e-6, 3, 10, 12, 0, 1)
    tall = box(0, 2, 3, 5, 0, 4)
    df = frame(spark, {"a": left, "b": right, "c": near, "d": far, "e": tall, "f": box(0, 2, 10, 12, 0, 1)})
    for cell in (1.7, 50.0):
        got = {(r.a, r.a_face, r.b, r.b_face): round(r.shared, 6) for r in S.interfaces(df, cell).collect()}
        assert got == {("a", 3, "b", 5): 4.0, ("a", 4, "e", 2): 8.0, ("b", 5, "e", 3): 4.0}
    sides = {(r.solid, r.face): r for r in S.boundaries(df, S.interfaces(df, 50.0)).collect()}
    assert (sides["b", 5].interfaces, round(sides["b", 5].interior, 6), round(sides["b", 5].remainder, 6)) == (2, 8.0, 2.0) and sides["a", 0].interfaces == 0
    slanted = frame(spark, {"a": [[[(0, 0, 0), (3, 0, 4), (3, 2, 4), (0, 2, 0)]]], "b": [[[(0, 1, 0), (0, 3, 0), (3, 3, 4), (3, 1, 4)]]], "c": [[[(0, 1, 0.1), (0, 3, 0.1), (3, 3, 4.1), (3, 1, 4.1)]]]})
    assert [(r.a, r.b, round(r.shared, 9)) for r in S.interfaces(slanted, 2.0).collect()] == [("a", "b", 5.0)]


def test_let_evaluates_once(spark):
    n = spark.range(1).select(P.let(F.rand(), lambda x: x - x).alias("n")).first().n
    assert n == 0.0


def test_straight_runs(spark):
    ring = [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(ring,), ([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)],)], "r array<struct<x:double,y:double>>")
    runs = lambda *a: [[tuple(x) for x in row[0]] for row in df.select(P.straight_runs(F.col("r"), *a)).collect()]
    assert runs() == [[(1, 2), (3, 1), (4, 1), (5, 2)], [(0, 1), (1, 1), (2, 1)]]
    assert runs(lambda i: i != 0)[0] == [(0, 1), (1, 2), (3, 1), (4, 1), (5, 1)]


def test_junctions(spark):
    left, right = box(0, 2, 0, 3, 0, 4), box(2.005, 5, 0, 6, 0, 3)
    away, ramp = box(2.02, 3, 10, 16, 0, 4), box(0, 2, 10, 13, 0, 4)
    for cell in (0.9, 40.0):
        got = sorted((r.solid, *(round(v, 3) for v in r.p), round(r.t, 3), round(r.distance, 3)) for r in S.junctions(frame(spark, {"a": left, "b": right, "c": away, "d": ramp}), cell).collect())
        assert got == [("a", 2.005, 0.0, 3.0, 0.75, 0.005), ("b", 2.0, 3.0, 0.0, 0.5, 0.005)]
    near = box(2.005, 5, 0.004, 6, 0, 3.996)  # its corner is near the other's corner: no junction there
    assert {(r.solid, round(r.t, 3)) for r in S.junctions(frame(spark, {"a": left, "b": near}), 2.0).collect()} == {("b", round(2.996 / 5.996, 3))}


def test_rings_of_any_length_pinched_and_open(spark):
    from masonry.operators import graphs

    ring = lambda nodes: list(zip(nodes, nodes[1:] + nodes[:1], strict=True))
    long = [1000 + (k * 37) % 501 for k in range(501)]
    edges = ring(long) + ring([3, 1, 2]) + ring([10, 11, 12, 13]) + ring([12, 20, 21]) + [(30, 31), (31, 32)]
    rows = graphs.rings(spark.createDataFrame(edges, "a int, b int").repartition(4)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.head, {})[r.pos] = r.node
    first = long.index(1000)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {1000: long[first:] + long[:first], 1: [1, 2, 3]}


def test_canonical_json(spark):
    from masonry.functions import scalars

    cases = ['{"b": [1, 2.50, {"z": null, "y": "\\u00e9\\/"}], "a": {}, "B": true}', '{"B":true,"a":{},"b":[1,2.5,{"y":"é/","z":null}]}', '{"a": NaN}', '{"a": 1, "a": 2}', "[1, 2", "", None, '"x"', "[]"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(scalars.canonical_json(F.col("v")), scalars.content_hash(F.col("v"))).collect()
    assert [r[0] for r in rows] == ['{"B":true,"a":{},"b":[1,2.5,{"y":"é/","z":null}]}'] * 2 + [None] * 5 + ['"x"', "[]"]
    assert rows[0][1] == rows[1][1] and rows[2][1] is None


HEADER = '{"type": "CityJSON", "version": "2.0", "transform": {"scale": [0.5, 0.5, 0.25], "translate": [100, 200, 10]}, "CityObjects": {}, "vertices": []}'
TETRA = '"vertices": [[0,0,0],[4,0,0],[0,4,0],[0,0,8]]'


def feature(name, boundaries="[[[[0,2,1]],[[0,1,3]],[[1,2,3]],[[2,0,3]]]]", kind="Solid", lod="2.2", extra="", vertices=TETRA):
    return '{"type": "CityJSONFeature", "id": "%s", "CityObjects": {"%s": {"type": "Building"}, "%s-0": {"type": "BuildingPart", "geometry": [{"type": "MultiSurface", "lod": "1.2", "boundaries": []}, {"type": "%s", "lod": "%s", "boundaries": %s}]}}, %s%s}' % (name, name, name, kind, lod, boundaries, vertices, extra)


def test_city_json_lines(spark, tmp_path):
    from masonry.sources import cityjson

    good = [HEADER, feature("a"), "", feature("shells", "[[[[0,2,1]],[[0,1,3]],[[1,2,3]],[[2,0,3]]],[[[0,1,2]]]]"), feature("far", "[[[[0,2,9]]]]"), feature("flat", kind="MultiSurface"), feature("low", lod="1.2"), feature("own", extra=', "transform": {"scale": [1,1,1], "translate": [0,0,0]}'), "[oops", feature("text", vertices='"vertices": "none"')]
    (tmp_path / "one.jsonl").write_text("\n".join(good))
    (tmp_path / "two.jsonl").write_text("\n".join(['{"type": "CityJSON", "version": "9.9"}', feature("old")]))
    (tmp_path / "three.jsonl").write_text(feature("headless"))
    lines = cityjson.lines(spark, str(tmp_path))
    found = cityjson.solids(lines)
    reasons = {(r.solid, r.reason) for r in found.collect()}
    assert reasons == {("a-0", None), ("shells-0", "unsupported_geometry"), ("far-0", "cityjson_invalid"), ("flat-0", "unsupported_geometry"), ("low-0", "lod_unavailable"), (None, "cityjson_invalid"), ("old-0", "cityjson_invalid"), ("headless-0", "cityjson_invalid"), ("own-0", "cityjson_invalid"), ("text-0", "cityjson_invalid")}
    f = cityjson.faces(found)
    r = S.checked(f).first()
    assert (r.solid, r.n_faces, r.n_edges, r.reason) == ("a-0", 4, 6, None) and math.isclose(r.volume, 2 * 2 * 2 / 6)
    first = f.filter("face = 0").first().rings[0]
    assert [tuple(p) for p in first] == [(100.0, 200.0, 10.0), (100.0, 202.0, 10.0), (102.0, 200.0, 10.0)]
