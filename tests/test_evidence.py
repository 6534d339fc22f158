"""Nearest faces against plain Python, and verdicts of small units."""

import math
import random

from masonry.operators import evidence as E

FACES = "unit string, face int, semantic string, rings array<array<struct<x:double,y:double,z:double>>>"
POINTS = "id int, x double, y double, z double, class int"
OUTLINES = "unit string, rings array<array<struct<x:double,y:double>>>, outline_type string"


def _square(x, y, s, height):
    return [(float(a), float(b), float(height(a, b))) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]


def _inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (ax, ay, _), (bx, by, _) in zip(ring, ring[1:] + ring[:1], strict=True):
            hits += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return hits % 2 == 1


def _edges(rings, p, axes):
    """Least (distance, height) over places on the edges."""
    found = []
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            d = [b[i] - a[i] for i in axes]
            t = min(1, max(0, sum(x * (p[i] - a[i]) for x, i in zip(d, axes, strict=True)) / sum(x * x for x in d)))
            found.append((math.dist([a[i] + t * (b[i] - a[i]) for i in axes], [p[i] for i in axes]), a[2] + t * (b[2] - a[2])))
    return min(found)


def test_nearest_face(spark):
    rng = random.Random(3)
    slopes = [(0.5, -0.2, 3), (0.0, 0.0, 4), (-1.0, 0.3, 9), (0.2, 0.9, 1)]
    faces, planes = [], []
    for k, (a, b, c) in enumerate(slopes):
        height = lambda x, y, a=a, b=b, c=c: a * x + b * y + c
        rings = [_square(6 * (k % 2), 5 * (k // 2), 5, height)] + ([_square(6 * (k % 2) + 1, 5 * (k // 2) + 1, 2, height)[::-1]] if k % 2 == 0 else [])
        faces.append(("u", k, "RoofSurface", rings))
        planes.append((rings, height, (a, b)))
    points = [("u", i, rng.uniform(-4, 15), rng.uniform(-4, 14), rng.uniform(-3, 14)) for i in range(300)] + [("none", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(points, "unit string, id int, x double, y double, z double")
    fs = spark.createDataFrame(faces, FACES)

    def space(p):
        out = []
        for rings, height, (a, b) in planes:
            up = (p[2] - height(p[0], p[1])) / math.sqrt(1 + a * a + b * b)
            n = (-a / math.sqrt(1 + a * a + b * b), -b / math.sqrt(1 + a * a + b * b))
            out.append(abs(up) if _inside(rings, p[0] - up * n[0], p[1] - up * n[1]) else _edges(rings, p, (0, 1, 2))[0])
        return min(out)

    def level(p):
        out = [(0.0, k, height(p[0], p[1])) if _inside(rings, p[0], p[1]) else (_edges(rings, p, (0, 1))[0], k, _edges(rings, p, (0, 1))[1]) for k, (rings, height, _) in enumerate(planes)]
        return abs(p[2] - min(out)[2])

    for flag, want in ((False, space), (True, level)):
        for cell in (2, 50):
            got = {r.id: r.residual for r in E.nearest(df, fs, cell, flag).collect()}
            assert got.keys() == {p[1] for p in points if p[0] == "u"}
            assert all(abs(got[p[1]] - want(p[2:])) < 1e-9 for p in points if p[0] == "u")


def test_verdicts(spark):
    flat = lambda z: lambda x, y: z
    outline = lambda unit, x, kind="roofprint": (unit, [[p[:2] for p in _square(x, 0, 4, flat(0))]], kind)
    box = lambda unit, x, s=4: [(unit, 0, "GroundSurface", [_square(x, 0, s, flat(0))[::-1]]), (unit, 1, "RoofSurface", [_square(x, 0, s, flat(3))])]
    outlines = spark.createDataFrame([outline("good", 0), outline("bare", 20), outline("thin", 40, None)], OUTLINES)
    faces = spark.createDataFrame([*box("good", 0), *box("thin", 40, 2), ("thin", 2, "Chimney", [_square(40, 0, 1, flat(4))])], FACES)
    at = [(i % 8 * 0.5 + 0.25, i // 8 * 0.5 + 0.25) for i in range(64)]
    rows = [(i, x, y, 3.1, 6) for i, (x, y) in enumerate(at)] + [(100 + i, -1.0, i / 4, 0.05, 2) for i in range(12)] + [(200, 40.5, 0.5, 9.0, 6), (201, 500.0, 500.0, 0.0, 6)]
    found = {r.unit: r for r in E.assess(outlines, faces, spark.createDataFrame(rows, POINTS), 10).collect()}
    good, bare, thin = found["good"], found["bare"], found["thin"]
    assert (good.status, good.reasons, good.roof_points, good.ground_points, good.coverage, good.roof_iou) == ("evidence_passed", [], 64, 12, 1.0, 1.0)
    assert abs(good.roof_p95 - 0.1) < 1e-6 and abs(good.ground_median - 0.05) < 1e-6
    assert (bare.status, bare.reasons) == ("needs_review", ["missing_reconstructed_surfaces"])
    assert thin.reasons == ["undefined_outline_semantics", "undefined_surface_semantics", "roof_outline_mismatch", "ground_outline_mismatch", "insufficient_roof_points", "insufficient_ground_points", "insufficient_roof_density", "insufficient_roof_coverage", "insufficient_roof_surface_coverage", "large_roof_evidence_gap", "roof_residual_threshold_exceeded"]
    bad = spark.createDataFrame([*rows, (300, float("nan"), 0.0, 0.0, 6), (301, None, 0.0, 0.0, 2)], POINTS)
    found = {r.unit: r.reasons for r in E.assess(outlines, faces, bad, 10).collect()}
    assert found["good"] == ["nonfinite_lidar_coordinates"] and found["bare"] == ["missing_reconstructed_surfaces", "nonfinite_lidar_coordinates"]
    assert E.assess(outlines.limit(0), faces, bad, 10).count() == 0


def test_boxes_are_compared_before_edges(spark):
    square = spark.createDataFrame([(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]])], "unit int, rings array<array<struct<x: double, y: double>>>")
    places = [(-2.0, 2.0), (6.0, 6.0), (5.4, 5.4), (2.0, 6.0), (2.0, 6.001), (2.0, 2.0), (9.0, 9.0), (-1.5, -1.5)]
    points = spark.createDataFrame([(k, x, y, 0.0) for k, (x, y) in enumerate(places)], "id int, x double, y double, z double")
    near = E.near_polygons(points, square, 2.0, 20)
    assert sorted(r.id for r in near.collect()) == [0, 2, 3, 5]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    tested = next(line for line in plan.splitlines() if "lambda" in line and "Join" in line or "Filter" in line and "lambda" in line)
    assert 0 < tested.index("box") < tested.index("lambda")
