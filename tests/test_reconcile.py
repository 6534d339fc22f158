"""Unions and links against plain Python on small cases."""

from itertools import combinations

from masonry.operators import reconcile as R

RINGS = "array<array<struct<x:double,y:double>>>"


def _clip(poly, by):
    """The part of a convex polygon in a convex counter-clockwise one."""
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        poly = out
    return poly


def _area(poly):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) / 2


def _union(polys):
    total = 0
    for k in range(1, len(polys) + 1):
        for some in combinations(polys, k):
            shape = some[0]
            for other in some[1:]:
                shape = _clip(shape, other) if shape else shape
            total += (-1) ** (k + 1) * (_area(shape) if shape else 0)
    return total


OWN = [(0.0, 0.0), (10.0, 1.0), (11.0, 9.0), (2.0, 8.0)]
MEMBERS = [[(-1.0, -1.0), (6.0, 0.0), (5.0, 6.0)], [(4.0, 1.0), (9.0, 2.0), (12.0, 7.0), (3.0, 6.5)], [(1.0, 5.0), (7.0, 4.0), (6.0, 12.0)], [(4.0, 1.0), (9.0, 2.0), (12.0, 7.0), (3.0, 6.5)]]


def _rings(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def test_unions_of_polygons(spark):
    rows = [("a", True, _rings(OWN))] + [("a", False, _rings(m)) for m in MEMBERS]
    rows += [("turned", True, _rings(OWN[::-1]))] + [("turned", False, _rings(m[::-1])) for m in MEMBERS]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows += [("hole", True, _rings(square(0, 0, 8))), ("hole", False, _rings(square(0, 0, 6), square(1, 1, 2)[::-1])), ("hole", False, _rings(square(2, 2, 4)))]
    rows += [("apart", True, _rings(square(0, 0, 2))), ("apart", False, _rings(square(5, 5, 1)))]
    df = spark.createDataFrame(rows, f"k string, own boolean, rings {RINGS}")
    for cell in (3, 100):
        got = {r.k: (r.whole, r.inside) for r in R.unions(df, "k", cell).collect()}
        whole, inside = _union(MEMBERS), _union([c for c in (_clip(m, OWN) for m in MEMBERS) if c])
        for key in ("a", "turned"):
            assert abs(got[key][0] - whole) < 1e-9 and abs(got[key][1] - inside) < 1e-9
        assert got["hole"] == (33.0, 33.0) and got["apart"] == (1.0, 0.0)
    assert R.unions(df.limit(0), "k", 3).count() == 0


def test_links(spark):
    box = lambda x0, x1, y1=10: _rings([(x0, 0), (x1, 0), (x1, y1), (x0, y1)])
    groups = spark.createDataFrame([("split", box(0, 10)), ("left", box(20, 25)), ("right", box(25, 30)), ("named", None), ("lost", None), ("edge", box(39, 41))], f"group_id string, rings {RINGS}")
    relations = spark.createDataFrame([("named", ["k1"], ["merged"], None, None, None), ("split", ["k2", None], None, None, box(0, 5), False), ("split", ["k3"], None, ["n1"], box(0, 5), True), ("split", None, ["nowhere"], ["n2"], None, None), ("other", ["k9"], ["half"], None, None, None)], f"group_id string, construction_ids array<string>, bdtopo_ids array<string>, rnb_ids array<string>, rings {RINGS}, fictitious boolean")
    features = spark.createDataFrame([("half", ["n2"], "roofprint"), ("rest", None, "unknown"), ("merged", None, "unknown"), ("wide", None, "unknown")], "source_id string, rnb_ids array<string>, outline_type string")
    parts = spark.createDataFrame([("half", 0, box(0, 5)), ("rest", 0, box(5, 10)), ("merged", 0, box(20, 30)), ("merged", 1, box(32, 32.5, 1)), ("wide", 0, box(40, 60))], f"source_id string, part int, rings {RINGS}")
    units, links = R.reconcile(groups, relations, features, parts, 7)
    ident = {r.unit: (r.source_id, r.part) for r in units.collect()}
    role = {(r.source_id, r.part): (r.role, r.n_groups) for r in units.collect()}
    assert role == {("half", 0): ("target", 1), ("rest", 0): ("target", 1), ("merged", 0): ("target", 3), ("merged", 1): ("target", 1), ("wide", 0): ("context", 0)}
    found = {(ident[r.unit], r.source_type, r.source_id, r.relationship): r for r in links.collect()}
    group = {(k[0], k[2], k[3]): (r.reason, r.shared) for k, r in found.items() if k[1] == "bdnb_group"}
    assert group == {
        (("half", 0), "split", "group_member"): ("explicit_rnb", 50.0), (("rest", 0), "split", "group_member"): ("spatial_union", 50.0),
        (("merged", 0), "left", "shared_physical_unit"): ("spatial_union", 50.0), (("merged", 0), "right", "shared_physical_unit"): ("spatial_union", 50.0), (("merged", 0), "named", "shared_physical_unit"): ("explicit_bdtopo", None),
        (("merged", 1), "named", "group_member"): ("explicit_bdtopo", None), (("wide", 0), "edge", "unresolved"): ("insufficient_bidirectional_coverage", 10.0),
    }
    kinds = {(k[0], k[1], k[2], k[3] != "unresolved") for k in found if k[1] in ("rnb", "bdnb_construction") and k[2]}
    assert kinds == {(("half", 0), "rnb", "n2", True), (("half", 0), "bdnb_construction", "k2", True), (("half", 0), "bdnb_construction", "k3", False), (("half", 0), "rnb", "n1", False), (("rest", 0), "bdnb_construction", "k2", False), (("rest", 0), "bdnb_construction", "k3", False), (("rest", 0), "rnb", "n1", False), (("rest", 0), "rnb", "n2", False), (("merged", 0), "bdnb_construction", "k1", True), (("merged", 1), "bdnb_construction", "k1", True)}
    assert {r.group_id for r in R.unresolved(groups, links).collect()} == {"lost", "edge"}
