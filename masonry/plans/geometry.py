"""Queries over general polygons, faces and solids; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rings as P
from ..functions import scalars
from ..operators import faces as S
from ..operators import graphs
from ..operators import polygons as Q
from ..sources import cityjson
from ..sources.views import BLD, FULL, OUTER, SLOPE, buildings, outline_edges_sql, outlines, solid_vertices, solid_vertices_sql, table
from .portfolio import full, query

EDGE = f"{BLD}, {outline_edges_sql('e')}"
#: Twice the signed area under an edge, of one polygon.
TWICE = "ax * ey - ex * ay"


def shared_sql(name: str, pairs: str) -> str:
    """A table (a, b, area) of what the polygons of edges l and r (pairs: a join that ends in ON) share, as a sum over pairs of edges; the smaller of two crossing lines is their mean less a triangle."""
    return f"""{name}_s AS (SELECT l.code AS a, r.code AS b, greatest(least(l.ax, l.ex), least(r.ax, r.ex)) AS lo, least(greatest(l.ax, l.ex), greatest(r.ax, r.ex)) AS hi,
 CASE WHEN (l.ax > l.ex) = (r.ax > r.ex) THEN 1.0 ELSE -1.0 END AS sign, l.ax AS lax, l.ay AS lay, l.ex AS lex, l.ey AS ley, r.ax AS rax, r.ay AS ray, r.ex AS rex, r.ey AS rey
 FROM {pairs} AND l.ax <> l.ex AND r.ax <> r.ex AND least(l.ax, l.ex) < greatest(r.ax, r.ex) AND least(r.ax, r.ex) < greatest(l.ax, l.ex)),
 {name}_h AS (SELECT *, lay + (ley - lay) * (lo - lax) / (lex - lax) AS l0, lay + (ley - lay) * (hi - lax) / (lex - lax) AS l1, ray + (rey - ray) * (lo - rax) / (rex - rax) AS r0, ray + (rey - ray) * (hi - rax) / (rex - rax) AS r1 FROM {name}_s),
 {name} AS (SELECT a, b, abs(sum(sign * (hi - lo) * ((l0 + l1 + r0 + r1) / 4 - CASE WHEN (l0 - r0) * (l1 - r1) < 0
 THEN (power(l0 - r0, 2) + power(l1 - r1, 2)) / (abs(l0 - r0) + abs(l1 - r1)) / 4 ELSE abs(l0 - r0 + l1 - r1) / 4 END))) AS area FROM {name}_h GROUP BY a, b)"""


@query(f"""WITH {EDGE}, pt AS (SELECT l_orderkey AS o, l_linenumber AS ln, CAST((l_orderkey * 7 + l_linenumber * 13) % 1000 AS DOUBLE) AS x, (l_partkey * 11 + l_linenumber * 3) % 3200 / 4.0 AS y FROM lineitem),
 box AS (SELECT code, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM e GROUP BY 1),
 m AS (SELECT o, ln, code, sum(CASE WHEN (ay > y) <> (ey > y) AND x < (ex - ax) * (y - ay) / nullif(ey - ay, 0) + ax THEN 1 ELSE 0 END) AS n,
 bool_or((ex - ax) * (y - ay) = (ey - ay) * (x - ax) AND x BETWEEN least(ax, ex) AND greatest(ax, ex) AND y BETWEEN least(ay, ey) AND greatest(ay, ey)) AS border
 FROM pt JOIN box ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 JOIN e USING (code) GROUP BY 1, 2, 3)
 SELECT o, ln, code FROM m WHERE n % 2 = 1 OR border""")
def point_in_polygon_join(spark, sf):
    """[J-05, F-02] points in outlines with notches and holes, borders included."""
    li = table(spark, sf, "lineitem")
    p = li.select(F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln")).alias("key"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1000).cast("double").alias("x"), ((F.col("l_partkey") * 11 + F.col("l_linenumber") * 3) % 3200 / 4).alias("y"))
    return Q.covering(p, outlines(spark, sf), "key", "code", 20).select("key.o", "key.ln", "code")


MOVED = f"{BLD}, {outline_edges_sql('e')}, {outline_edges_sql('f', 7, 2, 3)}, area AS (SELECT code, abs(sum({TWICE})) / 2 AS area FROM e GROUP BY 1), moved AS (SELECT code, abs(sum({TWICE})) / 2 AS area FROM f GROUP BY 1)"

NEAR = "near AS (SELECT l.code AS i, r.code AS j FROM (SELECT code, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY 1) l JOIN (SELECT code, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM f GROUP BY 1) r ON l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1)"


@query(f"WITH {MOVED}, {NEAR}, {shared_sql('shared', 'near JOIN e l ON l.code = i JOIN f r ON r.code = j')} SELECT a, b, round(shared.area, 6) AS shared, round(shared.area / (area.area + moved.area - shared.area), 6) AS iou FROM shared JOIN area ON a = area.code JOIN moved ON b = moved.code WHERE shared.area > 1e-9")
def polygon_overlap_area(spark, sf):
    """[J-06] outlines and their neighbours, moved and grown, that share an area."""
    found = Q.overlaps(outlines(spark, sf), outlines(spark, sf, 7, 2, 3), 20)
    return found.select("a", "b", F.round("shared", 6).alias("shared"), F.round(F.col("shared") / (F.col("left_area") + F.col("right_area") - F.col("shared")), 6).alias("iou"))


@query(f"""WITH {MOVED}, court AS (SELECT code, ax, ay, ex, ey FROM e WHERE ring = 1), {shared_sql('shared', 'e l JOIN f r ON l.code = r.code')}, {shared_sql('filled', 'court l JOIN f r ON l.code = r.code')},
 r AS (SELECT area.code, coalesce(s.area, 0) / (area.area + moved.area - coalesce(s.area, 0)) AS iou, coalesce(s.area, 0) / area.area AS coverage, coalesce(s.area, 0) / moved.area AS precision, coalesce(c.area, 0) AS filled
 FROM area JOIN moved USING (code) LEFT JOIN shared s ON s.a = area.code LEFT JOIN filled c ON c.a = area.code)
 SELECT code, round(iou, 6) AS iou, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(filled, 6) AS filled, array_to_string([CASE WHEN filled > 0.01 THEN 'fills_courtyard' END, CASE WHEN coverage < 0.98 OR precision < 0.98 THEN 'outline_mismatch' END], ',') AS reasons FROM r""")
def outline_agreement(spark, sf):
    """[A-13] outlines against models that are moved: IoU, coverage, precision, courtyards that the model fills."""
    found = Q.agreement(outlines(spark, sf), outlines(spark, sf, 7, 2, 3), 20)
    return found.select("code", *(F.round(c, 6).alias(c) for c in ("iou", "coverage", "precision", "filled")), F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {EDGE} SELECT code, round(abs(sum({TWICE})) / 2, 6) AS area, count(*) AS n_edges FROM e GROUP BY 1")
def polygon_area(spark, sf):
    """[A-19, G-02] area of outlines with holes."""
    rings = F.col("rings")
    return outlines(spark, sf).select("code", F.round(F.abs(P.area(rings)), 6).alias("area"), F.size(P.edges(rings)).cast("long").alias("n_edges"))


SOLID = f"{BLD}, {FULL}, {solid_vertices_sql()}"
#: Area vectors of rings about their first vertex, then planes of faces and how far their vertices are off.
RING = "ar AS (SELECT solid, face, ring, sum((y - oy) * (qz - oz) - (z - oz) * (qy - oy)) AS ax, sum((z - oz) * (qx - ox) - (x - ox) * (qz - oz)) AS ay, sum((x - ox) * (qy - oy) - (y - oy) * (qx - ox)) AS az FROM sv GROUP BY ALL)"
PLANE = f"""{RING}, n AS (SELECT solid, face, ax / sqrt(ax * ax + ay * ay + az * az) AS nx, ay / sqrt(ax * ax + ay * ay + az * az) AS ny, az / sqrt(ax * ax + ay * ay + az * az) AS nz FROM ar WHERE ring = 0),
 o AS (SELECT DISTINCT solid, face, ox AS px, oy AS py, oz AS pz FROM sv WHERE ring = 0),
 dev AS (SELECT solid, face, max(abs((x - px) * nx + (y - py) * ny + (z - pz) * nz)) AS deviation FROM sv JOIN n USING (solid, face) JOIN o USING (solid, face) GROUP BY ALL),
 fc AS (SELECT solid, face, sum(ax * nx + ay * ny + az * nz) / 2 AS area, bool_or(ring > 0 AND ax * nx + ay * ny + az * nz > 0) AS holes FROM ar JOIN n USING (solid, face) GROUP BY ALL),
 pl AS (SELECT solid, face, nx, ny, nz, area, deviation, CASE WHEN deviation > 1e-3 THEN 'planarity_tolerance_exceeded' WHEN holes THEN 'hole_orientation' END AS reason FROM n JOIN dev USING (solid, face) JOIN fc USING (solid, face))"""


@query(f"WITH {SOLID}, {PLANE} SELECT solid, face, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, round(area, 6) AS area, round(deviation, 6) AS deviation, reason FROM pl")
def face_planes(spark, sf):
    """[T-01] planes of sloped, holed and unsound faces, from a table of vertices."""
    found = S.planes(S.faces(solid_vertices(spark, sf)))
    rounded = lambda c, n: (F.round(c, 6) + F.lit(0.0)).alias(n)
    return found.select("solid", "face", *(rounded(f"normal.{c}", f"n{c}") for c in "xyz"), rounded("area", "area"), rounded("deviation", "deviation"), "reason")


@query(f"WITH {SOLID}, {PLANE} SELECT sv.solid, sv.face, ring, pos, round(sqrt(power(x - px, 2) + power(y - py, 2) + power(z - pz, 2)), 6) AS distance FROM sv JOIN o USING (solid, face) JOIN pl USING (solid, face) WHERE reason IS NULL")
def plane_coordinates(spark, sf):
    """[T-02] vertices in the coordinates of their planes and back; both distances from the origin agree."""
    v = solid_vertices(spark, sf)
    p = S.planes(S.faces(v)).filter("reason is null").select("solid", "face", "origin", "u", "v")
    plane = [F.col(c) for c in ("origin", "u", "v")]
    flat = v.join(p.hint("merge"), ["solid", "face"]).withColumn("q", S.projected(F.struct("x", "y", "z"), *plane)).withColumn("back", S.lifted(F.col("q"), *plane))
    moved = F.sqrt(sum(((F.col(f"back.{c}") - F.col(c)) ** 2 for c in "yz"), (F.col("back.x") - F.col("x")) ** 2))
    return flat.filter(moved < 1e-9).select("solid", "face", "ring", "pos", F.round(F.hypot("q.x", "q.y"), 6).alias("distance"))


@query(f"""WITH {SOLID}, {PLANE}, eg AS (SELECT solid, least(struct_pack(x := x, y := y, z := z), struct_pack(x := qx, y := qy, z := qz)) AS u, greatest(struct_pack(x := x, y := y, z := z), struct_pack(x := qx, y := qy, z := qz)) AS v,
 CASE WHEN struct_pack(x := x, y := y, z := z) < struct_pack(x := qx, y := qy, z := qz) THEN 1 ELSE -1 END AS way FROM sv), us AS (SELECT solid, u, v, count(*) AS uses, sum(way) AS turns FROM eg GROUP BY ALL),
 ed AS (SELECT solid, count(*) AS n_edges, bool_or(uses <> 2 OR turns <> 0) AS bad FROM us GROUP BY 1), vb AS (SELECT solid, min(x) AS gx, min(y) AS gy FROM sv GROUP BY 1),
 vo AS (SELECT solid, sum((ox - gx) * ((y - gy) * qz - z * (qy - gy)) + (oy - gy) * (z * (qx - gx) - (x - gx) * qz) + oz * ((x - gx) * (qy - gy) - (y - gy) * (qx - gx))) / 6 AS volume FROM sv JOIN vb USING (solid) GROUP BY 1),
 fr AS (SELECT solid, count(*) AS n_faces, min(reason) AS reason FROM pl GROUP BY 1)
 SELECT solid, n_faces, n_edges, round(volume, 6) AS volume, CASE WHEN reason IS NOT NULL THEN reason WHEN bad THEN 'non_manifold_edge' WHEN volume <= 0 THEN 'non_positive_volume' END AS reason FROM fr JOIN ed USING (solid) JOIN vo USING (solid)""")
def solid_validation(spark, sf):
    """[T-07, A-18, A-20, A-21] solids with sloped roofs and shafts, some unsound."""
    found = S.checked(S.faces(solid_vertices(spark, sf)))
    return found.select("solid", "n_faces", "n_edges", F.round("volume", 6).alias("volume"), "reason")


@query(f"""WITH {SOLID}, k AS (SELECT solid, face, ring, pos * 2 AS pos, x, y, z FROM sv WHERE z <= 4 UNION ALL SELECT solid, face, ring, pos * 2 + 1, x + (qx - x) * (4 - z) / (qz - z), y + (qy - y) * (4 - z) / (qz - z), 4.0 FROM sv WHERE (z - 4) * (qz - 4) < 0),
 c AS (SELECT *, {', '.join(f"coalesce(lead({c}) OVER r, first_value({c}) OVER r) AS q{c}, first_value({c}) OVER r AS o{c}" for c in "xyz")}, count(*) OVER r AS n FROM k WINDOW r AS (PARTITION BY solid, face, ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 a AS (SELECT solid, face, ring, sum((y - oy) * (qz - oz) - (z - oz) * (qy - oy)) AS ax, sum((z - oz) * (qx - ox) - (x - ox) * (qz - oz)) AS ay, sum((x - ox) * (qy - oy) - (y - oy) * (qx - ox)) AS az FROM c WHERE n >= 3 GROUP BY ALL)
 SELECT solid, face, count(*) AS rings, round(sqrt(power(sum(ax), 2) + power(sum(ay), 2) + power(sum(az), 2)) / 2, 6) AS area FROM a GROUP BY 1, 2""")
def horizontal_clip(spark, sf):
    """[T-10] the parts of faces up to a height of 4, and their areas."""
    cut = S.clipped(S.faces(solid_vertices(spark, sf)), F.lit(4.0), False)
    vectors = F.transform("rings", S.newell)
    length = F.sqrt(sum((P.total(F.transform(vectors, lambda v: v[c])) ** 2 for c in "yz"), P.total(F.transform(vectors, lambda v: v["x"])) ** 2))  # noqa: B023
    return cut.select("solid", "face", F.size("rings").cast("long").alias("rings"), F.round(length / 2, 6).alias("area"))


TOUCH = f"{BLD}, {FULL}, t AS (SELECT code, x0, y0, CAST(d AS DOUBLE) AS d, h, CASE WHEN code % 3 = 0 THEN 20 ELSE w END AS w FROM full_bld)"


@query(f"WITH {TOUCH} SELECT least(l.code, r.code) AS a, CASE WHEN l.code < r.code THEN 3 ELSE 5 END AS a_face, greatest(l.code, r.code) AS b, CASE WHEN l.code < r.code THEN 5 ELSE 3 END AS b_face, round(least(l.d, r.d) * least(l.h + {SLOPE} * l.w, r.h), 4) AS shared FROM t l JOIN t r ON l.x0 + l.w = r.x0 AND l.y0 = r.y0")
def coplanar_interfaces(spark, sf):
    """[J-16, J-23] walls that meet within tolerance, under sloped roofs."""
    found = S.interfaces(S.faces(solid_vertices(spark, sf, True)), 25)
    return found.select("a", "a_face", "b", "b_face", F.round("shared", 4).alias("shared"))


@query(f"""WITH {TOUCH}, m AS (SELECT l.code AS a, r.code AS b, least(l.d, r.d) * least(l.h + {SLOPE} * l.w, r.h) AS shared FROM t l JOIN t r ON l.x0 + l.w = r.x0 AND l.y0 = r.y0),
 s AS (SELECT a AS solid, shared FROM m UNION ALL SELECT b, shared FROM m), e AS (SELECT solid, sum(shared) AS interior, count(*) AS interfaces FROM s GROUP BY 1)
 SELECT code AS solid, CAST(coalesce(interfaces, 0) AS BIGINT) AS interfaces, round(coalesce(interior, 0), 4) AS interior, round(d * (h + {SLOPE} * w) + d * h + 2 * (w * h + {SLOPE} * w * w / 2) + d / 2 * (h + {SLOPE} * w * 0.75) + d / 2 * (h + {SLOPE} * w * 0.25) + 2 * (w / 2 * h + {SLOPE} * w * w / 4) + w * d * 0.75 * (1 + sqrt(1 + {SLOPE} * {SLOPE})) - coalesce(interior, 0), 3) AS remainder FROM t LEFT JOIN e ON code = e.solid""")
def boundary_areas(spark, sf):
    """[J-16, J-23] of each solid, the area shared with its neighbours and what is left of its faces."""
    f = S.faces(solid_vertices(spark, sf, True))
    rows = S.boundaries(f, S.interfaces(f, 25))
    return rows.groupBy("solid").agg(F.sum("interfaces").alias("interfaces"), F.round(F.sum("interior"), 4).alias("interior"), F.round(F.sum("remainder"), 3).alias("remainder"))


#: The edges of the cells (2 by 2) that an outline's box touches; code is the outline, j the cell.
CELLS = f"""{EDGE}, box AS (SELECT code, CAST(floor(min(ax) / 2) AS BIGINT) AS x0, CAST(ceil(max(ax) / 2) AS BIGINT) AS x1, CAST(floor(min(ay) / 2) AS BIGINT) AS y0, CAST(ceil(max(ay) / 2) AS BIGINT) AS y1 FROM e GROUP BY 1),
 cl0 AS (SELECT code, unnest(range(x0, x1)) AS cx, y0, y1 FROM box), cl AS (SELECT code, cx, unnest(range(y0, y1)) AS cy FROM cl0),
 near AS (SELECT code AS i, struct_pack(code := code, cx := cx, cy := cy) AS j FROM cl),
 f AS (SELECT struct_pack(code := code, cx := cx, cy := cy) AS code, 2.0 * cx + 2 * fx AS ax, 2.0 * cy + 2 * fy AS ay, 2.0 * cx + 2 * gx AS ex, 2.0 * cy + 2 * gy AS ey FROM cl, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) AS c(fx, fy, gx, gy)),
 {shared_sql('shared', 'near JOIN e l ON l.code = i JOIN f r ON r.code = j')}, grid AS (SELECT a AS code, b.cx AS cx, b.cy AS cy, area FROM shared WHERE area > 1e-9)"""


@query(f"WITH {CELLS} SELECT code, cx, cy, round(area, 6) AS area FROM grid")
def cell_areas(spark, sf):
    """[G-11] outlines with notches and holes, clipped to cells; the SQL adds up pairs of edges instead."""
    return Q.cells(outlines(spark, sf), "code", 2.0).filter("area > 1e-9").select("code", "cx", "cy", F.round("area", 6).alias("area"))


@query(f"""WITH RECURSIVE {CELLS}, g AS (SELECT *, (cx * cx * 31 + cy * 17 + code) % 11 < 6 AS hit FROM grid), r AS (SELECT code, cx, cy, cx * 100000 + cy AS root FROM g WHERE NOT hit UNION SELECT g.code, g.cx, g.cy, r.root FROM r JOIN g ON g.code = r.code AND NOT g.hit AND abs(g.cx - r.cx) + abs(g.cy - r.cy) = 1),
 l AS (SELECT code, cx, cy, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT code, root, sum(area) AS area FROM l JOIN g USING (code, cx, cy) GROUP BY ALL), m AS (SELECT code, sum(area) AS gap, max(area) AS largest FROM s GROUP BY 1)
 SELECT code, round(sum(area), 6) AS area, round(coalesce(sum(area) FILTER (hit), 0) / sum(area), 6) AS coverage, round(coalesce(any_value(gap), 0), 6) AS gap, round(coalesce(any_value(largest), 0), 6) AS largest FROM g LEFT JOIN m USING (code) GROUP BY 1""")
def clipped_coverage(spark, sf):
    """[A-10, A-11] coverage by area of clipped cells, and the largest gap in square metres."""
    grid = Q.cells(outlines(spark, sf), "code", 2.0).filter("area > 1e-9")
    hit = grid.filter((F.col("cx") * F.col("cx") * 31 + F.col("cy") * 17 + F.col("code")) % 11 < 6)
    return Q.cell_evidence(grid, hit, "code").select("code", *(F.round(c, 6).alias(c) for c in ("area", "coverage", "gap", "largest")))


_HALVES = [c for p, q in zip(OUTER, OUTER[1:] + OUTER[:1], strict=True) for c in (p, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2))]


@query(f"""WITH {BLD}, v0 AS (SELECT code, (k - code % 10 + 10) % 10 AS i, x0 + w * fx AS x, y0 + d * fy AS y FROM bld, (VALUES {', '.join(str((k, *map(float, c))) for k, c in enumerate(_HALVES))}) AS c(k, fx, fy)),
 v AS (SELECT *, coalesce(lag(x) OVER r, last_value(x) OVER a) AS px, coalesce(lag(y) OVER r, last_value(y) OVER a) AS py, coalesce(lead(x) OVER r, first_value(x) OVER a) AS qx, coalesce(lead(y) OVER r, first_value(y) OVER a) AS qy FROM v0
 WINDOW r AS (PARTITION BY code ORDER BY i), a AS (PARTITION BY code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT code, i FROM v WHERE NOT ((x - px) * (qx - x) + (y - py) * (qy - y) > 0 AND abs((x - px) * (qy - y) - (y - py) * (qx - x)) <= 1e-9 * sqrt(power(x - px, 2) + power(y - py, 2)) * sqrt(power(qx - x, 2) + power(qy - y, 2)) AND (code + i) % 7 <> 0))
 SELECT code, CAST(i AS INTEGER) AS start, CAST(coalesce(lead(i) OVER (PARTITION BY code ORDER BY i), first_value(i) OVER (PARTITION BY code ORDER BY i) + 10) - i AS INTEGER) AS n FROM b""")
def ring_straight_runs(spark, sf):
    """[W-06] rings with vertices within their sides, begun anywhere; some vertices may not be joined over."""
    code = F.col("code")
    at = lambda c, size, share: (F.col(c) + F.col(size) * share).cast("double")
    ring = F.array(*(F.struct(at("x0", "w", fx).alias("x"), at("y0", "d", fy).alias("y")) for fx, fy in _HALVES))
    rows = buildings(spark, sf).select("code", scalars.rotated(ring, (code % 10).cast("int")).alias("ring"))
    runs = P.straight_runs(F.col("ring"), lambda i: (code + i) % 7 != 0)
    return rows.select("code", F.explode(runs).alias("r")).select("code", "r.start", "r.n")


@query(f"""WITH {TOUCH}, l0 AS (SELECT code, x0, y0, d, h, h + {SLOPE} * 20 AS top FROM t WHERE code % 3 = 0), m AS (SELECT l.code AS l, r.code AS r, r.x0 AS x, l.y0 AS y, l.d AS ld, r.d AS rd, l.top AS lt, r.h AS rh FROM l0 l JOIN t r ON r.x0 = l.x0 + 20 AND r.y0 = l.y0)
 SELECT solid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(z, 3) AS z, round(t, 4) AS t FROM (SELECT r AS solid, x, y, lt AS z, lt / rh AS t FROM m WHERE lt < rh UNION ALL SELECT l, x, y, rh, rh / lt FROM m WHERE rh < lt
 UNION ALL SELECT r, x, y + ld, lt, lt / rh FROM m WHERE lt < rh AND ld = rd UNION ALL SELECT l, x, y + rd, rh, rh / lt FROM m WHERE rh < lt AND ld = rd
 UNION ALL SELECT r, x, y + ld, 0, ld / rd FROM m WHERE ld < rd UNION ALL SELECT l, x, y + rd, 0, rd / ld FROM m WHERE rd < ld
 UNION ALL SELECT r, x, y + ld, lt, ld / rd FROM m WHERE ld < rd AND lt = rh UNION ALL SELECT l, x, y + rd, rh, rd / ld FROM m WHERE rd < ld AND lt = rh)""")
def edge_junctions(spark, sf):
    """[J-18] corners that lie on a neighbour's edge, 4e-7 away."""
    found = S.junctions(S.faces(solid_vertices(spark, sf, True)), 25)
    whole = lambda c: F.round(f"p.{c}", 3).alias(c)
    return found.select("solid", whole("x"), whole("y"), whole("z"), F.round("t", 4).alias("t"))


@query(f"""WITH RECURSIVE {BLD}, c0 AS (SELECT code, x0, y0, d, unnest(range(x0, x0 + w)) AS x FROM bld), c AS (SELECT code, x, y FROM (SELECT *, unnest(range(y0, y0 + d)) AS y FROM c0) WHERE NOT (x = x0 + 2 AND y BETWEEN y0 + 1 AND y0 + 2)),
 s AS (SELECT code, x + ax AS ax, y + ay AS ay, x + bx AS bx, y + ey AS ey FROM c, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) AS o(ax, ay, bx, ey)),
 e AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.code = s.code AND z.ax = s.bx AND z.ay = s.ey AND z.bx = s.ax AND z.ey = s.ay)),
 r AS (SELECT code, ax, ay, bx, ey FROM e UNION SELECT r.code, r.ax, r.ay, e.bx, e.ey FROM r JOIN e ON e.code = r.code AND e.ax = r.bx AND e.ay = r.ey),
 h AS (SELECT code, ax, ay, min(struct_pack(x := bx, y := ey)) AS head, count(*) AS n FROM r GROUP BY ALL)
 SELECT code, head.x AS x, head.y AS y, count(*) AS n, sum(e.ax * e.ey - e.bx * e.ay) / 2.0 AS area FROM h JOIN e USING (code, ax, ay) GROUP BY ALL""")
def boundary_rings(spark, sf):
    """[A-28, G-16] outlines of cells, each with a hole, assembled from their boundary edges in order."""
    span = lambda low, size: F.explode(F.sequence(F.col(low).cast("long"), (F.col(low) + F.col(size) - 1).cast("long")))
    c = buildings(spark, sf).withColumn("x", span("x0", "w")).withColumn("y", span("y0", "d")).filter(~((F.col("x") == F.col("x0") + 2) & F.col("y").between(F.col("y0") + 1, F.col("y0") + 2)))
    # the code stands beside the corners: rows are dealt by it already, so edges that cells share are counted where they are drawn
    at = lambda dx, dy: F.struct("code", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    sides = F.explode(F.array(*(F.struct(at(*p).alias("a"), at(*q).alias("b")) for p, q in zip(corners, corners[1:] + corners[:1], strict=True))))
    e = c.select("code", sides.alias("e")).select("code", "e.a", "e.b", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"))
    edges = e.groupBy("code", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("b").alias("b")).filter("n = 1")
    found = graphs.rings(edges).select("head", "pos", "node")
    nxt = F.coalesce(F.lead("node").over(W.partitionBy("head").orderBy("pos")), F.col("head"))
    turned = found.withColumn("q", nxt)
    return turned.groupBy("head").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("node.x") * F.col("q.y") - F.col("q.x") * F.col("node.y")) / 2).alias("area")).select("head.code", "head.x", "head.y", "n", "area")


@query("""SELECT p_partkey AS code, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE sha256('{"Brand":"' || p_brand || '","list":[' || p_size || ',null,{"a":' || p_size / 4 || ',"é":"x\\"y"}],"nothing":{},"size":' || p_size || '}') END AS hash FROM part""".replace("p_size / 4 ||", "rtrim(rtrim(CAST(CAST(p_size / 4.0 AS DECIMAL(9, 2)) AS VARCHAR), '0'), '.') ||"))
def canonical_json_hash(spark, sf):
    """[K-02, P-31] JSON texts with keys in any order, blanks, escapes and zeros, and some that repeat a key: equal values have equal hashes."""
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    size, quarter = text("p_size"), F.format_string("%.2f", F.col("p_size") / 4)
    inner = F.concat(F.lit('{ "\\u00e9" : "x\\"y", "a":'), quarter, F.lit("}"))
    brand, rest = F.concat(F.lit('"Brand" : "'), F.col("p_brand"), F.lit('"')), F.concat(F.lit('"list": ['), size, F.lit(".0, null,"), inner, F.lit("]"))
    other = F.concat(F.lit('"size":'), size, F.lit(', "nothing": { }'))
    text = F.when(k % 9 == 0, F.concat(F.lit("{"), brand, F.lit(","), rest, F.lit(","), other, F.lit(', "size": 1}'))).when(k % 2 == 0, F.concat(F.lit("{"), rest, F.lit(",\n"), other, F.lit(" ,"), brand, F.lit("}"))).otherwise(F.concat(F.lit(" {"), brand, F.lit(","), other, F.lit(","), rest, F.lit("} ")))
    return table(spark, sf, "part").select(k.alias("code"), scalars.content_hash(text).alias("hash"))


@query(f"WITH {BLD}, {FULL} SELECT CAST(code AS VARCHAR) AS solid, CASE WHEN code % 7 = 3 THEN NULL ELSE round(w * d * h + w * d * {SLOPE} * w / 2, 6) END AS volume, CASE WHEN code % 7 = 3 THEN NULL ELSE CAST(x0 AS DOUBLE) END AS west, CASE WHEN code % 7 = 3 THEN 'lod_unavailable' END AS reason FROM full_bld")
def city_json_solids(spark, sf):
    """[S-21] lines of CityJSONSeq, five sources with headers of their own, to solids and their volumes."""
    b = full(spark, sf)
    source = (F.col("code") % 5).cast("string")
    header = b.groupBy(source.alias("source")).agg(F.concat(F.lit('{"type": "CityJSON", "version": "1.1", "transform": {"scale": [0.5, 0.5, 0.25], "translate": ['), (100 * F.col("source").cast("int")).cast("string"), F.lit(', 0, 1]}, "vertices": [], "CityObjects": {}}')).alias("value"))
    x0, x1 = (2 * (F.col("x0") + c - 100 * (F.col("code") % 5)) for c in (F.lit(0), F.col("w")))
    y0, y1 = 2 * F.col("y0"), 2 * (F.col("y0") + F.col("d"))
    z = lambda v: (4 * v - 4).cast("int")
    corner = lambda x, y, v: F.concat(F.lit("["), F.concat_ws(",", x, y, z(v)), F.lit("]"))
    low, high, top = F.lit(0), F.col("h"), F.col("h") + SLOPE * F.col("w")
    vertices = F.concat_ws(",", corner(x0, y0, low), corner(x1, y0, low), corner(x1, y1, low), corner(x0, y1, low), corner(x0, y0, high), corner(x1, y0, top), corner(x1, y1, top), corner(x0, y1, high))
    name, lod = F.col("code").cast("string"), F.when(F.col("code") % 7 == 3, "1.2").otherwise("2.2")
    value = F.concat(F.lit('{"type": "CityJSONFeature", "CityObjects": {"'), name, F.lit('": {"type": "Building", "geometry": [{"type": "Solid", "lod": "'), lod, F.lit('", "boundaries": [[[[3,2,1,0]],[[4,5,6,7]],[[0,1,5,4]],[[1,2,6,5]],[[2,3,7,6]],[[3,0,4,7]]]]}]}}, "vertices": ['), vertices, F.lit("]}"))
    found = graphs.cut(cityjson.solids(header.union(b.select(source.alias("source"), value.alias("value")))))
    f = cityjson.faces(found)
    west = f.groupBy("solid").agg(F.min(F.array_min(F.transform(F.flatten("rings"), lambda p: p["x"]))).alias("west"))
    return found.select("solid", "reason").join(S.volumes(f).hint("merge"), "solid", "left").join(west.hint("merge"), "solid", "left").select("solid", F.round("volume", 6).alias("volume"), "west", "reason")
