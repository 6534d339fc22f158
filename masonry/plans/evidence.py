"""Queries that hold units against measured points; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import faces as T
from ..sources.views import BLD, FULL, PT, SLOPE, buildings, points, solid_vertices, solid_vertices_sql
from .portfolio import query

#: Level floors and sloped roofs, both with a square shaft, of the buildings with even roofs; faces 0 and 1 of `solid_vertices`.
ROOT = f"sqrt(1 + {SLOPE * SLOPE})"
PLACES = f"""{BLD}, {FULL}, {PT}, {solid_vertices_sql()}, u AS (SELECT code AS unit, x0, y0, w, d, CAST(h AS DOUBLE) AS h, x0 + w / 4.0 AS hx0, x0 + w * 0.75 AS hx1, y0 + d / 4.0 AS hy0, y0 + d * 0.75 AS hy1 FROM full_bld WHERE code % 13 > 0 AND code % 19 > 0),
 edge AS (SELECT solid AS unit, face, x, y, z, qx - x AS dx, qy - y AS dy, qz - z AS dz FROM sv WHERE face < 2),
 pt2 AS (SELECT DISTINCT o, ln, class, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM pt), spot AS (SELECT u.*, o, ln, class, x, y, z, sqrt(power(greatest(x0 - x, 0, x - x0 - w), 2) + power(greatest(y0 - y, 0, y - y0 - d), 2)) AS away FROM u JOIN pt2 ON x BETWEEN x0 - 2 AND x0 + w + 2 AND y BETWEEN y0 - 2 AND y0 + d + 2)"""


def _within(x: str, y: str) -> str:
    """Inside a building's box and not in its shaft."""
    return f"({x} > x0 AND {x} < x0 + w AND {y} > y0 AND {y} < y0 + d AND NOT ({x} > hx0 AND {x} < hx1 AND {y} > hy0 AND {y} < hy1))"


def _space(rows: str, face: str) -> str:
    """The distance in space of each of `rows` to the nearest of the faces."""
    return f"""SELECT unit, o, ln, x, y, z, min(CASE WHEN inside THEN abs(up) ELSE rim END) AS residual FROM (SELECT a.*, {_within('fx', 'y')} AS inside FROM (SELECT a.*, face, CASE face WHEN 0 THEN z ELSE (z - h - {SLOPE} * (x - x0)) / {ROOT} END AS up, x - CASE face WHEN 0 THEN 0 ELSE (z - h - {SLOPE} * (x - x0)) / {ROOT} * -{SLOPE} / {ROOT} END AS fx FROM {rows} a, (VALUES (0), (1)) v(face) WHERE {face}) a) a
 JOIN (SELECT unit, o, ln, x, y, z, face, min(sqrt(power(ex + t * dx - x, 2) + power(ey + t * dy - y, 2) + power(ez + t * dz - z, 2))) AS rim FROM (SELECT a.unit, o, ln, e.face, a.x, a.y, a.z, e.x AS ex, e.y AS ey, e.z AS ez, dx, dy, dz, greatest(0, least(1, ((a.x - e.x) * dx + (a.y - e.y) * dy + (a.z - e.z) * dz) / (dx * dx + dy * dy + dz * dz))) AS t FROM {rows} a JOIN edge e USING (unit)) GROUP BY ALL) r USING (unit, o, ln, x, y, z, face) GROUP BY ALL"""


def _faces(spark, sf):
    kind = F.when(F.col("face") == 0, "GroundSurface").when(F.col("face") == 1, "RoofSurface").otherwise("WallSurface")
    return T.faces(solid_vertices(spark, sf).filter("solid % 13 > 0 and solid % 19 > 0")).select(F.col("solid").alias("unit"), "face", kind.alias("semantic"), "rings")


def _points(spark, sf):
    return points(spark, sf).select(F.struct("o", "ln", "x", "y", "z").alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "class")


def _boxes(spark, sf):
    b = buildings(spark, sf).filter("code % 13 > 0 and code % 19 > 0")
    return b.select(F.col("code").alias("unit"), F.array(S.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("d"))).alias("rings"), F.col("x0"), F.col("y0"), F.col("w"), F.col("d"))


def _residuals(spark, sf, level):
    near = E.near_polygons(_points(spark, sf), _boxes(spark, sf).select("unit", "rings"), 2, 20)
    found = E.nearest(near, _faces(spark, sf).filter(F.col("face") == 1 if level else F.col("face") < 2), 5, level)
    return found.select("unit", "id.o", "id.ln", F.round("residual", 6).alias("residual"))


@query(f"WITH {PLACES}, near AS (SELECT * FROM spot WHERE away <= 2) SELECT unit, o, ln, round(residual, 6) AS residual FROM ({_space('near', 'true')})")
def plane_residuals(spark, sf):
    """[J-13, J-14] points within 2 m of a building's outline: distance in space to the nearest of its floor and its sloped roof, both with a shaft."""
    return _residuals(spark, sf, False)


@query(f"""WITH {PLACES}, near AS (SELECT * FROM spot WHERE away <= 2), rim AS (SELECT unit, o, ln, x, y, z, arg_min(ez + t * dz, 1e6 * sqrt(power(ex + t * dx - x, 2) + power(ey + t * dy - y, 2)) + 1e-3 * (ez + t * dz)) AS rz FROM (SELECT a.*, e.x AS ex, e.y AS ey, e.z AS ez, dx, dy, dz, greatest(0, least(1, ((a.x - e.x) * dx + (a.y - e.y) * dy) / (dx * dx + dy * dy))) AS t FROM near a JOIN edge e USING (unit) WHERE face = 1) GROUP BY ALL)
 SELECT unit, o, ln, round(abs(z - CASE WHEN {_within('x', 'y')} THEN h + {SLOPE} * (x - x0) ELSE rz END), 6) AS residual FROM near JOIN rim USING (unit, o, ln, x, y, z)""")
def level_residuals(spark, sf):
    """[J-14] the same points' difference in height to the roof at its place nearest from above."""
    return _residuals(spark, sf, True)


#: Grid of the query's coverage: points are few, so its cells are larger than the default.
SIDE = 4

#: Quantiles of residuals lie on a lattice of 5e-8; this moves halves of the last digit off the tie, the same way in both engines.
TIE = 3e-9

EVIDENCE = f"""WITH {PLACES}, hole AS (SELECT *, unit % 3 = 0 AS hole, CAST(w * d AS DOUBLE) * CASE WHEN unit % 3 = 0 THEN 0.75 ELSE 1 END AS area FROM u),
 roofp AS (SELECT * FROM spot WHERE class = 6 AND away = 0 AND NOT (unit % 3 = 0 AND x > hx0 AND x < hx1 AND y > hy0 AND y < hy1)), groundp AS (SELECT * FROM spot WHERE class = 2 AND away <= 2 AND NOT (unit % 3 = 0 AND least(x - hx0, hx1 - x, y - hy0, hy1 - y) > 2)),
 rs AS (SELECT unit, count(*) AS n, quantile_cont(round(residual, 6), 0.5) AS med, quantile_cont(round(residual, 6), 0.95) AS p95 FROM ({_space('roofp', 'face = 1')}) GROUP BY 1), gs AS (SELECT unit, count(*) AS n, quantile_cont(round(abs(z), 6), 0.5) AS med, quantile_cont(round(abs(z), 6), 0.95) AS p95 FROM groundp GROUP BY 1),
 cell AS (SELECT *, cx * {SIDE} AS a, cy * {SIDE} AS b FROM (SELECT *, unnest(range(y0 // {SIDE}, (y0 + d + {SIDE - 1}) // {SIDE})) AS cy FROM (SELECT *, unnest(range(x0 // {SIDE}, (x0 + w + {SIDE - 1}) // {SIDE})) AS cx FROM hole))),
 sized AS (SELECT unit, hole, cx, cy, (least(a + {SIDE}, x0 + w) - a) * (least(b + {SIDE}, y0 + d) - b) AS box, greatest(0, least(a + {SIDE}, hx1) - greatest(a, hx0)) * greatest(0, least(b + {SIDE}, hy1) - greatest(b, hy0)) AS out FROM cell),
 occ AS (SELECT DISTINCT unit, CAST(floor(x / {SIDE}) AS BIGINT) AS cx, CAST(floor(y / {SIDE}) AS BIGINT) AS cy, true AS hit FROM roofp),
 grid AS (SELECT s.*, box - CASE WHEN hole THEN out ELSE 0 END AS part, box - out AS roof, coalesce(hit, false) AS hit FROM sized s LEFT JOIN occ USING (unit, cx, cy)),
 gap AS (SELECT unit, cx, cy, part FROM grid WHERE NOT hit AND part > 1e-10), reach(unit, cx, cy, tx, ty) AS (SELECT unit, cx, cy, cx, cy FROM gap UNION SELECT r.unit, r.cx, r.cy, g.cx, g.cy FROM reach r JOIN gap g ON g.unit = r.unit AND abs(g.cx - r.tx) + abs(g.cy - r.ty) = 1),
 largest AS (SELECT unit, max(s) AS s FROM (SELECT r.unit, r.cx, r.cy, sum(part) AS s FROM reach r JOIN gap g ON g.unit = r.unit AND g.cx = r.tx AND g.cy = r.ty GROUP BY ALL) GROUP BY 1),
 cov AS (SELECT unit, sum(CASE WHEN hit THEN part ELSE 0 END) / sum(part) AS c, sum(CASE WHEN hit THEN roof ELSE 0 END) / sum(roof) AS r FROM grid GROUP BY 1),
 e AS (SELECT unit, hole.area, coalesce(rs.n, 0) AS rn, coalesce(gs.n, 0) AS gn, coalesce(rs.n, 0) / hole.area AS density, c, r, coalesce(s, 0) AS gap, rs.med AS rmed, rs.p95 AS rp, gs.med AS gmed, gs.p95 AS gp, CASE WHEN hole THEN 1 ELSE 0.75 END AS iou FROM hole JOIN cov USING (unit) LEFT JOIN largest USING (unit) LEFT JOIN rs USING (unit) LEFT JOIN gs USING (unit))
 SELECT unit, rn AS roof_points, gn AS ground_points, round(density, 6) AS density, round(c, 6) AS coverage, round(gap, 6) AS largest_gap, round(r, 6) AS surface_coverage, round(iou, 6) AS roof_iou, round(rmed + {TIE}, 6) AS roof_median, round(rp + {TIE}, 6) AS roof_p95, round(gmed + {TIE}, 6) AS ground_median, round(gp + {TIE}, 6) AS ground_p95,
 array_to_string([CASE WHEN iou < 0.98 THEN 'roof_outline_mismatch' END, CASE WHEN iou < 0.98 THEN 'ground_outline_mismatch' END, CASE WHEN rn < 20 THEN 'insufficient_roof_points' END, CASE WHEN gn < 10 THEN 'insufficient_ground_points' END, CASE WHEN density < 1 THEN 'insufficient_roof_density' END, CASE WHEN c < 0.8 THEN 'insufficient_roof_coverage' END,
 CASE WHEN r < 0.7 THEN 'insufficient_roof_surface_coverage' END, CASE WHEN gap > greatest(1, 0.1 * area) THEN 'large_roof_evidence_gap' END, CASE WHEN rmed > 0.2 OR rp > 0.5 THEN 'roof_residual_threshold_exceeded' END, CASE WHEN gmed > 0.2 OR gp > 0.5 THEN 'ground_residual_threshold_exceeded' END], ',') AS reasons FROM e"""


@query(EVIDENCE.replace("WITH ", "WITH RECURSIVE ", 1))
def evidence_assessment(spark, sf):
    """[T-21] points, coverage, gaps, agreement and residuals of buildings with a shaft, which every third outline shows too."""
    b = _boxes(spark, sf)
    shaft = S.box_ring(F.col("x0") + F.col("w") / 4, F.col("y0") + F.col("d") / 4, F.col("w") / 2, F.col("d") / 2)
    outlines = b.select("unit", F.when(F.col("unit") % 3 == 0, F.concat("rings", F.array(F.reverse(shaft)))).otherwise(F.col("rings")).alias("rings"), F.lit("roofprint").alias("outline_type"))
    found = E.assess(outlines, _faces(spark, sf), _points(spark, sf), 20, SIDE)
    numbers, quantiles = ("density", "coverage", "largest_gap", "surface_coverage", "roof_iou"), ("roof_median", "roof_p95", "ground_median", "ground_p95")
    return found.select("unit", "roof_points", "ground_points", *(F.round(c, 6).alias(c) for c in numbers), *(F.round(F.col(c) + TIE, 6).alias(c) for c in quantiles), F.array_join("reasons", ",").alias("reasons"))
