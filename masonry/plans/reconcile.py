"""Queries that reconcile building groups with physical outlines; registered with those of `portfolio`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reconcile as R
from ..sources.views import BLD, buildings
from .portfolio import query

#: Groups, and outlines as in `union_coverage_assoc`; some have no shape, some outlines a second part that lies apart (4 square metres), and both carry identifiers.
SHAPES = f"""{BLD}, g AS (SELECT code AS a, x0, y0, x0 + w - CASE WHEN code % 4 = 0 THEN 4 ELSE 0 END AS x1, y0 + d AS y1, (w - CASE WHEN code % 4 = 0 THEN 4 ELSE 0 END) * d AS gs FROM bld WHERE code % 10 < 9),
 f0 AS (SELECT code, code * 10 AS b, x0 + code % 2 AS x0, y0, x0 + w + code % 2 AS x1, y0 + d AS y1, CASE WHEN code % 6 = 1 THEN 4 ELSE 0 END AS more FROM bld WHERE code % 3 > 0
 UNION ALL SELECT code, code * 10 + 1, x0, y0, x0 + w // 2 + code % 9 // 3, y0 + d, 0 FROM bld WHERE code % 3 = 0 UNION ALL SELECT code, code * 10 + 2, x0 + w // 2, y0, x0 + w, y0 + d, 0 FROM bld WHERE code % 3 = 0),
 f AS (SELECT *, (x1 - x0) * (y1 - y0) + more AS fs, CASE WHEN code % 8 < 3 THEN 'r' || code END AS rnb FROM f0),
 c AS (SELECT a, b, greatest(g.x0, f.x0) AS x0, greatest(g.y0, f.y0) AS y0, least(g.x1, f.x1) AS x1, least(g.y1, f.y1) AS y1, g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, gs, fs, more,
 CAST((least(g.x1, f.x1) - greatest(g.x0, f.x0)) * (least(g.y1, f.y1) - greatest(g.y0, f.y0)) AS DOUBLE) AS area FROM g JOIN f ON g.x0 < f.x1 AND f.x0 < g.x1 AND g.y0 < f.y1 AND f.y0 < g.y1)"""
NINE = "CAST(0.9 AS DOUBLE)"


def _count(key: str, member: str, box: str) -> str:
    """Unit cells that a key's members cover: `box` is a prefix of the corners."""
    return f"(SELECT {key}, count(*) AS n FROM (SELECT DISTINCT {key}, x, y FROM (SELECT {key}, x, unnest(range({box}y0, {box}y1)) AS y FROM (SELECT *, unnest(range({box}x0, {box}x1)) AS x FROM c WHERE area >= {NINE} * {member}))) GROUP BY 1)"


DECIDED = f"""p AS (SELECT a, s.total > CAST(1.05 AS DOUBLE) * (u.n + s.more) AS ambiguous, v.n >= {NINE} * s.size - 1e-9 AS covered FROM (SELECT a, sum(fs) AS total, sum(more) AS more, min(gs) AS size FROM c WHERE area >= {NINE} * fs GROUP BY 1) s JOIN {_count('a', 'fs', 'f')} u USING (a) JOIN {_count('a', 'fs', '')} v USING (a)),
 q AS (SELECT b, s.total > CAST(1.05 AS DOUBLE) * u.n AS ambiguous, v.n >= {NINE} * s.size - 1e-9 AS covered FROM (SELECT b, sum(gs) AS total, min(fs) AS size FROM c WHERE area >= {NINE} * gs GROUP BY 1) s JOIN {_count('b', 'gs', 'g')} u USING (b) JOIN {_count('b', 'gs', '')} v USING (b)),
 decided AS (SELECT c.a, c.b, area, CASE WHEN coalesce(area >= {NINE} * fs AND p.ambiguous, false) OR coalesce(area >= {NINE} * gs AND q.ambiguous, false) THEN 'ambiguous_overlap'
 WHEN coalesce(area >= {NINE} * fs AND p.covered, false) OR coalesce(area >= {NINE} * gs AND q.covered, false) THEN 'spatial_union' ELSE 'insufficient_bidirectional_coverage' END AS decision FROM c LEFT JOIN p USING (a) LEFT JOIN q USING (b)),
 rel AS (SELECT code, CASE WHEN code % 5 = 0 THEN code * 10 WHEN code % 7 = 0 THEN code * 10 + 10 END AS bd, CASE WHEN code % 4 < 2 THEN 'r' || code END AS rnb, code % 6 > 0 AS real, x0, y0, x0 + w AS x1, y0 + d AS y1 FROM bld),
 named AS (SELECT a, b, min(method) AS method FROM (SELECT rel.code AS a, b, 'explicit_bdtopo' AS method FROM rel JOIN f ON b = bd UNION ALL SELECT rel.code, b, 'explicit_rnb' FROM rel JOIN f USING (rnb)) GROUP BY ALL),
 link AS (SELECT coalesce(n.a, d.a) AS a, coalesce(n.b, d.b) AS b, coalesce(n.method, CASE WHEN decision = 'spatial_union' THEN decision END) AS method, decision, area FROM named n FULL JOIN decided d ON n.a = d.a AND n.b = d.b),
 part AS (SELECT b, 0 AS part, (x1 - x0) * (y1 - y0) AS ps, x0, y0, x1, y1, rnb FROM f UNION ALL SELECT b, 1, 4, NULL, NULL, NULL, NULL, rnb FROM f WHERE more > 0),
 unit AS (SELECT *, 'recon-' || left(sha256(b || ':' || part), 20) AS unit FROM part),
 met AS (SELECT l.a, unit.*, method, decision, CASE WHEN gs IS NOT NULL THEN coalesce(CASE WHEN part = 0 THEN area END, 0) END AS shared, gs FROM link l JOIN unit USING (b) LEFT JOIN g ON g.a = l.a WHERE (part = 0 AND area IS NOT NULL) OR method LIKE 'explicit%')"""

LINKS = f"""WITH {SHAPES}, {DECIDED},
 rows AS (SELECT unit, rel.code, rel.rnb, coalesce(rel.bd = b, false) OR coalesce(rel.rnb = met.rnb, false) OR (real AND coalesce(greatest(0, least(rel.x1, met.x1) - greatest(rel.x0, met.x0)) * greatest(0, least(rel.y1, met.y1) - greatest(rel.y0, met.y0)) >= {NINE} * greatest(ps, (rel.x1 - rel.x0) * (rel.y1 - rel.y0)), false)) AS direct
 FROM met JOIN rel ON rel.code = a WHERE method IS NOT NULL),
 ident AS (SELECT unit, 'bdtopo' AS source_type, CAST(b AS VARCHAR) AS source_id, true AS direct FROM unit UNION SELECT unit, 'rnb', rnb, true FROM unit WHERE rnb IS NOT NULL UNION SELECT unit, 'bdnb_construction', 'c' || code, direct FROM rows UNION SELECT unit, 'rnb', rnb, direct FROM rows WHERE rnb IS NOT NULL),
 links AS (SELECT unit, 'bdnb_group' AS source_type, CAST(a AS VARCHAR) AS source_id, CASE WHEN method IS NULL OR method = 'spatial_union' THEN 'spatial_verified' ELSE 'source_relation' END AS how, method IS NOT NULL AS sure, shared, shared / gs AS source_coverage, shared / ps AS physical_coverage, shared / (gs + ps - shared) AS iou,
 CASE WHEN method IS NULL THEN 'unresolved' WHEN method = 'spatial_union' THEN 'high' ELSE 'confirmed' END AS confidence, coalesce(method, CASE WHEN decision = 'ambiguous_overlap' THEN decision ELSE 'insufficient_bidirectional_coverage' END) AS reason FROM met
 UNION ALL SELECT unit, source_type, source_id, 'source_relation', direct, NULL, NULL, NULL, NULL, CASE WHEN direct THEN 'confirmed' ELSE 'unresolved' END, CASE WHEN NOT direct THEN 'physical_attribution_unresolved' END FROM ident)
 SELECT unit, source_type, source_id, how AS method, CASE WHEN NOT sure THEN 'unresolved' WHEN count(*) FILTER (sure) OVER (PARTITION BY unit, source_type) > 1 THEN 'shared_physical_unit' WHEN count(*) FILTER (sure) OVER (PARTITION BY source_type, source_id) > 1 THEN 'group_member' ELSE 'one_to_one' END AS relationship,
 round(shared, 6) AS shared, round(source_coverage, 6) AS source_coverage, round(physical_coverage, 6) AS physical_coverage, round(iou, 6) AS iou, confidence, reason FROM links"""


def _inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b, code, half = buildings(spark, sf), F.col("code"), F.floor(F.col("w") / 2)
    x0, y0, w, d = F.col("x0"), F.col("y0"), F.col("w"), F.col("d")
    box = lambda x, width: F.array(S.box_ring(x, y0, width, d)).alias("rings")
    rnb = lambda keep: F.when(keep, F.array(F.concat(F.lit("r"), code.cast("string")))).alias("rnb_ids")
    groups = b.select(code.alias("group_id"), F.when(code % 10 < 9, box(x0, w - F.when(code % 4 == 0, 4).otherwise(0))).alias("rings"))
    bdtopo = F.when(code % 5 == 0, F.array(code * 10)).when(code % 7 == 0, F.array(code * 10 + 10)).alias("bdtopo_ids")
    relations = b.select(code.alias("group_id"), F.array(F.concat(F.lit("c"), code.cast("string"))).alias("construction_ids"), bdtopo, rnb(code % 4 < 2), box(x0, w), (code % 6 == 0).alias("fictitious"))
    one = lambda keep, offset, x, width, y=None: b.filter(keep).select(code, (code * 10 + offset).alias("source_id"), F.lit(0).alias("part"), box(x, width))
    away = F.array(S.box_ring(x0 + 16, y0 + 16, F.lit(2), F.lit(2))).alias("rings")
    main = one(code % 3 > 0, 0, x0 + code % 2, w).unionByName(one(code % 3 == 0, 1, x0, half + F.floor(code % 9 / 3))).unionByName(one(code % 3 == 0, 2, x0 + half, w - half))
    features = main.select("source_id", rnb(code % 8 < 3), F.lit("unknown").alias("outline_type"))
    parts = main.drop("code").union(b.filter(code % 6 == 1).select((code * 10).alias("source_id"), F.lit(1).alias("part"), away))
    return groups, relations, features, parts


@query(LINKS)
def reconcile_links(spark, sf):
    """[J-04, J-07, J-08, J-09, A-12] links of physical units to groups, constructions, outlines and RNB numbers: explicit, spatial and unresolved."""
    _, links = R.reconcile(*_inputs(spark, sf), 20)
    return links.select("unit", "source_type", "source_id", "method", "relationship", *(F.round(c, 6).alias(c) for c in ("shared", "source_coverage", "physical_coverage", "iou")), "confidence", "reason")


@query(f"WITH {SHAPES}, {DECIDED} SELECT unit, b AS source_id, part, CASE WHEN count(method) > 0 THEN 'target' ELSE 'context' END AS role, count(method) AS n_groups FROM unit LEFT JOIN met USING (unit, b, part) GROUP BY 1, 2, 3")
def reconcile_units(spark, sf):
    """[J-08] physical units: parts of outlines, targets where a group belongs to them."""
    units, _ = R.reconcile(*_inputs(spark, sf), 20)
    return units.select("unit", "source_id", "part", "role", "n_groups")


@query(f"WITH {SHAPES}, {DECIDED} SELECT code AS group_id FROM bld WHERE code NOT IN (SELECT a FROM met WHERE method IS NOT NULL)")
def unresolved_groups(spark, sf):
    """[F-11, J-25, U-04] groups that belong to no physical unit."""
    groups, *rest = _inputs(spark, sf)
    return R.unresolved(groups, R.reconcile(groups, *rest, 20)[1])
