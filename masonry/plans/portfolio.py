"""Queries over the portfolio views; each function's SQL stands beside it in ORACLES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relations as R
from ..operators import spatial as G
from ..sources.views import BLD, FULL, PT, buildings, points, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def full(spark: SparkSession, sf: str) -> DataFrame:
    b = buildings(spark, sf)
    n, h = S.completed(F.col("height"), F.col("storeys"))
    return b.withColumns({"n": n, "h": h})


def long(c):
    return c.cast("long")


@query(f"WITH {BLD} SELECT count(*) AS n_buildings, round(sum(round(CAST(w * d AS DOUBLE), 2)), 2) AS footprint_area, round(sum(round(CAST(w * d * storeys AS DOUBLE), 2)), 2) AS floor_area, CAST(sum(storeys) AS BIGINT) AS known_storeys FROM bld")
def portfolio_totals(spark, sf):
    """[A-01, A-02, P-25] floor areas of buildings whose storeys are known only; nothing is filled in."""
    area = F.col("w") * F.col("d")
    total = lambda c: F.round(F.sum(F.round(c.cast("double"), 2)), 2)
    return buildings(spark, sf).agg(F.count(F.lit(1)).alias("n_buildings"), total(area).alias("footprint_area"), total(area * F.col("storeys")).alias("floor_area"), long(F.sum("storeys")).alias("known_storeys"))


@query(f"WITH {BLD}, {FULL} SELECT code, n, h FROM full_bld")
def height_storey_completion(spark, sf):
    """[P-20]"""
    return full(spark, sf).select("code", "n", "h")


WWR = "least(coalesce(CASE WHEN p > 1 THEN p / 100 WHEN p > 0 THEN p END, CASE WHEN g > 0 AND wall > 0 THEN g / wall END, 0.2), 0.9)"


@query(f"WITH {BLD}, v AS (SELECT code, CASE WHEN code % 3 <> 0 THEN CAST(code % 130 AS DOUBLE) / (1 + code % 2 * 99) END AS p, CASE WHEN code % 4 <> 0 THEN CAST(size % 9 AS DOUBLE) END AS g, CAST(w * d AS DOUBLE) AS wall FROM bld), r AS (SELECT code, coalesce(CASE WHEN p > 1 THEN p / 100 WHEN p > 0 THEN p END, CASE WHEN g > 0 AND wall > 0 THEN g / wall END, 0.2) AS q FROM v) SELECT code, round(CASE WHEN q >= 0.01 THEN least(q, 0.9) END, 6) AS wwr FROM r")
def wwr_completion(spark, sf):
    """[P-14, P-15]"""
    code, size = F.col("code"), F.col("size")
    published = F.when(code % 3 != 0, (code % 130).cast("double") / (1 + code % 2 * 99))
    glazed = F.when(code % 4 != 0, (size % 9).cast("double"))
    found = S.window_to_wall(published, glazed, (F.col("w") * F.col("d")).cast("double"), F.lit(0.2))
    return buildings(spark, sf).select("code", F.round(found, 6).alias("wwr"))


@query("SELECT p_partkey AS code, CASE ((((a % 360 + 360) % 360) + 45) % 360) // 90 WHEN 0 THEN 'north' WHEN 1 THEN 'east' WHEN 2 THEN 'south' ELSE 'west' END AS facing FROM (SELECT p_partkey, p_partkey * 37 % 720 - 180 AS a FROM part)")
def azimuth_bucket(spark, sf):
    """[P-17]"""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("code"), S.cardinal(F.col("p_partkey") * 37 % 720 - 180).alias("facing"))


@query(f"WITH {BLD} SELECT brand, round(least(70, CASE WHEN sum(w * d) > 0 THEN CAST(sum((180 - i) * w * d) AS DOUBLE) / sum(w * d) ELSE avg(180 - i) END), 6) AS pitch FROM (SELECT *, 90 + size * 7 % 91 AS i FROM bld) GROUP BY brand")
def roof_pitch_weighted(spark, sf):
    """[A-03]"""
    a, pitch = F.col("w") * F.col("d"), 180 - (90 + F.col("size") * 7 % 91)
    mean = F.when(F.sum(a) > 0, F.sum(pitch * a).cast("double") / F.sum(a)).otherwise(F.avg(pitch))
    return buildings(spark, sf).groupBy("brand").agg(F.round(F.least(F.lit(70), mean), 6).alias("pitch"))


ROOF = "m LIKE '%tuile%' OR m LIKE '%ardoise%' OR m LIKE '%zinc%' OR m LIKE '%alumin%' OR m LIKE '%chaume%' OR m LIKE '%bardeau%' OR m LIKE '%shingle%' OR m LIKE '%tole%' OR m LIKE '%bac acier%' OR m LIKE '%fibro%' OR m LIKE '%amiante%' OR m LIKE '%comble%' OR m LIKE '%rampant%' OR m LIKE '%charpente%'"
COVERS = ["TUILES mécaniques", "Béton", "Ardoise", "", "Tôle", "bac acier", "Étanchéité", "membrane", "Comble perdu", "chaume et béton", "lauze", "aluminium"]


@query(f"WITH f AS (SELECT p_partkey AS code, strip_accents(lower({COVERS!r}[p_partkey % 12 + 1])) AS m FROM part) SELECT code, CASE WHEN {ROOF} THEN 30.0 WHEN m LIKE '%beton%' OR m LIKE '%terrasse%' OR m LIKE '%gravier%' OR m LIKE '%bitume%' OR m LIKE '%etanch%' OR m LIKE '%membrane%' THEN 0.0 END::DOUBLE AS pitch FROM f")
def roof_keyword_class(spark, sf):
    """[P-11, P-18]"""
    code = F.col("p_partkey")
    return table(spark, sf, "part").select(code.alias("code"), S.roof_pitch(F.element_at(F.array(*map(F.lit, COVERS)), (code % 12 + 1).cast("int"))).alias("pitch"))


@query(f"WITH {BLD}, x AS (SELECT l_partkey AS code, max(l_quantity) AS height, CAST(max(l_linenumber) AS INTEGER) AS storeys FROM lineitem GROUP BY 1) SELECT b.code, coalesce(b.height, x.height) AS height, CASE WHEN b.code % 2 = 0 THEN x.storeys ELSE b.storeys END AS storeys FROM bld b LEFT JOIN x USING (code)")
def enrichment_left_join(spark, sf):
    """[J-02] heights are filled where null; storeys only where the row never had the field."""
    extra = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("code")).agg(F.max("l_quantity").alias("height"), F.max("l_linenumber").cast("int").alias("storeys"))
    return R.fill_from(buildings(spark, sf), extra, "code", ["height", "storeys"], {"storeys": F.col("code") % 2 == 0}).select("code", "height", "storeys")


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 10")
def address_lookup_join(spark, sf):
    """[J-01, O-01, W-01]"""
    o = R.first_rows(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], 10)
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT source_table, count(*) AS n, CAST(count(bdtopo_id) AS BIGINT) AS with_unit FROM (SELECT DISTINCT l_partkey AS group_id, CAST(l_suppkey AS VARCHAR) AS bdtopo_id, 'units' AS source_table FROM lineitem UNION ALL SELECT DISTINCT p_partkey, NULL, 'groups' FROM part) GROUP BY 1")
def relation_union(spark, sf):
    """[S-08, U-01]"""
    units = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("group_id"), F.col("l_suppkey").cast("string").alias("bdtopo_id")).distinct()
    rows = R.tagged_union({"units": units, "groups": table(spark, sf, "part").select(F.col("p_partkey").alias("group_id")).distinct()})
    return rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.count("bdtopo_id").alias("with_unit"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(NULL AS VARCHAR) AS rnb_id, CAST(NULL AS DOUBLE) AS altitude FROM part")
def schema_drift_projection(spark, sf):
    """[S-05]"""
    return R.drift_select(table(spark, sf, "part"), {"p_partkey": "long", "p_size": "double", "rnb_id": "string", "altitude": "double"}, ("p_partkey",))


@query("WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey // 3 END AS uprn, CASE o_orderstatus WHEN 'O' THEN 'E' WHEN 'F' THEN 'S' ELSE 'N' END AS country, CASE WHEN o_orderkey % 13 > 0 THEN round(o_totalprice / 300000, 2) END AS score FROM orders), r AS (SELECT *, coalesce(score, 0) AS sc, row_number() OVER w AS n, lead(coalesce(score, 0)) OVER w AS nxt, lead(uprn) OVER w AS other FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY coalesce(score, 0) DESC, o_orderkey)) SELECT o_custkey, uprn, sc AS score, CASE WHEN sc < 0.8 THEN 'low_score' WHEN nxt IS NOT NULL AND other IS DISTINCT FROM uprn AND sc - nxt < 0.05 THEN 'ambiguous' WHEN country NOT IN ('E', 'W', 'S') THEN 'unsupported_country' WHEN uprn IS NULL THEN 'missing_id' ELSE 'matched' END AS reason FROM r WHERE n = 1")
def match_margin(spark, sf):
    """[S-10, W-03]"""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    country = F.when(F.col("o_orderstatus") == "O", "E").when(F.col("o_orderstatus") == "F", "S").otherwise("N")
    score = F.when(key % 13 > 0, F.round(F.col("o_totalprice") / 300000, 2))
    rows = o.select("o_custkey", "o_orderkey", F.when(key % 11 > 0, F.floor(key / 3)).alias("uprn"), country.alias("country"), score.alias("score"))
    return R.best_match(rows, "o_custkey", "uprn", "score", "country", "o_orderkey")


ENDS = [" rue de la Paix", " 75002 Paris", " High St SW1A 1AA", ", England", " 75002 UK", "", ", Royaume-Uni", " GIR 0AA", " Belfast BT1 5GS", " road, Northern Ireland", " Munuk", " allée des Pins", " 75002 Paris, FRANCE", " SW1A 1AA, Scotland", " gb", "avenue"]


@query(f"WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name || {ENDS!r}[c_custkey % 16 + 1] END AS a FROM customer), f AS (SELECT *, regexp_extract(a, '(?i)\\b(?:GIR\\s*0AA|[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{{2}})\\b') AS pc, lower(regexp_extract(a, '(?i)(?:^|[,\\s])(france|fr|uk|gb|united kingdom|great britain|england|scotland|wales|royaume[- ]uni)\\s*$', 1)) AS sf, regexp_matches(a, '\\b[0-9]{{5}}\\b') AS five FROM a), g AS (SELECT *, CASE WHEN sf IN ('fr', 'france') THEN 'FR' WHEN sf <> '' THEN 'UK' END AS ex, CASE WHEN pc <> '' THEN 'UK' WHEN five THEN 'FR' END AS po FROM f) SELECT c_custkey, CASE WHEN trim(a) = '' THEN 'empty' WHEN regexp_matches(pc, '(?i)^(BT|JE|GY|IM)') OR regexp_matches(a, '(?i)\\bnorthern ireland\\b') THEN 'unsupported' WHEN ex <> po THEN 'conflict' WHEN coalesce(ex, po) IS NOT NULL THEN coalesce(ex, po) WHEN regexp_matches(a, '(?i)\\b(rue|chemin|impasse|allee|allée)\\b') THEN 'FR' ELSE 'unknown' END AS country FROM g")
def country_route(spark, sf):
    """[P-21]"""
    key = F.col("c_custkey")
    address = F.when(key % 17 == 0, " ").otherwise(F.concat("c_name", F.element_at(F.array(*map(F.lit, ENDS)), (key % 16 + 1).cast("int"))))
    return table(spark, sf, "customer").select("c_custkey", S.country(address).alias("country"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/]+/[^?#]*$') AND NOT contains(url, '..') AS allowed, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def url_whitelist(spark, sf):
    """[P-28] scheme, host and path of a page's address."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", (url.rlike("^https://[^/]+/[^?#]*$") & ~F.contains(url, F.lit(".."))).alias("allowed"), F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"))


@query(f"WITH {BLD}, {PT}, g AS (SELECT x, y, count(*) AS k FROM pt GROUP BY x, y) SELECT code, CAST(sum(k) AS BIGINT) AS n_points FROM g JOIN bld ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + d GROUP BY code")
def point_in_box_join(spark, sf):
    """[J-05, F-02] points that share a place are counted before the join."""
    p = points(spark, sf).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    b = buildings(spark, sf).select("code", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), (F.col("x0") + F.col("w")).alias("rx1"), (F.col("y0") + F.col("d")).alias("ry1"))
    return G.point_in_box(p, b, 20).groupBy("code").agg(F.sum("k").alias("n_points"))


def _boxes(spark, sf):
    b = buildings(spark, sf)
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("d")
    left = b.select(F.col("code").alias("a"), F.col("x0").alias("lx0"), F.col("y0").alias("ly0"), x1.alias("lx1"), y1.alias("ly1"))
    move = lambda c, k: (c + F.col("code") % k).cast("long")
    right = b.select(F.col("code").alias("b"), move(F.col("x0"), 17).alias("rx0"), move(F.col("y0"), 13).alias("ry0"), move(x1, 17).alias("rx1"), move(y1, 13).alias("ry1"))
    return left, right


BOXES = f"{BLD}, l AS (SELECT code AS a, x0 AS lx0, y0 AS ly0, x0 + w AS lx1, y0 + d AS ly1 FROM bld), r AS (SELECT code AS b, x0 + code % 17 AS rx0, y0 + code % 13 AS ry0, x0 + w + code % 17 AS rx1, y0 + d + code % 13 AS ry1 FROM bld), j AS (SELECT *, greatest(0, least(lx1, rx1) - greatest(lx0, rx0)) * greatest(0, least(ly1, ry1) - greatest(ly0, ry0)) AS area, (lx1 - lx0) * (ly1 - ly0) AS la, (rx1 - rx0) * (ry1 - ry0) AS ra FROM l JOIN r ON lx0 < rx1 AND rx0 < lx1 AND ly0 < ry1 AND ry0 < ly1)"


@query(f"WITH {BOXES} SELECT a, b, CAST(area AS BIGINT) AS area, round(area / CAST(la + ra - area AS DOUBLE), 6) AS iou, round(area / CAST(la AS DOUBLE), 6) AS coverage FROM j WHERE area > 0")
def box_overlap_iou(spark, sf):
    """[J-06, A-13]"""
    left, right = _boxes(spark, sf)
    pairs = G.box_join(left, right, 20).withColumn("area", G.overlap()).filter("area > 0")
    la, ra = (F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0")), (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))
    return pairs.select("a", "b", long(F.col("area")).alias("area"), F.round(F.col("area") / (la + ra - F.col("area")), 6).alias("iou"), F.round(F.col("area") / la, 6).alias("coverage"))


#: Groups (boxes of buildings, some a little smaller than what stands there) and physical outlines: whole boxes, some moved, or two halves, some of which overlap.
ASSOC = f"{BLD}, g AS (SELECT code AS a, x0, y0, x0 + w - CASE WHEN code % 4 = 0 THEN 4 ELSE 0 END AS x1, y0 + d AS y1 FROM bld), f AS (SELECT code * 10 AS b, x0 + code % 2 AS x0, y0, x0 + w + code % 2 AS x1, y0 + d AS y1 FROM bld WHERE code % 3 > 0 UNION ALL SELECT code * 10 + 1, x0, y0, x0 + w // 2 + code % 9 // 3, y0 + d FROM bld WHERE code % 3 = 0 UNION ALL SELECT code * 10 + 2, x0 + w // 2, y0, x0 + w, y0 + d FROM bld WHERE code % 3 = 0)"
CELLS = "SELECT DISTINCT {k}, x, y FROM (SELECT {k}, x, unnest(range({y0}, {y1})) AS y FROM (SELECT *, unnest(range({x0}, {x1})) AS x FROM c WHERE {cov} >= 0.9))"


def _side(k, s, cov):
    own = {"k": k, "cov": cov}
    whole = CELLS.format(**own, **{x: s + x for x in ("x0", "y0", "x1", "y1")})
    clipped = CELLS.format(**own, x0="greatest(gx0, fx0)", y0="greatest(gy0, fy0)", x1="least(gx1, fx1)", y1="least(gy1, fy1)")
    return f"SELECT {k}, u.n AS whole, v.n AS clipped, full_area FROM (SELECT {k}, sum(({s}x1 - {s}x0) * ({s}y1 - {s}y0)) AS full_area FROM c WHERE {cov} >= 0.9 GROUP BY 1) JOIN (SELECT {k}, count(*) AS n FROM ({whole}) GROUP BY 1) u USING ({k}) JOIN (SELECT {k}, count(*) AS n FROM ({clipped}) GROUP BY 1) v USING ({k})"


@query(f"WITH {ASSOC}, j AS (SELECT a, b, g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, greatest(0, least(g.x1, f.x1) - greatest(g.x0, f.x0)) * greatest(0, least(g.y1, f.y1) - greatest(g.y0, f.y0)) AS area FROM g JOIN f ON g.x0 < f.x1 AND f.x0 < g.x1 AND g.y0 < f.y1 AND f.y0 < g.y1), c AS (SELECT *, area / ((gx1 - gx0) * (gy1 - gy0)) AS ca, area / ((fx1 - fx0) * (fy1 - fy0)) AS cb FROM j WHERE area > 0), p AS ({_side('a', 'f', 'cb')}), q AS ({_side('b', 'g', 'ca')}), m AS (SELECT c.a, c.b, coalesce(cb >= 0.9 AND p.full_area > 1.05 * p.whole, false) OR coalesce(ca >= 0.9 AND q.full_area > 1.05 * q.whole, false) AS ambiguous, coalesce(cb >= 0.9 AND p.clipped >= 0.9 * (gx1 - gx0) * (gy1 - gy0), false) OR coalesce(ca >= 0.9 AND q.clipped >= 0.9 * (fx1 - fx0) * (fy1 - fy0), false) AS covered FROM c LEFT JOIN p USING (a) LEFT JOIN q USING (b)) SELECT a, b, CASE WHEN ambiguous THEN 'ambiguous_overlap' WHEN covered THEN 'spatial_union' ELSE 'insufficient_bidirectional_coverage' END AS decision FROM m")
def union_coverage_assoc(spark, sf):
    """[J-07, J-26] a group is linked to the outlines that lie in it by 0.9 if their union covers it by 0.9, and outlines likewise to groups; sides whose members overlap by more than 5 % decide nothing."""
    b, code, half = buildings(spark, sf), F.col("code"), F.floor(F.col("w") / 2)
    box = lambda k, x0, x1: [k, x0.alias("x0"), F.col("y0"), x1.alias("x1"), (F.col("y0") + F.col("d")).alias("y1")]
    x0, end = F.col("x0"), F.col("x0") + F.col("w")
    groups = b.select(*box(code.alias("a"), x0, end - F.when(code % 4 == 0, 4).otherwise(0)))
    whole = b.filter(code % 3 > 0).select(*box((code * 10).alias("b"), x0 + code % 2, end + code % 2))
    left = b.filter(code % 3 == 0).select(*box((code * 10 + 1).alias("b"), x0, x0 + half + F.floor(code % 9 / 3)))
    right = b.filter(code % 3 == 0).select(*box((code * 10 + 2).alias("b"), x0 + half, end))
    return R.union_coverage(groups, whole.unionByName(left).unionByName(right), 20)


LINKS = "l AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS unit FROM lineitem WHERE l_quantity >= 48), u AS (SELECT unit, count(*) AS s FROM l GROUP BY 1), g AS (SELECT source, count(*) AS n FROM l GROUP BY 1)"


def _links(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("unit"))


@query(f"WITH {LINKS} SELECT source, unit, CASE WHEN s > 1 THEN 'shared_physical_unit' WHEN n > 1 THEN 'group_member' ELSE 'one_to_one' END AS relationship FROM l JOIN u USING (unit) JOIN g USING (source)")
def link_cardinality(spark, sf):
    """[A-12]"""
    return R.cardinality(_links(spark, sf), "source", "unit")


@query(f"WITH {LINKS} SELECT p_partkey AS source, count(unit) AS n_units, count(unit) > 0 AND coalesce(bool_and(unit % 5 <> 0), false) AS verified FROM part LEFT JOIN l ON source = p_partkey GROUP BY 1")
def association_gate(spark, sf):
    """[F-10, F-11, J-25] verified: there are links, and all of them are resolved."""
    links = _links(spark, sf).distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("source"))
    resolved = (F.count("unit") > 0) & F.coalesce(F.bool_and(F.col("unit") % 5 != 0), F.lit(False))
    return parts.join(links, "source", "left").groupBy("source").agg(F.count("unit").alias("n_units"), resolved.alias("verified"))


@query(f"WITH {LINKS}, v AS (SELECT unit, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN ['', 'not provided'][p_size % 2 + 1] ELSE 'v' || p_size % 3 END AS v FROM l JOIN part ON p_partkey = source), k AS (SELECT unit, CASE WHEN v NOT IN ('', 'not provided') THEN v END AS v FROM v) SELECT unit, CASE WHEN count(v) = 0 THEN 'missing' WHEN count(DISTINCT v) > 1 THEN 'conflicting' WHEN count(v) < count(*) THEN 'incomplete_source_coverage' ELSE 'available' END AS status, CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS value, count(v) AS n_known, count(*) AS n_sources FROM k GROUP BY unit")
def consensus_attributes(spark, sf):
    """[A-04, J-10, J-11]"""
    size = F.col("p_size")
    v = F.when(size % 5 == 0, None).when(size % 5 == 1, F.when(size % 2 == 1, S.NOT_PROVIDED).otherwise("")).otherwise(F.concat(F.lit("v"), (size % 3).cast("string")))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), v.alias("v"))
    return R.consensus(_links(spark, sf).distinct().join(p, "source"), "unit", "v", ("", S.NOT_PROVIDED))


DIST = "greatest(x0 - x, x - x0 - w, 0)"


@query(f"WITH {BLD}, {PT}, o AS (SELECT * FROM pt WHERE class = 2 AND NOT EXISTS (SELECT 1 FROM bld WHERE x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + d)), n AS (SELECT code, z, sqrt(power(greatest(x0 - x, x - x0 - w, 0), 2) + power(greatest(y0 - y, y - y0 - d, 0), 2)) AS r FROM o JOIN bld ON x BETWEEN x0 - 10 AND x0 + w + 10 AND y BETWEEN y0 - 10 AND y0 + d + 10), b AS (SELECT code, k, count(*) AS n, quantile_cont(z, 0.05) AS g FROM n, (SELECT unnest([3, 6, 10]) AS k) WHERE r < k GROUP BY code, k HAVING count(*) >= 3) SELECT code, min(k) AS radius, round(arg_min(g, k), 6) AS ground FROM b GROUP BY code")
def ground_ring_percentile(spark, sf):
    """[J-12, A-07] the 5th percentile of ground points outside all outlines, in the least ring of 3, 6 and 10 m that has three."""
    b = buildings(spark, sf).select("code", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("d")).alias("y1"))
    boxes = b.select(F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    wide = b.withColumns({"rx0": F.col("x0") - 10, "ry0": F.col("y0") - 10, "rx1": F.col("x1") + 10, "ry1": F.col("y1") + 10})
    near = G.point_in_box(G.outside_boxes(points(spark, sf).filter("class = 2").select("x", "y", "z"), boxes, 20), wide, 20)
    gap = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0))
    near = near.withColumn("r", F.sqrt(F.pow(gap("x", "x0", "x1"), 2) + F.pow(gap("y", "y0", "y1"), 2))).filter("r < 10")
    ring = lambda k: F.when(F.col("r") < k, F.col("z"))
    rings = near.groupBy("code").agg(*(f for k in (3, 6, 10) for f in (F.count(ring(k)).alias(f"n{k}"), F.percentile(ring(k), 0.05).alias(f"g{k}"))))
    least = lambda c: F.when(F.col("n3") >= 3, c(3)).when(F.col("n6") >= 3, c(6)).when(F.col("n10") >= 3, c(10))
    return rings.select("code", least(F.lit).alias("radius"), F.round(least(lambda k: F.col(f"g{k}")), 6).alias("ground")).filter("radius is not null")


@query(f"WITH {PT} SELECT CASE WHEN class = 67 THEN 6 ELSE class END AS class, count(*) AS n, CAST(count(*) FILTER (class = 67) AS BIGINT) AS remapped FROM pt GROUP BY 1")
def class_remap_histogram(spark, sf):
    """[S-19, A-09]"""
    p = points(spark, sf)
    return p.groupBy(F.when(F.col("class") == 67, 6).otherwise(F.col("class")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == 67).alias("remapped"))


@query(f"WITH {BLD}, {PT}, g AS (SELECT DISTINCT x, y FROM pt WHERE class <> 2) SELECT code, count(x) AS covered, round(count(x) / CAST(any_value(w * d) AS DOUBLE), 6) AS coverage FROM bld LEFT JOIN g ON x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + d GROUP BY code")
def cell_coverage(spark, sf):
    """[G-11, A-10] share of unit cells with a roof point."""
    cells = points(spark, sf).filter("class <> 2").select("x", "y").distinct()
    b = buildings(spark, sf).withColumns({"rx0": F.col("x0"), "ry0": F.col("y0"), "rx1": F.col("x0") + F.col("w") - 1, "ry1": F.col("y0") + F.col("d") - 1})
    hit = G.point_in_box(cells, b.select("code", "rx0", "ry0", "rx1", "ry1"), 20).groupBy("code").agg(F.count(F.lit(1)).alias("covered"))
    return b.join(hit, "code", "left").select("code", F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce("covered", F.lit(0)) / (F.col("w") * F.col("d")), 6).alias("coverage"))


@query(f"WITH {PT}, r AS (SELECT *, row_number() OVER (ORDER BY t, x, y, z, e, o, ln) - 1 AS i, count(*) OVER () AS n FROM pt) SELECT class, o, ln, e, t FROM r WHERE i % greatest(1, CAST(ceil(n / 20000.0) AS BIGINT)) = 0")
def stride_sample(spark, sf):
    """[W-02]"""
    return R.stride_sample(points(spark, sf), ["t", "x", "y", "z", "e", "o", "ln"]).select("class", "o", "ln", "e", "t")


@query(f"WITH {PT}, p AS (SELECT class, least(abs(z - 10), abs(z - 25), abs(z - 40)) AS r FROM pt) SELECT class, quantile_cont(r, 0.5) AS median, round(quantile_cont(r, 0.95), 6) AS p95, CASE WHEN quantile_cont(r, 0.5) > 0.2 OR quantile_cont(r, 0.95) > 0.5 THEN 'needs_review' ELSE 'passed' END AS status FROM p GROUP BY class")
def residual_percentiles(spark, sf):
    """[J-14, A-08] distance to the nearest of three level planes."""
    r = F.least(*(F.abs(F.col("z") - k) for k in (10, 25, 40)))
    found = points(spark, sf).select("class", r.alias("r")).groupBy("class").agg(F.percentile("r", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return found.select("class", F.col("q")[0].alias("median"), F.round(F.col("q")[1], 6).alias("p95"), F.when((F.col("q")[0] > 0.2) | (F.col("q")[1] > 0.5), "needs_review").otherwise("passed").alias("status"))


@query("SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS epochs, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS INTEGER) AS span, max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) <= 31 AS mixed_allowed FROM orders GROUP BY 1")
def mission_span(spark, sf):
    """[A-14, A-15]"""
    day = F.to_date("o_orderdate")
    span = F.datediff(F.max(day), F.min(day))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(day).alias("epochs"), span.alias("span"), (span <= 31).alias("mixed_allowed"))


@query(f"WITH {BLD}, {FULL} SELECT code, i AS storey, round(i * h / n, 6) AS level, CAST(w * d AS DOUBLE) * h / n AS volume FROM (SELECT *, unnest(range(0, n)) AS i FROM full_bld)")
def storey_explode(spark, sf):
    """[W-08, M-02]"""
    f = full(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return f.select("code", long(F.col("i")).alias("storey"), F.round(F.col("i") * F.col("h") / F.col("n"), 6).alias("level"), ((F.col("w") * F.col("d")).cast("double") * F.col("h") / F.col("n")).alias("volume"))


@query(f"WITH {BLD}, {FULL}, e AS (SELECT code, h, s, CASE s WHEN 0 THEN 'south' WHEN 1 THEN 'east' WHEN 2 THEN 'north' ELSE 'west' END AS facing, CASE WHEN s % 2 = 0 THEN w ELSE d END AS len FROM full_bld, (SELECT unnest(range(0, 4)) AS s)) SELECT code, sum(len * h) AS exterior, sum(CASE WHEN facing IN ('south', 'west') THEN len * h ELSE 0 END) AS eligible, round(sum(CASE WHEN facing IN ('south', 'west') THEN len * h * 0.25 ELSE 0 END), 6) AS glazed, CAST(count(*) FILTER (facing IN ('south', 'west')) AS BIGINT) AS windows FROM e GROUP BY code")
def wall_explode_glazing(spark, sf):
    """[M-02, F-07, M-05, A-22, W-05] walls from ring edges; windows on south and west walls."""
    ring = S.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("d"))
    walls = full(spark, sf).withColumn("ring", ring).select("code", "h", "ring", F.posexplode("ring").alias("s", "p"))
    q = F.get("ring", F.pmod(F.col("s") + 1, F.size("ring")))
    dx, dy = q["x"] - F.col("p.x"), q["y"] - F.col("p.y")
    walls = walls.select("code", F.hypot(dx, dy).alias("len"), "h", S.cardinal(F.pmod(F.degrees(F.atan2(dy, -dx)) + 90, F.lit(360))).alias("facing"))
    area, ok = F.col("len") * F.col("h"), F.col("facing").isin("south", "west")
    return walls.groupBy("code").agg(F.sum(area).alias("exterior"), F.sum(F.when(ok, area).otherwise(0)).alias("eligible"), F.round(F.sum(F.when(ok, area * 0.25).otherwise(0)), 6).alias("glazed"), F.count_if(ok).alias("windows"))


@query(f"WITH {BLD} SELECT code, CAST(w * d AS DOUBLE) AS area, true AS counter_clockwise FROM bld")
def shoelace_area(spark, sf):
    """[G-03, A-19]"""
    area = S.ring_area(S.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("d")))
    return buildings(spark, sf).select("code", F.abs(area).alias("area"), (area > 0).alias("counter_clockwise"))


@query(f"WITH {BLD}, {FULL} SELECT code, round(w * d * h, 6) AS volume FROM full_bld")
def prism_volume(spark, sf):
    """[A-18] volume by fans of signed tetrahedra over the faces of a prism."""
    f = full(spark, sf)
    x0, y0, x1, y1 = F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.col("d").cast("double")
    low, high = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], F.col("h")
    bottom, top = [(*p, F.lit(0.0)) for p in low[::-1]], [(*p, high) for p in low]
    sides = [[(*low[i], F.lit(0.0)), (*low[(i + 1) % 4], F.lit(0.0)), (*low[(i + 1) % 4], high), (*low[i], high)] for i in range(4)]
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    volume = sum((det(face[0], face[i], face[i + 1]) for face in (bottom, top, *sides) for i in (1, 2)), F.lit(0.0)) / 6
    return f.select("code", F.round(volume, 6).alias("volume"))


@query(f"WITH {BLD} SELECT code, CAST(12 AS BIGINT) AS n_edges, code % 10 <> 0 AS manifold FROM bld")
def edge_manifold_check(spark, sf):
    """[A-20] each edge of a closed solid is used twice, in opposite directions; every tenth lacks its top face's turn."""
    faces = [[3, 2, 1, 0], [4, 5, 6, 7], *([i, (i + 1) % 4, (i + 1) % 4 + 4, i + 4] for i in range(4))]
    edges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("face")) for k, f in enumerate(faces) for a, b in zip(f, f[1:] + f[:1], strict=True)))
    e = buildings(spark, sf).select("code", F.explode(edges).alias("e"))
    turned = (F.col("code") % 10 == 0) & (F.col("e.face") == 1)
    way = F.when((F.col("e.a") < F.col("e.b")) != turned, 1).otherwise(-1)
    used = e.groupBy("code", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.sum(way).alias("s"))
    return used.groupBy("code").agg(F.count(F.lit(1)).alias("n_edges"), F.bool_and((F.col("k") == 2) & (F.col("s") == 0)).alias("manifold"))


@query(f"WITH {BLD}, {FULL}, t AS (SELECT code, x0, y0, h, CASE WHEN code % 3 = 0 THEN 20 ELSE w END AS w, d FROM full_bld) SELECT l.code AS a, r.code AS b, CAST(least(l.d, r.d) AS DOUBLE) * least(l.h, r.h) AS area FROM t l JOIN t r ON l.x0 + l.w = r.x0 AND l.y0 = r.y0")
def party_wall_pairs(spark, sf):
    """[J-16, J-23] walls on one plane with opposite normals; the shared area of each pair."""
    t = full(spark, sf).select("code", "x0", "y0", "h", "d", F.when(F.col("code") % 3 == 0, 20).otherwise(F.col("w")).alias("w"))
    left = t.select(F.col("code").alias("a"), (F.col("x0") + F.col("w")).alias("plane"), "y0", F.col("d").alias("ld"), F.col("h").alias("lh"))
    right = t.select(F.col("code").alias("b"), F.col("x0").alias("plane"), "y0", F.col("d").alias("rd"), F.col("h").alias("rh"))
    return left.join(right, ["plane", "y0"]).select("a", "b", (F.least("ld", "rd").cast("double") * F.least("lh", "rh")).alias("area"))


VERTEX = "v AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 300 AS DOUBLE) AS x, CAST(p_partkey * 104729 % 260 AS DOUBLE) AS y FROM part)"


@query(f"WITH {VERTEX} SELECT l.id AS a, r.id AS b FROM v l JOIN v r ON l.id < r.id AND abs(l.x - r.x) < 12 AND abs(l.y - r.y) < 12")
def epsilon_vertex_join(spark, sf):
    """[J-17, P-32]"""
    key = F.col("p_partkey")
    return G.near_pairs(table(spark, sf, "part").select(key.alias("id"), (key * 7919 % 300).cast("double").alias("x"), (key * 104729 % 260).cast("double").alias("y")), 12)


@query("WITH i AS (SELECT l_suppkey AS k, l_partkey % 977 * 10 AS lo, l_partkey % 977 * 10 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem), m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM i), g AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, g")
def interval_merge(spark, sf):
    """[W-07]"""
    lo = F.col("l_partkey") % 977 * 10
    return G.merge_intervals(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi")), "k", "lo", "hi")


@query(f"WITH {BLD} SELECT code, CASE WHEN code % 3 = 2 THEN NULL WHEN code % 3 = 1 THEN 5 ELSE 4 END::INTEGER AS n_vertices, CASE WHEN code % 3 < 2 THEN CAST(w * d AS DOUBLE) END AS area FROM bld")
def ring_dedupe(spark, sf):
    """[W-04] rings with repeated corners and a closing one keep their area; of a chain of near vertices those far enough from the last one kept stay (here one of five); a ring of near vertices only is none."""
    x0, y0, code = F.col("x0"), F.col("y0"), F.col("code")
    ring = S.box_ring(x0, y0, F.col("w"), F.col("d"))
    at = lambda k: F.struct((x0 + 0.0004 * k).cast("double").alias("x"), y0.cast("double").alias("y"))
    chain = F.array(*map(at, range(1, 5)))
    doubled = F.concat(F.slice(ring, 1, 2), F.slice(ring, 2, 3), F.slice(ring, 1, 1))
    given = F.when(code % 3 == 0, doubled).when(code % 3 == 1, F.concat(F.slice(ring, 1, 1), chain, F.slice(ring, 2, 3))).otherwise(F.concat(F.slice(chain, 1, 2), F.slice(chain, 1, 2)))
    b = buildings(spark, sf).withColumn("ring", S.clean_ring(given))
    return b.select("code", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_vertices"), F.round(S.ring_area(F.col("ring")), 6).alias("area"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf):
    """[P-31, K-09]"""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


REASONS = ["insufficient_roof_points", "large_roof_evidence_gap", "roof_residual_threshold_exceeded", "geometry_invalid", "crs_mismatch", "bdnb_assumed_roof_height", "lod_unavailable"]
#: Reasons that are reported but don't block, and failures after which the simpler model is tried.
REPORTED = ["insufficient_roof_points", "insufficient_ground_points", "insufficient_roof_density", "insufficient_roof_coverage", "insufficient_roof_surface_coverage", "large_roof_evidence_gap", "roof_residual_threshold_exceeded", "ground_residual_threshold_exceeded", "coverage_computation_limit", "unsupported_overhang_surface_evidence", "undefined_outline_semantics", "user_assumed_roof_height", "bdnb_assumed_roof_height"]
RETRIED = ["fallback_lod1", "lod_unavailable", "geometry_invalid", "unsupported_geometry", "planarity_tolerance_exceeded", "vertex_equivalence_collapsed_edge", "vertex_cleanup_degenerate_ring", "validator_invalid"]


@query(f"WITH r AS (SELECT o_orderkey, list_sort(list_distinct(coalesce(list(CASE WHEN l_quantity > 10 THEN {REASONS!r}[l_linenumber % 7 + 1] END) FILTER (l_quantity > 10), []))) AS reasons FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 OR list_has_any(reasons, ['geometry_invalid', 'crs_mismatch', 'lod_unavailable']) AS blocked, list_has_any(reasons, ['geometry_invalid', 'lod_unavailable']) AS retried FROM r")
def reason_gate(spark, sf):
    """[F-08, F-09] of what is to be reviewed, reasons outside the reportable list block, and so does having none; some call for the simpler model."""
    reason = F.when(F.col("l_quantity") > 10, F.element_at(F.array(*map(F.lit, REASONS)), F.col("l_linenumber") % 7 + 1))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), reason.alias("reason"))
    r = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").groupBy("o_orderkey").agg(F.array_sort(F.collect_set("reason")).alias("r"))
    listed = lambda words: F.array(*map(F.lit, words))
    return r.select("o_orderkey", F.array_join("r", ",").alias("reasons"), ((F.size("r") == 0) | (F.size(F.array_except("r", listed(REPORTED))) > 0)).alias("blocked"), F.arrays_overlap("r", listed(RETRIED)).alias("retried"))


@query("""WITH f AS (SELECT p_partkey AS k, p_size AS s, p_type AS t FROM part) SELECT 'g' || k AS code, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 3 = 1 THEN 'r' || k END AS construction_id, CASE WHEN k % 4 > 0 THEN s / 4.0 END AS height,
 CASE WHEN k % 5 > 0 THEN CAST(s // 3 AS INTEGER) END AS storeys, s % 2 = 0 AS fictitious, CAST((k % 3 > 0)::INT + (s > 10)::INT AS INTEGER) AS facings, CASE WHEN k % 2 = 0 THEN t ELSE 'Zinc' END AS roof_material,
 CASE WHEN k % 7 > 0 THEN 'type ' || k % 7 ELSE 'not provided' END AS wall_insulation, CASE WHEN s % 8 > 0 THEN (s % 8) / 2.0 END AS window_u_value, CASE WHEN s <= 20 THEN s / 20.0 END AS window_solar_factor, false AS roof_unknown FROM f""")
def group_rows(spark, sf):
    """[P-07, P-35, F-06, P-01 to P-04, P-08] rows as JSON texts with absent, blank and unreadable values."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    row = F.struct(
        F.concat(F.lit("g"), text(k)).alias("batiment_groupe_id"),
        F.when(k % 3 == 0, F.concat(F.lit(" c"), text(k))).otherwise("  ").alias("batiment_construction_id"),
        F.when(k % 3 != 2, F.concat(F.lit("r"), text(k))).alias("rnb_id"),
        F.when(k % 4 != 0, text(s / 4)).otherwise("unknown").alias("hauteur_mean"),
        F.when(k % 5 != 0, s / 3).alias("nb_niveau"),
        F.when(s % 2 == 0, "Vrai").otherwise("non").alias("contient_fictive_geom_groupe"),
        (k % 3).alias("surface_vitree_nord"),
        (s - 10).alias("surface_vitree_sud"),
        F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("materiaux_toiture_simplifie"),
        F.lit("Zinc").alias("mat_toit_txt"),
        F.when(k % 7 != 0, F.concat(F.lit("type "), text(k % 7))).alias("type_isolation_mur_exterieur"),
        ((s % 8) / 2).alias("uw"),
        (s / 20).alias("facteur_solaire_baie_vitree"),
    )
    groups = R.building_groups(table(spark, sf, "part").select(F.to_json(row).alias("row")))
    return groups.select("code", "construction_id", "height", "storeys", "fictitious", F.size("glazed_areas").alias("facings"), "roof_material", "wall_insulation", "window_u_value", "window_solar_factor", "roof_unknown")


@query("""WITH f AS (SELECT p_partkey AS k, p_size AS s FROM part), o AS (SELECT k, s, CASE k % 5 WHEN 0 THEN ['north', 'south', 'east'] WHEN 1 THEN ['east', 'west'] WHEN 2 THEN [] WHEN 3 THEN ['south'] ELSE [] END AS named FROM f)
 SELECT 'g' || k AS code, array_to_string(CASE WHEN len(named) > 0 THEN named ELSE list_filter([CASE WHEN k % 3 > 0 THEN 'north' END, CASE WHEN s > 10 THEN 'south' END], lambda x: x IS NOT NULL) END, ',') AS facings FROM o""")
def group_orientations(spark, sf):
    """[P-05, P-07, P-16, P-35] rows with orientations as JSON arrays, braced texts, blanks and nulls; where none is named, the sides with glazing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    listed = F.when(k % 5 == 0, '["nord", null, "Sud-Est"]').when(k % 5 == 1, '"{est, ,\\"Ouest\\"}"').when(k % 5 == 2, "[]").when(k % 5 == 3, '["Façade SUD", "inconnu"]').otherwise("null")
    row = F.concat(F.lit('{"batiment_groupe_id": "g'), k.cast("string"), F.lit('", "l_orientation_baie_vitree": '), listed, F.lit(', "surface_vitree_nord": '), (k % 3).cast("string"), F.lit(', "surface_vitree_sud": "'), (s - 10).cast("string"), F.lit('"}'))
    groups = R.building_groups(table(spark, sf, "part").select(row.alias("row")))
    return groups.select("code", F.array_join(S.orientations(F.col("orientations"), F.col("glazed_areas")), ",").alias("facings"))


@query(f"""WITH {BLD}, e AS (SELECT brand, size, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(3 * y0) AS DOUBLE) AS y0, CAST(max(x0 + w) AS DOUBLE) AS x1, CAST(max(3 * y0 + d) AS DOUBLE) AS y1, coalesce(min(height), 0.0) AS ground, bool_or(code % 40 = 0) AS fictitious FROM bld GROUP BY 1, 2)
 SELECT brand || '/' || size AS area, x0 - 30 AS west, y0 - 30 AS south, x1 + 30 AS east, y1 + 30 AS north, (x0 + x1) / 2 AS centre_x, (y0 + y1) / 2 AS centre_y, ground AS reference_elevation,
 CASE WHEN x1 <= 180 AND y1 <= 90 THEN 'EPSG:4326' ELSE 'EPSG:2154' END AS crs, CASE WHEN fictitious THEN 'fictitious_outline' WHEN x1 - x0 + 60 > 2000 OR y1 - y0 + 60 > 2000 THEN 'extent_limit' END AS reason FROM e""")
def area_extents(spark, sf):
    """[A-05, A-06, P-22, P-30]"""
    b = buildings(spark, sf)
    y = 3 * F.col("y0")
    boxes = b.select(F.concat("brand", F.lit("/"), F.col("size").cast("string")).alias("area"), "x0", y.alias("y0"), (F.col("x0") + F.col("w")).alias("x1"), (y + F.col("d")).alias("y1"), F.col("height").alias("ground"), (F.col("code") % 40 == 0).alias("fictitious"))
    return G.extents(boxes, "area")


#: Features whose properties depend on part, and the values that they stand for.
FEATURES = """f AS (SELECT p_partkey AS k, p_size AS s FROM part), v AS (SELECT k, s,
 CASE WHEN k % 11 <> 0 THEN 'osgb' || k WHEN k % 2 = 0 THEN 'f' || k END AS code, CASE WHEN k % 3 <> 0 THEN CAST(k % 5 AS DOUBLE) * 2.5 END AS top,
 CASE WHEN k % 4 <> 0 THEN CAST(s AS DOUBLE) END AS most, s / 2.0 AS floors, k % 13 <> 0 AS shaped FROM f)"""


def _features(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    k, s = F.col("k"), F.col("s")
    text = lambda c: c.cast("string")
    properties = F.struct(
        F.when(k % 11 != 0, F.concat(F.lit("osgb"), text(k))).alias("osid"),
        F.when(k % 3 != 0, (k % 5) * 2.5).alias("height_relativeroofbase_m"),
        F.when(k % 4 != 0, text(s)).otherwise("NaN").alias("height_relativemax_m"),
        (s / 2.0).alias("numberoffloors"),
        (s - 20).alias("height_absolutemin_m"),
        F.when(s % 6 != 0, s * 3).otherwise(-1).alias("geometry_area_m2"),
        F.element_at(F.array(*map(F.lit, ["Flat", "PITCHED", "Mixed"])), (s % 3 + 1).cast("int")).alias("roofshapeaspect_shape"),
        F.when(s % 4 != 0, "Slate").alias("roofmaterial_primarymaterial"),
    )
    shape = F.when(k % 13 != 0, F.struct(F.lit("Point").alias("type"), F.array(k, s).alias("coordinates")))
    feature = F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("f"), text(k))).alias("id"), shape.alias("geometry"), properties.alias("properties")))
    return p.select(F.when(k % 17 == 0, F.substring(feature, 2, 1000)).otherwise(feature).alias("feature"))


@query(f"""WITH {FEATURES}, r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'malformed' WHEN code IS NULL OR NOT shaped THEN 'missing_id_or_geometry' END AS reason, CASE WHEN top > 0 THEN top END AS t FROM v)
 SELECT CASE WHEN reason IS NULL THEN code END AS code, CASE WHEN reason IS NULL THEN coalesce(t, most) END AS height, CASE WHEN reason IS NULL AND s % 2 = 0 THEN CAST(s // 2 AS INTEGER) END AS storeys, CASE WHEN reason IS NULL THEN CAST(s - 20 AS DOUBLE) END AS ground_elevation,
 CASE WHEN reason IS NULL AND s % 6 <> 0 THEN CAST(s * 3 AS DOUBLE) END AS footprint_area, CASE WHEN reason IS NULL THEN CASE WHEN t IS NULL AND most IS NOT NULL THEN 'flat' WHEN s % 3 = 0 THEN 'flat' WHEN s % 3 = 1 THEN 'pitched' END END AS roof_shape, CASE WHEN reason IS NULL AND s % 4 <> 0 THEN 'Slate' END AS roof_material, reason FROM r""")
def british_features(spark, sf):
    """[P-09, P-10, S-12]"""
    return R.british_buildings(_features(spark, sf))


@query("WITH u AS (SELECT p_partkey AS code, CAST(p_size % 9 AS DOUBLE) AS u FROM part), r AS (SELECT code, CASE WHEN u > 0 THEN 1 / u - 0.13 - 0.04 END AS r FROM u) SELECT code, round(CASE WHEN r > 0 THEN r END, 6) AS resistance FROM r")
def equivalent_resistance(spark, sf):
    """[M-10, P-08]"""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.round(S.resistance((F.col("p_size") % 9).cast("double")), 6).alias("resistance"))


@query("SELECT * FROM (SELECT o_custkey, o_orderstatus, 'left' AS side FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT o_custkey, o_orderstatus, 'right' FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders))")
def two_way_inventory_diff(spark, sf):
    """[U-06, M-09]"""
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.difference(a.select("o_custkey", "o_orderstatus"), a.filter("o_orderkey % 10 <> 0").select("o_custkey", "o_orderstatus"))


@query("SELECT name, file FROM (SELECT o_custkey, CASE WHEN count(*) > 1 THEN 'FR:' || min(o_orderkey) || ' and ' || (count(*) - 1) || ' more' ELSE 'FR:' || min(o_orderkey) END AS name FROM orders GROUP BY 1), LATERAL (SELECT regexp_replace(regexp_replace(name, '[^\\w.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file)")
def model_naming(spark, sf):
    """[P-27]"""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(S.model_name(F.concat(F.lit("FR:"), F.min("o_orderkey").cast("string")), F.count(F.lit(1))).alias("name"))
    return g.select("name", S.file_name(F.col("name")).alias("file"))


@query(f"WITH {PT} SELECT class, o, ln, row_number() OVER (ORDER BY t, x, y, z, e, o, ln) - 1 AS n FROM pt")
def canonical_point_order(spark, sf):
    """[O-03] every point with its place in the canonical order."""
    return R.ordered(points(spark, sf), ["t", "x", "y", "z", "e", "o", "ln"], "n").select("class", "o", "ln", F.col("n").cast("long").alias("n"))


@query(f"WITH {BLD}, {FULL}, r AS (SELECT code, (x0 - y0) * cos(radians(45)) AS u, (x0 + y0) * sin(radians(45)) * sin(radians(28)) + h * cos(radians(28)) AS v FROM full_bld), m AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM r) SELECT code, round(40 + (u - u0) * least(1120 / (u1 - u0), 820 / (v1 - v0)), 4) AS px, round(860 - (v - v0) * least(1120 / (u1 - u0), 820 / (v1 - v0)), 4) AS py FROM r, m")
def svg_projection(spark, sf):
    """[V-01, V-04] axonometric projection, fitted to a 1200 x 900 canvas with a margin of 40."""
    q, e = F.radians(F.lit(45.0)), F.radians(F.lit(28.0))
    r = full(spark, sf).select("code", ((F.col("x0") - F.col("y0")) * F.cos(q)).alias("u"), ((F.col("x0") + F.col("y0")) * F.sin(q) * F.sin(e) + F.col("h") * F.cos(e)).alias("v"))
    m = r.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    scale = F.least(1120 / (F.col("u1") - F.col("u0")), 820 / (F.col("v1") - F.col("v0")))
    return r.join(F.broadcast(m)).select("code", F.round(40 + (F.col("u") - F.col("u0")) * scale, 4).alias("px"), F.round(860 - (F.col("v") - F.col("v0")) * scale, 4).alias("py"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), event_type) AS tag FROM events")
def json_props_coalesce(spark, sf):
    """[P-05, P-07]"""
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.page"), "event_type").alias("tag"))


@query(f"WITH {BLD}, v AS (SELECT code, storeys, height, w * d AS area, CASE code % 4 WHEN 0 THEN NULL WHEN 1 THEN code || ' rue de Metz 31000 Toulouse' WHEN 2 THEN '1 High Street' ELSE '' END AS address, CASE WHEN code % 3 > 0 THEN 'Toulouse' END AS city FROM bld), s AS (SELECT *, CASE code % 4 WHEN 1 THEN code || ' rue de Metz' WHEN 2 THEN '1 High Street' END AS street, list_filter(['an approximate footprint of ' || area || ' m²', 'an estimated floor area of ' || (area * storeys) || ' m²', 'a height of ' || CAST(height AS INTEGER) || '.0 m'], lambda f: f IS NOT NULL) AS facts FROM v) SELECT code, coalesce(storeys || '-storey building', 'Building') || CASE WHEN street IS NOT NULL AND city IS NOT NULL THEN ' located at ' || street || ', in ' || city WHEN street IS NOT NULL THEN ' located at ' || street WHEN city IS NOT NULL THEN ' located in ' || city ELSE '' END || ', with ' || CASE WHEN len(facts) = 1 THEN facts[1] ELSE array_to_string(facts[1:len(facts) - 1], ', ') || ', and ' || facts[len(facts)] END || '.' AS description FROM s")
def description_text(spark, sf):
    """[P-23, P-24] known facts only."""
    code, area = F.col("code"), F.col("w") * F.col("d")
    address = F.when(code % 4 == 1, F.concat(code.cast("string"), F.lit(" rue de Metz 31000 Toulouse"))).when(code % 4 == 2, "1 High Street").when(code % 4 == 3, "")
    city = F.when(code % 3 > 0, "Toulouse")
    return buildings(spark, sf).select("code", S.description(F.col("storeys"), address, city, area, F.col("height"), F.lit(True)).alias("description"))
